"""Operator 11: exact deduplication by content-defined chunk recipes, in DataFrame functions only.

1. A text is cut into chunks where its own content says so: at the first end of a line or sentence
   that is ``SHORTEST`` characters or more after the last cut, after ``LONGEST`` at the latest.
2. Chunks are grouped by (hash, content), with partial aggregation before the shuffle, so chunks
   are compared as strings, not by hash alone. Contents that share a hash are numbered; a chunk's
   identifier is its hash and that number (0 for all contents of a hash but the later ones, which
   are the only ones that need an entry; as a rule there are none).
3. A text's recipe is the ordered list of its identifiers, some 8 bytes for each 1,000 characters.
   Two texts are equal exactly if their recipes are, so from here on only recipes move: each text's
   bytes have moved once, in step 2, however many rounds of grouping and joining follow.

Scale: step 2 moves each distinct chunk of a map task once. Groups are formed by aggregation, never
by a window, so a text that a third of all rows hold is one row per map task; the join back to
the rows is between two exchanges, which adaptive execution can split, and only groups of two and more
rows take part in it. The numbering of contents that share a hash is by a window over these contents
alone.

Edge cases: null text counts as empty; empty texts are one group (an empty recipe). The text has
to be valid UTF-8. Of rows that share text and doc_id one is kept; a null doc_id is below all
others. An empty table gives an empty result. Further columns of the input, whatever their names,
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SHORTEST, LONGEST = 1024, 8192


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The chunks of a text as an array; joined they are the text again."""
    rule = rf"(?s).{{{shortest - 1},{longest - 2}}}?(?:\n|[.!?;:]\s)|.{{1,{longest}}}"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rule), F.lit(0))


def shared_hashes(parts: DataFrame) -> DataFrame:
    """h: the hashes that have several contents, from a table with h and chunk."""
    return parts.select("h", "chunk").distinct().groupBy("h").agg(F.count("*").alias("_contents")).filter("_contents > 1").select("h")


def later_contents(parts: DataFrame, shared: DataFrame) -> DataFrame:
    """h, chunk, k >= 1: the contents after the first of each hash in ``shared``."""
    contents = parts.join(shared, "h", "left_semi").select("h", "chunk").distinct()
    k = F.row_number().over(Window.partitionBy("h").orderBy("chunk")) - 1
    return contents.select("h", "chunk", k.alias("k")).filter("k > 0")


def recipes(docs: DataFrame, name=F.xxhash64, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """doc_id, rid, n_chunks, recipe, later, text_sha256: one row per row of ``docs``, written out.

    ``recipe`` lists the chunks' hashes and ``later`` numbers those that are not the first
    content of their hash, as (position, number). ``name`` hashes a chunk to a long.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("cut", chunks(F.col("text"), shortest, longest))
    parts = d.select(F.explode("cut").alias("chunk")).select(name("chunk").alias("h"), "chunk")
    shared = materialize(shared_hashes(parts), "exact-shared")
    out = d.select("doc_id", F.monotonically_increasing_id().alias("rid"), "cut", F.transform("cut", lambda c: name(c)).alias("recipe"), F.sha2("text", 256).alias("text_sha256"))
    numbers = F.lit(None).cast("array<struct<at:int,k:int>>")
    if not shared.isEmpty():
        later = materialize(later_contents(parts, shared), "exact-later")
        at = out.select("*", F.posexplode_outer("cut").alias("at", "chunk")).withColumn("h", F.element_at("recipe", F.col("at") + 1)).join(later, ["h", "chunk"], "left")
        found = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("at", "k"))))
        out = at.groupBy("rid", "doc_id", "recipe", "text_sha256").agg(found.alias("_later"))
        numbers = F.when(F.size("_later") > 0, F.col("_later")).cast("array<struct<at:int,k:int>>")
    return materialize(out.select("doc_id", "rid", F.size("recipe").alias("n_chunks"), "recipe", numbers.alias("later"), "text_sha256"), "exact-recipes")


def exact_groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Of the rows of a group the one with the largest doc_id is kept.
    """
    r = recipes(docs, **options)
    groups = r.groupBy("recipe", "later").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = materialize(groups.select(F.col("recipe").alias("_r"), F.col("later").alias("_l"), "keep", "group_size"), "exact-groups")
    j = r.join(groups, (F.col("recipe") == F.col("_r")) & F.col("later").eqNullSafe(F.col("_l")), "left")
    alone = F.col("group_size").isNull()
    return j.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep.rid"))).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of each group of equal texts.

    A row is found again by doc_id and the digest of its text; of rows that share both, one stays.
    """
    keep = exact_groups(docs, **options).filter("kept").select(F.col("doc_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_sha"))
    rows = docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    d = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("_keep_id")) & (F.col("_sha") == F.col("_keep_sha")), "left_semi")
    return d.dropDuplicates(["doc_id", "_sha"]).drop("_sha")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op11_exact_dedup": op11_exact_dedup}
SQL = {
    "op11_exact_dedup": """WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS n FROM t GROUP BY x)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, sha256(t.x) AS text_sha256 FROM t JOIN g ON t.x = g.x"""
}
