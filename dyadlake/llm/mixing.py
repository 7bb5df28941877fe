"""Operator 8: mixing sources to target weights (native DataFrame code).

Every source gets a target in words: all words of the corpus shared by weight, stopped at
``CAP`` times the source's own size, the excess reshared. Documents are cut into blocks of
``BLOCK`` words. A source's blocks are permuted by hash and drawn without replacement until
its target is met (whole rounds first), which fixes its exact block quota. A splitting tree
then deals these quotas to output shards: each node halves its shards, and the left half's
counts by source are one multivariate-hypergeometric draw, as if all blocks were shuffled.
Each shard takes the next stretch of every source's permutation and shuffles it locally.

Scale: no window ever spans a source. Ranks come from hash buckets of bounded size plus
prefix sums over the bucket table, so a source with a third of all rows is spread like any
other. Only the table of sources (one row each) is ranked as a whole.

Edge cases: null text has size 0 and is never taken; a null source is a source of its own
and comes last; repeated rows (even of one doc_id) are separate documents; an empty table
gives an empty result. Draws depend on doc_id, block and seed only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, WORD, materialize, table

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 256
PER_BUCKET = 2048
PER_SHARD = 4096


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and ``ord``, which tells rows of one doc_id apart."""
    d = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("_h"))
    return d.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("source").asc_nulls_last(), "size", "_h"))).drop("_h")


def targets(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: src (rank by code point, null last), source_size, target.

    Water filling: in order of cap over weight, a source is full if the level that the
    sources before it leave over exceeds its own cap.
    """
    s = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"all": F.sum("source_size").over(everything).cast("double"), "w_all": F.sum("w").over(everything), "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    s = s.withColumn("full", (F.col("all") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")) > F.col("cap") / F.col("w"))
    cap_full, w_full = (F.sum(F.when(F.col("full"), F.col(c)).otherwise(0.0)).over(everything) for c in ("cap", "w"))
    s = s.withColumns({"cap_full": cap_full, "w_full": w_full})
    level = F.try_divide(F.col("all") - F.col("cap_full"), F.col("w_all") - F.col("w_full"))
    return s.select("source", F.col("src").cast("long").alias("src"), "source_size", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("w")).alias("target"))


def ranked(df: DataFrame, key: Column, total: int, amount: str) -> DataFrame:
    """Adds ``rank`` and ``before`` (sum of ``amount`` before) in hash order within each src.

    Rows fall into buckets by the leading bits of ``key``, about PER_BUCKET rows each; a
    bucket is ordered by itself and the counts of earlier buckets are added.
    """
    bits = max(0, (total // PER_BUCKET).bit_length())
    d = df.withColumn("_k", F.shiftrightunsigned(key, 1))
    d = d.withColumn("_b", F.shiftright("_k", 63 - bits) if bits else F.lit(0).cast("long"))
    sums = d.groupBy("src", "_b").agg(F.count("*").alias("n"), F.sum(amount).alias("s"))
    earlier = Window.partitionBy("src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "_b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("_s0"))
    inside = Window.partitionBy("src", "_b").orderBy("_k", "doc_id", "ord", "block", "copy")
    d = d.withColumns({"_r": F.row_number().over(inside) - 1, "_s": F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(amount)})
    return d.join(sums, ["src", "_b"]).withColumns({"rank": F.col("_r") + F.col("_n0"), "before": F.col("_s") + F.col("_s0")}).drop("_k", "_b", "_r", "_s", "_n0", "_s0")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """Hypergeometric variate by inversion: ``good`` of ``total`` marked, ``draws`` drawn.

    The distribution is summed over the support, or over 9 standard deviations around the
    mode where the support is wider; beyond lies less than a double's rounding.
    """
    t, g, n = (c.cast("double") for c in (total, good, draws))
    mode = F.floor((n + 1) * (g + 1) / (t + 2))
    reach = F.ceil(9 * F.sqrt(F.greatest(F.lit(0.0), F.try_divide(n * g * (t - g) * (t - n), t * t * F.greatest(t - 1, F.lit(1.0)))))) + 2
    low = F.greatest(F.lit(0).cast("long"), (n - (t - g)).cast("long"), (mode - reach).cast("long"))
    high = F.least(draws, good, (mode + reach).cast("long"))
    step = lambda k: F.log((g - k) * (n - k)) - F.log((k + 1) * (t - g - n + k + 1))  # noqa: E731  log p(k+1) - log p(k)

    def walk(a: Column, b: Column) -> Column:
        ks = F.sequence(a, b)
        # log weights relative to the lowest value, their maximum and scaled sum, in one pass
        first = F.struct(F.lit(0.0).alias("lw"), F.lit(0.0).alias("top"), F.lit(1.0).alias("sum"))
        total_ = F.aggregate(
            F.slice(ks, F.lit(1), F.size(ks) - 1),
            first,
            lambda s, k: _bind(s["lw"] + step(k), lambda lw: F.when(lw > s["top"], F.struct(lw.alias("lw"), lw.alias("top"), (s["sum"] * F.exp(s["top"] - lw) + 1).alias("sum"))).otherwise(F.struct(lw.alias("lw"), s["top"].alias("top"), (s["sum"] + F.exp(lw - s["top"])).alias("sum")))),
        )
        return _bind(
            total_,
            lambda z: F.aggregate(
                F.slice(ks, F.lit(1), F.size(ks) - 1),
                F.struct(F.lit(0.0).alias("lw"), F.exp(-z["top"]).alias("cdf"), a.alias("x")),
                lambda s, k: F.when(s["cdf"] >= u * z["sum"], s).otherwise(_bind(s["lw"] + step(k), lambda lw: F.struct(lw.alias("lw"), (s["cdf"] + F.exp(lw - z["top"])).alias("cdf"), (k + 1).alias("x")))),
            )["x"],
        )

    return F.when(low >= high, low).otherwise(_bind(low, lambda a: _bind(high, lambda b: walk(a, b))))


def uniform(*parts) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Deals each source's quota to ``shards`` (a power of two): src, shard, q, at.

    ``quotas``: src, q. One row per tree node holds its counts by source in order; ``at`` is
    where the shard's stretch of the source's permutation begins, handed down the tree.
    """
    first = F.struct("src", "q", F.lit(0).cast("long").alias("at"))
    nodes = quotas.groupBy().agg(F.array_sort(F.collect_list(first)).alias("qs")).select(F.lit(0).cast("long").alias("lo"), "qs")
    width = shards
    while width > 1:
        half = width // 2
        if shards // width == 1024:  # from here on each subtree is split by itself
            nodes = nodes.repartition("lo")
        left = F.aggregate(
            "qs",
            F.struct(
                F.aggregate("qs", F.lit(0).cast("long"), lambda a, x: a + x["q"]).alias("rest"),
                F.floor(F.aggregate("qs", F.lit(0).cast("long"), lambda a, x: a + x["q"]) / 2).cast("long").alias("draws"),
                F.array().cast("array<bigint>").alias("out"),
            ),
            lambda s, x: _bind(
                hypergeometric(s["rest"], x["q"], s["draws"], uniform(F.lit(seed), F.lit(width), F.col("lo"), x["src"])),
                lambda k: F.struct((s["rest"] - x["q"]).alias("rest"), (s["draws"] - k).alias("draws"), F.array_append(s["out"], k).alias("out")),
            ),
        )["out"]
        both = nodes.select("lo", "qs", F.explode(F.array(left)).alias("l"))
        a = F.struct(F.col("lo").alias("lo"), F.zip_with("qs", "l", lambda x, k: F.struct(x["src"].alias("src"), k.alias("q"), x["at"].alias("at"))).alias("qs"))
        b = F.struct((F.col("lo") + half).alias("lo"), F.zip_with("qs", "l", lambda x, k: F.struct(x["src"].alias("src"), (x["q"] - k).alias("q"), (x["at"] + k).alias("at"))).alias("qs"))
        nodes = both.select(F.inline(F.array(a, b)))
        width = half
    return nodes.select(F.col("lo").alias("shard"), F.inline("qs"))


def place(ranked_blocks: DataFrame, stretches: DataFrame, quotas: DataFrame, shards: int) -> DataFrame:
    """Adds the shard whose stretch of the source's permutation holds each block's rank.

    Ranks and stretches meet by slots of a source's average stretch, so a slot is met by few
    stretches and holds few ranks, whatever the size of the source or the number of shards.
    """
    width = quotas.select("src", F.ceil(F.col("q") / shards).alias("w"))
    slots = F.explode(F.sequence(F.floor(F.col("at") / F.col("w")), F.floor((F.col("at") + F.col("q") - 1) / F.col("w")))).alias("slot")
    stretches = stretches.filter("q > 0").join(width, "src").select("src", "shard", "at", (F.col("at") + F.col("q")).alias("end"), slots)
    d = ranked_blocks.join(width, "src").withColumn("slot", F.floor(F.col("rank") / F.col("w")))
    return d.join(stretches, ["src", "slot"]).filter("at <= rank and rank < end").drop("slot", "w", "at", "end")


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 17, weights=WEIGHTS, cap: int = CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix: (documents with size and ord, sources with targets, drawn blocks).

    Drawn blocks: shard, position, doc_id, ord, src, block, copy, words; block numbers count
    ``block`` words each, copy counts the rounds.
    """
    d = materialize(sized(docs), "mix-sized")
    t = materialize(targets(d, weights, cap), "mix-targets")
    times = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size") + 1e-12))).otherwise(F.lit(0)).cast("int")
    plan = t.select(F.col("source").alias("_s"), "src", times.alias("rounds"), F.greatest(F.lit(0.0), F.col("target") - times * F.col("source_size")).alias("rest"))
    blocks = (
        d.filter("size > 0")
        .join(plan, F.col("source").eqNullSafe(F.col("_s")))
        .select("doc_id", "ord", "src", "size", "rounds", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block))).alias("block"))
        .withColumns({"words": F.least(F.lit(block), F.col("size") - F.col("block") * block).cast("long"), "copy": F.lit(0)})
    )
    total = d.agg(F.sum(F.ceil(F.col("size") / block))).first()[0] or 0
    order = ranked(blocks, F.xxhash64(F.lit(seed), "doc_id", "block"), total, "words")
    # the last, partial round takes a block if that brings the source nearer to its target
    n = F.col("rounds") + F.when((F.col("rounds") < cap) & (F.col("before") + F.col("words") / 2 <= F.col("rest")), 1).otherwise(0)
    drawn = order.select("doc_id", "ord", "src", "block", "words", n.alias("_n")).filter("_n > 0").select("doc_id", "ord", "src", "block", "words", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("copy"))
    drawn = materialize(drawn, "mix-drawn")
    quotas = materialize(drawn.groupBy("src").agg(F.count("*").alias("q")), "mix-quotas")
    taken = quotas.agg(F.sum("q")).first()[0] or 0
    shards = 1 << max(0, (taken // PER_SHARD).bit_length())
    stretches = materialize(split_quotas(quotas, shards, seed), "mix-stretches")
    dealt = ranked(drawn, F.xxhash64(F.lit(seed + 1), "doc_id", "block", "copy"), taken, "words")
    dealt = place(dealt, stretches, quotas, shards)
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "block", "copy"), "doc_id", "ord", "block", "copy")
    dealt = dealt.withColumn("position", F.row_number().over(local) - 1)
    return d, t, dealt.select("shard", "position", "doc_id", "ord", "src", "block", "copy", "words")


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The mix as documents: one row per document and round, its text the blocks drawn.

    A round that draws a whole document keeps its text as it is; else the drawn blocks are
    joined in order. Documents of which nothing is drawn go.
    """
    _, _, dealt = mix(docs, block, seed)
    rows = dealt.groupBy("doc_id", "ord", "copy").agg(F.sort_array(F.collect_list("block")).alias("_blocks"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(*DOC_COLUMNS).withColumns({"_size": size, "_h": F.xxhash64("text")})
    d = d.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("source").asc_nulls_last(), "_size", "_h")))
    d = d.withColumnRenamed("doc_id", "_id").withColumnRenamed("ord", "_ord")
    out = rows.join(d, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("ord") == F.col("_ord")))
    part = F.size("_blocks") < F.ceil(F.col("_size") / block)
    pieces = F.explode(F.array(F.when(part, F.regexp_extract_all("text", F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1)))))
    out = out.select("doc_id", "text", "lang", "source", "_blocks", pieces.alias("_words"))
    cut = F.array_join(F.flatten(F.transform("_blocks", lambda b: F.slice("_words", (b * block + 1).cast("int"), F.lit(block)))), "")
    text = F.coalesce(cut, F.col("text"))
    return out.select("doc_id", text.alias("text"), "lang", "source").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t, dealt = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = dealt.groupBy("doc_id", "ord").agg(F.sum("words").alias("taken"), F.count("*").alias("n_blocks"), F.min(F.struct("shard", "position")).alias("first"))
    d = d.join(t.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    taken = taken.withColumnRenamed("doc_id", "_id").withColumnRenamed("ord", "_ord")
    return d.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("ord") == F.col("_ord")), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.col("first.shard").cast("long").alias("first_shard"), F.col("first.position").cast("long").alias("first_position")
    )


QUERIES = {"op8_source_mixing": op8_source_mixing}
SQL: dict[str, str] = {}
