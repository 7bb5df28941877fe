"""Table and file readers with declared schemas, and the matching writers.

Ids are strings unless the table says otherwise; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pairs import canonical, lenient_bool, pair_key, split_multi


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Headerless white-space separated pair file; lines with fewer than two fields drop out."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(f.alias("f")).filter(F.size("f") >= 2).select(F.col("f")[0].alias("a"), F.col("f")[1].alias("b"))


def read_pair_keys(spark: SparkSession, path: str) -> DataFrame:
    """Distinct order-free keys of a pair file; self-pairs drop out."""
    return read_pairs(spark, path).filter("a <> b").select(pair_key("a", "b").alias("key")).distinct()


def read_sidecar(spark: SparkSession, path: str, merge: bool = True) -> DataFrame:
    """Provenance TSV: a, b, sources, lines, refs as arrays; repeated pairs are merged by set union."""
    d = spark.read.csv(path, sep="\t", header=True, schema="entrez1 string, entrez2 string, sources string, cell_lines string, pubmed_ids string", nullValue=None, emptyValue="")
    a, b = canonical("entrez1", "entrez2")
    d = d.filter("entrez1 is not null and entrez2 is not null").select(a.alias("a"), b.alias("b"), *[split_multi(c).alias(n) for c, n in (("sources", "sources"), ("cell_lines", "lines"), ("pubmed_ids", "refs"))])
    if not merge:
        return d
    return d.groupBy("a", "b").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("sources", "lines", "refs")])


def read_ordered_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id per line with its position; a repeated id is an error when read."""
    # whole-file reading keeps the order: id lists are small text files
    d = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("idx", "id")).select("idx", F.trim("id").alias("id"))
    n = d.groupBy("id").agg(F.count("*").alias("_n"))
    return d.join(n, "id").select("idx", F.when(F.col("_n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("repeated id: "), "id"))).alias("id"))


def read_flagged_pairs(spark: SparkSession, path: str, numbers: list[str], flags: list[str]) -> DataFrame:
    """CSV of predictions: string ids, doubles, lenient booleans and the order-free key.

    A missing column is an error.
    """
    head = spark.read.csv(path, header=True).columns
    absent = [c for c in ["gene1_entrez", "gene2_entrez", *numbers, *flags] if c not in head]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    d = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in head))
    return d.withColumns({**{c: F.expr(f"try_cast(`{c}` as double)") for c in numbers}, **{c: lenient_bool(c) for c in flags}, "key": pair_key("gene1_entrez", "gene2_entrez")})


def fold_columns(d: DataFrame, stem: str) -> DataFrame:
    """Wide columns <stem><k> to long rows (fold, value)."""
    import re

    found = sorted((int(m[1]), c) for c in d.columns if (m := re.fullmatch(rf"{stem}(\d+)", c)))
    keep = [c for c in d.columns if c not in {c for _, c in found}]
    return d.select(*keep, F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), F.col(c).alias("value")) for k, c in found])).alias("_f")).select(*keep, "_f.fold", "_f.value")


def _screen(d: DataFrame, a: Column, b: Column, outcome: str) -> DataFrame:
    d = d.select(F.upper(F.trim(a)).alias("a"), F.upper(F.trim(b)).alias("b"), F.expr(f"try_cast(`{outcome}` as double)").alias("outcome"))
    return d.filter("a is not null and b is not null and a <> '' and b <> '' and a <> b and outcome is not null")


def read_screen(spark: SparkSession, path: str, layout: str, outcome: str, controls: tuple[str, ...] = ()) -> DataFrame:
    """Screen measurements a, b, outcome: ``columns`` (TSV FirstGene, SecondGene), ``semicolon``
    (CSV gene_combination A;B, suffix _mis cut) or ``colon`` (GeneCombinationName A:B, controls drop out)."""
    d = spark.read.csv(path, header=True, sep="\t" if path.endswith((".tsv", ".txt")) else ",")
    if layout == "columns":
        return _screen(d, F.col("FirstGene"), F.col("SecondGene"), outcome)
    if layout == "semicolon":
        f = F.split(F.col("gene_combination"), ";")
        return _screen(d.filter(F.size(f) == 2), F.replace(f[0], F.lit("_mis")), F.replace(f[1], F.lit("_mis")), outcome)
    if layout == "colon":
        f = F.split(F.col("GeneCombinationName"), ":")
        out = _screen(d.filter(F.size(f) == 2), f[0], f[1], outcome)
        for c in controls:
            out = out.filter(~F.startswith("a", F.lit(c.upper())) & ~F.startswith("b", F.lit(c.upper())))
        return out
    raise ValueError(layout)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """GAF: symbol and its set of terms; comments and NOT-qualified lines drop out."""
    f = F.split("value", "\t")
    d = spark.read.text(path).filter(~F.startswith("value", F.lit("!"))).select(f.alias("f")).filter(F.size("f") >= 5)
    denied = F.exists(F.split(F.col("f")[3], r"\|"), lambda q: F.trim(F.upper(q)) == "NOT")
    return d.filter(~denied).groupBy(F.col("f")[2].alias("symbol")).agg(F.array_sort(F.collect_set(F.col("f")[4])).alias("terms"))


def read_links(spark: SparkSession, path: str, least: int = 700) -> DataFrame:
    """Weighted protein links (blank separated, header) from ``least`` on, self links dropped."""
    d = spark.read.csv(path, sep=" ", header=True, schema="protein1 string, protein2 string, combined_score int")
    return d.filter((F.col("combined_score") >= least) & (F.col("protein1") != F.col("protein2")))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """FASTA records: accession, gene (GN=), sequence."""
    d = spark.read.text(path, lineSep=">").filter(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.expr("substring(value, instr(value, '\n'))"), r"\s", "")
    return d.select(F.regexp_extract(head, r"^\w+\|([^|]+)\|", 1).alias("accession"), F.regexp_extract(head, r"GN=(\S+)", 1).alias("gene"), body.alias("sequence"))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word2vec text: name and vector; the header line (two fields) drops out."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(f.alias("f")).filter(F.size("f") > 2).select(F.col("f")[0].alias("name"), F.transform(F.slice("f", F.lit(2), F.size("f") - 1), lambda x: x.cast("float")).alias("vec"))


def read_symbol_tiers(spark: SparkSession, path: str) -> list[DataFrame]:
    """HGNC-like TSV to dictionary tiers (name, id, ord): current, previous, alias symbols."""
    d = spark.read.csv(path, sep="\t", header=True, schema="symbol string, prev_symbol string, alias_symbol string, entrez_id string").filter("entrez_id is not null")
    many = lambda c: d.select(F.posexplode(split_multi(c, r"\|")).alias("ord", "name"), F.col("entrez_id").alias("id")).select("name", "id", "ord")
    return [d.select(F.col("symbol").alias("name"), F.col("entrez_id").alias("id"), F.lit(0).alias("ord")), many("prev_symbol"), many("alias_symbol")]


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result records (JSON): model, cv, fold, metric, value in long form; unreadable files drop out."""
    schema = "summary struct<model: string, cv_type: string, folds: array<map<string, double>>>"
    d = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).filter("summary is not null")
    return d.select("summary.model", F.col("summary.cv_type").alias("cv"), F.posexplode("summary.folds").alias("fold", "m")).select("model", "cv", "fold", F.explode("m").alias("metric", "value"))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in a fixed order, null as an empty cell; the committer renames whole files."""
    df.select(*columns).write.mode("overwrite").option("nullValue", "").option("emptyValue", "").csv(path, header=True)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Parquet by fold columns, so that a reader of one fold opens its folder only."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
