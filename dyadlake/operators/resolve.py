"""Entity resolution through ranked dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_dictionary(tiers: list[DataFrame]) -> DataFrame:
    """name, id, tier: the best tier's entry of each name.

    ``tiers`` in order of precedence, each (name, id, ord); within a tier the least ord.
    """
    parts = [t.select(F.upper(F.trim("name")).alias("name"), F.col("id").cast("string").alias("id"), "ord", F.lit(i).alias("tier")) for i, t in enumerate(tiers)]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    w = Window.partitionBy("name").orderBy("tier", "ord", "id")
    return d.filter("name is not null and name <> ''").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("name", "id", "tier")


def unique_entries(dictionary: DataFrame) -> DataFrame:
    """Entries of (name, id) whose name has exactly one id."""
    return dictionary.groupBy("name").agg(F.count_distinct("id").alias("_n"), F.min("id").alias("id")).filter("_n = 1").drop("_n")


def first_unique_hit(names: DataFrame, dictionaries: list[DataFrame]) -> DataFrame:
    """Adds id and method: the first dictionary that knows the name by exactly one id."""
    d, hits = names, []
    for i, one in enumerate(dictionaries):
        d = d.join(unique_entries(one).select("name", F.col("id").alias(f"_id{i}")), "name", "left")
        hits.append(f"_id{i}")
    method = F.coalesce(*[F.when(F.col(h).isNotNull(), F.lit(i)) for i, h in enumerate(hits)])
    return d.withColumns({"id": F.coalesce(*hits), "method": method}).drop(*hits)


def resolve_pairs(pairs: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of ids, one row of counts): unmapped ends, self-pairs and duplicates drop out."""
    d = pairs
    for x in ("a", "b"):
        d = d.withColumn("_k", F.upper(F.trim(F.col(x).cast("string")))).join(dictionary.select(F.col("name").alias("_k"), F.col("id").alias(f"_{x}")), "_k", "left").drop("_k")
    known = d.filter("_a is not null and _b is not null")
    out = known.filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    counts = d.agg(F.count("*").alias("rows"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmapped"), F.count_if(F.col("_a") == F.col("_b")).alias("self_pairs"))
    return out.distinct(), counts


def settle_collisions(df: DataFrame, claim: str, order: list) -> DataFrame:
    """One row per claimed id: the first by ``order``; plus how many claimed it."""
    w = Window.partitionBy(claim)
    return df.withColumns({"claims": F.count("*").over(w), "_rn": F.row_number().over(w.orderBy(*order))}).filter("_rn = 1").drop("_rn")


def mostly_numeric(df: DataFrame, c: str) -> DataFrame:
    """One row: whether at least half of the non-empty ids are all digits."""
    x = F.trim(F.col(c).cast("string"))
    return df.filter(x != "").agg((F.avg(x.rlike("^[0-9]+$").cast("double")) >= 0.5).alias("numeric"))
