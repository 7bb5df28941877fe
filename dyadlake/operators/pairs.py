"""Operators on unordered-pair relations: two columns (a, b) with a < b."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pairs import canonical


def canonical_pairs(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct pairs in order, self-pairs and nulls dropped; other columns go."""
    x, y = canonical(a, b)
    return df.filter(F.col(a) != F.col(b)).select(x.alias("a"), y.alias("b")).distinct()


def cooccurring(df: DataFrame, group: str, item: str, *carry: str, most: int = 10_000) -> DataFrame:
    """Pairs of items that share a group, each with ``carry`` of both rows (suffixes 1, 2).

    An equi-join on the group. Its pairs grow with the square of a group, so a table with a
    group of over ``most`` rows is refused.
    """
    largest = df.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a group of {group} has {largest} rows, more than {most}")
    l, r = (df.select(F.col(group), F.col(item).alias(x), *[F.col(c).alias(f"{c}{i}") for c in carry]) for x, i in (("a", 1), ("b", 2)))
    return l.join(r, group).filter("a < b")


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def set_union(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Set union of array columns per key, sorted."""
    return df.groupBy(*keys).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in columns])


def mean_of_duplicates(df: DataFrame, value: str, sign: int = 1, a: str = "a", b: str = "b") -> DataFrame:
    """Mean value per unordered pair, times ``sign``; self-pairs and nulls dropped."""
    x, y = canonical(a, b)
    d = df.filter((F.col(a) != F.col(b)) & F.col(value).isNotNull()).select(x.alias("a"), y.alias("b"), F.col(value).cast("double").alias("v"))
    return d.groupBy("a", "b").agg((sign * F.avg("v")).alias("target"), F.count("*").alias("n"))


def conflicts(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """Pairs asserted both ways, with both context sets and how these agree.

    Inputs: a, b, lines (array), heads (array).
    """
    p, n = (d.select("a", "b", F.col("lines").alias(f"{k}_lines"), F.col("heads").alias(f"{k}_heads")) for d, k in ((pos, "pos"), (neg, "neg")))
    both = p.join(n, ["a", "b"])
    kind = lambda x, y: F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit("unknown")).when(F.arrays_overlap(x, y), F.lit("shared")).otherwise(F.lit("disjoint"))
    return both.withColumns({"line_agreement": kind("pos_lines", "neg_lines"), "head_agreement": kind("pos_heads", "neg_heads")})


def resolve_conflicts(pos: DataFrame, neg: DataFrame, policy: str) -> tuple[DataFrame, DataFrame]:
    """(positives, negatives) under a policy on pairs asserted both ways.

    ``drop``: in neither; ``positive``: positive; ``negative``: negative; ``context``: both
    stay unless their context sets share a line, which drops the negative assertion.
    """
    key = ["a", "b"]
    if policy == "drop":
        return pos.join(neg.select(*key), key, "left_anti"), neg.join(pos.select(*key), key, "left_anti")
    if policy == "positive":
        return pos, neg.join(pos.select(*key), key, "left_anti")
    if policy == "negative":
        return pos.join(neg.select(*key), key, "left_anti"), neg
    if policy == "context":
        shared = conflicts(pos, neg).filter("line_agreement <> 'disjoint'").select(*key)
        return pos, neg.join(shared, key, "left_anti")
    raise ValueError(policy)


def degrees(pairs: DataFrame) -> DataFrame:
    """id, degree over both ends; partial counts before the shuffle."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def degree_scores(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Adds score = log1p(degree a) + log1p(degree b), degrees from ``known``, 0 if absent."""
    d = degrees(known)
    for x in ("a", "b"):
        pairs = pairs.join(d.select(F.col("id").alias(x), F.log1p("degree").alias(f"_{x}")), x, "left")
    return pairs.withColumn("score", F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))).drop("_a", "_b")


def within(pairs: DataFrame, ids: DataFrame, how: str = "both") -> DataFrame:
    """Pairs whose ends are in ``ids`` (column id): both, either or neither."""
    if how == "both":
        for x in ("a", "b"):
            pairs = pairs.join(ids.select(F.col("id").alias(x)).distinct(), x, "left_semi")
        return pairs
    for x in ("a", "b"):
        pairs = pairs.join(ids.select(F.col("id").alias(x), F.lit(1).alias(f"_{x}")).distinct(), x, "left")
    hits = F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))
    return pairs.filter(hits > 0 if how == "either" else hits == 0).drop("_a", "_b")


def same_pairs(left: DataFrame, right: DataFrame, value: str, tolerance: float = 1e-9) -> DataFrame:
    """Counts that must be zero where two tables hold the same pairs and values."""
    l, r = left.select("a", "b", F.col(value).alias("x")), right.select("a", "b", F.col(value).alias("y"))
    d = l.withColumn("_l", F.lit(1)).join(r.withColumn("_r", F.lit(1)), ["a", "b"], "full_outer")
    return d.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"), F.count_if(F.abs(F.col("x") - F.col("y")) > tolerance).alias("different"))


def universe(pairs: DataFrame, ranges: int = 64) -> DataFrame:
    """Distinct ids of both ends with their rank: numeric ids by value first, then by text.

    Ids fall into ranges by approximate quantiles, of the numbers and, for the rest, of the
    bytes that follow the prefix they all share; ranks are ranks in the range plus the counts of
    the ranges before.
    """
    ids = pairs.select(F.explode(F.array(F.col("a").cast("string"), F.col("b").cast("string"))).alias("id")).distinct().withColumn("_v", F.expr("try_cast(id as bigint)"))
    low, high = ids.filter("_v is null").agg(F.min("id"), F.max("id")).first()
    shared = next((i for i, (x, y) in enumerate(zip(low or "", high or "", strict=False)) if x != y), min(len(low or ""), len(high or "")))
    bytes_ = F.rpad(F.substring(F.hex(F.encode(F.substring("id", shared + 1, 7), "UTF-8")), 1, 14), 14, "0")
    ids = ids.withColumn("_t", F.when(F.col("_v").isNull(), F.conv(bytes_, 16, 10).cast("long")))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    numbers, texts = ids.agg(F.percentile_approx("_v", shares), F.percentile_approx("_t", shares)).first()
    place = lambda c, cuts: F.size(F.filter(F.array(*[F.lit(x).cast("bigint") for x in sorted(set(cuts))]), lambda x: x <= F.col(c))) if cuts else F.lit(0)
    ids = ids.withColumn("_p", F.when(F.col("_v").isNotNull(), place("_v", numbers)).otherwise(ranges + place("_t", texts)))
    inside = ids.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_v", "id")) - 1)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = ids.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    return inside.join(counts, "_p").select("id", (F.col("_r") + F.col("_b")).alias("idx"))


def subsample(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs among the ``most`` ids of highest degree (ties by id)."""
    top = degrees(pairs).orderBy(F.desc("degree"), "id").limit(most)
    return within(pairs, top)
