"""Fold summaries, pivots and comparisons over long metric tables (model, fold, metric, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pairs import finite


def summarise(df: DataFrame, keys: list[str], value: str, sample: bool = False) -> DataFrame:
    """mean, sd, se over finite folds, how many were finite and how many there are."""
    v = finite(value)
    sd = F.stddev_samp(v) if sample else F.stddev_pop(v)
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), sd.alias("sd"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("se"), F.count(v).alias("n_finite"), F.count("*").alias("n_folds"))


def pivot_folds(df: DataFrame, keys: list[str], fold: str, value: str, folds: list[int]) -> DataFrame:
    """One column fold_<k> per fold."""
    p = df.groupBy(*keys).pivot(fold, folds).agg(F.first(value))
    return p.select(*keys, *[F.col(str(k)).alias(f"fold_{k}") for k in folds])


def flag_best(df: DataFrame, group: list[str], value: str, digits: int = 3, least: int = 2) -> DataFrame:
    """Adds best: all rows that equal the rounded maximum of a group of at least ``least``."""
    w, r = Window.partitionBy(*group), F.round(finite(value), digits)
    return df.withColumn("best", F.coalesce((F.count(r).over(w) >= least) & (r == F.max(r).over(w)), F.lit(False)))


def paired_deltas(df: DataFrame, model: str, reference: str, fold: str, value: str, keys: list[str]) -> DataFrame:
    """Fold-aligned differences to a reference model: mean, population sd, n."""
    ref = df.filter(F.col(model) == reference).select(*keys, fold, F.col(value).alias("_ref"))
    d = df.filter(F.col(model) != reference).join(ref, [*keys, fold]).withColumn("_d", F.col(value) - F.col("_ref"))
    return d.groupBy(*keys, model).agg(F.avg("_d").alias("delta"), F.stddev_pop("_d").alias("sd"), F.count("_d").alias("n"))


def best_per_fold(df: DataFrame, fold: str, category: str, value: str, order: str) -> DataFrame:
    """The configuration of highest value per fold and category, ties to the first by ``order``."""
    w = Window.partitionBy(fold, category).orderBy(F.desc(value), order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def leave_one_out(df: DataFrame, config: str, fold: str, val: str, test: str) -> DataFrame:
    """Per fold: the configuration with the best mean of the other folds, and its test value."""
    w = Window.partitionBy(config)
    others = F.try_divide(F.sum(val).over(w) - F.col(val), (F.count(val).over(w) - 1).cast("double"))
    d = df.withColumn("others", F.round(others, 12))
    pick = Window.partitionBy(fold).orderBy(F.desc("others"), config)
    return d.withColumn("_rn", F.row_number().over(pick)).filter("_rn = 1").select(fold, config, "others", test)


def weighted_ensemble(df: DataFrame, keys: list[str], weight: str, value: str) -> DataFrame:
    """Weighted and plain mean of model predictions."""
    return df.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("weighted"), F.avg(value).alias("plain"), F.count("*").alias("n_models"))


def missing_cells(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected cells that a table lacks."""
    return expected.join(actual.select(*keys).distinct(), keys, "left_anti")


def describe(df: DataFrame, group: str, value: str) -> DataFrame:
    """Group statistics; rows without a group are a group."""
    v = finite(value)
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count(v).alias("n_finite"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg((v < 0).cast("double")).alias("share_negative"))
