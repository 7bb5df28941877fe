"""Average ranks, correlation, resampling and multiple testing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import running


def average_ranks(df: DataFrame, keys: list[str], value: str, rank: str, weight: str | None = None) -> DataFrame:
    """Adds the (weighted) average rank of ``value`` within ``keys``, ascending from 1."""
    w = F.col(weight) if weight else F.lit(1)
    ties = df.groupBy(*keys, value).agg(F.sum(w).cast("double").alias("_g")).withColumn("_neg", -F.col(value).cast("double"))
    ties = running(ties, keys, "_neg", ["_g"])
    return df.join(ties.select(*keys, value, (F.col("cum__g") - F.col("_g") + (F.col("_g") + 1) / 2).alias(rank)), [*keys, value])


def pearson(df: DataFrame, keys: list[str], x: str, y: str, weight: str | None = None) -> DataFrame:
    """keys, n, r: (weighted) correlation from centred sums; null below 3 rows or without spread."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    m = df.groupBy(*keys).agg(F.sum(w).alias("_w"), F.try_divide(F.sum(w * F.col(x)), F.sum(w)).alias("_mx"), F.try_divide(F.sum(w * F.col(y)), F.sum(w)).alias("_my"), F.count_if(w > 0).alias("n"))
    d = df.join(m, keys)
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    s = d.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(w * dx * dy).alias("xy"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy"))
    return s.select(*keys, "n", F.when((F.col("n") >= 3) & (F.col("xx") > 1e-12) & (F.col("yy") > 1e-12), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("r"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, weight: str | None = None) -> DataFrame:
    """keys, n, r of (weighted) average ranks over rows where both values are finite."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    d = df.filter(ok(x) & ok(y))
    d = average_ranks(average_ranks(d, keys, x, "_rx", weight), keys, y, "_ry", weight)
    return pearson(d, keys, "_rx", "_ry", weight)


def percentile_ci(df: DataFrame, keys: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """keys, mean, se (sample), low, high (interpolated), n_finite, share_le0 of replicates."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("se"), F.percentile(v, F.lit(alpha / 2)).alias("low"), F.percentile(v, F.lit(1 - alpha / 2)).alias("high"), F.count(v).alias("n_finite"), F.avg((v <= 0).cast("double")).alias("share_le0"))


def holm(df: DataFrame, family: list[str], p: str, order: list[str]) -> DataFrame:
    """Adds holm: step-down adjusted p within each family; null p stays null and uncounted."""
    w = Window.partitionBy(*family, F.col(p).isNull())
    asc = w.orderBy(p, *order)
    step = F.least(F.lit(1.0), (F.count(p).over(w) - F.row_number().over(asc) + 1) * F.col(p))
    d = df.withColumn("_s", step)
    return d.withColumn("holm", F.when(F.col(p).isNotNull(), F.max("_s").over(asc.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def sign_flip(df: DataFrame, keys: list[str], value: str, order: str, tolerance: float = 1e-12) -> DataFrame:
    """keys, n, mean, p: exact two-sided sign-flip test over all 2^n sign vectors; over 20 folds are refused."""
    d = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("d"), F.count(value).alias("n"), F.avg(value).alias("mean"))
    observed = F.abs(F.aggregate("d", F.lit(0.0), lambda s, x: s + x))
    d = d.withColumn("n", F.when(F.col("n") <= 20, F.col("n")).otherwise(F.raise_error(F.lit("a sign-flip test of more than 20 folds"))))
    d = d.withColumn("obs", observed).withColumn("mask", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, cast(n as int))") - 1)))
    bit = lambda i: F.floor(F.col("mask") / F.pow(F.lit(2.0), i)) % 2
    flipped = F.aggregate(F.transform("d", lambda x, i: F.when(bit(i) == 1, -x).otherwise(x)), F.lit(0.0), lambda s, x: s + x)
    return d.groupBy(*keys).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.avg((F.abs(flipped) >= F.col("obs") - tolerance).cast("double")).alias("p"))


def paired_folds(df: DataFrame, keys: list[str], a: str, b: str, test_share: float = 0.25) -> DataFrame:
    """Difference of two runs over folds: mean, sd, t, variance-corrected t, wins, losses.

    The corrected t widens the variance by test/train size for overlapping training sets.
    """
    d = df.withColumn("_d", F.col(a) - F.col(b))
    m = d.groupBy(*keys).agg(F.count("_d").alias("n"), F.avg("_d").alias("mean"), F.stddev_samp("_d").alias("sd"), F.count_if(F.col("_d") > 0).alias("wins"), F.count_if(F.col("_d") < 0).alias("losses"))
    return m.withColumns({"t": F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n")), "t_corrected": F.try_divide(F.col("mean"), F.col("sd") * F.sqrt(1 / F.col("n") + test_share))})


def ols(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, slope, intercept; a constant x has slope 1 and the difference of means."""
    m = df.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    d = df.join(m, keys)
    s = d.groupBy(*keys).agg(F.sum((F.col(x) - F.col("_mx")) * (F.col(y) - F.col("_my"))).alias("xy"), F.sum((F.col(x) - F.col("_mx")) ** 2).alias("xx"), F.max("_mx").alias("mx"), F.max("_my").alias("my"))
    slope = F.when(F.col("xx") > 1e-12, F.col("xy") / F.col("xx")).otherwise(1.0)
    return s.select(*keys, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def quantile(df: DataFrame, value: str, share: float, small: int = 50_000) -> float | None:
    """Exact interpolated quantile of a column; null values do not count.

    Approximate quantiles narrow the range that holds the two ranks, a pass over the table
    each, until at most ``small`` values remain to be ordered.
    """
    d = df.select(F.col(value).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    n = d.count()
    if not n:
        return None
    at = (n - 1) * share

    def ranked(i: int) -> float:
        left, count = d, n
        while count > small:
            cuts = sorted(set(left.agg(F.percentile_approx("x", F.array(*[F.lit(k / 32) for k in range(33)]), F.lit(10_000))).first()[0]))
            below = left.agg(*[F.count_if(F.col("x") < c).alias(f"l{k}") for k, c in enumerate(cuts)], *[F.count_if(F.col("x") <= c).alias(f"u{k}") for k, c in enumerate(cuts)]).first()
            k = max((k for k in range(len(cuts)) if below[f"l{k}"] <= i), default=-1)
            if k >= 0 and i < below[f"u{k}"]:
                return cuts[k]
            if k >= 0:
                left, i, count = left.filter(F.col("x") > cuts[k]), i - below[f"u{k}"], count - below[f"u{k}"]
            if k + 1 < len(cuts):
                left, count = left.filter(F.col("x") < cuts[k + 1]), below[f"l{k + 1}"] - (below[f"u{k}"] if k >= 0 else 0)
        return sorted(r["x"] for r in left.collect())[i]

    low = ranked(int(at))
    return low if at == int(at) else low + (ranked(int(at) + 1) - low) * (at - int(at))


def replicate_differences(reps: DataFrame, model: str, reference: str, keys: list[str], values: list[str]) -> DataFrame:
    """Per replicate the difference of each model to the reference, which shares the replicate."""
    ref = reps.filter(F.col(model) == reference).select(*keys, "rep", *[F.col(v).alias(f"_{v}") for v in values])
    d = reps.filter(F.col(model) != reference).join(ref, [*keys, "rep"])
    return d.select(*keys, model, "rep", *[(F.col(v) - F.col(f"_{v}")).alias(v) for v in values])
