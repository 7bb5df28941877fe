"""Result tables over long metric rows: tiers, contrasts, ranks, effects, provenance."""

from __future__ import annotations

from math import asin, atan, cos, pi, sin, sqrt
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pairs import finite


def student_cdf(t: float, df: int) -> float:
    """P(T <= t) of Student's distribution with a whole number of degrees of freedom."""
    angle = atan(t / sqrt(df))
    c, s = cos(angle), sin(angle)
    if df % 2:
        term, total = c, 0.0
        for k in range(1, df - 1, 2):
            total += term
            term *= c * c * (k + 1) / (k + 2)
        return 0.5 + (angle + s * total) / pi
    term, total = 1.0, 0.0
    for k in range(0, df - 1, 2):
        total += term
        term *= c * c * (k + 1) / (k + 2)
    return 0.5 + s * total / 2


def student_quantile(p: float, df: int) -> float:
    """The value below which a share p lies, by bisection of the angle."""
    low, high = asin(-1.0) + 1e-12, asin(1.0) - 1e-12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_cdf(sin(mid) / cos(mid) * sqrt(df), df) < p else (low, mid)
    return sin(low) / cos(low) * sqrt(df)


def _quantile_by(n: Column, p: float, most: int) -> Column:
    """The t quantile of n - 1 degrees of freedom: from a table up to ``most``, beyond by the expansion about
    the normal quantile, whose error is below 1e-9 from 60 on; null below 1."""
    z, nu = NormalDist().inv_cdf(p), n - 1
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    far = sum((F.lit(t) / F.pow(nu, F.lit(float(k + 1))) for k, t in enumerate(terms)), F.lit(z))
    near = F.get(F.array(*[F.lit(None if k < 1 else float(student_quantile(p, k))) for k in range(most + 1)]), nu.cast("int"))
    return F.when(nu > most, far).otherwise(near)


def t_interval(df: DataFrame, keys: list[str], value: str, level: float = 0.95, most: int = 60) -> DataFrame:
    """keys, n, mean, sd (sample), low, high: t confidence interval of the mean over any number of folds."""
    v = finite(value)
    m = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    half = _quantile_by(F.col("n"), (1 + level) / 2, most) * F.col("sd") / F.sqrt("n")
    return m.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half})


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of a t value, by the finite series for whole degrees of freedom."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    c2, odd = F.pow(F.cos(angle), 2), (df % 2 == 1)
    steps = F.sequence(F.lit(0), F.greatest(F.floor((df - 2) / 2), F.lit(0)).cast("int"))
    start = F.when(odd, F.cos(angle)).otherwise(F.lit(1.0))
    count = F.when(odd, F.floor((df - 1) / 2)).otherwise(F.floor(df / 2)).cast("int")
    first = F.when(odd, F.lit(1)).otherwise(F.lit(0))
    total = F.aggregate(
        steps,
        F.struct(start.alias("term"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct((s["term"] * c2 * (first + 2 * i + 1) / (first + 2 * i + 2)).alias("term"), (s["sum"] + F.when(i < count, s["term"]).otherwise(0.0)).alias("sum")),
    )["sum"]
    inside = F.when(odd, 2 / pi * (angle + F.sin(angle) * total)).otherwise(F.sin(angle) * total)
    return F.when(t.isNotNull() & (df >= 1), F.greatest(F.lit(0.0), 1 - inside))


def fold_t_test(df: DataFrame, keys: list[str], d: str) -> DataFrame:
    """keys, n, mean, t, p, wins of fold differences; p is null without spread."""
    m = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.count_if(F.col(d) > 0).alias("wins"))
    t = F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n"))
    return m.withColumn("t", t).withColumn("p", student_p(F.col("t"), (F.col("n") - 1).cast("double"))).drop("sd")


def contrasts(df: DataFrame, model: str, keys: list[str], fold: str, value: str) -> DataFrame:
    """Every model against every later one on the same rows: mean difference over folds."""
    left, right = (df.select(*keys, fold, F.col(model).alias(m), F.col(value).alias(f"_{m}")) for m in ("first", "second"))
    d = left.join(right, [*keys, fold]).filter("first < second")
    return d.groupBy(*keys, "first", "second").agg(F.avg(F.col("_first") - F.col("_second")).alias("delta"), F.count("*").alias("n"))


def ranked(df: DataFrame, group: list[str], value: str, digits: int = 6) -> DataFrame:
    """Adds rank (1 is best, ties share it) and margin to the best other row of the group."""
    w = Window.partitionBy(*group)
    d = df.withColumn("_r", F.round(finite(value), digits))
    top = F.sort_array(F.collect_list("_r").over(w), asc=False)
    other = F.when(F.rank().over(w.orderBy(F.desc_nulls_last("_r"))) == 1, F.get(top, F.lit(1))).otherwise(F.get(top, F.lit(0)))
    return d.withColumns({"rank": F.when(F.col("_r").isNotNull(), F.rank().over(w.orderBy(F.desc_nulls_last("_r")))), "margin": F.round(F.col("_r") - other, digits)}).drop("_r")


def factorial_effects(df: DataFrame, fold: str, x: str, y: str, value: str, keys: list[str]) -> DataFrame:
    """keys, n and the mean main effects and interaction of two yes/no factors, fold by fold."""
    cell = lambda i, j: F.max(F.when((F.col(x) == bool(i)) & (F.col(y) == bool(j)), F.col(value)))
    p = df.groupBy(*keys, fold).agg(*[cell(i, j).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)])
    c = {k: F.col(k) for k in ("c00", "c01", "c10", "c11")}
    p = p.select(*keys, ((c["c10"] - c["c00"] + c["c11"] - c["c01"]) / 2).alias("ex"), ((c["c01"] - c["c00"] + c["c11"] - c["c10"]) / 2).alias("ey"), (c["c11"] - c["c10"] - c["c01"] + c["c00"]).alias("exy"))
    return p.groupBy(*keys).agg(F.count("exy").alias("n"), F.avg("ex").alias("effect_x"), F.avg("ey").alias("effect_y"), F.avg("exy").alias("interaction"))


def drop_differences(df: DataFrame, keys: list[str], split: str, value: str, reference: str) -> DataFrame:
    """Mean over folds of each split and how far it lies below the reference split's."""
    m = df.groupBy(*keys, split).agg(F.avg(value).alias("mean"))
    ref = m.filter(F.col(split) == reference).select(*keys, F.col("mean").alias("_ref"))
    return m.filter(F.col(split) != reference).join(ref, keys).withColumn("drop", F.col("_ref") - F.col("mean")).drop("_ref")


def winners(picks: DataFrame, category: str, order: str, pick: str) -> DataFrame:
    """category, n_folds and the distinct picks joined by ``/`` in the order first seen."""
    first = picks.groupBy(category, pick).agg(F.min(order).alias("_o"), F.count("*").alias("_n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", pick))), lambda s: s[pick]), "/")
    return first.groupBy(category).agg(F.sum("_n").alias("n_folds"), joined.alias("picks"))


def pick_counts(picks: DataFrame, keys: list[str], pick: str) -> DataFrame:
    """How often each configuration is picked."""
    return picks.groupBy(*keys, pick).agg(F.count("*").alias("n_folds"))


def fingerprint_groups(runs: DataFrame, model: str, stamp: list[str]) -> DataFrame:
    """Runs grouped by the stamp of their inputs: models, and whether there are other stamps."""
    d = runs.select(model, F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in stamp]).alias("stamp")).distinct()
    g = d.groupBy("stamp").agg(F.array_join(F.array_sort(F.collect_list(model)), ",").alias("models"), F.count("*").alias("n"))
    return g.withColumn("alone", F.lit(1) == F.count("*").over(Window.partitionBy()))


def map_differences(df: DataFrame, key: list[str], left: str, right: str, ignore: list[str]) -> DataFrame:
    """One row per field in which two maps differ (null-safe): field, left and right value."""
    every = F.array_except(F.array_distinct(F.concat(F.map_keys(left), F.map_keys(right))), F.array(*[F.lit(x) for x in ignore]) if ignore else F.array().cast("array<string>"))
    d = df.select(*key, F.explode(every).alias("field"), left, right)
    d = d.select(*key, "field", F.try_element_at(left, F.col("field")).alias("expected"), F.try_element_at(right, F.col("field")).alias("found"))
    return d.filter(~F.col("expected").eqNullSafe(F.col("found")))


def partial_runs(df: DataFrame, keys: list[str], value: str, expected: int) -> DataFrame:
    """Runs with fewer finite folds than expected."""
    return df.groupBy(*keys).agg(F.count(finite(value)).alias("n_scored")).filter(F.col("n_scored") < expected).withColumn("n_expected", F.lit(expected))


def best_runs(runs: DataFrame, group: str, metric: str, value: str, path: str) -> DataFrame:
    """The best run per group (ties to the first path); none where runs chose by several metrics."""
    one = runs.groupBy(group).agg(F.count_distinct(metric).alias("_m")).filter("_m = 1").select(group)
    w = Window.partitionBy(group).orderBy(F.desc(value), path)
    return runs.join(one, group).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def subset_table(rows: DataFrame, subsets: dict[str, Column]) -> DataFrame:
    """Long form: every row once for each named subset that holds it."""
    return rows.withColumn("subset", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()]), lambda x: x.isNotNull())))


def in_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Adds place: the position of the value in a stated order, unknown ones after it by name."""
    known = F.create_map(*[y for i, x in enumerate(order) for y in (F.lit(x), F.lit(i))])
    names = df.select(column).distinct().withColumn("_k", F.coalesce(F.try_element_at(known, F.col(column)), F.lit(len(order))))
    names = names.withColumn("place", F.row_number().over(Window.orderBy("_k", column)) - 1)  # one row per model
    return df.join(names.select(column, "place"), column)
