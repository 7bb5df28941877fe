"""Dense vectors per entity: arrays in a column, statistics per dimension in long form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_form(df: DataFrame, key: str, vec: str) -> DataFrame:
    """key, dim, x (double; NaN cells are null)."""
    d = df.select(key, F.posexplode(vec).alias("dim", "x"))
    return d.withColumn("x", F.when(~F.isnan("x"), F.col("x").cast("double")))


def sum_pool(df: DataFrame, group: str, vec: str, digits: int = 6) -> DataFrame:
    """group, vec: element-wise sums; summed per (group, dim), so a hot group is spread."""
    d = df.select(group, F.posexplode(vec).alias("dim", "x")).groupBy(group, "dim").agg(F.round(F.sum(F.col("x").cast("double")), digits).alias("s"))
    return d.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda v: v["s"]).alias("vec"))


def column_statistics(df: DataFrame, key: str, vec: str) -> DataFrame:
    """dim, mean, sd (sample; 1 where zero or undefined), n of finite cells."""
    s = long_form(df, key, vec).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count("x").alias("n"))
    return s.select("dim", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("sd"), "n")


def fitted(stats: DataFrame) -> DataFrame:
    """One row of arrays (means, sds) in dimension order; as wide as a vector."""
    s = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "sd"))).alias("s"))
    return s.select(F.transform("s", lambda x: x["mean"]).alias("means"), F.transform("s", lambda x: x["sd"]).alias("sds"))


def standardise(df: DataFrame, fit: DataFrame, vec: str) -> DataFrame:
    """Replaces NaN cells by the fitted mean and z-scores every dimension."""
    d = df.crossJoin(F.broadcast(fit))  # one row of the width of a vector
    filled = F.zip_with(vec, "means", lambda x, m: F.nanvl(F.coalesce(x.cast("double"), m), m))
    centred = F.zip_with(filled, "means", lambda x, m: x - m)
    return d.withColumn(vec, F.zip_with(centred, "sds", lambda x, s: x / s)).drop("means", "sds")


def global_scalars(df: DataFrame, vec: str, robust: bool = False) -> tuple[float, float]:
    """(centre, scale) of all cells together: mean and sample sd, or median and 1.4826 times the
    median absolute deviation; a scale of 0 falls back to the sd, then to 1."""
    from .stats import quantile

    x = df.select(F.explode(vec).alias("x")).select(F.col("x").cast("double").alias("x")).filter("not isnan(x)")
    mean, sd = x.agg(F.avg("x"), F.stddev_samp("x")).first()
    if not robust:
        return mean or 0.0, sd or 1.0
    middle = quantile(x, "x", 0.5) or 0.0
    spread = 1.4826 * (quantile(x.select(F.abs(F.col("x") - middle).alias("x")), "x", 0.5) or 0.0)
    return middle, spread or sd or 1.0


def normalise(df: DataFrame, vec: str, centre: float, scale: float) -> DataFrame:
    """(x - centre) / scale in every cell; NaN stays."""
    return df.withColumn(vec, F.transform(vec, lambda x: (x.cast("double") - centre) / scale))


def align(ids: DataFrame, vectors: DataFrame, key: str, vec: str, width: int) -> DataFrame:
    """Every id with its vector; NaN in each cell and missing = true where there is none."""
    d = ids.select(key).distinct().join(vectors.select(key, vec), key, "left")
    return d.select(key, F.coalesce(vec, F.array_repeat(F.lit(float("nan")), width).cast("array<float>")).alias(vec), F.col(vec).isNull().alias("missing"))


def concatenate(left: DataFrame, right: DataFrame, key: str, vec: str) -> DataFrame:
    """Vectors of two sources side by side; both must hold the same ids."""
    return left.select(key, F.col(vec).alias("_l")).join(right.select(key, F.col(vec).alias("_r")), key).select(key, F.concat("_l", "_r").alias(vec))


def huber_locations(df: DataFrame, key: str, vec: str, c: float = 1.345, rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """dim, location: robust centre of every dimension, iterated over whole-table sums.

    Scale is 1.4826 times the median absolute deviation; each round is one grouped sum, so
    no dimension's values meet in one task.
    """
    x = long_form(df, key, vec).filter("x is not null").persist()  # every round reads it
    state = x.groupBy("dim").agg(F.percentile("x", F.lit(0.5)).alias("location"))
    spread = x.join(F.broadcast(state), "dim").groupBy("dim").agg((1.4826 * F.percentile(F.abs(F.col("x") - F.col("location")), F.lit(0.5))).alias("scale"))
    rows = {r["dim"]: [r["location"], r["scale"]] for r in state.join(spread, "dim").collect()}  # two numbers per dimension
    spark = df.sparkSession
    for _ in range(rounds):
        now = F.broadcast(spark.createDataFrame([(d, float(m), float(s)) for d, (m, s) in rows.items()], "dim int, m double, s double"))
        r = F.abs(F.col("x") - F.col("m")) / F.col("s")
        w = F.when((F.col("s") <= 0) | (r <= c), 1.0).otherwise(c / r)
        new = {q["dim"]: q["m"] for q in x.join(now, "dim").groupBy("dim").agg((F.sum(w * F.col("x")) / F.sum(w)).alias("m")).collect()}
        moved = max((abs(new[d] - rows[d][0]) / max(rows[d][1], 1e-12) for d in new if rows[d][1] > 0), default=0.0)
        for d, m in new.items():
            if rows[d][1] > 0:
                rows[d][0] = m
        if moved < tolerance:
            break
    x.unpersist()
    return spark.createDataFrame([(int(d), float(m)) for d, (m, _) in sorted(rows.items())], "dim int, location double")


def as_matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column])


def scatter(df: DataFrame, vec: str, centre: np.ndarray) -> tuple[int, np.ndarray]:
    """Rows, and the sum of (x - centre)(x - centre)' over them: one packed row per dimension comes back."""
    d = len(centre)

    def run(batches):
        total, n = np.zeros((d, d)), 0
        for pdf in batches:
            if len(pdf):
                x = as_matrix(pdf["v"]) - centre
                total, n = total + x.T @ x, n + len(x)
        if n:
            yield pd.DataFrame({"i": range(d), "row": list(total), "n": [n] * d})

    parts = df.select(F.col(vec).alias("v")).mapInPandas(run, "i int, row array<double>, n long")
    cells = parts.select("i", "n", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    rows = cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda c: c["x"]).alias("row"), F.max("n").alias("n")).collect()
    out = np.zeros((d, d))
    for r in rows:
        out[r["i"]] = r["row"]
    return (rows[0]["n"] if rows else 0), (out + out.T) / 2


def principal_components(df: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """key, vec: the first k principal components of standardised vectors, signs fixed.

    The (width x width) covariance is summed from partial products in packed rows; its size
    depends on the width alone. The largest entry of each component is positive.
    """
    z = standardise(df, fitted(column_statistics(df, key, vec)), vec)

    width = z.select(F.max(F.size(vec))).first()[0] or 0
    n, total = scatter(z, vec, np.zeros(width))
    _, vectors = np.linalg.eigh(total / max(1, n))
    basis = vectors[:, ::-1][:, :k]
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])
    return z.select(key, F.array(*[F.aggregate(F.zip_with(vec, F.array(*[F.lit(float(b)) for b in basis[:, j]]), lambda x, b: x * b), F.lit(0.0), lambda s, v: s + v) for j in range(basis.shape[1])]).alias(vec))
