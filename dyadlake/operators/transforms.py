"""Fitted multi-modal transforms as a Spark ML estimator: impute, reduce, scale on the fit rows, apply to all.

Also what they are built from: scatter matrices summed in packed rows, numbers of components by explained
variance, and robust components (outlyingness over random directions, least outlying share).
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import settle
from .metrics import running
from .stats import quantile
from .vectors import as_matrix as _matrix
from .vectors import column_statistics, global_scalars, huber_locations, scatter

METHODS = ("plain", "svd", "robust")


def mapped(df: DataFrame, vec: str, f) -> DataFrame:
    """``df`` with the vectors of ``vec`` (rows of a matrix) replaced by ``f(matrix)``; null stays null."""

    def run(batches):
        for pdf in batches:
            have = pdf["_v"].notna().to_numpy()
            out = np.full(len(pdf), None, object)
            if have.any():
                out[have] = pd.Series(list(f(_matrix(pdf["_v"][have])))).to_numpy()
            yield pdf.drop(columns="_v").assign(**{vec: out})

    rest = [c for c in df.columns if c != vec]
    # other columns go through as one binary-safe struct per row: pandas would turn null longs into floats
    d = df.select(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("_rest") if rest else F.lit("{}").alias("_rest"), F.col(vec).cast("array<double>").alias("_v"))
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != vec)
    out = d.mapInPandas(run, f"_rest string, `{vec}` array<double>")
    return out.select(F.from_json("_rest", schema).alias("_r"), vec).select(*[F.col(f"_r.`{c}`").alias(c) for c in rest], vec) if rest else out.select(vec)


def components_for(values: np.ndarray, target: int | float) -> int:
    """Number of components: ``target`` itself, or the least number that explains that share (0 to 1) of the
    variance. ``values``: variances, falling."""
    if isinstance(target, int):
        return min(target, len(values))
    total = np.cumsum(np.maximum(values, 0))
    if not len(total) or total[-1] == 0:
        return len(values)
    return int(min(np.searchsorted(total / total[-1], target) + 1, len(values)))


def _top(s: np.ndarray, target: int | float) -> np.ndarray:
    """Eigenvectors (columns) of the largest eigenvalues, the entry of largest magnitude of each positive."""
    value, u = np.linalg.eigh(s)
    u = u[:, ::-1][:, : components_for(value[::-1], target)]
    sign = np.sign(u[np.abs(u).argmax(axis=0), range(u.shape[1])])
    return u * np.where(sign == 0, 1, sign)


# ---------------------------------------------------------------- robust components


def shortest_windows(values: DataFrame, keys: list[str], value: str, share: float, width: int = 20_000) -> DataFrame:
    """keys, location, scale: mean and deviation of the ``share`` of values in a row (by size) that vary least.

    The univariate minimum covariance determinant, exact: windows of h sorted values, by prefix sums of value and
    square. Equal values are one row. While both ends of a window move inside runs of equal values its variance
    is concave in the shift, so the best window starts with a run or ends with one, and those alone are looked
    at. The other end's prefix is found in slices of ``width`` ranks; no task holds a group.
    """
    t = values.groupBy(*keys, value).agg(F.count("*").alias("c"))
    n = t.groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col(value)) / F.sum("c")).alias("_m"))
    t = t.join(n, keys).withColumn("v", F.col(value) - F.col("_m"))  # near 0, for the sake of the squares
    t = t.withColumns({"_down": -F.col("v"), "s": F.col("c") * F.col("v"), "q": F.col("c") * F.col("v") * F.col("v")})
    t = settle(running(t, keys, "_down", ["c", "s", "q"]).withColumn("h", F.greatest(F.lit(1), F.floor(F.col("n") * share))), "windows")
    before = F.struct((F.col("cum_c") - F.col("c")).alias("c"), (F.col("cum_s") - F.col("s")).alias("s"), (F.col("cum_q") - F.col("q")).alias("q"), "v")
    start, end = F.col("cum_c") - F.col("c"), F.col("cum_c")
    asked = F.array(F.struct((start + F.col("h")).alias("at"), F.lit(1).alias("sign"), before["s"].alias("s"), before["q"].alias("q")), F.struct((end - F.col("h")).alias("at"), F.lit(-1).alias("sign"), F.col("cum_s").alias("s"), F.col("cum_q").alias("q")))
    none = F.lit(None).cast("struct<c:bigint,s:double,q:double,v:double>")
    groups = t.select(*keys, start.alias("at"), F.lit(1).alias("kind"), before.cast("struct<c:bigint,s:double,q:double,v:double>").alias("run"), F.lit(None).cast("struct<sign:int,s:double,q:double>").alias("ask"), "h", "_m")
    asks = t.select(*keys, "n", "h", "_m", F.explode(asked).alias("a")).filter("a.at >= 0 and a.at <= n")
    asks = asks.select(*keys, F.col("a.at").alias("at"), F.lit(0).alias("kind"), none.alias("run"), F.struct(F.col("a.sign").alias("sign"), F.col("a.s").alias("s"), F.col("a.q").alias("q")).alias("ask"), "h", "_m")
    all_ = groups.unionByName(asks).withColumn("slice", F.floor(F.col("at") / width))
    ends = all_.groupBy(*keys, "slice").agg(F.max_by("run", F.when(F.col("kind") == 1, F.col("at"))).alias("run"))
    carry = ends.select(*keys, "slice", F.last("run", True).over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    inside = Window.partitionBy(*keys, "slice").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    d = all_.withColumn("last", F.last("run", True).over(inside)).filter("kind = 0").join(carry, [*keys, "slice"], "left")
    d = d.withColumn("last", F.coalesce("last", "carry"))  # the last run that starts before the asked rank
    more = F.col("at") - F.col("last.c")
    s = F.coalesce(F.col("last.s") + more * F.col("last.v"), F.lit(0.0))
    q = F.coalesce(F.col("last.q") + more * F.col("last.v") * F.col("last.v"), F.lit(0.0))
    mean = F.col("ask.sign") * (s - F.col("ask.s")) / F.col("h")
    d = d.select(*keys, "_m", mean.alias("mean"), F.greatest(F.col("ask.sign") * (q - F.col("ask.q")) / F.col("h") - mean * mean, F.lit(0.0)).alias("var"))
    best = d.groupBy(*keys).agg(F.min(F.struct("var", "mean", "_m")).alias("b"))
    return best.select(*keys, (F.col("b.mean") + F.col("b._m")).alias("location"), F.sqrt("b.var").alias("scale"))


def outlyingness(df: DataFrame, key: str, vec: str, share: float = 0.75, directions: int = 100, seed: int = 1) -> DataFrame:
    """key, vec, out: the largest standardised distance of a row from the centre, over ``directions``.

    Directions run through pairs of rows (a sample of 2 * ``directions`` rows at most, by hash of the key); centres
    and scales are those of the least varying ``share`` of all rows in each. Directions in which that
    share does not vary tell nothing and are left out.
    """
    d = settle(df.select(key, F.col(vec).cast("array<double>").alias("v")), "rows")
    pick = [np.asarray(r["v"], float) for r in d.select("v", F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("_h")).orderBy("_h").limit(2 * directions).collect()]
    lines = [a - b for a, b in zip(pick[::2], pick[1::2], strict=False)]
    lines = [x / np.linalg.norm(x) for x in lines if np.linalg.norm(x) > 1e-12]
    if not lines:
        return d.select(key, F.col("v").alias(vec), F.lit(0.0).alias("out"))
    lines = np.array(lines).T

    def project(batches):
        for pdf in batches:
            p = _matrix(pdf["v"]) @ lines if len(pdf) else np.zeros((0, lines.shape[1]))
            yield pd.DataFrame({"dir": np.tile(np.arange(lines.shape[1]), len(p)), "x": p.ravel()})

    fit = shortest_windows(d.select("v").mapInPandas(project, "dir int, x double"), ["dir"], "x", share).collect()  # two numbers a direction
    use = [r for r in fit if r["scale"] > 1e-12]
    at, centre, scale = [r["dir"] for r in use], np.array([r["location"] for r in use]), np.array([r["scale"] for r in use])

    def far(v: pd.Series) -> pd.Series:
        if not len(use):
            return pd.Series(np.zeros(len(v)))
        return pd.Series((np.abs(_matrix(v) @ lines[:, at] - centre) / scale).max(axis=1) if len(v) else [])

    return settle(d.select(key, F.col("v").alias(vec), F.pandas_udf(far, "double")("v").alias("out")), "outlyingness")


def robust_components(df: DataFrame, key: str, vec: str, target: int | float, share: float = 0.75, directions: int = 100) -> np.ndarray:
    """Components (columns) of the covariance of the ``share`` of rows that are least outlying.

    Directions without variance are taken out first (effective rank of all rows), and an error tells if no
    more are left than asked for. ``target``: a number, or a share of variance. Rows hold no NaN.
    """
    width = df.select(F.size(vec)).first()[0]
    mean = np.zeros(width)
    for r in df.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect():
        mean[r["i"]] = r["m"]
    n, s = scatter(df, vec, mean)
    value, u = np.linalg.eigh(s)
    keep = u[:, value > value.max() * (max(n, width) * np.finfo(np.float32).eps) ** 2]
    if keep.shape[1] < width and isinstance(target, int) and keep.shape[1] <= target:
        raise ValueError(f"an effective rank of {keep.shape[1]} leaves nothing to reduce to {target} components")
    reduced = mapped(df.select(key, vec), vec, lambda x: (x - mean) @ keep)
    o = outlyingness(reduced, key, vec, share, directions)
    h = max(2, int(n * share))
    limit = quantile(o, "out", min(1.0, (h - 1) / max(1, n - 1)))
    inner = o.filter(F.col("out") <= limit * (1 + 1e-12))
    middle = np.zeros(keep.shape[1])
    for r in inner.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect():
        middle[r["i"]] = r["m"]
    _, s = scatter(inner, vec, middle)
    return keep @ _top(s, target)


# ---------------------------------------------------------------- estimator


class ModalityTransform(Estimator):
    """Fits, per modality (a vector column), on the rows where ``fit_column`` is true:

    - locations that NaN cells are filled with: means (plain), else Huber's;
    - components, where ``dims`` asks for them (a number, or a share of variance): of standardised columns (plain),
      of median-centred rows (svd), or robust ones (robust); rows are projected without centring but for plain;
    - one centre and scale for all cells together: mean and deviation (plain), else median and MAD;

    and, where ``post_dims`` is given, the same components of all modalities side by side, scaled again. A null
    vector is a row of NaN cells. ``key`` identifies rows. No statistic sees a row that is not a fit row.
    """

    def __init__(self, modalities: list[str], key: str, fit_column: str, dims: list | None = None, post_dims=None, method: str = "plain", output: str = "vector"):
        super().__init__()
        if method not in METHODS:
            raise ValueError(f"method is one of {METHODS}")
        if not modalities or dims is not None and len(dims) != len(modalities):
            raise ValueError("dims has one entry per modality")
        self.modalities, self.key, self.fit_column, self.method, self.output = modalities, key, fit_column, method, output
        self.dims, self.post_dims = dims or [None] * len(modalities), post_dims

    def _step(self, rows: DataFrame, vec: str, target) -> dict:
        """Statistics of one vector column over ``rows`` (key, vec)."""
        plain = self.method == "plain"
        stats = {r["dim"]: r for r in column_statistics(rows, self.key, vec).collect()}  # three numbers a dimension
        width = len(stats)
        fill = [stats[i]["mean"] for i in range(width)]
        if not plain:
            found = {r["dim"]: r["location"] for r in huber_locations(rows, self.key, vec).collect()}
            fill = [found.get(i, 0.0) for i in range(width)]
        out = {"fill": fill, "centre": None, "scale": None, "basis": None}
        filled = settle(mapped(rows, vec, lambda x: np.where(np.isnan(x), fill, x)), "filled")
        if target is not None:
            if plain:
                after = {r["dim"]: r for r in column_statistics(filled, self.key, vec).collect()}
                out["centre"], out["scale"] = [after[i]["mean"] for i in range(width)], [after[i]["sd"] for i in range(width)]
                centre, scale = np.array(out["centre"]), np.array(out["scale"])
                basis = _top(scatter(mapped(filled, vec, lambda x: (x - centre) / scale), vec, np.zeros(width))[1], target)
            elif self.method == "svd":
                middle = np.zeros(width)
                for r in filled.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.percentile("x", F.lit(0.5)).alias("m")).collect():
                    middle[r["i"]] = r["m"]
                basis = _top(scatter(filled, vec, middle)[1], target)
            else:
                basis = robust_components(filled, self.key, vec, target)
            out["basis"] = basis.tolist()
            filled = settle(mapped(filled, vec, lambda x: _applied(x, out | {"middle": 0.0, "spread": 1.0})), "reduced")
        out["middle"], out["spread"] = global_scalars(filled, vec, robust=not plain)
        return out

    def _fit(self, dataset: DataFrame) -> ModalityModel:
        rows = dataset.filter(F.col(self.fit_column))
        widths = [dataset.filter(F.col(c).isNotNull()).select(F.size(c)).first() for c in self.modalities]
        if any(w is None for w in widths):
            raise ValueError("a modality without any vector")
        steps = []
        for c, target, w in zip(self.modalities, self.dims, widths, strict=True):
            empty = F.array_repeat(F.lit(float("nan")), w[0])
            steps.append(self._step(rows.select(self.key, F.coalesce(F.col(c).cast("array<double>"), empty).alias(c)), c, target))
        model = ModalityModel(self.modalities, self.output, steps, None)
        if self.post_dims is not None:
            joint = model.transform(rows).select(self.key, self.output)
            model = ModalityModel(self.modalities, self.output, steps, self._step(joint, self.output, self.post_dims))
        return model


def _applied(x: np.ndarray, step: dict) -> np.ndarray:
    x = np.where(np.isnan(x), step["fill"], x)
    if step["centre"] is not None:
        x = (x - np.array(step["centre"])) / np.array(step["scale"])
    if step["basis"] is not None:
        x = x @ np.array(step["basis"])
    return (x - step["middle"]) / step["spread"]


class ModalityModel(Model, MLWritable, MLReadable):
    """Applies fitted steps to any rows: adds ``output``, all modalities side by side. Saved as a Parquet table of
    one row per step, so that a model needs no more than the shared file system."""

    def __init__(self, modalities: list[str], output: str, steps: list[dict], post: dict | None):
        super().__init__()
        self.modalities, self.output, self.steps, self.post = modalities, output, steps, post

    def _transform(self, dataset: DataFrame) -> DataFrame:
        parts = [F.coalesce(F.col(c).cast("array<double>"), F.array_repeat(F.lit(float("nan")), len(s["fill"]))) for c, s in zip(self.modalities, self.steps, strict=True)]
        for c, s in zip(self.modalities, self.steps, strict=True):
            odd = dataset.filter(F.col(c).isNotNull() & (F.size(c) != len(s["fill"]))).limit(1).count()
            if odd:
                raise ValueError(f"{c} holds a vector that is not {len(s['fill'])} wide")
        steps, post = self.steps, self.post
        cuts = np.cumsum([0, *[len(s["fill"]) for s in steps]])

        def apply(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            x = _matrix(v)
            y = np.hstack([_applied(x[:, a:b], s) for a, b, s in zip(cuts[:-1], cuts[1:], steps, strict=True)])
            return pd.Series(list(_applied(y, post) if post else y))

        return dataset.withColumn(self.output, F.pandas_udf(apply, "array<double>")(F.concat(*parts)))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ModalityModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        m = self.model
        rows = [(i, "step", json.dumps(s)) for i, s in enumerate(m.steps)] + [(-1, "head", json.dumps({"modalities": m.modalities, "output": m.output}))] + ([(len(m.steps), "post", json.dumps(m.post))] if m.post else [])
        spark.createDataFrame(rows, "at int, kind string, value string").coalesce(1).write.mode("overwrite" if self.shouldOverwrite else "errorifexists").parquet(path)


class _Reader(MLReader):
    def load(self, path: str) -> ModalityModel:
        rows = SparkSession.active().read.parquet(path).orderBy("at").collect()  # a row per modality
        head = json.loads(next(r["value"] for r in rows if r["kind"] == "head"))
        post = [json.loads(r["value"]) for r in rows if r["kind"] == "post"]
        return ModalityModel(head["modalities"], head["output"], [json.loads(r["value"]) for r in rows if r["kind"] == "step"], post[0] if post else None)
