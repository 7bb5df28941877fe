"""Operator 13: embedding whitening with components found by FEAST contour integration.

1. Vectors become whole numbers x = floor(1024 c) + 100000. Their count, sums and centred products are
   sums of whole numbers, so the covariance V is the same however the rows are dealt, and large common
   offsets cost no digits: rows are centred by the rounded mean before they are multiplied, and the
   remainder (at most 1/2) is taken off exactly.
2. The spectrum is cut into intervals of at most ``MOST`` eigenvalues each, from the top down. How many
   eigenvalues lie above a cut is the inertia of V - cut * I: the signs of the pivots of its
   factorisation (Sylvester). A cut close to an eigenvalue shows as a small pivot and is moved.
3. Each interval and each node z of a quadrature rule on the half circle over the interval is a Spark task that
   solves (z I - V) Q = Y. Sums over the nodes project Y onto the interval's eigenvectors; the Rayleigh-Ritz
   step, a task per interval, extracts vectors and values and gives the next Y, until the residuals of all
   values inside the interval are at rounding.
4. Inertia counts verify each interval: as many values as the counts at its ends say, or it is an error. Vectors
   of neighbouring intervals are made orthogonal to each other by one last Rayleigh-Ritz step.
5. Rows are projected, divided by the root of the eigenvalue, and the covariance of the result is measured.

Scale: tasks hold one Arrow batch and d x d numbers (d: the width of the vectors, at most ``WIDEST``); what
meets in a shuffle is d rows of d numbers per task, and what comes to the driver is d rows. Solves of
different intervals and nodes share nothing and can fail and be repeated by themselves.

Edge cases: rows whose vector is null, or holds null or non-finite entries, are dropped, and so are empty vectors
and those of another width than the widest. An entry beyond 2**42 is an error. Repeated rows and null ids stay.
Components whose eigenvalue is not above rounding (constant directions; a single row) are left out, since
they can't be scaled to 1. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Fixed by the contract: the grid of the entries and their offset.
SCALE, OFFSET = 1024, 100000
#: Components that are given.
COMPONENTS = 8
#: Eigenvalues of an interval, quadrature nodes on its half circle, rounds at most.
MOST, NODES, ROUNDS = 4, 8, 20
WIDEST = 4096
#: Products are summed as hi * 2**_LOW + lo.
_LOW = 40


# ---------------------------------------------------------------- exact moments


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, x (array<long>): the rows whose vector is usable."""
    v = F.col(vector)
    ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    d = rows.select("vec_id", v.cast("array<double>").alias("v")).filter(v.isNotNull() & (F.size("v") > 0) & ok)
    x = F.transform("v", lambda c: F.when(F.abs(c) > 2.0**42, F.raise_error(F.lit("an entry of a vector is beyond 2**42"))).otherwise(F.floor(c * SCALE) + OFFSET))
    d = d.select("vec_id", x.cast("array<long>").alias("x"))
    width = d.agg(F.max(F.size("x"))).first()[0] or 0
    if width > WIDEST:
        raise ValueError(f"vectors of {width} entries; {WIDEST} at most")
    return d.filter(F.size("x") == width)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy().reshape(len(x), -1)


def _halves(total: np.ndarray) -> tuple[list, list]:
    """Whole numbers of any size as hi * 2**_LOW + lo, both int64."""
    flat = [int(t) for t in total.ravel()]
    return [t >> _LOW for t in flat], [t & ((1 << _LOW) - 1) for t in flat]


def _summed(parts: DataFrame) -> list[list[int]]:
    """Sums by row number ``i`` of arrays given as halves; one list per i, in order. Bounded by WIDEST rows."""
    cells = parts.select("i", F.posexplode(F.arrays_zip("hi", "lo")).alias("j", "c")).groupBy("i", "j").agg(F.sum("c.hi").alias("hi"), F.sum("c.lo").alias("lo"))
    rows = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "hi", "lo"))).alias("row")).collect()
    return [[(c["hi"] << _LOW) + c["lo"] for c in r["row"]] for r in sorted(rows, key=lambda r: r["i"])]


_HALVES = "i int, hi array<long>, lo array<long>"


def _half_batch(i: list[int], totals: list[np.ndarray]) -> pa.RecordBatch:
    halves = [_halves(t) for t in totals]
    columns = [pa.array(i, pa.int32()), pa.array([h for h, _ in halves], pa.list_(pa.int64())), pa.array([l for _, l in halves], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["i", "hi", "lo"])


def count_and_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the sum of each dimension."""

    def run(batches):
        total = None
        for batch in batches:
            if len(batch):
                x = _matrix(batch)
                s = np.concatenate([x.sum(axis=0), [len(x)]]).astype(object)  # 2**53 times a batch's rows fits
                total = s if total is None else total + s
        if total is not None:
            yield _half_batch([0], [total])

    sums = _summed(rows.select("x").mapInArrow(run, _HALVES))
    return (sums[0][-1], sums[0][:-1]) if sums else (0, [])


def products(y: np.ndarray) -> np.ndarray:
    """y' y of whole numbers, exact."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64)
    y = y.astype(object)
    return y.T @ y


def covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of x with divisor n: exact sums of centred products, then one division."""
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def run(batches):
        total, bound = None, 0
        for batch in batches:
            for at in range(0, len(batch), 1024):
                y = _matrix(batch.slice(at, 1024)) - centre
                p = products(y)
                bound += int(np.abs(y).max(initial=0)) ** 2 * len(y)
                if total is None:
                    total = p
                else:
                    total = (total + p) if bound < 1 << 62 else total.astype(object) + p
        if total is not None:
            yield _half_batch(list(range(len(total))), list(total))

    p = _summed(rows.select("x").mapInArrow(run, _HALVES))
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    return np.array([[(n * p[i][j] - rest[i] * rest[j]) / (n * n) for j in range(len(rest))] for i in range(len(rest))])


# ---------------------------------------------------------------- inertia


def inertia(a: np.ndarray) -> tuple[int, float]:
    """Positive eigenvalues of symmetric ``a``, and its smallest pivot.

    Symmetric elimination; a pivot is the largest entry of the diagonal, or a 2 x 2 block about the
    largest entry where that is much larger (Bunch and Parlett).
    """
    a, positive, smallest = np.array(a, float), 0, float("inf")
    while len(a):
        diagonal = np.abs(np.diag(a))
        k, flat = int(diagonal.argmax()), int(np.abs(a).argmax())
        i, j = divmod(flat, len(a))
        at = [k] if diagonal[k] >= 0.64 * abs(a[i, j]) else [i, j]
        block = a[np.ix_(at, at)]
        values = np.array([block[0, 0]]) if len(at) == 1 else np.array([(t := block.trace() / 2) + (r := np.hypot((block[0, 0] - block[1, 1]) / 2, block[0, 1])), t - r])
        positive += int((values > 0).sum())
        smallest = min(smallest, float(np.abs(values).min()))
        if smallest == 0:
            return positive, 0.0
        rest = np.setdiff1d(np.arange(len(a)), at)
        side = a[np.ix_(rest, at)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return positive, smallest


def above(v: np.ndarray, cut: float, width: float) -> tuple[int, float]:
    """Eigenvalues of ``v`` above ``cut``, and the cut, moved by some of ``width`` where it is close to one."""
    scale = np.abs(v).max()
    for k in range(40):
        at = cut + width * 0.37 * ((k + 1) // 2) / 40 * (-1) ** k
        n, pivot = inertia(v - at * np.eye(len(v)))
        if pivot > 1e-10 * scale:
            break
    return n, at


def intervals(v: np.ndarray, k: int, most: int = MOST) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside): disjoint, from the top, until they hold ``k`` eigenvalues.

    Halved until an interval holds at most ``most``, or is so narrow that its values are one.
    """
    radius = np.abs(v).sum(axis=1) - np.abs(np.diag(v))
    high, low = float((np.diag(v) + radius).max()), float((np.diag(v) - radius).min())
    scale = max(abs(high), abs(low))
    high, low = high + 1e-3 * scale, min(low, 0.0) - 1e-3 * scale
    out, stack, found = [], [(low, high, len(v), 0)], 0
    while stack and found < k:
        low, high, below_top, over = stack.pop()  # eigenvalues above low; above high
        inside = below_top - over
        if not inside:
            continue
        if inside <= most or high - low < 1e-9 * scale:
            out.append((low, high, inside))
            found += inside
            continue
        n, cut = above(v, (low + high) / 2, (high - low) / 2)
        stack += [(low, cut, below_top, n), (cut, high, n, over)]
    return out


# ---------------------------------------------------------------- FEAST


def _dumped(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, float).tobytes()


def project(v: np.ndarray, low: float, high: float, node: int, y: np.ndarray) -> np.ndarray:
    """One node's share of the spectral projector of (low, high) on ``y``: Gauss-Legendre on the
    upper half circle; the lower half is its mirror image."""
    t, weight = np.polynomial.legendre.leggauss(NODES)
    angle, r = np.pi / 2 * (1 - t[node]), (high - low) / 2
    step = r * np.exp(1j * angle)
    q = np.linalg.solve(((low + high) / 2 + step) * np.eye(len(v)) - v, y.astype(complex))
    return weight[node] / 2 * (step * q).real


def ritz(v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (falling), vectors and residual norms of ``v`` on the span of ``q``."""
    u, s, _ = np.linalg.svd(q, full_matrices=False)
    u = u[:, s > 1e-13 * s[0]] if s.size and s[0] > 0 else u[:, :0]
    u, _ = np.linalg.qr(u)
    value, w = np.linalg.eigh(u.T @ v @ u)
    value, x = value[::-1], (u @ w)[:, ::-1]
    return value, x, np.linalg.norm(v @ x - x * value, axis=0)


def components(spark: SparkSession, v: np.ndarray, k: int = COMPONENTS, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of ``v``, falling, and their unit vectors (columns).

    A round is one Spark job: a task per interval and node solves, a task per interval extracts.
    """
    d, scale = len(v), float(np.abs(v).sum(axis=1).max(initial=0.0))
    k, flat = min(k, d), _dumped(v)
    if scale == 0 or not k:
        return np.zeros(0), np.zeros((d, 0))
    parts = intervals(v, k, most)
    start = np.random.RandomState(1).choice([-1.0, 1.0], (d, d))  # Y's columns, the same in each run
    work = [(i, lo, hi, n, min(d, 2 * n + 4)) for i, (lo, hi, n) in enumerate(parts)]
    sent = {i: start[:, :m] for i, _, _, _, m in work}
    done: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def solve(batches):
        a = np.frombuffer(flat).reshape(d, d)
        for pdf in batches:
            q = [_dumped(project(a, r.low, r.high, r.node, np.frombuffer(r.y).reshape(d, -1))) for r in pdf.itertuples()]
            yield pd.DataFrame({"i": pdf["i"], "low": pdf["low"], "high": pdf["high"], "q": q})

    def extract(group: pd.DataFrame) -> pd.DataFrame:
        a = np.frombuffer(flat).reshape(d, d)
        q = sum(np.frombuffer(b).reshape(d, -1) for b in group["q"])
        value, x, rest = ritz(a, q)
        inside = (value > group["low"].iloc[0]) & (value < group["high"].iloc[0])
        return pd.DataFrame({"i": [group["i"].iloc[0]], "value": [_dumped(value[inside])], "x": [_dumped(x)], "inside": [inside.tolist()], "worst": [float(rest[inside].max(initial=0.0))]})

    worst = {}
    for _ in range(ROUNDS):
        todo = [w for w in work if w[0] not in done]
        if not todo:
            break
        rows = [(i, lo, hi, node, bytearray(_dumped(sent[i]))) for i, lo, hi, _, _ in todo for node in range(NODES)]
        jobs = spark.createDataFrame(rows, "i int, low double, high double, node int, y binary").repartition(len(rows))
        got = jobs.mapInPandas(solve, "i int, low double, high double, q binary").groupBy("i").applyInPandas(extract, "i int, value binary, x binary, inside array<boolean>, worst double").collect()
        for r in got:
            x, value = np.frombuffer(r["x"]).reshape(d, -1), np.frombuffer(r["value"])
            sent[r["i"]], worst[r["i"]] = x, r["worst"]
            expected = parts[r["i"]][2]
            if len(value) == expected and r["worst"] <= 1e-13 * scale * d**0.5:
                done[r["i"]] = value, x[:, np.array(r["inside"], bool)]
    missing = [(parts[i][2], worst.get(i)) for i, *_ in work if i not in done]
    if missing:
        raise ArithmeticError(f"intervals whose eigenvalues did not all settle (expected, residual): {missing}")
    _, first, _ = ritz(v, np.hstack([done[i][1] for i, *_ in work]))
    value, x, _ = ritz(v, first)
    return value[:k], x[:, :k]


# ---------------------------------------------------------------- whitening


def whitened(rows: DataFrame, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """vec_id, deviation (decimal, exact), w (array<double>): a row for each row of ``rows``."""
    kind, k = dict(rows.dtypes)["vec_id"], len(values)
    total, turn = np.array(sums, object), vectors / np.sqrt(values)
    whole, rest = (total // n).astype(np.int64) if n else np.zeros(0, np.int64), np.array([s % n / n for s in sums], float)

    def run(batches):
        small = np.array([s % n for s in sums], object)
        for batch in batches:
            y = _matrix(batch) - whole
            most = max(int(np.abs(y).max(initial=0)) + 1, 1)
            z = n * y - small.astype(np.int64) if most * n < 1 << 62 else n * y.astype(object) - small
            exact = (z * z).sum(axis=1) if (most * n) ** 2 * y.shape[1] < 1 << 62 else (z.astype(object) ** 2).sum(axis=1)
            w = (y - rest) @ turn
            w = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), k).cast(pa.list_(pa.float64())) if k else pa.array([[]] * len(batch), pa.list_(pa.float64()))
            deviation = pa.array([Decimal(int(t)) for t in exact], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, w], names=["vec_id", "deviation", "w"])

    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), w array<double>")


def identity_error(w: DataFrame, k: int) -> float | None:
    """Largest absolute entry of the covariance of ``w`` less the identity; null without rows."""
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    if not cells:
        return None
    at = lambda i: F.element_at("w", i + 1)
    row = w.agg(*[F.covar_pop(at(i), at(j)).alias(f"c{i}_{j}") for i, j in cells]).first()
    return None if row[0] is None else max(abs(c - (i == j)) for c, (i, j) in zip(row, cells, strict=True))


def whiten(rows: DataFrame, vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    x = whole_vectors(rows, vector)
    n, sums = count_and_sums(x)
    v = covariance(x, n, sums) if n else np.zeros((0, 0))
    values, vectors = components(spark, v, k)
    trace = float(np.trace(v))
    real = values > 1e-12 * trace
    values, vectors = values[real], vectors[:, real]
    w = materialize(whitened(x, n, sums, values, vectors), "whitened")
    error = identity_error(w, len(values))
    shares = F.array(*[F.lit(float(e / trace)) for e in values]).cast("array<double>")
    d = w.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return d.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
SQL = {}
