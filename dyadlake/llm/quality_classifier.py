"""Operator 4: ordinal quality classifier (cumulative-link regression on hashed text).

Graded ratings 0 (poor), 1 (sound but toxic), 2 (good) come from ``labels``. One weight
vector over hashed words and a few shape features gives a score s; ordered thresholds
t1 < t2 turn it into P(grade >= k) = logistic(s - tk). From these follow the expected grade
and the tail probability P(grade >= 2) by which documents are kept.

The fit uses at most ``MAX_TRAIN`` labelled documents (the first by hash of doc_id; a
documented bound), whose sparse features come to the driver; every document is scored in
Arrow batches with the weights as a closure of fixed size.

Edge cases: null or empty text has shape features only; a doc_id rated more than once takes
its lowest grade, one with several rated rows is learnt from its first text in order; without any rating every document is kept with grade 2; null ratings do
not count; repeated rows get equal results; extra columns pass through unread.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, PUNCTUATED, ending, table, text_buffers, word_hashes

MAX_TRAIN = 20_000
BITS = 20
#: A word bucket that tells some grades apart by this many standard errors has a full weight;
#: weaker evidence scales the weight by its share of this, to the power ``POWER``, never to a cut.
FULL_Z = 6.0
POWER = 4
#: Features that a pass over the rated documents handles at a time.
RUN = 1 << 20
GRADES = 3
THRESHOLD = 0.5
SHAPE = 10


def _slices(batches, rows: int = 500):
    """Batches in pieces, so that a worker holds the features of few texts at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word buckets of each text (flat, offsets) and a (n, SHAPE) dense matrix."""
    data, offsets = text_buffers(column)
    words, at = word_hashes(data, offsets, separators=PUNCTUATED)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    key = np.unique((doc.astype(np.uint64) << np.uint64(BITS)) | (words >> np.uint64(64 - BITS)))
    owner = (key >> np.uint64(BITS)).astype(np.int64)
    buckets = (key & np.uint64((1 << BITS) - 1)).astype(np.int32)
    distinct = np.bincount(owner, minlength=n)
    n_words, n_bytes = np.maximum(np.diff(at), 1), np.maximum(np.diff(offsets), 1)

    def share(members, per):
        hits = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(members, np.uint8)), dtype=np.int32)])
        return (hits[offsets[1:]] - hits[offsets[:-1]]) / per

    dense = np.stack(
        [
            np.ones(n),
            np.log1p(np.diff(at)) / 5,
            np.minimum(share(b"#*$%&|<>", n_words), 3),
            np.minimum(share(b"!", n_words), 3),
            np.minimum(share(b"|", n_words), 3),
            4 * share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", n_bytes),
            4 * share(b"0123456789", n_bytes),
            np.minimum(share(b".", n_words) * 4, 3),
            1 - distinct / n_words,
            np.minimum(n_bytes / n_words / 8, 3),
        ],
        axis=1,
    )
    return buckets, np.concatenate([[0], np.cumsum(distinct)]), dense


class Model:
    """Weights, dense weights and thresholds; small enough to travel with the closure."""

    def __init__(self, weights=None, dense=None, cuts=None):
        self.weights = np.zeros(1 << BITS, np.float32) if weights is None else weights
        self.dense = np.zeros(SHAPE) if dense is None else dense
        self.cuts = np.array([-60.0, -50.0]) if cuts is None else cuts

    def scores(self, buckets, offsets, dense) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[buckets].astype(np.float64))])
        return sums[offsets[1:]] - sums[offsets[:-1]] + dense @ self.dense

    def tails(self, s: np.ndarray) -> np.ndarray:
        """(n, GRADES - 1): P(grade >= k)."""
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.cuts, -60, 60)))


def fit(buckets, offsets, dense, grades, rounds: int = 120, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Full-batch Adam on the cumulative-link likelihood; thresholds stay ordered.

    Every bucket of the rated documents takes part. Its weight is scaled by the evidence for
    it, so that the ridge penalty shrinks weights of weak evidence more, as of rare words.
    """
    n = len(grades)
    if not n:
        return Model()
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    own = np.flatnonzero(np.bincount(buckets, minlength=1 << BITS))
    place = np.zeros(1 << BITS, np.int32)
    place[own] = np.arange(len(own), dtype=np.int32)
    column = place[buckets]
    ease = _ease(buckets, owner, grades)[own]
    runs = [slice(i, i + RUN) for i in range(0, len(column), RUN)]
    theta = [np.zeros(len(own)), np.zeros(SHAPE), np.array([-1.0, 0.0])]  # cuts: first, log of the gap
    first, second = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for step in range(1, rounds + 1):
        w, d, c = theta
        cuts = np.array([c[0], c[0] + np.exp(c[1])])
        s = dense @ d
        for r in runs:
            s += np.bincount(owner[r], (ease * w)[column[r]], n)
        p = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -30, 30)))
        upper = np.where(grades > 0, np.take_along_axis(p, np.maximum(grades - 1, 0)[:, None], 1)[:, 0], 1.0)
        lower = np.where(grades < GRADES - 1, np.take_along_axis(p, np.minimum(grades, GRADES - 2)[:, None], 1)[:, 0], 0.0)
        mass = np.maximum(upper - lower, 1e-9)
        up, low = upper * (1 - upper), lower * (1 - lower)
        ds = -(up - low) / mass / n
        to_cut = np.zeros(GRADES - 1)
        np.add.at(to_cut, np.maximum(grades - 1, 0), np.where(grades > 0, up / mass / n, 0))
        np.add.at(to_cut, np.minimum(grades, GRADES - 2), np.where(grades < GRADES - 1, -low / mass / n, 0))
        dw = decay * w
        for r in runs:
            dw += ease * np.bincount(column[r], ds[owner[r]], len(own))
        grads = [dw, dense.T @ ds + decay * d, np.array([to_cut.sum(), to_cut[1] * np.exp(c[1])])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            theta[i] = theta[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    w, d, c = theta
    weights = np.zeros(1 << BITS, np.float32)
    weights[own] = ease * w
    return Model(weights, d, np.array([c[0], c[0] + np.exp(c[1])]))


def _ease(buckets: np.ndarray, owner: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Scale (0 to 1) of each bucket's weight, by how many standard errors its document
    frequency differs between grades below and from some grade on."""
    z, n = np.zeros(1 << BITS), len(grades)
    have = np.bincount(buckets, minlength=1 << BITS)
    for k in range(1, GRADES):
        above = grades >= k
        if above.all() or not above.any():
            continue
        share = above.mean()
        hits = np.bincount(buckets[above[owner]], minlength=1 << BITS)
        error = np.sqrt(np.maximum(have * share * (1 - share) * (1 - have / n), 0.25))
        z = np.maximum(z, np.abs(hits - have * share) / error)
    return np.minimum(z / FULL_Z, 1) ** POWER


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 where quality is 0, else 1 where toxic, else 2."""
    d = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)
    return d.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Fits on at most ``most`` rated documents; their ids are the only thing broadcast."""
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rated = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            buckets, at, dense = features(batch.column(2))
            packed = [buckets[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array(packed, pa.binary()), pa.array(dense.astype(np.float32).tolist(), pa.list_(pa.float32()))], ["doc_id", "grade", "buckets", "dense"])

    rows = rated.mapInArrow(ending(run), "doc_id long, grade int, buckets binary, dense array<float>").toArrow().sort_by("doc_id")
    lists = [np.frombuffer(b, np.int32) for b in rows.column("buckets").to_pylist()]
    if not lists:
        return Model()
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    dense = np.array(rows.column("dense").to_pylist(), np.float64)
    return fit(np.concatenate(lists), offsets, dense, rows.column("grade").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Adds expected_grade, p_sound, p_good and kept to ``docs`` (which has text); columns of
    these names are replaced."""
    docs = docs.drop("expected_grade", "p_sound", "p_good", "kept")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    place = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            p = model.tails(model.scores(*features(batch.column(place))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 1] >= threshold)], [*batch.schema.names, "expected_grade", "p_sound", "p_good", "kept"])

    return docs.mapInArrow(ending(run), f"{fields}, expected_grade double, p_sound double, p_good double, kept boolean")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")


def select_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents kept, with the columns of ``documents``."""
    docs = docs.select(*DOC_COLUMNS)
    return score(docs, train(docs, labels)).filter("kept").select(*DOC_COLUMNS)


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
SQL: dict[str, str] = {}
