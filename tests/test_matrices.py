"""Block stores and dense matrix files."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadlake.sources import matrices as X


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    r = np.random.RandomState(2)
    cells = [(i, j, float(np.round(r.randn(), 3))) for i in range(50) for j in range(i, 50) if r.rand() < 0.4 and (i < 16 or j > 35)]
    rows = [(j, i, s) if r.rand() < 0.5 else (i, j, s) for i, j, s in cells] + [(1, 2, None), (None, 3, 1.0), *[(i, j, s - 5) for i, j, s in cells[:9]]]
    at = f"file://{tmp_path_factory.mktemp('store')}/m"
    X.write_blocks(spark.createDataFrame(rows, "i long, j long, score double").repartition(3), at, 50, block=8)
    return X.read_blocks(spark, at), {(i, j): np.float32(s) for i, j, s in cells}


def test_pairs_are_found_in_either_order(spark, store):
    blocks, known = store
    asked = [(i, j) for i in range(0, 50, 3) for j in range(0, 50, 2)] + [(None, 1), (4, 4), (4, 4)]
    got = {(r["i"], r["j"]): r["score"] for r in X.pair_scores(blocks, spark.createDataFrame(asked, "i long, j long"), 8).collect()}
    assert got.keys() == {p for p in asked if p[0] is not None}
    assert all(got[i, j] == (None if known.get((min(i, j), max(i, j))) is None else pytest.approx(known[min(i, j), max(i, j)])) for i, j in got)


def test_rows_have_both_sides(spark, store):
    blocks, known = store
    got = {(r["i"], r["j"]): r["score"] for r in X.row_scores(blocks, spark.createDataFrame([(3,), (9,), (40,), (None,), (3,)], "i long"), 8).collect()}
    want = {(i, j): known.get((min(i, j), max(i, j))) for i in (3, 9, 40) for j in range(50)}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v is not None}


def test_only_asked_blocks_are_read(spark, store):
    blocks, _ = store
    plan = X.pair_scores(blocks, spark.createDataFrame([(1, 2), (2, 60)], "i long, j long"), 8)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(?bi#\d+ (=|IN|INSET)", plan)
    assert X.only_rows(blocks, spark.createDataFrame([(1,), (5,)], "bi int"), 1).rdd.getNumPartitions() >= 1
    assert blocks.filter("bi = 0 and bj = 1").count() == 1


def test_statistics_leave_out_the_diagonal(spark, store):
    blocks, known = store
    s = X.statistics(blocks).first()
    v = np.array([x for (i, j), x in known.items() if i != j], float)
    assert (s["n"], s["cells"], s["known"], s["diagonal_known"]) == (50, 1225, len(v), sum(i == j for i, j in known))
    assert s["mean"] == pytest.approx(v.mean()) and s["sd"] == pytest.approx(v.std(ddof=1)) and (s["least"], s["most"]) == (pytest.approx(v.min()), pytest.approx(v.max()))


def test_indices_out_of_range_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="outside"):
        X.write_blocks(spark.createDataFrame([(1, 9, 1.0)], "i long, j long, score double"), f"file://{tmp_path}/m", 9)
    empty = f"file://{tmp_path}/e"
    X.write_blocks(spark.createDataFrame([], "i long, j long, score double"), empty, 9)
    assert X.statistics(X.read_blocks(spark, empty)).first()["known"] is None or X.statistics(X.read_blocks(spark, empty)).first()["known"] == 0


@pytest.mark.parametrize("kind", ["<f4", "<f8"])
def test_dense_files_are_read_by_ranges(spark, tmp_path, kind):
    m = np.random.RandomState(1).randn(30, 20).astype(kind)
    np.save(tmp_path / "m.npy", m)
    spark.dataSource.register(X.NpyMatrix)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    d = spark.read.format("npy_matrix").option("rows", "7").load(f"file://{tmp_path}/m.npy")
    for where, i, j in (("true", range(30), range(20)), ("i = 4 and j >= 17", [4], [17, 18, 19]), ("i in (3, 29) and j < 2", [3, 29], [0, 1]), ("i > 27 and j = 5 and score is not null", [28, 29], [5]), ("i = 99", [], [])):
        got = {(r["i"], r["j"]): r["score"] for r in d.filter(where).collect()}
        assert got == {(a, b): float(m[a, b]) for a in i for b in j}
    reader = X.NpyReader(str(tmp_path / "m.npy"), 7)
    assert list(reader.pushFilters([X.EqualTo(("i",), 4), X.GreaterThan(("j",), 16), X.In(("j",), (17, 19))])) == [X.In(("j",), (17, 19))]
    assert reader.i == (4, 5) and reader.j == (17, 20) and len(reader.partitions()) == 1
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == 3  # three numbers are read, not 600
    with pytest.raises(Exception, match="no .npy"):
        (tmp_path / "x.npy").write_bytes(b"12345678")
        X.NpyReader(str(tmp_path / "x.npy"), 7)


def test_empty_questions(spark, store):
    blocks, _ = store
    none = spark.createDataFrame([(1, 1)], "i long, j long").filter(F.col("i") > 9)
    assert X.pair_scores(blocks, none, 8).count() == 0 and X.row_scores(blocks, none, 8).count() == 0


def test_thin_blocks_take_what_their_cells_take(spark, tmp_path):
    """Cells spread over many blocks, some given twice, and one block that is known in full."""
    r = np.random.RandomState(7)
    known = {(int(i), int(j)): float(v) for i, j, v in zip(r.randint(0, 5000, 400), r.randint(5000, 100_000, 400), r.randint(0, 99, 400), strict=True)}
    known |= {(i, 64 + j): float(i - j) for i in range(16) for j in range(16)}
    rows = [(i, j, s) for (i, j), s in known.items()] + [(j, i, s - 1) for (i, j), s in known.items()]
    at = f"file://{tmp_path}/thin"
    X.write_blocks(spark.createDataFrame(rows, "i long, j long, score double").repartition(5), at, 100_000, 16)
    blocks = X.read_blocks(spark, at)
    assert blocks.count() == len({(i // 16, j // 16) for i, j in known})
    assert blocks.selectExpr("sum(length(data))").first()[0] <= 8 * len(known)  # 1,024 bytes a block before
    got = {(x["i"], x["j"]): x["score"] for x in X.pair_scores(blocks, spark.createDataFrame([*known, (3, 4), (99_999, 1)], "i long, j long"), 16).collect()}
    assert got == {**known, (3, 4): None, (99_999, 1): None}
    low = {(x["i"], x["j"]): x["score"] for x in X.row_scores(blocks, spark.createDataFrame([(5,), (70,)], "i long"), 16).collect()}
    assert low == {(i, j): s for (i, j), s in known.items() if i == 5} | {(j, i): s for (i, j), s in known.items() if j == 70}
    s = X.statistics(blocks).first()
    assert s["known"] == len(known) and s["mean"] == pytest.approx(np.mean(list(known.values())))
