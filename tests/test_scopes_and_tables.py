"""Refusals, scopes, samples, table operators and the bootstrap's pairing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadlake.operators import pairs, scopes, stats, tables, vectors


def ab(spark, rows, more=""):
    return spark.createDataFrame(rows, "a long, b long" + more)


def test_refusals_name_the_rows(spark):
    parts = ab(spark, [(1, 2, 1), (1, 2, 0), (1, 3, 0)], ", label int")
    with pytest.raises(ValueError, match="both labels"):
        scopes.fold_labels(parts, ab(spark, [(1, 2)]))
    with pytest.raises(ValueError, match="pair file lacks"):
        scopes.fold_labels(ab(spark, [(1, 2, 1)], ", label int"), ab(spark, [(5, 6)]))
    with pytest.raises(ValueError, match="pair file holds"):
        scopes.fold_labels(ab(spark, [(1, 2, 0)], ", label int"), ab(spark, [(1, 2)]))
    assert scopes.fold_labels(ab(spark, [(1, 2, 1), (1, 2, 1), (1, 3, 0)], ", label int"), ab(spark, [(1, 2)])).count() == 2
    folds = spark.createDataFrame([(0, "val"), (1, "train")], "fold int, part string")
    with pytest.raises(ValueError, match="folds without val"):
        scopes.require_part(folds, "val", 2)
    with pytest.raises(Exception, match="not finite"):
        scopes.require_finite(spark.createDataFrame([(1.0,), (float("nan"),)], "v double"), "v").collect()
    with pytest.raises(ValueError, match="more than 2"):
        pairs.cooccurring(spark.createDataFrame([(1, i) for i in range(3)], "g int, x int"), "g", "x", most=2)


def test_pools_and_row_sets(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    d = scopes.pool_reasons(ab(spark, [(1, 1), (1, 2), (1, 9), (2, 3), (1, 3)]), ids(1, 2, 3), ids(1, 2, 3), ab(spark, [(1, 2)]))
    assert {(r["a"], r["b"]): r["reason"] for r in d.collect()} == {(1, 1): "self_pair", (1, 2): "positive", (1, 9): "not_embedded", (2, 3): "kept", (1, 3): "kept"}
    rows = ab(spark, [(1, 2), (1, 3)]).withColumns({"t": F.lit(True), "o": F.col("b") == 2, "k": F.lit(True)})
    got = scopes.row_sets(rows, F.col("t"), F.col("o"), F.col("k")).groupBy("row_set").count()
    assert {r["row_set"]: r["count"] for r in got.collect()} == {"incl_overlap": 2, "test": 1, "matched": 1, "in_overlap": 1, "matched_incl_overlap": 2}
    scores = spark.createDataFrame([(1, 2, 0.2), (2, 1, 0.6), (1, 3, 0.5)], "i long, j long, score double").withColumn("k", F.lit(0))
    found = {r["b"]: r["score"] for r in scopes.pair_scores(ab(spark, [(1, 2), (1, 3)]).withColumn("k", F.lit(0)), scores, ["k"]).collect()}
    assert found == {2: pytest.approx(0.4), 3: None}


def test_student_distribution():
    assert tables.student_quantile(0.975, 1) == pytest.approx(12.7062047, abs=1e-5)
    assert tables.student_quantile(0.975, 4) == pytest.approx(2.7764451, abs=1e-6)
    assert tables.student_quantile(0.975, 29) == pytest.approx(2.0452296, abs=1e-6)
    assert tables.student_cdf(0.0, 7) == pytest.approx(0.5)


def test_student_p_column_equals_the_function(spark):
    rows = [(t, float(k)) for t in (0.3, -1.7, 2.5, 9.0) for k in range(1, 12)]
    d = spark.createDataFrame(rows, "t double, df double")
    for r in d.withColumn("p", tables.student_p(F.col("t"), F.col("df"))).collect():
        assert r["p"] == pytest.approx(2 * (1 - tables.student_cdf(abs(r["t"]), int(r["df"]))), abs=1e-9)


def test_exact_quantiles_narrow_and_balance_keeps_counts(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=3000), np.full(800, 0.25)])
    d = spark.createDataFrame([(float(v),) for v in x], "x double")
    for q in (0.0, 0.01, 0.5, 0.613, 0.99, 1.0):
        assert stats.quantile(d, "x", q, small=50) == pytest.approx(np.quantile(x, q))
    assert stats.quantile(d.limit(0), "x", 0.5) is None
    from dyadlake.operators import folds

    b = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") % 7 == 0).cast("int").alias("label"), F.col("id").cast("string").alias("u"))
    got = {(r["g"], r["label"]): r["count"] for r in folds.balance(b, ["g"], "label", "u").groupBy("g", "label").count().collect()}
    assert got == {(0, 0): 215, (0, 1): 215, (1, 0): 214, (1, 1): 214}
    sample = scopes.ratio_sample(b.withColumn("r", F.rand(3)), ["g"], "label", [F.col("r"), F.col("u")], 2.0)
    assert {(r["g"], r["label"]): r["count"] for r in sample.groupBy("g", "label").count().collect()} == {(0, 0): 430, (0, 1): 215, (1, 0): 428, (1, 1): 214}


def test_universe_of_ids_with_a_common_prefix(spark):
    names = [f"gene-{i:04d}" for i in range(300)]
    p = spark.createDataFrame([(names[i], names[(i * 7 + 1) % 300]) for i in range(300)] + [("12", "3")], "a string, b string")
    assert [r["id"] for r in pairs.universe(p).orderBy("idx").collect()] == ["3", "12", *names]


def test_tables(spark):
    d = spark.createDataFrame([("m", 0, True, True, 4.0), ("m", 0, True, False, 3.0), ("m", 0, False, True, 2.0), ("m", 0, False, False, 1.0)], "k string, fold int, x boolean, y boolean, v double")
    r = tables.factorial_effects(d, "fold", "x", "y", "v", ["k"]).first()
    assert (r["effect_x"], r["effect_y"], r["interaction"]) == (2.0, 1.0, 0.0)
    ranks = tables.ranked(spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 1.0), ("d", None)], "m string, v double").withColumn("g", F.lit(1)), ["g"], "v")
    assert {r["m"]: (r["rank"], r["margin"]) for r in ranks.collect()} == {"a": (1, 0.0), "b": (1, 0.0), "c": (3, -2.0), "d": (None, None)}
    maps = spark.createDataFrame([(1, {"p": "1", "q": "2", "z": "9"}, {"p": "1", "q": "3", "r": None})], "id int, l map<string,string>, r map<string,string>")
    assert {(r["field"], r["expected"], r["found"]) for r in tables.map_differences(maps, ["id"], "l", "r", ["z"]).collect()} == {("q", "2", "3")}
    picks = spark.createDataFrame([("c", 0, "y"), ("c", 1, "x"), ("c", 2, "y")], "cat string, fold int, pick string")
    assert tables.winners(picks, "cat", "fold", "pick").first()[:] == ("c", 3, "y/x")
    runs = spark.createDataFrame([("a", "m1", 1.0, "p2"), ("a", "m1", 1.0, "p1"), ("b", "m1", 1.0, "p"), ("b", "m2", 2.0, "q")], "g string, metric string, v double, path string")
    assert [(r["g"], r["path"]) for r in tables.best_runs(runs, "g", "metric", "v", "path").collect()] == [("a", "p1")]


def test_differences_to_a_reference_and_global_scalars(spark):
    reps = spark.createDataFrame([("r", 0, 0.5), ("x", 0, 0.75), ("r", 1, 0.5)], "model string, rep int, v double")
    assert [(r["model"], r["v"]) for r in stats.replicate_differences(reps, "model", "r", [], ["v"]).collect()] == [("x", 0.25)]
    z = vectors.normalise(spark.createDataFrame([([1.0, 3.0],), ([5.0, float("nan")],)], "v array<double>"), "v", 3.0, 2.0)
    assert z.first()["v"] == [-1.0, 0.0] and vectors.global_scalars(spark.createDataFrame([([1.0, 3.0],), ([5.0],)], "v array<double>"), "v", robust=True) == (3.0, pytest.approx(2.9652))


def test_intermediate_tables_go_with_their_scope(spark):
    import os

    from dyadlake.operators import lineage

    with lineage.scope(spark):
        d = lineage.settle(spark.range(5), "scoped")
        at = d.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(at) and d.count() == 5
        spark.range(3).cache().count()
    assert not os.path.exists(at) and spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_t_interval_beyond_its_table(spark):
    """The expansion joins the table, and many folds have an interval."""
    d = spark.createDataFrame([("m", float(i % 7)) for i in range(200)] + [("s", 1.0)], "model string, v double")
    near = {r["model"]: r for r in tables.t_interval(d, ["model"], "v", most=300).collect()}
    far = {r["model"]: r for r in tables.t_interval(d, ["model"], "v").collect()}
    assert far["m"]["low"] == pytest.approx(near["m"]["low"], abs=1e-9) and far["s"]["low"] is None


def test_sign_flips_of_many_folds_are_refused(spark):
    with pytest.raises(Exception, match="20 folds"):
        stats.sign_flip(spark.createDataFrame([(i, 1.0) for i in range(21)], "fold int, d double"), [], "d", "fold").collect()
