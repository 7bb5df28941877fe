"""Golden values, invariances and refusals of the pair operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadlake.functions import pairs as C
from dyadlake.operators import folds, metrics, pairs, ranking, resolve, stats, vectors, views


def scores(spark, labels, values, weight=None):
    rows = [(1, int(y), float(s), w) for y, s, w in zip(labels, values, weight or [1] * len(labels))]
    return spark.createDataFrame(rows, "g int, label int, score double, w int")


@pytest.mark.parametrize(
    ("labels", "values", "want"),
    [([1, 0, 1], [3, 2, 1], -0.25), ([1, 1, 0, 0], [4, 3, 2, 1], 1.0), ([1, 0, 1, 0], [1, 1, 1, 1], 0.0), ([1, 0], [1, 2], -0.5)],
)
def test_precision_recall_gain(spark, labels, values, want):
    seg = metrics.segments(scores(spark, labels, values), ["g"])
    assert metrics.auprg(seg, ["g"]).first()["auprg"] == pytest.approx(want, abs=1e-12)


def test_metrics_of_one_class_are_null(spark):
    m = metrics.curve_metrics(metrics.segments(scores(spark, [1, 1], [1, 2]), ["g"]), ["g"]).first()
    assert m["auroc"] is None and m["ap"] is None and m["normalized_aupr"] is None


def test_constant_scores(spark):
    m = metrics.curve_metrics(metrics.segments(scores(spark, [1, 0, 0, 0], [5, 5, 5, 5]), ["g"]), ["g"]).first()
    assert m["auroc"] == 0.5 and m["ap"] == pytest.approx(0.25) and m["aupr"] == pytest.approx((1 + 0.25) / 2)


def test_weights_equal_repetition_and_monotone_transform(spark):
    import random

    rng = random.Random(3)
    y, s, w = [rng.random() < 0.4 for _ in range(60)], [rng.randrange(12) for _ in range(60)], [rng.randrange(1, 4) for _ in range(60)]
    weighted = metrics.auroc(scores(spark, y, s, w), ["g"], weight="w").first()["auroc"]
    many = [(a, b) for a, b, k in zip(y, s, w) for _ in range(k)]
    repeated = metrics.auroc(scores(spark, *zip(*many)), ["g"]).first()["auroc"]
    moved = metrics.auroc(scores(spark, [a for a, _ in many], [math.exp(b / 3) for _, b in many]), ["g"]).first()["auroc"]
    pos, neg = [b for a, b in many if a], [b for a, b in many if not a]
    brute = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert weighted == pytest.approx(brute) and repeated == pytest.approx(brute) and moved == pytest.approx(brute)


def test_running_sums_do_not_depend_on_ranges(spark):
    d = spark.range(1000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 1000).alias("x"), F.lit(1).alias("n"))
    for ranges in (2, 32):
        got = metrics.running(d, ["g"], "x", ["n"], ranges).filter("cum_n <> 1000 - x").count()
        assert got == 0


def test_spearman_without_spread_or_rows(spark):
    d = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 2.0), (1, 3.0, 2.0), (2, 1.0, 1.0), (2, float("nan"), 5.0), (3, 1.0, 3.0), (3, 2.0, 2.0), (3, 3.0, 1.0)], "g int, x double, y double")
    got = {r["g"]: r["r"] for r in stats.spearman(d, ["g"], "x", "y").collect()}
    assert got[1] is None and got[2] is None and got[3] == pytest.approx(-1)


def test_holm_sign_flip_and_ols(spark):
    d = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "id int, p double").withColumn("f", F.lit(0))
    got = {r["id"]: r["holm"] for r in stats.holm(d, ["f"], "p", ["id"]).collect()}
    assert got == {1: pytest.approx(0.03), 2: pytest.approx(0.06), 3: pytest.approx(0.06), 4: None}
    d = spark.createDataFrame([(0, k, v) for k, v in enumerate([1.0, 2.0, 3.0])], "g int, fold int, d double")
    assert stats.sign_flip(d, ["g"], "d", "fold").first()["p"] == pytest.approx(2 / 8)
    d = spark.createDataFrame([(0, 1.0, 5.0), (0, 1.0, 7.0)], "g int, x double, y double")
    r = stats.ols(d, ["g"], "x", "y").first()
    assert r["slope"] == 1.0 and r["intercept"] == 5.0


def test_pairs_and_conflicts(spark):
    d = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "c"), (None, "a")], "a string, b string")
    assert pairs.canonical_pairs(d).collect() == [("a", "b")]
    pos = spark.createDataFrame([(1, 2, ["x"], [0]), (1, 3, ["x"], [0])], "a int, b int, lines array<string>, heads array<int>")
    neg = spark.createDataFrame([(1, 2, ["y"], [0]), (2, 3, ["y"], [1])], "a int, b int, lines array<string>, heads array<int>")
    sizes = {p: tuple(d.count() for d in pairs.resolve_conflicts(pos, neg, p)) for p in ("drop", "positive", "negative", "context")}
    assert sizes == {"drop": (1, 1), "positive": (2, 1), "negative": (1, 2), "context": (2, 2)}
    with pytest.raises(ValueError):
        pairs.resolve_conflicts(pos, neg, "other")


def test_label_mask_rules(spark):
    one = lambda p, n, rule: [tuple(x) for x in spark.range(1).select(C.label_mask(F.array(*map(F.lit, p)), F.array(*map(F.lit, n)), 3, rule).alias("c")).first()["c"]]
    assert one([0, 1], [1, 2], "or") == [(1, 1), (1, 1), (0, 1)]
    assert one([0, 1], [1, 2], "mask") == [(1, 1), (0, 0), (0, 1)]


def test_lenient_bool_refuses(spark):
    d = spark.createDataFrame([("Yes",), ("0",), (None,)], "x string")
    assert [r[0] for r in d.select(C.lenient_bool("x")).collect()] == [True, False, None]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("maybe",)], "x string").select(C.lenient_bool("x")).collect()


def test_folds_do_not_leak(spark):
    p = spark.range(400).select((F.col("id") % 37).cast("string").alias("a"), ((F.col("id") * 7) % 41 + 40).cast("string").alias("b")).distinct()
    three = folds.carve_validation(folds.cv3(p, 4))
    assert {r["part"] for r in three.select("part").distinct().collect()} == {"train", "val", "test", "dropped"}
    assert all(r["pairs_twice"] == 0 and r["ids_shared"] == 0 for r in folds.leaks(three, True).collect())
    assert all(r["ids_shared"] == 0 for r in folds.leaks(folds.cv2(p, 4), False).collect())
    a, b = (folds.digest(x, ["fold"]).orderBy("fold").collect() for x in (three, three.orderBy(F.desc("b"))))
    assert a == b


def test_retrieval_conventions(spark):
    ranked = spark.createDataFrame([("q", 1, 1), ("q", 2, 0), ("q", 3, 1)], "query string, rank int, rel int")
    rel = spark.createDataFrame([("q", 4)], "query string, n_rel long")
    r = ranking.retrieval_metrics(ranked, rel, ["query"], [3]).first()
    assert r["recall"] == 0.5 and r["precision"] == pytest.approx(2 / 3)
    assert r["ap"] == pytest.approx((1 + 2 / 3) / 3) and r["ap_found"] == pytest.approx((1 + 2 / 3) / 2)
    assert r["ndcg_found"] > r["ndcg"]


def test_resolution_and_universe(spark):
    cur = spark.createDataFrame([("A", "1", 0), ("B", "2", 0)], "name string, id string, ord int")
    old = spark.createDataFrame([("a ", "9", 0), ("C", "3", 1), ("C", "4", 0)], "name string, id string, ord int")
    got = {r["name"]: (r["id"], r["tier"]) for r in resolve.ranked_dictionary([cur, old]).collect()}
    assert got == {"A": ("1", 0), "B": ("2", 0), "C": ("4", 1)}
    names = spark.createDataFrame([("A",), ("C",), ("Z",)], "name string")
    hit = {r["name"]: (r["id"], r["method"]) for r in resolve.first_unique_hit(names, [cur.drop("ord"), old.drop("ord")]).collect()}
    assert hit == {"A": ("1", 0), "C": (None, None), "Z": (None, None)}
    p = spark.createDataFrame([("10", "9"), ("x", "2"), ("X", "10")], "a string, b string")
    assert [r["id"] for r in pairs.universe(p).orderBy("idx").collect()] == ["2", "9", "10", "X", "x"]


def test_vectors(spark):
    d = spark.createDataFrame([(i, [float(i), float("nan") if i == 0 else 2.0]) for i in range(5)], "k int, v array<double>")
    z = vectors.standardise(d, vectors.fitted(vectors.column_statistics(d, "k", "v")), "v").orderBy("k").collect()
    assert z[0]["v"][1] == 0.0 and z[2]["v"][0] == 0.0
    robust = {r["dim"]: r["location"] for r in vectors.huber_locations(spark.createDataFrame([(i, [x]) for i, x in enumerate([1.0, 2.0, 3.0, 4.0, 1000.0])], "k int, v array<double>"), "k", "v").collect()}
    assert 2 < robust[0] < 5
    far = vectors.principal_components(spark.createDataFrame([(i, [float(i), 2.0 * i + (i % 2) * 0.01, 1.0 - i]) for i in range(30)], "k int, v array<double>"), "k", "v", 1).orderBy("k").collect()
    assert abs(far[0]["v"][0]) > 2 and far[0]["v"][0] * far[29]["v"][0] < 0


def test_fold_views(spark):
    d = spark.createDataFrame([("m", 0, 1.0), ("m", 1, float("nan")), ("r", 0, 0.5), ("r", 1, 0.25)], "model string, fold int, value double")
    got = {r["model"]: (r["mean"], r["n_finite"], r["n_folds"]) for r in views.summarise(d, ["model"], "value").collect()}
    assert got == {"m": (1.0, 1, 2), "r": (0.375, 2, 2)}
    best = {(r["model"], r["fold"]): r["best"] for r in views.flag_best(d, ["fold"], "value").collect()}
    assert best == {("m", 0): True, ("r", 0): False, ("m", 1): False, ("r", 1): False}


def test_fold_counts_from_bits_equal_those_from_rows(spark):
    """Leaks that are there are counted, of more folds than one row of bits holds; parts meet the ends once."""
    r = np.random.RandomState(3)
    rows = [(f, a, b, r.choice(["train", "val", "test", "dropped"], p=[0.3, 0.1, 0.2, 0.4]), (a + b) % 3 == 0) for f in (0, 1, 4, 19, 20, 23) for a in range(12) for b in range(a + 1, 12) if r.rand() < 0.4]
    rows += [(f, a, b, "test", x) for f, a, b, p, x in rows if p == "train" and (a + b + f) % 5 == 0]
    parts = spark.createDataFrame(rows, "fold int, a long, b long, part string, label boolean").withColumn("label", F.col("label").cast("int"))
    of = lambda f, *names: {(a, b) for g, a, b, p, _ in rows if g == f and p in names}
    ends = lambda pairs: {x for p in pairs for x in p}
    every = sorted({x[0] for x in rows})
    twice = {f: sum(sum(p in of(f, n) for n in ("train", "val", "test")) > 1 for p in of(f, "train", "val", "test")) for f in every}
    assert sum(twice.values()) > 5
    for both, most in ((True, 1), (False, 2)):
        shared = {f: sum((a in s) + (b in s) >= most for a, b in of(f, "test")) for f in every for s in [ends(of(f, "train", "val"))]}
        assert {(x["fold"], x["pairs_twice"], x["ids_shared"]) for x in folds.leaks(parts, both).collect()} == {(f, twice[f], shared[f]) for f in every}
    assert {tuple(x) for x in folds.train_keys(parts).select("fold", "n_keys", "n_first").collect()} == {(f, len(of(f, "train")), len({a for a, _ in of(f, "train")})) for f in every}
    assert {tuple(x) for x in folds.fit_counts(parts).select("fold", "n", "n_fit").collect()} == {(f, len(ends(of(f, "train", "val", "test"))), len(ends(of(f, "train")))) for f in every}
    for x in folds.geometry(parts, "label").collect():
        here, fit = of(x["fold"], x["part"]), ends(of(x["fold"], "train"))
        assert x["n"] == len(here) and x["prevalence"] == pytest.approx(np.mean([(a + b) % 3 == 0 for a, b in here])) and x["both_in_train"] == pytest.approx(np.mean([a in fit and b in fit for a, b in here]))
    plan = folds.leaks(parts, True)._jdf.queryExecution().executedPlan().toString()
    assert "count(distinct" not in plan and plan.count("Join") <= 6  # before: once a fold's rows, not once a pair


def test_score_segments_are_made_once(spark):
    """Cut points, totals and running sums read the table of segments, not the joins that gave the scores."""
    rows = spark.createDataFrame([(i % 5 / 4.0, i % 2) for i in range(40)], "score double, label int")
    plan = metrics.auroc(rows.withColumn("g", F.lit(1)), ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "score-segments" in plan
