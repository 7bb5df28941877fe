"""Spectra, diffusion, closure and distance correlation against dense or recursive versions."""

import numpy as np
import pytest

from dyadlake.operators import dependence as D
from dyadlake.operators import propagation as G
from dyadlake.operators import spectra as S


def random_pairs(n, share, seed):
    r = np.random.RandomState(seed)
    return [(i, j) for i in range(n) for j in range(i + 1, n) if r.rand() < share]


def test_singular_triplets_equal_a_dense_solver(spark):
    pairs = random_pairs(60, 0.2, 4)
    a = np.zeros((60, 60))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    edges = S.two_way(spark.createDataFrame([*pairs, pairs[0], (None, 3)], "a int, b int"))
    t = S.truncated_svd(edges, 3, 1e-9)
    value, vector = np.linalg.eigh(a)
    order = np.argsort(-np.abs(value))[:3]
    assert np.allclose(t.values, np.abs(value[order]), atol=1e-8) and np.allclose(t.signed, value[order], atol=1e-8) and max(t.residuals) < 1e-8 * t.values[0]
    u = np.zeros((60, 3))
    for r in t.vectors.collect():
        u[r["id"]] = r["u"]
    want = vector[:, order]
    want = want * np.sign(want[np.abs(want).argmax(axis=0), range(3)])
    assert np.abs(u - want).max() < 1e-6
    e = {r["id"]: r["vector"] for r in S.embeddings(t).collect()}
    assert np.allclose(e[5], u[5] * t.values)


def test_spectrum_of_few_ids_and_of_none(spark):
    star = S.two_way(spark.createDataFrame([(0, i) for i in range(1, 5)], "a int, b int"))
    t = S.truncated_svd(star, 2)
    assert np.allclose(t.values, [2.0, 2.0]) and sorted(np.round(t.signed, 9)) == [-2.0, 2.0]
    assert S.truncated_svd(star.filter("src > 9"), 2).values == []


def test_diffusion_keeps_its_bound(spark):
    pairs = [*random_pairs(40, 0.12, 1), (100, 101), *[(0, i) for i in range(200, 230)]]
    ids = sorted({i for p in pairs for i in p})
    a = np.zeros((len(ids), len(ids)))
    for i, j in pairs:
        a[ids.index(i), ids.index(j)] = a[ids.index(j), ids.index(i)] = 1
    d = a.sum(axis=0)
    for restart, bound in ((0.5, 1e-3), (0.2, 1e-4)):
        true = restart * np.linalg.inv(np.eye(len(ids)) - (1 - restart) * a / d)
        edges = S.two_way(spark.createDataFrame(pairs, "a int, b int")).select("src", "dst")
        got = G.restart_diffusion(edges, spark.createDataFrame([(0,), (100,), (205,), (999,), (0,)], "id int"), restart, bound).collect()
        assert {r["source"] for r in got} == {0, 100, 205}
        p = {(r["source"], r["node"]): r["p"] for r in got}
        for s in (0, 100, 205):
            for k, node in enumerate(ids):
                less = true[k, ids.index(s)] - p.get((s, node), 0.0)
                assert -1e-12 <= less <= bound * d[k] + 1e-12


def test_closure_of_a_hierarchy_with_several_parents(spark):
    edges = [(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (6, 6), (7, None), (1, 2), (4, 8)]
    df = spark.createDataFrame(edges, "child int, parent int")
    got = {(r["node"], r["ancestor"]) for r in G.closure(df).collect()}
    up = {}
    for c, p in edges:
        if p is not None and c != p:
            up.setdefault(c, set()).add(p)
    def above(x):
        return set().union(*[{p} | above(p) for p in up.get(x, ())]) if x in up else set()
    assert got == {(c, x) for c in up for x in above(c)} and G.closure(df).count() == len(got)
    notes = spark.createDataFrame([("g", 1), ("g", 5), ("h", 8), (None, 1), ("h", None), ("g", 1)], "gene string, term int")
    assert {(r["item"], r["node"]) for r in G.pushed_up(notes, df, "gene", "term").collect()} == {("g", x) for x in (1, 2, 3, 4, 5, 8)} | {("h", 8)}
    with pytest.raises(ValueError, match="cycle"):
        G.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child int, parent int"))
    assert G.closure(df.filter("child > 99")).count() == 0


def plain_dcor(x, y, floor):
    a, b = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    a, b = (m - m.mean(axis=0) - m.mean(axis=1)[:, None] + m.mean() for m in (a, b))
    root = lambda v: np.sqrt(max(v, 0) + floor)
    cov, va, vb = (a * b).mean(), (a * a).mean(), (b * b).mean()
    return cov, root(cov) / np.sqrt(root(va) * root(vb) + floor) if floor or (va > 1e-14 and vb > 1e-14) else None


@pytest.mark.parametrize("floor", [0.0, 1e-8])
def test_distance_correlation_equals_all_distances(spark, floor):
    r = np.random.RandomState(3)
    groups = {"plain": (r.randn(90), r.randn(90)), "ties": (r.randint(0, 4, 80).astype(float), r.randint(0, 3, 80).astype(float)), "far": (1e6 + r.randn(50), np.arange(50.0) ** 2), "same": (np.ones(10), r.randn(10)), "one": (np.array([3.0]), np.array([4.0]))}
    rows = [(g, float(a), float(b)) for g, (x, y) in groups.items() for a, b in zip(x, y, strict=True)] + [("plain", None, 1.0), ("plain", float("nan"), 1.0), ("ties", 1.0, float("inf"))]
    got = {v["g"]: v for v in D.distance_correlation(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y", floor).collect()}
    for g, (x, y) in groups.items():
        cov, dcor = plain_dcor(x, y, floor)
        assert got[g]["n"] == len(x) and got[g]["dcov2"] == pytest.approx(cov, abs=1e-9 * max(1, abs(cov)))
        assert got[g]["dcor"] == (None if dcor is None else pytest.approx(dcor, abs=1e-8))


def test_distance_correlation_without_groups_or_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    assert D.distance_correlation(df, [], "x", "y").first()["dcor"] == pytest.approx(1.0) and D.distance_correlation(df.filter("x > 9"), [], "x", "y").count() == 0


def test_levels_one_after_another_give_the_same(spark, monkeypatch):
    r = np.random.RandomState(8)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(r.randn(40), r.randn(40), strict=True)], "x double, y double")
    whole = D.distance_correlation(df, [], "x", "y").first()
    monkeypatch.setattr(D, "LEVEL_ROWS", 80)
    parts = D.distance_correlation(df, [], "x", "y").first()
    assert parts["dcov2"] == pytest.approx(whole["dcov2"], abs=1e-12) and parts["dcor"] == pytest.approx(whole["dcor"], abs=1e-12)
