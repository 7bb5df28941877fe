"""Fitted transforms, robust components and the windows they rest on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadlake.operators import transforms as T


def plain_window(x, share):
    x = np.sort(x)
    h = max(1, int(len(x) * share))
    best = min((x[i : i + h].var(), i) for i in range(len(x) - h + 1))
    return best[0]


@pytest.mark.parametrize("width", [3, 20_000])
def test_shortest_windows_equal_all_windows(spark, width):
    """Runs of equal values, windows that end inside them, and slices that no run starts in."""
    r = np.random.RandomState(4)
    groups = {"plain": r.randn(41), "ties": np.round(r.randn(60) * 2), "hot": np.array([5.0] * 20 + [1.0, 2.0, 9.0] * 5), "two": np.array([0.0] * 10 + [1.0] * 11), "same": np.full(7, 3.0), "one": np.array([2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, x double")
    got = {v["g"]: v for v in T.shortest_windows(df, ["g"], "x", 0.75, width).collect()}
    for g, x in groups.items():
        assert got[g]["scale"] ** 2 == pytest.approx(plain_window(x, 0.75), abs=1e-12), g


def planted(seed=1):
    """Rows about a plane, 15 % of them far off it in one direction."""
    r = np.random.RandomState(seed)
    basis = np.linalg.qr(r.randn(8, 8))[0]
    x = r.randn(300, 8) @ np.diag([9, 7, 1, 0.8, 0.6, 0.5, 0.4, 0.3]) @ basis.T
    x[:45] = r.randn(45, 8) * 0.5 + 60 * basis[:, 5] + 3
    return x, basis


def angle(a, b):
    """The largest angle between two subspaces, in degrees."""
    s = np.linalg.svd(np.linalg.qr(a)[0].T @ np.linalg.qr(b)[0], compute_uv=False)
    return np.degrees(np.arccos(np.clip(s.min(), -1, 1)))


def test_outliers_do_not_turn_robust_components(spark):
    x, basis = planted()
    df = spark.createDataFrame([(i, [float(c) for c in v] + [1.0]) for i, v in enumerate(x)], "id long, v array<double>")  # one constant column
    got = T.robust_components(df, "id", "v", 2)
    clean = x[45:] - x[45:].mean(axis=0)
    ideal = np.linalg.svd(clean, full_matrices=False)[2][:2].T
    assert got.shape == (9, 2) and np.abs(got[8]).max() < 1e-9

    assert angle(got[:8], ideal) < 1 and angle(got[:8], basis[:, :2]) < 2
    plain = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:2].T
    assert angle(plain, basis[:, :2]) > 60
    o = {r["id"]: r["out"] for r in T.outlyingness(df, "id", "v").collect()}
    assert min(o[i] for i in range(45)) > max(o[i] for i in range(45, 300))
    with pytest.raises(ValueError, match="effective rank"):
        T.robust_components(df, "id", "v", 8)


def test_components_by_share_of_variance():
    assert [T.components_for(np.array([6.0, 3.0, 1.0]), t) for t in (2, 9, 0.5, 0.6, 0.61, 0.95, 1.0)] == [2, 3, 1, 1, 2, 3, 3]
    assert T.components_for(np.zeros(3), 0.5) == 3


def modal(spark, held=1.0):
    r = np.random.RandomState(8)
    rows = []
    for i in range(60):
        a, b = r.randn(4) * [3, 2, 1, 1], r.randn(3) + 5
        if i % 7 == 0:
            a[i % 4] = np.nan
        fit = i % 3 > 0
        a, b = (a, b) if fit else (a * held, b * held)
        rows.append((2**60 + i, [float(c) for c in a], None if i % 11 == 0 else [float(c) for c in b], fit, "x"))
    return spark.createDataFrame(rows, "id long, a array<double>, b array<double>, fit boolean, steps string")


def vectors(df):
    return {r["id"]: np.array(r["vector"]) for r in df.collect()}


@pytest.mark.parametrize("method", ["plain", "robust"])
def test_held_out_rows_change_no_statistic(spark, method, tmp_path):
    plain = method == "plain"
    e = T.ModalityTransform(["a", "b"], "id", "fit", dims=[2, None], post_dims=3 if plain else None, method=method)
    one, two = e.fit(modal(spark)), e.fit(modal(spark, held=100.0))
    x, y = vectors(one.transform(modal(spark))), vectors(two.transform(modal(spark)))
    assert x.keys() == y.keys() and len(x) == 60 and all(np.allclose(x[k], y[k], atol=1e-9) and len(x[k]) == (3 if plain else 5) for k in x)
    one.write().save(f"file://{tmp_path}/model")
    again = vectors(T.ModalityModel.load(f"file://{tmp_path}/model").transform(modal(spark)))
    assert all((again[k] == x[k]).all() for k in x)


def test_median_centred_components_equal_a_dense_solver(spark):
    df = modal(spark).filter("b is not null").withColumn("fit", F.lit(True))
    m = T.ModalityTransform(["b"], "id", "fit", dims=[2], method="svd").fit(df)
    b = np.array([r["b"] for r in df.collect()])
    _, _, vt = np.linalg.svd(b - np.median(b, axis=0), full_matrices=False)
    basis = np.array(m.steps[0]["basis"])
    assert np.allclose(np.abs((basis * vt[:2].T).sum(axis=0)), 1)
    p = b @ basis
    middle = np.median(p)
    assert m.steps[0]["middle"] == pytest.approx(middle) and m.steps[0]["spread"] == pytest.approx(1.4826 * np.median(np.abs(p - middle)))


def test_refusals(spark):
    d = modal(spark)
    with pytest.raises(ValueError):
        T.ModalityTransform(["a"], "id", "fit", method="other")
    with pytest.raises(ValueError):
        T.ModalityTransform(["a"], "id", "fit", dims=[1, 2])
    with pytest.raises(ValueError, match="without any vector"):
        T.ModalityTransform(["b"], "id", "fit").fit(d.withColumn("b", F.lit(None).cast("array<double>")))
    m = T.ModalityTransform(["a"], "id", "fit").fit(d)
    with pytest.raises(ValueError, match="wide"):
        m.transform(d.withColumn("a", F.array(F.lit(1.0))))
