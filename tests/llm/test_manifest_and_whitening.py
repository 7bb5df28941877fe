"""Operators 11 to 13 against plain versions, with edge rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadlake.llm import exact_dedup, merkle_manifest, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string"


def docs(spark, rows):
    """doc_id, text, lang; with two columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "web", None if t is None else len(t), 7, "x") for i, t, lang in rows], DOCS).repartition(3)


# ---------------------------------------------------------------- exact deduplication


def plain_groups(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max(ids, key=lambda x: (x is not None, x)) for t, ids in groups.items()}
    return sorted((str(i), str(best[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)


@pytest.mark.parametrize("clashing", [False, True])
def test_exact_groups_against_a_dictionary(spark, clashing):
    """Hashes that clash all the time must not join texts that differ, nor part equal ones."""
    r = random.Random(4)
    texts = ["".join(r.choice("ab. \n") for _ in range(r.randrange(0, 40))) for _ in range(60)] + [None, "", "x" * 30000, "x" * 30001, "é" * 10, "\U0001f600." * 9]
    rows = [(i, r.choice(texts), "en") for i in range(300)] + [(7, "same row", "en")] * 5 + [(None, "same row", "en"), (None, "no id", "en"), (None, "no id", "de")]
    options = {"name": lambda c: (F.length(c) % 3).cast("long"), "shortest": 3, "longest": 7} if clashing else {}
    got = exact_dedup.exact_groups(docs(spark, rows), **options).collect()
    assert sorted((str(g["doc_id"]), str(g["keep_id"]), g["group_size"], g["text_sha256"]) for g in got) == plain_groups(rows)
    kept = [g for g in got if g["kept"]]
    assert len(kept) == len({t or "" for _, t, _ in rows}) == len({g["text_sha256"] for g in kept})
    assert all(g["doc_id"] == g["keep_id"] for g in kept)


def test_chunks_join_to_the_text_and_find_their_place_again(spark):
    r = random.Random(5)
    text = "".join(r.choice(["word ", "end. ", "line\n", "é"]) for _ in range(3000))
    rows = docs(spark, [(1, text, "en"), (2, "new start " + text, "en"), (3, "y" * 20000, "en"), (4, "", "en")])
    got = {x["doc_id"]: x["c"] for x in rows.select("doc_id", exact_dedup.chunks(F.col("text")).alias("c")).collect()}
    assert "".join(got[1]) == text and "".join(got[3]) == "y" * 20000 and got[4] == []
    assert all(len(c) <= exact_dedup.LONGEST for c in got[1] + got[3])
    assert len(set(got[1]) & set(got[2])) >= len(got[1]) - 2  # an insertion changes the chunks about it only


def test_exact_dedup_keeps_rows_with_all_columns_and_empty_tables(spark):
    rows = [(1, "a", "en"), (2, "a", "en"), (3, None, "en"), (4, "", "en"), (5, "b", None), (5, "b", None)]
    kept = exact_dedup.deduplicate(docs(spark, rows))
    assert sorted((x["doc_id"], x["size"]) for x in kept.collect()) == [(2, 7), (4, 7), (5, 7)] and kept.columns == docs(spark, rows).columns
    assert exact_dedup.exact_groups(docs(spark, rows).filter("doc_id > 9")).count() == 0


# ---------------------------------------------------------------- Merkle manifest


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(i, t, lang, source="web", n=None):
    parts = []
    for v in (i, source, lang, n if n is not None else (None if t is None else len(t)), t):
        parts.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return sha(["".join(parts)])


def plain_tree(leaves):
    """All levels of a tree."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def plain_path(tree, i):
    """(siblings before, after) from the leaves up."""
    for level in tree[:-1]:
        first = i - i % 8
        run = level[first : first + 8]
        yield run[: i % 8], run[i % 8 + 1 :]
        i //= 8


def plain_manifest(rows):
    langs = {}
    for i, t, lang in rows:
        langs.setdefault(lang, []).append((i, t, plain_leaf(i, t, lang)))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
        trees[lang] = plain_tree([x[2] for x in langs[lang]])
    top = plain_tree([trees[x][-1][0] for x in order])
    out = []
    for k, lang in enumerate(order):
        for j, (i, t, leaf) in enumerate(langs[lang]):
            path = [*plain_path(trees[lang], j), *plain_path(top, k)]
            node = leaf
            if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and t is not None:
                node = plain_leaf(i, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t), lang)
            for a, b in path:
                node = sha([*a, node, *b])
            out.append((str(i), leaf, trees[lang][-1][0], top[-1][0], sha([x for a, b in path for x in a + b]), node, node == top[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_against_plain_trees(spark, height):
    """Low builders force several stages of segments."""
    r = random.Random(height)
    rows = [(i * 3 - 200, r.choice(["Some Text", "lower", "", None, "É Ü"]), r.choice(["de", "de", "de", "es", None])) for i in range(700)]
    rows += [(i, "One", f"l{i:02d}") for i in range(70)] + [(5, "again", "de"), (5, "again", "de"), (5, "other", "de"), (None, "N", "de"), (None, None, None)] + [(1, "x", "n8")] * 8
    rows += [(2**60 + 1, "Large Id", "de")]
    got = merkle_manifest.verified(merkle_manifest.manifest(docs(spark, rows), height)).collect()
    fields = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((str(g["doc_id"]), *[g[f] for f in fields]) for g in got) == plain_manifest(rows)


def test_log_is_gapless_and_in_completion_order(spark):
    leaves = spark.createDataFrame([(t, i, bytearray(f"{t}{i}".encode().ljust(32))) for t, n in (("a", 1), ("b", 8), ("c", 77), ("d", 512)) for i in range(n)], "tree string, id long, leaf binary")
    stages, roots = merkle_manifest.build(merkle_manifest.placed(leaves, ["id"]), 1)
    nodes = {}
    for x in merkle_manifest.log_nodes(stages, 1).collect():
        nodes.setdefault(x["tree"], []).append((x["position"], x["level"], x["node"], bytes(x["digest"]).hex()))
    root = {x["tree"]: bytes(x["root"]).hex() for x in roots.collect()}
    for tree, n in (("a", 1), ("b", 8), ("c", 77), ("d", 512)):
        log = sorted(nodes[tree])
        plain = plain_tree([f"{tree}{i}".encode().ljust(32).hex() for i in range(n)])
        assert [x[0] for x in log] == list(range(sum(map(len, plain)))) and log[-1][3] == root[tree] == plain[-1][0]
        assert all(plain[level][node] == h for _, level, node, h in log)
        seen = set()
        for _, level, node, _ in log:  # a node comes after all of its children
            assert level == 0 or all((level - 1, c) in seen for c in range(node * 8, min(node * 8 + 8, len(plain[level - 1]))))
            seen.add((level, node))


def test_manifest_of_an_empty_table(spark):
    d = merkle_manifest.verified(merkle_manifest.manifest(docs(spark, [(1, "a", "en")]).filter("doc_id > 1")))
    assert d.count() == 0 and d.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


# ---------------------------------------------------------------- whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, x string").repartition(3)


def plain_whitening(a, k=8):
    x = np.floor(1024 * a.astype(np.float32).astype(float)) + 100000
    y = x - x.mean(axis=0)
    e, u = np.linalg.eigh(y.T @ y / len(y))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    whole, sums = x.astype(int).astype(object), x.astype(int).astype(object).sum(axis=0)
    return y @ u / np.sqrt(e), e / np.trace(y.T @ y / len(y)), ((len(y) * whole - sums) ** 2).sum(axis=1)


@pytest.mark.parametrize("kind", ["plain", "graded", "near"])
def test_whitening_against_a_dense_solver(spark, kind):
    r = np.random.RandomState(3)
    spread = {"plain": np.ones(20), "graded": 2.0 ** -np.arange(20), "near": np.array([5.0] * 3 + [1 + 1e-3 * i for i in range(17)])}[kind]
    a = r.randn(400, 20) @ np.diag(spread) @ np.linalg.qr(r.randn(20, 20))[0] * 30 + 50
    rows = [(i, [float(c) for c in v], 1, "a") for i, v in enumerate(a)]
    bad = [(900, None, 1, "a"), (901, [None] + [1.0] * 19, 1, "a"), (902, [float("nan")] * 20, 1, "a"), (903, [float("inf")] * 20, 1, "a"), (904, [], 1, "a"), (905, [1.0], 1, "a")]
    got = whitening.whiten(vectors(spark, rows + bad)).collect()
    want, shares, deviation = plain_whitening(a)
    assert len(got) == 400 * 8 and {g["n"] for g in got} == {400} and {g["identity_error"] for g in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    w = np.zeros((400, 8))
    for g in got:
        w[g["vec_id"], g["component"] - 1] = g["whitened"]
        assert g["deviation"] == deviation[g["vec_id"]] and g["explained"] == pytest.approx(shares[g["component"] - 1], rel=1e-9)
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * sign).max() < (1e-8 if kind != "near" else 1e-6)


def test_whitening_edges(spark):
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 1, "a")]).filter("vec_id > 1")).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 1, "a")] * 3)).count() == 0  # no direction varies
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 3.0, -float(i)], 1, "a") for i in range(9)] + [(None, [4.0, 3.0, -4.0], 1, "a")])).collect()
    assert {g["component"] for g in flat} == {1} and len(flat) == 10 and flat[0]["explained"] == pytest.approx(1.0, rel=1e-9)
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(vectors(spark, [(1, [1e30, 2.0], 1, "a")])).count()


def test_exact_sums_beyond_doubles(spark):
    """Large common offsets: products need more than 53 bits, and the covariance is still exact."""
    a = np.array([[3e6 * (i % 7) + j * i, 2e9 + i] for i, j in zip(range(50), range(50), strict=True)])
    x = whitening.whole_vectors(vectors(spark, [(i, [float(c) for c in v], 1, "a") for i, v in enumerate(a)]))
    n, sums = whitening.count_and_sums(x)
    whole = [[int(c) for c in r["x"]] for r in x.collect()]
    assert n == 50 and sums == [sum(c) for c in zip(*whole, strict=True)]
    exact = [[(n * sum(r[i] * r[j] for r in whole) - sums[i] * sums[j]) / n**2 for j in range(2)] for i in range(2)]
    assert whitening.covariance(x, n, sums).tolist() == exact


def test_inertia_and_intervals():
    r = np.random.RandomState(1)
    for n in (1, 2, 5, 12):
        m = r.randn(n, n)
        m = m + m.T
        assert whitening.inertia(m)[0] == (np.linalg.eigvalsh(m) > 0).sum()
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]))[0] == 1  # no usable diagonal
    u, _ = np.linalg.qr(r.randn(12, 12))
    e = np.array([9.0] * 5 + [4, 4, 3, 2, 1, 0.5, 0.0])  # a value of higher multiplicity than an interval takes
    v = (u * e) @ u.T
    parts = whitening.intervals(v, 8)
    assert sum(n for *_, n in parts) >= 8 and all(n == ((e > lo) & (e < hi)).sum() for lo, hi, n in parts)


def test_components_of_repeated_values(spark):
    u, _ = np.linalg.qr(np.random.RandomState(2).randn(12, 12))
    e = np.array([9.0] * 5 + [4, 4, 3, 2, 1, 0.5, 0.0])
    v = (u * e) @ u.T
    value, x = whitening.components(spark, v, 8)
    assert np.abs(value - e[:8]).max() < 1e-12 and np.abs(x.T @ x - np.eye(8)).max() < 1e-13 and np.abs(v @ x - x * value).max() < 1e-12
