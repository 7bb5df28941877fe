import pytest
from pyspark.sql import functions as F

from dyadlake.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")


def test_hypergeometric_is_exact_on_small_support(spark):
    """Inverting a fine grid of uniforms gives the distribution itself."""
    from math import comb

    n = 20000
    x = mixing.hypergeometric(F.lit(12).cast("long"), F.lit(5).cast("long"), F.lit(7).cast("long"), (F.col("id") + 0.5) / n)
    got = {r["x"]: r["count"] / n for r in spark.range(n).select(x.alias("x")).groupBy("x").count().collect()}
    for k in range(0, 6):
        assert got.get(k, 0) == pytest.approx(comb(5, k) * comb(7, 7 - k) / comb(12, 7), abs=2e-4)


def test_hypergeometric_far_from_small_numbers(spark):
    x = mixing.hypergeometric(F.lit(10**7), F.lit(4 * 10**6), F.lit(5 * 10**6), F.lit(0.5))
    assert abs(spark.range(1).select(x).first()[0] - 2 * 10**6) <= 1


def test_split_keeps_quotas_and_shares(spark):
    q = spark.createDataFrame([(0, 700), (1, 1), (2, 0), (3, 322)], "src long, q long")
    rows = mixing.split_quotas(q, 8, 5).collect()
    by_src, by_shard = {}, {}
    for r in rows:
        assert r["q"] >= 0
        by_src[r["src"]] = by_src.get(r["src"], 0) + r["q"]
        by_shard[r["shard"]] = by_shard.get(r["shard"], 0) + r["q"]
    assert by_src == {0: 700, 1: 1, 2: 0, 3: 322}
    assert sorted(by_shard) == list(range(8)) and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_mix_meets_targets_and_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PER_SHARD", 8)
    monkeypatch.setattr(mixing, "PER_BUCKET", 4)
    rows = [(i, "w " * (40 + i), "en", "b" if i % 3 else "a", 0, "clash") for i in range(40)]
    rows += [(100, None, "en", "c", 0, "x"), (101, "", "en", None, 0, "x"), (102, "one two", "en", None, 0, "x"), (5, "again " * 45, "en", "b", 0, "x"), (5, "again " * 45, "en", "b", 0, "x"), (None, "no id " * 30, None, "a", 0, "x")]
    d, t, dealt = mixing.mix(docs(spark, rows).drop("size").withColumn("size", F.lit("clash")), block=7)
    t, got = {r["source"]: r for r in t.collect()}, dealt.collect()
    assert len({r["shard"] for r in got}) > 4
    by_src = {}
    for r in got:
        by_src[r["src"]] = by_src.get(r["src"], 0) + r["words"]
    assert t["c"]["target"] == 0 and t[None]["src"] == 3 and t[None]["target"] == 6  # three times its size
    for s in t.values():
        assert abs(by_src.get(s["src"], 0) - s["target"]) <= 7
    assert len({(r["doc_id"], r["ord"], r["block"], r["copy"]) for r in got}) == len(got)
    assert sorted((r["shard"], r["position"]) for r in got) == sorted({(r["shard"], r["position"]) for r in got})
    again = mixing.mix(docs(spark, rows[::-1]), block=7)[2].collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_documents_and_empty(spark):
    rows = [(i, f"a{i}  b\nc " + "w " * 9, "en", "s" + str(i % 2), 0, "x") for i in range(6)]
    out = mixing.mixed_documents(docs(spark, rows), block=5).collect()
    whole = {r[0]: r[1] for r in rows}
    assert out and all(r["n_chars"] == len(r["text"]) for r in out)
    assert any(r["text"] == whole[r["doc_id"]] for r in out)
    assert mixing.mixed_documents(docs(spark, []), block=5).count() == 0


def test_targets_equal_a_plain_water_filling(spark):
    import random

    rng = random.Random(6)
    for _ in range(4):
        sizes = {s: rng.choice([0, 1, 7, 50, 400, 5000]) for s in "abcdefgh"[: rng.randrange(1, 9)]}
        rows = [(i, "w " * n, "en", s, 0, "x") for i, (s, n) in enumerate(sizes.items())]
        got = {r["source"]: r["target"] for r in mixing.targets(mixing.sized(docs(spark, rows))).collect()}
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
        left, open_, want = float(sum(sizes.values())), set(sizes), {}
        while open_:
            level = left / sum(weight[s] for s in open_)
            full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
            if not full:
                want |= {s: level * weight[s] for s in open_}
                break
            want |= {s: 3.0 * sizes[s] for s in full}
            left -= sum(want[s] for s in full)
            open_ -= full
        assert got == pytest.approx(want)


def test_every_rank_has_one_shard(spark):
    q = spark.createDataFrame([(0, 5000), (1, 3), (2, 64)], "src long, q long")
    ranks = q.select("src", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).alias("rank"))
    stretches = mixing.split_quotas(q, 64, 9)
    got = mixing.place(ranks, stretches, q, 64).groupBy("src", "shard").agg(F.count("*").alias("n"), (F.max("rank") - F.min("rank") + 1).alias("span"))
    want = {(r["src"], r["shard"]): r["q"] for r in stretches.collect() if r["q"]}
    assert {(r["src"], r["shard"]): r["n"] for r in got.collect()} == want and got.filter("n <> span").count() == 0
