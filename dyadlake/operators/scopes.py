"""Row sets, scopes, pools and lookups over pair tables (a < b), and refusals of bad input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import within


def refuse(df: DataFrame, what: str) -> None:
    """Raises if ``df`` has a row; the message shows up to five of them."""
    rows = df.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {[tuple(r) for r in rows]}")


def require_finite(df: DataFrame, value: str) -> DataFrame:
    """``df``, whose evaluation fails at the first null, NaN or infinite value."""
    x = F.col(value).cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return df.withColumn(value, F.when(ok, F.col(value)).otherwise(F.raise_error(F.concat(F.lit(f"{value} is not finite: "), F.coalesce(x.cast("string"), F.lit("null")))).cast(df.schema[value].dataType)))


def flagged(pairs: DataFrame, name: str, members: DataFrame) -> DataFrame:
    """Adds a boolean: whether the pair is in ``members``."""
    m = members.select("a", "b").distinct().withColumn("_in", F.lit(True))
    return pairs.join(m, ["a", "b"], "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_in")


def both_known(pairs: DataFrame, ids: DataFrame, name: str = "known") -> DataFrame:
    """Adds a boolean: whether both ends are in ``ids`` (column id)."""
    one = ids.select("id").distinct()
    for x in ("a", "b"):
        pairs = pairs.join(one.select(F.col("id").alias(x), F.lit(1).alias(f"_{x}")), x, "left")
    return pairs.withColumn(name, F.col("_a").isNotNull() & F.col("_b").isNotNull()).drop("_a", "_b")


def row_sets(rows: DataFrame, test: Column, overlap: Column, known: Column) -> DataFrame:
    """Long form: every row once for each of the five named row sets that it belongs to."""
    sets = {"incl_overlap": test, "test": test & ~overlap, "matched": test & ~overlap & known, "in_overlap": test & overlap, "matched_incl_overlap": test & known}
    named = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in sets.items()]), lambda x: x.isNotNull())
    return rows.withColumn("row_set", F.explode(named))


def membership(keys: DataFrame, pos: DataFrame, neg: DataFrame) -> DataFrame:
    """Adds in_pos and in_neg; a pair on both sides counts as positive."""
    d = flagged(flagged(keys, "in_pos", pos), "_neg", neg)
    return d.withColumn("in_neg", F.col("_neg") & ~F.col("in_pos")).drop("_neg")


def pool_reasons(pairs: DataFrame, embedded: DataFrame, universe: DataFrame, positives: DataFrame) -> DataFrame:
    """Adds reason: the first that drops a candidate negative, or ``kept``."""
    d = flagged(both_known(both_known(pairs, embedded, "_e"), universe, "_u"), "_p", positives)
    reason = F.when(F.col("a") == F.col("b"), "self_pair").when(~F.col("_e"), "not_embedded").when(~F.col("_u"), "outside_universe").when(F.col("_p"), "positive").otherwise("kept")
    return d.withColumn("reason", reason).drop("_e", "_u", "_p")


def label_conflicts(labelled: DataFrame) -> DataFrame:
    """Pairs that a set of labelled files gives both labels: a, b, n (rows)."""
    d = labelled.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_distinct("label").alias("_l"))
    return d.filter("_l > 1").drop("_l")


def fold_labels(parts: DataFrame, positives: DataFrame) -> DataFrame:
    """One label per pair from labelled fold parts (a, b, label). Refused: both labels on one
    pair, a positive that ``positives`` lacks, a negative that it holds."""
    refuse(label_conflicts(parts), "both labels on a pair")
    d = parts.select("a", "b", "label").distinct()
    refuse(d.filter("label = 1").join(positives, ["a", "b"], "left_anti"), "positives that the pair file lacks")
    refuse(d.filter("label = 0").join(positives, ["a", "b"], "left_semi"), "negatives that the pair file holds")
    return d


def require_part(parts: DataFrame, part: str, folds: int) -> DataFrame:
    """``parts``; refused where one of the folds 0..folds-1 has no row in ``part``."""
    have = parts.filter(F.col("part") == part).select("fold").distinct()
    spark = parts.sparkSession
    refuse(spark.range(folds).select(F.col("id").cast("int").alias("fold")).join(have, "fold", "left_anti"), f"folds without {part}")
    return parts


def pair_scores(pairs: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Looks pairs up in a directed score table (keys, i, j, score): the mean of both ways;
    null where one way is missing."""
    for way, (i, j) in {"_ij": ("a", "b"), "_ji": ("b", "a")}.items():
        pairs = pairs.join(scores.select(*keys, F.col("i").alias(i), F.col("j").alias(j), F.col("score").alias(way)), [*keys, "a", "b"], "left")
    return pairs.withColumn("score", (F.col("_ij") + F.col("_ji")) / 2).drop("_ij", "_ji")


def shifted(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Scores of a group moved so that its least is 1."""
    low = df.groupBy(*keys).agg(F.min(score).alias("_low"))
    return df.join(low, keys).withColumn(score, F.col(score) - F.col("_low") + 1).drop("_low")


def seen_index(train: DataFrame, known: DataFrame, answers: DataFrame) -> DataFrame:
    """Training and all known positives in order, less the answer key."""
    both = train.select("a", "b").unionByName(known.select("a", "b"))
    both = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    return both.join(answers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def fit_ids(parts: DataFrame) -> DataFrame:
    """fold, id, fits: an id is fitted on unless it stands in held-out pairs and in no train pair."""
    d = parts.filter("part <> 'dropped'").select("fold", F.explode(F.array("a", "b")).alias("id"), (F.col("part") == "train").alias("train"))
    return d.groupBy("fold", "id").agg(F.max("train").alias("fits"))


def view_coverage(pairs: DataFrame, views: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, share of pairs whose two ends both appear in at least one view (column id)."""
    d = both_known(pairs, views, "covered")
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("covered").cast("double")).alias("share"))


def ratio_sample(df: DataFrame, keys: list[str], label: str, order: list[Column], ratio: float) -> DataFrame:
    """All positives and, of the negatives in ``order``, the first ratio times as many per group.

    ``order``'s first column lies in [0, 1): slots of it are counted, so only the slot in
    which the quota ends is ranked.
    """
    d = df.withColumn("_slot", F.floor(order[0] * 256))
    need = df.groupBy(*keys).agg(F.ceil(F.count_if(F.col(label) == 1) * ratio).alias("_need"))
    counts = d.filter(F.col(label) == 0).groupBy(*keys, "_slot").agg(F.count("*").alias("_k"))
    upto = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_k").over(upto), F.lit(0))).join(need, keys).filter("_before < _need")
    neg = d.filter(F.col(label) == 0).join(counts.select(*keys, "_slot", "_k", (F.col("_need") - F.col("_before")).alias("_room")), [*keys, "_slot"])
    last = neg.filter("_k > _room").withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn <= _room").drop("_rn")
    kept = neg.filter("_k <= _room").unionByName(last)
    return d.filter(F.col(label) == 1).drop("_slot").unionByName(kept.drop("_slot", "_k", "_room"))


def last_wins(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys and the value of the last row by ``order``."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def typed_ends(edges: DataFrame, relation: str, kind: str) -> DataFrame:
    """Distinct ids of the ends that a relation ``<kind>_<verb>_<kind>`` types as ``kind``."""
    left, right = F.regexp_extract(relation, r"^([A-Za-z]+)_", 1), F.regexp_extract(relation, r"_([A-Za-z]+)$", 1)
    ends = F.array(F.when(left == kind, F.col("h")), F.when(right == kind, F.col("t")))
    return edges.select(F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("id")).distinct()


def picked(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The best candidate per key in a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def tiered(ids: DataFrame, tiers: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Adds value and source: of the first tier (key, value) that knows the id."""
    for i, t in enumerate(tiers.values()):
        ids = ids.join(t.select(key, F.col(value).alias(f"_v{i}")), key, "left")
    source = F.coalesce(*[F.when(F.col(f"_v{i}").isNotNull(), F.lit(n)) for i, n in enumerate(tiers)])
    return ids.withColumns({value: F.coalesce(*[f"_v{i}" for i in range(len(tiers))]), "source": source}).drop(*[f"_v{i}" for i in range(len(tiers))])


def index_map(ids: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """id, source and target position (-1 where a side lacks it) of two ordered universes."""
    d = ids.select("id").distinct()
    for name, u in (("source", source), ("target", target)):
        d = d.join(u.select("id", F.col("idx").alias(f"_{name}")), "id", "left").withColumn(name, F.coalesce(f"_{name}", F.lit(-1))).drop(f"_{name}")
    return d


def head_scores(pairs: DataFrame, vectors: DataFrame, heads: list[int], width: int) -> DataFrame:
    """Adds scores (one dot product per head, a stretch of the vector each) and their maximum."""
    for x in ("a", "b"):
        pairs = pairs.join(vectors.select(F.col("id").alias(x), F.col("vec").alias(f"_{x}")), x)
    dot = lambda h: F.aggregate(F.zip_with(F.slice("_a", h * width + 1, width), F.slice("_b", h * width + 1, width), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return pairs.withColumn("scores", F.array(*[dot(h) for h in heads])).withColumn("any", F.array_max("scores")).drop("_a", "_b")


def induced(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs with both ends in ``ids``."""
    return within(pairs, ids)
