"""Tie-correct classification metrics, all from one table of score segments.

A segment is all rows of a group that share a score: a group has as many segments as
distinct scores, and every curve has one point per segment. Weighted rows (bootstrap
multiplicities) only change the segment's sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pairs import normalized_aupr
from .lineage import settle


def running(df: DataFrame, keys: list[str], order: str, sums: list[str], ranges: int = 32) -> DataFrame:
    """Adds ``cum_<c>``: sums of c up to the row in descending ``order``, within ``keys``.

    One row per (keys, order) is expected. Values of ``order`` are split at approximate
    quantiles, each range is summed by itself, and the totals of higher ranges are added,
    so that a single large group is not one task.
    """
    cuts = sorted(set(df.agg(F.percentile_approx(order, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]))).first()[0] or []))
    at = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(order).cast("double"))) if cuts else F.lit(0)
    d = df.withColumn("_p", at)
    higher = Window.partitionBy(*keys).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "_p").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    totals = totals.select(*keys, "_p", *[F.coalesce(F.sum(f"_t_{c}").over(higher), F.lit(0)).alias(f"_h_{c}") for c in sums])
    inside = Window.partitionBy(*keys, "_p").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_i_{c}": F.sum(c).over(inside) for c in sums}).join(totals, [*keys, "_p"])
    return d.withColumns({f"cum_{c}": F.col(f"_i_{c}") + F.col(f"_h_{c}") for c in sums}).drop("_p", *[f"_{x}_{c}" for c in sums for x in "ih"])


def segments(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """keys, score, pos, neg, cum_pos, cum_neg, n_pos, n_neg; descending score is cumulative."""
    w = F.col(weight) if weight else F.lit(1)
    s = df.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(w * F.col(label)).alias("pos"), F.sum(w * (1 - F.col(label))).alias("neg"))
    s = running(settle(s, "score-segments"), keys, "score", ["pos", "neg"])  # its cut points, totals and sums read it
    totals = s.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return s.join(totals, keys)


def curve_metrics(seg: DataFrame, keys: list[str]) -> DataFrame:
    """auroc, ap, aupr (trapezoid), f1_max, prevalence, normalized_aupr per group.

    A metric that a group can't have (one class only) is null.
    """
    d = seg.withColumns({"precision": F.try_divide(F.col("cum_pos").cast("double"), F.col("cum_pos") + F.col("cum_neg")), "recall": F.try_divide(F.col("cum_pos").cast("double"), F.col("n_pos"))})
    # the point before is what the cumulative sums were without this segment: no window is needed
    before_p, before_n = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    last_p, last_r = F.coalesce(F.try_divide(before_p.cast("double"), before_p + before_n), F.lit(1.0)), F.coalesce(F.try_divide(before_p.cast("double"), F.col("n_pos")), F.lit(0.0))
    d = d.withColumn("slab", (F.col("recall") - last_r) * (F.col("precision") + last_p) / 2)
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    wins = F.col("pos") * (F.col("n_neg") - F.col("cum_neg") + F.col("neg") / 2.0)  # negatives below, ties half
    m = d.groupBy(*keys).agg(
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
        F.sum(F.when(both, F.try_divide(wins.cast("double"), (F.col("n_pos") * F.col("n_neg")).cast("double")))).alias("auroc"),
        F.sum(F.when(both, F.col("pos") / F.col("n_pos") * F.col("precision"))).alias("ap"),
        F.sum(F.when(both, F.col("slab"))).alias("aupr"),
        F.max(F.when(both, f1)).alias("f1_max"),
    )
    m = m.withColumn("prevalence", F.col("n_pos") / (F.col("n_pos") + F.col("n_neg")))
    return m.withColumn("normalized_aupr", normalized_aupr("aupr", "prevalence"))


def auroc(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """keys, n_pos, n_neg, auroc (Mann-Whitney; ties count half; null with one class)."""
    return curve_metrics(segments(df, keys, score, label, weight), keys).select(*keys, "n_pos", "n_neg", "auroc")


def auprg(seg: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the precision-recall-gain curve, by the definition of Flach and Kull.

    Gains use the curve's counts. Where recall gain crosses zero between two points, a
    point is interpolated on the counts; the area takes recall gains from 0 to 1. A segment
    and its cumulative sums hold both ends of a step, so the area is a plain sum.
    """
    pos, neg = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    tp0, fp0 = (F.col("cum_pos") - F.col("pos")).cast("double"), (F.col("cum_neg") - F.col("neg")).cast("double")
    d = seg.filter("n_pos > 0 and n_neg > 0").select(*keys, "score", pos.alias("p"), neg.alias("n"), tp0.alias("t0"), fp0.alias("f0"), F.col("cum_pos").cast("double").alias("t1"), F.col("cum_neg").cast("double").alias("f1"))
    zero = F.col("p") * F.col("p") / (F.col("p") + F.col("n"))  # true positives at recall gain 0

    def gains(t: Column, f: Column) -> Column:
        recall = 1 - F.try_divide(F.col("p") * (F.col("p") - t), F.col("n") * t)
        return F.struct(recall.alias("r"), F.when((t == F.col("p")) & (f == F.col("n")), F.lit(0.0)).otherwise(1 - F.try_divide(F.col("p") * f, F.col("n") * t)).alias("g"))

    d = d.withColumn("z", zero).withColumn("fz", F.col("f0") + F.try_divide((F.col("z") - F.col("t0")) * (F.col("f1") - F.col("f0")), F.col("t1") - F.col("t0")))
    crosses = (F.col("t0") < F.col("z")) & (F.col("z") < F.col("t1"))
    a = F.when(crosses, gains(F.col("z"), F.col("fz"))).when(F.col("t0") >= F.col("z"), gains(F.col("t0"), F.col("f0")))
    b = gains(F.col("t1"), F.col("f1"))
    slab = F.when(a.isNotNull() & (F.col("t1") >= F.col("z")), (b["r"] - a["r"]) * (b["g"] + a["g"]) / 2).otherwise(0.0)
    return d.groupBy(*keys).agg(F.sum(slab).alias("auprg"))


def views(cells: DataFrame, keys: list[str], row: list[str], head: str, score: str = "score", label: str = "label") -> DataFrame:
    """AUROC of a partial multi-label table in three views, as rows of one table.

    ``stratified``: all supervised cells together; ``any``: per row the OR of labels against
    the largest score; ``macro``: mean over categories that have both classes.
    """
    lit = lambda v: F.lit(v).alias("view")
    cells = cells.withColumn("_g", F.lit(1)) if not keys else cells
    keys = keys or ["_g"]
    whole = auroc(cells, keys, score, label).select(*keys, lit("stratified"), "auroc", (F.col("n_pos") + F.col("n_neg")).alias("n"))
    rows = cells.groupBy(*keys, *row).agg(F.max(score).alias("score"), F.max(label).alias("label"))
    any_ = auroc(rows, keys).select(*keys, lit("any"), "auroc", (F.col("n_pos") + F.col("n_neg")).alias("n"))
    per = auroc(cells, [*keys, head], score, label)
    macro = per.groupBy(*keys).agg(F.avg("auroc").alias("auroc"), F.count("auroc").alias("n")).select(*keys, lit("macro"), "auroc", "n")
    return whole.unionByName(any_).unionByName(macro)


def tail_flags(df: DataFrame, value: str, share: float = 0.01, most: float = 0.02) -> DataFrame:
    """Flags rows in the top and bottom ``share`` (interpolated quantiles); null where ties
    make that tail more than ``most`` of all rows."""
    from .stats import quantile  # stats builds on this module

    d, n = df, df.filter(F.col(value).isNotNull()).count()
    low, high = (quantile(df, value, q) for q in (share, 1 - share))
    d = d.withColumns({"_lo": F.lit(low).cast("double"), "_hi": F.lit(high).cast("double"), "_n": F.lit(n)})
    sizes = d.agg(F.count_if(F.col(value) >= F.col("_hi")).alias("_nh"), F.count_if(F.col(value) <= F.col("_lo")).alias("_nl"))
    d = d.crossJoin(F.broadcast(sizes))
    flag = lambda cond, size: F.when(F.col(size) <= most * F.col("_n"), cond.cast("int"))
    return d.withColumns({"top": flag(F.col(value) >= F.col("_hi"), "_nh"), "bottom": flag(F.col(value) <= F.col("_lo"), "_nl")}).drop("_lo", "_hi", "_n", "_nh", "_nl")
