"""Distance correlation in n log n: dominance sums by merging ranges, instead of all n x n distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settle
from .metrics import running

#: Rows of the levels that are taken together; one level at least.
LEVEL_ROWS = 20_000_000


def _positions(df: DataFrame, keys: list[str], x: str, own: str, rank: str) -> DataFrame:
    """Adds ``own``, the sum of distances of each value of ``x`` to all rows, and ``rank``, its dense rank from 0."""
    ties = df.groupBy(*keys, x).agg(F.count("*").alias("_c")).withColumns({"_cx": F.col("_c") * F.col(x), "_one": F.lit(1), "_down": -F.col(x)})
    t = running(ties, keys, "_down", ["_c", "_cx", "_one"])  # running sums are by descending order: ascending x
    whole = ties.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.sum("_cx").alias("_s"))
    t = t.join(whole, keys)
    below, beneath = F.col("cum__c"), F.col("cum__cx")
    far = F.col(x) * (2 * below - F.col("_n")) - 2 * beneath + F.col("_s")
    return df.join(t.select(*keys, x, far.alias(own), (F.col("cum__one") - 1).alias(rank)), [*keys, x])


def distance_correlation(df: DataFrame, keys: list[str], x: str, y: str, floor: float = 0.0) -> DataFrame:
    """keys, n, dcov2, dvar2_x, dvar2_y (squared, divisor n**2) and dcor of two columns, per group.

    The sum over pairs of |xi - xj| |yi - yj| is 4 D - 2 (n Sxy - Sx Sy), where D sums (xi - xj)(yi - yj) over
    pairs with xj < xi and yj < yi. D is found by halving the ranks of x: at each of the log n levels a
    pair whose ranks part there has its lower one in the left half, and running sums of the left half by y meet
    the right half. A level's rows are summed by (half, y) first, so ties are one row, and running sums are
    over ranges: no task holds a group. Levels are taken together up to ``LEVEL_ROWS`` rows, then one after another,
    so that the disk holds these and not log n times the table. Sums of distances of a row, and of squares, come from one sort.

    ``floor`` is added under each root, as implementations that take roots of it for training do. Rows with a
    null or non-finite value are left out. Null dcor where a side does not vary (unless floor > 0).
    """
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    if not keys:
        return distance_correlation(df.withColumn("_k", F.lit(1)), ["_k"], x, y, floor).drop("_k")
    d = df.filter(ok(x) & ok(y)).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    mean = d.groupBy(*keys).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    d = d.join(mean, keys).select(*keys, (F.col("x") - F.col("_mx")).alias("x"), (F.col("y") - F.col("_my")).alias("y"))
    d = settle(d, "distances")
    d = settle(_positions(_positions(d, keys, "x", "ax", "rx"), keys, "y", "ay", "ry"), "distances")
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum("ax").alias("ax"), F.sum("ay").alias("ay"), F.sum(F.col("ax") * F.col("ay")).alias("axy"), F.sum(F.col("ax") * F.col("ax")).alias("axx"), F.sum(F.col("ay") * F.col("ay")).alias("ayy"), F.max("rx").alias("top"))
    s = settle(s, "distances")
    levels = int(s.agg(F.max("top")).first()[0] or 0).bit_length()
    if levels:
        rows = s.agg(F.sum("n")).first()[0]
        step = max(1, min(levels, LEVEL_ROWS // max(rows, 1)))
        left = F.expr("shiftright(rx, level) % 2 = 0")
        side = lambda c, take: F.sum(F.when(take, c).otherwise(0.0))
        xy, group = F.col("x") * F.col("y"), [*keys, "level", "node"]
        found = None
        for low in range(0, levels, step):
            at = d.select(*keys, "x", "y", "rx", F.explode(F.array(*[F.lit(i) for i in range(low, min(low + step, levels))])).alias("level"))
            halves = at.groupBy(*keys, "level", F.expr("shiftright(rx, level + 1)").alias("node"), "y").agg(*[side(c, left).alias(f"l{n}") for n, c in (("n", F.lit(1.0)), ("x", F.col("x")), ("p", xy))], *[side(c, ~left).alias(f"r{n}") for n, c in (("n", F.lit(1.0)), ("x", F.col("x")), ("p", xy))])
            halves = settle(halves.withColumns({"_down": -F.col("y"), "ly": F.col("ln") * F.col("y"), "ry": F.col("rn") * F.col("y")}), "halves")
            run = running(halves, group, "_down", ["ln", "lx", "ly", "lp"])
            under = {c: F.col(f"cum_l{c}") - F.col(f"l{c}") for c in "nxyp"}  # strictly smaller y
            pairs = F.col("rp") * under["n"] - F.col("rx") * under["y"] - F.col("ry") * under["x"] + F.col("rn") * under["p"]
            part = settle(run.groupBy(*keys).agg(F.sum(pairs).alias("dominance")), "dominance", halves)
            found = part if found is None else found.unionByName(part)
        dominance = found.groupBy(*keys).agg(F.sum("dominance").alias("dominance"))
        s = s.join(dominance, keys, "left")
    else:
        s = s.withColumn("dominance", F.lit(0.0))
    n = F.col("n").cast("double")
    cross = 4 * F.coalesce("dominance", F.lit(0.0)) - 2 * (n * F.col("sxy") - F.col("sx") * F.col("sy"))
    square = lambda c: 2 * n * F.col(f"s{c}{c}") - 2 * F.col(f"s{c}") * F.col(f"s{c}")
    centred = lambda total, rows, a, b: total / (n * n) - 2 * rows / (n * n * n) + a * b / (n * n * n * n)
    out = s.select(*keys, "n", centred(cross, F.col("axy"), F.col("ax"), F.col("ay")).alias("dcov2"), centred(square("x"), F.col("axx"), F.col("ax"), F.col("ax")).alias("dvar2_x"), centred(square("y"), F.col("ayy"), F.col("ay"), F.col("ay")).alias("dvar2_y"))
    root = lambda c: F.sqrt(F.greatest(F.col(c), F.lit(0.0)) + floor)
    varies = (F.col("dvar2_x") > 1e-14) & (F.col("dvar2_y") > 1e-14) if not floor else F.lit(True)
    return out.withColumn("dcor", F.when(varies, root("dcov2") / F.sqrt(root("dvar2_x") * root("dvar2_y") + floor)))
