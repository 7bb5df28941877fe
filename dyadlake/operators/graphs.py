"""Edge-list algebra: (a, b, w) with both directions held as rows where needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def symmetric(edges: DataFrame) -> DataFrame:
    """src, dst, w: both directions, parallel edges summed."""
    d = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))
    return d.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def normalised(edges: DataFrame) -> DataFrame:
    """D^-1/2 (A + I) D^-1/2 over the nodes that have edges."""
    s = symmetric(edges)
    loops = s.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(1.0).alias("w"))
    full = s.withColumn("w", F.col("w").cast("double")).unionByName(loops)
    deg = full.groupBy("src").agg(F.sum("w").alias("d"))
    out = full.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
    return out.select("src", "dst", (F.col("w") / F.sqrt(F.col("d") * F.col("d2"))).alias("w"))


def row_normalised(edges: DataFrame) -> DataFrame:
    """Weights over their row sum; a row that sums to zero stays zero."""
    total = F.sum("w").over(Window.partitionBy("src"))
    return edges.withColumn("w", F.coalesce(F.try_divide(F.col("w").cast("double"), total.cast("double")), F.lit(0.0)))


def edge_softmax(edges: DataFrame, score: str) -> DataFrame:
    """Softmax of ``score`` over the edges that enter each node, shifted by their maximum."""
    top = edges.groupBy("dst").agg(F.max(score).alias("_m"))
    d = edges.join(top, "dst").withColumn("_e", F.exp(F.col(score) - F.col("_m")))
    total = d.groupBy("dst").agg(F.sum("_e").alias("_t"))
    return d.join(total, "dst").withColumn("attention", F.col("_e") / F.col("_t")).drop("_m", "_e", "_t")


def scatter_mean(values: DataFrame, index: str, value: str, all_ids: DataFrame) -> DataFrame:
    """Mean per index over all ids; zero where an id has no value."""
    m = values.groupBy(index).agg(F.avg(value).alias("mean"))
    return all_ids.select(index).distinct().join(m, index, "left").select(index, F.coalesce("mean", F.lit(0.0)).alias("mean"))


def with_inverses(triples: DataFrame, n_relations: int) -> DataFrame:
    """Triples (h, r, t) and their inverses (t, r + n_relations, h), distinct."""
    return triples.select("h", "r", "t").unionByName(triples.select(F.col("t").alias("h"), (F.col("r") + n_relations).alias("r"), F.col("h").alias("t"))).distinct()


def absent_triples(triples: DataFrame, named: DataFrame, labels: DataFrame) -> DataFrame:
    """Triples that ``named`` lacks, counted by relation and by the label of their pair."""
    gone = triples.join(named.select("h", "r", "t").distinct(), ["h", "r", "t"], "left_anti").select("r", F.least("h", "t").alias("a"), F.greatest("h", "t").alias("b"))
    return gone.join(labels.select("a", "b", "label").distinct(), ["a", "b"], "left").groupBy("r", F.coalesce(F.col("label").cast("string"), F.lit("unlabelled")).alias("label")).agg(F.count("*").alias("n"))


def sample_neighbours(edges: DataFrame, n: int, salt: str = "nb") -> DataFrame:
    """At most ``n`` neighbours of each source, chosen by hash."""
    w = Window.partitionBy("src").orderBy(F.md5(F.concat_ws("|", F.lit(salt), "src", "dst")), "dst")
    return edges.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
