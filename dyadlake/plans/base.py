"""The pair relation that the queries share, from the star schema's tables.

Parts that stand in one order form a pair. Each of its two lines asserts the pair: positive
where it was returned (flag R), else negative; the order's priority is the context.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pairs import bucket_of, normal_token, pair_key
from ..operators import pairs as P
from ..sources.tables import read_table

HEADS = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}
OTHER, N_HEADS, K = 3, 4, 5
ALIASES = {"4-NOT SPECI": "4-NOT SPECIFIED"}
JUNK = ["", "N/A", "NONE"]


def cooccurrences(spark: SparkSession, sf: str) -> DataFrame:
    return P.cooccurring(read_table(spark, sf, "lineitem"), "l_orderkey", "l_partkey", "l_returnflag", "l_extendedprice", "l_linestatus")


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """a, b, positive, x, status, ctx, o: two rows per co-occurrence."""
    co = cooccurrences(spark, sf).join(read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    sides = F.array(*[F.struct((F.col(f"l_returnflag{i}") == "R").alias("positive"), F.col(f"l_extendedprice{i}").alias("x"), F.col(f"l_linestatus{i}").alias("status")) for i in (1, 2)])
    return co.select("a", "b", F.explode(sides).alias("s"), normal_token("o_orderpriority", ALIASES, JUNK).alias("ctx"), F.col("l_orderkey").alias("o")).select("a", "b", "s.*", "ctx", "o")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """a, b, label: 1 if any line asserts the pair positive. Both lines of a co-occurrence count in its one row."""
    co = cooccurrences(spark, sf).join(read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    positive = [(F.col(f"l_returnflag{i}") == "R").cast("int") for i in (1, 2)]
    return co.groupBy("a", "b").agg(F.max(F.greatest(*positive)).alias("label"))


def folded(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).withColumn("fold", bucket_of(pair_key("a", "b"), K, "cv1"))


#: The same relation for the SQL side.
CO = """co AS (SELECT l.l_partkey AS a, r.l_partkey AS b, l.l_returnflag AS f1, r.l_returnflag AS f2, l.l_extendedprice AS x1,
  r.l_extendedprice AS x2, l.l_linestatus AS s1, r.l_linestatus AS s2, l.l_orderkey AS o
  FROM lineitem l JOIN lineitem r ON l.l_orderkey = r.l_orderkey AND l.l_partkey < r.l_partkey)"""
EV = (
    CO
    + """, ev AS (SELECT a, b, f1 = 'R' AS positive, x1 AS x, s1 AS status, upper(trim(o_orderpriority)) AS ctx, o FROM co JOIN orders ON o = o_orderkey
  UNION ALL SELECT a, b, f2 = 'R', x2, s2, upper(trim(o_orderpriority)), o FROM co JOIN orders ON o = o_orderkey)"""
)
LAB = EV + ", lab AS (SELECT a, b, max(positive::INT) AS label FROM ev GROUP BY a, b)"


def sql_key(a: str = "a", b: str = "b") -> str:
    return f"(least({a}::VARCHAR, {b}::VARCHAR) || '|' || greatest({a}::VARCHAR, {b}::VARCHAR))"


def sql_hash(key: str, salt: str) -> str:
    return f"('0x' || substr(md5('{salt}' || {key}), 1, 8))::BIGINT"


FOLD = LAB + f", fo AS (SELECT *, ({sql_hash(sql_key(), 'cv1')} % {K})::INT AS fold FROM lab)"
