"""Queries on result tables, tests over folds, and the paired and dyadic bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pairs import uniform_of
from ..operators import metrics as M
from ..operators import pairs as P
from ..operators import replicates as R
from ..operators import solvers as L
from ..operators import stats as S
from ..operators import tables as T
from ..operators import vectors as X
from ..operators.lineage import settle
from .base import EV, LAB, evidence, labelled, read_table, sql_hash
from .metric_plans import _AB, _DIM, FOLDS, LANG, RATED, fold_table, rated, two_runs

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _rounded(df, keys, values, digits=8):
    return df.select(*keys, *[F.round(v, digits).alias(v) for v in values])


@query(f"""WITH {FOLDS}, m AS (SELECT model, task, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM ft GROUP BY model, task)
SELECT model, task, n, round(mean, 8) AS mean, round(mean - {T.student_quantile(0.975, 5)!r} * sd / sqrt(n), 8) AS low, round(mean + {T.student_quantile(0.975, 5)!r} * sd / sqrt(n), 8) AS high FROM m""")
def tier_intervals(spark, sf):
    return _rounded(T.t_interval(fold_table(spark, sf), ["model", "task"], "value"), ["model", "task", "n"], ["mean", "low", "high"])


@query(f"""WITH {_AB}, m AS (SELECT task, count(d) AS n, avg(d) AS mean, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t, count(*) FILTER (d > 0) AS wins FROM ab GROUP BY task),
g AS (SELECT *, atan(abs(t) / sqrt(5.0)) AS th FROM m)
SELECT task, n, round(mean, 9) AS mean, round(t, 6) AS t, round(1 - 2 / pi() * (th + sin(th) * (cos(th) + 2.0 / 3 * cos(th) ^ 3)), 8) AS p, wins FROM g""")
def fold_t_test(spark, sf):
    d = T.fold_t_test(two_runs(spark, sf), ["task"], "d")
    return d.select("task", "n", F.round("mean", 9).alias("mean"), F.round("t", 6).alias("t"), F.round("p", 8).alias("p"), "wins")


@query(f"WITH {FOLDS} SELECT x.task, x.model AS first, y.model AS second, round(avg(x.value - y.value), 9) AS delta, count(*) AS n FROM ft x JOIN ft y ON x.task = y.task AND x.fold = y.fold AND x.model < y.model GROUP BY ALL")
def model_contrasts(spark, sf):
    return T.contrasts(fold_table(spark, sf), "model", ["task"], "fold", "value").select("task", "first", "second", F.round("delta", 9).alias("delta"), "n")


@query(f"""WITH {FOLDS}, m AS (SELECT task, model, round(avg(value), 6) AS v FROM ft GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY v DESC) AS rk FROM m)
SELECT task, model, v, rk AS rank, round(v - (SELECT max(o.v) FROM m o WHERE o.task = r.task AND o.model <> r.model), 6) AS margin FROM r""")
def ranks_and_margins(spark, sf):
    m = fold_table(spark, sf).groupBy("task", "model").agg(F.round(F.avg("value"), 6).alias("v"))
    return T.ranked(m, ["task"], "v").select("task", "model", "v", "rank", "margin")


_CELLS = "fc AS (SELECT l_returnflag AS task, (l_partkey % 6)::INT AS fold, l_linestatus = 'F' AS x, l_quantity > 25 AS y, avg(l_discount) AS value FROM lineitem WHERE l_returnflag <> 'N' OR l_linestatus = 'O' GROUP BY ALL)"


@query(f"""WITH {_CELLS}, p AS (SELECT task, fold, max(value) FILTER (NOT x AND NOT y) AS c00, max(value) FILTER (NOT x AND y) AS c01, max(value) FILTER (x AND NOT y) AS c10, max(value) FILTER (x AND y) AS c11 FROM fc GROUP BY task, fold)
SELECT task, count(c11 - c10 - c01 + c00) AS n, round(avg((c10 - c00 + c11 - c01) / 2), 9) AS effect_x, round(avg((c01 - c00 + c11 - c10) / 2), 9) AS effect_y, round(avg(c11 - c10 - c01 + c00), 9) AS interaction FROM p GROUP BY task""")
def factorial_effects(spark, sf):
    l = read_table(spark, sf, "lineitem").filter("l_returnflag <> 'N' or l_linestatus = 'O'")
    c = l.groupBy(F.col("l_returnflag").alias("task"), (F.col("l_partkey") % 6).cast("int").alias("fold"), (F.col("l_linestatus") == "F").alias("x"), (F.col("l_quantity") > 25).alias("y")).agg(F.avg("l_discount").alias("value"))
    return _rounded(T.factorial_effects(c, "fold", "x", "y", "value", ["task"]), ["task", "n"], ["effect_x", "effect_y", "interaction"], 9)


@query(f"WITH {FOLDS}, m AS (SELECT model, task, avg(value) AS mean FROM ft GROUP BY ALL) SELECT m.model, m.task, round(m.mean, 9) AS mean, round(r.mean - m.mean, 9) AS \"drop\" FROM m JOIN m r ON r.model = m.model AND r.task = 'N' AND m.task <> 'N'")
def split_drops(spark, sf):
    return _rounded(T.drop_differences(fold_table(spark, sf), ["model"], "task", "value", "N"), ["model", "task"], ["mean", "drop"], 9)


_PICK = f"{FOLDS}, pk AS (SELECT task, fold, model FROM (SELECT *, row_number() OVER (PARTITION BY task, fold ORDER BY value DESC, model) AS rn FROM ft) WHERE rn = 1)"


def picks(spark, sf):
    from ..operators.views import best_per_fold

    return best_per_fold(fold_table(spark, sf), "fold", "task", "value", "model").select("task", "fold", "model")


@query(f"WITH {_PICK} SELECT task, model, count(*) AS n_folds FROM pk GROUP BY task, model")
def pick_counts(spark, sf):
    return T.pick_counts(picks(spark, sf), ["task"], "model")


@query(f"WITH {_PICK}, f AS (SELECT task, model, min(fold) AS o, count(*) AS n FROM pk GROUP BY task, model) SELECT task, sum(n)::BIGINT AS n_folds, string_agg(model, '/' ORDER BY o) AS picks FROM f GROUP BY task")
def selection_winners(spark, sf):
    return T.winners(picks(spark, sf), "task", "fold", "model")


@query("""WITH r AS (SELECT DISTINCT s_name AS model, (s_nationkey % 4)::VARCHAR || '|' || (s_suppkey % 3)::VARCHAR AS stamp FROM supplier), g AS (SELECT stamp, string_agg(model, ',' ORDER BY model) AS models, count(*) AS n FROM r GROUP BY stamp)
SELECT stamp, models, n, (SELECT count(*) FROM g) = 1 AS alone FROM g""")
def provenance_groups(spark, sf):
    s = read_table(spark, sf, "supplier").select(F.col("s_name").alias("model"), (F.col("s_nationkey") % 4).alias("x"), (F.col("s_suppkey") % 3).alias("y"))
    return T.fingerprint_groups(s, "model", ["x", "y"])


@query("""WITH c AS (SELECT o_orderkey AS id, o_orderstatus AS e_status, o_orderpriority AS e_prio, CASE WHEN o_orderkey % 5 = 0 THEN 'P' ELSE o_orderstatus END AS f_status, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS f_prio FROM orders)
SELECT id, 'status' AS field, e_status AS expected, f_status AS found FROM c WHERE e_status IS DISTINCT FROM f_status UNION ALL SELECT id, 'priority', e_prio, f_prio FROM c WHERE e_prio IS DISTINCT FROM f_prio""")
def config_deviations(spark, sf):
    o = read_table(spark, sf, "orders")
    pairs = lambda status, prio: F.create_map(F.lit("status"), status, F.lit("priority"), prio, F.lit("date"), F.col("o_orderdate").cast("string"))
    expected = pairs(F.col("o_orderstatus"), F.col("o_orderpriority"))
    found = pairs(F.when(F.col("o_orderkey") % 5 == 0, "P").otherwise(F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
    d = o.select(F.col("o_orderkey").alias("id"), expected.alias("l"), found.alias("r"))
    return T.map_differences(d, ["id"], "l", "r", ["date"])


@query(f"WITH {FOLDS} SELECT model, task, count(*) FILTER (value < 0.0502) AS n_scored, 6 AS n_expected FROM ft GROUP BY model, task HAVING count(*) FILTER (value < 0.0502) < 6")
def partial_runs(spark, sf):
    d = fold_table(spark, sf).withColumn("value", F.when(F.col("value") < 0.0502, F.col("value")))
    return T.partial_runs(d, ["model", "task"], "value", 6)


@query("""WITH r AS (SELECT c_mktsegment AS cv, (c_nationkey % 2)::INT AS metric, c_acctbal AS value, c_name AS path FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_nationkey % 2 = 0), o AS (SELECT cv FROM r GROUP BY cv HAVING count(DISTINCT CASE WHEN cv = 'BUILDING' OR cv = 'MACHINERY' THEN metric ELSE 0 END) = 1),
w AS (SELECT r.*, row_number() OVER (PARTITION BY r.cv ORDER BY value DESC, path) AS rn FROM r JOIN o ON o.cv = r.cv) SELECT cv, value, path FROM w WHERE rn = 1""")
def best_runs(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_mktsegment").alias("cv"), (F.col("c_nationkey") % 2).alias("metric"), F.col("c_acctbal").alias("value"), F.col("c_name").alias("path")).filter("cv <> 'BUILDING' or metric = 0")
    c = c.withColumn("metric", F.when(F.col("cv").isin("BUILDING", "MACHINERY"), F.col("metric")).otherwise(0))
    return T.best_runs(c, "cv", "metric", "value", "path").select("cv", "value", "path")


@query(f"WITH {FOLDS}, n AS (SELECT DISTINCT model, CASE model WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END AS k FROM ft) SELECT model, row_number() OVER (ORDER BY k, model) - 1 AS place FROM n")
def display_order(spark, sf):
    return T.in_order(fold_table(spark, sf), "model", ["3-MEDIUM", "1-URGENT"]).select("model", "place").distinct()


@query(f"WITH {_DIM}, g AS (SELECT avg(x) AS m, stddev_samp(x) AS s FROM dm) SELECT vec_id, round(sum((x - m) / s), 5) AS total, round(max((x - m) / s), 6) AS top FROM dm, g GROUP BY vec_id")
def global_normalised(spark, sf):
    e = read_table(spark, sf, "embeddings")
    z = X.normalise(e, "embedding", *X.global_scalars(e, "embedding"))
    return z.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.array_max("embedding"), 6).alias("top"))


@query(f"WITH {_DIM}, q AS (SELECT quantile_cont(x, 0.5) AS m FROM dm), a AS (SELECT 1.4826 * quantile_cont(abs(x - m), 0.5) AS s FROM dm, q) SELECT vec_id, round(sum((x - m) / s), 5) AS total FROM dm, q, a GROUP BY vec_id")
def global_robust(spark, sf):
    e = read_table(spark, sf, "embeddings")
    z = X.normalise(e, "embedding", *X.global_scalars(e, "embedding", robust=True))
    return z.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


# the same least squares in SQL: conjugate gradients unrolled, far beyond what the digits shown need
_ROUNDS = 40
_STEP = "c{0} AS MATERIALIZED (SELECT n.*, d * p + s AS q FROM n{0} n JOIN (SELECT en.id, sum(o.p) AS s FROM en JOIN n{0} o ON o.id = en.other GROUP BY en.id) t ON t.id = n.id), \
k{0} AS MATERIALIZED (SELECT sum(r * r / d) AS rz, coalesce(sum(r * r / d) / nullif(sum(p * q), 0), 0) AS al FROM c{0}), \
m{0} AS MATERIALIZED (SELECT c.*, x + al * p AS x2, r - al * q AS r2 FROM c{0} c, k{0}), \
b{0} AS MATERIALIZED (SELECT coalesce(sum(r2 * r2 / d) / nullif((SELECT rz FROM k{0}), 0), 0) AS be FROM m{0}), \
n{1} AS MATERIALIZED (SELECT id, d, x2 AS x, r2 AS r, r2 / d + be * p AS p FROM m{0}, b{0})"


@query(f"""WITH {EV}, pm AS MATERIALIZED (SELECT a, b, avg(x) AS v FROM ev GROUP BY a, b), en AS MATERIALIZED (SELECT a AS id, b AS other, v FROM pm UNION ALL SELECT b, a, v FROM pm),
n0 AS MATERIALIZED (SELECT id, count(*)::DOUBLE AS d, 0.0::DOUBLE AS x, sum(v) AS r, sum(v) / count(*) AS p FROM en GROUP BY id), {", ".join(_STEP.format(k, k + 1) for k in range(_ROUNDS))},
f AS (SELECT v, x.x + y.x AS fit, avg(v) OVER () AS m FROM pm JOIN n{_ROUNDS} x ON x.id = pm.a JOIN n{_ROUNDS} y ON y.id = pm.b)
SELECT count(*) AS n, (SELECT count(*) FROM n0) AS n_ids, round(1 - sum((v - fit) ^ 2) / sum((v - m) ^ 2), 8) AS r2 FROM f""")
def additive_fit(spark, sf):
    d = settle(P.mean_of_duplicates(evidence(spark, sf), "x"), "means")
    return L.additive_r2(d, "target").select("n", "n_ids", F.round("r2", 8).alias("r2"))


# three models over the rated documents, resampled together; both classes keep their sizes
REPS = 1000
METRICS = ["auroc", "ap", "f1_max", "auprg"]


def models(spark, sf):
    d = rated(spark, sf)
    scores = F.array(F.struct(F.lit("length").alias("model"), F.col("score").alias("s")), F.struct(F.lit("short").alias("model"), (-F.floor(F.col("n_chars") / 300)).cast("double").alias("s")), F.struct(F.lit("random").alias("model"), F.round(uniform_of(F.col("doc_id"), "m"), 2).alias("s")))
    return d.select("doc_id", "label", F.explode(scores).alias("m")).select("doc_id", "label", "m.model", F.col("m.s").alias("score"))


def replicates(spark, sf):
    d = R.resampled(models(spark, sf), "doc_id", REPS, ["label"])
    return R.curve_replicates(d, ["model"], REPS)


_LABEL = """'{"label":' || coalesce(label::VARCHAR, 'null') || '}'"""
_REPS = f"""{RATED}, mo AS (SELECT doc_id, label, 'length' AS model, score FROM ra UNION ALL SELECT doc_id, label, 'short', -floor(n_chars / 300) FROM ra UNION ALL SELECT doc_id, label, 'random', round({sql_hash('doc_id::VARCHAR', 'm')} / 4294967296.0, 2) FROM ra),
un AS (SELECT doc_id AS unit, label FROM ra), {R.sql_multiplicities("ws", "un", REPS, stratum=_LABEL)},
wt AS (SELECT DISTINCT ra.doc_id, rep, w FROM ra JOIN ws ON ws.unit = ra.doc_id::VARCHAR AND ws.stratum = {_LABEL}),
sg AS (SELECT model, rep, score, sum(w * label) AS p, sum(w * (1 - label)) AS n FROM mo JOIN wt ON wt.doc_id = mo.doc_id WHERE w > 0 GROUP BY ALL),
cu AS (SELECT *, sum(p) OVER (PARTITION BY model, rep ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp, sum(n) OVER (PARTITION BY model, rep ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn, sum(p) OVER (PARTITION BY model, rep) AS np, sum(n) OVER (PARTITION BY model, rep) AS nn FROM sg),
q AS (SELECT *, cp / (cp + cn)::DOUBLE AS pr, cp / np::DOUBLE AS re, (cp - p)::DOUBLE AS t0, (cn - n)::DOUBLE AS f0, cp::DOUBLE AS t1, cn::DOUBLE AS f1, np::DOUBLE * np / (np + nn) AS z FROM cu),
r AS (SELECT *, CASE WHEN t0 < z AND z < t1 THEN z WHEN t0 >= z THEN t0 END AS ta, CASE WHEN t0 < z AND z < t1 THEN f0 + (z - t0) * (f1 - f0) / (t1 - t0) WHEN t0 >= z THEN f0 END AS fa FROM q),
g AS (SELECT *, 1 - np * (np - ta) / (nn * ta) AS ra_, CASE WHEN ta = np AND fa = nn THEN 0 ELSE 1 - np * fa / (nn * ta) END AS ga, 1 - np * (np - t1) / (nn * nullif(t1, 0)) AS rb, CASE WHEN t1 = np AND f1 = nn THEN 0 ELSE 1 - np * f1 / (nn * nullif(t1, 0)) END AS gb FROM r),
rp AS (SELECT model, rep, sum(p * (nn - cn + n / 2.0) / (np * nn)) AS auroc, sum(p / np::DOUBLE * pr) AS ap, max(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) END) AS f1_max, sum(CASE WHEN ta IS NOT NULL AND t1 >= z THEN (rb - ra_) * (gb + ga) / 2 ELSE 0 END) AS auprg FROM g GROUP BY model, rep)"""


def _long(columns: list[str]):
    return F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in columns])).alias("m")


_LONG = " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS v FROM {{}}" for m in METRICS)
_CI = "round(avg(v), 7) AS mean, round(stddev_samp(v), 7) AS se, round(quantile_cont(v, 0.025), 7) AS low, round(quantile_cont(v, 0.975), 7) AS high, count(v) AS n_finite"


@query(f"WITH {_REPS}, lo AS ({_LONG.format(*['rp'] * 4)}) SELECT model, metric, {_CI} FROM lo GROUP BY model, metric")
def bootstrap_metrics(spark, sf):
    d = replicates(spark, sf).select("model", _long(METRICS)).select("model", "m.metric", "m.v")
    return _rounded(S.percentile_ci(d, ["model", "metric"], "v"), ["model", "metric", "n_finite"], ["mean", "se", "low", "high"], 7)


_DIFF = ", ".join(f"x.{m} - y.{m} AS {m}" for m in METRICS)


@query(f"WITH {_REPS}, df AS (SELECT x.model, x.rep, {_DIFF} FROM rp x JOIN rp y ON y.rep = x.rep AND y.model = 'length' AND x.model <> 'length'), lo AS ({_LONG.format(*['df'] * 4)}) SELECT model, metric, {_CI}, round(avg((v <= 0)::INT), 7) AS share_le0 FROM lo GROUP BY model, metric")
def bootstrap_differences(spark, sf):
    d = S.replicate_differences(replicates(spark, sf), "model", "length", [], METRICS).select("model", _long(METRICS)).select("model", "m.metric", "m.v")
    return _rounded(S.percentile_ci(d, ["model", "metric"], "v"), ["model", "metric", "n_finite"], ["mean", "se", "low", "high", "share_le0"], 7)


@query(f"""WITH {RATED}, un AS (SELECT doc_id AS unit, lang FROM ra), {R.sql_multiplicities("wt", "un", REPS, stratum=LANG)},
bw AS (SELECT lang, n_chars AS x, label + toxic AS y, rep, w FROM ra JOIN wt ON wt.unit = ra.doc_id::VARCHAR AND wt.stratum = {LANG}),
k AS (SELECT * FROM bw WHERE w > 0),
rx AS (SELECT *, sum(w) OVER (PARTITION BY lang, rep ORDER BY x RANGE UNBOUNDED PRECEDING) - sum(w) OVER (PARTITION BY lang, rep, x) + (sum(w) OVER (PARTITION BY lang, rep, x) + 1) / 2.0 AS a, sum(w) OVER (PARTITION BY lang, rep ORDER BY y RANGE UNBOUNDED PRECEDING) - sum(w) OVER (PARTITION BY lang, rep, y) + (sum(w) OVER (PARTITION BY lang, rep, y) + 1) / 2.0 AS b FROM k),
m AS (SELECT *, sum(w * a) OVER (PARTITION BY lang, rep) / sum(w) OVER (PARTITION BY lang, rep) AS ma, sum(w * b) OVER (PARTITION BY lang, rep) / sum(w) OVER (PARTITION BY lang, rep) AS mb FROM rx),
c AS (SELECT lang, rep, sum(w * (a - ma) * (b - mb)) AS xy, sum(w * (a - ma) ^ 2) AS xx, sum(w * (b - mb) ^ 2) AS yy, sum(w) AS n FROM m GROUP BY lang, rep),
v AS (SELECT lang, CASE WHEN n >= 3 AND xx > 1e-12 AND yy > 1e-12 THEN xy / sqrt(xx * yy) END AS v FROM c) SELECT lang, {_CI} FROM v GROUP BY lang""")
def bootstrap_spearman(spark, sf):
    d = rated(spark, sf).withColumn("y", F.col("label") + F.col("toxic"))
    r = R.spearman_replicates(R.resampled(d, "doc_id", REPS, ["lang"]), ["lang"], "n_chars", "y", REPS)
    return _rounded(S.percentile_ci(r, ["lang"], "r"), ["lang", "n_finite"], ["mean", "se", "low", "high"], 7)


@query(f"""WITH {LAB}, d AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM lab UNION ALL SELECT b FROM lab) GROUP BY id),
un AS (SELECT id AS unit FROM d), {R.sql_multiplicities("mu", "un", REPS, "dyad")},
mi AS (SELECT unit::BIGINT AS id, rep, w FROM mu),
s AS (SELECT p.rep AS rep, round(ln(1 + x.degree) + ln(1 + y.degree), 9) AS score, sum(p.w * q.w * label) AS p, sum(p.w * q.w * (1 - label)) AS n FROM lab JOIN d x ON x.id = lab.a JOIN d y ON y.id = lab.b JOIN mi p ON p.id = lab.a JOIN mi q ON q.id = lab.b AND q.rep = p.rep GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY rep ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn, sum(p) OVER (PARTITION BY rep) AS np, sum(n) OVER (PARTITION BY rep) AS nn FROM s)
SELECT rep::INT AS rep, max(np)::BIGINT AS n_pos, max(nn)::BIGINT AS n_neg, round(sum(p * (nn - cn + n / 2.0) / (np::DOUBLE * nn)), 8) AS auroc FROM c GROUP BY rep""")
def dyadic_bootstrap(spark, sf):
    p = labelled(spark, sf)
    d = settle(P.degree_scores(p, p).withColumn("score", F.round("score", 9)), "scored-pairs")
    ids = d.select(F.explode(F.array("a", "b")).alias("id"))
    d = R.pair_multiplicities(d, R.multiplicities(ids, "id", REPS, salt="dyad"))
    m = R.curve_replicates(d, [], REPS, vectors=("ma", "mb"))
    return m.select("rep", "n_pos", "n_neg", F.round("auroc", 8).alias("auroc"))
