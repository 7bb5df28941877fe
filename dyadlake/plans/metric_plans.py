"""Queries on classification metrics, ranking, statistics, vectors and fold views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pairs as C
from ..operators import metrics as M
from ..operators import neighbours as N
from ..operators import pairs as P
from ..operators import ranking as K
from ..operators import replicates as R
from ..operators import stats as S
from ..operators import vectors as X
from ..operators import views as W
from ..operators.lineage import settle
from ..sources.tables import read_table
from .base import LAB, labelled, sql_hash

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rated(spark, sf):
    """doc_id, lang, label (quality), toxic, score: words-per-length score of rated documents."""
    d = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", "lang", "source", F.col("quality").alias("label"), "toxic", F.round(F.log1p(F.floor(F.col("n_chars") / 100)), 9).alias("score"), "n_chars")


RATED = "ra AS (SELECT doc_id, lang, source, quality AS label, toxic, round(ln(1 + floor(n_chars / 100)), 9) AS score, n_chars FROM documents JOIN labels USING (doc_id))"
CURVE = (
    RATED
    + """, sg AS (SELECT lang, score, sum(label) AS p, sum(1 - label) AS n FROM ra GROUP BY ALL),
cu AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY lang) AS np, sum(n) OVER (PARTITION BY lang) AS nn FROM sg WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
pt AS (SELECT *, cp / (cp + cn) AS pr, cp / np AS re, coalesce(lag(cp / (cp + cn)) OVER w, 1) AS pr0, coalesce(lag(cp / np) OVER w, 0) AS re0 FROM cu WINDOW w AS (PARTITION BY lang ORDER BY score DESC))"""
)


@query(f"""WITH {CURVE} SELECT lang, max(np)::BIGINT AS n_pos, max(nn)::BIGINT AS n_neg, round(sum(p * (nn - cn + n / 2.0) / (np * nn)), 8) AS auroc, round(sum(p / np * pr), 8) AS ap,
round(sum((re - re0) * (pr + pr0) / 2), 8) AS aupr, round(max(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) END), 8) AS f1_max FROM pt GROUP BY lang""")
def classification_by_lang(spark, sf):
    m = M.curve_metrics(M.segments(rated(spark, sf), ["lang"]), ["lang"])
    return m.select("lang", "n_pos", "n_neg", *[F.round(c, 8).alias(c) for c in ("auroc", "ap", "aupr", "f1_max")])


@query(f"""WITH {CURVE}, m AS (SELECT lang, sum((re - re0) * (pr + pr0) / 2) AS aupr, max(np) / (max(np) + max(nn)) AS pi FROM pt GROUP BY lang) SELECT lang, round(pi, 8) AS prevalence, round((aupr - pi) / (1 - pi), 8) AS normalized_aupr FROM m""")
def prevalence_skill(spark, sf):
    m = M.curve_metrics(M.segments(rated(spark, sf), ["lang"]), ["lang"])
    return m.select("lang", F.round("prevalence", 8).alias("prevalence"), F.round("normalized_aupr", 8).alias("normalized_aupr"))


@query(f"""WITH {CURVE}, q AS (SELECT lang, score, np AS pp, nn, (cp - p)::DOUBLE AS t0, (cn - n)::DOUBLE AS f0, cp::DOUBLE AS t1, cn::DOUBLE AS f1, np::DOUBLE * np / (np + nn) AS z FROM cu),
r AS (SELECT *, t0 < z AND z < t1 AS cross_, CASE WHEN t0 < z AND z < t1 THEN z WHEN t0 >= z THEN t0 END AS ta, CASE WHEN t0 < z AND z < t1 THEN f0 + (z - t0) * (f1 - f0) / (t1 - t0) WHEN t0 >= z THEN f0 END AS fa FROM q),
g AS (SELECT lang, 1 - pp * (pp - ta) / (nn * ta) AS ra_, CASE WHEN ta = pp AND fa = nn THEN 0 ELSE 1 - pp * fa / (nn * ta) END AS ga, 1 - pp * (pp - t1) / (nn * nullif(t1, 0)) AS rb, CASE WHEN t1 = pp AND f1 = nn THEN 0 ELSE 1 - pp * f1 / (nn * nullif(t1, 0)) END AS gb, ta, t1, z FROM r)
SELECT lang, round(sum(CASE WHEN ta IS NOT NULL AND t1 >= z THEN (rb - ra_) * (gb + ga) / 2 ELSE 0 END), 8) AS auprg FROM g GROUP BY lang""")
def precision_recall_gain(spark, sf):
    return M.auprg(M.segments(rated(spark, sf), ["lang"]), ["lang"]).select("lang", F.round("auprg", 8).alias("auprg"))


_AU = lambda rows, key: f"(SELECT {key}, (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label)::DOUBLE * sum(1 - label), 0) AS auroc, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY score) + (count(*) OVER (PARTITION BY {key}, score) - 1) / 2.0 AS r FROM {rows}) GROUP BY {key})"


@query(f"""WITH {RATED}, ce AS (SELECT 1 AS g, doc_id, 'quality' AS head, label, score FROM ra UNION ALL SELECT 1, doc_id, 'clean', 1 - toxic, -score FROM ra),
an AS (SELECT 1 AS g, doc_id, max(label) AS label, max(score) AS score FROM ce GROUP BY doc_id)
SELECT 'stratified' AS view, round(auroc, 8) AS auroc, n FROM {_AU('ce', 'g')} UNION ALL SELECT 'any', round(auroc, 8), n FROM {_AU('an', 'g')} UNION ALL SELECT 'macro', round(avg(auroc), 8), count(auroc) FROM {_AU('ce', 'head')}""")
def multilabel_views(spark, sf):
    d = rated(spark, sf)
    cells = d.select("doc_id", F.lit("quality").alias("head"), "label", "score").unionByName(d.select("doc_id", F.lit("clean").alias("head"), (1 - F.col("toxic")).alias("label"), (-F.col("score")).alias("score")))
    return M.views(cells, [], ["doc_id"], "head").select("view", F.round("auroc", 8).alias("auroc"), "n")


@query("""WITH v AS (SELECT o_orderkey AS id, o_totalprice AS x FROM orders), q AS (SELECT quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi, count(x) AS n FROM v),
s AS (SELECT count(*) FILTER (x >= hi) AS nh, count(*) FILTER (x <= lo) AS nl FROM v, q) SELECT id, CASE WHEN nh <= 0.02 * n THEN (x >= hi)::INT END AS top, CASE WHEN nl <= 0.02 * n THEN (x <= lo)::INT END AS bottom FROM v, q, s""")
def tail_flags(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"))
    return M.tail_flags(o, "x").select("id", "top", "bottom")


# ranking: candidate pairs are co-occurring parts that have vectors; relevant: equal labels
def scored(spark, sf):
    e = read_table(spark, sf, "embeddings")
    p = labelled(spark, sf).select("a", "b")
    for x in ("a", "b"):
        p = p.join(e.select(F.col("vec_id").alias(x), F.col("embedding").alias(f"v{x}"), F.col("label").alias(f"l{x}")), x)
    return p.select("a", "b", F.round(C.cosine("va", "vb"), 6).alias("score"), (F.col("la") == F.col("lb")).cast("int").alias("rel"))


def _sum(f):
    return f"list_sum(list_transform(range(1, len(x.embedding) + 1), lambda i: {f}))"


SCORED = f"""{LAB}, pr AS (SELECT lab.a, lab.b, round({_sum('x.embedding[i]::DOUBLE * y.embedding[i]')} / sqrt({_sum('x.embedding[i]::DOUBLE * x.embedding[i]')} * {_sum('y.embedding[i]::DOUBLE * y.embedding[i]')}), 6) AS score, (x.label = y.label)::INT AS rel
FROM lab JOIN embeddings x ON x.vec_id = lab.a JOIN embeddings y ON y.vec_id = lab.b),
di AS (SELECT a AS q, b AS c, score, rel FROM pr UNION ALL SELECT b, a, score, rel FROM pr), rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM di)"""


@query(f"WITH {SCORED} SELECT q AS query, c AS candidate, score, rank FROM rk WHERE rank <= 10")
def topk_neighbours(spark, sf):
    return K.top_lists(K.both_directions(scored(spark, sf)), ["query"], 10).select("query", "candidate", "score", "rank")


@query(f"""WITH {SCORED}, rel AS (SELECT q, sum(rel) AS n FROM di GROUP BY q HAVING sum(rel) > 0), t AS (SELECT rk.*, n, sum(rel) OVER (PARTITION BY q ORDER BY rank) AS hits FROM rk JOIN rel USING (q)),
m AS (SELECT q, k, max(n) AS n, sum(rel) AS f, sum(rel / log2(rank + 1)) AS dcg, sum(rel * hits / rank) AS gain FROM t, (SELECT unnest([5, 10]) AS k) WHERE rank <= k GROUP BY q, k),
id AS (SELECT *, list_sum(list_transform(range(1, least(k, n)::BIGINT + 1), lambda i: 1 / log2(i + 1))) AS ideal, list_sum(list_transform(range(1, greatest(f, 1)::BIGINT + 1), lambda i: 1 / log2(i + 1))) AS ideal_f FROM m)
SELECT k, count(*) AS n_queries, round(avg(dcg / ideal), 8) AS ndcg, round(avg(gain / least(k, n)), 8) AS ap, round(avg(f / k), 8) AS precision, round(avg(f / n), 8) AS recall,
round(avg(CASE WHEN f > 0 THEN dcg / ideal_f ELSE 0 END), 8) AS ndcg_found, round(avg(CASE WHEN f > 0 THEN gain / f ELSE 0 END), 8) AS ap_found FROM id GROUP BY k""")
def retrieval_at_k(spark, sf):
    d = K.both_directions(scored(spark, sf))
    rel = d.groupBy("query").agg(F.sum("rel").alias("n_rel")).filter("n_rel > 0")
    m = K.macro(K.retrieval_metrics(K.top_lists(d, ["query"], 10), rel, ["query"], [5, 10]), ["k"])
    return m.select("k", "n_queries", *[F.round(c, 8).alias(c) for c in ("ndcg", "ap", "precision", "recall", "ndcg_found", "ap_found")])


@query(f"WITH {SCORED} SELECT least(q, c) AS a, greatest(q, c) AS b, max(score) AS score, count(*) AS ways FROM rk WHERE rank <= 5 AND score > 0 GROUP BY ALL")
def knn_matrix(spark, sf):
    return K.nearest(scored(spark, sf), 5, 0.0)


# exact ranking over all vectors: queries are the ids divisible by 100, pairs that stand in one order are seen
_ALL = f"""{LAB}, vq AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), ap AS (SELECT x.vec_id AS q, y.vec_id AS c, round({_sum('x.embedding[i]::DOUBLE * y.embedding[i]')} / sqrt({_sum('x.embedding[i]::DOUBLE * x.embedding[i]')} * {_sum('y.embedding[i]::DOUBLE * y.embedding[i]')}), 6) AS score, (x.label = y.label)::INT AS rel
FROM vq x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE NOT EXISTS (SELECT 1 FROM lab WHERE a = least(x.vec_id, y.vec_id) AND b = greatest(x.vec_id, y.vec_id))),
ar AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM ap)"""


def seen_pairs(spark, sf):
    """The pairs of the relation whose two ends have a vector: lines of other parts do not meet at all."""
    l = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    l = l.join(read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("l_partkey")), "l_partkey", "left_semi")
    l = settle(l.join(read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi"), "seen-lines")
    return settle(P.cooccurring(l, "l_orderkey", "l_partkey").select("a", "b").distinct(), "seen")


def nearest_unseen(spark, sf, seen):
    """(query, candidate, score, rank) over all vectors, and the blocks that were read."""
    e = read_table(spark, sf, "embeddings")
    index = N.Index(e.select("vec_id", "embedding"), "vec_id", "embedding", block=64)
    return index.search(e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("id")), 10, seen)


@query(f"WITH {_ALL} SELECT q AS query, c AS candidate, score, rank FROM ar WHERE rank <= 10")
def exact_neighbours(spark, sf):
    return nearest_unseen(spark, sf, seen_pairs(spark, sf))[0].select("query", "candidate", "score", "rank")


@query(f"""WITH {_ALL}, rel AS (SELECT q, sum(rel) AS n FROM ap GROUP BY q HAVING sum(rel) > 0), t AS (SELECT ar.*, n, sum(rel) OVER (PARTITION BY q ORDER BY rank) AS hits FROM ar JOIN rel USING (q)),
m AS (SELECT q, k, max(n) AS n, sum(rel) AS f, sum(rel / log2(rank + 1)) AS dcg, sum(rel * hits / rank) AS gain FROM t, (SELECT unnest([5, 10]) AS k) WHERE rank <= k GROUP BY q, k),
id AS (SELECT *, list_sum(list_transform(range(1, least(k, n)::BIGINT + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM m)
SELECT k, count(*) AS n_queries, round(avg(dcg / ideal), 8) AS ndcg, round(avg(gain / least(k, n)), 8) AS ap, round(avg(f / k), 8) AS precision, round(avg(f / n), 8) AS recall FROM id GROUP BY k""")
def exact_retrieval(spark, sf):
    """Retrieval metrics over all candidates: relevant are unseen vectors of the query's label."""
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    seen = seen_pairs(spark, sf)
    top = nearest_unseen(spark, sf, seen)[0]
    of = lambda x, name: e.select(F.col("id").alias(x), F.col("label").alias(name))
    top = top.join(of("query", "lq"), "query").join(of("candidate", "lc"), "candidate").withColumn("rel", (F.col("lq") == F.col("lc")).cast("int"))
    asked = e.filter("id % 100 = 0").withColumnRenamed("id", "query")
    both = K.both_directions(seen).join(asked, "query").join(of("candidate", "lc"), "candidate").filter("label = lc").groupBy("query").agg(F.count("*").alias("gone"))
    alike = asked.join(e.groupBy("label").agg((F.count("*") - 1).alias("n")), "label").join(both, "query", "left")
    rel = alike.select("query", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n_rel")).filter("n_rel > 0")
    m = K.macro(K.retrieval_metrics(top.select("query", "rank", "rel"), rel, ["query"], [5, 10]), ["k"])
    return m.select("k", "n_queries", *[F.round(c, 8).alias(c) for c in ("ndcg", "ap", "precision", "recall")])


@query()
def neighbour_blocks(spark, sf):
    """How many blocks the search above has read; depends on the blocks, so it has no SQL."""
    r = nearest_unseen(spark, sf, seen_pairs(spark, sf))[1]
    return r.agg(F.count("*").alias("packs"), F.sum("queries").alias("queries"), F.sum("blocks").alias("pairs"), F.sum("blocks_read").alias("pairs_read"), F.round(1 - F.sum("blocks_read") / F.sum("blocks"), 6).alias("share_skipped"))


_RANKS = f"{RATED}, rr AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS x, rank() OVER (PARTITION BY lang ORDER BY label + toxic) + (count(*) OVER (PARTITION BY lang, label + toxic) - 1) / 2.0 AS y FROM ra)"


@query(f"WITH {_RANKS} SELECT lang, count(*) AS n, round(corr(x, y), 8) AS r FROM rr GROUP BY lang")
def spearman_by_lang(spark, sf):
    d = rated(spark, sf).withColumn("y", F.col("label") + F.col("toxic"))
    return S.spearman(d, ["lang"], "n_chars", "y").select("lang", "n", F.round("r", 8).alias("r"))


@query(f"""WITH {RATED}, w AS (SELECT lang, n_chars AS x, label + toxic AS y, 1 + doc_id % 3 AS w FROM ra),
rx AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY lang ORDER BY x RANGE UNBOUNDED PRECEDING), 0) - sum(w) OVER (PARTITION BY lang, x) + (sum(w) OVER (PARTITION BY lang, x) + 1) / 2.0 AS a, sum(w) OVER (PARTITION BY lang ORDER BY y RANGE UNBOUNDED PRECEDING) - sum(w) OVER (PARTITION BY lang, y) + (sum(w) OVER (PARTITION BY lang, y) + 1) / 2.0 AS b FROM w),
m AS (SELECT *, sum(w * a) OVER (PARTITION BY lang) / sum(w) OVER (PARTITION BY lang) AS ma, sum(w * b) OVER (PARTITION BY lang) / sum(w) OVER (PARTITION BY lang) AS mb FROM rx)
SELECT lang, count(*) AS n, round(sum(w * (a - ma) * (b - mb)) / sqrt(sum(w * (a - ma) ^ 2) * sum(w * (b - mb) ^ 2)), 8) AS r FROM m GROUP BY lang""")
def weighted_spearman(spark, sf):
    d = rated(spark, sf).select("lang", "n_chars", (F.col("label") + F.col("toxic")).alias("y"), (1 + F.col("doc_id") % 3).alias("w"))
    return S.spearman(d, ["lang"], "n_chars", "y", "w").select("lang", "n", F.round("r", 8).alias("r"))


B = 1000
LANG = """'{"lang":' || coalesce('"' || lang || '"', 'null') || '}'"""
_BOOT = f"""{RATED}, un AS (SELECT doc_id AS unit, lang FROM ra), {R.sql_multiplicities("wt", "un", B, stratum=LANG)},
bw AS (SELECT ra.*, rep, w FROM ra JOIN wt ON wt.unit = ra.doc_id::VARCHAR AND wt.stratum = {LANG}),
bs AS (SELECT lang, rep, score, sum(w * label) AS p, sum(w * (1 - label)) AS n FROM bw GROUP BY ALL),
bc AS (SELECT *, sum(n) OVER (PARTITION BY lang, rep ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn, sum(p) OVER (PARTITION BY lang, rep) AS np, sum(n) OVER (PARTITION BY lang, rep) AS nn FROM bs),
ba AS (SELECT lang, rep, sum(p * (nn - cn + n / 2.0) / (np * nn)) AS auroc FROM bc WHERE np > 0 AND nn > 0 GROUP BY lang, rep)"""


@query(f"WITH {_BOOT} SELECT lang, round(avg(auroc), 8) AS mean, round(stddev_samp(auroc), 8) AS se, round(quantile_cont(auroc, 0.025), 8) AS low, round(quantile_cont(auroc, 0.975), 8) AS high, count(auroc) AS n_finite FROM ba GROUP BY lang")
def bootstrap_ci(spark, sf):
    """Per language its documents resampled to their number."""
    reps = R.curve_replicates(R.resampled(rated(spark, sf), "doc_id", B, ["lang"]), ["lang"], B)
    ci = S.percentile_ci(reps.filter("auroc is not null"), ["lang"], "auroc")
    return ci.select("lang", *[F.round(c, 8).alias(c) for c in ("mean", "se", "low", "high")], "n_finite")


_P = "pv AS (SELECT l_shipdate IS NULL AS z, l_returnflag AS family, l_suppkey AS id, round(0.001 + 0.5 * avg(l_discount) * avg(l_tax) / 0.05, 12) AS p FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_P}, s AS (SELECT *, least(1, (count(p) OVER (PARTITION BY family) - row_number() OVER w + 1) * p) AS s FROM pv WINDOW w AS (PARTITION BY family ORDER BY p, id))
SELECT family, id, round(max(s) OVER (PARTITION BY family ORDER BY p, id ROWS UNBOUNDED PRECEDING), 8) AS holm FROM s""")
def holm_adjust(spark, sf):
    l = read_table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_suppkey").alias("id")).agg(F.round(0.001 + 0.5 * F.avg("l_discount") * F.avg("l_tax") / 0.05, 12).alias("p"))
    return S.holm(l, ["family"], "p", ["id"]).select("family", "id", F.round("holm", 8).alias("holm"))


# fold tables: per mode (ship year), priority (model) and fold a mean price
def fold_table(spark, sf):
    d = read_table(spark, sf, "lineitem").join(read_table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return d.groupBy(F.col("o_orderpriority").alias("model"), F.col("l_returnflag").alias("task"), (F.col("l_partkey") % 6).cast("int").alias("fold")).agg(F.round(F.avg("l_discount"), 10).alias("value"))


FOLDS = "ft AS (SELECT o_orderpriority AS model, l_returnflag AS task, (l_partkey % 6)::INT AS fold, round(avg(l_discount), 10) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"


@query(f"WITH {FOLDS} SELECT model, task, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS sd, count(value) AS n_finite, count(*) AS n_folds FROM ft GROUP BY model, task")
def fold_summary(spark, sf):
    return W.summarise(fold_table(spark, sf), ["model", "task"], "value").select("model", "task", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), "n_finite", "n_folds")


@query(f"WITH {FOLDS} SELECT model, task, " + ", ".join(f"max(value) FILTER (fold = {k}) AS fold_{k}" for k in range(6)) + " FROM ft GROUP BY model, task")
def pivot_folds(spark, sf):
    return W.pivot_folds(fold_table(spark, sf), ["model", "task"], "fold", "value", list(range(6)))


@query(f"WITH {FOLDS}, r AS (SELECT *, round(value, 3) AS r FROM ft) SELECT model, task, fold, count(r) OVER w >= 2 AND r = max(r) OVER w AS best FROM r WINDOW w AS (PARTITION BY task, fold)")
def best_in_group(spark, sf):
    return W.flag_best(fold_table(spark, sf), ["task", "fold"], "value").select("model", "task", "fold", "best")


@query(f"WITH {FOLDS} SELECT x.task, x.model, round(avg(x.value - y.value), 9) AS delta, round(stddev_pop(x.value - y.value), 9) AS sd, count(*) AS n FROM ft x JOIN ft y ON x.task = y.task AND x.fold = y.fold AND y.model = '1-URGENT' AND x.model <> '1-URGENT' GROUP BY ALL")
def paired_deltas(spark, sf):
    return W.paired_deltas(fold_table(spark, sf), "model", "1-URGENT", "fold", "value", ["task"]).select("task", "model", F.round("delta", 9).alias("delta"), F.round("sd", 9).alias("sd"), "n")


@query(f"WITH {FOLDS}, r AS (SELECT *, row_number() OVER (PARTITION BY fold, task ORDER BY value DESC, model) AS rn FROM ft) SELECT fold, task, model, value FROM r WHERE rn = 1")
def best_per_fold(spark, sf):
    return W.best_per_fold(fold_table(spark, sf), "fold", "task", "value", "model").select("fold", "task", "model", "value")


@query(f"""WITH {FOLDS}, v AS (SELECT model, fold, avg(CASE WHEN task = 'A' THEN value END) AS val, avg(CASE WHEN task = 'R' THEN value END) AS test FROM ft GROUP BY ALL),
o AS (SELECT *, round((sum(val) OVER (PARTITION BY model) - val) / (count(val) OVER (PARTITION BY model) - 1), 12) AS others FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY others DESC, model) AS rn FROM o)
SELECT fold, model, round(others, 9) AS others, test FROM r WHERE rn = 1""")
def leave_one_fold_out(spark, sf):
    v = fold_table(spark, sf).groupBy("model", "fold").agg(F.avg(F.when(F.col("task") == "A", F.col("value"))).alias("val"), F.avg(F.when(F.col("task") == "R", F.col("value"))).alias("test"))
    return W.leave_one_out(v, "model", "fold", "val", "test").select("fold", "model", F.round("others", 9).alias("others"), "test")


@query(f"WITH {FOLDS} SELECT task, fold, round(sum(value * length(model)) / sum(length(model)), 7) AS weighted, round(avg(value), 7) AS plain, count(*) AS n_models FROM ft GROUP BY task, fold")
def weighted_ensemble(spark, sf):
    d = fold_table(spark, sf).withColumn("w", F.length("model"))
    return W.weighted_ensemble(d, ["task", "fold"], "w", "value").select("task", "fold", F.round("weighted", 7).alias("weighted"), F.round("plain", 7).alias("plain"), "n_models")


_AB = f"{FOLDS}, ab AS (SELECT x.task, x.fold, x.value AS a, y.value AS b, x.value - y.value AS d FROM ft x JOIN ft y ON x.task = y.task AND x.fold = y.fold AND x.model = '2-HIGH' AND y.model = '5-LOW')"


def two_runs(spark, sf):
    f = fold_table(spark, sf)
    a, b = (f.filter(F.col("model") == m).select("task", "fold", F.col("value").alias(n)) for m, n in (("2-HIGH", "a"), ("5-LOW", "b")))
    return a.join(b, ["task", "fold"]).withColumn("d", F.col("a") - F.col("b"))


@query(f"WITH {_AB} SELECT task, count(d) AS n, round(avg(d), 9) AS mean, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t, round(avg(d) / (stddev_samp(d) * sqrt(1.0 / count(d) + 0.25)), 6) AS t_corrected FROM ab GROUP BY task")
def fold_paired_test(spark, sf):
    return S.paired_folds(two_runs(spark, sf), ["task"], "a", "b").select("task", "n", F.round("mean", 9).alias("mean"), "wins", "losses", F.round("t", 6).alias("t"), F.round("t_corrected", 6).alias("t_corrected"))


@query(f"""WITH {_AB}, l AS (SELECT task, list(d ORDER BY fold) AS ds, count(d) AS n, avg(d) AS mean FROM ab GROUP BY task), f AS (SELECT task, n, mean, abs(list_sum(ds)) AS obs, abs(list_sum(list_transform(ds, lambda x, i: CASE WHEN (m >> (i - 1)) & 1 = 1 THEN -x ELSE x END))) AS s FROM l, LATERAL (SELECT unnest(range(1 << n::INT)) AS m))
SELECT task, max(n) AS n, round(max(mean), 9) AS mean, avg((s >= obs - 1e-12)::INT) AS p FROM f GROUP BY task""")
def sign_flip_test(spark, sf):
    return S.sign_flip(two_runs(spark, sf), ["task"], "d", "fold").select("task", "n", F.round("mean", 9).alias("mean"), "p")


@query(f"WITH {RATED} SELECT lang, round(regr_slope(score, n_chars), 10) AS slope, round(regr_intercept(score, n_chars), 6) AS intercept FROM ra GROUP BY lang")
def ols_affine(spark, sf):
    return S.ols(rated(spark, sf), ["lang"], "n_chars", "score").select("lang", F.round("slope", 10).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("""WITH j AS (SELECT nullif(event_type, 'view') AS kind, CASE WHEN event_id % 50 = 0 THEN NULL ELSE value - 40 END AS v FROM events)
SELECT kind, count(*) AS n, count(v) AS n_finite, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(avg((v < 0)::INT), 8) AS share_negative FROM j GROUP BY kind""")
def describe_with_null_group(spark, sf):
    e = read_table(spark, sf, "events").select(F.nullif("event_type", F.lit("view")).alias("kind"), F.when(F.col("event_id") % 50 != 0, F.col("value") - 40).alias("v"))
    return W.describe(e, "kind", "v").select("kind", "n", "n_finite", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("share_negative", 8).alias("share_negative"))


@query("SELECT event_type, (props->>'k')::INT % 10 AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def json_navigation(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % 10
    return read_table(spark, sf, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_DIM = "dm AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"


@query(f"WITH {_DIM} SELECT label, dim::INT AS dim, round(sum(x), 5) AS s FROM dm GROUP BY label, dim")
def vector_sum_pool(spark, sf):
    d = X.sum_pool(read_table(spark, sf, "embeddings"), "label", "embedding", 5)
    return d.select("label", F.posexplode("vec").alias("dim", "s"))


@query(f"WITH {_DIM} SELECT dim::INT AS dim, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS sd, count(x) AS n FROM dm GROUP BY dim")
def column_statistics(spark, sf):
    s = X.column_statistics(read_table(spark, sf, "embeddings"), "vec_id", "embedding")
    return s.select("dim", F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"), "n")


@query(f"WITH {_DIM}, s AS (SELECT dim, avg(x) AS m, stddev_samp(x) AS sd FROM dm GROUP BY dim) SELECT vec_id, round(sum(abs((x - m) / sd)), 5) AS size FROM dm JOIN s USING (dim) GROUP BY vec_id")
def standardised_vectors(spark, sf):
    e = read_table(spark, sf, "embeddings")
    z = X.standardise(e, X.fitted(X.column_statistics(e, "vec_id", "embedding")), "embedding")
    return z.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("size"))


@query(f"""WITH {LAB} SELECT lab.a, lab.b, x.vec_id IS NULL OR y.vec_id IS NULL AS missing, round(CASE WHEN x.vec_id IS NULL OR y.vec_id IS NULL THEN -64 ELSE list_sum(list_transform(range(1, 65), lambda i: abs(x.embedding[i]::DOUBLE - y.embedding[i]::DOUBLE))) END, 5) AS total
FROM lab LEFT JOIN embeddings x ON x.vec_id = lab.a LEFT JOIN embeddings y ON y.vec_id = lab.b""")
def pair_features(spark, sf):
    e = read_table(spark, sf, "embeddings")
    p = labelled(spark, sf).select("a", "b")
    for x in ("a", "b"):
        p = p.join(e.select(F.col("vec_id").alias(x), F.col("embedding").alias(f"v{x}")), x, "left")
    missing = F.col("va").isNull() | F.col("vb").isNull()
    v = C.abs_difference("va", "vb", missing, 64)
    return p.select("a", "b", missing.alias("missing"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query()
def huber_locations(spark, sf):
    return X.huber_locations(read_table(spark, sf, "embeddings"), "vec_id", "embedding")


@query()
def principal_components(spark, sf):
    d = X.principal_components(read_table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 4)
    return d.select("vec_id", F.transform("embedding", lambda x: F.round(x, 5)).alias("components"))
