"""Queries on row sets, scopes, negative pools, lookups and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pairs as C
from ..operators import folds as V
from ..operators import metrics as M
from ..operators import scopes as X
from ..operators import tables as T
from ..operators.lineage import settle
from .base import EV, FOLD, K, LAB, evidence, folded, labelled, read_table, sql_hash, sql_key
from .pair_plans import _CV2, _CV3, _VAL, SCORES, fold_scores

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def embedded(spark, sf):
    return read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))


def universe(spark, sf):
    """Parts of a size up to 40."""
    return read_table(spark, sf, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("id"))


def urgent(spark, sf):
    """Pairs asserted in an urgent context."""
    return evidence(spark, sf).filter("ctx = '1-URGENT'").select("a", "b").distinct()


_KN = "un AS (SELECT p_partkey AS id FROM part WHERE p_size <= 40), em AS (SELECT vec_id AS id FROM embeddings), ur AS (SELECT DISTINCT a, b FROM ev WHERE ctx = '1-URGENT')"
_FLAGS = f"""{FOLD}, {_KN}, fl AS (SELECT fo.*, fold = 0 AS t, ur.a IS NOT NULL AS o, x.id IS NOT NULL AND y.id IS NOT NULL AS k FROM fo
LEFT JOIN ur ON ur.a = fo.a AND ur.b = fo.b LEFT JOIN un x ON x.id = fo.a LEFT JOIN un y ON y.id = fo.b)"""


def flags(spark, sf):
    d = X.flagged(folded(spark, sf), "o", urgent(spark, sf))
    return X.both_known(d, universe(spark, sf), "k").withColumn("t", F.col("fold") == 0)


_SETS = {"incl_overlap": "t", "test": "t AND NOT o", "matched": "t AND NOT o AND k", "in_overlap": "t AND o", "matched_incl_overlap": "t AND k"}


@query(f"WITH {_FLAGS} " + " UNION ALL ".join(f"SELECT '{n}' AS row_set, count(*) AS n, sum(label)::BIGINT AS n_pos FROM fl WHERE {w} HAVING count(*) > 0" for n, w in _SETS.items()))
def row_sets(spark, sf):
    d = X.row_sets(flags(spark, sf), F.col("t"), F.col("o"), F.col("k"))
    return d.groupBy("row_set").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"))


@query(f"""WITH {_FLAGS}, sc AS (SELECT 'all' AS scope, * FROM fl UNION ALL SELECT 'known', * FROM fl WHERE k UNION ALL SELECT 'fold_' || fold::VARCHAR, * FROM fl)
SELECT scope, count(*) AS n, sum(o::INT)::BIGINT AS n_overlap, round(avg(o::INT), 8) AS share, CASE WHEN avg(o::INT) >= 0.5 THEN 'in_distribution' ELSE 'external' END AS role FROM sc GROUP BY scope""")
def screen_scopes(spark, sf):
    f = flags(spark, sf)
    d = T.subset_table(f, {"all": F.lit(True), "known": F.col("k")} | {f"fold_{i}": F.col("fold") == i for i in range(K)})
    d = d.groupBy(F.col("subset").alias("scope")).agg(F.count("*").alias("n"), F.sum(F.col("o").cast("int")).alias("n_overlap"), F.avg(F.col("o").cast("int")).alias("s"))
    return d.select("scope", "n", "n_overlap", F.round("s", 8).alias("share"), F.when(F.col("s") >= 0.5, "in_distribution").otherwise("external").alias("role"))


@query(f"""WITH {EV}, ps AS (SELECT DISTINCT a, b FROM ev WHERE positive), ng AS (SELECT DISTINCT a, b FROM ev WHERE NOT positive), ke AS (SELECT DISTINCT a, b FROM ev WHERE o % 3 <> 0 OR status = 'O')
SELECT p.a IS NOT NULL AS in_pos, n.a IS NOT NULL AND p.a IS NULL AS in_neg, count(*) AS n FROM ke LEFT JOIN ps p ON p.a = ke.a AND p.b = ke.b LEFT JOIN ng n ON n.a = ke.a AND n.b = ke.b GROUP BY ALL""")
def membership_flags(spark, sf):
    e = evidence(spark, sf)
    keys = e.filter("o % 3 <> 0 or status = 'O'").select("a", "b").distinct()
    return X.membership(keys, e.filter("positive"), e.filter("not positive")).groupBy("in_pos", "in_neg").agg(F.count("*").alias("n"))


@query(f"""WITH {_CV3}{_VAL} SELECT fold, count(DISTINCT {sql_key()}) AS n_keys, count(DISTINCT a) AS n_first FROM va WHERE part = 'train' GROUP BY fold""")
def fold_train_keys(spark, sf):
    return V.train_keys(V.carve_validation(V.cv3(labelled(spark, sf), K)))


@query(f"""WITH {LAB}, {_KN}, ng AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem),
r AS (SELECT CASE WHEN ng.a = ng.b THEN 'self_pair' WHEN e1.id IS NULL OR e2.id IS NULL THEN 'not_embedded' WHEN u1.id IS NULL OR u2.id IS NULL THEN 'outside_universe' WHEN l.a IS NOT NULL THEN 'positive' ELSE 'kept' END AS reason
FROM (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM ng) ng LEFT JOIN em e1 ON e1.id = ng.a LEFT JOIN em e2 ON e2.id = ng.b LEFT JOIN un u1 ON u1.id = ng.a LEFT JOIN un u2 ON u2.id = ng.b
LEFT JOIN (SELECT a, b FROM lab WHERE label = 1) l ON l.a = ng.a AND l.b = ng.b) SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def negative_pool(spark, sf):
    l = read_table(spark, sf, "lineitem")
    cand = l.select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()
    d = X.pool_reasons(cand, embedded(spark, sf), universe(spark, sf), labelled(spark, sf).filter("label = 1"))
    return d.groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {LAB}, {_KN} SELECT count(*) AS n, sum(a + b)::BIGINT AS total FROM lab WHERE label = 1 AND a IN (SELECT id FROM em) AND b IN (SELECT id FROM em)""")
def embedded_positives(spark, sf):
    d = X.induced(labelled(spark, sf).filter("label = 1"), embedded(spark, sf))
    return d.agg(F.count("*").alias("n"), F.sum(F.col("a") + F.col("b")).alias("total"))


@query(f"""WITH {EV}, c AS (SELECT a, b, count(*) AS n FROM (SELECT a, b, positive, o FROM ev) GROUP BY a, b HAVING count(DISTINCT positive) > 1) SELECT n, count(*) AS pairs FROM c GROUP BY n""")
def label_conflict_counts(spark, sf):
    e = evidence(spark, sf).select("a", "b", F.col("positive").alias("label"))
    return X.label_conflicts(e).groupBy("n").agg(F.count("*").alias("pairs"))


@query(f"WITH {FOLD} SELECT label, count(*) AS n, count(DISTINCT a) AS n_first FROM fo GROUP BY label")
def fold_label_union(spark, sf):
    p = folded(spark, sf)
    d = X.fold_labels(p.select("a", "b", "label"), p.filter("label = 1").select("a", "b"))
    return d.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("a").alias("n_first"))


_DIRECTED = "ds AS (SELECT l_linenumber AS k, l_partkey AS i, l_suppkey AS j, avg(l_discount) AS score FROM lineitem GROUP BY ALL UNION ALL SELECT l_linenumber, l_suppkey, l_partkey, avg(l_tax) FROM lineitem WHERE l_quantity > 10 GROUP BY ALL)"


def directed(spark, sf):
    """A directed score table per fold: part to supplier, and back where there is a large line."""
    l = read_table(spark, sf, "lineitem")
    there = l.groupBy(F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.avg("l_discount").alias("score"))
    back = l.filter("l_quantity > 10").groupBy(F.col("l_linenumber").alias("k"), F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.avg("l_tax").alias("score"))
    return there.unionByName(back).groupBy("k", "i", "j").agg(F.avg("score").alias("score"))


@query(f"""WITH {_DIRECTED}, d AS (SELECT k, i, j, avg(score) AS score FROM ds GROUP BY ALL), p AS (SELECT DISTINCT l_linenumber AS k, l_partkey AS a, l_suppkey AS b FROM lineitem)
SELECT p.k, count(*) AS n, count(x.score + y.score) AS n_scored, round(avg((x.score + y.score) / 2), 8) AS mean FROM p LEFT JOIN d x ON x.k = p.k AND x.i = p.a AND x.j = p.b LEFT JOIN d y ON y.k = p.k AND y.i = p.b AND y.j = p.a GROUP BY p.k""")
def pair_score_lookup(spark, sf):
    p = read_table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    d = X.pair_scores(p, directed(spark, sf), ["k"])
    return d.groupBy("k").agg(F.count("*").alias("n"), F.count("score").alias("n_scored"), F.round(F.avg("score"), 8).alias("mean"))


@query(f"WITH {SCORES}, m AS (SELECT fold, min(score) AS low FROM sc GROUP BY fold) SELECT sc.fold, count(*) AS n, round(min(score - low + 1), 6) AS low, round(avg(score - low + 1), 6) AS mean FROM sc JOIN m ON m.fold = sc.fold GROUP BY sc.fold")
def shifted_scores(spark, sf):
    d = X.shifted(fold_scores(spark, sf), ["fold"], "score")
    return d.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("low"), F.round(F.avg("score"), 6).alias("mean"))


@query(f"WITH {FOLD} SELECT count(*) AS n, sum(a)::BIGINT AS total FROM fo WHERE label = 1 AND NOT (fold = 1)")
def seen_index(spark, sf):
    p = folded(spark, sf).filter("label = 1")
    d = X.seen_index(p.filter("fold in (2, 3)").select(F.col("b").alias("a"), F.col("a").alias("b")), p, p.filter("fold = 1"))
    return d.agg(F.count("*").alias("n"), F.sum("a").alias("total"))


@query(f"""WITH {_CV2}{_VAL}, e AS (SELECT fold, a AS id, part = 'train' AS t FROM va UNION ALL SELECT fold, b, part = 'train' FROM va), i AS (SELECT fold, id, max(t::INT) AS fits FROM e GROUP BY fold, id)
SELECT fold, count(*) AS n, sum(fits)::BIGINT AS n_fit FROM i GROUP BY fold""")
def fold_fit_mask(spark, sf):
    return V.fit_counts(V.carve_validation(V.cv2(labelled(spark, sf), K)))


@query(f"""WITH {FOLD}, {_KN}, vw AS (SELECT id FROM un UNION SELECT id FROM em) SELECT fold, count(*) AS n, round(avg((x.id IS NOT NULL AND y.id IS NOT NULL)::INT), 8) AS share
FROM fo LEFT JOIN vw x ON x.id = fo.a LEFT JOIN vw y ON y.id = fo.b GROUP BY fold""")
def view_coverage(spark, sf):
    views = universe(spark, sf).unionByName(embedded(spark, sf))
    return X.view_coverage(folded(spark, sf), views, ["fold"]).select("fold", "n", F.round("share", 8).alias("share"))


@query(f"""WITH {FOLD}, u AS (SELECT *, {sql_hash(sql_key(), 'neg')} / 4294967296.0 AS u FROM fo), w AS (SELECT *, row_number() OVER (PARTITION BY fold, label ORDER BY u, a, b) AS rn, sum(label) OVER (PARTITION BY fold) AS np FROM u)
SELECT fold, label, count(*) AS n, sum(a)::BIGINT AS total FROM w WHERE label = 1 OR rn <= ceil(np * 0.5) GROUP BY fold, label""")
def negative_ratio_sample(spark, sf):
    d = folded(spark, sf).withColumn("u", C.uniform_of(C.pair_key("a", "b"), "neg"))
    d = X.ratio_sample(d, ["fold"], "label", [F.col("u"), F.col("a"), F.col("b")], 0.5)
    return d.groupBy("fold", "label").agg(F.count("*").alias("n"), F.sum("a").alias("total"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) SELECT l_partkey AS a, l_suppkey AS b, l_returnflag AS field FROM r WHERE rn = 1")
def last_wins(spark, sf):
    l = read_table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("field"), F.struct("l_orderkey", "l_linenumber").alias("ord"))
    return X.last_wins(l, ["a", "b"], "field", "ord").select("a", "b", "field")


@query("SELECT DISTINCT id FROM (SELECT l_partkey AS id FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'F')")
def typed_endpoints(spark, sf):
    l = read_table(spark, sf, "lineitem")
    relation = F.concat(F.when(F.col("l_returnflag") != "N", "Gene").otherwise("Drug"), F.lit("_binds_"), F.when(F.col("l_linestatus") == "F", "Gene").otherwise("Drug"))
    return X.typed_ends(l.select(F.col("l_partkey").alias("h"), F.col("l_suppkey").alias("t"), relation.alias("relation")), "relation", "Gene")


@query("""WITH r AS (SELECT p_brand AS brand, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY (p_name LIKE '%a%') DESC, length(p_name) DESC, p_partkey) AS rn FROM part) SELECT brand, id FROM r WHERE rn = 1""")
def candidate_pick(spark, sf):
    p = read_table(spark, sf, "part")
    return X.picked(p, "p_brand", [F.desc(F.col("p_name").contains("a")), F.desc(F.length("p_name")), F.col("p_partkey")]).select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"))


_TIERS = "t1 AS (SELECT l_partkey AS id, max(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), t2 AS (SELECT l_partkey AS id, max(l_tax) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), t3 AS (SELECT vec_id AS id, label::DOUBLE AS v FROM embeddings)"


@query(f"""WITH {_TIERS} SELECT p_partkey AS id, coalesce(t1.v, t2.v, t3.v) AS v, CASE WHEN t1.v IS NOT NULL THEN 'returned' WHEN t2.v IS NOT NULL THEN 'accepted' WHEN t3.v IS NOT NULL THEN 'vector' END AS source
FROM part LEFT JOIN t1 ON t1.id = p_partkey LEFT JOIN t2 ON t2.id = p_partkey LEFT JOIN t3 ON t3.id = p_partkey""")
def tiered_values(spark, sf):
    l = read_table(spark, sf, "lineitem")
    tier = lambda flag, c: l.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("id")).agg(F.max(c).alias("v"))
    vectors = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("v"))
    return X.tiered(read_table(spark, sf, "part").select(F.col("p_partkey").alias("id")), {"returned": tier("R", "l_quantity"), "accepted": tier("A", "l_tax"), "vector": vectors}, "id", "v")


@query(f"""WITH {LAB}, {_KN}, su AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM un), ta AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM em), ids AS (SELECT a AS id FROM lab UNION SELECT b FROM lab)
SELECT ids.id, coalesce(su.idx, -1) AS source, coalesce(ta.idx, -1) AS target FROM ids LEFT JOIN su ON su.id = ids.id LEFT JOIN ta ON ta.id = ids.id""")
def index_map(spark, sf):
    from ..operators.pairs import universe as ranks

    def indexed(ids):
        both = ids.select(F.col("id").alias("a"), F.col("id").alias("b"))
        return ranks(both).select(F.col("id").cast("long").alias("id"), "idx")

    ids = labelled(spark, sf).select(F.explode(F.array("a", "b")).alias("id"))
    return X.index_map(ids, indexed(universe(spark, sf)), indexed(embedded(spark, sf))).select("id", "source", "target")


def _dot(h: int) -> str:
    return f"list_sum(list_transform(range({16 * h + 1}, {16 * h + 17}), lambda i: x.embedding[i]::DOUBLE * y.embedding[i]::DOUBLE))"


@query(f"""WITH {LAB}, h AS (SELECT lab.a, lab.b, {", ".join(f"{_dot(h)} AS s{h}" for h in range(4))} FROM lab JOIN embeddings x ON x.vec_id = lab.a JOIN embeddings y ON y.vec_id = lab.b)
SELECT a, b, round(greatest(s0, s1, s2, s3), 5) AS any_score, round(s0 + s1 + s2 + s3, 5) AS total FROM h""")
def head_scores(spark, sf):
    v = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    d = X.head_scores(labelled(spark, sf).select("a", "b"), v, [0, 1, 2, 3], 16)
    return d.select("a", "b", F.round("any", 5).alias("any_score"), F.round(F.aggregate("scores", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(f"""WITH {FOLD}, tr AS (SELECT a AS id FROM fo WHERE label = 1 AND fold <> 0 UNION ALL SELECT b FROM fo WHERE label = 1 AND fold <> 0) SELECT id, count(*) AS degree FROM tr GROUP BY id""")
def train_degrees(spark, sf):
    from ..operators.pairs import degrees

    return degrees(folded(spark, sf).filter("label = 1 and fold <> 0"))


@query(f"""WITH {FOLD}, n AS (SELECT count(DISTINCT id) AS m FROM (SELECT a AS id FROM fo UNION ALL SELECT b FROM fo)) SELECT label, count(*) AS n_pairs, max(m) AS n_ids, round(count(*) / (max(m) * (max(m) - 1) / 2.0), 10) AS density FROM fo, n GROUP BY label""")
def data_statistics(spark, sf):
    p = folded(spark, sf)
    m = p.select(F.explode(F.array("a", "b")).alias("id")).agg(F.count_distinct("id").alias("m"))
    d = p.groupBy("label").agg(F.count("*").alias("n_pairs")).crossJoin(F.broadcast(m))  # one row
    return d.select("label", "n_pairs", F.col("m").alias("n_ids"), F.round(F.col("n_pairs") / (F.col("m") * (F.col("m") - 1) / 2), 10).alias("density"))


@query(f"""WITH {_CV2}{_VAL}, sn AS (SELECT DISTINCT fold, id FROM (SELECT fold, a AS id FROM va WHERE part = 'train' UNION ALL SELECT fold, b FROM va WHERE part = 'train'))
SELECT va.fold, part, count(*) AS n, round(avg(label), 8) AS prevalence, round(avg((x.id IS NOT NULL AND y.id IS NOT NULL)::INT), 8) AS both_in_train FROM va LEFT JOIN sn x ON x.fold = va.fold AND x.id = va.a LEFT JOIN sn y ON y.fold = va.fold AND y.id = va.b GROUP BY va.fold, part""")
def fold_geometry(spark, sf):
    d = V.geometry(V.carve_validation(V.cv2(labelled(spark, sf), K)), "label")
    return d.select("fold", "part", "n", F.round("prevalence", 8).alias("prevalence"), F.round("both_in_train", 8).alias("both_in_train"))


_AUC = "(sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label)::DOUBLE * sum(1 - label), 0)"


@query(f"""WITH {FOLD}, {_KN}, m AS (SELECT a, b, max((ctx = '1-URGENT')::INT) = 1 AS urgent, max((status = 'O')::INT) = 1 AS open_, avg(x) AS score FROM ev GROUP BY a, b),
j AS (SELECT lab.label, round(m.score, 6) AS score, urgent, open_ FROM lab JOIN m ON m.a = lab.a AND m.b = lab.b),
l AS (SELECT 'all' AS subset, * FROM j UNION ALL SELECT 'urgent', * FROM j WHERE urgent UNION ALL SELECT 'open', * FROM j WHERE open_ UNION ALL SELECT 'urgent_not_open', * FROM j WHERE urgent AND NOT open_),
k AS (SELECT *, rank() OVER (PARTITION BY subset ORDER BY score) + (count(*) OVER (PARTITION BY subset, score) - 1) / 2.0 AS r FROM l)
SELECT subset, count(*) AS n, round({_AUC}, 8) AS auroc FROM k GROUP BY subset""")
def agreement_by_subset(spark, sf):
    m = evidence(spark, sf).groupBy("a", "b").agg(F.max(F.col("positive").cast("int")).alias("label"), F.max(F.col("ctx") == "1-URGENT").alias("urgent"), F.max(F.col("status") == "O").alias("open"), F.round(F.avg("x"), 6).alias("score"))
    m = settle(T.subset_table(m, {"all": F.lit(True), "urgent": F.col("urgent"), "open": F.col("open"), "urgent_not_open": F.col("urgent") & ~F.col("open")}), "subsets")
    d = M.auroc(m, ["subset"])
    return d.select("subset", (F.col("n_pos") + F.col("n_neg")).alias("n"), F.round("auroc", 8).alias("auroc"))


@query(f"WITH {FOLD} SELECT fold, count(*) AS n, round(avg(label), 8) AS mean FROM (SELECT label, unnest(range({K}))::INT AS fold FROM lab) GROUP BY fold")
def label_as_predictor(spark, sf):
    d = labelled(spark, sf).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(K - 1))))
    return d.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("label"), 8).alias("mean"))


_NAMES = "nm AS (SELECT n_nationkey AS id, CASE n_nationkey WHEN 3 THEN 'PINNED' ELSE upper(trim(n_name)) END AS symbol FROM nation)"


@query(f"WITH {_NAMES} SELECT c_custkey AS id, coalesce(symbol, '') AS symbol FROM customer LEFT JOIN nm ON nm.id = CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_nationkey END")
def reverse_symbols(spark, sf):
    names = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") == 3, "PINNED").otherwise(F.upper(F.trim("n_name"))).alias("symbol"))
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 == 0, -1).otherwise(F.col("c_nationkey")).alias("k"))
    return c.join(names, "k", "left").select("id", F.coalesce("symbol", F.lit("")).alias("symbol"))


@query("""WITH m AS (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 0), d AS (SELECT l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count(*) AS ids, count(n_name) AS mapped, count(*) FILTER (n_name IS NULL) AS unmapped, count(DISTINCT n_name) AS targets FROM d LEFT JOIN m ON m.s_suppkey = d.id""")
def convert_ids_report(spark, sf):
    m = read_table(spark, sf, "supplier").filter("s_suppkey % 5 <> 0").join(read_table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), "n_name")
    d = read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id")).distinct().join(m, "id", "left")
    return d.agg(F.count("*").alias("ids"), F.count("n_name").alias("mapped"), F.count_if(F.col("n_name").isNull()).alias("unmapped"), F.count_distinct("n_name").alias("targets"))
