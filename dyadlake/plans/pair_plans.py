"""Queries on pair relations, conflicts, labels, partitions and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pairs as C
from ..operators import folds as V
from ..operators import graphs as G
from ..operators import metrics as M
from ..operators import pairs as P
from ..operators import resolve as R
from ..operators.lineage import settle
from .base import EV, FOLD, HEADS, K, LAB, N_HEADS, OTHER, cooccurrences, evidence, folded, labelled, read_table, sql_hash, sql_key

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def sides(spark, sf):
    """Positive and negative assertions: a, b, lines, heads."""
    e = evidence(spark, sf).groupBy("a", "b", "positive").agg(F.array_sort(F.collect_set("ctx")).alias("lines"))
    e = e.withColumn("heads", C.heads_of_members(F.col("lines"), F.lit(True), HEADS, OTHER))
    return e.filter("positive").drop("positive"), e.filter("not positive").drop("positive")


LINES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
#: Both sides' contexts as bits, one row per pair: pl, nl of lines and ph, nh of heads.
_BIT = " ".join(f"WHEN '{x}' THEN {1 << i}" for i, x in enumerate(LINES))
BITS = EV + f""", mb AS (SELECT a, b, bit_or(CASE WHEN positive THEN m ELSE 0 END) AS pl, bit_or(CASE WHEN positive THEN 0 ELSE m END) AS nl
FROM (SELECT a, b, positive, (CASE ctx {_BIT} ELSE 0 END)::INT AS m FROM ev) GROUP BY a, b),
mk AS (SELECT *, (pl & 7) + CASE WHEN (pl & 24) > 0 THEN 8 ELSE 0 END AS ph, (nl & 7) + CASE WHEN (nl & 24) > 0 THEN 8 ELSE 0 END AS nh FROM mb)"""


def _lines_of(mask: str) -> str:
    return "concat_ws(';', " + ", ".join(f"CASE WHEN ({mask} & {1 << i}) > 0 THEN '{x}' END" for i, x in enumerate(LINES)) + ")"


HEAD_SQL = "CASE ctx WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END"
SIDE = EV + f""", sd AS (SELECT a, b, positive, list_sort(list_distinct(list(ctx))) AS lines, list_sort(list_distinct(list({HEAD_SQL}))) AS heads FROM ev GROUP BY ALL),
ps AS (SELECT * FROM sd WHERE positive), ng AS (SELECT * FROM sd WHERE NOT positive)"""


@query(f"WITH {EV} SELECT DISTINCT a, b FROM ev")
def pair_canonical_dedup(spark, sf):
    co = cooccurrences(spark, sf)
    return P.canonical_pairs(co.select(F.col("b").alias("x"), F.col("a").alias("y")), "x", "y")


@query(f"WITH {EV} SELECT a, b, array_to_string(list_sort(list_distinct(list(ctx))), ';') AS contexts, array_to_string(list_sort(list_distinct(list(status))), ';') AS statuses FROM ev GROUP BY a, b")
def pair_set_union(spark, sf):
    e = evidence(spark, sf).select("a", "b", F.array("ctx").alias("contexts"), F.array("status").alias("statuses"))
    u = P.set_union(e, ["a", "b"], "contexts", "statuses")
    return u.select("a", "b", F.array_join("contexts", ";").alias("contexts"), F.array_join("statuses", ";").alias("statuses"))


@query(f"WITH {EV} SELECT a, b, round(-avg(x), 6) AS target, count(*) AS n FROM ev GROUP BY a, b")
def unordered_dedup_mean(spark, sf):
    m = P.mean_of_duplicates(evidence(spark, sf), "x", -1)
    return m.select("a", "b", F.round("target", 6).alias("target"), "n")


@query(f"""WITH {BITS} SELECT a, b, {_lines_of('pl')} AS pos_lines, {_lines_of('nl')} AS neg_lines,
CASE WHEN (pl & nl) > 0 THEN 'shared' ELSE 'disjoint' END AS line_agreement, CASE WHEN (ph & nh) > 0 THEN 'shared' ELSE 'disjoint' END AS head_agreement
FROM mk WHERE pl > 0 AND nl > 0""")
def conflict_report(spark, sf):
    c = P.conflicts(*sides(spark, sf))
    return c.select("a", "b", F.array_join("pos_lines", ";").alias("pos_lines"), F.array_join("neg_lines", ";").alias("neg_lines"), "line_agreement", "head_agreement")


def _policy(name: str, sql_pos: str, sql_neg: str):
    @query(f"""WITH {SIDE} SELECT a, b, 1 AS label FROM ps p WHERE {sql_pos} UNION ALL SELECT a, b, 0 FROM ng n WHERE {sql_neg}""")
    def run(spark, sf):
        pos, neg = P.resolve_conflicts(*sides(spark, sf), name)
        return pos.select("a", "b", F.lit(1).alias("label")).unionByName(neg.select("a", "b", F.lit(0).alias("label")))

    QUERIES[f"conflict_policy_{name}"], SQL[f"conflict_policy_{name}"] = QUERIES.pop("run"), SQL.pop("run")


_NOT_NEG, _NOT_POS = "NOT EXISTS (SELECT 1 FROM ng q WHERE q.a = p.a AND q.b = p.b)", "NOT EXISTS (SELECT 1 FROM ps q WHERE q.a = n.a AND q.b = n.b)"
_policy("drop", _NOT_NEG, _NOT_POS)
_policy("positive", "true", _NOT_POS)
_policy("negative", _NOT_NEG, "true")
_policy("context", "true", "NOT EXISTS (SELECT 1 FROM ps q WHERE q.a = n.a AND q.b = n.b AND len(list_intersect(q.lines, n.lines)) > 0)")


def labels(spark, sf, same_head="or"):
    pos, neg = (d.select("a", "b", F.col("heads").alias(n)) for d, n in zip(sides(spark, sf), ("ph", "nh"), strict=True))
    d = pos.join(neg, ["a", "b"], "full_outer")
    none = F.array().cast("array<int>")
    return d.select("a", "b", C.label_mask(F.coalesce("ph", none), F.coalesce("nh", none), N_HEADS, same_head).alias("cells"))


_CELLS = BITS + ", ce AS (" + " UNION ALL ".join(f"SELECT a, b, {h} AS h, (ph & {1 << h}) > 0 AS p, (nh & {1 << h}) > 0 AS n FROM mk" for h in range(4)) + ")"


@query(f"WITH {_CELLS} SELECT a, b, h AS head, CASE WHEN p THEN 1 ELSE 0 END AS label, CASE WHEN p OR n THEN 1 ELSE 0 END AS mask FROM ce")
def label_mask_or(spark, sf):
    return labels(spark, sf).select("a", "b", F.posexplode("cells").alias("head", "c")).select("a", "b", "head", "c.label", "c.mask")


@query(f"WITH {_CELLS} SELECT a, b, h AS head, CASE WHEN p AND NOT n THEN 1 ELSE 0 END AS label, CASE WHEN p <> n THEN 1 ELSE 0 END AS mask FROM ce")
def label_mask_strict(spark, sf):
    return labels(spark, sf, "mask").select("a", "b", F.posexplode("cells").alias("head", "c")).select("a", "b", "head", "c.label", "c.mask")


@query(f"WITH {_CELLS} SELECT a, b, max(CASE WHEN p THEN 1 ELSE 0 END) AS pooled FROM ce GROUP BY a, b")
def pooled_label(spark, sf):
    return labels(spark, sf).select("a", "b", C.pooled(F.col("cells")).alias("pooled"))


@query(f"WITH {LAB}, d AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM lab UNION ALL SELECT b FROM lab) GROUP BY id) SELECT lab.a, lab.b, round(ln(1 + x.degree) + ln(1 + y.degree), 9) AS score FROM lab JOIN d x ON x.id = lab.a JOIN d y ON y.id = lab.b")
def degree_prior_scores(spark, sf):
    p = settle(labelled(spark, sf), "labelled")
    return P.degree_scores(p, p).select("a", "b", F.round("score", 9).alias("score"))


def fold_scores(spark, sf):
    """Every pair scored by its ends' degrees among the pairs of the other folds."""
    p = settle(folded(spark, sf), "folded")  # the relation's own degrees, its pairs and the cut points of the scores read it
    own = p.select(F.explode(F.array("a", "b")).alias("id"), "fold").groupBy("id", "fold").agg(F.count("*").alias("n"))
    every = own.groupBy("id").agg(F.sum("n").alias("all"))
    train = own.join(every, "id").select("id", "fold", (F.col("all") - F.col("n")).alias("deg"))
    for x in ("a", "b"):
        p = p.join(train.select(F.col("id").alias(x), "fold", F.col("deg").alias(f"d{x}")), [x, "fold"])
    return p.select("a", "b", "fold", "label", F.round(F.log1p("da") + F.log1p("db"), 9).alias("score"))


SCORES = FOLD + """, en AS (SELECT id, fold, count(*) AS n FROM (SELECT a AS id, fold FROM fo UNION ALL SELECT b, fold FROM fo) GROUP BY ALL),
tr AS (SELECT id, fold, sum(n) OVER (PARTITION BY id) - n AS deg FROM en),
sc AS (SELECT fo.a, fo.b, fo.fold, label, round(ln(1 + x.deg) + ln(1 + y.deg), 9) AS score FROM fo JOIN tr x ON x.id = fo.a AND x.fold = fo.fold JOIN tr y ON y.id = fo.b AND y.fold = fo.fold)"""


@query(f"""WITH {SCORES}, rk AS (SELECT fold, label, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS r FROM sc)
SELECT fold, sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg, round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label)::DOUBLE * sum(1 - label)), 8) AS auroc FROM rk GROUP BY fold""")
def degree_prior_auroc(spark, sf):
    return M.auroc(fold_scores(spark, sf), ["fold"]).select("fold", "n_pos", "n_neg", F.round("auroc", 8).alias("auroc"))


@query(f"WITH {FOLD} SELECT fold, label, count(*) AS n FROM fo GROUP BY fold, label")
def fold_cv1(spark, sf):
    return V.cv1(labelled(spark, sf), K).groupBy("fold", "label").agg(F.count("*").alias("n"))


_HELD = f"""{LAB}, he AS (SELECT *, (({sql_hash('a::VARCHAR', 'gene')} % {K}) = fold)::INT + (({sql_hash('b::VARCHAR', 'gene')} % {K}) = fold)::INT AS h FROM lab, (SELECT unnest(range({K}))::INT AS fold))"""
_CV2 = _HELD + ", pa AS (SELECT *, CASE WHEN h > 0 THEN 'test' ELSE 'train' END AS part FROM he)"
_CV3 = _HELD + ", pa AS (SELECT *, CASE WHEN h = 2 THEN 'test' WHEN h = 0 THEN 'train' ELSE 'dropped' END AS part FROM he)"
_VAL = f", va AS (SELECT * REPLACE (CASE WHEN part = 'train' AND {sql_hash(sql_key() + chr(124) * 2 + repr('#') + chr(124) * 2 + 'fold::VARCHAR', 'val')} / 4294967296.0 < 0.1 THEN 'val' ELSE part END AS part) FROM pa)"


@query(f"WITH {_CV2}{_VAL} SELECT fold, part, label, count(*) AS n FROM va GROUP BY ALL")
def fold_cv2(spark, sf):
    return V.carve_validation(V.cv2(labelled(spark, sf), K)).groupBy("fold", "part", "label").agg(F.count("*").alias("n"))


@query(f"WITH {_CV3}{_VAL} SELECT fold, part, label, count(*) AS n FROM va GROUP BY ALL")
def fold_cv3(spark, sf):
    return V.carve_validation(V.cv3(labelled(spark, sf), K)).groupBy("fold", "part", "label").agg(F.count("*").alias("n"))


def _leak_sql(cv: str, both: int) -> str:
    """Counts from the parts themselves: pairs in two parts, and test pairs with ends in train."""
    return f"""WITH {cv}{_VAL}, tw AS (SELECT fold, count(*) FILTER (k > 1) AS pairs_twice FROM (SELECT fold, a, b, count(DISTINCT part) AS k FROM va WHERE part <> 'dropped' GROUP BY fold, a, b) GROUP BY fold),
sn AS (SELECT DISTINCT fold, id FROM (SELECT fold, a AS id FROM va WHERE part IN ('train', 'val') UNION ALL SELECT fold, b FROM va WHERE part IN ('train', 'val'))),
te AS (SELECT va.fold, count(*) FILTER ((x.id IS NOT NULL)::INT + (y.id IS NOT NULL)::INT >= {both}) AS ids_shared FROM va LEFT JOIN sn x ON x.fold = va.fold AND x.id = va.a LEFT JOIN sn y ON y.fold = va.fold AND y.id = va.b WHERE part = 'test' GROUP BY va.fold)
SELECT tw.fold, pairs_twice, coalesce(ids_shared, 0) AS ids_shared FROM tw LEFT JOIN te ON te.fold = tw.fold"""


@query(_leak_sql(_CV3, 1))
def fold_leak_check(spark, sf):
    return V.leaks(V.carve_validation(V.cv3(labelled(spark, sf), K)), both_held=True)


@query(_leak_sql(_CV2, 2))
def fold_leak_check_cv2(spark, sf):
    return V.leaks(V.carve_validation(V.cv2(labelled(spark, sf), K)), both_held=False)


@query(f"WITH {_CV3} SELECT fold, part, count(*) AS n, sum(('0x' || substr(md5({sql_key()}), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS digest FROM pa GROUP BY fold, part")
def fold_digest(spark, sf):
    return V.digest(V.cv3(labelled(spark, sf), K), ["fold", "part"])


@query(f"WITH {FOLD} SELECT a, b FROM fo WHERE label = 1 AND fold <> 0")
def seen_mask_antijoin(spark, sf):
    p = folded(spark, sf).filter("label = 1")
    return V.seen_mask(p.select("a", "b"), p.filter("fold = 0"))


@query(f"""WITH {LAB}, d AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM lab UNION ALL SELECT b FROM lab) GROUP BY id ORDER BY n DESC, id LIMIT 500)
SELECT a, b FROM lab WHERE a IN (SELECT id FROM d) AND b IN (SELECT id FROM d)""")
def subsample_hubs(spark, sf):
    return P.subsample(labelled(spark, sf).select("a", "b"), 500)


@query(f"""WITH {LAB} SELECT id::VARCHAR AS id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT a AS id FROM lab UNION SELECT b FROM lab)""")
def entity_universe(spark, sf):
    return P.universe(labelled(spark, sf))


@query(f"""WITH {FOLD}, w AS (SELECT *, row_number() OVER (PARTITION BY fold, label ORDER BY {sql_hash(sql_key(), 'bal')} / 4294967296.0, {sql_key()}) AS rn, count(*) OVER (PARTITION BY fold, label) AS n FROM fo),
m AS (SELECT fold, min(n) AS m FROM w GROUP BY fold HAVING count(DISTINCT label) = 2) SELECT a, b, fold, label FROM w JOIN m USING (fold) WHERE rn <= m""")
def class_balance(spark, sf):
    p = folded(spark, sf).withColumn("unit", C.pair_key("a", "b"))
    return V.balance(p, ["fold"], "label", "unit").select("a", "b", "fold", "label")


@query(f"""WITH {EV}, t AS (SELECT a, b, x, o FROM ev), l AS (SELECT a, b, min(x) AS y FROM t GROUP BY a, b), r AS (SELECT a, b, max(x) AS y FROM t WHERE o % 2 = 0 GROUP BY a, b)
SELECT count(*) FILTER (r.a IS NULL) AS only_left, count(*) FILTER (l.a IS NULL) AS only_right, count(*) FILTER (abs(l.y - r.y) > 1e-9) AS different FROM l FULL JOIN r ON l.a = r.a AND l.b = r.b""")
def same_pairs_check(spark, sf):
    e = evidence(spark, sf)
    l = e.groupBy("a", "b").agg(F.min("x").alias("y"))
    r = e.filter("o % 2 = 0").groupBy("a", "b").agg(F.max("x").alias("y"))
    return P.same_pairs(l, r, "y")


#: Stand-in dictionaries over nation names: current, previous and alias names.
_DICT = """cur AS (SELECT n_name AS name, n_nationkey::VARCHAR AS id, 0 AS tier FROM nation),
pre AS (SELECT right(n_name, 2) AS name, n_nationkey::VARCHAR AS id, 1 AS tier FROM nation),
ali AS (SELECT right(n_name, 1) AS name, n_nationkey::VARCHAR AS id, 2 AS tier FROM nation)"""


def tiers(spark, sf):
    n = read_table(spark, sf, "nation")
    cut = lambda k: n.select((F.right("n_name", F.lit(k)) if k else F.col("n_name")).alias("name"), F.col("n_nationkey").cast("string").alias("id"), F.lit(0).alias("ord"))
    return [cut(0), cut(2), cut(1)]


def asked(spark, sf):
    """Names to resolve: every supplier's nation, written in full, in part or wrongly."""
    s = read_table(spark, sf, "supplier").join(read_table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    how = F.col("s_suppkey") % 4
    return s.select("s_suppkey", F.when(how == 0, F.col("n_name")).when(how == 1, F.right("n_name", F.lit(2))).when(how == 2, F.right("n_name", F.lit(1))).otherwise("?").alias("name"))


_ASKED = "asked AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN n_name WHEN 1 THEN right(n_name, 2) WHEN 2 THEN right(n_name, 1) ELSE '?' END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query(f"""WITH {_DICT}, {_ASKED}, al AS (SELECT * FROM cur UNION ALL SELECT * FROM pre UNION ALL SELECT * FROM ali),
di AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, id) AS rn FROM al) SELECT s_suppkey, asked.name, di.id, coalesce(di.tier, -1) AS tier FROM asked LEFT JOIN di ON di.name = asked.name AND rn = 1""")
def resolve_precedence(spark, sf):
    d = R.ranked_dictionary(tiers(spark, sf))
    return asked(spark, sf).join(d, "name", "left").select("s_suppkey", "name", "id", F.coalesce("tier", F.lit(-1)).alias("tier"))


def _uniq(t):
    return f"(SELECT name, min(id) AS id FROM {t} GROUP BY name HAVING count(DISTINCT id) = 1)"


@query(f"""WITH {_DICT}, {_ASKED} SELECT s_suppkey, q.name, coalesce(c.id, p.id, l.id) AS id, CASE WHEN c.id IS NOT NULL THEN 0 WHEN p.id IS NOT NULL THEN 1 WHEN l.id IS NOT NULL THEN 2 ELSE -1 END AS method
FROM asked q LEFT JOIN {_uniq('cur')} c ON c.name = q.name LEFT JOIN {_uniq('pre')} p ON p.name = q.name LEFT JOIN {_uniq('ali')} l ON l.name = q.name""")
def resolve_unique_chain(spark, sf):
    return R.first_unique_hit(asked(spark, sf), [t.drop("ord") for t in tiers(spark, sf)]).select("s_suppkey", "name", "id", F.coalesce("method", F.lit(-1)).alias("method"))


@query(f"""WITH {_DICT}, c AS (SELECT name, id, count(*) OVER (PARTITION BY name) AS claims, row_number() OVER (PARTITION BY name ORDER BY id DESC) AS rn FROM ali) SELECT name, id, claims FROM c WHERE rn = 1""")
def settle_collisions(spark, sf):
    return R.settle_collisions(tiers(spark, sf)[2], "name", [F.desc("id")]).select("name", "id", "claims")


@query(f"""WITH {LAB}, s AS (SELECT a AS src, b AS dst FROM lab UNION ALL SELECT b, a FROM lab), g AS (SELECT src, dst, 1.0::DOUBLE AS w FROM s UNION ALL SELECT DISTINCT src, src, 1.0 FROM s),
d AS (SELECT src, sum(w) AS d FROM g GROUP BY src) SELECT g.src, g.dst, round(g.w / sqrt(x.d * y.d), 9) AS w FROM g JOIN d x ON x.src = g.src JOIN d y ON y.src = g.dst""")
def normalised_adjacency(spark, sf):
    e = settle(labelled(spark, sf).select("a", "b", F.lit(1).alias("w")), "labelled")
    return G.normalised(e).select("src", "dst", F.round("w", 9).alias("w"))


@query("""WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, l_extendedprice / 10000 AS s FROM lineitem), m AS (SELECT dst, max(s) AS m FROM e GROUP BY dst),
x AS (SELECT e.*, exp(s - m) AS z FROM e JOIN m USING (dst)), t AS (SELECT dst, sum(z) AS t FROM x GROUP BY dst)
SELECT dst, count(*) AS n, round(max(z / t), 9) AS top, round(sum(z / t * s), 6) AS pooled FROM x JOIN t USING (dst) GROUP BY dst""")
def edge_softmax(spark, sf):
    e = read_table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_extendedprice") / 10000).alias("s"))
    return G.edge_softmax(e, "s").groupBy("dst").agg(F.count("*").alias("n"), F.round(F.max("attention"), 9).alias("top"), F.round(F.sum(F.col("attention") * F.col("s")), 6).alias("pooled"))


@query("SELECT c_custkey, round(coalesce(m, 0), 6) AS mean FROM customer LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def scatter_mean(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return G.scatter_mean(o, "c_custkey", "o_totalprice", read_table(spark, sf, "customer")).select("c_custkey", F.round("mean", 6).alias("mean"))


_TRI = "tri AS (SELECT DISTINCT l_partkey AS h, l_linenumber AS r, l_suppkey AS t FROM lineitem), nam AS (SELECT DISTINCT l_partkey AS h, l_linenumber AS r, l_suppkey AS t FROM lineitem WHERE l_returnflag <> 'R'), lb AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_linestatus AS label FROM lineitem WHERE l_quantity < 25)"


@query(f"""WITH {_TRI}, go AS (SELECT r, least(h, t) AS a, greatest(h, t) AS b FROM (SELECT * FROM tri EXCEPT SELECT * FROM nam))
SELECT r, coalesce(label, 'unlabelled') AS label, count(*) AS n FROM go LEFT JOIN lb USING (a, b) GROUP BY ALL""")
def absent_triples_by_label(spark, sf):
    l = read_table(spark, sf, "lineitem")
    tri = l.select(F.col("l_partkey").alias("h"), F.col("l_linenumber").alias("r"), F.col("l_suppkey").alias("t"), "l_returnflag")
    lab = l.filter("l_quantity < 25").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), F.col("l_linestatus").alias("label"))
    return G.absent_triples(tri.select("h", "r", "t").distinct(), tri.filter("l_returnflag <> 'R'"), lab)


@query(f"WITH {_TRI} SELECT DISTINCT h, r, t FROM (SELECT h, r, t FROM tri UNION ALL SELECT t, r + 7, h FROM tri)")
def graph_with_inverses(spark, sf):
    l = read_table(spark, sf, "lineitem").select(F.col("l_partkey").alias("h"), F.col("l_linenumber").alias("r"), F.col("l_suppkey").alias("t"))
    return G.with_inverses(l, 7)
