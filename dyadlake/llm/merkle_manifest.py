"""Operator 12: Merkle manifest of a data set as a postorder append log.

Each row is a leaf; the leaves of a tree are ordered, every 8 nodes become their parent, and nodes
are appended to the tree's log at the moment they are complete: a run of leaves, their parent, and so
on. The position of a node in that order needs no index. With ``e`` the last leaf under it:

    position(level, index) = e + e // 8 + e // 64 + ... + level,   e = min((index + 1) * 8**level, n) - 1

since e + 1 leaves end with e // 8 + e // 64 + ... parents that were complete before, and the
nodes that end with leaf e follow it from the bottom up.

1. Leaves are hashed by built-in functions in the scan; only doc_id and digests move on.
2. They are dealt by ranges of (tree, doc_id) and sorted; a leaf's place is its place within its
   part and the sum of what the parts before hold, a table of one row per part and tree.
3. Builders are aligned to 8**HEIGHT leaves. Each appends the nodes of its subtree to one segment, in
   completion order. Its topmost node is a leaf of the next stage, and so on to the root: a stage has 4,096
   times fewer rows than the one before. A subtree's log is a log of its own, so that a position in a
   segment is the same formula over the subtree's leaves.
4. Proofs go down: a builder reads the siblings on the path from its topmost node to the root once, out of
   the segments above; each row of it then adds the siblings inside its own segment, by position.
5. The trees' roots (subroots) are the leaves of one more tree, built and read in the same way.

Scale: text is read by the scan alone. What moves is about 100 bytes per row, three times. Groups have
4,096 rows at most whatever the data; no window or task spans a tree. Tables between steps are written to
the shared folder.

Edge cases: null in any column is ``-``; a null doc_id comes first and is never tampered with; rows
that share a doc_id are ordered by leaf; an empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, table

ARITY = 8
#: Levels of a builder's subtree; 8**4 leaves.
HEIGHT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_DIGEST = 32


def digest(parts) -> bytes:
    """SHA-256 over the digests' hex texts, joined."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def before(leaf: int) -> int:
    """Parents that are complete before ``leaf`` is appended."""
    total, x = 0, leaf // ARITY
    while x:
        total, x = total + x, x // ARITY
    return total


def position(level: int, index: int, n: int) -> int:
    """Place in the log of the node ``index`` of ``level`` in a tree of ``n`` leaves."""
    last = min((index + 1) * ARITY**level, n) - 1
    return last + before(last) + level


def levels(n: int) -> int:
    """Levels above the leaves, for ``n`` leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def append_log(leaves: list[bytes], height: int) -> list[bytes]:
    """The log of a subtree of ``height`` levels: its nodes in the order of their completion.

    Open runs are the only state: one list per level.
    """
    log, open_runs = [], [[] for _ in range(height + 1)]

    def close(level: int) -> None:
        node = digest(open_runs[level])
        open_runs[level].clear()
        open_runs[level + 1].append(node)
        log.append(node)

    for leaf in leaves:
        log.append(leaf)
        open_runs[0].append(leaf)
        for level in range(height):
            if len(open_runs[level]) < ARITY:
                break
            close(level)
    for level in range(height):
        if open_runs[level]:
            close(level)
    return log


def siblings(log: bytes, index: int, n: int, height: int) -> tuple[bytes, list[int]]:
    """Siblings of a leaf inside one segment, from the bottom up: their digests, joined, and one number
    per level, 16 * (own place in the run) + siblings in the run."""
    found, shape, count = [], [], n
    for level in range(height):
        first = index - index % ARITY
        run = [i for i in range(first, min(first + ARITY, count)) if i != index]
        for i in run:
            at = position(level, i, n) * _DIGEST
            found.append(log[at : at + _DIGEST])
        shape.append(16 * (index - first) + len(run))
        index, count = index // ARITY, -(-count // ARITY)
    return b"".join(found), shape


def fold(node: bytes, found: bytes, shape) -> bytes:
    """The root from a leaf and its siblings."""
    at = 0
    for s in shape:
        own, n = divmod(int(s), 16)
        run = [found[at + i * _DIGEST : at + (i + 1) * _DIGEST] for i in range(n)]
        at += n * _DIGEST
        node = digest(run[:own] + [node] + run[own:])
    return node


# ---------------------------------------------------------------- leaves and their places


def leaf_digest(docs: DataFrame, text: Column | None = None) -> Column:
    """Digest of a row (binary): each field as its number of UTF-8 bytes, ``:`` and its value."""
    parts = []
    for name in FIELDS:
        value = (text if name == "text" and text is not None else docs[name]).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def lower_ascii(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def tree_key(lang: Column) -> Column:
    """A string that orders null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("1"), lang), F.lit("0"))


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``place`` (from 0 within ``tree``, ordered by ``order``) and ``n`` (leaves of the tree)."""
    d = df.withColumn("_tie", F.monotonically_increasing_id())  # equal rows may part
    d = d.repartitionByRange(partitions(df.sparkSession), "tree", *order, "_tie").sortWithinPartitions("tree", *order, "_tie")
    d = materialize(d.drop("_tie").withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "merkle-placed")
    parts = d.groupBy("tree", "_part").agg(F.count("*").alias("_c"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "_part", "_first", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy("tree")).alias("n"))
    return d.join(parts, ["tree", "_part"]).withColumn("place", F.col("_before") + F.col("_row") - F.col("_first")).drop("_part", "_row", "_first", "_before")


# ---------------------------------------------------------------- building


def build(leaves: DataFrame, height: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """The segments of each stage, and tree, n, root.

    ``leaves``: tree, n, place, leaf. A segment: tree, n, builder, ``count`` (its leaves), ``up`` (its
    levels) and ``log`` (digests, joined, in postorder).
    """
    span = ARITY**height

    def append(stage: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("place")
            n = int(group["n"].iloc[0])
            up = min(height, max(0, levels(n) - stage * height))
            log = append_log(list(group["leaf"]), up)
            return pd.DataFrame({"tree": [group["tree"].iloc[0]], "n": [n], "builder": [int(group["place"].iloc[0]) // span], "count": [len(group)], "up": [up], "log": [b"".join(log)], "top": [log[-1]]})

        return run

    stages, stage, now = [], 0, leaves.select("tree", "n", "place", "leaf")
    while True:
        grouped = now.withColumn("builder", F.expr(f"place div {span}")).groupBy("tree", "builder")
        made = grouped.applyInPandas(append(stage), "tree string, n long, builder long, count int, up int, log binary, top binary")
        made = materialize(made, f"merkle-segments-{stage}")
        stages.append(made.select("tree", "n", "builder", "count", "up", "log"))
        now = made.select("tree", "n", F.col("builder").alias("place"), F.col("top").alias("leaf"))
        if made.filter("builder > 0").isEmpty():  # every tree has come down to one node
            return stages, now.select("tree", "n", F.col("leaf").alias("root"))
        stage += 1


def log_nodes(stages: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """The whole log of each tree, one row per node: tree, position, level, node, digest."""
    span = ARITY**height

    def rows(stage: int):
        def run(batches):
            for pdf in batches:
                out = []
                for tree, n, builder, count, up, log in pdf.itertuples(index=False):
                    here = int(count)
                    for level in range(0 if stage == 0 else 1, up + 1):
                        width = -(-here // ARITY**level)
                        for i in range(width):
                            at = position(level, i, here) * _DIGEST
                            whole, node = level + stage * height, int(builder) * span // ARITY**level + i
                            out.append((tree, position(whole, node, int(n)), whole, node, log[at : at + _DIGEST]))
                yield pd.DataFrame(out, columns=["tree", "position", "level", "node", "digest"])

        return run

    all_ = None
    for stage, s in enumerate(stages):
        nodes = s.select("tree", "n", "builder", "count", "up", "log").mapInPandas(rows(stage), "tree string, position long, level int, node long, digest binary")
        all_ = nodes if all_ is None else all_.unionByName(nodes)
    return all_


# ---------------------------------------------------------------- proofs


def proofs(leaves: DataFrame, stages: list[DataFrame], keep: list[str], height: int = HEIGHT) -> DataFrame:
    """``keep``, found, shape: each leaf's siblings up to its tree's root.

    They are read from the segments; the path above a builder once per builder, from the top down.
    """
    span = ARITY**height

    def read(columns: list[str]):
        def run(rows: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
            log, above = bytes(segment["log"].iloc[0]), bytes(segment["above"].iloc[0])
            count, up, bits = int(segment["count"].iloc[0]), int(segment["up"].iloc[0]), list(segment["above_shape"].iloc[0])
            got = [siblings(log, int(p) % span, count, up) for p in rows["place"]]
            return rows[columns].assign(found=[f + above for f, _ in got], shape=[s + bits for _, s in got])

        return run

    paths = None
    for stage in reversed(range(len(stages))):
        s = stages[stage].drop("n")
        if paths is None:
            s = s.select("*", F.unhex(F.lit("")).alias("above"), F.array().cast("array<int>").alias("above_shape"))
        else:
            s = s.join(paths, ["tree", "builder"])
        if stage:
            rows, columns, types = stages[stage - 1].select("tree", F.col("builder").alias("place")), ["tree", "place"], "tree string, place long"
        else:
            kinds = dict(leaves.dtypes)
            rows, columns, types = leaves.select("place", *dict.fromkeys(["tree", *keep])), keep, ", ".join(f"`{c}` {kinds[c]}" for c in keep)
        rows = rows.withColumn("builder", F.expr(f"place div {span}"))
        out = rows.groupBy("tree", "builder").cogroup(s.groupBy("tree", "builder")).applyInPandas(read(columns), f"{types}, found binary, shape array<int>")
        if not stage:
            return out
        paths = materialize(out.select("tree", F.col("place").alias("builder"), F.col("found").alias("above"), F.col("shape").alias("above_shape")), f"merkle-paths-{stage}")
    raise ValueError("no stages")


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, tampered, subroot, root (binary), found, shape: one row per row of ``docs``.

    ``found`` and ``shape`` are the proof: siblings from the leaf to the root, over the tree of the row's
    lang and the tree of all langs. ``tampered`` is the leaf of the row with its text's A-Z in lower
    case, where 3 divides the CRC-32 of its doc_id; null elsewhere.
    """
    changed = F.crc32(docs["doc_id"].cast("string")) % 3 == 0
    leaves = docs.select("doc_id", docs["doc_id"].cast("string").alias("id"), tree_key(docs["lang"]).alias("tree"), leaf_digest(docs).alias("leaf"), F.when(changed, leaf_digest(docs, lower_ascii(docs["text"]))).alias("tampered"))
    leaves = materialize(placed(leaves, ["doc_id", "leaf"]), "merkle-leaves")
    stages, roots = build(leaves, height)
    tops = roots.select(F.col("tree").alias("lang_tree"), F.lit("").alias("tree"), F.col("root").alias("leaf"))
    tops = materialize(placed(tops, ["lang_tree"]), "merkle-subroots")
    top_stages, top = build(tops, height)
    inside = proofs(leaves, stages, ["tree", "id", "leaf", "tampered"], height)  # pandas would make a null among longs a float
    over = proofs(tops, top_stages, ["lang_tree", "leaf"], height)
    over = over.select(F.col("lang_tree").alias("tree"), F.col("leaf").alias("subroot"), F.col("found").alias("_found"), F.col("shape").alias("_shape"))
    first = top.first()  # one row, or none for an empty table
    over = materialize(over.withColumn("root", F.lit(bytes(first["root"]) if first else None).cast("binary")), "merkle-over")
    d = inside.join(over, "tree")
    return d.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "leaf", "tampered", "subroot", "root", F.concat("found", "_found").alias("found"), F.concat("shape", "_shape").alias("shape"))


def verified(proved: DataFrame) -> DataFrame:
    """The digest columns in lower-case hex, and what folding the tampered, else the own, leaf gives."""

    def run(batches):
        for pdf in batches:
            found, leaf = pdf.pop("found"), pdf.pop("tampered")
            leaf = leaf.where(leaf.notna(), pdf["leaf"])
            pdf["proof_sha256"] = [hashlib.sha256(f.hex().encode()).hexdigest() for f in found]
            pdf["folded_root"] = [fold(x, f, s) for x, f, s in zip(leaf, found, pdf.pop("shape"), strict=True)]
            for c in ("leaf", "subroot", "root", "folded_root"):
                pdf[c] = [x.hex() for x in pdf[c]]
            yield pdf

    kind = dict(proved.dtypes)["doc_id"]
    d = proved.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return d.withColumns({"doc_id": F.col("doc_id").cast(kind), "verified": F.col("folded_root") == F.col("root")})


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(manifest(table(spark, sf_dir, "documents").select(*FIELDS)))


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in (*FIELDS[:-1], text)) + ")"


def _sql_tree(name: str, depth: int) -> str:
    """Tables of a forest over ``name``_0 (tree, i, h): nodes and the siblings beside them by level, and the roots."""
    out, root = [], []
    for k in range(depth + 1):
        out.append(f"{name}c{k} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {name}_{k})")
        root.append(f"SELECT tree, h FROM {name}c{k} WHERE c = 1")
        if k < depth:
            side = "coalesce(string_agg(h, '') OVER (PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN {}), '')"
            out.append(f"{name}s{k} AS (SELECT tree, i, {side.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS a, {side.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS b FROM {name}c{k} WHERE c > 1)")
            out.append(f"{name}_{k + 1} AS (SELECT tree, i // 8 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}c{k} WHERE c > 1 GROUP BY tree, i // 8)")
    return ", ".join(out) + f", {name}_root AS ({' UNION ALL '.join(root)})"


def _sql_fold(name: str, depth: int, base: str) -> str:
    """``base`` (tree, i, f, proof) folded level by level to the root of its tree."""
    out = []
    for k in range(depth):
        came = base if k == 0 else f"{base}{k}"
        out.append(f"{base}{k + 1} AS (SELECT x.* REPLACE (CASE WHEN s.a IS NULL THEN x.f ELSE sha256(s.a || x.f || s.b) END AS f, x.proof || coalesce(s.a || s.b, '') AS proof) FROM {came} x LEFT JOIN {name}s{k} s ON s.tree = x.tree AND s.i = x.i // {8**k})")
    return ", ".join(out)


_DEPTH, _OVER = 7, 3  # levels in the SQL: up to 8**7 rows in a lang, 8**3 langs
_CRC = "xor(list_reduce(list_prepend(4294967295, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda q, z: CASE WHEN q & 1 = 1 THEN xor(q >> 1, 3988292384) ELSE q >> 1 END)), 4294967295)"
_UPPER = "".join(map(chr, range(65, 91)))
_SQL = f"""WITH d AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {_sql_leaf("text")} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_sql_leaf(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} END AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
n_0 AS (SELECT tree, i, leaf AS h FROM p), {_sql_tree("n", _DEPTH)},
u AS (SELECT tree AS lang_tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i FROM n_root),
m_0 AS (SELECT '' AS tree, i, subroot AS h FROM u), {_sql_tree("m", _OVER)},
w AS (SELECT doc_id, leaf, tree, i, coalesce(tampered, leaf) AS f, '' AS proof FROM p), {_sql_fold("n", _DEPTH, "w")},
v AS (SELECT '' AS tree, u.i, w{_DEPTH}.* EXCLUDE (tree, i), subroot FROM w{_DEPTH} JOIN u ON u.lang_tree = w{_DEPTH}.tree), {_sql_fold("m", _OVER, "v")}
SELECT doc_id, leaf, subroot, m_root.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = m_root.h AS verified FROM v{_OVER}, m_root"""

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
SQL = {"op12_merkle_manifest": _SQL}
