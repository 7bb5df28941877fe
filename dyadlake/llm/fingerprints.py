"""Operator 2: Merkle fingerprints of documents.

A text is a tree: the root over sections, a section over paragraphs (lines), a paragraph
over clauses. A clause ends after a word chosen by its own hash (one in ``CLAUSE``) or with
its paragraph; a section ends at an empty line or after a paragraph chosen by its hash (one
in ``SECTION``). Boundaries thus move with the text, and an edit changes the nodes above the
clauses it touches and no others. Leaves are cryptographic hashes of their bytes, every other
node is one of its children's hashes in order, so equal roots mean equal texts.

The fingerprint is a string ``root/section;paragraph:clause.size:clause.size;...``: the root in
full (128 bits), the other nodes shortened, each clause with its bytes. Two fingerprints are
compared from the top: sections that both hold need no further look, of the others the
paragraphs are matched, of the rest the clauses. What stays unmatched are the edits.

Likeness of two fingerprints: the bytes in nodes that both hold (as multisets), times two,
over the bytes of both; 1 for two empty texts. It is computed from the two strings alone.

Scale: documents meet their successor without a global order in one task: ranges of doc_id
of about equal rows and bounded bytes are dealt out, and a range also gets the first document
of the next one. One shuffle of the text.

Edge cases: null text is empty; rows of one doc_id are ordered by text; null doc_ids come
first; the successor of the last document is the first, a lone one its own; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PUNCTUATED, bounds_by_id, segment_hashes, table, text_buffers

CLAUSE = 8
SECTION = 8
#: Bytes of text that a task turns into trees at a time.
RUN_BYTES = 4 << 20
_SIZE = re.compile(r"\.(\d+)")


def _node(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def fingerprints(texts: list[str]) -> list[str]:
    """Merkle trees of texts, as strings."""
    import pyarrow as pa

    data, offsets = text_buffers(pa.array(texts, pa.string()))
    # A clause ends at a line end, at the end of its text, or after a chosen word.
    gap = PUNCTUATED[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[True], gap[:-1]]) if len(data) else gap
    starts = np.flatnonzero(~gap & (before | first[:-1]))
    after = np.concatenate([gap[1:], [True]]) if len(data) else gap
    ends = np.flatnonzero(~gap & (after | first[1:])) + 1
    chosen = ends[segment_hashes(data, starts, ends) % np.uint64(CLAUSE) == 0]
    cut = np.zeros(len(data) + 1, bool)
    cut[chosen] = True
    cut[np.flatnonzero(data == 0x0A) + 1] = True
    cut[offsets] = True
    at = np.flatnonzero(cut)
    of, at = np.searchsorted(at, offsets).tolist(), at.tolist()
    raw, known, out = data.tobytes(), {}, []  # clauses repeat between a text and its edited text
    for a, b in zip(of[:-1], of[1:], strict=True):
        sections, section, paragraph = [], [], []
        for k in range(a, b):
            clause = raw[at[k] : at[k + 1]]
            leaf = known.get(clause)
            if leaf is None:
                digest = _node(clause)
                leaf = known[clause] = (digest, f":{digest[:4].hex()}.{len(clause)}")
            paragraph.append(leaf)
            if clause.endswith(b"\n") or k == b - 1:
                node = _node(b"".join([x[0] for x in paragraph]))
                section.append((node, ";" + node[:4].hex() + "".join([x[1] for x in paragraph])))
                if clause == b"\n" and len(paragraph) == 1 or node[15] % SECTION == 0 or k == b - 1:
                    node = _node(b"".join([x[0] for x in section]))
                    sections.append((node, "/" + node[:8].hex() + "".join([x[1] for x in section])))
                    section = []
                paragraph = []
        out.append(_node(b"".join([x[0] for x in sections])).hex() + "".join([x[1] for x in sections]))
    return out


def _bytes(node: str) -> int:
    """Bytes of text under a section, paragraph or clause of a fingerprint."""
    return sum(map(int, _SIZE.findall(node)))


def unmatched(a: str, b: str) -> tuple[list[str], list[str]]:
    """The clauses (hash.size) that one fingerprint holds beyond the other's, from the top.

    Equal roots have none; equal sections, then equal paragraphs drop out with all below.
    """
    if a[:32] == b[:32]:
        return [], []
    left, right = [a], [b]
    for mark in "/;:":
        x, y = (Counter([n for node in nodes for n in node.split(mark)[1:]]) for nodes in (left, right))
        both = x & y
        left, right = list((x - both).elements()), list((y - both).elements())
    return left, right


def likeness(a: str, b: str) -> float:
    """Likeness (0 to 1) of two fingerprints, from the strings alone."""
    if a[:32] == b[:32]:
        return 1.0
    left, right = unmatched(a, b)
    total = _bytes(a) + _bytes(b)
    lost = sum(int(x.rsplit(".", 1)[1]) for x in (*left, *right))
    return (total - lost) / total if total else 1.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Byte spans of the second text (start, end) whose clauses the first one lacks."""
    new, out, at = Counter(unmatched(a, b)[1]), [], 0
    for clause in [c for section in b.split("/")[1:] for paragraph in section.split(";")[1:] for c in paragraph.split(":")[1:]]:
        size = int(clause.rsplit(".", 1)[1])
        if new[clause] > 0:
            new[clause] -= 1
            if out and out[-1][1] == at:
                out[-1] = (out[-1][0], at + size)
            else:
                out.append((at, at + size))
        at += size
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, likeness to both neighbours, and
    ``edit_start``: the first byte at which the trees locate the edit (null: none)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = np.array(bounds_by_id(docs, "doc_id"), np.int64)

    def part_of(ids):
        part = np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right").astype(np.int64)
        part[np.array(ids.is_null(), bool)] = -1
        return part

    def mark(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(part_of(batch.column(0))), batch.column(0)], ["part", "doc_id"])

    # The first doc_id of each range, at most one row per range, tells which rows a range lends to the one before.
    heads = sorted((r["part"], r["first"]) for r in docs.select("doc_id").mapInArrow(mark, "part long, doc_id long").groupBy("part").agg(F.min("doc_id").alias("first")).collect())
    before = {part: heads[i - 1][0] for i, (part, _) in enumerate(heads)}
    first = {part: f for part, f in heads}

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            part, ids = part_of(batch.column(0)), batch.column(0).to_pylist()
            lent = np.array([i for i, (p, d) in enumerate(zip(part.tolist(), ids, strict=True)) if first[p] == d], np.int64)
            for rows, to, own in ((np.arange(len(part)), part, True), (lent, np.array([before[p] for p in part[lent].tolist()], np.int64), False)):
                if len(rows):
                    t = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(to), *t.columns, pa.array([own] * len(rows))], ["part", "doc_id", "text", "own"])

    def run(key, t):
        import pyarrow as pa
        import pyarrow.compute as pc

        t = t.set_column(2, "text", pc.fill_null(t.column("text"), ""))
        rows = t.take(pc.sort_indices(t, [("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))
        own, lent = rows.filter(rows.column("own")), rows.filter(pc.invert(rows.column("own")))
        if not own.num_rows:
            return pa.table([pa.array([], f.type) for f in SCHEMA], schema=SCHEMA)
        out = []
        texts = pa.chunked_array([*own.column("text").chunks, *lent.column("text").slice(0, 1).chunks], pa.string())
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        a = 0
        while a < own.num_rows:
            b = min(max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + RUN_BYTES))), own.num_rows)
            mine = texts.slice(a, b + 1 - a).to_pylist()
            new = [edited(x, y) for x, y in zip(mine[:-1], mine[1:], strict=True)]
            prints = fingerprints([*mine, *new])
            prints, after = prints[: len(mine)], prints[len(mine) :]
            spans = [edits(x, y) for x, y in zip(prints, after, strict=False)]
            columns = [own.column("doc_id").slice(a, b - a).combine_chunks(), [len(x) for x in mine[:-1]], [hashlib.sha256(x.encode()).hexdigest() for x in new], prints[:-1], after]
            columns += [[likeness(x, y) for x, y in zip(prints, after, strict=False)], [likeness(x, y) for x, y in zip(prints[:-1], prints[1:], strict=True)], [s[0][0] if s else None for s in spans]]
            out.append(pa.table([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA))
            a = b
        return pa.concat_tables(out)

    import pyarrow as pa

    SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edit_start", pa.int64())])
    dealt = docs.mapInArrow(deal, "part long, doc_id long, text string, own boolean")
    return dealt.groupBy("part").applyInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_start long")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


QUERIES = {"op2_fingerprints": op2_fingerprints}
SQL: dict[str, str] = {}
