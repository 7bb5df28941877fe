"""Operator 6: best-fit-decreasing packing of documents into windows of equal length.

A document longer than a window is first cut into full windows; the piece that is left goes,
longest first, into the open window that it fits most tightly. A segment tree over the
capacities 0..window counts the open windows that have each capacity left, so the tightest
one is found in log(window) steps.

Scale: which pieces a document has depends on its length alone. Documents are dealt by hash
to groups of about ``GROUP`` documents, and each group packs by itself: what it wastes is at
most about one window, whatever the corpus size. Nothing is packed on the driver.

Edge cases: a null or empty text is the end id alone; repeated rows are separate documents;
an empty table gives no pieces; ties in length are ordered by doc_id and checksum.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ending, materialize, table
from .tokens import Encoder

WINDOW = 4096
GROUP = 4096
VOCABULARY = "word_bpe_49k.json"


class CapacityTree:
    """Open windows by the capacity they have left; finds the least capacity that suffices."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = np.zeros(2 * self.leaves, np.int64).tolist()
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, window) of the tightest open window, if any fits."""
        count, at = self.count, size + self.leaves
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up until a right sibling holds one
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:  # down to its leftmost
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return capacity, self.windows[capacity].pop()


def best_fit_decreasing(sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each piece; ``sizes`` must be in descending order."""
    tree, opened = CapacityTree(window), 0
    number, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        found = tree.take(size)
        if found is None:
            found, opened = (window, opened), opened + 1
        left, at = found
        number[i], offset[i] = at, window - left
        if left > size:
            tree.add(left - size, at)
    return number, offset


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, release: bool = False) -> DataFrame:
    """doc_id, doc_tokens and crcs: the checksum of each window-long piece of its ids."""

    def run(batches):
        import pyarrow as pa

        encoder = Encoder.of(vocabulary)
        for batch in batches:
            ids_of, texts = batch.column(0), (x.as_py() for x in batch.column(1))  # one text at a time
            for first, ids, offsets in encoder.encode(texts):
                data, crcs = ids.astype("<u4").data, []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    crcs.append([zlib.crc32(data[i : min(i + window, b)]) for i in range(a, b, window)])
                yield pa.RecordBatch.from_arrays([ids_of.slice(first, len(crcs)), pa.array(np.diff(offsets)), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "crcs"])
        del encoder
        if release:
            Encoder.release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(ending(run), "doc_id long, doc_tokens long, crcs array<long>")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, release: bool = False) -> DataFrame:
    """One row per piece; see the query's contract for the columns.

    A worker keeps the pieces of text that its encoder has learnt for the tasks that follow; ``release`` drops
    them at the end of each task, for runs whose other stages need the memory.
    """
    cut = materialize(pieces(docs, vocabulary, window, release), "packing-pieces")
    groups = max(1, -(-cut.count() // GROUP))
    cut = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "doc_tokens", "crcs"), F.lit(groups)))

    def run(key, t):
        import pyarrow as pa

        doc, tokens = t.column("doc_id").to_numpy(zero_copy_only=False), t.column("doc_tokens").to_numpy()
        crcs = t.column("crcs").combine_chunks()
        n = -(-tokens // window)
        owner = np.repeat(np.arange(len(tokens)), n)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        start = part * window
        length = np.minimum(tokens[owner] - start, window)
        crc = crcs.flatten().to_numpy()
        order = np.lexsort((start, crc, doc[owner], -length))
        number, offset = best_fit_decreasing(length[order], window)
        owner = owner[order]
        ids = t.column("doc_id").combine_chunks().take(pa.array(owner))
        sequence = (int(key[0].as_py()) << 40) + number
        return pa.table([ids, start[order], length[order], crc[order], tokens[owner], sequence, offset], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return cut.groupBy("g").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_packing": op6_packing}
SQL: dict[str, str] = {}
