"""Helpers that every operator of this subpackage shares.

Nothing here holds more than one Arrow batch (or one bounded group) in memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import place

#: White space that separates words, everywhere in this subpackage (ASCII only).
WORD = r"[^\x20\x09-\x0D]+"

#: Options of the session while an intermediate table is written: the shuffle files of a query
#: go when it ends, and Arrow batches of whole texts stay some MB on both sides of a Python task.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark (the path may be in a store only Spark opens)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    The copy survives the loss of any executor. It is for intermediate tables that are
    read more than once. The write's shuffle files go when it has ended, the copy with
    ``operators.lineage.clear`` or ``scope``.
    """
    spark = df.sparkSession
    at = place(spark, what)
    before = {name: spark.conf.get(name, None) for name in _WRITING}
    for name, value in _WRITING.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(at)
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns memory that a task has freed to the system.

    Python workers live on between stages; what their allocators keep would add to the peak
    of whatever stage comes next.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def ending(run):
    """A mapInArrow function that gives back its memory when its partition has ended."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer over uint64, in place where possible."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Segments of up to this many bytes are mixed as arrays; longer ones go to blake2b each.
_SHORT = 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def segment_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``data[start:end]`` (uint8).

    Eight bytes at a time are mixed in by a function that is not linear, so that regular
    texts, such as a Thue-Morse word and its complement, do not meet.
    """
    size = end - start
    h = mix64(size.astype(np.uint64) + np.uint64(0xA24BAED4963EE407))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each position on
    for at in range(0, _SHORT, 8):
        on = np.flatnonzero((size > at) & (size <= _SHORT))
        if not len(on):
            break
        block = eight[start[on] + at] & _MASKS[np.minimum(size[on] - at, 8)]
        h[on] = mix64((h[on] ^ mix64(block + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(at + 1))
    long = np.flatnonzero(size > _SHORT)
    if len(long):
        raw = data.tobytes()
        h[long] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return h


#: 1 for the bytes that separate words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: 1 for all ASCII that is no letter or digit.
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Lower-cases A-Z and leaves all other bytes.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in ``data``; and word offsets (n + 1) per text."""
    data = _LOWER[data] if lower else data
    solid = np.empty(len(data) + 1, bool)
    solid[:-1] = ~separators[data]
    solid[-1] = False
    first = np.zeros(len(data) + 1, bool)  # a text's first byte never continues the text before
    first[offsets[:-1]] = True
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first))
    ends = np.flatnonzero(before & (~solid | first))
    return segment_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, and offsets per text.

    A text of 1 to k-1 words has its whole sequence as its only shingle.
    """
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(offsets[:-1] - out_offsets[:-1], count) + np.arange(out_offsets[-1])
    size = np.repeat(np.minimum(n, k), count)
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        use = size > i
        if use.all():
            out = out * np.uint64(0xC6A4A7935BD1E995) + words[at + i]
        else:
            out[use] = out[use] * np.uint64(0xC6A4A7935BD1E995) + words[at[use] + i]
    return mix64(out + size.astype(np.uint64)), out_offsets


def bounds_by_id(df: DataFrame, column: str, text: str = "text", least: int = 512, most_bytes: int = 4 << 20) -> list[int]:
    """Cut points that split ``column`` into ranges of about equal rows.

    Four ranges per shuffle partition, more where these would hold over ``most_bytes`` of
    ``text`` on average; on small tables fewer, of ``least`` rows, but no fewer than partitions.
    """
    most = partitions(df.sparkSession)
    rows, size = df.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    n = max(min(4 * most, max(most, -(-rows // least))), -(-(size or 0) // most_bytes))
    if n < 2:
        return []
    rows = df.select(F.percentile_approx(column, F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(20 * n)).alias("cuts")).first()
    return sorted(set(rows["cuts"] or []))
