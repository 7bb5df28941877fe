"""Operator 7: token files, Arrow IPC with fixed-size-list batches.

All ids, each document followed by the end id, stand in ascending doc_id order and are cut
into equal-length sequences. A file holds record batches of (input_ids: fixed_size_list
<uint16 or uint32>[L], mask: fixed_size_list<bool>[L]); the mask is false on the padding of
the file's last sequence. Row i of a batch starts at byte i * L * width of its buffer, so a
memory-mapped file gives any sequence without copying. A second IPC file beside it is its
index: doc_id, start (in the file's ids) and n_tokens.

Scale: the corpus is cut by doc_id into ranges of about equal rows, several per shuffle
partition; each range is one task that tokenises, writes its two files (to a name of its
own attempt, then renamed) and returns one manifest row. Global starts are prefix sums over
the manifest. A rerun task writes new files; the manifest names those that count.

Edge cases: null text is the end id alone; rows of one doc_id (or of none: null sorts first)
are ordered by text; an empty table writes no file. The folder is ``spark.checkpoint.dir``
or below, opened in tasks through pyarrow's file systems (file, hdfs, s3, gs URIs).
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import place
from .common import bounds_by_id, materialize, partitions, table
from .tokens import Encoder

VOCABULARY = "byte_bpe_50k.json"
LENGTH = 2048
ROWS_PER_BATCH = 512


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Appends flat ids and writes full record batches of ``length``-long sequences."""

    def __init__(self, sink, length: int, wide: bool):
        import pyarrow as pa

        self.pa, self.length, self.kind = pa, length, pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("input_ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.kind.to_pandas_dtype()))
        self.n += len(ids)
        if self.n >= ROWS_PER_BATCH * self.length:
            self._write(self.n // self.length)

    def _write(self, rows: int, padded: int = 0) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint16)
        use = rows * self.length
        mask = np.ones(use, bool)
        if padded:
            ids = np.concatenate([ids, np.zeros(padded, ids.dtype)])
            mask[-padded:] = False
        pa = self.pa
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[:use]), self.length) for x in (ids, mask)]
        for at in range(0, rows, ROWS_PER_BATCH):
            self.out.write_batch(pa.RecordBatch.from_arrays([x.slice(at, ROWS_PER_BATCH) for x in lists], schema=self.schema))
        self.waiting, self.n = [ids[use:]], len(ids) - use

    def close(self) -> None:
        if self.n:
            self._write(-(-self.n // self.length), -self.n % self.length)
        self.out.close()


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """Writes the files and returns the manifest: part, path, n_docs, n_tokens, base."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = np.array(bounds_by_id(docs, "doc_id"), np.int64)

    def ranges(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            part = np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right").astype(np.int32)
            part[np.array(ids.is_null())] = -1
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], ["part", "doc_id", "text"])

    def encode(key, t):
        import uuid

        import pyarrow as pa

        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        encoder, name = Encoder.of(vocabulary), f"{key[0].as_py() + 1:08d}-{uuid.uuid4().hex}"
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        counts, width = [], encoder.tokenizer.get_vocab_size() > 1 << 16
        with store.open_output_stream(f"{root}/.{name}.ids") as sink:
            writer = SequenceWriter(sink, length, width)
            for batch in t.select(["text"]).to_batches(max_chunksize=2048):
                for _, ids, offsets in encoder.encode(x.as_py() for x in batch.column(0)):
                    writer.add(ids)
                    counts.append(np.diff(offsets))
            writer.close()
        n = np.concatenate(counts)
        index = pa.table([t.column("doc_id"), pa.array(np.cumsum(n) - n), pa.array(n)], ["doc_id", "start", "n_tokens"])
        with store.open_output_stream(f"{root}/.{name}.index") as sink, pa.ipc.new_file(sink, index.schema) as out:
            out.write_table(index)
        for kind in ("ids", "index"):
            store.move(f"{root}/.{name}.{kind}", f"{root}/{name}.{kind}.arrow")
        return pa.table([pa.array([key[0].as_py()], pa.int32()), [f"{folder}/{name}"], [len(n)], [int(n.sum())]], ["part", "path", "n_docs", "n_tokens"])

    dealt = docs.mapInArrow(ranges, "part int, doc_id long, text string")
    manifest = dealt.groupBy("part").applyInArrow(encode, "part int, path string, n_docs long, n_tokens long")
    manifest = materialize(manifest, "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """Reads every document back from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    spread = manifest.repartition(max(partitions(spark), 1), "part")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                store, path = _store(row["path"])
                with store.open_input_file(f"{path}.index.arrow") as f:
                    index = pa.ipc.open_file(f).read_all()
                with store.open_input_file(f"{path}.ids.arrow") as f:
                    file = pa.ipc.open_file(f)
                    crcs = _checksums(file, index.column("start").to_numpy(), index.column("n_tokens").to_numpy())
                start = pa.array(index.column("start").to_numpy() + row["base"])
                for out in pa.table([index.column("doc_id"), start, index.column("n_tokens"), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"]).to_batches(max_chunksize=10_000):
                    yield out

    return spread.select("path", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _checksums(file, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """crc32 of each document's ids, reading one record batch at a time."""
    out, at, crc = np.zeros(len(n), np.int64), 0, 0
    seen = 0  # ids in the batches read before
    for k in range(file.num_record_batches):
        batch = file.get_batch(k)
        ids = batch.column(0).flatten().to_numpy()
        mask = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        data = ids[mask].astype("<u4").data
        size = len(data)
        while at < len(n):
            a, b = max(start[at] - seen, 0), min(start[at] + n[at] - seen, size)
            crc = zlib.crc32(data[a:b], crc)
            if start[at] + n[at] > seen + size:
                break
            out[at], at, crc = crc, at + 1, 0
        seen += size
    return out


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = place(spark, "token-files")
    return read(write(table(spark, sf_dir, "documents"), folder))


QUERIES = {"op7_token_files": op7_token_files}
SQL: dict[str, str] = {}
