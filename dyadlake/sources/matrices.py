"""Score matrices in files: packed symmetric blocks as Parquet, and dense ``.npy`` files read by byte ranges."""

from __future__ import annotations

import ast

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

BLOCK = 256


# ---------------------------------------------------------------- packed blocks


def encoded(cells: np.ndarray, scores: np.ndarray, block: int) -> bytes:
    """A block from its known cells in order: numbers and floats of these where fewer than half are known
    (8 bytes each), else a float for each cell, NaN where unknown. The length tells which."""
    if 2 * len(cells) < block * block:
        return cells.astype("<i4").tobytes() + scores.astype("<f4").tobytes()
    data = np.full(block * block, np.nan, "<f4")
    data[cells] = scores
    return data.tobytes()


def decoded(data: bytes, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Known cells of a block, in order, and their scores."""
    if len(data) < 4 * block * block:
        k = len(data) // 8
        return np.frombuffer(data, "<i4", k), np.frombuffer(data, "<f4", k, 4 * k)
    values = np.frombuffer(data, "<f4")
    cells = np.flatnonzero(~np.isnan(values))
    return cells, values[cells]


def write_blocks(scores: DataFrame, path: str, n: int, block: int = BLOCK) -> None:
    """Writes a symmetric matrix over indices 0..n-1 from its known cells (i, j, score), in either order.

    One row per block (bi <= bj) of the upper triangle that holds a known cell (see ``encoded``: a store takes
    at most 8 bytes a known cell, however thinly they are spread); one folder per block row. A cell given
    several times keeps its largest score. Indices out of range are an error; null ones and null scores are
    left out. Tasks take ranges of blocks in order, so a folder has few files; a task holds one batch and one block.
    """
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    known = scores.filter("i is not null and j is not null and score is not null and not isnan(score)")
    d = known.select(lo.alias("i"), hi.alias("j"), F.col("score").cast("float").alias("score"))
    d = d.select(F.when((F.col("i") < 0) | (F.col("j") >= n), F.raise_error(F.lit(f"an index outside 0..{n - 1}"))).otherwise(F.col("i")).cast("long").alias("i"), "j", "score")
    cell = F.expr(f"cast((i % {block}) * {block} + j % {block} as int)")
    d = d.select(F.expr(f"cast(i div {block} as int)").alias("bi"), F.expr(f"cast(j div {block} as int)").alias("bj"), cell.alias("cell"), "score")

    def rows(bi, bj, cell, score, starts, ends) -> pa.RecordBatch:
        data = [encoded(cell[a:b], score[a:b], block) for a, b in zip(starts, ends, strict=True)]
        many = len(starts)
        return pa.RecordBatch.from_arrays([pa.array(bi[starts]), pa.array(bj[starts]), pa.array(np.full(many, n, np.int64)), pa.array(np.full(many, block, np.int32)), pa.array(data, pa.binary())], names=["bi", "bj", "n", "block", "data"])

    def pack(batches):
        held = None  # the last block so far, which the next batch may add to
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now = [np.concatenate(p) for p in zip(held, now, strict=True)] if held else now
            bi, bj, cell, score = now
            if not len(bi):
                continue
            apart = (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
            first = np.flatnonzero(np.concatenate([[True], apart | (cell[1:] != cell[:-1])]))
            score = np.maximum.reduceat(score, first)
            bi, bj, cell = bi[first], bj[first], cell[first]
            starts = np.flatnonzero(np.concatenate([[True], (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]))
            if len(starts) > 1:
                yield rows(bi, bj, cell, score, starts[:-1], starts[1:])
            held = [x[starts[-1] :] for x in (bi, bj, cell, score)]
        if held:
            yield rows(*held, np.array([0]), np.array([len(held[0])]))

    blocks = d.repartitionByRange("bi", "bj").sortWithinPartitions("bi", "bj", "cell").mapInArrow(pack, "bi int, bj int, n long, block int, data binary")
    blocks.sortWithinPartitions("bi", "bj").write.partitionBy("bi").option("parquet.block.size", 16 << 20).mode("errorifexists").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """bi, bj, n, block, data. Filters on bi choose folders, those on bj row groups."""
    return spark.read.schema("bj int, n long, block int, data binary, bi int").parquet(path)


def pair_scores(blocks: DataFrame, pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """i, j (as asked), score of each distinct asked pair; null where the matrix does not know it.

    Pairs meet their block once, as a list of cells (block * block at most); the folders of blocks that
    nobody asks for are not read (see ``only_rows``).
    """
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    d = pairs.filter("i is not null and j is not null").select("i", "j").distinct()
    row = F.floor(lo / block).cast("int")
    d = d.withColumns({"bi": row, "bj": F.floor(hi / block).cast("int"), "cell": ((lo % block) * block + hi % block).cast("int")})
    want = d.groupBy("bi", "bj").agg(F.collect_list(F.struct("i", "j", "cell")).alias("asked"))

    def pick(batches):
        for b in batches:
            i, j, cell = (b.column(c) for c in ("i", "j", "cell"))
            cells = cell.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(cell.value_lengths().to_numpy(zero_copy_only=False))
            score = np.full(len(cells), np.nan, np.float32)
            for at, (end, data) in enumerate(zip(ends, b.column("data"), strict=True)):
                raw = data.as_py()
                if raw is not None:
                    asked = cells[(ends[at - 1] if at else 0) : end]
                    have, values = decoded(raw, block)
                    where = np.minimum(np.searchsorted(have, asked), len(have) - 1)
                    score[(ends[at - 1] if at else 0) : end] = np.where(have[where] == asked, values[where], np.float32(np.nan))
            yield pa.RecordBatch.from_arrays([i.flatten().cast("int64"), j.flatten().cast("int64"), pa.array(score, mask=np.isnan(score))], names=["i", "j", "score"])

    have = only_rows(blocks, pairs.filter("i is not null and j is not null").select(row.alias("bi"))).select("bi", "bj", "data")
    return want.join(have, ["bi", "bj"], "left").select("asked.i", "asked.j", "asked.cell", "data").mapInArrow(pick, "i long, j long, score float")


def only_rows(blocks: DataFrame, asked: DataFrame, most: int = 10_000) -> DataFrame:
    """``blocks`` without the folders of block rows that ``asked`` (bi) lacks, where it names ``most`` at most;
    beyond, all folders are read and the join that follows chooses."""
    names = [r[0] for r in asked.distinct().limit(most + 1).collect()]
    return blocks.filter(F.col("bi").isin(names)) if len(names) <= most else blocks


def row_scores(blocks: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """i, j, score: all known cells of the rows ``i``, from both sides of the diagonal."""
    r = rows.filter("i is not null").select("i").distinct().withColumn("b", F.floor(F.col("i") / block).cast("int"))
    want = r.groupBy("b").agg(F.collect_list((F.col("i") % block).cast("int")).alias("asked"))

    def take(across: bool):
        def run(batches):
            for pdf in batches:
                out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
                for asked, bi, bj, size, data in pdf.itertuples(index=False):
                    cells, values = decoded(data, size)
                    i, j = cells // size, cells % size
                    own = np.zeros(size, bool)
                    own[asked] = True
                    keep = own[i] if across else own[j]
                    if bi == bj and not across:
                        keep &= i != j  # the diagonal has been taken
                    i, j = i[keep] + np.int64(bi) * size, j[keep] + np.int64(bj) * size
                    out.append((i, j, values[keep]) if across else (j, i, values[keep]))
                yield pd.DataFrame({name: np.concatenate(v) for name, v in zip(("i", "j", "score"), zip(*out, strict=True), strict=True)})

        return run

    def side(on: str, across: bool) -> DataFrame:
        d = blocks.join(want, F.col(on) == F.col("b")).select("asked", "bi", "bj", "block", "data")
        return d.mapInPandas(take(across), "i long, j long, score float")

    return side("bi", True).unionByName(side("bj", False))


def statistics(blocks: DataFrame) -> DataFrame:
    """n, cells (off the diagonal, upper triangle), known, diagonal_known, mean, sd, least, most."""

    def run(batches):
        for pdf in batches:
            diagonal, parts = 0, [np.zeros(0, np.float32)]
            for bi, bj, size, data in zip(pdf["bi"], pdf["bj"], pdf["block"], pdf["data"], strict=True):
                cells, values = decoded(data, size)
                if bi == bj:
                    off = cells // size != cells % size
                    diagonal += int((~off).sum())
                    values = values[off]
                parts.append(values)
            v = np.concatenate(parts).astype(float)
            some = len(v) > 0
            yield pd.DataFrame({"n": [int(pdf["n"].max()) if len(pdf) else 0], "d": [diagonal], "k": [len(v)], "m": [v.mean() if some else 0.0], "q": [((v - v.mean()) ** 2).sum() if some else 0.0], "lo": [v.min() if some else None], "hi": [v.max() if some else None]})

    parts = blocks.select("bi", "bj", "n", "block", "data").mapInPandas(run, "n long, d long, k long, m double, q double, lo double, hi double")
    total = parts.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.sum("k").alias("known"), F.sum("d").alias("diagonal_known"), (F.sum(F.col("k") * F.col("m")) / F.sum("k")).alias("mean"), F.sum("q").alias("_q"), F.sum(F.col("k") * F.col("m") * F.col("m")).alias("_mm"), F.min("lo").alias("least"), F.max("hi").alias("most"))
    sd = F.sqrt((F.col("_q") + F.greatest(F.col("_mm") - F.col("known") * F.col("mean") * F.col("mean"), F.lit(0.0))) / (F.col("known") - 1))
    return total.select("n", F.expr("n * (n - 1) div 2").alias("cells"), "known", "diagonal_known", "mean", F.when(F.col("known") > 1, sd).alias("sd"), "least", "most")


# ---------------------------------------------------------------- dense files


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class NpyReader(DataSourceReader):
    """One partition per block of rows; bounds on i choose rows, bounds on j the bytes inside a row."""

    def __init__(self, path: str, per_part: int):
        self.path, self.per_part = path, per_part
        with open(path, "rb") as f:
            if f.read(6) != b"\x93NUMPY":
                raise ValueError(f"{path} is no .npy file")
            wide = f.read(2)[0] > 1
            size = int.from_bytes(f.read(4 if wide else 2), "little")
            head = ast.literal_eval(f.read(size).decode("latin1"))
            self.begin = f.tell()
        if head["fortran_order"] or len(head["shape"]) != 2 or np.dtype(head["descr"]).kind != "f":
            raise ValueError("a matrix of floats in row order is expected")
        self.kind, (self.rows, self.columns) = head["descr"], head["shape"]
        self.i, self.j = (0, self.rows), (0, self.columns)

    def pushFilters(self, filters):
        """Takes bounds on i and j into the ranges; an In narrows them and is applied again above."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name not in ("i", "j") or not isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                yield f
                continue
            lo, hi = getattr(self, name)
            values = [v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None]
            if not values:
                yield f
                continue
            if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual):
                lo = max(lo, min(values) + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | In | LessThan | LessThanOrEqual):
                hi = min(hi, max(values) + (not isinstance(f, LessThan)))
            setattr(self, name, (lo, max(lo, hi)))
            if isinstance(f, In):
                yield f

    def partitions(self):
        return [_Rows(a, min(a + self.per_part, self.i[1])) for a in range(self.i[0], self.i[1], self.per_part)] or [_Rows(0, 0)]

    def read(self, part):
        lo, hi = self.j
        item = np.dtype(self.kind).itemsize
        if part.first >= part.last or lo >= hi:
            return
        with open(self.path, "rb") as f:
            for i in range(part.first, part.last):
                f.seek(self.begin + (i * self.columns + lo) * item)
                line = np.frombuffer(f.read((hi - lo) * item), self.kind).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, i)), pa.array(np.arange(lo, hi)), pa.array(line)], names=["i", "j", "score"])


class NpyMatrix(DataSource):
    """``spark.read.format("npy_matrix").load(path)``: i, j, score of a dense matrix file on a shared mount.

    Option ``rows``: rows per partition (256). Register it with ``spark.dataSource.register``; filters reach it
    with ``spark.sql.python.filterPushdown.enabled``.
    """

    @classmethod
    def name(cls):
        return "npy_matrix"

    def schema(self):
        return "i long, j long, score double"

    def reader(self, schema):
        return NpyReader(self.options["path"].removeprefix("file://"), int(self.options.get("rows", "256")))
