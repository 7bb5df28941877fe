"""Operator 9: exact substring deduplication by a distributed difference cover.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier in the corpus. Only
the order of suffixes up to LENGTH bytes matters, and only whether neighbours are equal, so
ranks are replaced by names (hashes) that any task can compute by itself:

1. Sort the sample. Positions whose offset modulo ``MODULUS`` lies in the difference cover
   ``COVER`` give a tuple of ``TUPLE`` bytes. Any two positions have a common shift below
   MODULUS after which both are sampled, so two equal LENGTH-byte strings show the sample at
   least one equal tuple (TUPLE = LENGTH - MODULUS + 1). The tuples' names are dealt by value,
   sorted, and those that occur once are dropped.
   Whole texts are named by 128 bits of a cryptographic hash and compared in the same way:
   a text that occurs before needs no further look.
2. Recurse on the names that are left: a position stays only if a repeated tuple lies within
   its string, which removes unique text before any string is named.
3. Merge: the strings of the positions that stay are named, dealt by value, sorted together
   with the part of the corpus they come from, and adjacent entries are compared. All but
   the first part's entry of each run of equal names are reported back.
4. In each part, strings seen in an earlier part or earlier in the part are marked and the
   bytes under them removed.

A string's name joins two polynomials modulo 2**31 - 1 at points drawn anew for each run, so
no text can be made to collide: different strings meet with a chance of about 2**-62.

Scale: the corpus is cut by doc_id into ranges (parts) of at most some 4 MB on average, the
shuffled unit. What moves is 4 bytes per sampled tuple (1 of 7 positions) and 8 per position
that may repeat, less what compression takes, each name once per part, so a passage that a
third of all documents hold is one entry per part, in buckets that are even by hash and as
many as the bytes need. Two tuples of one bucket with equal 32 bits only keep a position for
step 3.

Edge cases: null text is empty; texts below LENGTH bytes stay whole; rows of one doc_id
are ordered by text; an empty table gives an empty result; null doc_ids come first.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounds_by_id, ending, give_back, materialize, mix64, partitions, table

LENGTH = 100
#: A perfect difference set: every residue modulo 57 is a difference of two members.
MODULUS, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
TUPLE = LENGTH - MODULUS + 1

#: The modulus of the names, 2**31 - 1. A name joins two polynomials at random points.
_PRIME = np.uint64((1 << 31) - 1)
_BLOCK = 1 << 20
#: Names that are looked up at a time.
_RUN = 1 << 17
#: Bytes of text for each bucket of names, where the table is large.
_PER_BUCKET = 48 << 20
_WHOLE = np.dtype([("a", "<u8"), ("b", "<u8")])
_POWERS: dict[int, np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """``x`` modulo _PRIME, in place, up to one _PRIME more."""
    for _ in range(2):
        low = x & _PRIME
        x >>= np.uint64(31)
        x += low
    return x


def _power(base: int, n: int) -> np.ndarray:
    """Powers 0..n-1 of ``base``, modulo _PRIME; kept for the blocks of one task."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint32)
        while len(have) < n:
            more = have.astype(np.uint64) * np.uint64(pow(base, len(have), int(_PRIME))) % _PRIME
            have = np.concatenate([have, more.astype(np.uint32)])
        _POWERS[base] = have
    return have[:n]


def new_key() -> tuple[int, int]:
    """Two random points, drawn anew for each run, so no text can be made to collide."""
    return 2 + secrets.randbelow(int(_PRIME) - 3), 2 + secrets.randbelow(int(_PRIME) - 3)


class Names:
    """Names of substrings of one block of texts: two polynomials modulo 2**31 - 1."""

    def __init__(self, data: np.ndarray, key: tuple[int, int]):
        self.key, self.sums = key, []
        for base in key:
            sums, carry, powers = np.zeros(len(data) + 1, np.uint32), np.uint64(0), _power(base, len(data))
            for at in range(0, len(data), 1 << 20):  # 2**20 terms below 2**40 keep the sum in 64 bits
                some = np.cumsum((data[at : at + (1 << 20)].astype(np.uint64) + np.uint64(1)) * powers[at : at + (1 << 20)])
                some += carry
                sums[at + 1 : at + 1 + len(some)] = _fold(some)
                carry = some[-1]
            self.sums.append(sums)

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        halves = []
        for base, sums in zip(self.key, self.sums, strict=True):
            back = _power(pow(base, -1, int(_PRIME)), len(sums))
            x = sums[start + length].astype(np.uint64) + np.uint64(2) * _PRIME - sums[start]
            x *= back[start]
            _fold(_fold(x))
            x[x >= _PRIME] -= _PRIME
            halves.append(x)
        return mix64((halves[0] << np.uint64(32)) | halves[1])


def blocks(ends: np.ndarray):
    """Runs of documents of about _BLOCK bytes: (first, last + 1)."""
    first, begin = 0, 0
    for i, end in enumerate(ends.tolist()):
        if end - begin >= _BLOCK or i == len(ends) - 1:
            yield first, i + 1
            first, begin = i + 1, end


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting: numpy's own ``unique`` hashes integers, at many times the cost."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]


def sampled(offsets: np.ndarray, length: int) -> np.ndarray:
    """Sampled positions (by offset in the block) whose tuple ends within their document."""
    total = int(offsets[-1])
    grid = (np.arange(0, total, MODULUS)[:, None] + np.array(COVER)).ravel()
    grid = grid[grid < total]
    return grid[grid + length <= offsets[np.searchsorted(offsets, grid, side="right")]] if total else grid


def split_by_bucket(bucket: np.ndarray, values: np.ndarray, n: int):
    """(bucket, its values), values ordered as given within a bucket."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    values = values[order]
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, values[cuts[b] : cuts[b + 1]]


def tuple_keys(names: Names, at: np.ndarray, n: int) -> np.ndarray:
    """Bucket in the upper and 32 bits of the name in the lower half."""
    h = names.at(at, TUPLE)
    return (((h >> np.uint64(32)) % np.uint64(n)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def planes(values: np.ndarray, width: int) -> bytes:
    """Sorted values as gaps by byte plane, compressed: the upper planes are nearly empty."""
    import pyarrow as pa

    gaps = np.diff(values, prepend=values.dtype.type(0)).astype(f">u{width}")
    return len(values).to_bytes(4, "big") + pa.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, width).T), codec="zstd", asbytes=True)


def from_planes(data: bytes, width: int) -> np.ndarray:
    import pyarrow as pa

    n = int.from_bytes(data[:4], "big")
    raw = np.frombuffer(pa.decompress(data[4:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(width, n).T).view(f">u{width}").ravel().astype(f"u{width}"), dtype=f"u{width}")


def compressed(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.compress(data, codec="zstd", asbytes=True) if data else b""


def expanded(data: bytes, size: int) -> bytes:
    import pyarrow as pa

    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


class Part:
    """One range of documents, as its row holds it."""

    def __init__(self, row: dict):
        self.ids, self.lengths = row["ids"], np.array(row["lengths"], np.int64)
        self.data = np.frombuffer(expanded(row["data"], int(self.lengths.sum())), np.uint8)
        self.ends = np.cumsum(self.lengths)

    def blocks(self):
        """(first document, its offsets within the block, bytes, position of the block)."""
        for a, b in blocks(self.ends):
            begin = int(self.ends[a - 1]) if a else 0
            yield np.concatenate([[begin], self.ends[a:b]]) - begin, self.data[begin : int(self.ends[b - 1])], begin

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """(documents of at least LENGTH bytes, 128-bit cryptographic hashes of their texts)."""
        long, data = np.flatnonzero(self.lengths >= LENGTH), self.data.tobytes()
        ends = self.ends[long]
        hashes = [hashlib.blake2b(data[b - n : b], digest_size=16).digest() for b, n in zip(ends.tolist(), self.lengths[long].tolist(), strict=True)]
        return long, np.frombuffer(b"".join(hashes), _WHOLE)

    def copies(self, bits: dict[int, bytes], n: int) -> np.ndarray:
        """True for documents whose whole text stands before, in this part or an earlier one."""
        out = np.zeros(len(self.lengths), bool)
        which, names = self.whole()
        out[which] = seen_before(names, bits, n)
        return out

    def candidates(self, repeated: np.ndarray, n: int, skip: np.ndarray, key: tuple[int, int]):
        """Per block: positions whose string holds a repeated tuple, and their names.

        Documents in ``skip`` are left out.
        """
        first = 0
        for offsets, data, begin in self.blocks():
            mine = skip[first : first + len(offsets) - 1]
            first += len(mine)
            if len(data) < LENGTH:
                continue
            names = Names(data, key)
            at = sampled(offsets, TUPLE)
            keys = tuple_keys(names, at, n)
            where = np.minimum(np.searchsorted(repeated, keys), max(len(repeated) - 1, 0))
            hit = at[repeated[where] == keys] if len(repeated) else at[:0]
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, np.maximum(hit - (LENGTH - TUPLE), 0), 1)
            np.add.at(change, hit + 1, -1)
            near = np.cumsum(change[:-1]) > 0
            room = np.zeros(len(data) + 1, np.int32)  # a string must end within its document
            long = (np.diff(offsets) >= LENGTH) & ~mine
            np.add.at(room, offsets[:-1][long], 1)
            np.add.at(room, offsets[1:][long] - LENGTH + 1, -1)
            position = np.flatnonzero(near & (np.cumsum(room[:-1]) > 0))
            yield position + begin, names.at(position, LENGTH)


def parts_of(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per range of doc_ids: part, ids, rest, lengths, data (all texts, compressed)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(c).cast("string").alias(c) for c in keep] or [F.lit(None).cast("string").alias("_")]).alias("rest"))
    cuts = np.array(bounds_by_id(docs, "doc_id"), np.int64)
    rest = docs.schema["rest"].dataType.simpleString()

    kind = f"part int, ids array<long>, rest array<{rest}>, lengths array<long>, data binary"

    def packed(part: int, t):
        import pyarrow as pa
        import pyarrow.compute as pc

        text = pc.fill_null(t.column("text"), "")
        lengths = pc.cast(pc.binary_length(text), pa.int64())
        return [part, t.column("doc_id"), t.column("rest"), lengths, compressed("".join(text.to_pylist()).encode())]

    def as_batch(rows):
        import pyarrow as pa

        lists = [pa.array([r[i].to_pylist() for r in rows], pa.list_(rows[0][i].type)) for i in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *lists, pa.array([r[4] for r in rows], pa.binary())], ["part", "ids", "rest", "lengths", "data"])

    def ranges(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            part = np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
            part[np.array(ids.is_null())] = -1
            order = np.argsort(part, kind="stable")
            at = np.flatnonzero(np.diff(part[order], prepend=-2))
            t = pa.Table.from_batches([batch]).take(pa.array(order))
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
                yield as_batch([packed(int(part[order[a]]), t.slice(a, b - a))])

    def gather(key, t):
        import pyarrow as pa

        ids, rests, texts = [], [], []
        for row in t.to_pylist():
            data, at = expanded(row["data"], sum(row["lengths"])), 0
            for i, r, n in zip(row["ids"], row["rest"], row["lengths"], strict=True):
                ids.append(i)
                rests.append(r)
                texts.append(data[at : at + n])
                at += n
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        texts = [texts[i] for i in order]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([[ids[i] for i in order]], t.schema.field("ids").type), pa.array([[rests[i] for i in order]], t.schema.field("rest").type), pa.array([[len(x) for x in texts]], pa.list_(pa.int64())), pa.array([compressed(b"".join(texts))], pa.binary())], ["part", "ids", "rest", "lengths", "data"])

    return docs.mapInArrow(ending(ranges), kind).groupBy("part").applyInArrow(gather, kind)


def repeated_tuples(parts: DataFrame, n: int, key: tuple[int, int]) -> DataFrame:
    """part, bucket, values: the part's sampled tuples that the sample holds twice or more."""
    names_key = key

    def sample(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(batch.schema.get_field_index(k))[i].as_py() for k in ("part", "ids", "lengths", "data")}
                keys = []
                for offsets, data, _ in Part(row).blocks():
                    keys.append(tuple_keys(Names(data, names_key), sampled(offsets, TUPLE), n))
                keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
                keys = keys[(keys != np.concatenate([[~keys[0]], keys[:-1]])) | _second(keys)] if len(keys) else keys  # each at most twice
                out = [(b, planes(v.astype(np.uint32), 4)) for b, v in split_by_bucket((keys >> np.uint64(32)).astype(np.int64), keys, n)]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([row["part"]] * len(out), pa.int32()), pa.array([v for _, v in out], pa.binary())], ["bucket", "part", "vals"])
        _POWERS.clear()

    def compare(key, t):
        import pyarrow as pa

        lists = [from_planes(v, 4) for v in t.column("vals").to_pylist()]
        every = np.sort(np.concatenate(lists))
        twice = distinct(every[1:][every[1:] == every[:-1]])
        part, out = [], []
        for p, v in zip(t.column("part").to_pylist(), lists, strict=True):
            v = distinct(v)
            v = v[np.isin(v, twice, assume_unique=True)]
            if len(v):
                part.append(p)
                out.append(planes(v, 4))
        return pa.table([pa.array(part, pa.int32()), pa.array([key[0].as_py()] * len(part), pa.int32()), pa.array(out, pa.binary())], ["part", "bucket", "vals"])

    return parts.mapInArrow(ending(sample), "bucket int, part int, vals binary").groupBy("bucket").applyInArrow(compare, "part int, bucket int, vals binary")


def _second(keys: np.ndarray) -> np.ndarray:
    """True at the second of a run of equal sorted values."""
    same = np.concatenate([[False], keys[1:] == keys[:-1]])
    return same & ~np.concatenate([[False], same[:-1]])


def _merged_tuples(t) -> np.ndarray:
    """All repeated tuples of a part, from its rows, as sorted keys."""
    keys = [from_planes(v, 4).astype(np.uint64) | np.uint64(b << 32) for b, v in zip(t.column("bucket").to_pylist(), t.column("vals").to_pylist(), strict=True)]
    return np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def _string_bucket(names: np.ndarray, n: int) -> np.ndarray:
    names = names["a"] if names.dtype == _WHOLE else names
    return ((names >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def _packed(names: np.ndarray) -> bytes:
    return names.tobytes() if names.dtype == _WHOLE else planes(names, 8)


def _dealt_names(names: np.ndarray, part: int, n: int) -> list[list]:
    """(bucket, part, packed names) of the distinct names of a part."""
    names = distinct(names)
    return [[b, part, _packed(v)] for b, v in split_by_bucket(_string_bucket(names, n), names, n)]


def _names_table(rows: list[list], batch: bool = False):
    import pyarrow as pa

    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))]
    return (pa.RecordBatch if batch else pa.Table).from_arrays(columns, ["bucket", "part", "vals"])


def seen_before(names: np.ndarray, bits: dict[int, bytes], n: int) -> np.ndarray:
    """True where a name stands before: earlier in ``names``, or in an earlier part by ``bits``."""
    own = distinct(names)
    earlier = np.zeros(len(own), bool)
    for b, at in split_by_bucket(_string_bucket(own, n), np.arange(len(own)), n):
        earlier[at] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=len(at)).astype(bool)
    out = np.ones(len(names), bool)
    for a in range(0, len(names), _RUN):  # in order: a name's first entry takes its answer, the others are copies
        which, first = np.unique(np.searchsorted(own, names[a : a + _RUN]), return_index=True)
        out[a + first] = earlier[which]
        earlier[which] = True
    return out


def _per_document(flags: np.ndarray, part: Part) -> np.ndarray:
    """How many flags are set in each document."""
    out, some = np.zeros(len(part.lengths), np.int64), np.flatnonzero(part.lengths)
    if len(some):
        out[some] = np.add.reduceat(flags.view(np.uint8), part.ends[some] - part.lengths[some], dtype=np.int64)
    return out


def _answers(t, kind: int) -> dict[int, bytes]:
    import pyarrow.compute as pc

    return {r["bucket"]: r["vals"] for r in t.filter(pc.equal(t.column("kind"), kind)).to_pylist()}


def _tuples_of(t) -> np.ndarray:
    import pyarrow.compute as pc

    return _merged_tuples(t.filter(pc.equal(t.column("kind"), 1)))


def _found_earlier(named: DataFrame, whole: bool) -> DataFrame:
    """part, bucket, vals: bits over the part's sorted names, set if an earlier part has it."""

    def compare(key, t):
        import pyarrow as pa

        rows = sorted(zip(t.column("part").to_pylist(), t.column("vals").to_pylist(), strict=True), key=lambda r: r[0])
        lists = [np.frombuffer(v, _WHOLE) if whole else from_planes(v, 8) for _, v in rows]
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")  # equal names stand together, the earliest part first
        ranked = every[order]
        earlier = np.zeros(len(every), bool)
        earlier[order[1:]] = ranked[1:] == ranked[:-1]
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(earlier, cuts)]
        return pa.table([pa.array([p for p, _ in rows], pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array(bits, pa.binary())], ["part", "bucket", "vals"])

    return named.groupBy("bucket").applyInArrow(compare, "part int, bucket int, vals binary")


def earlier_texts(parts: DataFrame, n: int) -> DataFrame:
    """Which whole texts of a part an earlier part has."""

    def name(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(batch.schema.get_field_index(k))[i].as_py() for k in ("part", "ids", "lengths", "data")}
                yield _names_table(_dealt_names(Part(row).whole()[1], row["part"], n), batch=True)

    return _found_earlier(parts.mapInArrow(ending(name), "bucket int, part int, vals binary"), True)


def earlier_strings(parts: DataFrame, known: DataFrame, n: int, names_key: tuple[int, int]) -> DataFrame:
    """Which strings of a part an earlier part has; ``known``: repeated tuples and texts."""

    def name(key, left, right):
        rows = []
        for row in left.select(["ids", "lengths", "data"]).to_pylist():
            part = Part(row)
            found = [names for _, names in part.candidates(_tuples_of(right), n, part.copies(_answers(right, 3), n), names_key)]
            rows += _dealt_names(np.concatenate(found) if found else np.zeros(0, np.uint64), key[0].as_py(), n)
        _POWERS.clear()
        give_back()
        return _names_table(rows)

    return _found_earlier(parts.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(name, "bucket int, part int, vals binary"), False)


def remove(parts: DataFrame, answers: DataFrame, n: int, names_key: tuple[int, int], whole_characters: bool = False) -> DataFrame:
    """doc_id, rest, n_bytes, n_removed, n_spans, kept (binary) of every document."""
    rest = parts.schema["rest"].dataType.elementType.simpleString()

    def run(key, left, right):
        import pyarrow as pa

        tables = []
        for row in left.to_pylist():
            part = Part(row)
            copies = part.copies(_answers(right, 3), n)
            found = list(part.candidates(_tuples_of(right), n, copies, names_key))
            position = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
            names = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint64)
            start = position[seen_before(names, _answers(right, 2), n)]
            begins = part.ends - part.lengths
            change = np.zeros(len(part.data) + 1, np.int32)
            change[start] += 1
            change[start + LENGTH] -= 1
            np.add.at(change, begins[copies], 1)
            np.subtract.at(change, part.ends[copies], 1)
            np.cumsum(change, out=change)
            gone = change[:-1] > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            opens[begins[(part.lengths > 0)]] = gone[begins[(part.lengths > 0)]]
            removed, spans = _per_document(gone, part), _per_document(opens, part)
            del change, position, names, found, start
            keep = part.data[~gone].tobytes()
            kept = np.concatenate([[0], np.cumsum(part.lengths - removed)])
            texts = [keep[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
            if whole_characters:
                texts = [x.decode("utf-8", "ignore").encode() for x in texts]
            tables.append(pa.table([pa.array(row["ids"], pa.int64()), left.column("rest").combine_chunks().flatten(), pa.array(part.lengths), pa.array(removed), pa.array(spans), pa.array(texts, pa.binary())], ["doc_id", "rest", "n_bytes", "n_removed", "n_spans", "kept"]))
        _POWERS.clear()
        give_back()
        return pa.concat_tables(tables) if tables else None

    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, f"doc_id long, rest {rest}, n_bytes long, n_removed long, n_spans long, kept binary")


def deduplicate(docs: DataFrame, keep: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """Every document with the bytes kept; ``keep`` names string columns to carry in ``rest``.

    ``whole_characters``: of a character that loses some of its bytes, kept loses the others.
    """
    spark, key = docs.sparkSession, new_key()
    parts = materialize(parts_of(docs, keep), "suffix-parts")
    size = parts.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    n = max(partitions(spark), -(-size // _PER_BUCKET))
    tuples = materialize(repeated_tuples(parts, n, key), "suffix-tuples")
    texts = materialize(earlier_texts(parts, n), "suffix-texts")
    known = tuples.withColumn("kind", F.lit(1)).unionByName(texts.withColumn("kind", F.lit(3)))
    strings = materialize(earlier_strings(parts, known, n, key), "suffix-strings")
    answers = known.unionByName(strings.withColumn("kind", F.lit(2)))
    return remove(parts, answers, n, key, whole_characters)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
SQL: dict[str, str] = {}
