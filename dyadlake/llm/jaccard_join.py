"""Operator 3: n-gram Jaccard self-join with set-relation skipping.

A document is the set of its distinct 4-word shingles (64-bit hashes). Two link when their
Jaccard similarity is at least ``NUM`` / ``DEN``. Result: one row per document with its
component.

Index. In an order that puts shingles of many prefixes last, two linked sets share one of
their first n - ceil(t n) + 1 shingles (prefix filter), and of any first m shingles a set
shares all but n - ceil(t n) with a partner. The first ``DEPTH`` prefix lengths make an
inverted index dealt by shingle; a smaller partner may index fewer of them (``LEAST_LIVE``).
A list is cut into blocks of equal set size. Of a block only its least position matters: a
block whose best entry leaves too little room behind for the overlap that two sizes need is
skipped whole, so a list costs as many steps as it has sizes, whatever its length. Entries
without a possible partner drop out, and so do sets with too few left; the sets that remain
are counted once more with all their shingles, among themselves.

Answers. Equal sets are one class. Each class has one home, the longest list in which it may
link; a home is cut into cells of at most ``CELL`` sets and ``FAMILY`` shingles. In its cell a
set is written as a leader's set plus and minus a difference (the first leader is the home's
own, sent to each of its cells). Overlaps with the leaders are computed once; those of any
two sets follow from them by the differences alone. Links inside cells give components.
Then only pairs of cells that still share a list with sets of different components meet,
each such pair once however many lists it shares, and what is sent for a set is its
difference, with the leaders' sets once per pair of cells: answers that follow from the
components are skipped, the others are derived from the leaders' answers.

Scale: hot shingles go last in the order (at most ``HOT`` of them are broadcast, by
construction: each stands in ``cut`` prefixes and cut grows with the corpus). A family of any
size is sent once to its cells, and again only as differences. Components come from star
contractions over a spanning forest of the links.

Edge cases: null, empty or wordless text is an empty set and links with nothing; texts of
1 to 3 words are one shingle; rows of equal doc_id are separate documents; a null doc_id
counts after all others (a component of such rows alone has a null id); an empty table gives
an empty result. Shingles and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, ending, give_back, materialize, mix64, partitions, shingle_hashes, table, text_buffers, word_hashes

NUM, DEN, WORDS = 85, 100, 4
DEPTH = 2
HOT = 1_000_000
FAMILY = 1 << 17
CELL = 512
SLICE = 500
#: Rows (doc_id, class) of sets to compare that are broadcast at most, some 24 MB.
SENT = 1_000_000
#: Leaders that a cell looks for; sets far from all of these stand by themselves.
LEADERS = 16

#: Least number of index entries with a partner that a linked set of n shingles has: all but
#: n - ceil(t n) of its first DEPTH prefixes, unless its smallest possible partner indexes fewer.
_SMALLEST = f"ceil({NUM} * n / {DEN})"
LEAST_LIVE = f"least(least(n, {DEPTH} * (n - {_SMALLEST} + 1)) - (n - {_SMALLEST}), {DEPTH} * ({_SMALLEST} - ceil({NUM} * {_SMALLEST} / {DEN}) + 1))"


def shingle_sets(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending (flat), and offsets."""
    words, at = word_hashes(*text_buffers(column))
    grams, at = shingle_hashes(words, at, WORDS)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(at) - 1))])


def class_ids(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash per set, the same for equal sets."""
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix64(grams + np.uint64(0x51_7CC1_B727_2202)), out=sums[1:])
    return mix64(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def prefix_lengths(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - -(-NUM * n // DEN) + 1, 0)


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap at which sets of these sizes link."""
    return -(-NUM * (a + b) // (NUM + DEN))


def heads(at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the first ``lengths`` entries of each run, owner of each)."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return np.repeat(at[:-1] - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(owner)), owner


def _slices(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            yield batch.slice(a, SLICE)


def _dealt(bucket: np.ndarray, columns: list[np.ndarray], n: int):
    """(bucket, packed columns) for each bucket with rows."""
    import pyarrow as pa

    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        raw = b"".join(c[cuts[b] : cuts[b + 1]].tobytes() for c in columns)
        yield b, len(raw), pa.compress(raw, codec="lz4", asbytes=True)


def _undealt(t, kinds: list[str]) -> list[np.ndarray]:
    import pyarrow as pa

    out: list[list[np.ndarray]] = [[] for _ in kinds]
    width = sum(np.dtype(k).itemsize for k in kinds)
    for size, data in zip(t.column("size").to_pylist(), t.column("vals").to_pylist(), strict=True):
        raw, at, n = pa.decompress(data, decompressed_size=size, codec="lz4", asbytes=True), 0, size // width
        for i, k in enumerate(kinds):
            out[i].append(np.frombuffer(raw, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(x) for x in out]


BLOBS = "bucket int, size long, vals binary"


def _blob_batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "size", "vals"])


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), n (set size), cls for every document."""

    def run(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            grams, at = shingle_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(at)), pa.array(class_ids(grams, at))], ["doc_id", "h", "n", "cls"])

    return docs.withColumn("h", F.xxhash64("text")).mapInArrow(ending(run), "doc_id long, h long, n long, cls long")


def hot_shingles(docs: DataFrame, n: int, cut: int) -> np.ndarray:
    """Shingles that stand in more than ``cut`` prefixes (in plain hash order), ascending."""

    def count(batches):
        for batch in _slices(batches):
            grams, at = shingle_sets(batch.column(1))
            own, times = np.unique(grams[heads(at, prefix_lengths(np.diff(at)))[0]], return_counts=True)
            yield _blob_batch(list(_dealt((own % np.uint64(n)).astype(np.int64), [own, times.astype(np.uint16)], n)))

    def total(key, t):
        import pyarrow as pa

        own, times = _undealt(t, ["u8", "u2"])
        own, which = np.unique(own, return_inverse=True)
        many = own[np.bincount(which, times) > cut]
        return pa.table([pa.array([many.tobytes()], pa.binary())], ["hot"])

    rows = docs.mapInArrow(ending(count), BLOBS).groupBy("bucket").applyInArrow(total, "hot binary").filter(F.length("hot") > 0).collect()
    return np.sort(np.concatenate([np.frombuffer(r["hot"], np.uint64) for r in rows])) if rows else np.zeros(0, np.uint64)


def possible(grams, n, position):
    """Of index entries sorted by (shingle, size, position), one per set: which have a
    partner by size, and which can link with this shingle as the first that both hold.

    For a link both entries lie in their prefixes and leave enough room behind. Entries of
    one shingle and size are a block, and step k compares every block with the one k places
    on; lists end and sizes grow apart, so ever fewer remain.
    """
    if not len(grams):
        return np.zeros(0, bool), np.zeros(0, bool)
    opens = np.concatenate([[True], (grams[1:] != grams[:-1]) | (n[1:] != n[:-1])])
    start = np.flatnonzero(opens)
    count = np.diff(np.append(start, len(grams)))
    block = np.cumsum(opens) - 1
    key, size = grams[start], n[start]
    room = np.where(position < prefix_lengths(n), n - position, -1)
    best = room[start]  # positions ascend, so the first entry has the most room
    second = np.where(count > 1, room[np.minimum(start + 1, len(grams) - 1)], -1)
    some = count > 1
    least = np.full(len(start), np.iinfo(np.int64).max)
    at, k = np.arange(len(start) - 1), 1
    while len(at):
        a, b = at, at + k
        near = (key[a] == key[b]) & (DEN * size[a] >= NUM * size[b])
        a, b = a[near], b[near]
        some[a] = True
        some[b] = True
        need = needed(size[a], size[b])
        for own, other in ((a, b), (b, a)):
            fits = best[other] >= need
            np.minimum.at(least, own[fits], need[fits])
        k += 1
        at = a[a + k < len(start)]
    own = needed(n, n)
    partner = np.where(opens, second[block], best[block])
    links = (room >= 0) & ((room >= least[block]) | (np.minimum(room, partner) >= own))
    return some[block], links


def live_entries(docs: DataFrame, hot: np.ndarray, n: int) -> DataFrame:
    """What the index lists say, as rows of (kind, key, cls).

    kind 0: class ``cls`` has ``key`` entries with a partner by size; 1: ``cls`` may link in
    the list of shingle ``key``.
    """
    last = docs.sparkSession.sparkContext.broadcast(hot)

    def index(batches):
        for batch in _slices(batches):
            grams, at = shingle_sets(batch.column(1))
            size = np.diff(at)
            owner = np.repeat(np.arange(len(size)), size)
            hot = last.value
            is_hot = hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams if len(hot) else np.zeros(len(grams), bool)
            grams = grams[np.lexsort((is_hot, owner))]  # stable: by hash within each half
            ids = class_ids(grams, at)  # the order within a set does not matter
            first, who = heads(at, np.minimum(size, DEPTH * prefix_lengths(size)))
            position = first - at[who]
            columns = [grams[first], ids[who], size[who].astype(np.uint32), position.astype(np.uint32)]
            yield _blob_batch(list(_dealt((columns[0] % np.uint64(n)).astype(np.int64), columns, n)))

    def meet(key, t):
        import pyarrow as pa

        grams, ids, size, position = _undealt(t, ["u8", "i8", "u4", "u4"])
        order = np.lexsort((ids, position, size, grams))
        grams, ids, size, position = grams[order], ids[order], size[order].astype(np.int64), position[order].astype(np.int64)
        own = np.ones(len(grams), bool)  # equal sets count once
        own[1:] = (grams[1:] != grams[:-1]) | (ids[1:] != ids[:-1])
        grams, ids, size, position = grams[own], ids[own], size[own], position[own]
        some, links = possible(grams, size, position)
        own, times = np.unique(ids[some], return_counts=True)
        kinds = np.repeat(np.array([0, 1], np.int32), [len(own), int(links.sum())])
        give_back()
        return pa.table([pa.array(kinds), pa.array(np.concatenate([times, grams[links].view(np.int64)])), pa.array(np.concatenate([own, ids[links]]))], ["kind", "key", "cls"])

    return docs.mapInArrow(ending(index), BLOBS).groupBy("bucket").applyInArrow(meet, "kind int, key long, cls long")


def supported(sets: DataFrame, n: int) -> DataFrame:
    """cls, shared: how many of a set's shingles a set of compatible size has too."""

    def index(batches):
        for batch in _slices(batches):
            lists = [np.frombuffer(g, np.uint64) for g in batch.column(1).to_pylist()]
            size = np.array([len(x) for x in lists])
            grams = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
            ids = np.repeat(batch.column(0).to_numpy(), size)
            columns = [grams, ids, np.repeat(size, size).astype(np.uint32)]
            yield _blob_batch(list(_dealt((grams % np.uint64(n)).astype(np.int64), columns, n)))

    def meet(key, t):
        import pyarrow as pa

        grams, ids, size = _undealt(t, ["u8", "i8", "u4"])
        order = np.lexsort((size, grams))
        grams, ids, size = grams[order], ids[order], size[order].astype(np.int64)
        some = np.zeros(len(grams), bool)
        # by size, so a partner in reach is a neighbour
        near = (grams[1:] == grams[:-1]) & (DEN * size[:-1] >= NUM * size[1:])
        some[1:] |= near
        some[:-1] |= near
        own, times = np.unique(ids[some], return_counts=True)
        rows = list(_dealt((own.view(np.uint64) % np.uint64(n)).astype(np.int64), [own, times.astype(np.uint32)], n))
        return pa.Table.from_batches([_blob_batch(rows)])

    def total(key, t):
        import pyarrow as pa

        ids, times = _undealt(t, ["i8", "u4"])
        own, which = np.unique(ids, return_inverse=True)
        return pa.table([pa.array(own), pa.array(np.bincount(which, times).astype(np.int64))], ["cls", "shared"])

    counts = sets.mapInArrow(ending(index), BLOBS).groupBy("bucket").applyInArrow(meet, BLOBS)
    return counts.groupBy("bucket").applyInArrow(total, "cls long, shared long")


def product(a: list[np.ndarray], a_sign: list[np.ndarray], b: list[np.ndarray], b_sign: list[np.ndarray]) -> np.ndarray:
    """Sums over common elements of the product of signs, for every list of a with every of b.

    A matrix product over the elements that both sides hold, a stretch of them at a time.
    """
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(a) or not len(b):
        return out
    own = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (a, b)]
    flat, sign = [np.concatenate(x) for x in (a, b)], [np.concatenate(x) for x in (a_sign, b_sign)]
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    if not len(both):
        return out
    place = []
    for k in (0, 1):
        column = np.minimum(np.searchsorted(both, flat[k]), len(both) - 1)
        keep = both[column] == flat[k]
        order = np.argsort(column[keep], kind="stable")
        place.append((column[keep][order], own[k][keep][order], sign[k][keep][order]))
    width = 1024
    for at in range(0, len(both), width):
        sides = []
        for (column, owner, sign_), rows in zip(place, (len(a), len(b)), strict=True):
            lo, hi = np.searchsorted(column, [at, at + width])
            m = np.zeros((rows, min(width, len(both) - at)), np.float32)
            m[owner[lo:hi], column[lo:hi] - at] = sign_[lo:hi]
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


class Coded:
    """Sets written as a leader's set with a difference: elements and signs (+1 more, -1 less)."""

    def __init__(self, leaders: list[np.ndarray], leader: np.ndarray, elements: list[np.ndarray], signs: list[np.ndarray], size: np.ndarray):
        self.leaders, self.leader, self.elements, self.signs, self.size = leaders, leader, elements, signs, size

    def overlaps(self, other: Coded) -> np.ndarray:
        """Overlap of every set here with every set of ``other``: the leaders' overlap,
        corrected by the differences."""
        plain = lambda sets: [np.ones(len(s), np.int8) for s in sets]
        at, there = self.leader[:, None], other.leader[None, :]
        out = product(self.leaders, plain(self.leaders), other.leaders, plain(other.leaders))[at, there]
        out += product(self.elements, self.signs, other.leaders, plain(other.leaders))[:, other.leader]
        out += product(self.leaders, plain(self.leaders), other.elements, other.signs)[self.leader]
        # what the differences have in common can't exceed the shorter one: most pairs are settled
        slack = np.minimum(np.array([len(x) for x in self.elements])[:, None], np.array([len(x) for x in other.elements])[None, :])
        least = NUM * (self.size[:, None] + other.size[None, :])
        open_ = ((NUM + DEN) * (out + slack) >= least) & ((NUM + DEN) * (out - slack) < least)
        rows, cols = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if len(rows):
            out[np.ix_(rows, cols)] += product([self.elements[i] for i in rows], [self.signs[i] for i in rows], [other.elements[i] for i in cols], [other.signs[i] for i in cols])
        return out

    def links(self, other: Coded) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero((NUM + DEN) * self.overlaps(other).astype(np.int64) >= NUM * (self.size[:, None] + other.size[None, :]))


def coded(sets: list[np.ndarray], least: int = 2) -> Coded:
    """Leaders for the sets of a cell, the first set being the first leader.

    A set follows a leader if the difference is at most half of it.
    """
    size = np.array([len(s) for s in sets], np.int64)
    leader = np.full(len(sets), -1)
    leaders: list[np.ndarray] = []
    elements: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(sets)
    signs: list[np.ndarray] = [np.zeros(0, np.int8)] * len(sets)
    while (leader < 0).any():
        left = np.flatnonzero(leader < 0)
        if len(leaders) >= LEADERS:
            leader[left] = len(leaders) + np.arange(len(left))
            leaders += [sets[i] for i in left]
            break
        lead = sets[left[0]]
        for i in left.tolist():
            at = np.minimum(np.searchsorted(lead, sets[i]), len(lead) - 1)
            has = lead[at] == sets[i]
            gap = len(sets[i]) + len(lead) - 2 * int(has.sum())
            if least * gap <= len(sets[i]) or i == left[0]:
                lost = np.ones(len(lead), bool)
                lost[at[has]] = False
                elements[i] = np.concatenate([sets[i][~has], lead[lost]])
                signs[i] = np.repeat(np.array([1, -1], np.int8), [int((~has).sum()), int(lost.sum())])
                leader[i] = len(leaders)
        leaders.append(lead)
    return Coded(leaders, leader, elements, signs, size)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links among n nodes: (child, root)."""
    label = np.arange(n)
    while True:  # the least label spreads over links
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _runs(column) -> list[tuple[int, int]]:
    """(first, last + 1) of each run of equal values."""
    values = column.to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def cells(homes: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """cls, cell, n, leader (a class), elements, signs, root (a link inside the cell) per class.

    ``homes``: cls, home, n. ``sets``: cls, grams. The class that leads a home is a guest in
    all cells of it.
    """
    size = homes.groupBy("home").agg(F.greatest(F.ceil(F.sum("n") / FAMILY), F.ceil(F.count("*") / CELL)).alias("b"), F.min("cls").alias("first"))
    seats = homes.join(size, "home").withColumn("at", F.pmod(F.xxhash64("cls", "home"), "b"))
    guests = size.filter("b > 1").select(F.col("first").alias("cls"), "home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("at"), F.lit(True).alias("guest"))
    seats = seats.select("cls", "home", "at", F.lit(False).alias("guest")).unionByName(guests).withColumn("cell", F.xxhash64("home", "at"))
    first = size.select("home", "first")
    seats = seats.join(first, "home").select("cls", "cell", "guest", (F.col("first") == F.col("cls")).alias("leads"))

    def run(key, t):
        import pyarrow as pa

        t = t.sort_by([("cell", "ascending"), ("leads", "descending"), ("guest", "ascending"), ("cls", "ascending")])
        out = []
        for a, b in _runs(t.column("cell")):
            part = t.slice(a, b - a).combine_chunks()
            ids, guest = part.column("cls").to_numpy(), part.column("guest").to_numpy(zero_copy_only=False)
            own = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))  # the home's leader may be guest at its own cell
            ids, guest = ids[own], guest[own]
            sets_ = [np.frombuffer(g, np.uint64) for g in part.column("grams").take(pa.array(own)).to_pylist()]
            c = coded(sets_)
            child, root = forest(len(ids), *c.links(c))
            tree = ids.copy()
            tree[child] = ids[root]
            lead = np.zeros(len(c.leaders), np.int64)
            for i in range(len(ids) - 1, -1, -1):
                if not len(c.elements[i]):
                    lead[c.leader[i]] = ids[i]
            keep = np.flatnonzero(~guest | (tree != ids))
            out.append(pa.table([pa.array(ids[keep]), pa.array([part.column("cell")[0].as_py()] * len(keep), pa.int64()), pa.array(c.size[keep]), pa.array(lead[c.leader[keep]]), pa.array([c.elements[i].tobytes() for i in keep], pa.binary()), pa.array([c.signs[i].tobytes() for i in keep], pa.binary()), pa.array(tree[keep]), pa.array(guest[keep])], ["cls", "cell", "n", "leader", "elements", "signs", "root", "guest"]))
        return pa.concat_tables(out)

    group = F.pmod(F.col("cell"), F.lit(16 * parts)).alias("g")
    return sets.join(seats, "cls").select(group, "cell", "cls", "guest", "leads", "grams").groupBy("g").applyInArrow(run, "cls long, cell long, n long, leader long, elements binary, signs binary, root long, guest boolean")


def across(lists: DataFrame, seated: DataFrame, roots: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """u, v: links between sets of different cells and components that share a list.

    ``lists``: key, cls; ``seated``: the cells' classes; ``roots``: node, root of links so far.
    """
    at = seated.select("cls", "cell").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    at = lists.join(at, "cls")
    open_ = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("cell").alias("c0"), F.max("cell").alias("c1")).filter("lo <> hi and c0 <> c1").select("key")
    at = materialize(at.join(open_, "key"), "jaccard-open")
    # per list and cell the span of its components tells whether another cell has a different one
    span = at.groupBy("key", "cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    other = span.select("key", F.col("cell").alias("cell2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    meet = span.join(other, "key").filter("cell < cell2 and not (lo = hi and lo2 = hi2 and lo = lo2)")
    meet = materialize(meet.select("key", "cell", "cell2"), "jaccard-meet")
    unit = F.xxhash64("cell", "cell2").alias("unit")
    sides = F.explode(F.array(F.struct(F.col("cell").alias("c"), F.lit(0).alias("side")), F.struct(F.col("cell2").alias("c"), F.lit(1).alias("side")))).alias("s")
    seats = meet.select("key", unit, sides).select("key", "unit", F.col("s.c").alias("cell"), F.col("s.side").alias("side"))
    members = at.select("key", "cell", "cls", "root").join(seats, ["key", "cell"]).select("unit", "side", "cls", "root").distinct()
    members = materialize(members.join(seated.select("cls", "n", "leader", "elements", "signs"), "cls"), "jaccard-differences")
    leaders = members.select("unit", "side", "leader").distinct().join(sets.withColumnRenamed("cls", "leader"), "leader")
    nothing = F.lit(None)
    rows = members.select("unit", "side", "leader", "cls", "root", "n", "elements", "signs").unionByName(
        leaders.select("unit", "side", "leader", nothing.cast("long").alias("cls"), nothing.cast("long").alias("root"), nothing.cast("long").alias("n"), F.col("grams").alias("elements"), nothing.cast("binary").alias("signs"))
    )

    def run(key, t):
        import pyarrow as pa
        import pyarrow.compute as pc

        t = t.sort_by([("unit", "ascending"), ("side", "ascending"), ("cls", "ascending")])
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in _runs(t.column("unit")):
            part = t.slice(a, b - a)
            sides = []
            for side in (0, 1):
                mine = part.filter(pc.equal(part.column("side"), side))
                lead, own = mine.filter(pc.is_null(mine.column("cls"))), mine.filter(pc.is_valid(mine.column("cls")))
                names = {x: i for i, x in enumerate(lead.column("leader").to_pylist())}
                where = np.array([names[x] for x in own.column("leader").to_pylist()])
                c = Coded([np.frombuffer(g, np.uint64) for g in lead.column("elements").to_pylist()], where, [np.frombuffer(g, np.uint64) for g in own.column("elements").to_pylist()], [np.frombuffer(g, np.int8) for g in own.column("signs").to_pylist()], own.column("n").to_numpy())
                sides.append((c, own.column("cls").to_numpy(), own.column("root").to_numpy()))
            (c, ids, root), (d, ids2, root2) = sides
            i, j = c.links(d)
            new = root[i] != root2[j]
            child, top = forest(len(ids) + len(ids2), i[new], len(ids) + j[new])
            every = np.concatenate([ids, ids2])
            u.append(every[child])
            v.append(every[top])
        return pa.table([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return rows.withColumn("g", F.pmod("unit", F.lit(16 * parts))).groupBy("g").applyInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) by large- and small-star rounds.

    ``edges``: u, v. Every round is written to the shared folder; rounds grow with the
    logarithm of the longest path.
    """
    e = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        e = materialize(small, "star")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), n, root (of its component; null for an empty set) per row."""
    spark = docs.sparkSession
    parts = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = materialize(classes(docs), "jaccard-classes")
    held = every.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    entries = every.agg(F.sum(F.expr(f"n - ceil({NUM} * n / {DEN}) + 1"))).first()[0] or 0
    hot = hot_shingles(docs, parts, max(32, -(-int(entries) // HOT)))
    said = materialize(live_entries(docs, hot, parts), "jaccard-said")
    misses = F.expr(f"n - ceil({NUM} * n / {DEN})")
    live = said.filter("kind = 0").groupBy("cls").agg(F.sum("key").alias("live")).join(held, "cls")
    live = materialize(live.filter(F.expr(f"live >= {LEAST_LIVE}")).select("cls", "rep", "n"), "jaccard-alive")

    def to_sets(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            grams, at = shingle_sets(batch.column(0))
            packed = [grams[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(class_ids(grams, at)), pa.array(packed, pa.binary()), batch.column(1)], ["cls", "grams", "want"])

    wanted = live.select(F.col("rep"), F.col("cls").alias("want"))
    if live.count() <= SENT:  # beyond, the texts are dealt by doc_id instead
        wanted = F.broadcast(wanted)
    sets = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "want")
    sets = sets.mapInArrow(ending(to_sets), "cls long, grams binary, want long").filter("cls = want").drop("want")
    sets = materialize(sets.dropDuplicates(["cls"]), "jaccard-sets")  # rows of one doc_id may be equal
    live = live.join(supported(sets, parts), "cls").filter(F.col("shared") >= F.col("n") - misses).select("cls", "n")
    lists = materialize(said.filter("kind = 1").select("key", "cls").join(live, "cls"), "jaccard-lists")
    length = lists.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1")
    lists = materialize(lists.join(length, "key"), "jaccard-long")
    homes = lists.groupBy("cls").agg(F.max(F.struct("k", "key"))["key"].alias("home"), F.max("n").alias("n"))
    seated = materialize(cells(homes, sets, parts), "jaccard-cells")
    links = seated.filter("root <> cls").select(F.col("cls").alias("u"), F.col("root").alias("v"))
    more = across(lists.select("key", "cls"), seated.filter("not guest"), components(links), sets, parts)
    roots = components(links.unionByName(materialize(more, "jaccard-links")))
    out = every.join(roots, F.col("cls") == F.col("node"), "left")
    return materialize(out.select("doc_id", "h", "n", F.when(F.col("n") > 0, F.coalesce("root", "cls")).alias("root")), "jaccard-linked")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = linked(docs)
    lowest = rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    rows = rows.join(lowest, "root", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of ``documents``: the least doc_id, and of
    its rows one text. Documents without words stay."""
    docs = docs.select(*DOC_COLUMNS)
    rows = linked(docs).filter("root is not null")
    times = rows.groupBy("root", "doc_id", "h").agg(F.count("*").alias("k"))
    last = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("h"))
    first = times.groupBy("root").agg(F.min(last).alias("first"))
    times = times.join(first, "root").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), (last == F.col("first")).alias("wins"), "k").filter("not wins or k > 1")
    times = materialize(times, "jaccard-others")
    docs = docs.withColumn("_t", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_h"))
    alone = docs.join(times, same, "left_anti")
    repeated = docs.join(times.filter("wins"), same, "left_semi").dropDuplicates(["doc_id", "_t"])
    return alone.unionByName(repeated).drop("_t")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
SQL = {
    "op3_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS doc, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.doc = d.doc_id GROUP BY d.doc_id
""",
}
