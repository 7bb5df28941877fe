"""Leak-free cross-validation partitions, reproducible by hash instead of a random stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pairs import bucket_of, pair_key, uniform_of
from .lineage import settle


def cv1(pairs: DataFrame, k: int = 5, salt: str = "cv1") -> DataFrame:
    """Adds fold: every pair is tested in exactly one fold."""
    return pairs.withColumn("fold", bucket_of(pair_key("a", "b"), k, salt))


def _held(pairs: DataFrame, k: int, salt: str) -> DataFrame:
    """A row per fold; an end's bucket is hashed once a pair, before the folds are spread."""
    own = pairs.select("*", bucket_of(F.col("a"), k, salt).alias("_ka"), bucket_of(F.col("b"), k, salt).alias("_kb"))
    held = lambda x: (F.col(x) == F.col("fold")).cast("int")
    return own.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_h", held("_ka") + held("_kb")).drop("_ka", "_kb")


def cv2(pairs: DataFrame, k: int = 5, salt: str = "gene") -> DataFrame:
    """fold and part for every fold: test if at least one end is held out, else train."""
    return _held(pairs, k, salt).withColumn("part", F.when(F.col("_h") > 0, "test").otherwise("train")).drop("_h")


def cv3(pairs: DataFrame, k: int = 5, salt: str = "gene") -> DataFrame:
    """fold and part: test if both ends are held out, train if none; mixed are ``dropped``."""
    return _held(pairs, k, salt).withColumn("part", F.when(F.col("_h") == 2, "test").when(F.col("_h") == 0, "train").otherwise("dropped")).drop("_h")


def carve_validation(parts: DataFrame, share: float = 0.1, salt: str = "val") -> DataFrame:
    """Moves a share of each fold's train pairs to ``val``, by hash of pair and fold (of train pairs alone)."""
    u = uniform_of(F.concat_ws("#", pair_key("a", "b"), F.col("fold").cast("string")), salt)
    return parts.withColumn("part", F.when(F.col("part") == "train", F.when(u < share, "val").otherwise("train")).otherwise(F.col("part")))


#: Folds of one row of bits, three bits each.
PACKED = 20
_BITS = {"train": 1, "val": 2, "test": 4}


def packed_parts(parts: DataFrame, *keep: str) -> DataFrame:
    """a, b, chunk, m, settled: one row per pair and 20 folds, three bits a fold: it stands in its train, val or test part.

    The rows of a pair stand together where folds have been spread, so they are one row before anything is
    shuffled. ``keep``: columns of the pair. Other parts than these and ``dropped``, and null folds, are an error.
    """
    wrong = F.raise_error(F.concat(F.lit("no part of a fold: "), F.coalesce("part", F.lit("null")))).cast("int")
    bit = F.when(F.col("fold").isNull(), wrong).otherwise(F.coalesce(*[F.when(F.col("part") == name, F.lit(v)) for name, v in {**_BITS, "dropped": 0}.items()], wrong))
    m = F.call_function("shiftleft", bit.cast("bigint"), (3 * F.pmod("fold", F.lit(PACKED))).cast("int"))
    d = parts.select("a", "b", F.floor(F.col("fold") / PACKED).cast("int").alias("chunk"), m.alias("m"), *keep)
    return settle(d.groupBy("a", "b", "chunk").agg(F.bit_or("m").alias("m"), *[F.max(c).alias(c) for c in keep]), "parts")


def folds_of(packed: DataFrame) -> list[tuple[int, int]]:
    """(chunk, place in it) of the folds that have a row in train, val or test."""
    used = packed.groupBy("chunk").agg(F.bit_or("m").alias("m")).collect()  # one row for 20 folds
    return [(r["chunk"], f) for r in sorted(used) for f in range(PACKED) if r["m"] >> (3 * f) & 7]


def _has(m: str, fold: int, *names: str) -> Column:
    return F.col(m).bitwiseAND(F.lit(sum(_BITS[n] for n in names) << (3 * fold)).cast("bigint")) != 0


def ends_of(packed: DataFrame) -> DataFrame:
    """id, chunk, m: all bits of the pairs of an id."""
    return packed.select(F.explode(F.array("a", "b")).alias("id"), "chunk", "m").groupBy("id", "chunk").agg(F.bit_or("m").alias("m"))


def with_ends(packed: DataFrame, ends: DataFrame) -> DataFrame:
    """``packed`` with ma and mb, what ``ends`` has of both; null where it lacks one."""
    for x in ("a", "b"):
        packed = packed.join(ends.select(F.col("id").alias(x), "chunk", F.col("m").alias(f"m{x}")), [x, "chunk"], "left")
    return packed


def _per_fold(d: DataFrame, folds: list[tuple[int, int]], values) -> DataFrame:
    """fold and the aggregates ``values(place)`` (by name) over the rows of its chunk: one pass for all folds."""
    places = sorted({f for _, f in folds})
    if not places:
        places = [0]
    t = d.groupBy("chunk").agg(*[c.alias(f"{name}{f}") for f in places for name, c in values(f).items()])
    names = list(values(places[0]))
    each = F.array(*[F.struct((F.col("chunk") * PACKED + f).alias("fold"), *[F.col(f"{n}{f}").alias(n) for n in names]) for f in places])
    return t.select(F.explode(each).alias("c")).select("c.*")


def leaks(parts: DataFrame, both_held: bool) -> DataFrame:
    """fold, pairs_twice, ids_shared: counts that must be zero.

    pairs_twice: pairs in more than one part; ids_shared: test pairs with an end in train or val (cv3) or with
    both ends there (cv2). One row per pair and one per id hold all folds as bits (see ``packed_parts``), so
    that test pairs meet their ends once for all folds.
    """
    d = packed_parts(parts)
    folds = folds_of(d)
    parts_in = lambda f: sum((_has("m", f, n).cast("int") for n in _BITS), F.lit(0))
    twice = _per_fold(d, folds, lambda f: {"n": F.count_if(_has("m", f, *_BITS)), "pairs_twice": F.count_if(parts_in(f) > 1)}).filter("n > 0").drop("n")
    any_test = F.lit(sum(_BITS["test"] << (3 * f) for f in range(PACKED))).cast("bigint")
    test = with_ends(d.filter(F.col("m").bitwiseAND(any_test) != 0), ends_of(d))
    seen = lambda m, f: F.coalesce(_has(m, f, "train", "val"), F.lit(False)).cast("int")
    shared = _per_fold(test, folds, lambda f: {"ids_shared": F.count_if(_has("m", f, "test") & (seen("ma", f) + seen("mb", f) >= (1 if both_held else 2)))})
    return twice.join(shared, "fold", "left").select("fold", "pairs_twice", F.coalesce("ids_shared", F.lit(0)).alias("ids_shared"))


def train_keys(parts: DataFrame) -> DataFrame:
    """fold, n_keys, n_first: distinct train pairs, and distinct first ends of these."""
    d = packed_parts(parts)
    folds = folds_of(d)
    train = {f: _has("m", f, "train") for _, f in folds}
    first = d.groupBy("a", "chunk").agg(F.bit_or("m").alias("m"), *[F.count_if(c).alias(f"_{f}") for f, c in train.items()])
    t = _per_fold(first, folds, lambda f: {"n_keys": F.sum(f"_{f}") if f in train else F.lit(0), "n_first": F.count_if(_has("m", f, "train"))})
    return t.filter("n_keys > 0")


def fit_counts(parts: DataFrame) -> DataFrame:
    """fold, n, n_fit: ids in a part of the fold, and those in its train part (see ``scopes.fit_ids``)."""
    d = packed_parts(parts)
    return _per_fold(ends_of(d), folds_of(d), lambda f: {"n": F.count_if(_has("m", f, *_BITS)), "n_fit": F.count_if(_has("m", f, "train"))}).filter("n > 0")


def geometry(parts: DataFrame, label: str) -> DataFrame:
    """fold, part (train, val, test), n, prevalence, both_in_train: the share of pairs with both ends in train pairs."""
    d = packed_parts(parts, label)
    folds = folds_of(d)

    def values(f: int) -> dict[str, Column]:
        both = F.coalesce(_has("ma", f, "train") & _has("mb", f, "train"), F.lit(False))
        of = lambda n: {f"{n}_n": F.count_if(_has("m", f, n)), f"{n}_l": F.sum(F.when(_has("m", f, n), F.col(label))), f"{n}_k": F.count(F.when(_has("m", f, n), F.col(label))), f"{n}_b": F.count_if(_has("m", f, n) & both)}
        return {k: c for n in _BITS for k, c in of(n).items()}

    t = _per_fold(with_ends(d, ends_of(d)), folds, values)
    each = F.array(*[F.struct(F.lit(n).alias("part"), F.col(f"{n}_n").alias("n"), F.try_divide(F.col(f"{n}_l").cast("double"), F.col(f"{n}_k")).alias("prevalence"), F.try_divide(F.col(f"{n}_b").cast("double"), F.col(f"{n}_n")).alias("both_in_train")) for n in _BITS])
    return t.select("fold", F.explode(each).alias("c")).select("fold", "c.*").filter("n > 0")


def digest(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, digest: order-free content hash, a sum of 60-bit hashes of the pairs."""
    h = F.conv(F.substring(F.md5(pair_key("a", "b")), 1, 15), 16, 10).cast("decimal(38,0)")
    return parts.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("digest"))


def seen_mask(positives: DataFrame, test: DataFrame) -> DataFrame:
    """All known positives without this fold's test positives."""
    return positives.join(test.select("a", "b").distinct(), ["a", "b"], "left_anti")


def balance(df: DataFrame, keys: list[str], label: str, unit: str, salt: str = "bal", slots: int = 256) -> DataFrame:
    """Class undersampling: in each group as many rows of each class as its smaller one has.

    Rows go in hash order. Slots of that order are counted; a class keeps the slots that fit
    whole, and only the rows of the slot in which its quota ends are ranked.
    """
    d = df.withColumn("_u", uniform_of(F.col(unit), salt)).withColumn("_slot", F.floor(F.col("_u") * slots))
    counts = d.groupBy(*keys, label, "_slot").agg(F.count("*").alias("_k"))
    sizes = counts.groupBy(*keys, label).agg(F.sum("_k").alias("_n")).groupBy(*keys).agg(F.min("_n").alias("_m"), F.count("*").alias("_c")).filter("_c = 2")
    upto = Window.partitionBy(*keys, label).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_k").over(upto), F.lit(0))).join(sizes, keys)
    counts = counts.filter("_before < _m").select(*keys, label, "_slot", (F.col("_m") - F.col("_before")).alias("_room"), "_k")
    d = d.join(counts, [*keys, label, "_slot"])
    whole = d.filter("_k <= _room")
    last = d.filter("_k > _room").withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, label).orderBy("_u", unit))).filter("_rn <= _room").drop("_rn")
    return whole.unionByName(last).drop("_u", "_slot", "_room", "_k")


def split(df: DataFrame, unit: str, train: float = 0.8, val: float = 0.1, salt: str = "split") -> DataFrame:
    """Adds part: train, val (a share of train) or test, by hash of ``unit``."""
    u = uniform_of(F.col(unit), salt)
    return df.withColumn("part", F.when(u >= train, "test").when(u < train * val, "val").otherwise("train"))
