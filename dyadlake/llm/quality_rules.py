"""Operator 10: quality rules combined by weak supervision (native DataFrame code).

Each rule looks at one statistic of a text and votes good (1), bad (-1) or abstains (0).
Expectation-maximisation over the vote patterns estimates how often each rule is right on
good and on bad texts, and the posterior probability of quality decides, instead of demanding
every rule. The parameters are free: the prior on each is one row of either vote, and the
classes are named by an identifiability check, the good one being where rules that vote good
are right. Rules on different sides of one fault (marks by words, by characters, words without
a letter) let the model tell a fault from a rule's error; the base's own rules, length and
repeated windows, do not vote.

The patterns are at most 3 ** len(RULES) rows whatever the corpus size: all documents are
counted into them with map-side partial sums, and each EM round is one small aggregation.

Edge cases: null or empty text has zero words, fails the base and is not kept; repeated
documents are separate rows with equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialize, table

WINDOW = 8


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns whose values later expressions read as they are.

    A generator stands between, so the optimizer does not inline them: a lambda that
    refers to an inlined array would compute that array anew for every element.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def statistics(docs: DataFrame) -> DataFrame:
    """The base statistics of each whole text of ``docs`` (columns doc_id, text).

    n_repeat_words counts the words in 8-word windows that the text holds twice or more.
    Windows are compared by 64-bit hash. Most texts repeat none, which a hash set of longs
    shows in linear time; only the others sort their windows.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    d = computed(
        d,
        _h=F.transform(F.regexp_extract_all("_t", F.lit(f"({WORD})"), F.lit(1)), lambda w: F.xxhash64(w)),
        _lines=F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    )
    windows = F.transform(F.sequence(F.lit(1), F.size("_h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_h", i, F.lit(WINDOW))))
    d = computed(d, _win=F.when(F.size("_h") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    # (window, position) in order, so equal windows are neighbours: keep those that have an equal neighbour
    pairs = F.array_sort(F.transform("_win", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    d = computed(d, _pairs=F.when(F.size(F.array_distinct("_win")) < F.size("_win"), pairs))
    w_at = lambda i: F.get(F.col("_pairs"), i)["w"]
    repeated = F.filter("_pairs", lambda p, i: F.coalesce(w_at(i - 1) == p["w"], F.lit(False)) | F.coalesce(w_at(i + 1) == p["w"], F.lit(False)))
    d = computed(d, _rep=F.sort_array(F.transform(repeated, lambda p: p["i"])))
    covered = F.aggregate(
        "_rep",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("n"), i.alias("last")),
    )["n"]
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("long")
    return d.select(
        "doc_id",
        F.size("_h").cast("long").alias("n_words"),
        (F.length("_t") - F.regexp_count("_t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        count("[.!?]").alias("n_stops"),
        count("[0-9]").alias("n_digits"),
        count("[A-Z]").alias("n_capitals"),
        count("!").alias("n_shouts"),
        count(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])").alias("n_letterless"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Name and vote of each rule. The limits are production defaults for prose."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    mean, marks = F.col("word_chars") / n, F.col("n_symbols") + F.col("n_shouts") + F.col("n_digits")
    return {
        "word_length": _vote(mean.between(3, 10), (mean < 2.5) | (mean > 14)),
        "symbols": _vote(100 * F.col("n_symbols") <= 3 * n, 100 * F.col("n_symbols") > 20 * n),
        "letterless": _vote(100 * F.col("n_letterless") <= 3 * n, 100 * F.col("n_letterless") > 15 * n),
        "marks": _vote(100 * marks <= 5 * chars, 100 * marks > 8 * chars),
        "dup_lines": _vote(F.col("n_dup_lines") == 0, (F.col("n_dup_lines") >= 3) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines"))),
        "sentences": _vote(60 * F.col("n_stops") >= n, (F.col("n_stops") == 0) & (F.col("n_words") >= 40)),
        "digits": _vote(100 * F.col("n_digits") <= 10 * chars, 100 * F.col("n_digits") > 30 * chars),
        "capitals": _vote(100 * F.col("n_capitals") <= 10 * chars, 100 * F.col("n_capitals") > 30 * chars),
        "shouts": _vote(100 * F.col("n_shouts") <= 3 * n, 100 * F.col("n_shouts") > 20 * n),
    }


def estimate(patterns: DataFrame, names: list[str], rounds: int = 50) -> dict:
    """EM over vote patterns (one column per rule, ``n`` documents each).

    Parameters: the prior of quality and, per rule, how often it is right when it votes, for
    good and for bad texts apart; each with one added row of either kind. One aggregation a
    round; what returns to the driver is two sums per rule and vote.
    """
    state = {"prior": 0.8, "acc": {r: (0.9, 0.5) for r in names}}
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("vote")) for r in names])).alias("e")
    for _ in range(rounds):
        q = patterns.select("n", posterior(state, names).alias("q"), each)
        sums = {(s["rule"], s["vote"]): (s["good"], s["bad"]) for s in q.groupBy("e.rule", "e.vote").agg(F.sum(F.col("n") * F.col("q")).alias("good"), F.sum(F.col("n") * (1 - F.col("q"))).alias("bad")).collect()}
        if not sums:
            break
        of = lambda r, v, side: sums.get((r, v), (0.0, 0.0))[side]
        right = lambda r, v, side: (of(r, v, side) + 1) / (of(r, v, side) + of(r, -v, side) + 2)
        new = {r: (right(r, 1, 0), right(r, -1, 1)) for r in names}
        good, bad = (sum(of(names[0], v, side) for v in (-1, 0, 1)) for side in (0, 1))
        prior = (good + 1) / (good + bad + 2)
        moved = max([abs(prior - state["prior"]), *(abs(a - b) for r in names for a, b in zip(new[r], state["acc"][r], strict=True))])
        state = {"prior": prior, "acc": new}
        if moved < 1e-5:
            break
    return named(state)


def named(state: dict) -> dict:
    """The state with its classes exchanged where rules are right less than half of the time."""
    acc = state["acc"]
    if sum(a + b for a, b in acc.values()) >= len(acc):
        return state
    return {"prior": 1 - state["prior"], "acc": {r: (1 - b, 1 - a) for r, (a, b) in acc.items()}}


def posterior(state: dict, names: list[str]) -> Column:
    """Probability of quality given the votes, as a column expression over them.

    The log odds of all votes stand in one array literal, so each EM round runs the same
    generated code.
    """
    from math import log

    odds = []
    for r in names:
        good, bad = state["acc"][r]
        odds += [log((1 - good) / bad), 0.0, log(good / (1 - bad))]
    table_ = F.array(*[F.lit(float(x)) for x in [*odds, log(state["prior"] / (1 - state["prior"]))]])
    said = [F.get(table_, F.col(r) + F.lit(3 * k + 1)) for k, r in enumerate(names)]
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, said, F.get(table_, F.lit(3 * len(names))))))


def judge(docs: DataFrame, threshold: float = 0.5, rounds: int = 50) -> DataFrame:
    """Statistics, votes, posterior quality and verdict of every document."""
    stats = statistics(docs)
    votes = rules()
    stats = materialize(stats.withColumns(votes), "quality-rules")
    names = list(votes)
    patterns = materialize(stats.groupBy(*names).agg(F.count("*").alias("n")), "quality-patterns")
    state = estimate(patterns, names, rounds)
    failed = base_failed()
    return stats.withColumn("quality", posterior(state, names)).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= threshold))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("quality").alias("posterior"))


QUERIES = {"op10_quality_rules": op10_quality_rules}
SQL: dict[str, str] = {}
