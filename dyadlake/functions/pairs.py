"""Column functions on unordered pairs, multi-valued cells and partial labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical(a, b) -> tuple[Column, Column]:
    """The pair in order, so that swapped rows agree."""
    return F.least(col(a), col(b)), F.greatest(col(a), col(b))


def pair_key(a, b, sep: str = "|") -> Column:
    """Order-free composite key in string order."""
    a, b = col(a).cast("string"), col(b).cast("string")
    return F.concat_ws(sep, F.least(a, b), F.greatest(a, b))


def split_multi(c, pattern: str = ";") -> Column:
    """Multi-valued cell to its distinct trimmed non-empty members; null gives none."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), pattern), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def any_allowed(c, allow: list[str], pattern: str = "[;|]") -> Column:
    """True if any member is in the allow-list; unknown members count as excluded."""
    return F.exists(split_multi(c, pattern), lambda x: x.isin(allow))


def lenient_bool(c) -> Column:
    """true/1/yes/t/y and false/0/no/f/n in any case; null stays null; else an error."""
    x = F.lower(F.trim(col(c).cast("string")))
    return F.when(x.isin("true", "1", "yes", "t", "y"), True).when(x.isin("false", "0", "no", "f", "n"), False).when(x.isNull(), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), x)).cast("boolean"))


def normal_token(c, aliases: dict[str, str], junk: list[str]) -> Column:
    """Trimmed, upper-cased, merged by alias; junk and empty tokens are null."""
    x = F.upper(F.trim(col(c)))
    pairs = [F.lit(y) for kv in aliases.items() for y in kv]
    merged = F.coalesce(F.try_element_at(F.create_map(*pairs), x), x) if pairs else x
    return F.when((x != "") & ~x.isin(junk), merged)


def head_of(token: Column, heads: dict[str, int], other: int) -> Column:
    """Category of a token; ``other`` where it has none of its own."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for kv in heads.items() for y in kv]), token), F.lit(other))


def heads_of_members(tokens: Column, member: Column, heads: dict[str, int], other: int) -> Column:
    """Categories of a member's tokens; a member without tokens is ``other``, a non-member has none."""
    own = F.array_sort(F.array_distinct(F.transform(tokens, lambda t: head_of(t, heads, other))))
    return F.when(~member, F.array().cast("array<int>")).when(F.size(tokens) == 0, F.array(F.lit(other))).otherwise(own)


def label_mask(pos_heads: Column, neg_heads: Column, n_heads: int, same_head: str = "or") -> Column:
    """Per category struct(label, mask): 1/1 if asserted positive, 0/1 if only negative, else 0/0.

    ``same_head``: a category asserted both ways is positive (``or``) or unlabelled (``mask``).
    """

    def one(h: Column) -> Column:
        p, n = F.array_contains(pos_heads, h), F.array_contains(neg_heads, h)
        known = (p | n) if same_head == "or" else (p != n)
        return F.struct(F.when(known & p, 1).otherwise(0).alias("label"), F.when(known, 1).otherwise(0).alias("mask"))

    return F.transform(F.sequence(F.lit(0), F.lit(n_heads - 1)), one)


def pooled(labels: Column) -> Column:
    """1 if any supervised category is positive."""
    return F.exists(labels, lambda x: (x["mask"] == 1) & (x["label"] == 1)).cast("int")


def finite(c) -> Column:
    """The number, or null where it is null, NaN or infinite."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def sigmoid(c) -> Column:
    return 1 / (1 + F.exp(-col(c).cast("double")))


def normalized_aupr(aupr, prevalence) -> Column:
    p = col(prevalence)
    return F.when((p > 0) & (p < 1), (col(aupr) - p) / (1 - p))


def precision_gain(tp, fp, n_pos, n_neg) -> Column:
    """1 - (pos/neg) * fp/tp; null without a true positive."""
    return 1 - F.try_divide(col(n_pos) * col(fp), col(n_neg) * col(tp))


def recall_gain(tp, n_pos, n_neg) -> Column:
    """1 - (pos/neg) * fn/tp."""
    return 1 - F.try_divide(col(n_pos) * (col(n_pos) - col(tp)), col(n_neg) * col(tp))


def bucket_of(key: Column, n: int, salt: str = "") -> Column:
    """Deterministic bucket 0..n-1 of a string key by md5 (the same in any SQL engine)."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("long") % n).cast("int")


def uniform_of(key: Column, salt: str = "") -> Column:
    """Deterministic uniform in [0, 1) of a string key by md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def two_sided_p(share_le0, replicates, share_ge0=None) -> Column:
    """Two-sided bootstrap p from one-sided shares, at least 1 / (replicates + 1)."""
    low = col(share_le0)
    high = col(share_ge0) if share_ge0 is not None else 1 - low
    return F.least(F.lit(1.0), 2 * F.greatest(F.least(low, high), 1 / (col(replicates) + 1)))


def verdict(delta, se, threshold: float = 0.005) -> Column:
    """better / worse / within noise / below threshold."""
    d, s = col(delta), col(se)
    return F.when(d.isNull(), F.lit("undefined")).when(F.abs(d) < threshold, F.lit("below threshold")).when(F.abs(d) <= 2 * F.coalesce(s, F.lit(0.0)), F.lit("within noise")).when(d > 0, F.lit("better")).otherwise(F.lit("worse"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def abs_difference(a, b, missing: Column, width: int) -> Column:
    """|a - b| by element; -1 everywhere where either side is missing."""
    return F.when(missing, F.array_repeat(F.lit(-1.0), width)).otherwise(F.zip_with(col(a), col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
