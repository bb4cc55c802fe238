"""Array helpers: logits to probabilities, token arrays (higher-order functions, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_logits(c: Column | str, bound: float = 100.0) -> Column:
    """F8: NaN -> 0, +inf -> +bound, -inf -> -bound."""
    inf = float("inf")
    return F.transform(
        _c(c).cast("array<double>"),
        lambda x: F.when(F.isnan(x), F.lit(0.0)).when(x == F.lit(inf), F.lit(bound))
        .when(x == F.lit(-inf), F.lit(-bound)).otherwise(x),
    )


def softmax(c: Column | str) -> Column:
    """stable softmax (subtract the max before exp)."""
    x = _c(c)
    m = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / s)


def with_softmax(df, c: str, out: str = "probs"):
    """F9 staged over projections: max, exponentials, their sum, then the ratios.

    Each intermediate is its own column, so no array is recomputed per element
    (a nested expression would re-evaluate the inner array inside every lambda)."""
    t = df.withColumn("__m", F.array_max(c))
    t = t.withColumn("__e", F.transform(c, lambda v: F.exp(v - F.col("__m"))))
    t = t.withColumn("__s", F.aggregate("__e", F.lit(0.0), lambda acc, v: acc + v))
    return t.withColumn(out, F.transform("__e", lambda v: v / F.col("__s"))).drop("__m", "__e", "__s")


def argmax(c: Column | str) -> Column:
    """0-based index of the first maximum."""
    x = _c(c)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def positive_prob(probs: Column | str) -> Column:
    """element 1 when there are two or more classes, else element 0."""
    p = _c(probs)
    return F.when(F.size(p) >= 2, F.element_at(p, 2)).otherwise(F.element_at(p, 1))


def pad_truncate(c: Column | str, n: int, pad: int = 0) -> Column:
    """cut to n elements, then pad with ``pad`` up to n."""
    x = F.slice(_c(c), 1, n)
    return F.concat(x, F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(x), F.lit(0))))


def attention_mask(c: Column | str, n: int) -> Column:
    """1 for real elements, 0 for padding, length n."""
    k = F.least(F.size(_c(c)), F.lit(n))
    return F.concat(F.array_repeat(F.lit(1), k), F.array_repeat(F.lit(0), F.lit(n) - k))


def fit_budget(c: Column | str, max_len: int, new_tokens: int) -> Column:
    """keep the first (max_len - new_tokens) whitespace tokens of a prompt."""
    budget = max(max_len - new_tokens, 0)
    toks = F.split(_c(c), " ")
    return F.array_join(F.slice(toks, 1, budget), " ") if budget > 0 else F.lit("")


def char_tokens(c: Column | str) -> Column:
    """one token per character (stand-in for a trained tokenizer)."""
    return F.split(_c(c), "")
