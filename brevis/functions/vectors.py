"""Vector functions over array columns, in double precision."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; a missing component counts as 0."""
    return total(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the length of ``a``; 0 if either norm is 0."""
    other = F.slice(b, 1, F.size(a))
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(other, other))
    return F.when(scale == 0, dot(a, other)).otherwise(dot(a, other) / scale)


def l2_normalized(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def int8_codes(v: Column) -> Column:
    """Components clamped to [-1, 1] and scaled to 127 steps, halves rounded up."""
    return F.transform(v, lambda x: F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0)))) * 127 + 0.5).cast("tinyint"))


def int8_similarity(query: Column, codes: Column) -> Column:
    return total(F.zip_with(codes, query, lambda c, q: F.coalesce(q, F.lit(0.0)) * (F.coalesce(c, F.lit(0)) / 127)))


def sign_bits(v: Column) -> Column:
    """1 where a component is not negative."""
    return F.transform(v, lambda x: F.when(F.coalesce(x, F.lit(0.0)) >= 0, 1).otherwise(0))


def binary_similarity(query: Column, bits: Column) -> Column:
    """Share of agreeing bits of whole bytes; padding bits never agree."""
    agree = F.aggregate(F.zip_with(bits, sign_bits(query), lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    return agree / (F.ceil(F.size(bits) / 8) * 8)


def softmax(score: Column, over) -> Column:  # noqa: ANN001
    """Softmax of a score column over a window."""
    e = F.exp(score - F.max(score).over(over))
    return e / F.sum(e).over(over)


def kl_term(p: Column, q: Column) -> Column:
    """A row's term of the Kullback-Leibler divergence of p from q."""
    return F.when(p > 0, p * F.ln(p / F.greatest(q, F.lit(1e-12)))).otherwise(0.0)


def weighted_sum(df: DataFrame, weight: str, vector: str, *keys: str) -> DataFrame:
    """``keys, dim, x``: the sum of each group's vectors times their weights, by dimension."""
    d = df.select(*keys, F.col(weight).alias("_w"), F.posexplode(doubles(vector)).alias("dim", "_x"))
    return d.groupBy(*keys, "dim").agg(F.sum(F.col("_w") * F.coalesce("_x", F.lit(0.0))).alias("x"))


def relative_error(exact: Column, approx: Column) -> Column:
    """Length of the difference of two vectors over the length of the exact one."""
    off = F.zip_with(exact, approx, lambda x, y: F.coalesce(y, F.lit(0.0)) - F.coalesce(x, F.lit(0.0)))
    return F.sqrt(dot(off, off)) / F.sqrt(dot(exact, exact))


def uniforms(seed: int) -> Iterator[float]:
    """Numbers in [0, 1] of a 32-bit linear congruential generator."""
    state = seed & 0xFFFFFFFF
    while True:
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        yield state / 0xFFFFFFFF


def gaussians(seed: int) -> Iterator[float]:
    """Normal numbers by the Box-Muller transform of :func:`uniforms`, one of a pair."""
    u = uniforms(seed)
    for a in u:
        yield math.sqrt(-2 * math.log(a + 1e-12)) * math.cos(2 * math.pi * next(u))
