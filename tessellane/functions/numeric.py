"""Vector, hash and score functions, as Spark columns."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if a norm is 0; an error if the lengths differ."""
    checked = F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(checked / (norm(a) * norm(b)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value made once a row even where lambdas use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalized(a: Column) -> Column:
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    raw = F.hex(F.encode(text, "UTF-8"))
    pairs = F.when(F.length(raw) > 0, F.sequence(F.lit(1), F.length(raw), F.lit(2))).otherwise(F.array().cast("array<int>"))
    octets = F.transform(pairs, lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(octets, F.lit(2166136261).cast("long"), lambda h, b: h.bitwiseXOR(b) * F.lit(16777619) % F.lit(1 << 32))


def crc_bucket(text: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(text, "UTF-8")), F.lit(buckets))


def crc_sign(text: Column) -> Column:
    """The sign that bit 1 of the hash gives."""
    return F.when(F.crc32(F.encode(text, "UTF-8")).bitwiseAND(F.lit(2)) != 0, 1.0).otherwise(-1.0)


def idf_bm25(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, idf: Column, length: Column, mean_length: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(a: Column) -> Column:
    """Shifted by the greatest element, so that nothing overflows."""
    shifted = let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m)))
    return let(shifted, lambda e: let(_total(e), lambda total: F.transform(e, lambda x: x / total)))


def layer_norm(a: Column, epsilon: float = 1e-5) -> Column:
    centred = let(_total(a) / F.size(a), lambda mean: F.transform(a, lambda x: x - mean))
    return let(centred, lambda c: let(F.sqrt(_total(F.transform(c, lambda x: x * x)) / F.size(c) + epsilon), lambda d: F.transform(c, lambda x: x / d)))


def linear(a: Column, weights: Column, bias: Column) -> Column:
    """``weights`` is an array of rows."""
    return F.zip_with(F.transform(weights, lambda row: dot(a, row)), bias, lambda x, y: x + y)


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function to about 15 places: 2/sqrt(pi) exp(-x^2) (x + 2x^3/3 + 4x^5/15 + ...), whose terms are all positive; beyond 6 it is 1."""
    z = np.minimum(np.abs(x), 6.0)
    term = z.copy()
    total = term.copy()
    for n in range(1, 130):
        term = term * 2 * z * z / (2 * n + 1)
        total += term
    return np.sign(x) * np.minimum(2 / math.sqrt(math.pi) * np.exp(-z * z) * total, 1.0)


@F.pandas_udf(DoubleType())
def gelu(x: pd.Series) -> pd.Series:
    """Exact, by the error function, which Spark lacks; whole batches at a time. Null stays null."""
    v = x.to_numpy(dtype=float, na_value=np.nan)
    out = 0.5 * v * (1 + _erf(v / math.sqrt(2)))
    return pd.Series(out).where(~np.isnan(out), None)


def cross_entropy(p: Column) -> Column:
    """Mean of -ln p, an aggregate."""
    return F.avg(-F.log(F.greatest(p, F.lit(1e-300))))


def length_penalty(n_chars: Column, best: int = 300) -> Column:
    return F.when(n_chars == 0, 1.0).otherwise(F.least(F.lit(1.0), F.abs(F.log2(n_chars / best)) / 5))
