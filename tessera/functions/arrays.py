"""Column expressions over arrays: ternary encoding, dot products, bit planes, quantising, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floor of a norm in cosine().
NORM_FLOOR = 1e-9
#: Fixed values of the byte encoder: centre, spread, and the cut on each side.
BYTE_CENTRE, BYTE_SPREAD, BYTE_CUT = 109.5, 13.0, 0.33


def total(values: Column, f=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + f(x).cast("double"))


def total_long(values: Column, f=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + f(x).cast("long"))


def dot(a: Column, b: Column) -> Column:
    """Of the common length."""
    return total(F.zip_with(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(total(a, lambda x: x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unlike long or all-zero arrays."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (both == 0), 0.0).otherwise(dot(a, b) / F.greatest(both, F.lit(NORM_FLOOR)))


def ternary(a: Column) -> Column:
    """Sign where the size is over half the mean size, else 0."""
    cut = 0.5 * total(a, F.abs) / F.greatest(F.size(a), F.lit(1))
    return F.transform(a, lambda x: F.when(x.cast("double") > cut, 1).when(x.cast("double") < -cut, -1).otherwise(0).cast("tinyint"))


def ternary_bytes(text: Column) -> Column:
    """-1, 0 or 1 for each byte of the UTF-8 text."""
    raw = F.hex(F.encode(text, "UTF-8"))
    codes = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length(raw) / 2 - 1).cast("int"))), lambda i: F.conv(F.substring(raw, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int"))
    score = lambda b: (b - BYTE_CENTRE) / BYTE_SPREAD
    return F.when(F.length(raw) == 0, F.array().cast("array<tinyint>")).otherwise(F.transform(codes, lambda b: F.when(score(b) > BYTE_CUT, 1).when(score(b) < -BYTE_CUT, -1).otherwise(0).cast("tinyint")))


def density(a: Column) -> Column:
    """Share that is not 0; 0 for an empty array."""
    return F.coalesce(F.try_divide(F.size(F.filter(a, lambda x: x != 0)).cast("double"), F.size(a).cast("double")), F.lit(0.0))


def bit_occupancy(a: Column) -> Column:
    """Set bits over twice the length, as of a two-plane code: half the density."""
    return density(a) / 2


def plane(a: Column, value: int, width: int = 32) -> Column:
    """Words of ``width`` bits: bit k of word w is set where element width * w + k is ``value``."""
    words = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(a) / width).cast("int") - 1))
    return F.transform(words, lambda w: F.aggregate(F.transform(F.slice(a, (w * width + 1).cast("int"), F.lit(width)), lambda x, k: F.when(x == value, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x)))


def plane_dot(p1: Column, n1: Column, p2: Column, n2: Column) -> Column:
    """Ternary dot product of two vectors in positive and negative planes, by popcounts."""
    count = lambda x, y: total_long(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseAND(b))))
    return count(p1, p2) + count(n1, n2) - count(p1, n2) - count(n1, p2)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def alignment(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / 64.0


def int8_scale(a: Column) -> Column:
    """Largest size / 127; 1 for an all-zero array."""
    top = F.coalesce(F.array_max(F.transform(a, F.abs)).cast("double"), F.lit(0.0))
    return F.when(top == 0, 1.0).otherwise(top / 127)


def int8(a: Column) -> Column:
    """Rounded half away from 0."""
    scale = int8_scale(a)
    return F.transform(a, lambda x: (F.signum(x.cast("double")) * F.floor(F.abs(x.cast("double") / scale) + 0.5)).cast("int"))


def int8_activation(a: Column) -> Column:
    """Scale 127 / max(largest size, 1e-5), rounded half to even, within -128 and 127."""
    scale = 127 / F.greatest(F.coalesce(F.array_max(F.transform(a, F.abs)).cast("double"), F.lit(0.0)), F.lit(1e-5))
    return F.transform(a, lambda x: F.least(F.lit(127), F.greatest(F.lit(-128), F.rint(x.cast("double") * scale).cast("int"))))
