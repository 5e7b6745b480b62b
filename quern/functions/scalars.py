"""Hashes, partitions and buckets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTITIONS = 271  # fixed value: a prime


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the code units of a string (characters of the basic plane)."""
    units = F.filter(F.split(c, ""), lambda x: x != "")
    step = lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(units, F.lit(2166136261).cast("long"), step)



def mix32(c: Column) -> Column:
    """A 32-bit finaliser (xor-shift and multiply) of a long that holds 32 bits."""
    h = c
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        h = h.bitwiseXOR(F.shiftright(h, shift))
        if factor:
            # Two halves, so that no product leaves 64 bits.
            low = h.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor)
            high = (F.shiftright(h, 16) * F.lit(factor)).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)
            h = (low + high).bitwiseAND(F.lit(0xFFFFFFFF))
    return h


def combined_hash(c: Column) -> Column:
    """An aggregate: the sum of mixed hashes, in 32 bits, whatever the order."""
    return F.sum(mix32(c)).bitwiseAND(F.lit(0xFFFFFFFF))


def partition_id(c: Column) -> Column:
    return F.pmod(fnv1a(c), F.lit(PARTITIONS)).cast("int")


def integer_multiple(c: Column, size: float) -> Column:
    return F.floor(c / size) * size


def power_of_ten(c: Column) -> Column:
    return F.pow(F.lit(10.0), F.floor(F.log10(c)))


def logarithmic(c: Column, base: float) -> Column:
    """The greatest power of the base that isn't more than the value."""
    return F.pow(F.lit(float(base)), F.floor(F.log(c) / F.log(F.lit(float(base)))))


def time_interval(c: Column, millis: int) -> Column:
    return F.floor(F.unix_millis(c) / millis) * millis


# ------------------------------------------------------------ neighbours in a sorted map


def neighbours(df: DataFrame, column: str, value) -> DataFrame:
    """One row: lower (<), floor (<=), ceiling (>=) and higher (>) of a value among a column's; null where there is none."""
    c = F.col(column)
    return df.agg(
        F.max(F.when(c < value, c)).alias("lower"), F.max(F.when(c <= value, c)).alias("floor"),
        F.min(F.when(c >= value, c)).alias("ceiling"), F.min(F.when(c > value, c)).alias("higher"))


def at_place(df: DataFrame, column: str, place: int) -> DataFrame:
    """The row at a place of the order by a column, from 0."""
    return df.orderBy(column).offset(place).limit(1)


# ------------------------------------------------------------ vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a norm is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 1.0).otherwise(1 - dot(a, b) / n)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, v: s + v))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def distance(metric: str, a: Column, b: Column) -> Column:
    return {"cosine": cosine_distance, "l2": euclidean, "dot": lambda x, y: -dot(x, y), "l1": manhattan}[metric](a, b)


def score(metric: str, d: Column) -> Column:
    return {"cosine": 1 - d, "dot": -d}.get(metric, 1 / (1 + d))
