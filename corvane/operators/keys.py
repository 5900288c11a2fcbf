"""Joins and groupings on ids. Ids of one kind share their first letters, by which Spark sorts first; a hash of the keys
before them tells rows apart at once, and rows without a key, which match nothing, are spread over all tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH = "_hash"


def spread(keys: list[str], others: list[str]) -> Column:
    """A hash of the keys; of all other columns where a key is null."""
    lacks = reduce(Column.__or__, (F.col(k).isNull() for k in keys))
    return F.when(lacks, F.xxhash64(*others)).otherwise(F.xxhash64(*keys)) if others else F.xxhash64(*keys)


def joined_by(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, keys, how) of inner, left, left_semi or left_anti; keys of both sides have the same types."""
    others = [c for c in left.columns if c not in keys]
    return left.withColumn(HASH, spread(keys, others)).join(right.withColumn(HASH, F.xxhash64(*keys)), [HASH, *keys], how).drop(HASH)


def gathered(rows: DataFrame, keys: list[str]):
    """rows.groupBy(keys) with the hash as first key (to be dropped): sorted once, after the shuffle."""
    return rows.repartition(*keys).groupBy(F.xxhash64(*keys).alias(HASH), *keys)
