"""Checks of a model: each returns the violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTAINER_KINDS = ("class", "interface", "struct", "enum")


def duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, n, first_id of the keys that occur more than once in one collection."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.min(order).alias("first_id")).where("n > 1")


def missing_ends(relationships: DataFrame, known: DataFrame) -> DataFrame:
    """source, target, missing: a row for each end that no collection knows."""
    ends = relationships.select("source", "target", F.explode(F.array(F.struct(F.lit("source").alias("missing"), F.col("source").alias("id")), F.struct(F.lit("target").alias("missing"), F.col("target").alias("id")))).alias("e"))
    ends = ends.select("source", "target", "e.missing", "e.id")
    return ends.join(known.select("id").distinct(), "id", "left_anti").select("source", "target", "missing")


def owner_mismatches(elements: DataFrame, components: DataFrame) -> DataFrame:
    """id, problem: elements of unknown components, or that name another container than their component does."""
    own = components.select("component_id", F.col("container_id").alias("own"))
    rows = elements.join(own, "component_id", "left").where("own IS NULL OR own <> container_id")
    return rows.select("id", F.when(F.col("own").isNull(), "unknown component").otherwise("other container").alias("problem"))


def wrong_shapes(elements: DataFrame) -> DataFrame:
    """id, kind: containers without members and symbols without a signature."""
    return elements.where(F.when(F.col("kind").isin(*CONTAINER_KINDS), F.col("members").isNull()).otherwise(F.col("signature").isNull())).select("id", "kind")
