"""Nested settings documents: VARIANT values taken apart into rows, merged by depth, and folded together again.

A row of `flatten` is one place of a document: `path` (an array of keys) with a JSON value, or with none where an object
stands. Arrays are values as a whole. All steps are joins and groupings over rows, a round for each level of nesting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = "array<string>"


def _is_object(json: Column) -> Column:
    return F.startswith(json, F.lit("{"))


def flatten(docs: DataFrame) -> DataFrame:
    """doc (VARIANT) and other columns -> these, path, value: a row for every key at any depth, value null for objects.
    Documents that are null or no objects have no rows."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != "doc"]
    level = docs.where(_is_object(F.to_json("doc"))).select(*others, F.array().cast(_KEY).alias("path"), F.col("doc").alias("_v"))
    out = None
    while out is None or not level.isEmpty():
        each = level.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        each = each.select(*others, F.concat("path", F.array("key")).alias("path"), F.col("value").alias("_v"), F.to_json("value").alias("_json"))
        rows = each.where("_json IS NOT NULL").select(*others, "path", F.when(~_is_object(F.col("_json")), F.col("_json")).alias("value"))
        out = rows if out is None else out.unionByName(rows)
        level = each.where(_is_object(F.col("_json"))).select(*others, "path", "_v")
    return out


def merged(rows: DataFrame, by: list[str], depth: str = "depth") -> DataFrame:
    """Rows of `flatten` of several documents a group -> by, path, value: what holds when documents of greater depth go
    over those of smaller ones. Objects merge key by key; any other value replaces what was there, and what was below
    it in documents before. A null is such a value."""
    leaf = F.when(F.col("value").isNotNull(), F.col(depth))
    top = rows.groupBy(*by, "path").agg(F.max(F.struct(F.col(depth).alias("d"), F.col("value").alias("v"))).alias("last"), F.max(leaf).alias("leaf"))
    over = top.where("leaf IS NOT NULL").select(*by, F.col("path").alias("_above"), F.col("leaf").alias("_leaf"))
    above = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.slice("path", 1, i))
    below = top.where(F.size("path") > 1).select(*by, "path", F.explode(above).alias("_above")).join(over, [*by, "_above"])
    below = below.groupBy(*by, "path").agg(F.max("_leaf").alias("_leaf"))
    kept = top.join(below, [*by, "path"], "left").where(F.coalesce(F.col("_leaf") <= F.col("last.d"), F.lit(True)))
    return kept.select(*by, "path", F.col("last.v").alias("value"))


def _quoted(key: Column) -> Column:
    text = F.to_json(F.array(key))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def rebuilt(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, path, value -> by, json: a document a group, folded from its deepest level up, keys in order. A place with
    places below it is an object, whatever its own value."""
    deepest = rows.agg(F.coalesce(F.max(F.size("path")), F.lit(0))).first()[0]
    built = rows.select(*by, "path", F.coalesce("value", F.lit("{}")).alias("json"))
    for level in range(deepest, 0, -1):  # one grouping a level, which reads what is built so far once
        here = F.size("path") == level
        entry = F.struct(F.element_at("path", -1).alias("k"), F.concat(_quoted(F.element_at("path", -1)), F.lit(":"), "json").alias("e"))
        moved = built.select(*by, F.when(here, F.slice("path", 1, level - 1)).otherwise(F.col("path")).alias("path"), F.when(here, entry).alias("_field"), F.when(~here, F.col("json")).alias("_own"))
        moved = moved.groupBy(*by, "path").agg(F.array_sort(F.collect_list("_field")).alias("_fields"), F.max("_own").alias("_own"))
        inner = F.concat(F.lit("{"), F.array_join(F.transform("_fields", lambda f: f["e"]), ","), F.lit("}"))
        built = moved.select(*by, "path", F.when(F.size("_fields") > 0, inner).otherwise(F.col("_own")).alias("json"))
    return built.where(F.size("path") == 0).select(*by, "json")


def in_force(docs: DataFrame, targets: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
    """docs: dir, doc (VARIANT); targets: dir -> dir, json: the settings of each target, those of its own folder over those
    of the folders above, up to the root ('' or '.') or the nearest boundary (dir), that one included. Targets that no
    document reaches have '{}'."""
    plain = lambda c: F.when(c == ".", "").otherwise(c)
    parts = F.filter(F.split(plain(F.col("dir")), "/"), lambda s: s != "")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = targets.select("dir").distinct().select(F.col("dir").alias("target"), F.posexplode(up).alias("depth", "dir"))
    if boundaries is not None:
        ends = above.join(boundaries.select(plain(F.col("dir")).alias("dir")).distinct(), "dir").groupBy("target").agg(F.max("depth").alias("_end"))
        above = above.join(ends, "target", "left").where("_end IS NULL OR depth >= _end").drop("_end")
    rows = flatten(docs.select(plain(F.col("dir")).alias("dir"), "doc"))
    found = above.join(rows, "dir").select("target", "depth", "path", "value")
    whole = rebuilt(merged(found, ["target"]), ["target"]).withColumnRenamed("target", "dir")
    return targets.select("dir").distinct().join(whole, "dir", "left").select("dir", F.coalesce("json", F.lit("{}")).alias("json"))
