"""Settings and ordered classification rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective_excludes(user: Column, defaults: Column, forced: Column) -> Column:
    """User and default patterns without repeats, in this order, less those that are forced in."""
    return F.array_except(F.array_union(user, defaults), forced)


def cascade(rows: DataFrame) -> DataFrame:
    """target, depth, key (dotted), value -> the settings in force: the deepest value of a key. A scalar hides
    shallower values below its key, and a value hides a shallower scalar at one of its prefixes."""
    top = rows.groupBy("target", "key").agg(F.max_by("value", "depth").alias("value"), F.max("depth").alias("depth"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split("key", r"\."))), lambda i: F.array_join(F.slice(F.split("key", r"\."), 1, i), "."))
    each = top.select("target", F.col("key").alias("own"), "depth", F.explode(prefixes).alias("prefix")).where("own <> prefix")
    # A deeper key below this one, or this one below a deeper key.
    below = each.groupBy("target", F.col("prefix").alias("key")).agg(F.max("depth").alias("below"))
    above = each.join(top.select("target", F.col("key").alias("prefix"), F.col("depth").alias("d")), ["target", "prefix"]).groupBy("target", F.col("own").alias("key")).agg(F.max("d").alias("above"))
    out = top.join(below, ["target", "key"], "left").join(above, ["target", "key"], "left")
    hidden = (F.coalesce("below", F.lit(-1)) > F.col("depth")) | (F.coalesce("above", F.lit(-1)) > F.col("depth"))
    return out.where(~hidden).select("target", "key", "value")


def classify_pages(pages: DataFrame) -> DataFrame:
    """page_id, kind by the first rule that holds."""
    kind = (
        F.when(F.contains("html", F.lit("<form")), "form")
        .when(F.col("url").rlike(r"^https?://blog\."), "blog")
        .when(F.col("url").rlike("[?&]page="), "listing")
        .when(F.contains("html", F.lit("<article")), "article")
        .otherwise("other")
    )
    return pages.select("page_id", kind.alias("kind"))
