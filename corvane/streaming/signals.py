"""Signals of a stream of configuration lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signals


def stream_signals(lines: DataFrame, delay: str = "1 hour") -> DataFrame:
    """lines: ts, file, line, text (streaming) -> ts, file, line, type, pattern, value.

    Each (file, type, value) comes once; the state of one that isn't seen again is dropped after `delay`. Which
    of several equal signals of a micro-batch comes first is not defined, unlike in batch."""
    tests = [F.struct(F.lit(n).alias("pattern"), F.lit(t).alias("type"), F.regexp_extract("text", "(?i)" + p, 0).alias("value")) for n, t, p in signals.PATTERNS]
    usable = lines.where((F.trim("text") != "") & ~F.col("text").rlike(signals.COMMENT))
    found = usable.select("ts", "file", "line", F.explode(F.filter(F.array(*tests), lambda s: s["value"] != "")).alias("s"))
    found = found.select("ts", "file", "line", "s.type", "s.pattern", "s.value").where(~signals.noise(F.col("value")))
    return found.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["file", "type", "value"])


def windowed_counts(events: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) by tumbling window and type, late ones within `delay` included."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
