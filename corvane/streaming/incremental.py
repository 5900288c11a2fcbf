"""Which levels of a project are stale, decided as its checksums arrive.

A project's state is what its cache holds, kept with those of its bucket: the checksums of the last scan that was made, and the sequence number of
the last event that was seen. An event is scan-stale if its scan checksum differs from the state, or if there is none;
a scan then takes both checksums into the state. It is model-stale if the model checksum differs from the state as it
was before. State lives in the checkpoint, so a stream that starts again goes on where it ended.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "project string, seq long, scan_stale boolean, model_stale boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 1 << 14  # projects share their state by hash, since every access of it is a call to the JVM
_STORE = "spark.sql.streaming.stateStore.providerClass"


class _Staleness(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._cache = handle.getValueState("cache", "held string")  # JSON: project -> scan, model, seq

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._cache.get()
        held = json.loads(held[0]) if held else {}
        out = []
        for seq, project, new_scan, new_model in sorted((r.seq, r.project, r.scan_checksum, r.model_checksum) for r in rows):
            scan, model, seen = held.get(project, (None, None, None))
            if seen is not None and seq <= seen:
                continue
            stale = scan is None or scan != new_scan
            out.append(Row(project=project, seq=seq, scan_stale=stale, model_stale=scan is None or model != new_model))
            held[project] = (new_scan, new_model, seq) if stale else (scan, model, seq)
        if out:
            self._cache.update((json.dumps(held),))
        yield from out

    def close(self) -> None:
        pass


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state needs a store with column families; streams that start afterwards have one."""
    spark.conf.set(_STORE, PROVIDER)


def staleness(events: DataFrame) -> DataFrame:
    """A stream of project, seq, scan_checksum, model_checksum (none null) -> project, seq, scan_stale, model_stale.

    Events of a project arrive in the order of seq, but for those of one micro-batch, which are put in order. One that
    isn't newer than all before is a repetition and gives no row. See `use_keyed_state`."""
    rows = events.select("project", F.col("seq").cast("long").alias("seq"), "scan_checksum", "model_checksum")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("project"), F.lit(BUCKETS))).groupBy("bucket").transformWithState(_Staleness(), OUTPUT, outputMode="append", timeMode="none")


def staleness_of(events: DataFrame) -> DataFrame:
    """The same of a whole history at once: what the stream gives however its events are split into batches."""
    first = events.groupBy("project", F.col("seq").cast("long").alias("seq")).agg(F.min(F.struct("scan_checksum", "model_checksum")).alias("c")).select("project", "seq", "c.*")
    order = Window.partitionBy("project").orderBy("seq")
    before = F.lag("scan_checksum").over(order)
    rows = first.withColumn("scan_stale", before.isNull() | (before != F.col("scan_checksum")))
    held = F.last(F.when(F.col("scan_stale"), F.col("model_checksum")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("project", "seq", "scan_stale", F.coalesce(held != F.col("model_checksum"), F.lit(True)).alias("model_stale"))
