"""Queries that run as streams over files made from the tables, micro-batch by micro-batch, to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.store import scratch
from ..streaming import incremental
from .adapters import table
from .registry import register

BATCHES = 4


def _history(spark, sf_dir):
    """Customers are projects, their orders the events: the status tells what was scanned, the priority the model."""
    o = table(spark, sf_dir, "orders")
    c = F.col
    return o.select(F.concat(F.lit("project-"), "o_custkey").alias("project"), c("o_orderkey").cast("long").alias("seq"), c("o_orderstatus").alias("scan_checksum"), F.concat_ws("/", "o_orderstatus", F.substr("o_orderpriority", F.lit(1), F.lit(1))).alias("model_checksum"))


def _streamed(spark, sf_dir):
    """The history arrives in batches of equal ranges of seq; the stream is stopped after half of them and started again,
    and goes on from its checkpoint."""
    history = _history(spark, sf_dir)
    source, sink, checkpoint = (scratch(spark, n) for n in ("events", "stale", "state"))
    low, high = history.agg(F.min("seq"), F.max("seq")).first()
    parts = history.withColumn("part", F.floor((F.col("seq") - F.lit(low or 0)) * BATCHES / F.lit(1 + (high or 0) - (low or 0))))
    incremental.use_keyed_state(spark)
    history.limit(0).write.parquet(source)
    for i in range(BATCHES):
        parts.where(F.col("part") == i).drop("part").write.mode("append").parquet(source)
        if i >= BATCHES // 2 - 1:
            stream = spark.readStream.schema(history.schema).option("maxFilesPerTrigger", 1_000).parquet(source)
            run = incremental.staleness(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            run.awaitTermination()
    return spark.read.schema(incremental.OUTPUT).parquet(sink)


register(
    "stream_staleness",
    _streamed,
    """WITH e AS (SELECT 'project-' || o_custkey AS project, CAST(o_orderkey AS BIGINT) AS seq, o_orderstatus AS scan, o_orderstatus || '/' || o_orderpriority[1:1] AS model FROM orders),
s AS (SELECT *, lag(scan) OVER w IS DISTINCT FROM scan AS scan_stale FROM e WINDOW w AS (PARTITION BY project ORDER BY seq))
SELECT a.project, a.seq, a.scan_stale, coalesce((SELECT b.model FROM s b WHERE b.project = a.project AND b.seq < a.seq AND b.scan_stale ORDER BY b.seq DESC LIMIT 1) <> a.model, true) AS model_stale FROM s a""",
)
