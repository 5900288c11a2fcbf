"""Staleness of projects as a stream: the same however events are split, after restarts and with repetitions."""

from __future__ import annotations

import random

import pytest

from corvane.streaming import incremental

EVENTS = "project string, seq long, scan_checksum string, model_checksum string"


def brute(events):
    cache, out = {}, []
    for p, seq, scan, model in sorted(events, key=lambda e: e[1]):
        held = cache.get(p)
        stale = held is None or held[0] != scan
        out.append((p, seq, stale, held is None or held[1] != model))
        if stale:
            cache[p] = (scan, model)
    return sorted(out)


@pytest.mark.parametrize("cuts", [[], [13], [5, 6, 40]])
def test_stream_equals_batch_after_any_split(spark, tmp_path, cuts):
    rng = random.Random(len(cuts))
    events = [(f"p{rng.randrange(4)}", i, rng.choice("ab"), rng.choice("xyz")) for i in range(60)]
    incremental.use_keyed_state(spark)
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([], EVENTS).write.parquet(source)
    bounds = [0, *cuts, 60]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):  # a run a part: state comes from the checkpoint
        part = events[a:b] + events[max(0, a - 3) : a]  # some come again
        rng.shuffle(part)
        spark.createDataFrame(part, EVENTS).write.mode("append").parquet(source)
        stream = incremental.staleness(spark.readStream.schema(EVENTS).parquet(source))
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = sorted(tuple(r) for r in spark.read.schema(incremental.OUTPUT).parquet(sink).collect())
    assert found == brute(events)
    assert sorted(tuple(r) for r in incremental.staleness_of(spark.createDataFrame(events + events[:9], EVENTS)).collect()) == brute(events)
