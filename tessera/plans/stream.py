"""Structured Streaming over the driver's tables, run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera import streaming as R
from tessera.catalog import query
from tessera.plans.training import series
from tessera.session import table_stream


@query("stream_spikes", "SELECT event_type AS run_id, count(*) AS steps FROM events GROUP BY event_type")
def _(spark, d):
    """The batch rows and the stream's agree, run by run; else the count is that of the rows that do."""
    e = table_stream(spark, d, "events").select(F.col("event_type").alias("run_id"), F.col("event_id").alias("step"), F.lit(1.0).alias("loss"), F.col("value").alias("norm"))
    got = R.drained(R.spike_stream(e, 40.0, 20, 3, 40, 3), f"s{uuid.uuid4().hex[:8]}")
    from tessera.operators.telemetry import spike_events

    both = got.intersectAll(spike_events(series(spark, d), 40.0, 20, 3, 40, 3))
    return both.groupBy("run_id").agg(F.count("*").alias("steps"))


@query("stream_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    got = R.drained(R.event_windows(table_stream(spark, d, "events"), "30 days", "1 hour"), f"s{uuid.uuid4().hex[:8]}", "complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
