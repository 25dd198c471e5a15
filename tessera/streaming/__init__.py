"""Structured Streaming: spike detection as keyed state, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState

from tessera.operators.telemetry import Walk, bad_step
from tessera.sources import shared

#: Rows handed on at once.
CHUNK = 1 << 16
STATE = "recent array<bigint>, cooldown int, skipped bigint, halted boolean"


def spike_stream(series: DataFrame, threshold: float, start_step: int, skip_steps: int, window: int, most: int) -> DataFrame:
    """The batch operator's rows, from a stream of (run_id, step, loss, norm) whose steps come in order."""

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, cooldown, skipped, halted = state.get if state.exists else ([], 0, 0, False)
        w = Walk(cooldown, list(recent), halted)
        parts = [(b["step"].to_numpy(np.int64), b["bad"].to_numpy(bool)) for b in batches]  # nine bytes a row
        step, bad = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(step, kind="stable")
        for lo in range(0, len(order), CHUNK):
            at = order[lo : lo + CHUNK]
            skip, fresh, halt = w.see(step[at], bad[at], skip_steps, window, most)
            skipped += int(skip.sum())
            yield pd.DataFrame({"run_id": key[0], "step": step[at], "skipped": skip, "fresh": fresh, "halted": halt})
        state.update((w.recent, w.cooldown, skipped, w.halted))

    kind = series.schema["run_id"].dataType.simpleString()
    marked = series.select("run_id", "step", bad_step(threshold, start_step).alias("bad"))
    return marked.groupBy("run_id").applyInPandasWithState(one, f"run_id {kind}, step bigint, skipped boolean, fresh boolean, halted boolean", STATE, "append", "NoTimeout")


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Counts and sums of events by tumbling event-time window and type, late ones dropped beyond the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a finite stream gives, as a table in the shared folder; in complete mode what it gives last."""
    spark: SparkSession = stream.sparkSession
    path = shared.fresh(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{path}/rows")
    else:
        writer = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}/rows"))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
