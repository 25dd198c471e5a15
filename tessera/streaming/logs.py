"""Logs of a run as JSON lines: records of a stream that are written once, and what a record says of the gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.operators.telemetry import norm_rollup


def lines(stream: DataFrame, path: str, run: str):
    """A writer of ``stream`` whose micro-batches are JSON lines in folders ``path/run=<run>/batch=<id>``.

    A batch that comes again after a crash takes the place of its folder, so a record is
    neither lost nor there twice. A run that starts anew, with no checkpoint of its own, has
    to have another name, or it would write over the first one's batches.
    """

    def land(batch: DataFrame, number: int) -> None:
        batch.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{path}/run={run}/batch={number}")

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", f"{path}/_checkpoints/{run}")


def records(spark: SparkSession, path: str, schema: str, latest: str | None = None) -> DataFrame:
    """The records of all runs with ``run`` and ``batch``; of equal values of ``latest`` within all runs, the one that the last run by name has."""
    got = spark.read.schema(schema).option("basePath", path).json(f"{path}/run=*")
    if latest is None:
        return got
    found = got.groupBy(latest).agg(F.max_by(F.struct(*got.columns), F.struct(F.col("run").cast("string"), "batch")).alias("last"))
    return found.select("last.*")


def _number(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def norm_records(norms: DataFrame, top: int = 12, digits: int = 6) -> DataFrame:
    """(step, line) of (step, consumed_tokens, name, ordinal, category, layer, norm): a JSON object a step.

    It holds the global norm, those by category and by layer (parameters of no layer are in none), and the ``top``
    largest parameters, equal ones in order of ``ordinal``. Steps are merged from parts; of a
    step's parameters no more than ``top`` meet in a task.
    """
    level = norm_rollup(norms, digits=digits)
    entry = lambda key, at: F.collect_list(F.when(at, F.struct(F.col(key).alias("k"), F.col("norm").alias("v"))))
    by = level.groupBy("step").agg(
        F.max(F.when(F.col("level") == 3, F.col("norm"))).alias("whole"),
        F.sort_array(entry("category", (F.col("level") == 1) & F.col("category").isNotNull())).alias("by_category"),
        F.sort_array(entry("layer", (F.col("level") == 2) & F.col("layer").isNotNull())).alias("by_layer"),
    )
    from tessera.operators.telemetry import top_norms

    first = top_norms(norms, top).groupBy("step").agg(F.sort_array(F.collect_list(F.struct("rank", "name", _number(F.col("norm"), digits).alias("v")))).alias("top"))
    tokens = norms.groupBy("step").agg(F.max("consumed_tokens").alias("consumed_tokens"))
    quoted = lambda s: F.regexp_replace(F.to_json(F.array(s.cast("string"))), r"^\[|\]$", "")
    pairs = lambda c: F.concat(F.lit("{"), F.array_join(F.transform(c, lambda e: F.concat(quoted(e["k"]), F.lit(": "), e["v"].cast("string"))), ", "), F.lit("}"))
    most = F.array_join(F.transform("top", lambda e: F.concat(F.lit("["), quoted(e["name"]), F.lit(", "), e["v"].cast("string"), F.lit("]"))), ", ")
    parts = ['{"step": ', "step", ', "consumed_tokens": ', "consumed_tokens", ', "global": ', "whole", ', "by_category": ', pairs("by_category"), ', "by_layer": ', pairs("by_layer"), ', "top": [', most, "]}"]
    line = F.concat(*(p if isinstance(p, Column) else F.coalesce(F.col(p).cast("string"), F.lit("null")) if p in ("step", "consumed_tokens", "whole") else F.lit(p) for p in parts))
    return by.join(first, "step").join(tokens, "step").select("step", line.alias("line"))
