"""The session the engine is meant to run in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution, skew joins and last-wins maps; further settings by ``conf`` (``_`` for ``.``)."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table_stream(spark: SparkSession, sf_dir: str, name: str, **options):
    """The table as a stream of its files, be it one file or a folder of them. A pattern stands for the path, as a stream takes no single file else."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).options(**options).parquet(f"{sf_dir}/{name}.parque[t]")


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
