"""Pulls that can be killed at any time: micro-batches that land once, a cursor of what was read, and the revision it was read of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tessera.sources import shared


def once(stream: DataFrame, path: str, keep: Column | None = None):
    """A writer of ``stream`` that puts each micro-batch into its own folder ``path/rows/batch=<id>``, and its counts into ``path/log/batch=<id>``.

    A batch that is run again after a crash overwrites its folder, so no row is lost or there
    twice; a batch counts once its log is there, which is written last. ``keep`` filters; the
    log has the rows scanned and kept, as observed while they are written.
    """

    def land(batch: DataFrame, number: int) -> None:
        seen = Observation(f"scanned-{number}")
        rows = batch.observe(seen, F.count("*").alias("scanned"), F.coalesce(F.count_if(keep if keep is not None else F.lit(True)), F.lit(0)).alias("kept"))
        rows = rows if keep is None else rows.where(keep)
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        told = seen.get
        shared.note(batch.sparkSession, f"{path}/log/batch={number}", f"{told['scanned']} {told['kept']}")

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", f"{path}/checkpoint")


def landed(spark: SparkSession, path: str) -> DataFrame:
    """(batch, scanned, kept) of the batches that are whole."""
    if not shared.exists(spark, f"{path}/log"):
        return spark.createDataFrame([], "batch bigint, scanned bigint, kept bigint")
    line = spark.read.text(f"{path}/log", recursiveFileLookup=True, pathGlobFilter="batch=*[0-9]").select(F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)$", 1).cast("bigint").alias("batch"), F.split("value", " ").alias("n"))
    return line.select("batch", F.col("n")[0].cast("bigint").alias("scanned"), F.col("n")[1].cast("bigint").alias("kept"))


def rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all whole batches; one that was cut off is left out until it is run again."""
    whole = [r["batch"] for r in landed(spark, path).select("batch").collect()]  # a number for each batch
    if not whole:
        raise ValueError(f"nothing has landed in {path}")
    return spark.read.option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/batch={b}" for b in sorted(whole))).drop("batch")


def pull(stream: DataFrame, path: str, revision: str, keep: Column | None = None, batches: int | None = None) -> dict[str, int]:
    """Goes on with a pull of a file stream into ``path``; the counts of all that has landed so far.

    ``revision`` names the state of what is pulled and is noted beside it. If another one is
    noted there, what lies there was pulled from something else and is dropped first. ``batches``
    ends the pull after so many, as a kill would.
    """
    spark = stream.sparkSession
    noted = shared.noted(spark, f"{path}/revision")
    if noted is not None and noted != revision:
        shared.delete(spark, path)
    if noted != revision:
        shared.note(spark, f"{path}/revision", revision)
    writer = once(stream, path, keep)
    if batches is None:
        writer.trigger(availableNow=True).start().awaitTermination()
    else:
        q = writer.trigger(availableNow=True).start()  # ends by itself where there are fewer
        while q.isActive and landed(spark, path).count() < batches:
            q.awaitTermination(1)
        q.stop()
    told = landed(spark, path).agg(F.count("*").alias("batches"), F.coalesce(F.sum("scanned"), F.lit(0)).alias("scanned"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept")).first()
    return told.asDict()


def json_lines(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """A stream of (line) of JSON-lines files, compressed or not, ``files_a_batch`` at a time."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_a_batch).option("lineSep", "\n").load(path).select(F.col("value").alias("line"))


def valid_lines(spark: SparkSession, path: str, chunk: int = 10_000) -> tuple[DataFrame, int]:
    """(lines, n): the lines of a half-written JSON-lines file that a pull may go on behind.

    Those are the lines before the first that is no JSON or has no line end, less the last chunk
    if it is not full.
    """
    from tessera.sources.text import placed_lines

    at = placed_lines(spark, path)
    whole = F.try_parse_json("line").isNotNull() & (F.col("offset") + F.octet_length("line") < F.col("size"))
    numbered = shared.cut(at.withColumn("good", whole))
    first_bad = numbered.agg(F.min(F.when(~F.col("good"), F.col("number"))), F.count("*")).first()
    clean = first_bad[1] if first_bad[0] is None else first_bad[0]
    n = clean // chunk * chunk
    return numbered.where(F.col("number") < n).select("number", "line"), n


def written(table: DataFrame, path: str, **metrics: Column) -> dict:
    """Writes ``table`` as Parquet and gives the ``metrics`` of the rows as they passed."""
    seen = Observation()
    table.observe(seen, *(c.alias(k) for k, c in metrics.items())).write.option("compression", "zstd").parquet(path)
    return seen.get
