"""Text sources and sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from tessera.functions.text import non_empty
from tessera.operators.order import prefix_sum


def parquet_text(spark: SparkSession, path: str | list[str], column: str = "text") -> DataFrame:
    """(text) of Parquet files: one column read, nulls dropped (empty texts are kept)."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path)).select(F.col(column).alias("text")).where(F.col("text").isNotNull())


def jsonl_rows(spark: SparkSession, path: str | list[str], field: str = "text") -> DataFrame:
    """(text, bad): every line of JSON lines, plain, gzip or zstd by file name; ``bad`` holds a line that is no JSON object."""
    schema = T.StructType([T.StructField(field, T.StringType()), T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.select(F.col(field).alias("text"), F.col("_corrupt_record").alias("bad"))


def jsonl_text(spark: SparkSession, path: str | list[str], field: str = "text") -> DataFrame:
    """(text) of JSON lines; blank and malformed lines, missing, null and empty texts are dropped."""
    return jsonl_rows(spark, path, field).where(F.col("bad").isNull() & non_empty(F.col("text"))).select("text")


def jsonl_in_order(spark: SparkSession, path: str | list[str], field: str = "text") -> DataFrame:
    """(pos, text) of ``jsonl_text``; ``pos`` grows with the file's path and the line's place in it, however files are split.

    Lines dropped may leave gaps. Spark's byte ranges are counted first, a row each; texts are not moved.
    """
    schema = T.StructType([T.StructField(field, T.StringType()), T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    row = F.monotonically_increasing_id().alias("row")  # only differences inside a range count
    rows = raw.select(F.col(field).alias("text"), F.col("_corrupt_record").alias("bad"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), row)
    kept = rows.where(F.col("bad").isNull() & non_empty(F.col("text")))
    ranges = kept.groupBy("file", "block").agg(F.min("row").alias("first"), (F.max("row") - F.min("row") + 1).alias("n"))
    before = lambda *by: W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    files = ranges.groupBy("file").agg(F.sum("n").alias("n")).select("file", F.coalesce(F.sum("n").over(before("file")), F.lit(0)).alias("base"))  # a row a file
    inside = ranges.select("file", "block", "first", F.coalesce(F.sum("n").over(before("file", "block")), F.lit(0)).alias("own"))
    at = inside.join(files, "file").select("file", "block", (F.col("base") + F.col("own") - F.col("first")).alias("shift"))
    return kept.join(at, ["file", "block"]).select((F.col("row") + F.col("shift")).alias("pos"), "text")


def segment_of(offset: Column, size: Column, workers: int) -> Column:
    """Which of ``workers`` byte ranges a line that begins at ``offset`` belongs to: the k with size*k div N <= offset < size*(k+1) div N."""
    k = F.call_function("div", offset * workers, size)
    upper = F.call_function("div", size * (k + 1), F.lit(workers).cast("bigint"))
    return F.when(offset >= upper, k + 1).otherwise(k)


def placed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, offset, number, size): every line of text files with the byte and the count it begins at.

    Spark cuts large files into byte ranges and finds the line ends there; a line's offset is the bytes of
    all lines before it in its file, summed by range first. So no file is one task's, and none is held whole.
    Lines end with a line feed alone; a carriage return is part of its line.
    """
    meta = {"file": "file_path", "block": "file_block_start", "size": "file_size"}
    read = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), *(F.col(f"_metadata.{v}").alias(k) for k, v in meta.items()))
    rows = read.withColumn("row", F.monotonically_increasing_id()).withColumn("bytes", F.octet_length("line") + 1).withColumn("one", F.lit(1))
    at = prefix_sum(rows, ["block"], ["row"], "bytes", "offset", group=["file"])
    return prefix_sum(at, ["block"], ["row"], "one", "number", group=["file"]).select("file", "line", "offset", "number", "size")


def segments(spark: SparkSession, path: str | list[str], workers: int) -> DataFrame:
    """(line, offset, worker) of text files cut into byte ranges, blank lines left out; a line belongs to the range it begins in."""
    rows = placed_lines(spark, path).where(non_empty(F.trim(F.translate("line", "\t\r\x0b\f", "    "))))
    return rows.select("line", "offset", segment_of(F.col("offset"), F.col("size"), workers).cast("int").alias("worker"))


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, bytes, ordinal) of files, in order of their paths; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", F.col("length").alias("bytes"))
    return files.withColumn("ordinal", F.row_number().over(W.orderBy("path")) - 1)


def worker_files(files: DataFrame, workers: int, worker: int) -> DataFrame:
    return files.where(F.pmod("ordinal", F.lit(workers)) == worker)


def write_jsonl(texts: DataFrame, path: str, compression: str = "none") -> None:
    """One JSON object a line with the key ``text``; anything beyond ASCII is escaped."""
    import json

    @F.pandas_udf(T.StringType())
    def line(t: pd.Series) -> pd.Series:
        return t.map(lambda x: json.dumps({"text": x}))

    texts.select(line("text").alias("value")).write.option("compression", compression).text(path)


def fetched(ids: DataFrame, blobs: DataFrame, key: str = "blob_id") -> DataFrame:
    """Every id with its blob's text; a blob that is not there, or not readable in its charset, gives null or replacements."""
    return ids.join(blobs, key, "left")


def valid_prefix_floor(lines: DataFrame, chunk: int = 10_000, order: str = "pos", line: str = "line") -> DataFrame:
    """(valid, resume): leading lines that parse, and where a pull goes on: all, if the whole is valid and full chunks, else full chunks."""
    bad = F.get_json_object(line, "$").isNull()
    told = lines.agg(F.min(F.when(bad, F.col(order))).alias("first_bad"), F.count("*").alias("n"))
    valid = F.coalesce("first_bad", "n")
    return told.select(valid.cast("bigint").alias("valid"), (F.call_function("div", valid, F.lit(chunk).cast("bigint")) * chunk).cast("bigint").alias("resume"))
