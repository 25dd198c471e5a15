"""Files of a mirror, verified against the digests that a manifest names while they are read.

How files are fetched is a parameter: a function (spark, paths) -> (path, content). The one
given is Spark's binary source, which reads whatever file system the path names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.registry import blake2b_hex

Transport = Callable[[SparkSession, Sequence[str]], DataFrame]


def binary(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def gs_parts(uri: str) -> tuple[str, str]:
    """(bucket, prefix) of a ``gs://`` address, the prefix without slashes at its ends."""
    scheme, _, rest = uri.partition("://")
    bucket, _, prefix = rest.partition("/")
    if scheme != "gs" or not bucket:
        raise ValueError(f"not a gs:// address with a bucket: {uri!r}")
    return bucket, prefix.strip("/")


def verified(spark: SparkSession, root: str, manifest: DataFrame, transport: Transport = binary, digest: str = "sha256") -> DataFrame:
    """(name, content) of the files that ``manifest`` (name, digest) lists below ``root``.

    A file whose digest is another, that is there under no name, or that has no digest, ends the
    read with an error that names it; nothing is given of it. ``digest``: sha256 or blake2b (32 bytes),
    as hexadecimal digits of either case. Spark's sources pass over files without a byte, so a file that
    has the digest of nothing and is not found is given as empty.
    """
    names = [r["name"] for r in manifest.select("name").collect()]  # a manifest is a list of files
    if not names:
        return spark.createDataFrame([], "name string, content binary")
    if len(set(names)) != len(names):
        raise ValueError("a manifest names a file twice")
    got = transport(spark, [f"{root.rstrip('/')}/{n}" for n in names])
    own = F.sha2("content", 256) if digest == "sha256" else blake2b_hex("content")
    known = manifest.select("name", F.lower("digest").alias("digest"), F.concat(F.lit("/"), "name").alias("_end"))
    there = got.join(F.broadcast(known), F.col("path").endswith(F.col("_end")), "right") if len(names) <= 100_000 else got.join(known, F.element_at(F.split("path", "/"), -1) == F.element_at(F.split("name", "/"), -1), "right").where(F.col("path").isNull() | F.col("path").endswith(F.col("_end")))
    hollow = F.col("path").isNull() & (F.col("digest") == (hashlib.sha256() if digest == "sha256" else hashlib.blake2b(digest_size=32)).hexdigest())
    problem = F.when(F.coalesce(hollow, F.lit(False)), None).when(F.col("path").isNull(), F.concat(F.lit("missing from the mirror: "), "name")).when(F.col("digest").isNull(), F.concat(F.lit("no digest to hold against: "), "name")).when(own != F.col("digest"), F.concat(F.lit("digest differs: "), "name"))
    return there.select("name", F.when(problem.isNotNull(), F.raise_error(problem).cast("binary")).otherwise(F.coalesce("content", F.lit(b""))).alias("content"))


def fetched(spark: SparkSession, root: str, manifest: DataFrame, to: str, transport: Transport = binary, digest: str = "sha256") -> int:
    """Writes the verified files as a table (name, content) at ``to``, those of earlier calls left as they are; how many were new."""
    from tessera.sources import shared

    new = manifest
    if shared.exists(spark, to):
        new = manifest.join(spark.read.parquet(to).select("name"), "name", "left_anti")
    n = new.count()
    if n:
        verified(spark, root, new, transport, digest).write.mode("append").parquet(to)
    return n


def sizes(files: DataFrame) -> pd.DataFrame:
    """(name, bytes) of verified files; a row a file."""
    return files.select("name", F.octet_length("content").alias("bytes")).toPandas()
