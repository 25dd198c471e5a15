"""Token shards as ``.bin`` and ``.idx`` files, and the Spark source and sink for them.

``.bin`` has the ids of all documents with nothing between; ``.idx`` says where each
begins. Numbers are little-endian. Header: magic, version, type, documents, tokens; then
documents + 1 offsets in tokens, and as many in bytes.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC, VERSION = b"MMIDIDX\0", 1
#: The types and their codes.
KINDS = {1: "uint8", 2: "int8", 3: "int16", 4: "int32", 5: "int64", 6: "float32", 7: "float64", 8: "uint16", 9: "uint32"}
HEADER = struct.Struct("<8sQBqq")


def index_bytes(lengths: np.ndarray, kind: str = "uint32") -> bytes:
    """The ``.idx`` of documents of these lengths."""
    code = next(c for c, k in KINDS.items() if k == kind)
    off = np.concatenate(([0], np.cumsum(lengths))).astype("<i8")
    return HEADER.pack(MAGIC, VERSION, code, len(lengths), int(off[-1])) + off.tobytes() + (off * np.dtype(kind).itemsize).astype("<i8").tobytes()


def parse_index(data: bytes) -> tuple[str, np.ndarray, np.ndarray]:
    """(type, offsets in tokens, offsets in bytes)."""
    if len(data) < HEADER.size or data[:8] != MAGIC:
        raise ValueError("not an index file")
    _, version, code, n, _ = HEADER.unpack_from(data)
    if version != VERSION or code not in KINDS:
        raise ValueError(f"index of version {version} and type {code} is not known")
    tokens = np.frombuffer(data, "<i8", n + 1, HEADER.size)
    return KINDS[code], tokens, np.frombuffer(data, "<i8", n + 1, HEADER.size + 8 * (n + 1))


class ShardReader:
    """One shard by its prefix: a document by number (negative from the end), its length without its ids, or all in order."""

    def __init__(self, prefix: str, index_only: bool = False):
        with open(f"{prefix}.idx", "rb") as f:
            self.kind, self.tokens, self.bytes = parse_index(f.read())
        self._ids = None if index_only or not self.bytes[-1] else np.memmap(f"{prefix}.bin", np.dtype(self.kind).newbyteorder("<"), "r")

    def __len__(self) -> int:
        return len(self.tokens) - 1

    def _at(self, i: int) -> int:
        j = i + len(self) if i < 0 else i
        if not 0 <= j < len(self):
            raise IndexError(i)
        return j

    def length(self, i: int) -> int:
        j = self._at(i)
        return int(self.tokens[j + 1] - self.tokens[j])

    def document(self, i: int) -> np.ndarray:
        j = self._at(i)
        if self._ids is None:
            if self.bytes[-1]:
                raise RuntimeError("opened without its ids")
            return np.zeros(0, self.kind)
        return self._ids[self.tokens[j] : self.tokens[j + 1]]

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self.document(i) for i in range(len(self)))


def write_shard(prefix: str, documents, kind: str = "uint32") -> dict:
    """Writes a shard and says what a manifest has of it. Both files appear under their names when they are whole."""
    lengths, h, tokens = [], hashlib.blake2b(digest_size=32), 0
    part = f"{uuid.uuid4().hex}.part"  # of this attempt alone
    with open(f"{prefix}.bin.{part}", "wb") as f:
        for d in documents:
            data = np.asarray(d).astype(np.dtype(kind).newbyteorder("<")).tobytes()
            f.write(data)
            h.update(data)
            lengths.append(len(d))
            tokens += len(d)
    index = index_bytes(np.array(lengths, np.int64), kind)
    with open(f"{prefix}.idx.{part}", "wb") as f:
        f.write(index)
    os.replace(f"{prefix}.bin.{part}", f"{prefix}.bin")
    os.replace(f"{prefix}.idx.{part}", f"{prefix}.idx")
    return {"prefix": os.path.basename(prefix), "num_documents": len(lengths), "token_count": tokens, "bin_blake2b": h.hexdigest(), "idx_blake2b": hashlib.blake2b(index, digest_size=32).hexdigest()}


class _Shard(InputPartition):
    def __init__(self, shard: int, prefix: str):
        self.shard, self.prefix = shard, prefix


class _Reader(DataSourceReader):
    def __init__(self, prefixes: list[str], index_only: bool, batch: int):
        self.prefixes, self.index_only, self.batch = prefixes, index_only, batch

    def partitions(self) -> list[_Shard]:
        return [_Shard(i, p) for i, p in enumerate(self.prefixes)]

    def read(self, partition: _Shard) -> Iterator[pa.RecordBatch]:
        r = ShardReader(partition.prefix, self.index_only)
        for lo in range(0, len(r), self.batch):
            hi = min(len(r), lo + self.batch)
            off = r.tokens[lo : hi + 1]
            n = hi - lo
            columns = [pa.array(np.full(n, partition.shard, np.int32)), pa.array(np.arange(lo, hi, dtype=np.int32)), pa.array(np.diff(off).astype(np.int32))]
            if not self.index_only:
                ids = np.concatenate([np.asarray(r.document(i)) for i in range(lo, hi)]) if n else np.zeros(0)
                columns.append(pa.ListArray.from_arrays(pa.array((off - off[0]).astype(np.int32)), pa.array(ids.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, ["shard_id", "local_doc", "n_tokens", *([] if self.index_only else ["tokens"])])


class IdxSource(DataSource):
    """``spark.read.format("mmididx").option("prefixes", "a,b")``: a partition for each shard; ``index_only`` reads no ids."""

    @classmethod
    def name(cls) -> str:
        return "mmididx"

    def _index_only(self) -> bool:
        return self.options.get("index_only", "false").lower() == "true"

    def schema(self) -> str:
        return "shard_id int, local_doc int, n_tokens int" + ("" if self._index_only() else ", tokens array<bigint>")

    def reader(self, schema) -> _Reader:
        return _Reader([p for p in self.options["prefixes"].split(",") if p], self._index_only(), int(self.options.get("batch", "1024")))


def write_shards(docs: DataFrame, directory: str, source: str, kind: str = "uint32", shard: str = "shard_id", order: str = "local_doc", tokens: str = "tokens") -> DataFrame:
    """Writes a shard for each ``shard`` value, in ``order``, to a folder that all executors share; the manifest's rows.

    A shard is one task's; a task that is run again writes the same bytes to the same names.
    """
    import pandas as pd

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(rows[shard].iloc[0])
        told = write_shard(f"{directory}/{source}_{k:05d}", rows.sort_values(order)[tokens], kind)
        return pd.DataFrame([{"shard_id": k, **told}])

    return docs.select(shard, order, tokens).groupBy(shard).applyInPandas(one, "shard_id int, prefix string, num_documents bigint, token_count bigint, bin_blake2b string, idx_blake2b string")


def read_shards(spark: SparkSession, prefixes: list[str], index_only: bool = False) -> DataFrame:
    spark.dataSource.register(IdxSource)
    return spark.read.format("mmididx").option("prefixes", ",".join(prefixes)).option("index_only", str(index_only).lower()).load()


def digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, digest) of files: BLAKE2b with 32 bytes."""
    from tessera.functions.registry import blake2b_hex

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.substring_index("path", "/", -1).alias("file"), blake2b_hex("content").alias("digest"))


def verified(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """``manifest`` (file, digest) with ``state``: ok, mismatch or missing."""
    f = found.select("file", F.col("digest").alias("_d"))
    return manifest.join(f, "file", "left").withColumn("state", F.when(F.col("_d").isNull(), "missing").when(F.col("_d") == F.lower("digest"), "ok").otherwise("mismatch")).drop("_d")
