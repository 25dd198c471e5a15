"""Source manifests: YAML on disk, rows in Spark, and merging workers' manifests."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "name string, tokenizer_hash string, dtype string, filter_version string, shards array<struct<prefix:string, num_documents:bigint, token_count:bigint, bin_blake2b:string, idx_blake2b:string>>, raw_jsonl_blake2b map<string,string>"


@dataclass
class Manifest:
    name: str
    tokenizer_hash: str
    dtype: str = "uint32"
    shards: list[dict] = field(default_factory=list)
    filter_version: str = ""
    raw_jsonl_blake2b: dict[str, str] = field(default_factory=dict)

    def text(self) -> str:
        import yaml

        return yaml.safe_dump(asdict(self), sort_keys=False)

    def digest(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()

    def save(self, path: str) -> None:
        import os

        with open(f"{path}.part", "w") as f:
            f.write(self.text())
        os.replace(f"{path}.part", path)

    @classmethod
    def load(cls, path: str) -> Manifest:
        """Keys that older files lack have their defaults; keys that are no longer known are left out."""
        import yaml

        with open(path) as f:
            got = yaml.safe_load(f)
        got["shards"] = [s | {k: s.get(k, "") for k in ("bin_blake2b", "idx_blake2b")} for s in got.get("shards", [])]
        return cls(**{k: v for k, v in got.items() if k in cls.__dataclass_fields__})

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([asdict(self)], SCHEMA)


def merge(workers: list[Manifest], check_filter: bool = False, strict: bool = True) -> Manifest:
    """One manifest of the workers', shards in the workers' order.

    Names, tokenizer hashes and types have to agree (and filter versions, if asked). Raw
    digests are united; two for one file are an error if ``strict``, else the last stays.
    """
    if not workers:
        raise ValueError("nothing to merge")
    for key in ("name", "tokenizer_hash", "dtype", *(["filter_version"] if check_filter else [])):
        if len({getattr(w, key) for w in workers}) > 1:
            raise ValueError(f"the workers' {key} differ")
    raw: dict[str, str] = {}
    for w in workers:
        for k, v in w.raw_jsonl_blake2b.items():
            if strict and raw.get(k, v) != v:
                raise ValueError(f"two digests for {k}")
            raw[k] = v
    a = workers[0]
    return Manifest(a.name, a.tokenizer_hash, a.dtype, [s for w in workers for s in w.shards], a.filter_version, raw)


def shard_rows(manifests: DataFrame) -> DataFrame:
    """(source, shard_id, prefix, num_documents, token_count): a shard's id is its place in its manifest."""
    return manifests.select(F.col("name").alias("source"), F.posexplode("shards").alias("shard_id", "s")).select("source", "shard_id", "s.prefix", "s.num_documents", "s.token_count")


def totals(shards: DataFrame) -> DataFrame:
    """Documents, tokens and tokens per document of each source."""
    t = shards.groupBy("source").agg(F.sum("token_count").alias("total_tokens"), F.sum("num_documents").alias("total_documents"))
    return t.withColumn("avg_tokens", F.col("total_tokens") / F.greatest("total_documents", F.lit(1)))


def conflicts(raw: DataFrame) -> DataFrame:
    """(file) with more than one digest. ``raw``: (file, digest)."""
    return raw.groupBy("file").agg(F.countDistinct("digest").alias("digests")).where("digests > 1")
