"""Command line: ``python -m tessera.cli <command> ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from tessera.functions.registry import bpe_decoder, bpe_encoder
from tessera.operators.order import greedy_shards
from tessera.session import session
from tessera.sources import idx, manifests, runs, text


def build_source(spark, texts, tokenizer: str, directory: str, name: str, target_bytes: int, tokenizer_hash: str = ""):
    """Texts (pos, text) to shards and a manifest: tokenize, drop what has no token, cut greedily by bytes, write, digest."""
    ids = texts.select("pos", bpe_encoder(tokenizer)("text").alias("tokens")).where(F.size("tokens") > 0).withColumn("source", F.lit(name)).withColumn("bytes", F.size("tokens") * 4)
    shards = greedy_shards(ids, target_bytes, "source", "pos", "bytes")
    docs = ids.join(shards, ["source", "pos"]).select("shard_id", F.col("pos").alias("local_doc"), "tokens")
    told = idx.write_shards(docs, directory, name).orderBy("shard_id").collect()
    made = manifests.Manifest(name, tokenizer_hash, shards=[{k: r[k] for k in ("prefix", "num_documents", "token_count", "bin_blake2b", "idx_blake2b")} for r in told])
    made.save(f"{directory}/manifest.yaml")
    return made


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("shard", help="JSON lines to .bin/.idx shards and a manifest")
    for x in ("input", "output", "name", "tokenizer"):
        a.add_argument(f"--{x}", required=True)
    a.add_argument("--target-bytes", type=int, default=1 << 30)
    a = sub.add_parser("merge-manifests", help="workers' manifests to one")
    a.add_argument("--output", required=True)
    a.add_argument("inputs", nargs="+")
    a = sub.add_parser("inspect", help="the first documents of a shard as text")
    for x in ("prefix", "tokenizer"):
        a.add_argument(f"--{x}", required=True)
    a.add_argument("-n", type=int, default=3)
    a = sub.add_parser("token-stats", help="bytes for each token of a manifest's source")
    a.add_argument("manifest")
    a = sub.add_parser("query", help="a registered query as Parquet")
    for x in ("name", "data", "output"):
        a.add_argument(f"--{x}", required=True)
    o = p.parse_args(argv)
    if o.command == "merge-manifests":
        manifests.merge([manifests.Manifest.load(x) for x in sorted(o.inputs)]).save(o.output)
        return 0
    if o.command == "token-stats":
        m = manifests.Manifest.load(o.manifest)
        docs, tokens = sum(s["num_documents"] for s in m.shards), sum(s["token_count"] for s in m.shards)
        print(f"{m.name}: {docs} documents, {tokens} tokens, {tokens / max(docs, 1):.1f} a document")
        return 0
    spark = session()
    if o.command == "shard":
        texts = text.jsonl_in_order(spark, o.input)
        made = build_source(spark, texts, o.tokenizer, o.output, o.name, o.target_bytes)
        print(f"{len(made.shards)} shards, manifest {made.digest()}")
    elif o.command == "inspect":
        first = runs.head(idx.read_shards(spark, [o.prefix]), o.n)
        for r in first.select("local_doc", bpe_decoder(o.tokenizer)("tokens").alias("text")).orderBy("local_doc").collect():
            print(f"[{r['local_doc']}] {r['text']}")
    elif o.command == "query":
        from tessera import catalog

        catalog.queries()[o.name](spark, o.data).write.parquet(o.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
