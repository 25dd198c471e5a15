"""Seeded draws and permutations, each computed where its rows are.

The generators are numpy's PCG64 and CPython's Mersenne Twister. PCG64 can be advanced to
any draw, so draws split over tasks; a permutation's unit is a shard, which is a task.
"""

from __future__ import annotations

import array
import random
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.text import blank
from tessera.operators.order import prefix_sum
from tessera.sources.shared import cut


def stable_name_hash(name: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:4], "big")


def source_draws(spark: SparkSession, names: Sequence[str], weights: Sequence[float], seed: int, first: int, last: int, partitions: int = 8) -> DataFrame:
    """(draw, source) for draws ``first`` to ``last`` (exclusive) of a weighted categorical stream.

    A draw is the place of one uniform number among the running sums of the weights.
    """
    total = float(sum(weights))
    if total <= 0:
        raise ValueError("weights sum to nothing")
    edges = np.cumsum(np.array(weights, float) / total)
    edges = edges / edges[-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bits = np.random.default_rng(np.array([seed], np.uint64)).bit_generator
            k = b["id"].to_numpy()
            bits.advance(int(k[0]))
            u = np.random.Generator(bits).random(int(k[-1] - k[0]) + 1)
            yield pd.DataFrame({"draw": k, "source": np.array(names)[np.searchsorted(edges, u[k - k[0]], side="right")]})

    return spark.range(first, last, numPartitions=partitions).mapInPandas(run, "draw bigint, source string")


def permutations(spark: SparkSession, shards: Mapping[str, Sequence[int]], seed: int, wanted: Sequence[tuple[str, int]]) -> DataFrame:
    """(source, epoch, perm_pos, global_doc) of all ``wanted`` (source, epoch): shards in shuffled order, the documents of each shuffled.

    The driver lays out shards alone; each shard's documents are shuffled where it is dealt to.
    """
    names = ["source", "epoch", "shard", "first", "n", "pos"]
    laid, rows = [], 0
    for source, epoch in wanted:
        h, docs = stable_name_hash(source), np.asarray(shards[source], np.int64)
        order = np.random.default_rng(np.array([seed, h, epoch], np.uint64)).permutation(len(docs))
        first, n = np.cumsum(docs) - docs, docs[order]
        laid.append(pa.Table.from_arrays([pa.array([source] * len(docs), pa.string()), pa.array(np.full(len(docs), epoch, np.int32)), pa.array(order.astype(np.int32)), pa.array(first[order]), pa.array(n), pa.array(np.cumsum(n) - n)], names))
        rows += len(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, int] = {}

        def told(source: list, epoch: list, first: list, pos: list, local: list) -> pa.RecordBatch:
            n = [len(x) for x in local]
            inner = np.arange(sum(n)) - np.repeat(np.cumsum(n) - n, n)
            name = pa.array(source, pa.string()).take(pa.array(np.repeat(np.arange(len(n)), n)))
            return pa.RecordBatch.from_arrays([name, pa.array(np.repeat(np.array(epoch, np.int32), n)), pa.array(inner + np.repeat(pos, n)), pa.array(np.concatenate(local) + np.repeat(first, n))], ["source", "epoch", "perm_pos", "global_doc"])

        for b in batches:  # many small shards make one batch of rows, not one each
            held, size = [], 0
            for source, epoch, shard, first, n, pos in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                h = hashes[source] if source in hashes else hashes.setdefault(source, stable_name_hash(source))
                held.append((source, epoch, first, pos, np.random.default_rng(np.array([seed, h, epoch, shard], np.uint64)).permutation(n)))
                size += n
                if size >= 1 << 16:
                    yield told(*map(list, zip(*held, strict=True)))
                    held, size = [], 0
            if held:
                yield told(*map(list, zip(*held, strict=True)))

    kinds = "source string, epoch int, perm_pos bigint, global_doc bigint"
    if not rows:
        return spark.createDataFrame([], kinds)
    table = spark.createDataFrame(pa.concat_tables(laid))
    return table.repartition(max(1, min(rows, 64)), "source", "epoch", "shard").mapInArrow(run, kinds)


def epoch_permutation(spark: SparkSession, source: str, shard_docs: Sequence[int], seed: int, epoch: int) -> DataFrame:
    """(source, epoch, perm_pos, global_doc): shards in shuffled order, the documents of each shuffled."""
    return permutations(spark, {source: shard_docs}, seed, [(source, epoch)])


def with_positions(draws: DataFrame, sizes: DataFrame, stretch: int = 1 << 16) -> DataFrame:
    """Draws with their ordinal in their source, and the epoch and position that falls on. ``sizes``: (source, n_docs), and ``base``, the documents drawn before, if not none.

    Counted in stretches of draws, so that a source is not one task.
    """
    counted = prefix_sum(draws.withColumn("_stretch", F.expr(f"draw div {stretch}")).withColumn("_one", F.lit(1)), ["_stretch"], ["draw"], "_one", "ordinal", group=["source"]).drop("_stretch", "_one")
    known = sizes if "base" in sizes.columns else sizes.withColumn("base", F.lit(0))
    placed = counted.join(known, "source").withColumn("ordinal", (F.col("ordinal") + F.col("base")).cast("bigint")).drop("base")
    return placed.withColumn("epoch", F.call_function("div", F.col("ordinal"), F.col("n_docs")).cast("int")).withColumn("perm_pos", F.pmod("ordinal", "n_docs"))


def resolve(docs: DataFrame, cumulative: DataFrame, stretch: int = 256) -> DataFrame:
    """Global document numbers to (shard_id, local_doc). ``cumulative``: (source, shard_id, cum, next_cum).

    A document is compared with the shards that reach into its stretch of numbers alone, not
    with all of its source.
    """
    div = lambda c: F.call_function("div", c.cast("bigint"), F.lit(stretch).cast("bigint"))
    full = cumulative.where("next_cum > cum")
    near = full.select("source", "shard_id", "cum", "next_cum", F.explode(F.sequence(div(F.col("cum")), div(F.col("next_cum") - 1))).alias("_at"))
    inside = (F.col("global_doc") >= F.col("cum")) & (F.col("global_doc") < F.col("next_cum"))
    return docs.alias("d").join(near.alias("c"), (F.col("d.source") == F.col("c.source")) & (div(F.col("global_doc")) == F.col("_at")) & inside).select("d.*", "c.shard_id", (F.col("global_doc") - F.col("cum")).alias("local_doc"))


def bucket_shuffle(rows: DataFrame, seed: int, buckets: int = 512, order: str = "pos", text: str = "text", stretch: int = 1 << 22) -> DataFrame:
    """``rows`` shuffled by two deterministic passes, blank lines dropped, as ``out_bucket`` and ``out_pos``.

    Pass one deals lines to buckets by one generator in line order (``order`` is unique): lines are
    numbered by ranges, and the generator's draws come from any number of tasks (``twister.below``).
    Pass two shuffles each bucket by a generator of its own, which needs the bucket's size alone: a
    task a bucket writes out its places, four or eight bytes a line, and the lines are joined to them. No
    task gathers the lines of a bucket. A blank line is null, empty or of Unicode white space.
    """
    from tessera.operators import twister

    spark = rows.sparkSession
    kept = rows.where(~blank(F.col(text)))
    # The parts are ranges of the order; numbers run on from part to part.
    ranged = cut(kept.select(F.col(order).alias("key")).repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    numbered = prefix_sum(ranged.withColumn("one", F.lit(1)), ["part"], ["key"], "one", "number").select("key", "number")
    draws = twister.below(spark, seed, buckets, ranged.count(), stretch).withColumnRenamed("drawn", "bucket")
    dealt = cut(numbered.join(draws, "number").select("key", "bucket", "number", F.expr(f"number div {stretch}").alias("stretch"), F.lit(1).alias("one")))
    placed = prefix_sum(dealt, ["stretch"], ["number"], "one", "at", group=["bucket"]).select("key", "bucket", "at")
    sizes = cut(dealt.groupBy("bucket").agg(F.count("*").alias("n")))

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, n in zip(b.column("bucket").to_pylist(), b.column("n").to_pylist(), strict=True):
                at = array.array("I" if n < 1 << 32 else "Q", range(n))
                random.Random(seed * 1_000_003 + bucket + 1).shuffle(at)
                for lo in range(0, n, 1 << 18):
                    part = np.array(at[lo : lo + (1 << 18)], np.int64)
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.full(len(part), bucket, np.int64)), "out_pos": pa.array(np.arange(lo, lo + len(part))), "at": pa.array(part)})

    out = sizes.repartition(max(1, min(buckets, spark.sparkContext.defaultParallelism * 8)), "bucket").mapInArrow(shuffle, "bucket bigint, out_pos bigint, at bigint")
    told = placed.join(out, ["bucket", "at"]).select(F.col("key").alias(order), F.col("bucket").cast("int").alias("out_bucket"), F.col("out_pos").cast("int").alias("out_pos"))
    return kept.join(told, order)
