"""The per-rank stream: each of ``world`` ranks draws sources by a generator of its own, takes every world-th document of an epoch, and packs its own windows.

A rank's state is a handful of counters (draws, epoch and documents of each source, tokens
carried over). Draws are advanced to the state's, ordinals go on from its counters, so a
stream goes on from any place without what lies before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import packing, sampling
from tessera.operators.order import prefix_sum
from tessera.operators.stream import Position
from tessera.sources.shared import cut

STRETCH = 1 << 16


class RankStream:
    """``lengths``: (source, global_doc, n_tokens); ``shards``: the documents of each shard of each source."""

    def __init__(self, spark: SparkSession, lengths: DataFrame, shards: Mapping[str, Sequence[int]], weights: Sequence[float], seq_len: int, seed: int, world: int):
        if sum(weights) <= 0 or len(weights) != len(shards):
            raise ValueError("a weight for each source, with a sum over zero, is needed")
        self.spark, self.lengths, self.shards, self.weights = spark, lengths, dict(shards), list(weights)
        self.window, self.seed, self.world = seq_len + 1, seed, world
        self.sizes = {s: sum(n) for s, n in self.shards.items()}
        if any(n < world for n in self.sizes.values()):
            raise ValueError("a source with fewer documents than ranks leaves a rank without any")

    def epoch_size(self, source: str, rank: int) -> int:
        """Documents of an epoch that are the rank's."""
        return (self.sizes[source] - rank + self.world - 1) // self.world

    def start(self) -> dict[int, Position]:
        return {r: Position() for r in range(self.world)}

    def draws(self, at: Mapping[int, Position], n: int) -> DataFrame:
        """(rank, draw, source, ordinal, epoch, consumed, perm_pos, global_doc, n_tokens) of each rank's next ``n`` draws after ``at``."""
        names, seed, world = list(self.shards), self.seed, self.world
        edges = np.cumsum(np.array(self.weights, float) / float(sum(self.weights)))
        edges = edges / edges[-1]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for rank, first, count in b.itertuples(index=False):
                    bits = np.random.default_rng(np.array([seed, rank, world], np.uint64)).bit_generator
                    bits.advance(int(first))
                    u = np.random.Generator(bits).random(int(count))
                    yield pd.DataFrame({"rank": np.int32(rank), "draw": first + np.arange(count), "source": np.array(names)[np.searchsorted(edges, u, side="right")]})

        chunks = self.spark.range(len(at) * -(-n // STRETCH)).select("id")
        firsts = self.spark.createDataFrame([(r, p.draws) for r, p in at.items()], "rank int, begun bigint")
        per = -(-n // STRETCH)
        order = {k: r for k, r in enumerate(at)}
        named = self.spark.createDataFrame(list(order.items()), "k bigint, rank int").join(firsts, "rank")
        made = chunks.select(F.expr(f"id div {per}").alias("k"), (F.col("id") % per * STRETCH).alias("off")).join(named, "k")
        made = made.select("rank", (F.col("begun") + F.col("off")).alias("first"), F.least(F.lit(STRETCH), F.lit(n) - F.col("off")).alias("count"))
        drawn = made.mapInPandas(run, "rank int, draw bigint, source string").withColumn("stretch", F.expr(f"draw div {STRETCH}")).withColumn("one", F.lit(1))
        counted = prefix_sum(drawn, ["stretch"], ["draw"], "one", "seen", group=["rank", "source"])
        bases = [(r, s, self.epoch_size(s, r), p.epoch.get(s, 0) * self.epoch_size(s, r) + p.consumed.get(s, 0)) for r, p in at.items() for s in names]
        table = self.spark.createDataFrame(bases, "rank int, source string, own bigint, base bigint")
        ordinal = F.col("base") + F.col("seen")
        placed = counted.join(table, ["rank", "source"]).select("rank", "draw", "source", ordinal.alias("ordinal"), F.expr("cast((base + seen) div own as int)").alias("epoch"), F.expr("(base + seen) % own").alias("consumed"))
        placed = cut(placed.withColumn("perm_pos", F.col("consumed") * self.world + F.col("rank")))
        wanted = [(r["source"], e) for r in placed.groupBy("source").agg(F.min("epoch").alias("a"), F.max("epoch").alias("b")).collect() for e in range(r["a"], r["b"] + 1)]
        perm = sampling.permutations(self.spark, self.shards, self.seed, wanted)
        return placed.join(perm, ["source", "epoch", "perm_pos"]).join(self.lengths, ["source", "global_doc"]).select("rank", "draw", "source", "ordinal", "epoch", "consumed", "perm_pos", "global_doc", "n_tokens")

    def drawn(self, windows: int, at: Mapping[int, Position]) -> DataFrame:
        """Draws that fill ``windows`` further windows of every rank, with where each document begins in its rank's stream; written once."""
        mean = self.lengths.agg(F.avg(F.col("n_tokens") + 1)).first()[0] or 1.0
        guess = int(windows * self.window / mean * 1.1) + 16
        need = {r: windows * self.window - p.carry for r, p in at.items()}
        while True:
            table = cut(self.draws(at, guess))
            full = {r["rank"]: r["n"] for r in table.groupBy("rank").agg(F.sum(F.col("n_tokens") + 1).alias("n")).collect()}
            if all(full.get(r, 0) >= n for r, n in need.items()):
                break
            guess = int(guess * 1.5) + 16
        carry = self.spark.createDataFrame([(r, p.carry, p.windows) for r, p in at.items()], "rank int, carry bigint, out bigint")
        wide = table.withColumn("b", F.expr("draw div 4096")).withColumn("w", F.col("n_tokens") + 1)
        return prefix_sum(wide, ["b"], ["draw"], "w", "s", group=["rank"]).join(carry, "rank").withColumn("stream_start", F.col("s") + F.col("carry"))

    def spans(self, windows: int, at: Mapping[int, Position] | None = None) -> DataFrame:
        """Fragments of each rank's next ``windows`` windows: rank, draw, source, global_doc, rank_window, tok_start, tok_end."""
        placed = self.drawn(windows, at or self.start())
        spans = packing.spans(placed, self.window).where(F.col("global_window") < windows)
        return spans.select("rank", "draw", "source", "global_doc", (F.col("global_window") + F.col("out")).alias("rank_window"), "tok_start", "tok_end")

    def positions(self, windows: int, at: Mapping[int, Position] | None = None) -> dict[int, Position]:
        """Where each rank stands when ``windows`` further windows are out."""
        at = at or self.start()
        used = cut(self.drawn(windows, at).where(F.col("stream_start") < windows * self.window))
        told = {r["rank"]: r for r in used.groupBy("rank").agg(F.max("draw").alias("draw"), F.sum("w").alias("w")).collect()}
        last: dict[int, dict] = {r: {} for r in at}
        for r in used.groupBy("rank", "source").agg(F.max(F.struct("ordinal", "epoch", "consumed")).alias("m")).collect():
            last[r["rank"]][r["source"]] = r["m"]
        out = {}
        for r, p in at.items():
            draws = told[r]["draw"] + 1 if r in told else p.draws
            tokens = p.carry + (told[r]["w"] if r in told else 0) - windows * self.window
            out[r] = Position(draws, {**p.consumed, **{s: m["consumed"] + 1 for s, m in last[r].items()}}, {**p.epoch, **{s: m["epoch"] for s, m in last[r].items()}}, tokens, p.windows + windows)
        return out
