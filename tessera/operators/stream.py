"""The canonical stream: seeded draws over sources, resolved to documents, packed into windows, at any place.

Nothing is walked: draw k's source is computed from k, its document from its ordinal in its
source, its place from a prefix sum of lengths. A position is a handful of counters, and the
stream goes on from it with the tokens that were left over as an offset.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import packing, sampling
from tessera.operators.order import prefix_sum
from tessera.sources.shared import cut


@dataclass(frozen=True)
class Position:
    """Draws made, and of each source the epoch and the documents consumed in it; tokens carried over; windows emitted."""

    draws: int = 0
    consumed: Mapping[str, int] = field(default_factory=dict)
    epoch: Mapping[str, int] = field(default_factory=dict)
    carry: int = 0
    windows: int = 0


class CanonicalStream:
    """``lengths``: (source, global_doc, n_tokens); ``shards``: the documents of each shard of each source."""

    def __init__(self, spark: SparkSession, lengths: DataFrame, shards: Mapping[str, Sequence[int]], weights: Sequence[float], seq_len: int, seed: int):
        self.spark, self.lengths, self.shards, self.weights = spark, lengths, dict(shards), list(weights)
        self.window, self.seed = seq_len + 1, seed
        self.sizes = {s: sum(n) for s, n in self.shards.items()}

    def draws(self, start: Position, last: int) -> DataFrame:
        """(draw, source, ordinal, epoch, perm_pos, global_doc, n_tokens) of the draws after ``start`` up to ``last``; none before is made again."""
        drawn = sampling.source_draws(self.spark, list(self.shards), self.weights, self.seed, start.draws, last)
        table = [(s, n, start.epoch.get(s, 0) * n + start.consumed.get(s, 0)) for s, n in self.sizes.items()]
        placed = cut(sampling.with_positions(drawn, self.spark.createDataFrame(table, "source string, n_docs bigint, base bigint")))
        wanted = [(r["source"], e) for r in placed.groupBy("source").agg(F.min("epoch").alias("a"), F.max("epoch").alias("b")).collect() for e in range(r["a"], r["b"] + 1)]
        perm = sampling.permutations(self.spark, self.shards, self.seed, wanted)
        return placed.join(perm, ["source", "epoch", "perm_pos"]).join(self.lengths, ["source", "global_doc"]).select("draw", "source", "ordinal", "epoch", "perm_pos", "global_doc", "n_tokens")

    def placed(self, windows: int, start: Position = Position()) -> DataFrame:
        """Draws that fill ``windows`` further windows, with the running sum ``s`` of their lengths: a number estimated from the mean length, made longer if it falls short. Written once."""
        mean = self.lengths.agg(F.avg(F.col("n_tokens") + 1)).first()[0] or 1.0
        need = windows * self.window - start.carry
        guess = int(need / mean * 1.05) + 16
        while True:
            drawn = cut(self.draws(start, start.draws + guess))
            if (drawn.agg(F.sum(F.col("n_tokens") + 1)).first()[0] or 0) >= need:
                wide = drawn.withColumn("b", F.expr("draw div 4096")).withColumn("w", F.col("n_tokens") + 1)
                return prefix_sum(wide, ["b"], ["draw"], "w", "s")
            guess = int(guess * 1.5) + 16

    def spans(self, windows: int, start: Position = Position()) -> DataFrame:
        """Fragments of the next ``windows`` windows after ``start``: draw, source, global_doc, global_window, tok_start, tok_end.

        What ``start`` carried over lies at the front of the first window and has no span.
        """
        placed = self.placed(windows, start).withColumn("stream_start", F.col("s") + start.carry)
        spans = packing.spans(placed, self.window).where(F.col("global_window") < windows)
        return spans.select("draw", "source", "global_doc", (F.col("global_window") + start.windows).alias("global_window"), "tok_start", "tok_end")

    def position(self, windows: int, start: Position = Position()) -> Position:
        """Where the stream stands when ``windows`` further windows are out: documents are drawn until the last is full."""
        need = windows * self.window - start.carry
        used = self.placed(windows, start).where(F.col("s") < need)
        told = used.agg(F.max("draw"), F.sum("w")).first()
        consumed, epoch = dict(start.consumed), dict(start.epoch)
        for r in used.groupBy("source").agg(F.max(F.struct("ordinal", "epoch", "perm_pos")).alias("m")).collect():
            consumed[r["source"]], epoch[r["source"]] = r["m"]["perm_pos"] + 1, r["m"]["epoch"]
        draws = start.draws if told[0] is None else told[0] + 1
        return Position(draws, consumed, epoch, (told[1] or 0) - need, start.windows + windows)

    def refs(self, windows: int, start: Position = Position()) -> DataFrame:
        """(source, global_doc) of all documents drawn for the next windows, the last among them however little of it is used."""
        end = self.position(windows, start)
        return self.draws(start, end.draws).select("source", "global_doc").distinct()
