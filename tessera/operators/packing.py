"""Packing documents into fixed windows, in closed form.

A document of ``n`` tokens whose stream begins at ``s`` (the exclusive running sum of all
lengths plus one end token each) has fragments in the windows ``s div W`` to
``(s + n - 1) div W``. So packing is a prefix sum and an explode, with no buffer to carry.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.functions import schedules as S


def spans(placed: DataFrame, window: int, start: str = "stream_start", n: str = "n_tokens") -> DataFrame:
    """A row for each fragment: ``placed`` with global_window, tok_start, tok_end. Documents without tokens have none."""
    s, k, g = F.col(start), F.col(n), F.col("global_window")
    div = lambda a: F.call_function("div", a, F.lit(window).cast("bigint"))
    wide = placed.where(k > 0).withColumn("global_window", F.explode(F.sequence(div(s), div(s + k - 1))))
    return wide.withColumn("tok_start", F.greatest(g * window - s, F.lit(0)).cast("int")).withColumn("tok_end", F.least((g + 1) * window - s, k).cast("int"))


class Piece(NamedTuple):
    """A stretch of steps with one batch size: its first step, the steps in it, tokens and windows before it, micro-batches a step."""

    step: int
    steps: int
    consumed: int
    window: int
    microbatches: int


def plan_pieces(phases: S.Phases, micro_batch: int, seq_len: int, total_tokens: int, consumed: int = 0, window: int = 0, step: int = 0) -> list[Piece]:
    """The three pieces of a run, from its beginning or from where a checkpoint left it.

    A phase is entered at known tokens and lasts the ceiling of what is left to its boundary
    over its step, so each piece is arithmetic in the step's or the window's number.
    """
    unit, out = micro_batch * seq_len, []
    for target, end in ((phases.warmup, phases.to_main), (phases.main, phases.to_late), (phases.late, total_tokens)):
        m = max(1, -(-target // unit))
        steps = max(0, -(-(min(end, total_tokens) - consumed) // (m * unit)))
        out.append(Piece(step, steps, consumed, window, m))
        step, consumed, window = step + steps, consumed + steps * m * unit, window + steps * m * micro_batch
    return out


def _map_columns(step: Column, rel: Column, micro_batch: int, world: int, order: list[str]) -> list[Column]:
    microbatch = F.call_function("div", rel, F.lit(micro_batch).cast("bigint"))
    frag = F.row_number().over(W.partitionBy("global_window").orderBy(*order)) - 1
    return [
        step.cast("int").alias("step"),
        F.col("global_window"),
        microbatch.cast("int").alias("microbatch"),
        F.pmod(rel, F.lit(micro_batch)).cast("smallint").alias("slot"),
        frag.cast("smallint").alias("frag_idx"),
        S.owner_rank(microbatch, world).cast("smallint").alias("dp_rank"),
        F.col("source"),
        F.col("shard_id").cast("int").alias("shard_id"),
        F.col("local_doc").cast("int").alias("local_doc"),
        F.col("tok_start"),
        F.col("tok_end"),
    ]


def doc_map(fragments: DataFrame, windows_a_step: int, micro_batch: int, world: int, order: list[str]) -> DataFrame:
    """The step-to-document map of fragments under a constant batch: step, microbatch, slot, frag_idx, dp_rank and the span."""
    g = F.col("global_window")
    step = F.call_function("div", g, F.lit(windows_a_step).cast("bigint"))
    return fragments.select(*_map_columns(step, F.pmod(g, F.lit(windows_a_step)), micro_batch, world, order))


def phased_doc_map(fragments: DataFrame, pieces: Sequence[Piece], micro_batch: int, world: int, order: list[str]) -> DataFrame:
    """``doc_map`` where the batch grows with the phases: each window's step from its piece alone, without a join.

    Windows before the first piece (a resumed run) and beyond the last have no step and no rows.
    """
    live = [p for p in pieces if p.steps]
    g = F.col("global_window")
    if not live:
        return fragments.limit(0).select(*_map_columns(g, g, micro_batch, world, order))
    step = rel = None
    for p in live:
        width, past = p.microbatches * micro_batch, g - p.window
        inside = past < p.steps * width
        at, of = F.call_function("div", past, F.lit(width).cast("bigint")) + p.step, F.pmod(past, F.lit(width).cast("bigint"))
        step, rel = (F.when(inside, at), F.when(inside, of)) if step is None else (step.when(inside, at), rel.when(inside, of))
    end = live[-1].window + live[-1].steps * live[-1].microbatches * micro_batch
    return fragments.where((g >= live[0].window) & (g < end)).select(*_map_columns(step, rel, micro_batch, world, order))


def step_plan(spark, phases: S.Phases, micro_batch: int, seq_len: int, total_tokens: int, consumed: int = 0, window: int = 0, step: int = 0) -> DataFrame:
    """(step, consumed_tokens, base_window, microbatches, tokens_this_step) of a whole run, or of what follows a checkpoint."""
    out = None
    for p in plan_pieces(phases, micro_batch, seq_len, total_tokens, consumed, window, step):
        m, unit, k = p.microbatches, p.microbatches * micro_batch, F.col("id") - p.step
        part = spark.range(p.step, p.step + p.steps).select(F.col("id").alias("step"), (k * (unit * seq_len) + p.consumed).alias("consumed_tokens"), (k * unit + p.window).alias("base_window"), F.lit(m).cast("bigint").alias("microbatches"), F.lit(unit * seq_len).cast("bigint").alias("tokens_this_step"))
        out = part if out is None else out.unionByName(part)
    return out


def owned_only(fragments: DataFrame, rank: int, world: int, micro_batch: int, windows_a_step: int) -> DataFrame:
    """The fragments of windows that a rank owns; the plan is made of lengths, and tokens are joined to these alone."""
    rel = F.pmod(F.col("global_window"), F.lit(windows_a_step))
    return fragments.where(S.owner_rank(F.call_function("div", rel, F.lit(micro_batch).cast("bigint")), world) == rank)


def window_tokens(fragments: DataFrame, tokens: Column, end_id: int, window: int) -> DataFrame:
    """(global_window, tokens) of full windows, from fragments in stream order (``frag_idx``) with their documents' ids; an end id follows each document."""
    piece = F.slice(tokens, F.col("tok_start") + 1, F.col("tok_end") - F.col("tok_start"))
    closed = F.when(F.col("tok_end") == F.size(tokens), F.concat(piece, F.array(F.lit(end_id)))).otherwise(piece)
    got = fragments.select("global_window", F.struct("stream_start", closed.alias("ids")).alias("p")).groupBy("global_window").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return got.select("global_window", F.flatten(F.transform("p", lambda x: x["ids"])).alias("tokens"))
