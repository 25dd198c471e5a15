"""Schedules and counts as column arithmetic: batch phases, learning rates, floating-point operations."""

from __future__ import annotations

from dataclasses import dataclass

import math

from pyspark.sql import Column, functions as F


def ceil_div(a: Column | int, b: Column | int) -> Column:
    """Integer ceiling of a / b for positive numbers, without doubles."""
    a, b = (F.lit(x).cast("bigint") if isinstance(x, int) else x for x in (a, b))
    return F.call_function("div", a + b - 1, b)


@dataclass(frozen=True)
class Phases:
    """Global batch sizes in tokens, and the consumed tokens at which the next one begins."""

    warmup: int
    main: int
    late: int
    to_main: int
    to_late: int

    def target(self, consumed: Column) -> Column:
        return F.when(consumed < self.to_main, self.warmup).when(consumed < self.to_late, self.main).otherwise(self.late).cast("bigint")


def microbatches(target: Column, micro_batch: int, seq_len: int) -> Column:
    """Micro-batches of a step whose batch is ``target`` tokens."""
    return F.greatest(F.lit(1).cast("bigint"), ceil_div(target, micro_batch * seq_len))


def legacy_accumulation(target: Column, micro_batch: int, seq_len: int, replicas: Column) -> Column:
    """Gradient accumulation steps where every replica holds a micro-batch."""
    return F.greatest(F.lit(1).cast("bigint"), ceil_div(target, F.lit(micro_batch * seq_len).cast("bigint") * F.greatest(replicas, F.lit(1)).cast("bigint")))


def owner_rank(microbatch: Column, world: int) -> Column:
    return F.pmod(microbatch, F.lit(max(world, 1)))


def accumulation(microbatches: Column, rank: Column, world: int) -> Column:
    """How many of a step's micro-batches a rank owns."""
    return F.greatest(F.lit(0).cast("bigint"), F.call_function("div", microbatches - rank + (world - 1), F.lit(world).cast("bigint")))


def window_position(window: Column, base: Column, count: Column, micro_batch: int) -> Column:
    """(microbatch, slot) of a window in a step; a window outside it is an error."""
    rel = window - base
    inside = (rel >= 0) & (rel < count * micro_batch)
    checked = F.when(inside, rel).otherwise(F.raise_error(F.concat(F.lit("window outside the step: "), window.cast("string"))).cast("bigint"))
    return F.struct(F.call_function("div", checked, F.lit(micro_batch).cast("bigint")).alias("microbatch"), F.pmod(checked, F.lit(micro_batch)).alias("slot"))


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _warm(c: Column, peak: float, warm: float, rest: Column) -> Column:
    return F.when(c < warm, F.lit(peak) * c / max(warm, 1)).otherwise(rest)


def lr_cosine(c: Column, peak: float, warm: float, total: float, least: float) -> Column:
    """Linear warm-up, then half a cosine from ``peak`` to ``least * peak``."""
    low = peak * least
    q = _clamped((c - warm) / max(total - warm, 1))
    return _warm(c, peak, warm, F.lit(low) + F.lit(0.5 * (peak - low)) * (1 + F.cos(F.lit(math.pi) * q)))


def lr_wsd(c: Column, peak: float, warm: float, total: float, decay_start: float, decay_to: float) -> Column:
    """Warm-up, stable, then linear decay from ``decay_start`` of the run."""
    d = decay_start * total
    q = _clamped((c - d) / max(total - d, 1))
    return _warm(c, peak, warm, F.when(c < d, F.lit(peak)).otherwise(F.lit(peak) + F.lit(peak * decay_to - peak) * q))


def lr_linear_anneal(c: Column, peak: float, warm: float, total: float, start: float, least: float) -> Column:
    """Stable, then linear from ``start`` tokens to ``least * peak`` at the end."""
    if total <= start:
        raise ValueError("the run ends before its anneal starts")
    a = max(start, warm)
    q = _clamped((c - a) / max(total - a, 1))
    return _warm(c, peak, warm, F.when(c < a, F.lit(peak)).otherwise(F.lit(peak) + F.lit(peak * least - peak) * q))


def rewarmed(lr: Column, c: Column, anchor: Column, ramp: float) -> Column:
    """A short ramp from zero after a restart at ``anchor``."""
    e = c - anchor
    return F.when(e < ramp, lr * F.greatest(F.lit(0.0), e / ramp)).otherwise(lr)


def flops_per_token(layers: Column, dim: Column, seq: Column, vocab: Column) -> Column:
    return 72 * layers * dim * dim + 12 * layers * seq * dim + 6 * vocab * dim


def mfu(tokens_per_sec: Column, flops: Column, devices: int, peak: float = 1e15) -> Column:
    return tokens_per_sec * flops / (devices * peak)


def clip_coefficient(norm: Column, most: float) -> Column:
    return F.least(F.lit(most) / (norm + 1e-6), F.lit(1.0))


def chunk_bounds(size: Column, shards: int, shard: Column) -> Column:
    """(start, end) of a shard's rows when ``size`` rows are cut into chunks of equal ceiling."""
    chunk = ceil_div(size, shards)
    start = F.least(chunk * shard, size)
    return F.struct(start.alias("start"), F.least(start + chunk, size).alias("end"))


def perplexity(nll: Column, count: Column) -> Column:
    return F.when(count == 0, F.lit(float("nan"))).otherwise(F.exp(nll / count))


def anneal_guard(consumed: int, anneal_start: int, total: int) -> list[str]:
    """Warnings of a resume into an anneal; a resume that cannot be right is an error."""
    if consumed < anneal_start:
        raise ValueError(f"resumes at {consumed}, before the anneal at {anneal_start}")
    if total <= consumed:
        raise ValueError(f"nothing is left: {consumed} of {total} tokens are consumed")
    return [f"resumes {consumed - anneal_start} tokens into the anneal"] if consumed > anneal_start else []
