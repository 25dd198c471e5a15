"""Training telemetry: gradient norms, spikes, dead tensors."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.operators.order import runs
from tessera.sources.shared import cut


def norm_rollup(norms: DataFrame, step: str = "step", digits: int = 6) -> DataFrame:
    """Root sums of squares of ``norm`` overall, by category and by layer, in one pass."""
    sq = F.sum(F.col("norm") * F.col("norm"))
    sets = norms.groupingSets([[F.col(step)], [F.col(step), F.col("category")], [F.col(step), F.col("layer")]], F.col(step), F.col("category"), F.col("layer"))
    return sets.agg(F.bround(F.sqrt(sq), digits).alias("norm"), F.grouping_id().alias("level"))


def top_norms(norms: DataFrame, k: int = 12) -> DataFrame:
    """The ``k`` largest of each step, equal ones in order of ``ordinal``."""
    return norms.withColumn("rank", F.row_number().over(W.partitionBy("step").orderBy(F.col("norm").desc(), "ordinal"))).where(F.col("rank") <= k)


def dead_runs(norms: DataFrame, least: int, name: str = "name", step: str = "step") -> DataFrame:
    """Stretches of ``least`` or more logged steps in which a parameter's norm is exactly zero (NaN is not)."""
    zero = F.coalesce((F.col("norm") == 0.0) & ~F.isnan("norm"), F.lit(False))
    marked = runs(norms.withColumn("_zero", zero), [name], step, F.col("_zero"))
    return marked.where("_zero").groupBy(name, "run").agg(F.min(step).alias("first_step"), F.max(step).alias("last_step"), F.count("*").alias("length")).where(F.col("length") >= least).drop("run")


def halts(fresh: DataFrame, window: int, most: int) -> DataFrame:
    """Fresh spikes with ``recent``, their number in the inclusive last ``window`` steps, and whether that halts the run."""
    n = F.count("*").over(W.partitionBy("run_id").orderBy("step").rangeBetween(-window, 0))
    return fresh.withColumn("recent", n).withColumn("halted", F.col("recent") >= most)


@dataclass
class Spikes:
    """Spike detection step by step: what skips a step, and when skips halt the run."""

    threshold: float
    start_step: int
    skip_steps: int
    window: int
    most: int
    recent: list[int] = field(default_factory=list)
    cooldown: int = 0
    skipped: int = 0
    halted: bool = False

    def see(self, step: int, loss: float, norm: float) -> tuple[bool, bool, bool]:
        """(skipped, fresh, halted) for the next step."""
        finite = pd.notna(loss) and pd.notna(norm) and abs(loss) != float("inf") and abs(norm) != float("inf")
        skip = not finite or self.cooldown > 0 or (step >= self.start_step and norm > self.threshold)
        fresh = skip and self.cooldown == 0
        if skip:
            self.skipped += 1
        if skip and not fresh:
            self.cooldown -= 1
        if fresh:
            self.recent = [s for s in self.recent if s >= step - self.window] + [step]
            self.cooldown = max(self.skip_steps, 1) - 1
            self.halted = self.halted or len(self.recent) >= self.most
        return skip, fresh, self.halted


def bad_step(threshold: float, start_step: int) -> Column:
    """Whether a step is skipped for its own sake: loss or norm not finite, or from ``start_step`` on a norm above ``threshold``."""
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return odd("loss") | odd("norm") | ((F.col("step") >= start_step) & (F.col("norm") > threshold))


@dataclass
class Walk:
    """``Spikes`` over whole stretches of steps: rows still to be skipped, the latest fresh spikes' steps (as many as a halt looks back at), and whether the run is halted."""

    cooldown: int = 0
    recent: list[int] = field(default_factory=list)
    halted: bool = False

    def fresh(self, bad: np.ndarray, skip_steps: int) -> list[int]:
        """Places of fresh spikes: from each to the next bad row behind its cooldown; the cooldown is carried on."""
        at, length, free, out = np.flatnonzero(bad).tolist(), max(skip_steps, 1), self.cooldown, []
        i = bisect_left(at, free)
        while i < len(at):
            out.append(at[i])
            free = at[i] + length
            i = bisect_left(at, free, i + 1, min(len(at), i + length))
        self.cooldown = max(0, free - len(bad))
        return out

    def see(self, step: np.ndarray, bad: np.ndarray, skip_steps: int, window: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(skipped, fresh, halted) of the next rows, in step order."""
        n, length, most = len(bad), max(skip_steps, 1), max(most, 1)
        skip, fresh, halt = np.zeros(n + 1, np.int32), np.zeros(n, bool), np.full(n, self.halted)
        skip[0] += 1
        skip[min(self.cooldown, n)] -= 1
        at = np.array(self.fresh(bad, skip_steps), np.int64)
        fresh[at] = True
        skip[at] += 1
        np.subtract.at(skip, np.minimum(at + length, n), 1)
        first = halting(self.recent, step[at], window, most)
        if first is not None and not self.halted:
            halt[at[first] :] = self.halted = True
        self.recent = ([*self.recent, *step[at[-most:]].tolist()])[-(most - 1) :] if most > 1 else []
        return np.cumsum(skip[:n]) > 0, fresh, halt


def halting(before: Sequence[int], steps: np.ndarray, window: int, most: int) -> int | None:
    """The first of the fresh spikes at ``steps`` that is the ``most``-th within ``window`` steps, those ``before`` counted; none halts: nothing."""
    if most == 1:
        return 0 if len(steps) else None
    all_ = np.concatenate((np.array(before, np.int64), steps.astype(np.int64)))
    if len(all_) < most:
        return None
    at = np.flatnonzero(all_[most - 1 :] - all_[: len(all_) - most + 1] <= window) + most - 1 - len(before)
    at = at[at >= 0]
    return int(at[0]) if at.size else None


def _segments(runs_: pa.Array) -> list[tuple[int, int]]:
    """The places between which a sorted column keeps its value."""
    code = runs_.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    edge = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
    return list(zip(edge[:-1], edge[1:])) if len(code) else []


def spike_events(series: DataFrame, threshold: float, start_step: int, skip_steps: int, window: int, most: int, rows: int = 1 << 18) -> DataFrame:
    """(run_id, step, skipped, fresh, halted) of every step, in parts of about ``rows`` rows, however long a run is.

    Parts are ranges of (run, step). What a part hands on to the next depends on what it is handed alone by
    the rows still to be skipped, so it is worked out for each number of those (``skip_steps``), and by the few
    spikes at its ends. The driver goes along the parts, a row each; then each part is walked from where it begins.
    """
    most, ways = max(most, 1), max(skip_steps, 1)
    slim = series.select("run_id", F.col("step").cast("bigint").alias("step"), bad_step(threshold, start_step).alias("bad"))
    ranged = slim.repartitionByRange(max(1, -(-slim.count() // rows)), "run_id", "step").sortWithinPartitions("run_id", "step")
    parts = cut(ranged.withColumn("part", F.spark_partition_id()))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, first, held, part = None, True, [], None
        for b in batches:
            for lo, hi in _segments(b.column("run_id")):
                now = b.column("run_id")[lo]
                if held and now != run and (now.is_valid or run.is_valid):
                    first, held = False, []
                run, part = now, b.column("part")[lo].as_py()
                held.append((b.column("step").to_numpy()[lo:hi], b.column("bad").to_numpy(zero_copy_only=False)[lo:hi]))
        if not held:
            return
        step, bad = (np.concatenate(x) for x in zip(*held, strict=True))
        told = []
        for c in range(ways if first else 1):
            w = Walk(c)
            at = step[np.array(w.fresh(bad, skip_steps), np.int64)]
            told.append({"cooldown": w.cooldown, "head": at[: most - 1].tolist(), "tail": at[len(at) - min(len(at), most - 1) :].tolist(), "halted": halting([], at, window, most) is not None})
        kind = pa.list_(pa.struct([("cooldown", pa.int32()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64())), ("halted", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([run.as_py()], b.schema.field("run_id").type), pa.array([first]), pa.array([told], kind)], ["part", "run_id", "first", "ways"])

    kind = series.schema["run_id"].dataType.simpleString()
    told = parts.mapInArrow(ends, f"part int, run_id {kind}, first boolean, ways array<struct<cooldown: int, head: array<bigint>, tail: array<bigint>, halted: boolean>>")
    begin, run, at = {}, None, None
    for r in sorted(told.collect(), key=lambda r: r["part"]):  # a row a part
        goes_on = at is not None
        begin[r["part"]] = (run, at) if goes_on else None
        now = at if goes_on and r["first"] and r["run_id"] == run else Walk()
        way = r["ways"][now.cooldown]
        halted = now.halted or way["halted"] or halting(now.recent, np.array(way["head"], np.int64), window, most) is not None
        recent = [*now.recent, *way["tail"]][-(most - 1) :] if most > 1 else []
        run, at = r["run_id"], Walk(way["cooldown"], recent, halted)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, w, fresh_part = None, None, True
        for b in batches:
            for lo, hi in _segments(b.column("run_id")):
                now = b.column("run_id")[lo].as_py()
                if fresh_part:
                    before = begin.get(b.column("part")[lo].as_py())
                    w = Walk(before[1].cooldown, list(before[1].recent), before[1].halted) if before is not None and before[0] == now else Walk()
                    fresh_part = False
                elif now != run:
                    w = Walk()
                run = now
                some = b.slice(lo, hi - lo)
                got = w.see(some.column("step").to_numpy(), some.column("bad").to_numpy(zero_copy_only=False), skip_steps, window, most)
                yield pa.RecordBatch.from_arrays([some.column("run_id"), some.column("step"), *map(pa.array, got)], ["run_id", "step", "skipped", "fresh", "halted"])

    return parts.mapInArrow(walk, f"run_id {kind}, step bigint, skipped boolean, fresh boolean, halted boolean")


def last_known(df: DataFrame, value: str, order: str, group: list[str]) -> Column:
    """The latest value that is not null, up to this row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
