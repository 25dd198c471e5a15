"""Operators whose result depends on a total order: prefix sums, limits, quotas, interleaving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def prefix_sum(df: DataFrame, bucket: Sequence[str], order: Sequence[str], value: str, into: str, group: Sequence[str] = ()) -> DataFrame:
    """``df`` with the exclusive running sum of ``value`` in the order of (bucket, order), in each ``group`` anew.

    A window without partitions would gather all rows in one task. Here each bucket (a
    coarse leading part of the order) sums up first; only the buckets, one small row each,
    are summed in order, and the rows of a bucket run on from its base.
    """
    keys = [*group, *bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_s"))
    base = sums.select(*keys, F.coalesce(F.sum("_s").over(W.partitionBy(*group).orderBy(*bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.join(base, keys).withColumn(into, (F.col("_base") + own).cast("bigint")).drop("_base")


def previous(df: DataFrame, bucket: Sequence[str], order: Sequence[str], value: str, into: str) -> DataFrame:
    """``df`` with ``value`` of the row before in the order of (bucket, order), null at the first; in two passes like ``prefix_sum``.

    Each bucket's last value, a row a bucket, is handed on to the next bucket's first row.
    """
    last = df.groupBy(*bucket).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    before = last.select(*bucket, F.lag("_last").over(W.orderBy(*bucket)).alias("_last"))
    w = W.partitionBy(*bucket).orderBy(*order)
    own = F.when(F.row_number().over(w) == 1, F.col("_last.v")).otherwise(F.lag(value).over(w))
    return df.join(before, list(bucket)).withColumn(into, own).drop("_last")


def ordered_limit(df: DataFrame, keep: Column, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows that ``keep`` holds for; none for n <= 0. Top-n per task, then one merge."""
    return df.where(keep).orderBy(*order).limit(max(n, 0))


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: Column | int = 1) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def split_by_weight(parts: DataFrame, total: int, order: str = "ordinal", weight: str = "weight") -> DataFrame:
    """``parts`` with ``share``: whole shares of ``total``, what rounding leaves going to the last."""
    floor = F.floor(F.lit(total) * F.col(weight)).cast("bigint")
    last = F.row_number().over(W.orderBy(F.col(order).desc())) == 1
    before = F.coalesce(F.sum(floor).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("share", F.when(last, F.lit(total) - before).otherwise(floor).cast("bigint"))


def worker_quota(total: Column | int, workers: int, worker: Column) -> Column:
    """An equal share, and the remainder for the last worker."""
    whole = F.lit(total).cast("bigint")
    share = F.call_function("div", whole, F.lit(workers).cast("bigint"))
    return F.when(worker == workers - 1, whole - share * (workers - 1)).otherwise(share).cast("bigint")


def round_robin(queues: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(directory, file) in rounds, each directory giving its next file.

    The order of a round is the last one's, less the exhausted, rotated by the round's
    number; the rotations add up. It is a list of files, which the driver holds anyway.
    """
    left = {d: list(reversed(f)) for d, f in queues.items() if f}
    order, out, turn = list(left), [], 0
    while order:
        k = turn % len(order)
        order = order[k:] + order[:k]
        out += [(d, left[d].pop()) for d in order]
        order = [d for d in order if left[d]]
        turn += 1
    return out


def interleave(rows: DataFrame, queues: dict[str, list[str]], directory: str = "dir", file: str = "file", line: str = "line") -> DataFrame:
    """The rows of files in round-robin order of their files, as a column ``work_idx`` with the line."""
    work = rows.sparkSession.createDataFrame([(i, d, f) for i, (d, f) in enumerate(round_robin(queues))], f"work_idx bigint, {directory} string, {file} string")
    return rows.join(work, [directory, file]).select("work_idx", line, *[c for c in rows.columns if c != line])


def greedy_shards(df: DataFrame, target: int, group: str, order: str, size: str) -> DataFrame:
    """(group, order, shard_id): a shard closes with the row that brings it to ``target``, and the next begins at nothing.

    The one inherently sequential step: it runs over (order, size) alone, a task per group,
    and goes from shard to shard by a search in the running sum of sizes (none is negative).
    """
    import numpy as np
    import pandas as pd

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        upto = rows[size].to_numpy(np.int64).cumsum()
        shard, at, ends = np.zeros(len(rows), np.int32), 0, []
        while at < len(rows):
            base = upto[at - 1] if at else 0
            at = max(at, int(np.searchsorted(upto, base + target))) + 1
            ends.append(at)
        shard[ends[:-1]] = 1
        return pd.DataFrame({group: rows[group], order: rows[order], "shard_id": shard.cumsum(dtype=np.int32)})

    slim = df.select(group, order, size)
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    return slim.groupBy(group).applyInPandas(one, f"{group} {kinds[group]}, {order} {kinds[order]}, shard_id int")


def runs(df: DataFrame, group: Sequence[str], order: str, same: Column) -> DataFrame:
    """``df`` with ``run``: a number for each stretch of rows in which ``same`` keeps its value."""
    w = W.partitionBy(*group).orderBy(order) if group else W.orderBy(order)
    changed = (~same.eqNullSafe(F.lag(same).over(w))).cast("int")
    return df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w)).drop("_c")


def skip(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """All but the first ``n`` rows in order. Only the last of those is looked for, so nothing is numbered."""
    edge = df.orderBy(*order).limit(n).select(*order).orderBy(*[F.col(c).desc() for c in order]).limit(1)
    last = edge.first() if n > 0 else None
    if last is None:
        return df
    rows, full = F.struct(*[F.col(c) for c in order]), F.struct(*[F.lit(last[c]).alias(c) for c in order])
    return df.where(rows > full)
