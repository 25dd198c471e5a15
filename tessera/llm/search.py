"""Exact top-k inner products by distributed histogram selection.

All queries are scored against all candidates, in blocks, several times over; what leaves
a task is small each time. A round counts, per query, the scores in equal bins of the
interval that is known to hold the k-th highest, sums the counts over all tasks, and goes
on with the bin in which the k-th lies, until a bin is one integer wide: then the k-th
value is known exactly, and one more pass keeps what is above it and, of what equals it,
the smallest ids. A task's counts end at the bin of its own k-th highest score, below
which the global one cannot lie, so it sends at most k bins a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.llm._store import cut

BIN_BITS = 8
LONG = 1 << 63


def usable(vector: Column) -> Column:
    """Whether a vector is there, and all its components are, and finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """floor(256 x) of each component as whole doubles; shorter vectors end in zeros."""
    flat = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    length = np.asarray(column.value_lengths())
    if (length == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(length), dims))
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def scores(queries: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Inner products as integers, within a long.

    Doubles hold every partial sum of a pair unless its vectors are very large; such pairs
    alone are summed in Python's integers.
    """
    dims = queries.shape[1]
    q, c = (np.abs(x).max(axis=1, initial=0) for x in (queries, some))
    far = np.flatnonzero(dims * c * q.max(initial=0) >= 1 << 53)
    with np.errstate(all="ignore"):
        out = (queries @ some.T).astype(np.int64)
    if far.size:
        row, col = np.nonzero(dims * q[:, None] * c[far] >= 1 << 53)
        whole = lambda x: [[int(v) for v in r] for r in x]
        left, right = dict(zip(u := np.unique(row), whole(queries[u]))), dict(zip(u := np.unique(far[col]), whole(some[u])))
        for i, j in zip(row, far[col]):
            out[i, j] = min(max(sum(a * b for a, b in zip(left[i], right[j])), -LONG), LONG - 1)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = 4096, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best candidates, ties to smaller ids.

    Queries are the distinct ids among the usable rows that ``is_query`` holds for (of rows
    that share an id, the vector that sorts first); candidates are all usable rows with
    another id. Rows without an id or with an unusable vector take no part; of vectors of
    unequal lengths the shorter count as ending in zeros; scores outside a long stop at its
    ends. Repeated rows are candidates as often as they come. Queries go in blocks of about
    ``block``, which alone are sent to the executors. No query or no candidate: no rows.
    """
    spark = vectors.sparkSession
    usables = vectors.where(usable(F.col(vector)) & F.col(id_col).isNotNull())
    slim = usables.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"))
    told = slim.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    asked = usables.where(is_query).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(vector).alias("v"))
    n = asked.count()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not n:
        return spark.createDataFrame([], schema)
    dims, most = max(1, told[0]), int(256 * (told[1] or 0)) + 1
    bound = min(dims * most * most, LONG - 1)
    blocks = -(-n // block)
    parts = []
    for part in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == part).toArrow().combine_chunks()
        if not got.num_rows:
            continue
        ids = got.column("id").to_numpy().astype(np.int64)
        sent = spark.sparkContext.broadcast((ids, _matrix(got.column("v").combine_chunks(), dims)))
        parts.append(cut(_block(slim, sent, ids, dims, bound, k)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _scored(batches: Iterator[pa.RecordBatch], sent, dims: int, step: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, scores by query, whether it counts) of the candidates, ``step`` at a time."""
    ids, queries = sent.value
    for b in batches:
        for at in range(0, b.num_rows, step):
            some = b.slice(at, step)
            own = some.column("id").to_numpy()
            yield own, scores(queries, _matrix(some.column("v"), dims)), ids[:, None] != own[None, :]


def _block(slim: DataFrame, sent, ids: np.ndarray, dims: int, bound: int, k: int) -> DataFrame:
    low = [-bound] * len(ids)
    need = np.full(len(ids), k)
    left = (2 * bound + 1).bit_length()
    short = np.zeros(len(ids), bool)  # fewer than k candidates: all are taken
    while left > 0:
        shift = max(0, left - BIN_BITS)
        bins = 1 << (left - shift)
        state = slim.sparkSession.sparkContext.broadcast((np.array(low, np.int64), need.copy()))

        def counts(batches: Iterator[pa.RecordBatch], state=state, shift=shift, bins=bins) -> Iterator[pa.RecordBatch]:
            low, need = state.value
            total = np.zeros((len(low), bins), np.int64)
            for _, s, ok in _scored(batches, sent, dims):
                ok &= s >= low[:, None]
                place = (s.view(np.uint64) - low[:, None].view(np.uint64)) >> np.uint64(shift)
                ok &= place < bins
                q, c = np.nonzero(ok)
                total += np.bincount(q * bins + place[q, c].astype(np.int64), minlength=total.size).reshape(total.shape)
            above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
            q, b = np.nonzero((total > 0) & (above < need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(total[q, b])], ["q", "bin", "n"])

        sums = slim.mapInArrow(counts, "q bigint, bin bigint, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        run = sums.withColumn("upto", F.sum("n").over(W.partitionBy("q").orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)))
        wanted = slim.sparkSession.createDataFrame(list(enumerate(need.tolist())), "q bigint, need bigint")
        found = run.join(wanted, "q").where("upto >= need").groupBy("q").agg(F.max(F.struct("bin", (F.col("upto") - F.col("n")).alias("above"))).alias("b"))
        here = np.zeros(len(ids), bool)
        for q, (b, above) in found.collect():  # a row for each query of the block
            low[q] += b << shift
            need[q] -= above
            here[q] = True
        short |= ~here
        for q in np.flatnonzero(short):
            low[q], need[q] = -bound, k
        left = shift

    last = slim.sparkSession.sparkContext.broadcast((np.array(low, np.int64), need, short))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, need, short = last.value
        ids, _ = sent.value
        ties = [np.zeros(0, np.int64)] * len(ids)
        out = []
        for own, s, ok in _scored(batches, sent, dims):
            q, c = np.nonzero(ok & ((s > low[:, None]) | short[:, None]))
            out.append((q, own[c], s[q, c]))
            q, c = np.nonzero(ok & (s == low[:, None]) & ~short[:, None])
            cuts = np.searchsorted(q, np.arange(len(ids) + 1))
            for i in np.unique(q):
                ties[i] = np.sort(np.concatenate((ties[i], own[c[cuts[i] : cuts[i + 1]]])))[: need[i]]
        q = np.repeat(np.arange(len(ids)), list(map(len, ties)))
        out.append((q, np.concatenate(ties), low[q]))
        q, c, s = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(c), pa.array(s)], ["query_id", "vec_id", "score"])

    rows = slim.mapInArrow(kept, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the five best of every fiftieth vector."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
