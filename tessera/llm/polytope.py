"""Embedding near-duplicates by cross-polytope hashing.

A vector is turned by random signs and fast Hadamard transforms, three times each; its hash
is the nearest corner of the cross-polytope, that is its largest coordinate and that one's
sign. A table joins two such hashes into a bucket, and a vector lies in its ``probes`` best
buckets of each of ``tables`` tables: where the largest coordinates are close to the next,
the next ones are tried. Vectors that share a bucket and a label are candidates; their cosine is
computed in double precision, so every link is true. A pair that is at the limit of 0.98 misses one
table with a chance of about 0.05, so all four of them with about 5e-6; nearer pairs less.

Equal vectors are folded before anything else. Buckets with one vector are left out by
their counts; those with many are cut into blocks of members, whose pairs of blocks are
tasks of their own, so every bucket is compared as a whole whatever its size. A pair is
counted in the least bucket that both share, and tasks give back sums and a spanning forest.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm._store import cut
from tessera.llm.search import usable
from tessera.llm.simhash import components

TURNS = 3
#: Groups up to so many members are compared together with others, as lists of pairs.
FEW = 48


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row, scaled to keep lengths."""
    rows, dims = x.shape
    h = 1
    while h < dims:
        y = x.reshape(rows, dims // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(rows, dims)
        h *= 2
    return x / np.sqrt(dims)


def buckets(unit: np.ndarray, tables: int = 4, factors: int = 2, probes: int = 3, seed: int = 13) -> np.ndarray:
    """The buckets of unit vectors, ``tables * probes`` a row; a table's come one behind the other, the nearest first.

    Only sums, differences and signs of doubles are used, so that a vector has the same
    buckets wherever and beside whichever others it is hashed.
    """
    rows, width = unit.shape
    dims = 1 << max(1, (width - 1).bit_length())
    x = np.zeros((rows, dims))
    x[:, :width] = unit
    top = min(3, dims)
    tried = [t for t in itertools.product(range(top), repeat=factors) if sum(t) <= 3]
    probes = min(probes, len(tried))
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, tables, probes), np.int64)
    for table in range(tables):
        corner, loss = [], []
        for _ in range(factors):
            turned = x
            for _ in range(TURNS):
                turned = hadamard(turned * rng.choice([-1.0, 1.0], dims))
            size = np.abs(turned)
            best = np.argsort(-size, axis=1, kind="stable")[:, :top]
            length = np.take_along_axis(size, best, 1)
            corner.append(2 * best + (np.take_along_axis(turned, best, 1) < 0))
            loss.append((length[:, :1] - length) ** 2)
        total = np.stack([sum(loss[f][:, k] for f, k in enumerate(t)) for t in tried], axis=1)
        key = np.full((rows, len(tried)), table, np.int64)
        for f in range(factors):
            key = key * (2 * dims) + np.stack([corner[f][:, t[f]] for t in tried], axis=1)
        out[:, table] = np.take_along_axis(key, np.argsort(total, axis=1, kind="stable")[:, :probes], 1)
    return out.reshape(rows, -1)


def units(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors at length one, in doubles; shorter ones end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.asarray(column.value_lengths()).astype(np.int64)
    out = np.zeros((len(length), dims))
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    out /= np.abs(out).max(axis=1, initial=0, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def earlier(left: np.ndarray, right: np.ndarray, key: np.ndarray, probes: int) -> np.ndarray:
    """Whether two rows of buckets share one below ``key``; the arrays broadcast but for their last axis."""
    met = np.zeros(np.broadcast_shapes(left.shape[:-1], right.shape[:-1]), bool)
    for a in range(left.shape[-1]):
        mine = left[..., a]
        for b in range(a // probes * probes, a // probes * probes + probes):
            met |= (mine == right[..., b]) & (mine < key)
    return met


def _sunk(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each member's least fellow along the links (a, b)."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def compared(group: np.ndarray, own: np.ndarray, crossed: np.ndarray, key: np.ndarray, unit: np.ndarray, weight: np.ndarray, least: float, shape: dict) -> tuple[np.ndarray, np.ndarray]:
    """(weight of its links, least fellow) of each row. Rows of a ``group`` are neighbours; where ``crossed`` only rows of unequal ``own`` are compared."""
    n = len(group)
    sums, label = np.zeros(n, np.int64), np.arange(n)
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((begin, [n])))
    probes = shape["probes"]
    mine = lambda rows: buckets(unit[rows], **shape)
    lists = []
    for m in np.unique(size[(size > 1) & (size <= FEW)]):
        i, j = np.triu_indices(m, 1)
        at = begin[size == m]
        step = max(1, (1 << 17) // len(i))
        for k in range(0, len(at), step):
            a, b = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
            near = (~crossed[a] | (own[a] != own[b])) & (np.einsum("ij,ij->i", unit[a], unit[b]) >= least)
            lists.append((a[near], b[near]))
    if lists:
        a, b = (np.concatenate(x) for x in zip(*lists))
        rows, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        if len(rows):
            ks = mine(rows)
            first = ~earlier(ks[place[: len(a)]], ks[place[len(a) :]], key[a], probes)
            a, b = a[first], b[first]
            np.add.at(sums, a, weight[b])
            np.add.at(sums, b, weight[a])
            label = np.minimum(label, _sunk(n, a, b))
    for at, m in zip(begin[size > FEW], size[size > FEW]):
        part = slice(at, at + m)
        near = unit[part] @ unit[part].T >= least
        np.fill_diagonal(near, False)
        if crossed[at]:
            near &= own[part, None] != own[None, part]
        if not near.any():
            continue
        ks = mine(part)
        for k in range(0, m, 256):
            near[k : k + 256] &= ~earlier(ks[k : k + 256, None], ks[None], key[at], probes)
        sums[part] = near @ weight[part].astype(np.float64)
        now = np.arange(m)
        while True:
            low = np.minimum(now, np.where(near, now, m).min(axis=1))
            low = np.minimum(low, low[low])
            if (low == now).all():
                break
            now = low
        label[part] = at + now
    return sums, label


def _grouped(batches: Iterator[pa.RecordBatch], most: int = 8192) -> Iterator[pa.Table]:
    """Whole groups of (label, key, lo, hi), many at a time; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) < most:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        ids = np.stack([t.column(c).to_numpy() for c in ("group", "key", "lo", "hi")], axis=1)
        change = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        if change.size:
            yield t.slice(0, change[-1])
            held = t.slice(change[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def near_duplicates(vectors: DataFrame, least: float = 0.98, tables: int = 4, factors: int = 2, probes: int = 3, block: int = 1024, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row of ``vectors``.

    Rows link when their labels are equal and not null and the cosine of their vectors is
    ``least`` or more. Null vectors, those with null or non-finite components and those
    without a component but zeros link with nothing; of vectors of unequal lengths the
    shorter count as ending in zeros. Repeated rows are rows of their own: each links with
    the others. ``component_id`` is the smallest id reachable; null ids do not count there
    (null if a component has no other), and such a row is not ``kept``. An empty table gives
    no rows; further columns are not looked at. ``factors`` corners make a bucket: three
    for far larger tables, at more ``tables`` for the same recall.
    """
    spark = vectors.sparkSession
    name = lambda c: F.col(f"`{c}`")
    v = name(vector)
    links = F.coalesce(usable(v) & F.exists(v, lambda x: x != 0) & name(label).isNotNull(), F.lit(False))
    rows = vectors.select(name(id_col).alias("id"), name(label).alias("label"), v.alias("v"), links.alias("links"))
    keyed = rows.where("links").select("id", F.xxhash64("label").alias("group"), F.col("label").cast("string").alias("label"), "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    alone = rows.where("not links").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    same = ["group", "label", "h1", "h2"]
    folded = keyed.groupBy(same).agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("least"))
    folded = cut(folded.withColumn("node", F.monotonically_increasing_id()))
    dims = folded.agg(F.max(F.size("v"))).first()[0] or 1
    shape = {"tables": tables, "factors": factors, "probes": probes}
    shape["probes"] = buckets(np.ones((1, dims)), **shape).shape[1] // tables

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                some = b.slice(at, 4096)
                keys = buckets(units(some.column("v"), dims), **shape)
                wide = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.ravel())
                yield pa.RecordBatch.from_arrays([some.column("node"), some.column("group"), wide], ["node", "group", "keys"])

    lying = cut(folded.select("node", "group", "v").mapInArrow(hashed, "node bigint, group bigint, keys array<bigint>")).select("node", "group", F.explode("keys").alias("key"))
    shared = lying.groupBy("group", "key").agg(F.count("*").alias("members")).where("members > 1")
    placed = lying.join(shared, ["group", "key"]).select("node", "key", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("node", "key", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).join(folded.select("node", "group", "n", "v"), "node")
    group = ["group", "key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            col = {c: t.column(c).to_numpy() for c in ("node", "own", "n", *group)}
            ids = np.stack([col[c] for c in group], axis=1)
            step = np.concatenate(([0], np.cumsum((ids[1:] != ids[:-1]).any(axis=1))))
            unit = units(t.column("v").combine_chunks(), dims)
            sums, low = compared(step, col["own"], col["lo"] != col["hi"], col["key"], unit, col["n"], least, shape)
            hit = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(col["node"][hit]), pa.array(col["node"][low[hit]]), pa.array(sums[hit])], ["node", "other", "n"])

    found = cut(met.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "node bigint, other bigint, n bigint"))
    root = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    count = found.groupBy("node").agg(F.sum("n").alias("more"))
    told = folded.drop("v").join(count, "node", "left").join(root, "node", "left").select(*same, "least", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    smallest = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = told.join(smallest, "root").select(*same, "n_links", "component_id")
    out = keyed.drop("v").join(told, same).select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: links, component and verdict of every vector."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), good AS (
  SELECT *, sqrt(list_inner_product(e, e)) AS size FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r
  WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (
  SELECT a, min(vec_id) AS low FROM reach JOIN v ON v.r = reach.b GROUP BY a
), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.r LEFT JOIN least ON least.a = v.r
"""
