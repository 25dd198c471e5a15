"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard levels. At each node every child draws a number
from the row's id and the child's name, exponentially distributed with the child's weight
as its rate, and the smallest draw wins; a child gets its weight's share of the rows.
Since a child's draw depends on nothing but the id, its own name and its own weight, a
change of weight moves rows only into (or out of) the subtrees on whose path it lies: no
row moves between two children whose weights stay.

The layout for a plain shard count has a core of 16 leaves, whatever the count, in regions
of two racks of four shards; each later shard opens a region of its own. With fewer shards
the core's weights are the same, and a key that descends to a shard that is not there yet
draws once more among those that are. So one more shard changes no weight that existed, and
takes rows only into itself, at every count: law ``key``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.llm._native import n_bytes
from tessera.llm._store import cut, documents

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def layout(shards: int, core: int | None = None, racks: int = 2, per_rack: int = 4) -> Tree:
    """The tree of ``shards`` equal shards: the first ``core`` (16, or all if fewer) in racks, then one region for each further shard."""
    if shards < 1:
        raise ValueError("one shard at least")
    core = min(shards, 16) if core is None else min(core, shards)
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        region, rack = (f"r{s // (racks * per_rack)}", f"k{s // per_rack % racks}") if s < core else (f"s{s}", "k0")
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def _draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw of rate ``weight``, from 52 bits of a hash of key and name."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / weight


def _choose(key: Column, path: str, children: Mapping[str, tuple[float, Column]]) -> Column:
    """The value of the child with the least draw; ties go to the child that is named first."""
    live = [(name, weight, value) for name, (weight, value) in children.items() if weight > 0]
    if not live:
        return F.lit(None).cast("int")
    if len(live) == 1:
        return live[0][2]
    drawn = F.array_min(F.array(*[F.struct(_draw(key, f"{path}/{name}", weight).alias("d"), F.lit(i).alias("i")) for i, (name, weight, _) in enumerate(live)]))["i"]
    out = live[-1][2]
    for i in range(len(live) - 2, -1, -1):
        out = F.when(drawn == i, live[i][2]).otherwise(out)
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard that ``key`` descends to."""
    regions = {}
    for region, racks in tree.items():
        below = {}
        for rack, shards in racks.items():
            leaves = {str(s): (float(w), F.lit(s)) for s, w in shards.items()}
            below[rack] = (sum(w for w, _ in leaves.values()), _choose(key, f"{region}/{rack}", leaves))
        regions[region] = (sum(w for w, _ in below.values()), _choose(key, region, below))
    return _choose(key, "", regions)


def placed(key: Column, shards: int, core: int = 16) -> Column:
    """The shard of ``key`` among ``shards`` equal ones, in a tree whose core has ``core`` places, taken or not."""
    first = shard_of(key, layout(max(shards, core), core))
    if shards >= core:
        return first
    return F.when(first < shards, first).otherwise(_choose(key, "again", {str(s): (1.0, F.lit(s)) for s in range(shards)}))


def assign(docs: DataFrame, shards: int = 16, core: int = 16, rows_a_bucket: int = 50_000, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) of every row.

    The id and the shard count (and ``core``, which has to stay as it is while shards are added, see ``placed``) alone decide the shard, so rows
    with equal ids share one and equal texts need not; a null id is a key like any other.
    Null and empty texts have size 1 and the CRC of no bytes. Slots are gapless in each shard:
    rows are numbered in buckets of a shard, by hash and by partition, whose sizes are summed
    beforehand; so no task holds a whole shard, nor all of many equal rows. Which of equal
    rows has which slot is open. Other columns are not read; an empty table gives no rows.
    """
    key = F.coalesce(F.xxhash64(id_col), F.lit(0))
    size, crc = n_bytes(F.col(text)) + 1, F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    slim = docs.select(F.col(id_col).alias("id"), key.alias("key"), size.alias("size"), crc.alias("text_crc32")).withColumns({"shard": placed(F.col("key"), shards, core), "grown_shard": placed(F.col("key"), shards + 1, core)})
    slim = cut(slim)
    n_buckets = max(1, slim.count() // (shards * rows_a_bucket) + 1)
    slim = slim.withColumn("bucket", F.pmod(F.xxhash64("key", "text_crc32", F.spark_partition_id()), F.lit(n_buckets)).cast("int"))
    counts = slim.groupBy("shard", "bucket").count()
    base = cut(counts.select("shard", "bucket", F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base")))
    base = F.broadcast(base) if shards * n_buckets <= 100_000 else base
    numbered = slim.withColumn("at", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")) - 1)
    return numbered.join(base, ["shard", "bucket"]).select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("at")).cast("bigint").alias("slot"), "grown_shard")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: 16 shards, and what a 17th would take."""
    return assign(documents(spark, sf_dir))
