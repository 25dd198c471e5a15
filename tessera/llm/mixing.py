"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 40-bit hash of its id and text; equal rows are numbered, and the
number is hashed too. A source that is to give ``target`` words takes
each of its documents a whole number of times, and once more those whose hash lies under
the source's threshold. The thresholds are found without sorting: sizes are summed by
source and hash bucket (partial sums first, so a source with a third of all rows is no
hot key), the running sum over the 1,024 buckets names the bucket in which the budget
ends, and only that bucket is refined by the next ten bits, until the hash is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.llm._native import n_words
from tessera.llm._store import cut, documents, named

BITS, LEVELS = 10, 4
#: A per-source table is sent to all executors up to this many rows (some tens of bytes each).
BROADCAST_ROWS = 100_000


def _known(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def targets(totals: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size, target double) from (source, source_size).

    Sources in code point order, null last, weigh 1, 2, 3, repeating. Their targets share
    the sum of all sizes by weight; one that would pass ``most`` times its source's size
    stops there, and its excess goes to the others by weight, until none is above. That is
    the water level over the ratio of cap to weight, found with running sums.
    """
    by_name, all_rows = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy()
    weighed = totals.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (
        weighed.withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("among", F.sum("weight").over(after))
        .withColumn("rank", F.row_number().over(order))
        .withColumn("free", F.col("left") * F.col("weight") <= F.col("cap") * F.col("among"))
        .withColumn("head", F.min(F.when(F.col("free"), F.struct("rank", "left", "among"))).over(all_rows))
    )
    share = F.col("head.left").cast("double") * F.col("weight") / F.col("head.among")
    return level.select("source", "source_size", F.when(F.col("rank") >= F.col("head.rank"), share).otherwise(F.col("cap").cast("double")).alias("target"))


def _prefix(level: int) -> Column:
    """The first ``level`` digits of the hash."""
    return F.shiftrightunsigned("hash", BITS * (LEVELS - level))


def thresholds(sized: DataFrame, budgets: DataFrame, n_sources: int) -> DataFrame:
    """(source, edge, low, budget): hashes under ``edge`` sum to ``low`` words, and the hash ``edge`` itself crosses the budget.

    ``sized``: (source, size, hash); ``budgets``: (source, budget double). A source whose
    sum stays within its budget has no row.
    """
    found = budgets.select("source", F.lit(0).cast("bigint").alias("edge"), F.lit(0).cast("bigint").alias("low"), "budget")
    for level in range(1, LEVELS + 1):
        inside = sized.alias("d").join(_known(found.select("source", "edge", "low", "budget"), n_sources).alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")) & (_prefix(level - 1) == F.col("edge")))
        sums = inside.select("d.source", "size", "low", "budget", _prefix(level).alias("bucket"), "hash").groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.first("low").alias("low"), F.first("budget").alias("budget"), F.count("*").alias("n"), F.min("hash").alias("hash"))
        run = sums.withColumn("upto", F.col("low") + F.sum("size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))
        crossing = F.min(F.when(F.col("upto") > F.col("budget"), F.struct(F.col("bucket").alias("edge"), (F.col("upto") - F.col("size")).alias("low"), "budget", "n", "hash")))
        found = cut(run.groupBy("source").agg(crossing.alias("c")).where("c is not null").select("source", "c.*"))
        if (found.agg(F.max("n")).first()[0] or 1) == 1:  # a document a bucket: its hash is the threshold
            found = found.withColumn("edge", F.col("hash"))
            break
    return found.select("source", "edge", "low", "budget")


def _hash(id_col: str, text: str, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text), F.lit(seed)), 64 - BITS * LEVELS)


def twins(sized: DataFrame) -> DataFrame:
    """(hash, part, before): where rows share a hash, how many of them lie in the partitions before ``part``."""
    per = sized.groupBy("hash", "part").agg(F.count("*").alias("rows"))
    many = per.groupBy("hash").agg(F.sum("rows").alias("all")).where("all > 1").select("hash")
    before = F.sum("rows").over(W.partitionBy("hash").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return cut(per.join(many, "hash").select("hash", "part", F.coalesce(before, F.lit(0)).alias("before")))


def told_apart(rows: DataFrame, found: DataFrame, hash: str = "hash", part: str = "part") -> DataFrame:
    """``rows`` with a hash of their own for those that share one, by their number among them.

    They are numbered within their partitions, so that a third of all rows may be equal; which
    of equal rows has which number is all the same.
    """
    n = found.count()
    if not n:
        return rows
    on = found.select(F.col("hash").alias("_twin_hash"), F.col("part").alias("_twin_part"), F.col("before").alias("_twin_before"))
    joined = rows.join(_known(on, n), (F.col(hash) == F.col("_twin_hash")) & (F.col(part) == F.col("_twin_part")), "left")
    number = F.col("_twin_before") + F.row_number().over(W.partitionBy(hash, part).orderBy(F.lit(0)))
    own = F.shiftrightunsigned(F.xxhash64(hash, number), 64 - BITS * LEVELS)
    more = joined.where("_twin_before is not null").withColumn(hash, own)
    return joined.where("_twin_before is null").unionByName(more).select(*rows.columns)


def plan_mix(sized: DataFrame, most: int = 3) -> tuple[DataFrame, int]:
    """The mix of ``sized`` (source, size, hash) as a row per source, and how many there are.

    (source, source_size, target, times, rounds, one): a document is taken ``times`` times,
    and once more if ``once_more`` says so. A document that does not fit into what is left
    of its source's budget is passed over: each further round finds a threshold among the
    hashes behind the last one, for documents that fit, until none does. What is left is less
    than the document that crossed, so each round looks through the documents of the round before
    that are short enough alone, and these are soon few. ``one`` is the hash of a last
    document that brings its source nearer to the target.
    """
    totals = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    n = totals.count()
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    taken = F.array().cast("array<struct<after:bigint,edge:bigint,fits:double>>")
    plan = cut(targets(totals, most).withColumn("times", times).select("*", (F.col("target") - F.col("times") * F.col("source_size")).alias("budget"), F.lit(-1).cast("bigint").alias("after"), taken.alias("rounds")))
    same = F.col("d.source").eqNullSafe(F.col("p.source"))
    fit = sized
    while True:
        fit = cut(fit.alias("d").join(_known(plan.select("source", "budget", "after"), n).alias("p"), same & (F.col("hash") > F.col("after")) & F.col("size").between(1, F.col("budget"))).select("d.source", "size", "hash"))
        if fit.isEmpty():
            break
        edge = thresholds(fit, plan.select("source", "budget"), n).select(F.col("source").alias("of"), "edge", "low")
        end = F.coalesce("edge", F.lit(1 << BITS * LEVELS))
        step = F.struct("after", end.alias("edge"), F.col("budget").alias("fits"))
        plan = cut(plan.join(edge, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", "target", "times", (F.col("budget") - F.coalesce("low", F.lit(0))).alias("budget"), end.alias("after"), F.concat("rounds", F.array(step)).alias("rounds")))
    off = F.abs(F.col("size") - F.col("budget"))
    spare = sized.where("size > 0").alias("d").join(_known(plan, n).alias("p"), same).where(~_under() & (F.col("times") < most) & (off < F.col("budget")))
    best = spare.groupBy("d.source").agg(F.min(F.struct(off.alias("off"), "hash", "size")).alias("best"))
    return cut(plan.join(best.select(F.col("source").alias("of"), F.col("best.hash").alias("one")), F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "budget", "after")), n


def _under(hash: str = "hash", size: str = "size", rounds: str = "rounds") -> Column:
    """Whether a document lies under one of its source's thresholds."""
    return F.exists(rounds, lambda r: (F.col(hash) > r["after"]) & (F.col(hash) < r["edge"]) & (F.col(size) <= r["fits"]))


def copies(hash: str = "hash", size: str = "size", plan: str = "p") -> Column:
    """How often the mix takes a document."""
    more = _under(hash, size, f"{plan}.rounds") | F.coalesce(F.col(hash) == F.col(f"{plan}.one"), F.lit(False))
    return F.col(f"{plan}.times") + more.cast("bigint")


def mix(docs: DataFrame, most: int = 3, text: str = "text", source: str = "source", id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """(id_col, size, source_size, target, taken, copies) of every row of ``docs``.

    ``size`` counts words; null, empty and blank texts have 0 and are taken 0 times their
    size. Null is a source of its own. A null id hashes like any value; of rows equal in id
    and text, as many are taken as their hashes say. Other columns are not read. An empty
    table gives no rows.
    """
    sized = _sized(docs, text, source, id_col, seed)
    sized = cut(told_apart(sized, twins(sized)))
    plan, n = plan_mix(sized.select("source", "size", "hash"), most)
    joined = sized.alias("d").join(_known(plan, n).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("id", "size", "source_size", "target", copies().alias("copies"))
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _sized(docs: DataFrame, text: str, source: str, id_col: str, seed: int) -> DataFrame:
    return cut(docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), _hash(id_col, text, seed).alias("hash"), F.spark_partition_id().alias("part")))


def mixed(docs: DataFrame, most: int = 3, text: str = "text", source: str = "source", id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its columns as they are.

    ``docs`` is read twice and should come in the same partitions (a table in files does).
    """
    sized = _sized(docs, text, source, id_col, seed)
    same = twins(sized)
    plan, n = plan_mix(cut(told_apart(sized, same)).select("source", "size", "hash"), most)
    own = [named(c).alias(f"_mix_{i}") for i, c in enumerate(docs.columns)]
    marked = docs.select(*own, n_words(F.col(text)).alias("_size"), _hash(id_col, text, seed).alias("_hash"), F.col(source).cast("string").alias("_source"), F.spark_partition_id().alias("_part"))
    joined = told_apart(marked, same, "_hash", "_part").join(_known(plan, n).alias("p"), F.col("_source").eqNullSafe(F.col("p.source")))
    times = copies("_hash", "_size")
    taken = joined.where((times > 0) & (F.col("_size") > 0)).select(*[f"_mix_{i}" for i in range(len(own))], F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("_copy"))
    return taken.select(*[F.col(f"_mix_{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document's share in the mix."""
    return mix(documents(spark, sf_dir))
