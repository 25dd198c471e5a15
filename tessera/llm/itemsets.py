"""Closed frequent itemsets of baskets, and their rules, over the graph of frequent pairs.

Items are vertices, frequent pairs are edges. The graph is peeled in degeneracy order: in
rounds, all vertices of least degree at once, so that each vertex has few neighbours behind
it. An itemset belongs to the first of its items in that order, and all others are later
neighbours of that one; so every vertex is a task of its own, over the baskets that hold
it, projected to its later neighbours, equal projections merged and counted before they
meet. There closed itemsets are found by closing sets of transactions, one item after the
other; one that an earlier item could be added to at the same support belongs to an
earlier task and ends there with all that extend it. For that, each merged projection
carries the earlier items that all its baskets hold.

No basket is spread into all its pairs unless it has at most ``wide`` frequent items. In
wider ones a pair is looked for only if the narrow ones leave it a chance, or if both items
are in as many wide baskets as the support asks for. Wide baskets are never gathered into
a row; neither they nor items with a third of the rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm._store import cut, written

ROW = "items array<bigint>, support bigint, rest array<struct<c:bigint,a:bigint,s:bigint>>, first bigint, own bigint, behind bigint"


def _pairs(items: Column) -> Column:
    """All (a, b) of a sorted array, a before b."""
    tail = lambda i: F.slice(items, i + 2, F.size(items))
    return F.flatten(F.transform(items, lambda a, i: F.transform(tail(i), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def frequent_pairs(entries: DataFrame, wide: DataFrame, narrow: DataFrame, support: int) -> DataFrame:
    """(a, b, n): pairs a < b in at least ``support`` baskets. ``wide`` and ``narrow`` part the distinct (basket, item) ``entries``."""
    lists = narrow.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    small = lists.select(F.inline(_pairs(F.col("items")))).groupBy("a", "b").agg(F.count("*").alias("n"))
    often = wide.groupBy("item").agg(F.count("*").alias("wide"))
    if often.isEmpty():
        return small.where(F.col("n") >= support)
    often = cut(often)
    by = lambda c: often.select(F.col("item").alias(c), F.col("wide").alias(f"wide_{c}"))
    hope = small.join(by("a"), "a", "left").join(by("b"), "b", "left").na.fill(0, ["wide_a", "wide_b"])
    hope = cut(hope.where(F.col("n") + F.least("wide_a", "wide_b") >= support))
    # A pair of some narrow basket: looked for in the wide baskets of its rarer item.
    rare, other = F.when(F.col("wide_a") <= F.col("wide_b"), F.col("a")).otherwise(F.col("b")), F.when(F.col("wide_a") <= F.col("wide_b"), F.col("b")).otherwise(F.col("a"))
    asked = hope.where("wide_a > 0 and wide_b > 0").select("a", "b", rare.alias("rare"), other.alias("other"))
    at = asked.join(wide.select("basket", F.col("item").alias("rare")), "rare").join(wide.select("basket", F.col("item").alias("other")), ["basket", "other"])
    more = at.groupBy("a", "b").agg(F.count("*").alias("more"))
    met = hope.join(more, ["a", "b"], "left").select("a", "b", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")).where(F.col("n") >= support)
    heavy = wide.join(often.where(F.col("wide") >= support).select("item"), "item")
    if heavy.isEmpty():
        return met
    # A pair of no narrow basket has to be in so many wide ones, and so has either item.
    left, right = heavy.select("basket", F.col("item").alias("a")), heavy.select("basket", F.col("item").alias("b"))
    both = left.join(right, "basket").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    return met.unionByName(both.join(small.select("a", "b"), ["a", "b"], "left_anti"))


def peeled(edges: DataFrame, slow: float = 0.1) -> DataFrame:
    """(item, round): the degeneracy order is by round, then by item.

    A round takes all vertices whose degree is no more than the highest least degree so far:
    then no vertex has more later neighbours than the graph's degeneracy. Where that takes
    under ``slow`` of what is left (long chains), rounds go on up to one and a half times the
    mean degree, which takes a third of it at least and gives three times the degeneracy at most.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    held = lambda df: cut(df.coalesce(cores))  # noqa: E731  the graph is far smaller than the baskets; a round has a task a core
    left = held(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    out, k, n, rushed = None, 0, 0, False
    while True:
        degree = held(left.groupBy("u").agg(F.count("*").alias("d")))
        counts = {r["d"]: r["n"] for r in degree.groupBy("d").agg(F.count("*").alias("n")).collect()}  # distinct degrees: no more than the root of twice the edges
        there = sum(counts.values())
        if not there:
            # Vertices that lost all their neighbours before their own turn come last: they have none behind them.
            every = edges.select(F.col("a").alias("item")).unionByName(edges.select(F.col("b").alias("item"))).distinct()
            return cut(every.withColumn("round", F.lit(n)) if out is None else out.unionByName(every.join(out, "item", "left_anti").withColumn("round", F.lit(n))))
        k = max(k, min(counts), int(1.5 * sum(d * m for d, m in counts.items()) / there) if rushed else 0)
        taken = degree.where(F.col("d") <= k).select(F.col("u").alias("item"), F.lit(n).alias("round"))
        out = taken if out is None else out.unionByName(taken)
        gone = taken.select("item")
        left = held(left.join(gone, left.u == gone.item, "left_anti").join(gone, left.v == gone.item, "left_anti"))
        rushed, n = rushed or sum(m for d, m in counts.items() if d <= k) < slow * there, n + 1


def _projected(narrow: DataFrame, wide: DataFrame, arcs: DataFrame) -> DataFrame:
    """(v, later, n, earlier): baskets that hold v and a later neighbour, merged by the later neighbours they hold; ``earlier`` are in all of them."""
    ahead = arcs.groupBy("x").agg(F.sort_array(F.collect_list("y")).alias("ahead"))
    vertices = ahead.select(F.col("x").alias("item"), "ahead").unionByName(arcs.select(F.col("y").alias("item")).distinct().join(ahead.select(F.col("x").alias("item")), "item", "left_anti").withColumn("ahead", F.array().cast("array<bigint>")))
    vertices = cut(vertices)  # so that the join below can split an item with many baskets
    lists = narrow.join(vertices, "item").groupBy("basket").agg(F.collect_list(F.struct("item", "ahead")).alias("l"), F.collect_list("item").alias("has")).where(F.size("l") > 1)
    here = lists.select(F.transform("l", lambda e: F.struct(e.item.alias("v"), F.array_intersect(e.ahead, F.col("has")).alias("later"))).alias("l"))
    before = lambda e: F.transform(F.filter("l", lambda o: F.array_contains(o.later, e.v)), lambda o: o.v)
    kept = here.select(F.inline(F.transform(F.filter("l", lambda e: F.size(e.later) > 0), lambda e: F.struct(e.v.alias("v"), e.later.alias("later"), before(e).alias("e")))))
    rows = kept.select("v", "later", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "e")).alias("e"))
    pairs = wide.select("basket", F.col("item").alias("x")).join(arcs.select("x", "y"), "x").join(wide.select("basket", F.col("item").alias("y")), ["basket", "y"])
    if not wide.isEmpty():
        pairs = cut(pairs.select("basket", "x", "y"))
        far = pairs.groupBy("basket", "x").agg(F.sort_array(F.collect_list("y")).alias("later")).select("basket", F.col("x").alias("v"), "later")
        past = far.join(pairs.select("basket", F.col("y").alias("v"), F.col("x").alias("e")), ["basket", "v"]).select("v", "later", "e")
        rows = rows.unionByName(far.select("v", "later", F.lit(None).cast("bigint").alias("e"))).unionByName(past)
    counted = rows.groupBy("v", "later", "e").agg(F.count("*").alias("c"))
    merged = counted.groupBy("v", "later").agg(F.max("c").alias("n"), F.collect_list(F.when(F.col("e").isNotNull(), F.struct("e", "c"))).alias("l"))
    return merged.select("v", "later", "n", F.transform(F.filter("l", lambda x: x.c == F.col("n")), lambda x: x.e).alias("earlier"))


def _table(t: pa.Table, column: str, index: dict[int, int]) -> np.ndarray:
    """Which of the indexed items each row's list holds: items x rows."""
    lists = t.column(column).combine_chunks()
    out = np.zeros((len(index), t.num_rows), bool)
    row = np.repeat(np.arange(t.num_rows), np.asarray(lists.value_lengths()).astype(np.int64))
    for item, at in zip(lists.flatten().to_pylist(), row):
        out[index[item], at] = True
    return out


def closed(own: int, holds: np.ndarray, always: np.ndarray, weight: np.ndarray, support: int) -> Iterator[tuple[np.ndarray, int]]:
    """(members of the later items, support) of each closed set of the vertex and some of them.

    A set is reached by one way alone: from the set before it by adding an item and closing,
    if closing adds no item ahead of that one. ``always``: earlier items x projections.
    """
    n = len(holds)
    totals = holds @ weight
    todo = [(totals == own, np.ones(len(weight), bool), own, totals, -1)]
    while todo:
        members, rows, total, sums, last = todo.pop()
        yield members, total
        for j in np.flatnonzero((sums >= support) & ~members):
            if j <= last:
                continue
            inner = rows & holds[j]
            if always[:, inner].all(axis=1).any():
                continue
            below = holds[:, inner] @ weight[inner]
            more = below == sums[j]
            if not (more[:j] & ~members[:j]).any():
                todo.append((more, inner, int(sums[j]), below, j))


def _mined(support: int):
    def run(vertex: pa.Table, rows: pa.Table) -> pa.Table:
        own = vertex.to_pylist()[0]
        v, at = own["v"], {y["item"]: k for k, y in enumerate(own["ahead"])}
        items, supports = np.array(list(at), np.int64), [y["s"] for y in own["ahead"]]
        past = {e: k for k, e in enumerate(sorted({e for l in rows.column("earlier").to_pylist() for e in l}))}
        holds, always, weight = _table(rows, "later", at), _table(rows, "earlier", past), rows.column("n").to_numpy().astype(np.int64)
        out = []
        for members, total in closed(own["s"], holds, always, weight, support) if own["s"] != own["most"] else ():
            k = np.flatnonzero(members)
            rest = []
            for c in k:
                others = k[k != c]
                a = int(weight[holds[others].all(axis=0)].sum()) if len(others) else own["s"]
                rest.append({"c": int(items[c]), "a": a, "s": supports[c]})
            if len(k) == 1:
                rest.append({"c": v, "a": supports[k[0]], "s": own["s"]})
            out.append({"items": sorted([v, *items[k].tolist()]), "support": int(total), "rest": rest, "first": v, "own": own["s"], "behind": int(items[k[0]]) if len(k) > 1 else None})
        kind = pa.struct([("c", pa.int64()), ("a", pa.int64()), ("s", pa.int64())])
        return pa.Table.from_pylist(out, pa.schema([("items", pa.list_(pa.int64())), ("support", pa.int64()), ("rest", pa.list_(kind)), ("first", pa.int64()), ("own", pa.int64()), ("behind", pa.int64())]))

    return run


def _supports(asked: pa.Table, rows: pa.Table) -> pa.Table:
    """The support of each asked set (its first item is the vertex): the weight of the projections that hold all its others."""
    v = asked.column("v")[0].as_py() if asked.num_rows else None
    sets = asked.column("set").to_pylist()
    at = {x: k for k, x in enumerate(sorted({x for l in rows.column("later").to_pylist() for x in l}))}
    holds, weight = _table(rows, "later", at), rows.column("n").to_numpy().astype(np.int64)
    out = [int(weight[holds[[at[x] for x in s if x != v]].all(axis=0)].sum()) for s in sets]
    return pa.table({"set": pa.array(sets, pa.list_(pa.int64())), "a": pa.array(out, pa.int64())})


def closed_itemsets(lines: DataFrame, basket: str, item: str, least: int = 5, share: int = 20000, wide: int = 64) -> tuple[DataFrame, int]:
    """((items, support, rest), number of baskets): each closed itemset in at least ``least`` baskets and at least one in ``share``.

    ``items`` ascend; ``rest`` has, for sets of two or more and each item c of them, the
    support a of the set without c and the support s of c. Rows with a null basket or item
    are no part of any basket; repeated rows count once; an empty table gives no rows. Items
    are cast to bigint; further columns are not looked at.
    """
    name = lambda c: F.col(f"`{c}`")
    spark = lines.sparkSession
    entries = written(lines.select(name(basket).alias("basket"), name(item).cast("bigint").alias("item")).where("basket is not null and item is not null").distinct(), "entries")
    baskets = entries.select("basket").distinct().count()
    support = max(least, -(-baskets // share))
    single = cut(entries.groupBy("item").agg(F.count("*").alias("s")).where(F.col("s") >= support))
    often = entries.join(single.select("item"), "item")
    sizes = often.groupBy("basket").agg(F.count("*").alias("size")).where("size > 1")
    parts = written(often.join(sizes, "basket").select("basket", "item", (F.col("size") > wide).alias("wide")), "frequent")
    broad, narrow = parts.where("wide").drop("wide"), parts.where("not wide").drop("wide")
    edges = cut(frequent_pairs(entries, broad, narrow, support))
    order = peeled(edges)
    ends = lambda c, r: order.select(F.col("item").alias(c), F.col("round").alias(r))
    ranked = edges.join(ends("a", "ra"), "a").join(ends("b", "rb"), "b")
    forward = (F.col("ra") < F.col("rb")) | ((F.col("ra") == F.col("rb")) & (F.col("a") < F.col("b")))
    pick = lambda x, y: F.when(forward, F.col(x)).otherwise(F.col(y))
    arcs = cut(ranked.select(pick("a", "b").alias("x"), pick("b", "a").alias("y"), pick("rb", "ra").alias("ry"), "n"))
    merged = written(_projected(narrow, broad, arcs), "projected")
    behind = arcs.join(single.select(F.col("item").alias("y"), "s"), "y").groupBy("x").agg(F.sort_array(F.collect_list(F.struct("ry", F.col("y").alias("item"), "s"))).alias("ahead"))
    before = arcs.groupBy("y").agg(F.max("n").alias("most"))
    vertex = order.select(F.col("item").alias("v")).join(single.select(F.col("item").alias("v"), "s"), "v")
    vertex = vertex.join(behind.withColumnRenamed("x", "v"), "v", "left").join(before.withColumnRenamed("y", "v"), "v", "left")
    empty = F.array().cast("array<struct<ry:int,item:bigint,s:bigint>>")
    vertex = vertex.select("v", "s", F.coalesce("ahead", empty).alias("ahead"), F.coalesce("most", F.lit(0)).alias("most"))
    mined = cut(vertex.groupBy("v").cogroup(merged.groupBy("v")).applyInArrow(_mined(support), ROW))
    asked = mined.where("behind is not null").select(F.col("behind").alias("v"), F.array_remove("items", F.col("first")).alias("set")).distinct()
    told = asked.groupBy("v").cogroup(merged.select("v", "later", "n").join(asked.select("v").distinct(), "v", "left_semi").groupBy("v")).applyInArrow(_supports, "set array<bigint>, a bigint")
    full = mined.withColumn("set", F.when(F.col("behind").isNotNull(), F.array_remove("items", F.col("first")))).join(told, "set", "left")
    last = F.struct(F.col("first").alias("c"), F.col("a"), F.col("own").alias("s"))
    whole = full.select("items", "support", F.when(F.col("behind").isNotNull(), F.concat("rest", F.array(last))).otherwise(F.col("rest")).alias("rest"))
    lone = single.join(order.select("item"), "item", "left_anti").select(F.array("item").alias("items"), F.col("s").alias("support"), F.array().cast("array<struct<c:bigint,a:bigint,s:bigint>>").alias("rest"))
    return whole.unionByName(lone), baskets


def with_rules(sets: DataFrame, baskets: int, confidence: int = 60) -> DataFrame:
    """``sets`` with ``rules``: the (c, a, s) of ``rest``, by c, that hold in ``confidence`` of 100 baskets with the rest and more often than c does anywhere."""
    hold = lambda r: (100 * F.col("support") >= confidence * r.a) & (F.col("support") * F.lit(baskets).cast("bigint") > r.a * r.s)
    return sets.withColumn("rules", F.array_sort(F.filter("rest", hold)))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: closed itemsets of the shop's baskets with a digest of their rules."""
    sets, baskets = closed_itemsets(spark.read.parquet(f"{sf_dir}/sale_lines.parquet"), "sale_id", "item_id")
    text = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r.c, r.a, r.s)), ";")
    best = F.array_min(F.transform("rules", lambda r: F.struct(r.a.alias("a"), r.c.alias("c")))).c
    return with_rules(sets, baskets).select(
        F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"), F.size("items").cast("bigint").alias("n_items"), "support",
        F.size("rules").cast("bigint").alias("n_rules"), best.alias("best_item"), F.sha2(text, 256).alias("rules_sha256"),
    )


ORACLE_SQL = """
WITH RECURSIVE e AS (
  SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL
), n AS (SELECT count(DISTINCT sale_id) AS baskets FROM e),
f AS (SELECT item_id AS i, count(*) AS s FROM e GROUP BY item_id HAVING count(*) >= 5 AND count(*) * 20000 >= (SELECT baskets FROM n)),
w AS (SELECT e.* FROM e JOIN f ON e.item_id = f.i),
p AS (
  SELECT x.item_id AS a, y.item_id AS b, list(x.sale_id) AS t FROM w x JOIN w y ON x.sale_id = y.sale_id AND x.item_id < y.item_id
  GROUP BY ALL HAVING count(*) >= 5 AND count(*) * 20000 >= (SELECT baskets FROM n)
), g(items, t) AS (
  SELECT [a, b], t FROM p
  UNION ALL
  SELECT list_append(g.items, p.b), list_intersect(g.t, p.t) FROM g JOIN p ON p.a = g.items[-1]
  WHERE len(list_intersect(g.t, p.t)) >= 5 AND len(list_intersect(g.t, p.t)) * 20000 >= (SELECT baskets FROM n)
), sets AS (SELECT [i] AS items, s FROM f UNION ALL SELECT items, len(t) FROM g),
part AS (
  SELECT items, s, c, list_filter(items, lambda x: x <> c) AS rest FROM (SELECT items, s, unnest(items) AS c FROM sets) WHERE len(items) > 1
), sub AS (SELECT part.items, part.s AS support, part.c, sets.s AS a, part.rest FROM part JOIN sets ON sets.items = part.rest),
open AS (SELECT DISTINCT rest AS items FROM sub WHERE support = a),
rule AS (
  SELECT sub.items, sub.c, sub.a, f.s FROM sub JOIN f ON f.i = sub.c, n
  WHERE 100 * support >= 60 * a AND CAST(support AS HUGEINT) * baskets > CAST(a AS HUGEINT) * f.s
), told AS (
  SELECT items, count(*) AS n_rules, arg_min(c, {a: a, c: c}) AS best_item, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS txt FROM rule GROUP BY items
)
SELECT array_to_string(items, ',') AS items, len(items) AS n_items, CAST(sets.s AS BIGINT) AS support, coalesce(n_rules, 0) AS n_rules, best_item, sha256(coalesce(txt, '')) AS rules_sha256
FROM sets ANTI JOIN open USING (items) LEFT JOIN told USING (items)
"""
