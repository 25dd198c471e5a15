import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from tessera.llm import itemsets as I
from tests import oracle

SCHEMA = "sale_id bigint, item_id bigint, basket int, item string, n int"


def brute(rows, support):
    """{items: (support, rest)} by growing tidsets."""
    tids = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            tids[i].add(b)
    tids = {i: t for i, t in tids.items() if len(t) >= support}
    every, todo = {}, [((i,), t) for i, t in tids.items()]
    while todo:
        items, t = todo.pop()
        every[items] = len(t)
        todo += [((*items, i), t & u) for i, u in tids.items() if i > items[-1] and len(t & u) >= support]
    less = {x[:k] + x[k + 1 :] for x in every if len(x) > 1 for k in range(len(x)) if every[x[:k] + x[k + 1 :]] == every[x]}
    rest = lambda x: sorted((c, every[tuple(i for i in x if i != c)], every[c,]) for c in x) if len(x) > 1 else []
    return {x: (n, rest(x)) for x, n in every.items() if x not in less}


def lines(seed=1):
    """Baskets from overlapping families, a hub in half of them, very wide ones, repeats and nulls."""
    rng = random.Random(seed)
    families = [rng.sample(range(40), rng.randint(2, 7)) for _ in range(12)]
    rows = []
    for b in range(400):
        items = set(rng.choice(families)) | {rng.randrange(60) for _ in range(rng.randint(0, 2))}
        items = {i for i in items if rng.random() < 0.9} | ({-5} if b % 2 else set())
        rows += [(b, i) for i in items]
    for b in range(400, 404):
        rows += [(b, i) for i in range(b % 3, 60, 1 + b % 2)]
    return rows + rows[:50] + [(None, 3), (5, None), (None, None)]


@pytest.mark.parametrize("wide", [1, 6, 100])
def test_closed_sets_match_brute_force(spark, wide):
    rows = lines()
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA).repartition(3)
    sets, baskets = I.closed_itemsets(df, "sale_id", "item_id", least=6, wide=wide)
    got = {tuple(r["items"]): (r.support, sorted(map(tuple, r.rest))) for r in sets.collect()}
    want = brute(rows, 6)
    assert baskets == 404 and len(want) > 100 and max(map(len, want)) > 3
    assert got == want


def test_pairs_of_wide_baskets_alone_are_found(spark):
    rows = [(b, i) for b in range(7) for i in range(30)] + [(100 + k, 50) for k in range(3)]
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)
    got = {tuple(r["items"]): r.support for r in I.closed_itemsets(df, "sale_id", "item_id", wide=8)[0].collect()}
    assert got == {tuple(range(30)): 7}


def test_order_leaves_few_behind(spark):
    """A star, a clique, a long chain: every vertex has a place, and no more later neighbours than stated."""
    star, clique, chain = [(0, k) for k in range(1, 40)], list(combinations(range(100, 108), 2)), [(k, k + 1) for k in range(200, 260)]
    edges = spark.createDataFrame(star + clique + chain, "a bigint, b bigint")
    place = {r["item"]: (r["round"], r["item"]) for r in I.peeled(edges).collect()}
    assert set(place) == {v for e in star + clique + chain for v in e}
    behind = Counter(min(e, key=place.get) for e in star + clique + chain)
    assert max(behind.values()) <= 3 * 7 and max(behind[k] for k in range(40)) <= 3


def test_empty_tables_and_lone_items(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert I.closed_itemsets(none, "sale_id", "item_id")[0].count() == 0
    lone = spark.createDataFrame([(b, 9, 0, "x", 1) for b in range(6)], SCHEMA)
    assert [(r["items"], r.support) for r in I.closed_itemsets(lone, "sale_id", "item_id")[0].collect()] == [([9], 6)]


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = oracle.connect(sf)
    duck.sql(f"create view sale_lines as select * from '{sf}/sale_lines.parquet'")
    assert oracle.rows(I.query(spark, sf).toPandas()) == oracle.rows(duck.sql(I.ORACLE_SQL).df())
