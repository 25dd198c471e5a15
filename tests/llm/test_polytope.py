import math

import numpy as np
import pytest

from tessera.llm import polytope as P
from tests import oracle

SCHEMA = "vec_id bigint, embedding array<float>, label int, node int, key string, id int"


def vectors(n=400, dims=24, seed=2):
    """Clusters around and beyond the limit, equal vectors, scaled ones, and all that may not link."""
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for k in range(n // 8):
        centre = rng.normal(size=dims)
        for _ in range(8):
            v = centre / np.linalg.norm(centre) + rng.normal(size=dims) * rng.choice([0.0, 0.01, 0.02, 0.03, 0.06])
            rows.append((at, (v * rng.choice([1.0, 30.0])).astype(np.float32).tolist(), int(k % 3)))
            at += 1
    one = rows[0][1]
    rows += [(at + 1, one, 0), (at + 1, one, 0), (at + 1, one, 1), (None, one, 0), (at + 2, one, None), (at + 3, None, 0), (at + 4, [0.0] * dims, 0), (at + 5, [0.0] * dims, 0)]
    rows += [(at + 6, [math.nan] + one[1:], 0), (at + 7, [None] + one[1:], 0), (at + 8, [math.inf] + one[1:], 0), (at + 9, [], 0), (at + 10, [1e30] * dims, 2), (at + 11, [1e-30] * dims, 2), (at + 12, [1.0], 2), (at + 13, [1.0, 0.0], 2), (None, None, None)]
    return rows


def brute(rows, least=0.98):
    dims = max(len(v or []) for _, v, _ in rows)
    ok = [k for k, (_, v, l) in enumerate(rows) if l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1] + [0.0] * (dims - len(rows[k][1]))) for k in ok}
    unit = {k: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for k, v in unit.items()}
    links, root = [0] * len(rows), list(range(len(rows)))
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= least:
                links[a] += 1
                root = [root[a] if r == root[b] else r for r in root]
    low = {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            low[r] = min(low.get(r, rows[k][0]), rows[k][0])
    return sorted((str(i), n, low.get(r), i is not None and i == low.get(r)) for (i, _, _), n, r in zip(rows, links, root))


def plain(df):
    return sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("few,block", [(48, 1024), (2, 5), (0, 3)])
def test_links_match_brute_force(spark, monkeypatch, few, block):
    monkeypatch.setattr(P, "FEW", few)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    want = brute(rows)
    assert sum(w[1] > 0 for w in want) > 100 and sum(w[3] for w in want) > 80
    assert plain(P.near_duplicates(df, block=block)) == want


def test_a_third_in_one_dense_cluster(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=16)
    rows = [(k, (base + rng.normal(size=16) * 0.03).tolist() if k % 3 == 0 else rng.normal(size=16).tolist(), 1) for k in range(600)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    assert plain(P.near_duplicates(df, block=64)) == brute([(i, np.float32(v).astype(float).tolist(), l) for i, v, l in rows])


def test_recall_at_the_limit():
    """Pairs exactly at the limit share a bucket nearly always."""
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=(2, 20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(axis=1)[:, None] * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1)[:, None]
    a, b = P.buckets(x), P.buckets(y)
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() > 0.9995


def test_buckets_do_not_depend_on_neighbours():
    x = P.hadamard(np.random.default_rng(1).normal(size=(50, 32)))
    assert (P.buckets(x)[7] == P.buckets(x[7:8])[0]).all()
    assert np.allclose(np.linalg.norm(P.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_empty_tables(spark):
    assert P.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert plain(P.near_duplicates(spark.createDataFrame([(4, None, 1, 1, "x", 2)], SCHEMA))) == [("4", 0, 4, True)]


def test_query_matches_its_sql(spark, sf_dir):
    assert oracle.rows(P.query(spark, sf_dir).toPandas()) == oracle.rows(oracle.connect(sf_dir).sql(P.ORACLE_SQL).df())
