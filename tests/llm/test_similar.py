import random

import corpus_pipeline as C
from pyspark.sql import functions as F

from tessera.llm import similar
from tests.llm.test_operators import WORD, lower


def brute_sets(t, k=5):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def brute_roots(texts, least=0.8):
    sets, root = [brute_sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def changed(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**6)}"
    return out


def near_copies():
    """Copies with changed words around the limit, chains of them, a common passage, short and blank texts."""
    rng = random.Random(3)
    line = [f"common{i}" for i in range(30)]
    out = [None, "", " \t", "one two", "One  TWO", "one two three", "Ein Satz mit genau fünf", "ein satz mit genau fünf"]
    for k in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))] + line * (k % 2)
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            base = changed(rng, base, rng.randint(1, max(1, len(base) // 60))) if rng.random() < 0.5 else base
            out.append(" ".join(changed(rng, base, rng.randint(1, max(1, len(base) // 35)))))
    return out


def test_all_pairs_of_the_limit_are_found(spark, monkeypatch):
    monkeypatch.setattr(similar, "SAMPLE", 1)
    texts = near_copies()
    rows = [(i, t, "en", "s0") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    want = set(brute_roots(texts))
    got = C.without_copies(spark, docs, None).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    assert 30 < len(want) < len(texts) - 30


def test_hubs_serve_similar_sizes_alone():
    import numpy as np

    n, first = np.array([10, 12, 13, 15, 17, 3, 3]), np.array([0, 0, 0, 0, 0, 5, 5])
    assert similar.hub_pairs(n, first, 0.8).tolist() == [0, 0, 2, 2, 4, 5, 5]


def test_one_changed_word_in_a_hundred_is_a_near_copy(spark):
    rng = random.Random(1)
    pairs = [[f"w{rng.randrange(9999)}" for _ in range(100)] for _ in range(40)]
    rows = [(2 * i, " ".join(p)) for i, p in enumerate(pairs)] + [(2 * i + 1, " ".join(p[:50] + ["other"] + p[51:])) for i, p in enumerate(pairs)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in C.without_copies(spark, docs, None).select("doc_id").collect()) == [2 * i for i in range(40)]
    assert C.without_copies(spark, docs.where(F.lit(False)), None).count() == 0


def test_many_copies_that_are_near_one_text_alone(spark):
    """Two copies with a changed word each are under the limit, but both are near the text they come from."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(84)]
    texts = [" ".join(base)] + [" ".join(changed(rng, base, 1)) for _ in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    keyed = docs.select(similar.text_key(F.col("text")).alias("tid"), F.xxhash64("doc_id").alias("row"), "text")
    found = similar.looked_at(keyed, 5, 0.8, similar.common_shingles(keyed, 5))
    members = similar.groups_of_several(found.select(F.explode("h").alias("h"), "tid", "n"))
    hubs = similar.stars(members, 0.8).groupBy("hub").count().orderBy(F.desc("count")).first()
    assert hubs.hub == keyed.where(F.col("text") == texts[0]).first().tid
    assert [r.doc_id for r in C.without_copies(spark, docs, None).collect()] == [0]


def test_pairs_of_large_groups_are_made_by_the_member(spark):
    """200 texts that meet in 30 groups: a round makes a few rows a member, and all rounds make every pair of several roots."""
    rng = random.Random(4)
    texts = {t: (rng.randint(90, 110), t % 40, rng.randbytes(64)) for t in range(200)}
    seen = spark.createDataFrame([(t, bytes(i & j & 7 for i, j in zip(b, b"\7" * 64))) for t, (_, _, b) in texts.items()], "tid bigint, bits binary")
    rows = [(h, t, n, root, root) for h in range(30) for t, (n, root, _) in texts.items()]
    members = spark.createDataFrame(rows, "h bigint, tid bigint, n int, was bigint, root bigint").repartition(4)
    found, lo, hi, more = [], 0, 1, 30
    while more:
        met = similar.nearest(members, seen, lo, hi, 0.3)
        pairs = [(r.a, r.b) for r in met.where("h is null").collect()]
        assert len(pairs) <= (hi - lo) * len(texts) * met.rdd.getNumPartitions() and (lo or len(pairs) >= 190)
        more = met.where("a is null").count()
        assert more in (0, 30)
        found += set(pairs)
        lo, hi = hi, 16 * hi + 1
    bits = {r.tid: int.from_bytes(r.bits) for r in seen.collect()}
    can = lambda a, b: (bits[a] ^ bits[b]).bit_count() * 1.3 <= (texts[a][0] + texts[b][0]) * 0.7 + 1e-6
    want = {(a, b) for b in texts for a in range(b) if texts[a][1] != texts[b][1] and can(a, b)}
    assert sorted(found) == sorted(want) and len(want) > 1000


def test_wide_bitmaps_bound_how_sets_differ():
    """Long sets keep a bit a shingle, so that those far from the limit are told apart, and folding never tells too much."""
    import numpy as np

    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 40_000).astype(np.uint64)
    for n, m, both in ((3000, 3000, 300), (4000, 4200, 1500), (4200, 4000, 3900), (300, 310, 290), (5000, 5000, 5000)):
        x, y = pool[:n], pool[n - both : n - both + m]
        (a,), (b,) = (similar.wide_bitmaps(np.zeros(len(z), np.int64), z, np.array([len(z)])) for z in (x, y))
        apart, least = similar.differing(a, b), both / (n + m - both)
        assert apart == similar.differing(b, a) <= n + m - 2 * both
        assert bool(similar.can_be(np.array([apart]), np.array([n]), np.array([m]), 0.8)[0]) == (least >= 0.7)
