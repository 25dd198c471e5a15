import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A, schedules as S, text as X
from tessera.operators import evals, order as O, packing as P, sampling, telemetry, twister, verify as V
from tessera.sources import idx, manifests, text as T


def sequential_windows(lengths, window):
    """Fragments by walking: each document's tokens and one end token."""
    out, at = [], 0
    for k, n in enumerate(lengths):
        for t in range(n):
            out.append((k, (at + t) // window, t))
        at += n + 1
    spans = {}
    for k, g, t in out:
        a, b = spans.get((k, g), (t, t + 1))
        spans[k, g] = (min(a, t), max(b, t + 1))
    return {(k, g, a, b) for (k, g), (a, b) in spans.items()}


@pytest.mark.parametrize("window", [3, 17, 64])
def test_spans_are_those_of_a_walk(spark, window):
    rng = random.Random(window)
    lengths = [rng.randint(0, 40) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(lengths)), "k bigint, n_tokens bigint").withColumn("b", F.expr("k div 7")).withColumn("w", F.col("n_tokens") + 1)
    got = P.spans(O.prefix_sum(docs, ["b"], ["k"], "w", "stream_start"), window).select("k", "global_window", "tok_start", "tok_end")
    assert {tuple(r) for r in got.collect()} == sequential_windows(lengths, window)


def test_step_rows_golden(spark):
    spans = [(100, "a", 0, 5, 0, 10), (100, "a", 0, 6, 0, 7), (101, "b", 1, 2, 3, 17), (105, "a", 2, 9, 0, 17)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(spans)], "global_window bigint, source string, shard_id int, local_doc int, tok_start int, tok_end int, o int")
    at = S.window_position(F.col("global_window"), F.lit(100).cast("bigint"), F.lit(3).cast("bigint"), 2)
    rows = df.select("o", at.alias("p"), S.owner_rank(at["microbatch"], 2).alias("rank")).orderBy("o").collect()
    assert [r.p.microbatch for r in rows] == [0, 0, 0, 2] and [r.p.slot for r in rows] == [0, 0, 1, 1] and [r["rank"] for r in rows] == [0, 0, 0, 0]


def test_window_outside_its_step_is_an_error(spark):
    at = S.window_position(F.col("id"), F.lit(0).cast("bigint"), F.lit(1).cast("bigint"), 2)
    with pytest.raises(Exception, match="outside"):
        spark.range(3).select(at).collect()


def test_ranks_share_all_windows(spark):
    frags = spark.range(60).select(F.col("id").alias("global_window"))
    for world in (1, 3, 4):
        parts = [{r[0] for r in P.owned_only(frags, r, world, 2, 12).collect()} for r in range(world)]
        assert sum(map(len, parts)) == 60 and set().union(*parts) == set(range(60))


def test_ordered_limit_and_quota(spark):
    df = spark.range(50)
    assert O.ordered_limit(df, F.col("id") % 2 == 1, ["id"], 0).count() == 0
    assert [r.id for r in O.ordered_limit(df, F.col("id") % 2 == 1, ["id"], 3).collect()] == [1, 3, 5]
    k = spark.range(3).select(O.worker_quota(10, 3, F.col("id")).alias("q"))
    assert sorted(r.q for r in k.collect()) == [3, 3, 4]


def test_greedy_shards_close_with_the_row_that_fills_them(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 5, 1, 12, 3, 9, 1])], "g string, o int, n int")
    got = {r.o: r.shard_id for r in O.greedy_shards(df, 10, "g", "o", "n").collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3}


def test_round_robin_rotations_add_up():
    got = O.round_robin({"a": ["a0", "a1", "a2"], "b": ["b0", "b1", "b2"], "c": ["c0", "c1"], "e": []})
    assert [f for _, f in got] == ["a0", "b0", "c0", "b1", "c1", "a1", "b2", "a2"]


def test_bucket_shuffle(spark):
    rows = spark.createDataFrame([(i, f"d{i}" if i % 10 else " ") for i in range(300)], "pos bigint, text string")
    a = [tuple(r) for r in sampling.bucket_shuffle(rows, 3, 8).orderBy("out_bucket", "out_pos").select("pos").collect()]
    rng, buckets = random.Random(3), [[] for _ in range(8)]
    for i in range(300):
        if i % 10:
            buckets[rng.randrange(8)].append(i)
    for k, b in enumerate(buckets):
        random.Random(3 * 1_000_003 + k + 1).shuffle(b)
    assert a == [(i,) for b in buckets for i in b]


def test_draws_do_not_depend_on_the_split(spark):
    args = (["a", "b"], [0.7, 0.3], 9)
    one = [r.source for r in sampling.source_draws(spark, *args, 0, 5000, partitions=1).orderBy("draw").collect()]
    many = [r.source for r in sampling.source_draws(spark, *args, 0, 5000, partitions=7).orderBy("draw").collect()]
    rng = np.random.default_rng(np.array([9], np.uint64))
    assert one == many == [["a", "b"][rng.choice(2, p=[0.7, 0.3])] for _ in range(5000)]
    assert abs(one.count("a") / 5000 - 0.7) < 0.05
    tail = [r.source for r in sampling.source_draws(spark, *args, 3000, 5000, partitions=3).orderBy("draw").collect()]
    assert tail == one[3000:]


def test_permutation_covers_each_shard(spark):
    rows = sampling.epoch_permutation(spark, "s", [4, 0, 3], 1, 0).orderBy("perm_pos").collect()
    docs = [r.global_doc for r in rows]
    assert [r.perm_pos for r in rows] == list(range(7)) and sorted(docs) == list(range(7))
    assert {tuple(sorted(docs[:4])), tuple(sorted(docs[3:]))} & {(0, 1, 2, 3), (4, 5, 6)}


def test_token_shares():
    lengths, shares = [5, 50], [0.5, 0.5]
    x = [s / n for s, n in zip(shares, lengths)]
    assert np.allclose(np.array(x) / sum(x), [10 / 11, 1 / 11])


def test_run_totals(spark):
    plan = P.step_plan(spark, S.Phases(3_145_728, 4_718_592, 9_437_184, 4_000_000_000, 360_000_000_000), 4, 4096, 400_000_000_000)
    n, tokens = plan.agg(F.count("*"), F.sum("tokens_this_step")).first()
    assert (n, tokens) == (80_957, 400_004_481_024)


def test_schedules(spark):
    c = spark.createDataFrame([(0.0,), (10.0,), (55.0,), (100.0,), (200.0,)], "c double")
    lr = [r[0] for r in c.select(S.lr_cosine(F.col("c"), 1.0, 10, 100, 0.1)).collect()]
    assert lr[0] == 0 and lr[1] == pytest.approx(1) and lr[2] == pytest.approx(0.55) and lr[3] == lr[4] == pytest.approx(0.1)
    with pytest.raises(ValueError):
        S.lr_linear_anneal(F.col("c"), 1.0, 0, 10, 10, 0.1)
    f = spark.range(1).select(S.flops_per_token(F.lit(2), F.lit(4), F.lit(8), F.lit(16))).first()[0]
    assert f == 3456
    assert S.anneal_guard(10, 10, 20) == [] and len(S.anneal_guard(12, 10, 20)) == 1
    for bad in ((9, 10, 20), (20, 10, 20)):
        with pytest.raises(ValueError):
            S.anneal_guard(*bad)


@pytest.mark.parametrize("n", range(1, 13))
def test_tree_sum_is_the_fold(spark, n):
    v = [1e16, 1.0, -1e16, 3.0, 1e-3, 7.5, 1e12, -1e12, 0.1, 0.2, 0.3, 1e8][:n]
    got = spark.createDataFrame([(v,)], "v array<double>").select(A.tree_sum(F.col("v"))).first()[0]
    balanced = lambda x: x[0] if len(x) == 1 else balanced(x[: len(x) // 2]) + balanced(x[len(x) // 2 :])
    want, at = None, 0
    for size in A.tree_blocks(n):
        part, at = balanced(v[at : at + size]), at + size
        want = part if want is None else want + part
    assert got == want
    assert sum(A.tree_blocks(n)) == n


def test_ordered_fold_keeps_its_order(spark):
    df = spark.createDataFrame([(2, -1e16), (0, 1.0), (1, 1e16)], "o int, v double")
    got = df.agg(A.ordered_fold(F.collect_list(F.struct(F.col("o").alias("order"), F.col("v").alias("value")))).alias("s")).first().s
    assert got == (1.0 + 1e16) - 1e16


def test_spikes():
    s = telemetry.Spikes(5.0, 0, 1, 10, 3)
    assert [s.see(k, 1.0, 9.0 if k in (0, 2, 5) else 1.0)[2] for k in range(6)] == [False] * 5 + [True]
    s = telemetry.Spikes(5.0, 0, 1, 10, 3)
    halts = {k: s.see(k, 1.0, 9.0)[2] for k in (0, 2, 100, 101, 102)}
    assert halts == {0: False, 2: False, 100: False, 101: False, 102: True}
    s = telemetry.Spikes(5.0, 100, 3, 10, 3)
    assert s.see(0, float("nan"), 1.0) == (True, True, False) and s.see(1, 1.0, 1.0) == (True, False, False)
    assert s.see(2, 1.0, 1.0)[0] and not s.see(3, 1.0, 9.0)[0]


def test_dead_runs_end_at_nan(spark):
    v = [0.0, 0.0, float("nan"), 0.0, 0.0, 0.0, 1.0]
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate(v)], "name string, step int, norm double")
    assert [tuple(r) for r in telemetry.dead_runs(df, 3).collect()] == [("p", 3, 5, 3)]


def test_index_bytes_and_shards(tmp_path, spark):
    docs = [[1, 2, 3, 4, 5], [], [10, 20, 30], [100], list(range(1000))]
    told = idx.write_shard(str(tmp_path / "a"), docs)
    assert told["token_count"] == 1009
    head = (tmp_path / "a.idx").read_bytes()[:33]
    assert struct.unpack("<8sQBqq", head) == (b"MMIDIDX\0", 1, 9, 5, 1009)
    r = idx.ShardReader(str(tmp_path / "a"))
    assert [d.tolist() for d in r] == docs and r.document(-2).tolist() == [100] and r.length(0) == 5
    with pytest.raises(RuntimeError):
        idx.ShardReader(str(tmp_path / "a"), index_only=True).document(0)
    got = idx.read_shards(spark, [str(tmp_path / "a")]).orderBy("local_doc").collect()
    assert [x.tokens for x in got] == docs
    slim = idx.read_shards(spark, [str(tmp_path / "a")], index_only=True)
    assert slim.columns == ["shard_id", "local_doc", "n_tokens"] and slim.count() == 5
    (tmp_path / "a.idx").write_bytes(b"X" + (tmp_path / "a.idx").read_bytes()[1:])
    with pytest.raises(ValueError):
        idx.ShardReader(str(tmp_path / "a"))


def test_manifests(tmp_path):
    m = manifests.Manifest("s", "h", shards=[{"prefix": "a", "num_documents": 1, "token_count": 2}], raw_jsonl_blake2b={"f": "1"})
    m.save(str(tmp_path / "m.yaml"))
    back = manifests.Manifest.load(str(tmp_path / "m.yaml"))
    assert back.shards[0]["bin_blake2b"] == "" and back.raw_jsonl_blake2b == {"f": "1"}
    both = manifests.merge([m, manifests.Manifest("s", "h", shards=[{"prefix": "b"}], raw_jsonl_blake2b={"g": "2"})])
    assert [s["prefix"] for s in both.shards] == ["a", "b"] and both.raw_jsonl_blake2b == {"f": "1", "g": "2"}
    other = manifests.Manifest("s", "h", raw_jsonl_blake2b={"f": "9"})
    with pytest.raises(ValueError):
        manifests.merge([m, other])
    assert manifests.merge([m, other], strict=False).raw_jsonl_blake2b == {"f": "9"}
    with pytest.raises(ValueError):
        manifests.merge([m, manifests.Manifest("s", "other")])


def test_jsonl(tmp_path, spark):
    import zstandard

    lines = b'{"text": "a"}\n\n{"text": ""}\n{"other": 1}\n{"text": "\xc3\xa9 "}\n{"text": "cut'
    (tmp_path / "x.jsonl").write_bytes(lines)
    (tmp_path / "y.jsonl.zst").write_bytes(zstandard.compress(b'{"text": "z"}\n'))
    assert sorted(r.text for r in T.jsonl_text(spark, [str(tmp_path / "x.jsonl"), str(tmp_path / "y.jsonl.zst")]).collect()) == ["a", "z", "é "]
    assert T.jsonl_rows(spark, str(tmp_path / "x.jsonl")).cache().where("bad is not null").count() == 1
    got = T.segments(spark, str(tmp_path / "x.jsonl"), 3).collect()
    assert len(got) == 5 and sorted({r.worker for r in got}) == [0, 1, 2]
    T.write_jsonl(spark.createDataFrame([("é",)], "text string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"text": "\\u00e9"}'


def test_digests_and_chains():
    a, b = V.blake(b"a"), V.blake(b"b")
    assert V.combined([a]) == a and V.combined([a, b]) == V.blake(a, b)
    x = {"k": ("int64", (2,), bytes(16))}
    assert V.chained(None, x) != V.chained(a, x) and V.chained(None, x) == V.chained(bytes(32), x)
    assert V.link(None, a) == V.link("00" * 32, a) != V.link(None, a, [])
    with pytest.raises(ValueError):
        V.combined([])


def test_suites():
    suites = {"all": ["x", "s"], "s": ["y", "x"]}
    assert evals.expand(suites, {"x", "y"}, ["all"]) == ["x", "y", "x"]
    with pytest.raises(ValueError):
        evals.expand(suites, {"x"}, ["all"])


def test_eval_split_names(spark):
    names = {"a_test_0.jsonl.zst": True, "latest/a.jsonl": False, "x/dev/y": True, "contest-1": False, "VALID.json": True}
    got = {r.n: r.e for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", X.is_eval_split(F.col("n")).alias("e")).collect()}
    assert got == names


def test_tree_sum_has_a_slot_for_every_bit(spark):
    got = spark.range(1).select(A.tree_sum(F.array_repeat(F.lit(1.0), 5)).alias("a"), A.tree_sum(F.array().cast("array<double>")).alias("b"), A.tree_sum(F.transform(F.sequence(F.lit(1), F.lit(70_000)), lambda x: x.cast("double"))).alias("c")).first()
    assert (got.a, got.b, got.c) == (5.0, None, 70_000 * 70_001 / 2)


def test_json_kinds_of_broken_texts(spark):
    cases = ["{oops", '{"a": 1', "[1, 2", "[x", '"open', "{}", "[]", '""', '{"a": 1, "a": 2}', '{"a": null}', "[null]", None, ""]
    got = [r.k for r in spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", X.json_kind(F.col("t")).alias("k")).orderBy("i").collect()]
    assert got == [None] * 5 + ["OBJECT", "ARRAY", "VARCHAR", "OBJECT", "OBJECT", "ARRAY", None, None]


def test_json_kinds(spark):
    kinds = {'{"k": 1}': "OBJECT", " [1]": "ARRAY", '"x"': "VARCHAR", "true": "BOOLEAN", "null": "NULL", "12": "UBIGINT", "-3": "BIGINT", "1.5": "DOUBLE", "2e3": "DOUBLE", "": None}
    got = {r.t: r.k for r in spark.createDataFrame([(t,) for t in kinds], "t string").select("t", X.json_kind(F.col("t")).alias("k")).collect()}
    assert got == kinds


def test_blank_is_what_strip_leaves_empty(spark):
    some = ["", " ", "\u3000\x85", "\x1c\x1f", "\u200b", "a ", "\u2028\xa0", None]
    got = {r.t: r.b for r in spark.createDataFrame([(t,) for t in some], "t string").select("t", X.blank(F.col("t")).alias("b")).collect()}
    assert got == {t: not (t or "").strip() for t in some}


def test_batch_digests_name_the_type(spark):
    """The wire format: name, type, shape, each with a zero byte behind, then the bytes."""
    import hashlib

    import numpy as np

    a = np.array([5, 6, 7], np.int64)
    named = lambda n, x: n + b"\0torch.int64\0(2,)\0" + x.tobytes()
    want = hashlib.blake2b(b"\0" * 32 + named(b"input_ids", a[:2]) + named(b"labels", a[1:]), digest_size=32).hexdigest()
    got = V.batch_digests(spark.createDataFrame([(0, 0, a.tolist())], "rank int, step int, tokens array<long>")).first().digest
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 623, 624, 20_000, 300_017])
def test_the_twister_from_any_place(n):
    want = random.Random(5)
    want.getrandbits(32 * n) if n else None
    assert twister.advanced(5, n).random_raw(700).tolist() == [want.getrandbits(32) for _ in range(700)]


@pytest.mark.parametrize("limit", [1, 7, 8, 512, 1000, 1 << 31])
def test_draws_in_order_from_many_tasks(spark, limit):
    got = twister.below(spark, 11, limit, 5000, stretch=700).orderBy("number").collect()
    rng = random.Random(11)
    assert [tuple(r) for r in got] == [(i, rng.randrange(limit)) for i in range(5000)]


def test_no_draws(spark):
    assert twister.below(spark, 1, 8, 0).count() == 0
    with pytest.raises(ValueError):
        twister.below(spark, 1, 0, 5)


@pytest.mark.parametrize("seed", [3, -3, 1 << 70])
def test_bucket_shuffle_over_many_stretches(spark, seed):
    """Text keys, white space of any script, nulls and equal texts, against the plain walk."""
    texts = [None if i % 11 == 0 else "  \t" if i % 7 == 0 else f"same{i % 5}" for i in range(4000)]
    rows = spark.createDataFrame([(f"{i:06d}", t, i) for i, t in enumerate(texts)], "pos string, text string, `number` int").repartition(5)
    got = sampling.bucket_shuffle(rows, seed, 48, stretch=512).orderBy("out_bucket", "out_pos").select("pos", "out_pos").collect()
    rng, buckets = random.Random(seed), [[] for _ in range(48)]
    for i, t in enumerate(texts):
        if t and t.strip():
            buckets[rng.randrange(48)].append(f"{i:06d}")
    for k, b in enumerate(buckets):
        random.Random(seed * 1_000_003 + k + 1).shuffle(b)
    assert [tuple(r) for r in got] == [(x, j) for b in buckets for j, x in enumerate(b)]
