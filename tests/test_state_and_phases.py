import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import arrays as A, schedules as S
from tessera.functions.registry import canonical_sha256
from tessera.operators import order as O, packing as P, sampling, state as ST, verify as V
from tessera.plans.lineage import PHASED
from tessera.plans.verification import state
from tessera.sources import runs


def walk(phases, micro, seq, consumed, window, step, upto):
    """Steps one by one."""
    out = []
    while consumed < upto:
        target = phases.warmup if consumed < phases.to_main else phases.main if consumed < phases.to_late else phases.late
        m = max(1, -(-target // (micro * seq)))
        out.append((step, consumed, window, m, m * micro * seq))
        consumed, window, step = consumed + m * micro * seq, window + m * micro, step + 1
    return out


@pytest.mark.parametrize("at", [0, 3, 4, 7, 12])
def test_plans_and_maps_follow_a_walk_from_any_step(spark, at):
    whole = walk(PHASED, 4, 256, 0, 0, 0, 60_000)
    step, consumed, window = whole[at][:3]
    want = walk(PHASED, 4, 256, consumed, window, step, 60_000)
    assert want == whole[at:]
    args = (PHASED, 4, 256, 60_000, consumed, window, step)
    assert sorted(map(tuple, P.step_plan(spark, *args).collect())) == want
    g = spark.range(0, 400).select(F.col("id").alias("global_window"), F.lit("s").alias("source"), F.lit(0).alias("shard_id"), F.lit(0).alias("local_doc"), F.lit(0).alias("tok_start"), F.lit(1).alias("tok_end"), F.lit(0).alias("stream_start"))
    got = {r.global_window: (r.step, r.microbatch, r.slot, r.dp_rank) for r in P.phased_doc_map(g, P.plan_pieces(*args), 4, 4, ["stream_start"]).collect()}
    expect = {w: (s, (w - b) // 4, (w - b) % 4, (w - b) // 4 % 4) for s, _, b, m, _ in want for w in range(b, min(b + m * 4, 400))}
    assert got == expect


def test_a_step_map_is_written_in_chunks(spark, sf_dir, tmp_path):
    rows = catalog.queries()["doc_map_phased"](spark, sf_dir)
    runs.write_step_map(rows, str(tmp_path / "map"), 5)
    got = spark.read.parquet(str(tmp_path / "map"))
    assert got.where("chunk <> step div 5").isEmpty() and got.select(rows.columns).exceptAll(rows).isEmpty() and got.count() == rows.count()


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_broken_links_do_not_depend_on_stretches(spark, bucket):
    rng = random.Random(1)
    steps = sorted(rng.sample(range(100), 40))
    log = [(s, f"h{s}", None if i == 0 else f"h{steps[i - 1]}" if s % 7 else "x") for i, s in enumerate(steps)]
    df = spark.createDataFrame(log, "step long, state_hash string, prev_hash string")
    got = V.broken_links(df, steps_a_bucket=bucket)
    assert got.columns == df.columns
    assert sorted(r.step for r in got.collect()) == [s for s in steps[1:] if s % 7 == 0]


@pytest.mark.parametrize("target", [0, 1, 10, 1000])
def test_greedy_shards_follow_a_walk(spark, target):
    rng = random.Random(target)
    rows = [(g, i, rng.choice([0, 0, 1, 4, 30])) for g in "ab" for i in range(60)]
    got = {(r.g, r.o): r.shard_id for r in O.greedy_shards(spark.createDataFrame(rows, "g string, o int, n long"), target, "g", "o", "n").collect()}
    want = {}
    for g in "ab":
        shard = held = 0
        for _, i, n in [r for r in rows if r[0] == g]:
            want[g, i], held = shard, held + n
            if held >= target:
                shard, held = shard + 1, 0
    assert got == want


def feed(label, data):
    return label + b"torch.uint8\0" + str((len(data),)).encode() + b"\0" + data


def test_shard_digests_of_a_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars", "source").collect()
    want = {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        h = want.setdefault(r.doc_id % 8, hashlib.blake2b(digest_size=32))
        h.update(f"doc.{r.doc_id:012d}".encode() + b"\0" + feed(b"weight\0", (r.text or "").encode()))
        h.update(b"optim_step\0" + (r.n_chars or 0).to_bytes(8, "little", signed=True))
        h.update(feed(b"grad\0", r.source.encode()) if r.doc_id % 3 == 0 and r.source is not None else b"grad_none\0")
    got = {r.shard: r.digest for r in catalog.queries()["state_shard_digests"](spark, sf_dir).collect()}
    assert got == {k: h.hexdigest() for k, h in want.items()}


def arrays(spark, rows):
    return spark.createDataFrame([(s, n, p, c, "torch.float32", [len(d) // 4], bytearray(d), 5) for s, n, p, c, d in rows], ST.STATE)


def test_chunks_full_hash_and_refusals(spark):
    whole = arrays(spark, [(0, "b", "weight", 0, b"01234567"), (0, "a", "weight", 0, b"89ab"), (0, "a", "exp_avg", 0, b"cdef"), (0, "a", "optim_step", 0, b"")])
    a = b"a\0weight\0torch.float32\0(1,)\x0089ab" + b"optim_step\0" + (5).to_bytes(8, "little") + b"optim_exp_avg\0torch.float32\0(1,)\0cdef"
    b = b"b\0weight\0torch.float32\0(2,)\x0001234567"
    groups = [{"lr": 0.1, "betas": [0.9, 0.95]}]
    head = b"L\nprev\0" + bytes(32) + b"params\0"
    tail = b"param_groups\0" + json.dumps(groups, sort_keys=True).encode() + b"batch_digest\0" + bytes(range(32))
    got = ST.full_hash(whole, None, groups, bytes(range(32)), label=b"L\n").first().digest
    assert got == hashlib.blake2b(head + a + b + tail, digest_size=32).hexdigest()
    cut = spark.createDataFrame([(0, "b", "weight", 0, "torch.float32", [2], bytearray(b"0123"), 0), (0, "b", "weight", 1, None, None, bytearray(b"4567"), 0)], ST.STATE)
    assert ST.state_digests(cut).first().digest == hashlib.blake2b(b, digest_size=32).hexdigest()
    assert ST.state_digests(whole.limit(0)).collect() == []
    for bad in ([(0, "a", "grad", 0, b"")], [(0, "a", "weight", 0, b""), (0, "a", "weight", 0, b"")], [(0, "a", "weight", 1, b"")], [(0, "a", "other", 0, b"")]):
        with pytest.raises(Exception):
            ST.state_digests(arrays(spark, bad), grads=True).collect()


def test_handoffs(spark):
    held = arrays(spark, [(s, n, "weight", 0, f"{s}{n}zz".encode()) for s in range(2) for n in "ab"])
    told = [bytes.fromhex(r.digest) for r in ST.state_digests(held).orderBy("shard").collect()]
    chains = {r: bytes([r] * 32) for r in range(4)}
    over = V.blake(*[told[r % 2] for r in range(4)])
    assert ST.over_ranks(told, 4) == over and ST.over_ranks(told[:1], 1) == V.blake(told[0])
    before, groups = "ab" * 32, [{"lr": 1}]
    want = V.blake(b"L\n", b"prev\0", bytes.fromhex(before), b"shard_state\0", over, b"param_groups\0", json.dumps(groups).encode(), b"batch_digest\0", V.blake(*chains.values())).hex()
    check = lambda expect, **k: ST.verify_handoff(held, expect, before, **({"shards": 2, "ranks": 4, "param_groups": groups, "chains": chains, "label": b"L\n"} | k))
    assert check(want)["match"] and check(want.upper(), attested=want)["match"]
    assert not check("00" * 32)["match"] and not check(want, param_groups=[])["match"]
    for bad in (dict(expect=None, attested=want), dict(expect="no"), dict(expect=want, attested="00" * 32), dict(expect=want, shards=3), dict(expect=want, chains={0: bytes(32)})):
        with pytest.raises(ValueError):
            check(**bad)


def test_intervals_never_pass_without_steps(spark):
    log = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "step long, state_hash string")
    assert ST.interval_verdict(log, log, 1, 3).first().passed
    none = ST.interval_verdict(log, log, 7, 9).first()
    assert (none.steps, none.passed) == (0, False)
    assert tuple(ST.interval_verdict(log, log.where("step <> 2"), 1, 4).first()) == (3, 1, 1, 2, False)
    with pytest.raises(ValueError):
        ST.interval_verdict(log, log, 3, 3)


def test_descriptors_and_steps(spark, tmp_path):
    (tmp_path / "meta.json").write_text(json.dumps({"reduction_mode": "fast"}))
    with pytest.raises(ValueError):
        runs.descriptor(spark, str(tmp_path))
    (tmp_path / "meta.json").write_text(json.dumps({"reduction_mode": runs.AUDITABLE, "step": 3}))
    with pytest.raises(FileNotFoundError):
        runs.descriptor(spark, str(tmp_path))
    (tmp_path / "global_stream.json").write_text(json.dumps({"consumed_documents_per_source": {"a": 4}, "epoch_per_source": {"a": 0}, "windows_emitted": 9}))
    meta, at = runs.descriptor(spark, str(tmp_path))
    assert meta["step"] == 3 and at["windows_emitted"] == 9 and at["carry_over"] == []
    assert runs.until_step(None, 5, False) == 5 and runs.until_step(9, 5, True) == 9
    for asked in (None, 5):
        with pytest.raises(ValueError):
            runs.until_step(asked, 5, True)


def test_scores_of_evaluations(spark, tmp_path):
    line = lambda alias, score, idx: json.dumps({"task_name": "t", "task_idx": idx, "task_config": {"metadata": {"alias": alias} if alias else {}}, "metrics": {"primary_score": score}})
    for step, rows in ((100, [("core_9mcqa::olmes", 0.5, None), ("mmlu::olmes", 0.3, None), ("arc:mc::olmes", 0.1, 0), ("arc:mc::olmes", 0.2, 1), ("gsm8k", 0.4, 2), (None, 0.6, 3), ("gone", None, 4)]), (200, [("mmlu::olmes", 0.4, None)])):
        (tmp_path / f"step_{step}").mkdir()
        (tmp_path / f"step_{step}" / "metrics-all.jsonl").write_text("\n".join(line(*r) for r in rows))
    got = runs.task_scores(spark, str(tmp_path))
    assert sorted((r.alias, r.score, r.kind) for r in got.where("step = 100").collect()) == [("arc:mc::olmes", 0.2, "per_task"), ("core_9mcqa::olmes", 0.5, "aggregate"), ("gsm8k", 0.4, "extended"), ("mmlu::olmes", 0.3, "aggregate"), ("t", 0.6, "extended")]
    made = {r.step: (r.olmes_macro, r.num_leaf_tasks) for r in runs.score_summary(got).collect()}
    assert made[100] == (pytest.approx(0.48), 1) and made[200] == (None, 0)


def test_canonical_json_and_scores_of_nothing(spark):
    assert canonical_sha256('{"b": 1, "a": [1, 2]}') == hashlib.sha256(b'{"a":[1,2],"b":1}').hexdigest()
    none = spark.range(1).select(A.continuation_score(F.array().cast("array<array<double>>"), F.array().cast("array<int>")).alias("s")).first().s
    assert tuple(none) == (0.0, True)


@pytest.mark.parametrize("stretch", [1, 7, 10_000])
def test_numbers_resolve_whatever_the_stretch(spark, stretch):
    shards = [("a", 0, 0, 5), ("a", 1, 5, 5), ("a", 2, 5, 40), ("b", 0, 0, 3)]
    docs = [(s, i) for s, n in (("a", 42), ("b", 4)) for i in range(n)]
    got = sampling.resolve(spark.createDataFrame(docs, "source string, global_doc long"), spark.createDataFrame(shards, "source string, shard_id int, cum long, next_cum long"), stretch)
    want = sorted((s, i, k, i - lo) for s, i in docs for t, k, lo, hi in shards if s == t and lo <= i < hi)
    assert sorted((r.source, r.global_doc, r.shard_id, r.local_doc) for r in got.collect()) == want
