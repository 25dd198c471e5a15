import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.operators import sampling
from tessera.operators.stream import CanonicalStream, Position
from tessera.sources import manifests, runs

SHARDS = {"a": [40, 0, 35, 30], "b": [25, 25]}


def length(source, doc):
    shards, s = SHARDS[source], 0
    while doc >= shards[s]:
        doc, s = doc - shards[s], s + 1
    return 5 + (doc + s) % 7


def walk(windows, window, seed, weights):
    """The stream by hand: draw, resolve, append, cut."""
    rng = np.random.default_rng(np.array([seed], np.uint64))
    names, count, perms, out, at, k = list(SHARDS), dict.fromkeys(SHARDS, 0), {}, {}, 0, 0

    def perm(source, epoch):
        h, n = sampling.stable_name_hash(source), SHARDS[source]
        first = np.concatenate(([0], np.cumsum(n)))
        order = np.random.default_rng(np.array([seed, h, epoch], np.uint64)).permutation(len(n))
        return np.concatenate([np.random.default_rng(np.array([seed, h, epoch, s], np.uint64)).permutation(n[s]) + first[s] for s in order.tolist()])

    while at < windows * window:
        source = names[rng.choice(len(names), p=weights)]
        total = sum(SHARDS[source])
        epoch, pos = divmod(count[source], total)
        doc = int(perms.setdefault((source, epoch), perm(source, epoch))[pos])
        count[source] += 1
        for t in range(length(source, doc)):
            g = (at + t) // window
            if g < windows:
                a, b = out.get((k, source, doc, g), (t, t + 1))
                out[k, source, doc, g] = (min(a, t), max(b, t + 1))
        at += length(source, doc) + 1
        k += 1
    state = {s: ((n - 1) // sum(SHARDS[s]), (n - 1) % sum(SHARDS[s]) + 1) for s, n in count.items() if n}
    return {(*key, *span) for key, span in out.items()}, k, at - windows * window, state


@pytest.fixture(scope="module")
def stream(spark):
    lengths = spark.createDataFrame([(s, d, length(s, d)) for s, n in SHARDS.items() for d in range(sum(n))], "source string, global_doc bigint, n_tokens bigint")
    return CanonicalStream(spark, lengths, SHARDS, [0.6, 0.4], 16, 5)


def rows(df):
    return {(r.draw, r.source, r.global_doc, r.global_window, r.tok_start, r.tok_end) for r in df.collect()}


def test_stream_is_the_walk(stream):
    spans, draws, carry, state = walk(120, 17, 5, [0.6, 0.4])
    assert rows(stream.spans(120)) == spans
    end = stream.position(120)
    assert (end.draws, end.carry, end.windows) == (draws, carry, 120)
    assert {s: (end.epoch[s], end.consumed[s]) for s in state} == state
    assert max(end.epoch.values()) >= 1


def test_resume_is_the_continuous_stream(stream):
    whole = rows(stream.spans(60))
    middle = stream.position(25)
    rest = rows(stream.spans(35, middle))
    assert {r for r in whole if r[3] >= 25 and r[0] >= middle.draws} == rest
    assert stream.position(35, middle).draws == stream.position(60).draws
    refs = {(r.source, r.global_doc) for r in stream.refs(25).collect()}
    assert {(r[1], r[2]) for r in whole if r[3] < 25} <= refs
    assert stream.position(0) == Position()


def test_checkpoints_and_evaluations(spark, tmp_path):
    for step, done in ((100, True), (200, True), (300, False)):
        d = tmp_path / f"step_{step:09d}"
        d.mkdir()
        (d / "meta.json").write_text(json.dumps({"tokens": step * 10}))
        (d / f"step_{step}.json").write_text(json.dumps({"macro_average": step / 1000}))
        if done:
            (d / "_COMPLETE").write_text("ok")
    got = runs.checkpoints(spark, str(tmp_path))
    assert sorted((r.step, r.tokens) for r in got.collect()) == [(100, 1000), (200, 2000)]
    assert sorted((r.folder_step, r.macro_average) for r in runs.evaluations(spark, str(tmp_path)).collect()) == [(100, 0.1), (200, 0.2), (300, 0.3)]
    steps = spark.range(1, 11).select((F.col("id") * 100).alias("step"))
    assert sorted(r.step for r in runs.kept_checkpoints(steps, 2, 400).collect()) == [400, 800, 900, 1000]


def test_metrics_long(spark):
    log = spark.createDataFrame([(1, 0.5, None), (2, None, 3.0)], "step bigint, loss double, lr double")
    assert sorted(map(tuple, runs.metrics_long(log).collect())) == [(1, "loss", 0.5), (2, "lr", 3.0)]


def test_documents_dump_goes_on(spark, tmp_path):
    docs = spark.createDataFrame([("s", k // 3, k % 3, 1, f"t{k}") for k in range(9)], "source string, shard_id int, local_doc int, n_tokens int, text string")
    path = str(tmp_path / "dump")
    assert runs.write_documents(docs.where("shard_id < 2"), path) == 2
    assert runs.write_documents(docs, path) == 1 and runs.write_documents(docs, path) == 0
    assert spark.read.parquet(path).count() == 9
    with pytest.raises(ValueError):
        runs.write_documents(docs.unionAll(docs), path)


def test_states():
    a = {"x": [1, {"y": float("nan")}], "z": None}
    assert runs.flattened(a)[0] == ("x.0", 1)
    assert runs.same_state(a, {"x": [1, {"y": float("nan")}], "z": None}) and not runs.same_state(a, {"x": [1.0, {"y": float("nan")}], "z": None})


def test_shard_command(spark, tmp_path, capsys):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = spark.createDataFrame([(i, f"document {i} " * (i + 1)) for i in range(12)] + [(99, "")], "pos bigint, text string")
    made = cli.build_source(spark, texts, path, str(tmp_path), "src", 300)
    assert sum(s["num_documents"] for s in made.shards) == 12 and len(made.shards) > 1
    assert manifests.Manifest.load(str(tmp_path / "manifest.yaml")).digest() == made.digest()
    cli.main(["inspect", "--prefix", str(tmp_path / made.shards[0]["prefix"]), "--tokenizer", path, "-n", "1"])
    cli.main(["token-stats", str(tmp_path / "manifest.yaml")])
    out = capsys.readouterr().out
    assert "[0] document 0" in out and "12 documents" in out
    cli.main(["merge-manifests", "--output", str(tmp_path / "all.yaml"), str(tmp_path / "manifest.yaml")])
    assert manifests.Manifest.load(str(tmp_path / "all.yaml")).shards == made.shards


def test_lines_keep_their_order_however_files_are_split(spark, tmp_path):
    """Larger files are read first and cut; lines still follow the files' paths and their places."""
    from tessera.sources import text

    want = []
    for name, n in (("a", 3), ("b", 120), ("c", 0), ("d", 40)):
        lines = [json.dumps({"text": f"{name}{k}", "other": "x" * (k % 37)}) for k in range(n)]
        want += [f"{name}{k}" for k in range(n) if k % 11 != 5]
        lines = ["{broken" if k % 22 == 5 else '{"text": ""}' if k % 11 == 5 else x for k, x in enumerate(lines)]
        (tmp_path / f"{name}.jsonl").write_text("".join(x + "\n" for x in lines))
    key, seen = "spark.sql.files.maxPartitionBytes", set()
    before = spark.conf.get(key)
    try:
        for size in ("300", "2000", before):
            spark.conf.set(key, size)
            got = text.jsonl_in_order(spark, str(tmp_path))
            seen.add(text.jsonl_text(spark, str(tmp_path)).rdd.getNumPartitions())
            rows = sorted((r.pos, r.text) for r in got.collect())
            assert [t for _, t in rows] == want and len({p for p, _ in rows}) == len(want)
    finally:
        spark.conf.set(key, before)
    assert len(seen) > 1


def test_last_score_of_an_alias_counts_however_files_are_split(spark, tmp_path):
    (tmp_path / "step_7").mkdir()
    lines = [json.dumps({"task_name": f"t{k % 5}", "task_idx": k, "metrics": {"primary_score": k / 1000}, "pad": "x" * (k % 23)}) for k in range(200)]
    (tmp_path / "step_7" / "metrics-all.jsonl").write_text("\n".join(lines) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in ("300", "5000", before):
            spark.conf.set(key, size)
            got = {r.alias: r.score for r in runs.task_scores(spark, str(tmp_path)).collect()}
            assert got == {f"t{k}": (195 + k) / 1000 for k in range(5)}
    finally:
        spark.conf.set(key, before)


def test_tokens_are_held_by_pieces_whatever_the_batches(spark):
    """A batch of many or of long texts is not held at once, and a null text goes round as an empty one."""
    import pandas as pd
    import public_tokenizers

    from tessera.functions import registry

    texts = ["a b", None, "", "long " * 50, "c"] * 40
    got = list(registry.in_pieces(iter([pd.Series(texts, dtype=object)]), lambda x: len(x or ""), limit=300))
    assert [n for s in got for n in s] == [len(x or "") for x in texts]
    assert len(got) > 20 and max(sum(s) for s in got) <= 300 + 250
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    back = df.select("k", registry.bpe_encoder(path)("text").alias("ids")).select("k", registry.bpe_decoder(path)("ids").alias("text"))
    assert {r.k: r.text for r in back.collect()} == {k: x or "" for k, x in enumerate(texts)}
