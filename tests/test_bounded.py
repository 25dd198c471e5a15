"""Steps that once held a group, a file or a result whole: what they hold is bounded, and what they give is a plain walk's."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import sampling, telemetry, verify as V
from tessera.plans import continuous
from tessera.session import table_stream


def walked(rows, threshold, start, skip, window, most):
    out, runs = [], {}
    for run, step, loss, norm in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        s = runs.setdefault(run, telemetry.Spikes(threshold, start, skip, window, most))
        out.append((run, step, *s.see(step, loss, norm)))
    return sorted(out, key=str)


def series(seed, n, bad):
    rnd = random.Random(seed)
    runs, at = ["a", "b", None, "c"], {}
    rows = []
    for _ in range(n):
        run = rnd.choices(runs, [20, 3, 1, 1])[0]
        at[run] = at.get(run, 0) + rnd.choice([1, 1, 2, 9])
        rows.append((run, at[run], rnd.choice([1.0] * 30 + [float("nan"), float("inf"), None]), 9.0 if rnd.random() < bad else 1.0))
    return rows


SCHEMA = "run_id string, step bigint, loss double, norm double"


def test_spikes_by_parts_are_those_of_a_walk(spark):
    for seed, (bad, skip, window, most) in enumerate([(0.45, 3, 40, 3), (0.1, 1, 10, 3), (1.0, 7, 30, 4), (0.02, 25, 100, 2), (0.3, 0, 5, 1)]):
        rows = series(seed, 400, bad)
        got = telemetry.spike_events(spark.createDataFrame(rows, SCHEMA), 5.0, 4, skip, window, most, rows=23)
        assert sorted(map(tuple, got.collect()), key=str) == walked(rows, 5.0, 4, skip, window, most)


def test_spikes_of_a_stream_go_on_from_batch_to_batch(spark, tmp_path):
    from tessera import streaming as R

    rows = series(9, 300, 0.4)
    (tmp_path / "events.parquet").mkdir()
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = table_stream(spark, str(tmp_path), "events", maxFilesPerTrigger=1)
    got = R.drained(R.spike_stream(stream, 5.0, 4, 3, 40, 3), "spikes")
    assert sorted(map(tuple, got.collect()), key=str) == walked(rows, 5.0, 4, 3, 40, 3)


def test_a_chain_goes_on_over_batches(spark):
    rows = [(k % 3, k, [k, k + 1, *range(k % 17)]) for k in range(200)]
    want = {}
    for rank, _, t in rows:
        a = np.array(t, np.int64)
        want[rank] = V.chained(want.get(rank), {"input_ids": ("torch.int64", (len(a) - 1,), a[:-1].tobytes()), "labels": ("torch.int64", (len(a) - 1,), a[1:].tobytes())})
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "rank bigint, step int, tokens array<bigint>")
        plan = V.batch_digests(df)
        assert {r["rank"]: r["digest"] for r in plan.collect()} == {k: v.hex() for k, v in want.items()}
        assert "MapInArrow" in plan._jdf.queryExecution().toString() and "FlatMapGroups" not in plan._jdf.queryExecution().toString()
    finally:
        spark.conf.set(key, before)


def test_a_folder_of_one_file_is_pulled(spark, tmp_path):
    """It was taken for a file, of which the stream then saw nothing, and the pull waited for a first batch for ever."""
    docs = spark.createDataFrame([(k, None if k == 3 else " " if k == 5 else f"t {k}", "en", "s", 3) for k in range(20)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for n in (1, 3):
        d = str(tmp_path / str(n))
        docs.repartition(n).write.parquet(f"{d}/documents.parquet")
        got = catalog.queries()["pulled_documents"](spark, d)
        assert sorted(r.doc_id for r in got.collect()) == [k for k in range(20) if k not in (3, 5)]


def test_pull_ends_where_there_are_fewer_batches(spark, tmp_path):
    from tessera.streaming import pull as P

    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.jsonl").write_text('{"n": 1}\n')
    assert P.pull(P.json_lines(spark, str(tmp_path / "src")), str(tmp_path / "out"), "r", batches=4) == {"batches": 1, "scanned": 1, "kept": 1}


def test_a_mirrors_files_are_bounded(spark, tmp_path):
    lines = spark.createDataFrame([("part-0", "ab" * 50)] * 300 + [("part-1", "")] * 3 + [(None, "cd")], "part string, line string")
    continuous.mirrored(lines, str(tmp_path / "m"), most=2_000)
    sizes = [p.stat().st_size for p in (tmp_path / "m").rglob("*.txt")]
    assert len(sizes) > 12 and max(sizes) < 6_000 and sum(sizes) == 300 * 101 + 3 + 3


def test_pages_without_a_byte_are_counted(spark, tmp_path):
    spark.createDataFrame([(k, "u", "x" * 9 if k < 16 else "") for k in range(40)], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = catalog.queries()["verified_mirror"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(f"part-{k}", 5, 18) for k in range(8)]


def test_permutations_of_many_small_shards(spark):
    """Shards of no, few and many documents, in batches; as drawn shard by shard, and few batches of rows come of them."""
    shards, seed = {"a": [5] * 40 + [0, 3], "b": [70_000, 1]}, 7
    want = set()
    for source, epoch in (("a", 0), ("a", 3), ("b", 1)):
        h, first, at = sampling.stable_name_hash(source), np.concatenate(([0], np.cumsum(shards[source]))), 0
        for k in np.random.default_rng(np.array([seed, h, epoch], np.uint64)).permutation(len(shards[source])).tolist():
            local = np.random.default_rng(np.array([seed, h, epoch, k], np.uint64)).permutation(shards[source][k])
            want |= {(source, epoch, at + i, int(first[k] + x)) for i, x in enumerate(local.tolist())}
            at += shards[source][k]
    got = sampling.permutations(spark, shards, seed, [("a", 0), ("a", 3), ("b", 1)])
    assert set(map(tuple, got.collect())) == want and sampling.permutations(spark, shards, seed, []).count() == 0
    assert "MapInArrow" in got._jdf.queryExecution().toString()


def test_a_stream_reads_its_texts_once(spark, sf_dir):
    from tessera.plans.lineage import stream

    assert "parquet" not in stream(spark, sf_dir)[0].lengths._jdf.queryExecution().toString().lower()
