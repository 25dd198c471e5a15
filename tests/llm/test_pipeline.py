from collections import Counter

import corpus_pipeline as C
from tessera.llm import secrets
from tessera.llm._store import written
from tests.llm.conftest import SCHEMA
from tests.llm.test_operators import base_spans
from tests.llm.test_similar import brute_roots

from pyspark.sql import functions as F


def brute_kept(rows):
    """The ids that one row of each group of near copies has."""
    groups = {}
    for r, root in zip(rows, brute_roots([r.text for r in rows])):
        groups.setdefault(root, []).append(r)
    return Counter(min((r.doc_id is None, r.doc_id or 0, r.doc_id) for r in g)[2] for g in groups.values())


def test_stages_on_odd_rows(spark, docs, none):
    now = docs
    for name, stage in C.STAGES:
        before, now = now, written(stage(spark, now, None), name)
        assert now.columns == docs.columns or name == "packing"
        if name == "near_dedup":
            assert Counter(r.doc_id for r in now.collect()) == brute_kept(before.collect())
        if name == "secret_scan":
            assert now.count() == before.count()
            texts = {r.doc_id: r.text for r in before.collect()}
            for r in now.collect():
                assert not base_spans(r.text) and (r.n_chars is None) == (r.text is None)
                assert r.text == texts[r.doc_id] or "[secret]" in r.text
    assert now.count()
    for _, stage in C.STAGES:
        assert stage(spark, none, None).count() == 0


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = C.known_language(spark, docs, sf_dir)
    assert one.count() >= docs.where(F.col("text").rlike(r"\p{L}")).count() * 0.98
    got = C.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kept = set(brute_kept(one.collect()))
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} <= kept
    assert secrets.KINDS[0] == "assign"


def test_repeated_and_null_ids_lose_their_copies(spark, texts):
    """A third of all rows under one id, copies without an id, an id with two texts, and equal rows."""
    prose = [t for _, t, _, _ in texts if t and len(t.split()) > 20]
    rows = [(7, prose[k % 5], "en", "s0") for k in range(30)] + [(None, prose[k % 4 + 3], "en", "s1") for k in range(12)]
    rows += [(3, prose[6], "en", "s0"), (5, prose[6], "en", "s0"), (5, prose[7], "en", "s0"), (9, None, None, None), (None, "", None, None)]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *[0] * (len(SCHEMA.split(",")) - 5)) for r in rows], SCHEMA).repartition(4)
    first = sorted((str(r.doc_id), str(r.text)) for r in C.without_copies(spark, docs, None).collect())
    again = sorted((str(r.doc_id), str(r.text)) for r in C.without_copies(spark, docs.repartition(7), None).collect())
    assert first == again
    assert Counter(i for i, _ in first) == Counter({str(k): n for k, n in brute_kept(docs.collect()).items()})
    assert len({t for _, t in first}) == len(first)


def test_columns_named_like_a_stage_s_own(spark, docs):
    """Names of the stages, dots, backticks, maps and structs pass all stages as they are."""
    own = ["_pipeline_lang", "_pipeline_score", "_pipeline_tid", "_pipeline_row", "_PIPELINE_ROWS", "_pipeline_found", "a.b", "c`d", "_tessera_text"]
    odd = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in own])
    odd = odd.withColumns({"a map": F.create_map(F.lit("k"), F.col("doc_id")), "in": F.struct(F.col("doc_id").alias("x.y"))})
    plain, now = docs, odd
    for name, stage in C.STAGES[:-1]:
        plain, now = written(stage(spark, plain, None), name), written(stage(spark, now, None), name)
        assert now.columns == odd.columns
        assert Counter((r.doc_id, r.text) for r in now.collect()) == Counter((r.doc_id, r.text) for r in plain.collect())
        for r in now.collect():
            i = "-" if r.doc_id is None else str(r.doc_id)
            assert all(r[c] == f"{c}:{i}" for c in own) and r["in"]["x.y"] == r.doc_id
    assert C.into_sequences(spark, now, None).count() == C.into_sequences(spark, plain, None).count()
