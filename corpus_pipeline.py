"""The training-corpus pipeline: each stage applies one operator of tessera.llm to all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import language, mixing, packing, secrets, similar
from tessera.llm._store import cut, documents, named, unused, written

#: SQL has no form for the tokenizer, the fingerprints and the language model; the stages are tested against brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, by a model of the labelled ones: no letter or no clear language goes."""
    lang, score = unused(docs, "_pipeline_lang"), unused(docs, "_pipeline_score")
    found = language.identify(docs, language.train(docs), keep=docs.columns, pred=lang, score=score)
    return found.where((F.col(lang) != "und") & (F.col(score) >= 0.5)).select(*map(named, docs.columns))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, Jaccard similarity 0.8 or more) one row.

    It is the row with the smallest id, null ids last, and of rows that share it the one
    whose columns hash lowest; equal rows are one. Rows that share an id but not a group are
    documents of their own. Null, empty and blank texts are one group. Columns that hold maps
    or variants count by their JSON.
    """
    tid, row, rows = (unused(docs, f"_pipeline_{x}") for x in ("tid", "row", "rows"))
    plain = lambda f: not any(x in f.dataType.simpleString() for x in ("map<", "variant"))
    hashed = [named(f.name) if plain(f) else F.to_json(F.struct(named(f.name).alias("v"))) for f in docs.schema.fields]
    key = {tid: similar.text_key(F.col("text")), row: F.xxhash64(*hashed)}
    marked = docs.withColumns(key)
    slim = marked.select("doc_id", F.col(tid).alias("tid"), F.col(row).alias("row"))
    root = similar.roots(marked.select(F.col(tid).alias("tid"), F.col(row).alias("row"), F.col("text").cast("string").alias("text")), words=5, least=0.8)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "tid", F.col("rows")))
    distinct = slim.groupBy("tid", "row", "doc_id").agg(F.count("*").alias("rows"))
    stay = distinct.join(root, F.col("tid") == F.col("node"), "left").groupBy(F.coalesce("root", "tid").alias("root")).agg(first.alias("first"))
    stay = cut(stay.select(F.col("first.tid").alias(tid), F.col("first.row").alias(row), F.col("first.rows").alias(rows)))
    kept = marked.join(stay, list(key))
    once = kept.where(F.col(rows) == 1)
    if not stay.where(F.col(rows) > 1).isEmpty():
        once = once.union(kept.where(F.col(rows) > 1).dropDuplicates(list(key)))
    return once.select(*map(named, docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by a mark; texts without one stay as they are."""
    into = unused(docs, "_pipeline_found")
    found = secrets.scan(docs.select("*"), secrets.train(secrets.training_sample(spark)), into=into)
    clean = secrets.redacted(F.col("text"), F.col(into))
    changed = F.size(into) > 0
    return found.withColumn("n_chars", F.when(changed, F.length(clean).cast("bigint")).otherwise(F.col("n_chars"))).withColumn("text", clean).select(*map(named, docs.columns))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", without_copies),
    ("secret_scan", without_secrets),
    ("mixing", to_weights),
    ("packing", into_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
