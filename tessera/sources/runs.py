"""What a run leaves on disk: checkpoints, evaluations, logs, the step map and the documents dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def step_of(path: Column) -> Column:
    """The number in a path's ``step_<digits>`` folder."""
    return F.regexp_extract(path, r"step_(\d+)/", 1).cast("bigint")


def checkpoints(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """Descriptors (``meta.json``) of complete checkpoints with their ``step``; folders without the last file are left out."""
    reader = spark.read.option("multiLine", True)
    meta = (reader.schema(schema) if schema else reader).json(f"{root}/step_*/meta.json").withColumn("step", step_of(F.col("_metadata.file_path")))
    done = spark.createDataFrame([(x,) for x in completed(spark, root)], "step bigint")
    return meta.join(F.broadcast(done), "step", "left_semi")


def completed(spark: SparkSession, root: str) -> list[int]:
    """Steps of checkpoints that have their last file. Spark's sources pass over names with a leading underscore, so the file system is asked."""
    import re

    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/step_*/_COMPLETE")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(re.search(r"step_(\d+)/", str(f.getPath()))[1]) for f in found)


def kept_checkpoints(steps: DataFrame, last: int, every: int) -> DataFrame:
    """The last few, and those whose number is a multiple of ``every``."""
    return steps.orderBy(F.desc("step")).limit(last).unionByName(steps.where(F.col("step") % every == 0)).distinct()


def evaluations(spark: SparkSession, root: str) -> DataFrame:
    """Evaluation results of all steps: the files' columns, and the step of their folder."""
    return spark.read.option("multiLine", True).json(f"{root}/step_*/step_*.json").withColumn("folder_step", step_of(F.col("_metadata.file_path")))


def metrics_long(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(step, key, value) of a wide metrics log; keys that a line lacks have no row."""
    keys = keys or [f.name for f in log.schema.fields if f.name not in ("step", "time") and f.dataType.typeName() in ("double", "long", "integer", "float")]
    return log.select("step", *[F.col(k).cast("double").alias(k) for k in keys]).unpivot("step", keys, "key", "value").where("value is not null")


def write_step_map(rows: DataFrame, path: str, chunk_steps: int) -> None:
    """The step-to-document map, a folder for each chunk of steps, in Parquet with zstd."""
    chunk = F.call_function("div", F.col("step").cast("bigint"), F.lit(chunk_steps).cast("bigint"))
    rows.withColumn("chunk", chunk).repartition("chunk").sortWithinPartitions("step", "global_window", "frag_idx").write.partitionBy("chunk").option("compression", "zstd").parquet(path)


def write_documents(docs: DataFrame, path: str) -> int:
    """The documents dump by source and shard; shards that are there already are skipped. The number of shards written.

    ``docs``: source, shard_id, local_doc, n_tokens, text. One (source, shard_id, local_doc)
    twice is an error.
    """
    spark = docs.sparkSession
    if not docs.groupBy("source", "shard_id", "local_doc").count().where("count > 1").isEmpty():
        raise ValueError("a document's place occurs twice")
    from pyspark.errors import AnalysisException

    try:
        there = spark.read.parquet(path).select("source", "shard_id").distinct()
        new = docs.join(there, ["source", "shard_id"], "left_anti")
    except AnalysisException:
        new = docs
    n = new.select("source", "shard_id").distinct().count()
    if n:
        new.repartition("source", "shard_id").sortWithinPartitions("local_doc").write.mode("append").partitionBy("source", "shard_id").option("compression", "zstd").parquet(path)
    return n


def head(docs: DataFrame, n: int, order: str = "local_doc") -> DataFrame:
    return docs.orderBy(order).limit(n)


def synthetic(spark: SparkSession, source: str, docs: int, low: int, high: int, vocab: int, seed: int) -> DataFrame:
    """(source, local_doc, n_tokens, tokens): lengths and ids from hashes of the document's number, so any part can be made alone."""
    k = F.col("id")
    n = (F.pmod(F.xxhash64(k, F.lit(source), F.lit(seed)), F.lit(high - low + 1)) + low).cast("int")
    ids = F.transform(F.sequence(F.lit(1), n), lambda i: F.pmod(F.xxhash64(k, i, F.lit(source), F.lit(seed)), F.lit(vocab)))
    return spark.range(docs).select(F.lit(source).alias("source"), k.cast("int").alias("local_doc"), n.alias("n_tokens"), ids.alias("tokens"))


def flattened(state, path: str = "") -> list[tuple[str, object]]:
    """(path, value) of a nested state, keys and places joined by dots."""
    if isinstance(state, dict):
        items = state.items()
    elif isinstance(state, (list, tuple)):
        items = enumerate(state)
    else:
        return [(path, state)]
    return [x for k, v in items for x in flattened(v, f"{path}.{k}" if path else str(k))]


def same_state(a, b) -> bool:
    """Equality of nested states, NaN equal to itself, types not mixed."""
    fa, fb = flattened(a), flattened(b)
    alike = lambda x, y: type(x) is type(y) and (x == y or (x != x and y != y))
    return len(fa) == len(fb) and all(p == q and alike(x, y) for (p, x), (q, y) in zip(fa, fb, strict=True))


#: Fixed value: how a checkpoint says that its stream is the canonical one.
AUDITABLE = "deterministic_allgather"


def descriptor(spark: SparkSession, directory: str) -> tuple[dict, dict]:
    """(meta, stream position) of a checkpoint that can be audited; any other is refused."""
    import json

    def read(name: str) -> dict:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/{name}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            raise FileNotFoundError(f"{directory} has no {name}")
        return json.loads(spark.read.text(f"{directory}/{name}", wholetext=True).first()[0])

    meta = read("meta.json")
    if meta.get("reduction_mode") != AUDITABLE:
        raise ValueError(f"reduction mode {meta.get('reduction_mode')!r}: its stream is not the canonical one")
    at = read("global_stream.json")
    return meta, {"consumed_documents_per_source": at["consumed_documents_per_source"], "epoch_per_source": at["epoch_per_source"], "mix_rng_state": at.get("mix_rng_state"), "carry_over": at.get("carry_over") or [], "windows_emitted": at.get("windows_emitted", 0)}


def until_step(asked: int | None, checkpoint_step: int, resumes: bool) -> int:
    """Where a walk ends (exclusive): the checkpoint's step unless asked otherwise; a walk that resumes there must name a later one."""
    if resumes and (asked is None or asked <= checkpoint_step):
        raise ValueError(f"a walk from step {checkpoint_step} needs a later step to end at, not {asked}")
    return checkpoint_step if asked is None else asked


def task_scores(spark: SparkSession, root: str) -> DataFrame:
    """(step, alias, score, kind) of all evaluated steps, from their ``metrics-all.jsonl``.

    ``kind``: aggregate without a task number, per_task for the forms of the core suite,
    extended else. Entries without a primary score are left out; the last of an alias counts.
    """
    schema = "task_name string, task_idx int, task_config struct<metadata:struct<alias:string>>, metrics struct<primary_score:double>"
    alias = F.coalesce("task_config.metadata.alias", "task_name")
    line = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())  # ids follow the lines inside a range alone
    rows = spark.read.schema(schema).json(f"{root}/step_*/metrics-all.jsonl").select(step_of(F.col("_metadata.file_path")).alias("step"), alias.alias("alias"), F.col("metrics.primary_score").alias("score"), "task_idx", line.alias("line")).where("score is not null")
    form = F.col("alias").endswith("::olmes") & (F.col("alias").contains(":mc::") | F.col("alias").contains(":rc::"))
    kind = F.when(F.col("task_idx").isNull(), "aggregate").when(form, "per_task").otherwise("extended")
    return rows.groupBy("step", kind.alias("kind"), "alias").agg(F.max_by("score", "line").alias("score")).select("step", "alias", "score", "kind")


def score_summary(scores: DataFrame) -> DataFrame:
    """(step, olmes_macro, num_leaf_tasks) of ``task_scores``: the macro over ten tasks, null unless both its aggregates are there."""
    one = lambda a: F.max(F.when((F.col("kind") == "aggregate") & (F.col("alias") == a), F.col("score")))
    macro = (one("core_9mcqa::olmes") * 9 + one("mmlu::olmes")) / 10
    return scores.groupBy("step").agg(macro.alias("olmes_macro"), F.count_if(F.col("kind") == "per_task").alias("num_leaf_tasks"))
