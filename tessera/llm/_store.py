"""Places shared by driver and executors, and cutting lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset in local mode (tests, a laptop) a folder of this process is
    made and set; a cluster that names none is an error, as no machine-local folder would do.
    """
    jsc = spark.sparkContext._jsc.sc()
    found = jsc.getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return jsc.getCheckpointDir().get()


def bounded(spark: SparkSession, most: int = 2 << 20) -> None:
    """Lets the batches that go to Python hold ``most`` bytes of texts, instead of so many rows, whatever their lengths."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > most:
        spark.conf.set(key, str(most))


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written once to the shared folder, with no lineage behind them."""
    shared_dir(df.sparkSession)
    bounded(df.sparkSession)
    return _plainly_sized(df.checkpoint(eager=True))


def _plainly_sized(done: DataFrame) -> DataFrame:
    """``done``, a table just cut, without Spark's estimate of its size where that is beyond a long.

    A cut table keeps the estimate of the plan behind it, and a join's is the product of its
    sides'. Where a loop joins what it cut before, the digits of the estimate double and more
    each time round: after a dozen rounds such a number fills the driver. Without one Spark takes the
    size for unknown and large, as it is told here; partitioning and order stay.
    """
    plan = done._jdf.queryExecution().logical()
    try:
        if plan.stats().sizeInBytes() < 1 << 63:
            return done
    except ValueError:  # more digits than Python reads at once
        pass
    jvm, session = done.sparkSession._jvm, done._jdf.sparkSession()
    option = jvm.scala.Option
    unsized = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, option.empty(), option.apply(plan.constraints()))
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, unsized), done.sparkSession)


def swept(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffles and checkpoints that nothing refers to any more.

    By itself it waits until the driver's JVM collects, half an hour at most
    (``spark.cleaner.periodicGC.interval``).
    """
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a columnar table in the shared folder, read again (columns still prune)."""
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(column: str) -> Column:
    """The column of that name, dots and backticks and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so in any case."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
