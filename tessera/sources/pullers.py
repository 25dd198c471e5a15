"""A table of sources as a SQL table function: ``pull_x('source', n)`` gives the first n rows of a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators.order import prefix_sum
from tessera.sources.shared import cut, fresh


def numbered(table: DataFrame, source: str, order: str) -> DataFrame:
    """``table`` with ``number``, each row's place in its source by ``order`` (unique in a source), counted from range to range.

    Only the two columns are numbered; the rows themselves are joined to their numbers.
    """
    keys = table.select(F.col(f"`{source}`").alias("s"), F.col(f"`{order}`").alias("o")).where("s is not null and o is not null")
    ranged = cut(keys.repartitionByRange("o").withColumn("part", F.spark_partition_id()))  # read twice, so settled first
    places = prefix_sum(ranged.withColumn("one", F.lit(1)), ["part"], ["o"], "one", "number", group=["s"]).select("s", "o", "number")
    return table.join(places, (F.col(f"`{source}`") == F.col("s")) & (F.col(f"`{order}`") == F.col("o"))).drop("s", "o")


def register(name: str, table: DataFrame, source: str, order: str, columns: list[str]) -> None:
    """Makes ``name(wanted, n)`` a table function of the session: ``columns`` of the first n rows of the source ``wanted``.

    It is SQL through and through, so a call's filters reach the table's scan, and it can be
    joined LATERAL to a table of (source, n). A source that is not there, or n of 0 or less, gives no rows.
    """
    spark = table.sparkSession
    # The numbers lie in a table of their own: what a range holds is then settled for every later call.
    path = fresh(spark, f"pull-{name}")
    keys = numbered(table.select(source, order), source, order)
    keys.select(F.col(f"`{source}`").alias("s"), F.col(f"`{order}`").alias("o"), "number").write.parquet(path)
    table.createOrReplaceTempView(f"{name}_rows")
    spark.read.parquet(path).createOrReplaceTempView(f"{name}_places")
    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    returns = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    picked = ", ".join(f"r.`{c}`" for c in columns)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(wanted {kinds[source]}, n BIGINT) RETURNS TABLE({returns}) RETURN "
        f"SELECT {picked} FROM {name}_rows r JOIN {name}_places p ON r.`{source}` = p.s AND r.`{order}` = p.o WHERE p.s = wanted AND r.`{source}` = wanted AND p.number < n"
    )
