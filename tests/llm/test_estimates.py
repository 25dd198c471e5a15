"""What Spark takes a cut table to hold: loops that join what they cut before must not let that number grow without end."""

import random

from tessera.llm import mixing
from tessera.llm._store import cut


def bits(df):
    """Of Spark's estimate of a table's bytes."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_cut_tables_joined_again_and_again(spark):
    table = cut(spark.range(50).repartition(3, "id"))
    assert bits(table) < 20  # small ones keep theirs
    for _ in range(6):
        table = cut(table.join(table.select("id"), "id").repartition(3, "id"))
        assert bits(table) <= 63
    assert sorted(r.id for r in table.collect()) == list(range(50))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # Spark keeps how a cut table is dealt only without it
    try:
        table = cut(table.join(table.select("id"), "id").repartition(3, "id"))
        assert bits(table) <= 63
        assert "Exchange" not in table.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rounds_of_a_mix(spark):
    rng = random.Random(3)
    rows = [(f"s{i % 3}", rng.choice([1, 2, 3, 50, 700, 9000]), rng.randrange(1 << 40)) for i in range(400)]
    plan, n = mixing.plan_mix(spark.createDataFrame(rows, "source string, size bigint, hash bigint").repartition(3))
    assert n == 3 and bits(plan) <= 63
    assert max(len(r.rounds) for r in plan.collect()) >= 3
