"""Evaluation results: scores, macros, suites, stitching of run segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Fixed values, in order of preference.
PRIMARY = ("acc_norm,none", "acc,none", "exact_match,none", "pass_at_1,none")


def primary_metric(metrics: Column, keys: Sequence[str] = PRIMARY) -> Column:
    """The first of ``keys`` that a map of metrics has, else its first value, else 0."""
    return F.coalesce(*[F.element_at(metrics, k) for k in keys], F.get(F.map_values(metrics), F.lit(0)), F.lit(0.0))


def macro(scores: DataFrame, category: str = "category", score: str = "score", by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Means per category (and ``by``), and the mean of these; failed (null) scores are left out, and no category gives 0."""
    per = scores.where(F.col(score).isNotNull()).groupBy(*by, category).agg(F.avg(score).alias("macro"))
    return per, per.groupBy(*by).agg(F.coalesce(F.avg("macro"), F.lit(0.0)).alias("macro_average"))


def olmes_macro(core: Column, mmlu: Column) -> Column:
    """Nine parts core, one part the other; null if either is."""
    return (core * 9 + mmlu) / 10


def expand(suites: Mapping[str, Sequence[str]], leaves: set[str], names: Sequence[str]) -> list[str]:
    """Suites to their tasks, in order and as often as they are named; an unknown name is an error."""
    out: list[str] = []

    def walk(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise ValueError(f"suite {name} contains itself")
        if name in suites:
            for x in suites[name]:
                walk(x, (*path, name))
        elif name in leaves:
            out.append(name)
        else:
            raise ValueError(f"no task or suite {name}")

    for n in names:
        walk(n, ())
    return out


def stitched(points: DataFrame, segment: str = "segment", step: str = "step") -> DataFrame:
    """One row a step: the latest segment's."""
    return points.withColumn("_r", F.row_number().over(W.partitionBy(step).orderBy(F.col(segment).desc()))).where("_r = 1").drop("_r")


def always_equal(scores: DataFrame, macros: DataFrame, category: str = "category") -> DataFrame:
    """(category, task) for categories whose macro is one task's score at every step of theirs; only where that task is unique."""
    steps = macros.groupBy(category).agg(F.countDistinct("step").alias("steps"))
    same = scores.join(macros, ["step", category]).where(F.col("score") == F.col("macro")).groupBy(category, "task").agg(F.countDistinct("step").alias("n"))
    hit = same.join(steps, category).where("n = steps")
    alone = hit.groupBy(category).agg(F.count("*").alias("k"), F.min("task").alias("task"))
    return alone.where("k = 1").select(category, "task")
