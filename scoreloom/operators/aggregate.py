"""Means over runs, tasks, dimensions and groups, and comparisons of them.

Scores come in long form: (condition, task_id, run_index, dim, score), null where a dimension does not apply; nulls
are left out of every mean.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Means are taken over decimals of so many places and rounded to them, so that the order of summation has no say.
PLACES = 6


def mean(c: str) -> Column:
    return F.round(F.avg(F.col(c).cast(f"decimal(20,{PLACES})")), PLACES).cast("double")


def aggregate_runs(scores: DataFrame, keys: tuple[str, ...] = ("condition",)) -> DataFrame:
    """(keys, task_id, dim, mean, n): by task and, with a null task_id, over all.  One shuffle by grouping sets."""
    ks = list(keys)
    both = scores.groupingSets([[*ks, "task_id", "dim"], [*ks, "dim"]], *ks, "task_id", "dim")
    return both.agg(mean("score").alias("mean"), F.count("score").alias("n"), F.grouping("task_id").cast("int").alias("overall"))


def run_counters(runs: DataFrame, keys: tuple[str, ...] = ("condition",)) -> DataFrame:
    return runs.groupBy(*keys, "task_id").agg(
        F.count("*").alias("runs"), F.count_if("format_failure").alias("format_failures"), F.count_if("format_repaired").alias("format_repairs")
    )


def overall_accuracy(aggregate: DataFrame, keys: tuple[str, ...] = ("condition",)) -> DataFrame:
    """The mean of the dimension means (not of the runs)."""
    return aggregate.filter("overall = 1").groupBy(*keys).agg(mean("mean").alias("accuracy"), F.count("mean").alias("dims"))


def task_accuracy(aggregate: DataFrame, keys: tuple[str, ...] = ("condition",)) -> DataFrame:
    return aggregate.filter("overall = 0").groupBy(*keys, "task_id").agg(mean("mean").alias("accuracy"))


def _by_dimension(aggregate: DataFrame, dimensions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Every (keys, dim) of a declared dimension with its overall mean.  Both sides are declared lists: packs and dimensions."""
    every = aggregate.select(*keys).distinct().join(dimensions)
    over = aggregate.filter("overall = 1").select(*keys, "dim", "mean")
    return every.join(over, [*keys, "dim"], "left")


def coverage(aggregate: DataFrame, dimensions: DataFrame, keys: tuple[str, ...] = ("condition",)) -> DataFrame:
    """Covered and unexercised dimensions.  ``dimensions``: dim, reason (null where none is declared)."""
    joined = _by_dimension(aggregate, dimensions, keys)
    return joined.groupBy(*keys).agg(
        F.count_if(F.col("mean").isNotNull()).alias("covered"),
        F.count_if(F.col("mean").isNull() & F.col("reason").isNotNull()).alias("declared"),
        F.count_if(F.col("mean").isNull() & F.col("reason").isNull()).alias("undeclared"),
    )


def require_coverage(coverage_: DataFrame, overall: DataFrame, keys: tuple[str, ...] = ("condition",)) -> DataFrame:
    """``coverage_``; fails where it and the overall accuracy disagree on whether anything was scored."""
    right = overall.select(*keys, F.col("accuracy").alias("_a"))
    wrong = (F.col("covered") == 0) != F.col("_a").isNull()
    checked = coverage_.join(right, list(keys), "left").withColumn(
        "covered", F.when(wrong, F.raise_error(F.lit("coverage and overall accuracy disagree")).cast("long")).otherwise(F.col("covered"))
    )
    return checked.drop("_a")


def coverage_misses(aggregate: DataFrame, dimensions: DataFrame, keys: tuple[str, ...] = ("condition",)) -> DataFrame:
    """How many packs do not cover each dimension, most first."""
    missed = _by_dimension(aggregate, dimensions, keys).groupBy("dim").agg(F.count_if(F.col("mean").isNull()).alias("misses"))
    return missed.filter("misses > 0").orderBy(F.desc("misses"), "dim")


def cohort_coverage(covered: DataFrame) -> DataFrame:
    """How many packs cover how many dimensions.  ``covered``: one row per pack with column covered."""
    return covered.groupBy("covered").agg(F.count("*").alias("packs")).orderBy(F.desc("packs"), "covered")


def docs_provenance(entries: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Entries, how many were retrieved, and the sorted distinct dates of those."""
    got = F.coalesce(F.col("content_hash"), F.lit("")) != ""
    return entries.groupBy(*keys).agg(
        F.count("*").alias("entries"), F.count_if(got).alias("retrieved"),
        F.array_join(F.sort_array(F.collect_set(F.when(got, F.col("fetch_date").cast("string")))), ",").alias("dates"),
    )


def rollup_by_group(task_means: DataFrame, mapping: DataFrame, groups: DataFrame, excused: DataFrame | None = None) -> DataFrame:
    """Means of task means for each declared group, in declared order; a group without tasks has nulls.

    ``task_means``: task_id, dim, mean; ``mapping``: task_id, grp; ``groups``: grp, pos; ``excused``: grp, reason of
    groups that do not apply, which get nulls and the reason, whatever their tasks scored.
    """
    if excused is not None:
        plain = rollup_by_group(task_means, mapping.join(excused, "grp", "left_anti"), groups)
        return plain.join(excused.select("grp", F.col("reason").alias("not_applicable")), "grp", "left")
    joined = groups.join(mapping, "grp", "left").join(task_means, "task_id", "left")
    dims = joined.groupBy("grp", "pos", "dim").agg(mean("mean").alias("mean"), F.count_distinct(F.when(F.col("mean").isNotNull(), F.col("task_id"))).alias("tasks"))
    return dims


def group_overall(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("grp", "pos").agg(mean("mean").alias("overall"), F.max("tasks").alias("tasks"))


def cohort_conflict(packs: DataFrame) -> DataFrame:
    """One row: how many cohorts the packs name, and whether that keeps them from being compared."""
    return packs.agg(F.count_distinct(F.when(F.col("cohort") != "", F.col("cohort"))).alias("cohorts")).withColumn("conflict", F.col("cohorts") > 1)


def require_one_cohort(packs: DataFrame) -> None:
    """Refuse to put packs of different cohorts side by side."""
    if cohort_conflict(packs).first()["conflict"]:
        raise ValueError("packs of more than one cohort cannot be compared")


def by_source(rollups: DataFrame, sources: Iterable[str], value: str = "overall") -> DataFrame:
    """Groups as rows, sources as columns; null where a source has no such group."""
    return rollups.groupBy("grp").pivot("source", list(sources)).agg(F.first(value))


def compare_two(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sides' means and b - a for every (task, dim) that either has.  Null task_id: the overall rows."""
    left = a.select(F.coalesce("task_id", F.lit("")).alias("task_id"), "dim", F.col("mean").alias("a"))
    right = b.select(F.coalesce("task_id", F.lit("")).alias("task_id"), "dim", F.col("mean").alias("b"))
    return left.join(right, ["task_id", "dim"], "full").withColumn("delta", F.round(F.col("b") - F.col("a"), PLACES))


def compare_many(aggregate: DataFrame, conditions: list[str]) -> DataFrame:
    """Overall means with a column for each condition and, for each but the last, last minus it."""
    wide = aggregate.filter("overall = 1").groupBy("dim").pivot("condition", conditions).agg(F.first("mean"))
    last = conditions[-1]
    return wide.withColumns({f"{last}_minus_{c}": F.round(F.col(last) - F.col(c), PLACES) for c in conditions[:-1]})


def format_failure_row(runs: DataFrame, conditions: list[str]) -> DataFrame:
    """Failed and all runs of each condition side by side, as the last row of a comparison."""
    cell = F.concat_ws("/", F.count_if("format_failure").cast("string"), F.count("*").cast("string")).alias("cell")
    return runs.groupBy("condition").agg(cell).groupBy(F.lit("format_failures").alias("dim")).pivot("condition", conditions).agg(F.first("cell"))


def delta_vs_baseline(new: DataFrame, base: DataFrame) -> DataFrame:
    """new - base by condition and dim; null where the baseline lacks it."""
    right = base.select("condition", "dim", F.col("mean").alias("base"))
    return new.select("condition", "dim", F.col("mean").alias("new")).join(right, ["condition", "dim"], "left").withColumn(
        "delta", F.round(F.col("new") - F.col("base"), PLACES)
    )


def compare_groups(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two group rollups side by side."""
    left = a.select("grp", "pos", F.col("overall").alias("a"), F.col("tasks").alias("a_tasks"))
    right = b.select("grp", F.col("overall").alias("b"), F.col("tasks").alias("b_tasks"))
    return left.join(right, "grp", "full").withColumn("delta", F.round(F.col("b") - F.col("a"), PLACES))


def usage_rollup(runs: DataFrame, keys: tuple[str, ...] = ("condition",)) -> DataFrame:
    return runs.groupBy(*keys).agg(
        F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.sum("duration_ms").alias("duration_ms"),
        F.count_distinct("model").alias("models"), F.count_if("reused").alias("reused"),
        F.every("discipline_ok").alias("all_ok"), F.count_if(~F.col("discipline_ok")).alias("violations"),
    )
