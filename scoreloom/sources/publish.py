"""Write, audit, publish: a condition's runs and their aggregate change together, or nothing does."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.archive import reconcile
from .staging import path_of

RUNS, AGGREGATE = "runs", "aggregate"
SHOWN = 5


class NotPublished(ValueError):
    """The audit found something; ``problems`` has a few of them."""

    def __init__(self, condition: str, problems: list[str], total: int) -> None:
        super().__init__(f"{condition}: {total} of its runs stop the publication, such as {'; '.join(problems)}")
        self.problems, self.total = problems, total


def place_of(base: str, condition: str) -> str:
    return f"{base.rstrip('/')}/condition={condition}"


def audited(staged: DataFrame, archive: DataFrame, keys: list[str], transport: Iterable[str], derived: Iterable[str]) -> tuple[list[str], int]:
    """Some blocking problems of the staged runs against the archived ones, and how many there are."""
    found = reconcile(staged, archive, keys, list(transport), list(derived)).filter("problem is not null")
    total = found.count()
    first = found.orderBy("problem", *keys).limit(SHOWN).collect() if total else []
    return [f"{', '.join(str(r[k]) for k in keys)}: {r['problem']}" for r in first], total


def publish_condition(
    scored: DataFrame, archive: DataFrame, base: str, condition: str, keys: list[str], transport: Iterable[str], derived: Iterable[str],
    aggregate: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Publish ``scored`` runs of one condition and ``aggregate`` of them under ``base``; returns the published aggregate.

    Both are written to a staging folder.  What was written is read back and held against ``archive``: a key that stands
    twice, is missing or is too much, or a field of ``transport`` that drifted, stops the publication and leaves what is
    published as it is.  Fields of ``derived`` may change.  Else the condition's folder is swapped as a whole by two
    renames; should the second fail, the first is taken back.
    """
    spark = scored.sparkSession
    ident = uuid.uuid4().hex
    staging, old = (f"{base.rstrip('/')}/_{name}/{ident}" for name in ("staging", "old"))
    target = place_of(base, condition)
    fs, staged_at = path_of(spark, staging)
    try:
        scored.write.parquet(f"{staging}/{RUNS}")
        staged = spark.read.schema(scored.schema).parquet(f"{staging}/{RUNS}")
        problems, total = audited(staged, archive, keys, transport, derived)
        if total:
            raise NotPublished(condition, problems, total)
        aggregate(staged).write.parquet(f"{staging}/{AGGREGATE}")
        _swap(spark, staging, target, old)
    finally:
        if fs.exists(staged_at):
            fs.delete(staged_at, True)
    return spark.read.parquet(f"{target}/{AGGREGATE}")


def _swap(spark: SparkSession, staging: str, target: str, old: str) -> None:
    fs, new_at = path_of(spark, staging)
    target_at, old_at = path_of(spark, target)[1], path_of(spark, old)[1]
    had = fs.exists(target_at)
    if had:
        fs.mkdirs(old_at.getParent())
        if not fs.rename(target_at, old_at):
            raise OSError(f"{target} could not be moved")
    if not fs.rename(new_at, target_at):
        if had:
            fs.rename(old_at, target_at)
        raise OSError(f"{staging} could not be moved to {target}")
    if had:
        fs.delete(old_at, True)


def published(spark: SparkSession, base: str, part: str = RUNS) -> DataFrame:
    """What is published of all conditions (column condition): their runs or their aggregates."""
    return spark.read.option("basePath", base).parquet(f"{base.rstrip('/')}/condition=*/{part}").withColumn("condition", F.col("condition").cast("string"))
