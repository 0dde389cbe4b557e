"""Mixing sources to target weights by hash-threshold histograms (operator 3).

Every document has a 60-bit hash of its id and text.  A source takes its whole copies first and then every document whose
hash lies below the source's threshold.  The threshold is found without sorting: sum the sizes by (source, bucket)
over 1024 buckets, take the buckets that fit the budget, and split only the bucket where the budget ends by the
next ten bits, six times in all.  What is moved is one row per source and bucket.

Defined results: null texts have size 0; the null source comes last; rows with equal id and text have equal hashes and
are taken alike; an empty table gives an empty result; a source without words gets target 0; ``repeated`` keeps all
columns, whatever their names, and ``mixed`` those of ``keep`` that are not named as its results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

HASH_BITS, STEP_BITS = 60, 10
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
#: Sources up to which the plan (about 100 bytes a source) is broadcast.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 over the decimal id, a colon and the text: the same in any engine, and spread without ids too."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def budgets(sized: DataFrame) -> DataFrame:
    """One row per source: source_size, target, whole (copies of everything) and rest (words of the last, partial copy).

    Targets share the total by weight; those above 3 times their size stop there, and the excess goes to the others
    by weight.  That is one water level: sort by limit / weight and take the first prefix of stopped sources whose
    remaining level no further source falls under.  The windows run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    per = per.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(WEIGHTS)))
    per = per.withColumn("most", (MOST_COPIES * F.col("source_size")).cast("double"))
    by_limit = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "level"))).over(every)["level"]
    per = per.withColumn("target", F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most"))))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    per = per.withColumn("whole", F.least(copies, F.lit(MOST_COPIES)).cast("long"))
    return per.select(
        "source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest")
    )


def thresholds(sized: DataFrame, plan: DataFrame, owner: str = "mixing") -> DataFrame:
    """``plan`` with ``below``: documents whose hash is smaller are taken once more.

    Six nested histograms.  Only the documents of each source's boundary bucket reach the next one.
    """
    state = plan.withColumn("below", F.lit(0).cast("long"))
    for step in range(HASH_BITS // STEP_BITS):
        width = HASH_BITS - STEP_BITS * (step + 1)
        keys = state.select(F.col("source").alias("_s"), F.col("below").alias("_b"))
        inside = sized.join(keys, F.col("source").eqNullSafe(F.col("_s"))).filter(
            F.shiftright("hash", width + STEP_BITS) == F.shiftright("_b", width + STEP_BITS)
        )
        hist = inside.groupBy("source", F.shiftright("hash", width).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.sum("words").over(upto)).select(F.col("source").alias("_s"), "bucket", "words", "upto")
        joined = state.join(hist, F.col("source").eqNullSafe(F.col("_s")), "left")
        fits = F.col("upto") <= F.col("rest")
        # The first bucket that does not fit is the boundary; without one everything fits and the top is the end.
        state = joined.groupBy("source", "source_size", "target", "whole", "rest", "below").agg(
            F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("_used"),
            F.min(F.when(~fits, F.col("bucket"))).alias("_edge"),
        ).select(
            "source", "source_size", "target", "whole",
            (F.col("rest") - F.col("_used")).alias("rest"),
            F.coalesce(F.shiftleft("_edge", width), F.lit((1 << HASH_BITS)).cast("long")).alias("below"),
        )
        # The tables are tiny (a row per source); writing them keeps each plan one histogram deep.
        state = scratch.written(state, owner)
    return state


def _bounded(plan: DataFrame) -> DataFrame:
    """The plan marked for broadcast where its rows, one a source, are few.  With more, the join is left to Spark: no
    source has a second row, so a hot one is split where it is skewed."""
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def mixed(docs: DataFrame, owner: str = "mixing", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document, with ``keep`` columns added."""
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("hash"), *keep)
    light = scratch.written(sized, owner)
    plan = thresholds(light, scratch.written(budgets(light), owner), owner)
    right = _bounded(plan.select(F.col("source").alias("_s"), "source_size", "target", "whole", "below"))
    out = light.join(right, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    copies = (F.col("whole") + (F.col("hash") < F.col("below")).cast("long")).alias("copies")
    out = out.select("doc_id", "source", "size", "source_size", "target", copies, *keep)
    return out.withColumn("copies", F.least("copies", F.lit(MOST_COPIES))).withColumn("taken", F.col("size") * F.col("copies"))


def repeated(docs: DataFrame, owner: str = "mixing") -> DataFrame:
    """``docs`` with each row 0 to 3 times, as the mix takes it.

    The hash and size of a row decide, so the plan is joined to the rows by source and nothing but the plan moves.
    """
    sized = docs.select("source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("hash"))
    light = scratch.written(sized, owner)
    plan = thresholds(light, scratch.written(budgets(light), owner), owner)
    right = _bounded(plan.select(F.col("source").alias("_s"), "whole", "below"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", hash_of(F.col("doc_id"), F.col("text")).alias("hash"))
    copies = F.least(F.col("whole") + (F.col("hash") < F.col("below")).cast("long"), F.lit(MOST_COPIES))
    taken = rows.join(right, F.col("source").eqNullSafe(F.col("_s"))).select("row", copies.alias("copies")).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents")
    return mixed(docs, "op3").select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 1.0 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight,
         3.0 * source_size AS most FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighed
  WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(level, most / weight) AS level FROM levels WHERE level * weight <= most),
plan AS (
  SELECT source, source_size, least(most, coalesce(chosen.level * weight, most))::DOUBLE AS target
  FROM levels, chosen),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM plan),
running AS (
  SELECT s.doc_id, s.size, c.source_size, c.target, c.whole,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         c.target - c.whole * c.source_size AS rest
  FROM sized s JOIN cut c ON s.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * least(whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM running
"""
