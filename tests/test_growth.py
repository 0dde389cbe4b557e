"""Queries on tables that are large, or filled, where their work once grew too fast or went astray."""

import re
import time
from dataclasses import replace
from pathlib import Path

from pyspark.sql import functions as F

from scoreloom.operators import gates as G
from scoreloom.operators import roundtrip as R
from scoreloom.plans import catalog, catalog_audit  # noqa: F401

from .compare import TABLES, connect, difference

SMALL = Path("/root/testdata/sf0.001")


def folder_with(spark, tmp_path, name: str, rows, schema: str) -> str:
    """The smallest tables with one of them replaced."""
    for t in TABLES:
        if t != name:
            (tmp_path / f"{t}.parquet").symlink_to(SMALL / f"{t}.parquet")
    spark.createDataFrame(rows, schema).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    return str(tmp_path)


def same_as_sql(spark, name: str, folder: str) -> None:
    assert difference(catalog.QUERIES[name](spark, folder), connect(folder), catalog.ORACLE_SQL[name]) is None


def test_description_of_a_host_with_many_pages(spark, tmp_path):
    """Each operation once read the whole description of its host again: 3000 of them took minutes."""
    rows = [(i, f"https://{'a' if i % 9 else 'b'}.example/{i % 2500}", "") for i in range(1, 3001)]
    folder = folder_with(spark, tmp_path, "pages", rows, "page_id long, url string, html string")
    same_as_sql(spark, "a5_spec_operations", str(SMALL))
    start = time.monotonic()
    same_as_sql(spark, "a5_spec_operations", folder)
    assert time.monotonic() - start < 20
    assert catalog._specs(spark, folder).selectExpr("max(length(body) - length(replace(body, 'operationId', '')))").first()[0] <= 1000 * 2 * len("operationId")


def test_references_that_a_page_cuts_off(spark, tmp_path):
    """Titles end inside a reference: what no semicolon ends is text, as the SQL has it."""
    ends = ("&amp", "&lt", "&am", "&quot", "&#39", "&nbsp", "&copy", "&amp;amp", "&amp;&amp;&amp", "&amp;lt;", "&ampx;")
    rows = [(k, "https://a.example/1", f"<html><body><header>a {e}</header><p>b{e} c</p></body></html>") for k, e in enumerate(ends)]
    same_as_sql(spark, "h1_pages_to_text", folder_with(spark, tmp_path, "pages", rows, "page_id long, url string, html string"))


def test_answer_texts_are_read_once(spark):
    """Scores and reasons once read every text for themselves, and on the fewest tasks that its bytes allow."""
    seen, docs = spark.sparkContext.accumulator(0), R.cohorts()["docs"]

    @F.pandas_udf("string")
    def counted(texts):
        seen.add(len(texts))
        return texts

    decode = lambda rows: docs.decode(rows.withColumn("raw_response", counted.asNondeterministic()("raw_response")))
    keys = spark.range(40).selectExpr(
        "id AS task_id", "array('A' || id) AS gt_catalogs", "if(id = 7, 'latest', '35.010') AS gt_firmware", "'35.010' AS gt_software", "'P' AS gt_publication", "map('lamp', 'on') AS gt_observations"
    )
    found = {(r["subject"], r["problem"]) for r in R.roundtrip_contracts({"docs": keys}, {"docs": replace(docs, decode=decode)}).collect()}
    assert found == {("7", "direct: firmware_version scores below 1"), ("7", "parsed: firmware_version scores below 1")}
    assert seen.value == 40
    grouped = keys.groupBy("task_id").agg(*[F.first(c).alias(c) for c in keys.columns[1:]])
    spread = replace(docs, decode=lambda rows: docs.decode(rows).withColumn("publication", F.spark_partition_id().cast("string")))
    both, _ = R.both_ways(grouped, replace(spread, score=lambda rows: rows.select("task_id", *[F.col(next(c for c in ("publication", "answer_publication") if c in rows.columns)).alias(d) for d in docs.dimensions])))
    assert both.filter("via = 'parsed'").select("score").distinct().count() > 1


def test_suite_of_few_categories(spark):
    """Tasks once met their categories in a task for each; anti joins of ids once sorted every task."""
    rows = [(1, "1", "a"), (1, "x1", "a"), (2, "2", "odd"), (3, "3", None), (None, "4", "b"), (5, "5", "b")]
    tasks = spark.createDataFrame(rows, "task_id long, stem string, category string")
    expected = spark.createDataFrame([(1,), (6,), (6,), (None,)], "task_id long")
    na = spark.createDataFrame([("a",), ("a",), ("odd",), (None,)], "category string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = G.task_suite(tasks, expected, na, ("a", "b"))
        assert sorted((r["subject"] or "", r["problem"]) for r in found.collect()) == [
            ("", "missing"), ("1", "category does not apply"), ("1", "duplicate"), ("2", "category does not apply"), ("2", "unexpected"), ("3", "unexpected"), ("5", "unexpected"), ("6", "missing"),
            ("odd", "unknown category marked as not applicable"), ("x1", "category does not apply"), ("x1", "id differs from the file's stem"),
        ]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"SortMergeJoin \[category#\d+\]", plan) and "LeftAnti" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
