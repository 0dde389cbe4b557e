"""The streams over several batches: one file each."""

import random
from datetime import datetime, timedelta

from scoreloom.streaming import jobs

DAY = datetime(2026, 1, 1)


def _batches(spark, folder: str, schema: str, batches: list[list[tuple]]):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return jobs.read_stream(spark, f"{folder}/in", schema, "parquet", files_per_trigger=1)


def test_breaker(spark, tmp_path):
    rng, batches = random.Random(3), []
    for k in range(3):
        rows = [(c, 100 * k + i, rng.random() < p) for c, p in (("a", 0.1), ("b", 0.5), (None, 0.25)) for i in range(30)]
        batches.append(rng.sample([*rows, ("a", 100 * k + 50, None)], len(rows) + 1))
    stream = jobs.stream_breaker(_batches(spark, str(tmp_path), "condition string, pos long, format_failure boolean", batches))
    got = {}

    def keep(df, epoch):
        got[epoch] = {r["condition"]: (r["runs"], r["failures"], r["trip_pos"]) for r in df.collect()}

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    want: dict = {}
    for epoch, rows in enumerate(batches):
        for c, pos, failed in sorted(rows, key=lambda r: r[1]):
            n, f, trip = want.get(c, (0, 0, None))
            n, f = n + 1, f + bool(failed)
            want[c] = (n, f, pos if trip is None and n >= 20 and f / n > 0.2 else trip)
        assert got[epoch] == want


def test_breaker_counts_equal_the_stateful_stream(spark, tmp_path):
    """By batches: the trip is found across batches, a batch done again changes nothing, and one condition is many tasks."""
    from scoreloom.operators import running

    rng, batches = random.Random(4), []
    for k in range(3):
        rows = [(c, 100 * k + i, rng.random() < p) for c, p in (("a", 0.1), ("b", 0.5), (None, 0.25)) for i in range(30)]
        batches.append(rng.sample([*rows, ("a", 100 * k + 50, None), *([("once", 7, True)] if k == 0 else [])], len(rows) + 1 + (k == 0)))
    want: dict = {}
    for rows in batches:
        for c, pos, failed in sorted(rows, key=lambda r: r[1]):
            n, f, trip = want.get(c, (0, 0, None))
            n, f = n + 1, f + bool(failed)
            want[c] = (n, f, pos if trip is None and n >= 20 and f / n > 0.2 else trip)
    state = f"{tmp_path}/state"
    stream = _batches(spark, str(tmp_path), "condition string, pos long, format_failure boolean", batches)
    jobs.stream_breaker_counts(stream, state, f"{tmp_path}/c").awaitTermination()
    shown = lambda df: {r["condition"]: (r["runs"], r["failures"], r["trip_pos"]) for r in df.collect()}
    assert shown(jobs.breaker_counts(spark, state)) == want
    again = spark.createDataFrame(batches[2], "condition string, pos long, format_failure boolean")
    assert shown(jobs.counted_batch(again, jobs.breaker_counts(spark, state, before=2))) == want
    busy = spark.createDataFrame([("a", k, False) for k in range(4000)], "condition string, pos long, format_failure boolean")
    seen, old = [], running.stored
    running.stored = lambda df, name: seen.append(out := old(df, name)) or out
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert shown(jobs.counted_batch(busy, jobs.breaker_counts(spark, f"{tmp_path}/none"))) == {"a": (4000, 0, None)}
    finally:
        running.stored = old
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen[0].select("_range").distinct().count() > 1


def test_transcripts_of_runs_without_a_result_are_forgotten(spark, tmp_path):
    late = DAY + timedelta(days=10)
    batches = [
        [("kept", 1, "assistant", ["x"], DAY), ("lost", 1, "assistant", ["y"], DAY), ("done", 1, "assistant", ["z"], DAY), ("done", 2, "result", None, DAY), ("none", 1, "assistant", ["q"], None)],
        [("kept", 3, "assistant", ["w", "v"], DAY + timedelta(days=1)), ("kept", 2, "system", [], DAY)],
        [("kept", 4, "result", [], DAY + timedelta(days=1)), ("far", 1, "assistant", ["u"], late)],
        [("far", 2, "system", None, late)],
        [("lost", 2, "result", [], late), ("far", 3, "result", None, late)],
    ]
    stream = jobs.stream_transcripts(_batches(spark, str(tmp_path), "run_id string, pos long, type string, tools array<string>, at timestamp", batches), "at")
    jobs.start(stream, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = {r["run_id"]: (r["turns"], r["tool_uses"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"done": (1, "z"), "kept": (2, "x,v,w"), "far": (1, "u"), "lost": (0, "")}
