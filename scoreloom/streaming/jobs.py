"""The incremental jobs.  Each takes a stream (or a batch, for tests) and gives a stream; ``start`` runs it.

Checkpoints hold what has been done, so a job that is started again goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.archive import BREAKER_FLOOR, BREAKER_THRESHOLD
from ..operators.running import summed_before
from ..sources.staging import path_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_trigger: int = 100) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("multiLine", True) if fmt == "json" else reader).format(fmt).load(path)


def stream_score(runs: DataFrame, score: Callable[[DataFrame], DataFrame], keys: list[str], time: str, delay: str = "2 days") -> DataFrame:
    """Scores of runs as they come: a stream-static job, each key once.  ``score``: what a batch would apply.

    A key is remembered for ``delay`` after its ``time``; rows that come later than that are dropped.
    """
    return score(runs.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each condition of a batch of rows: its positions and failures, packed."""
    for pdf in batches:
        failed = pdf["format_failure"].fillna(False).to_numpy(bool)
        pos = pdf["pos"].to_numpy(np.int64)
        groups = pdf.groupby("condition", sort=False, dropna=False).indices
        yield pd.DataFrame(
            [(None if pd.isna(c) else c, pos[at].tobytes(), failed[at].tobytes()) for c, at in groups.items()], columns=["condition", "pos", "failed"]
        )


class _Breaker(StatefulProcessor):
    """Holds (runs, failures, position at which the breaker tripped) of one condition."""

    threshold, floor = BREAKER_THRESHOLD, BREAKER_FLOOR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("counts", "n long, failures long, trip long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, failures, trip = self._state.get() if self._state.exists() else (0, 0, -1)
        packed = [pair for pdf in rows for pair in zip(pdf["pos"], pdf["failed"], strict=True)]
        pos = np.concatenate([np.frombuffer(p, np.int64) for p, _ in packed])
        failed = np.concatenate([np.frombuffer(f, bool) for _, f in packed])
        # Rows of one batch come in any order: they are put in order of position first.
        order = np.argsort(pos, kind="stable")
        seen, so_far = n + np.arange(1, len(pos) + 1), failures + np.cumsum(failed[order])
        over = np.flatnonzero((seen >= self.floor) & (so_far / seen > self.threshold))
        if trip < 0 and self.threshold < 1 and len(over):
            trip = int(pos[order[over[0]]])
        n, failures = int(seen[-1]), int(so_far[-1])
        self._state.update((n, failures, trip))
        yield pd.DataFrame({"condition": [key[0]], "runs": [n], "failures": [failures], "trip_pos": [None if trip < 0 else trip]}).astype({"trip_pos": "Int64"})

    def close(self) -> None:
        pass


def stream_breaker(runs: DataFrame) -> DataFrame:
    """After each batch, per condition: runs, failures and where the breaker tripped.  ``runs``: condition, pos (not
    null), format_failure (null: none).

    Rows are packed before they move: of a condition the batch moves nine bytes a run, and counts them as arrays.
    """
    runs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    packed = runs.select("condition", "pos", "format_failure").mapInPandas(_packed, "condition string, pos binary, failed binary")
    return packed.groupBy("condition").transformWithStateInPandas(
        statefulProcessor=_Breaker(), outputStructType="condition string, runs long, failures long, trip_pos long", outputMode="Update", timeMode="None"
    )


_COUNTS = "condition string, runs long, failures long, trip_pos long"


def breaker_counts(spark: SparkSession, state: str, before: int | None = None) -> DataFrame:
    """condition, runs, failures, trip_pos after the last batch (of those before ``before``); empty where there is none."""
    fs, at = path_of(spark, state)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    done = [int(n.split("=")[1]) for n in names if n.startswith("epoch=") and fs.exists(path_of(spark, f"{state}/{n}/_SUCCESS")[1])]
    done = [e for e in done if before is None or e < before]
    return spark.read.schema(_COUNTS).parquet(f"{state}/epoch={max(done)}") if done else spark.createDataFrame([], _COUNTS)


def counted_batch(batch: DataFrame, counts: DataFrame) -> DataFrame:
    """``counts`` after a batch of runs: two levels, running sums inside ranges of positions and totals of the ranges
    before, so that a busy condition is counted by many tasks."""
    failed = F.coalesce("format_failure", F.lit(False)).cast("long")
    runs = batch.select("condition", "pos", failed.alias("_x"))
    before = counts.select(F.col("condition").alias("_c"), "runs", "failures", "trip_pos")
    rows = summed_before(runs, ["condition"], "pos", {"_n": F.lit(1).cast("long"), "_f": F.col("_x")}).join(before, F.col("condition").eqNullSafe(F.col("_c")), "left")
    zero = F.lit(0).cast("long")
    n, f = F.coalesce("runs", zero) + F.col("_n") + 1, F.coalesce("failures", zero) + F.col("_f") + F.col("_x")
    trips = (n >= BREAKER_FLOOR) & (f / n > BREAKER_THRESHOLD)
    new = rows.groupBy("condition").agg(F.max(n).alias("runs"), F.max(f).alias("failures"), F.coalesce(F.first("trip_pos"), F.min(F.when(trips, F.col("pos")))).alias("trip_pos"))
    silent = counts.join(new.select(F.col("condition").alias("_c")), F.col("condition").eqNullSafe(F.col("_c")), "left_anti")
    return new.unionByName(silent)


def stream_breaker_counts(runs: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """The breaker over a stream whose conditions may be busy: counts are a table, one folder a batch under ``state``.

    A batch reads the counts that the batch before it left and writes its own, so one that is done again comes out the
    same.  Read them by ``breaker_counts``.  ``runs``: condition, pos, format_failure.
    """

    def count(batch: DataFrame, epoch: int) -> None:
        counts = breaker_counts(batch.sparkSession, state, epoch)
        counted_batch(batch, counts).write.mode("overwrite").parquet(f"{state}/epoch={epoch}")

    return runs.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Transcript(StatefulProcessor):
    """Tool names and turns of one run until its result arrives; then one row, and the state goes.

    The state of a run whose result does not come goes when the watermark has passed the run's last event.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._tools = handle.getListState("tools", "pos long, name string")
        self._run = handle.getValueState("run", "turns long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns, last = self._run.get() if self._run.exists() else (0, None)
        if last is not None:
            self._handle.deleteTimer(last + 1)
            if last < timerValues.getCurrentWatermarkInMs():
                self._forget()
                turns, last = 0, None
        done, added = False, []
        for pdf in rows:
            for pos, kind, names, ms in zip(pdf["pos"], pdf["type"], pdf["tools"], pdf["event_ms"], strict=True):
                turns += kind == "assistant"
                done |= kind == "result"
                added += [(int(pos), n) for n in (names if names is not None else [])]
                last = int(ms) if last is None else max(last, int(ms))
        for a in added:
            self._tools.appendValue(a)
        if done:
            tools = [name for _, name in sorted(self._tools.get())] if self._tools.exists() else []
            self._forget()
            yield pd.DataFrame({"run_id": [key[0]], "turns": [turns], "tool_uses": [",".join(tools)]})
        else:
            self._run.update((turns, last))
            self._handle.registerTimer(last + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        return iter([])

    def _forget(self) -> None:
        self._tools.clear()
        self._run.clear()

    def close(self) -> None:
        pass


def stream_transcripts(events: DataFrame, time: str, delay: str = "2 days") -> DataFrame:
    """One row per run when its result event arrives.  ``events``: run_id, pos, type, tools (array), and ``time``, a
    timestamp (rows without one are left out).

    A run is remembered for ``delay`` after its last event; rows that come later than that are dropped, and a run
    that goes on after it has been forgotten begins anew.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = events.filter(F.col(time).isNotNull()).withWatermark(time, delay)
    timed = timed.select("run_id", "pos", "type", "tools", F.unix_millis(time).alias("event_ms"), F.col(time).alias("event_time"))
    return timed.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=_Transcript(), outputStructType="run_id string, turns long, tool_uses string", outputMode="Append", timeMode="EventTime"
    )


def start(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream as Parquet until what is there has been read."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
