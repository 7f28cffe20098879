"""Runs of equal words in a stream, with their best analysis, by event time.

Rows of a key wait as state until the watermark has passed them, and are then taken one by one in the
order of (time, order), so what arrives late by less than the watermark's delay finds its place. A run
ends with the first row of another word, or, by a timer, when its key has been quiet for ``quiet_ms`` of
event time: the last run of a key comes out as well. A key has one timer at a time, for whatever is
due first.

Kept for a key: what waits, at most the rows of the delay and of one batch (which a source bounds by
files or rows a trigger), and the open run, one row. Rows come, wait and go as JSON, in packs of up to
``PACK``, as every value of the state is a call from Python to the JVM, and every cell of a row is
converted by itself; a pack in the state has the time of its earliest row beside it. The state store is
RocksDB, which keeps it on disk and in the checkpoint folder, so a lost executor resumes
from there.

Defined results: rows with a null word or time are not part of any run; a null score is less than any
other; of rows with one time and order any is the first; a key that begins again after it was quiet
goes on counting its runs; rows later than the watermark are dropped by Spark before they come here.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: rows: JSON of (at, ord, word, analysis, score), joined by commas.
_WAITING = "earliest long, rows string"
_RUN = ("run", "word", "analysis", "score")
_RUNS = "array<struct<run long, word string, analysis string, score double>>"
PACK = 1024
#: run: number of the open run, or of the last; word is null where none is open; timer: when the key's
#: timer is due, in milliseconds.
_OPEN = "run long, word string, analysis string, score double, last long, timer long"
_LOWEST = float("-inf")

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the worker that plans a stateful query has no shipped packages


class BestOfRuns(StatefulProcessor):
    """One key's runs; its rows come as (key, time, at: microseconds, row: JSON), at null where they are
    part of no run; runs go out as JSON."""

    def __init__(self, key: str, quiet_ms: int):
        self.out = Row(key, "runs")
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.open = handle.getValueState("open", _OPEN)

    def close(self) -> None:
        pass

    def _now(self) -> list:
        return list(self.open.get() or (0, None, None, None, None, None))

    def _timed(self, now: list, due: int) -> None:
        """The key's timer, moved to ``due`` if that is earlier than what it stands at."""
        if now[5] is None or due < now[5]:
            if now[5] is not None:
                self.handle.deleteTimer(now[5])
            self.handle.registerTimer(due)
            now[5] = due

    def _kept(self, pack: list[tuple[int, str]], first: int | None) -> int:
        earliest = min(at for at, _ in pack)
        self.waiting.appendValue((earliest, ",".join(row for _, row in pack)))
        return earliest if first is None else min(first, earliest)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        first, pack = None, []
        for _, _, at, row in rows:
            if at is None:  # a filter of the stream would go before the watermark, and hide marks from it
                continue
            pack.append((at, row))
            if len(pack) == PACK:
                first = self._kept(pack, first)
                pack = []
        if pack:
            first = self._kept(pack, first)
        if first is not None:
            now = self._now()
            self._timed(now, first // 1000 + 1)
            self.open.update(tuple(now))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        now = self._now()
        now[5] = None
        due, later = [], []
        for earliest, body in self.waiting.get():
            if earliest // 1000 >= passed:
                later.append((earliest, body))
                continue
            rest = []
            for row in json.loads(f"[{body}]"):
                (due if row["at"] // 1000 < passed else rest).append(row)
            if rest:
                later.append((min(row["at"] for row in rest), json.dumps(rest)[1:-1]))
        ended = []
        for row in sorted(due, key=lambda r: (r["at"], r["ord"])):
            at, _, word, analysis, score = row.values()
            score = float(score) if isinstance(score, str) else score  # what is not finite is a text
            if now[1] != word:
                if now[1] is not None:
                    ended.append(now[:4])
                now[:4] = [now[0] + 1, word, analysis, score]
            elif self._rank(analysis, score) > self._rank(now[2], now[3]):
                now[2:4] = [analysis, score]
            now[4] = at
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if now[1] is not None and now[4] // 1000 + self.quiet_ms < passed and not later:
            ended.append(now[:4])
            now[1:5] = [None] * 4
        if later:
            self._timed(now, min(earliest for earliest, _ in later) // 1000 + 1)
        elif now[1] is not None:
            self._timed(now, now[4] // 1000 + self.quiet_ms + 1)
        self.open.update(tuple(now))
        for i in range(0, len(ended), PACK):
            yield self.out(*key, json.dumps([dict(zip(_RUN, run, strict=True)) for run in ended[i : i + PACK]]))

    @staticmethod
    def _rank(analysis: str | None, score: float | None) -> tuple[float, int]:
        return (_LOWEST if score is None else score, -len(analysis or ""))


def best_of_runs(stream: DataFrame, key: str, time: str, order: str, quiet_ms: int, delay: str = "0 seconds") -> DataFrame:
    """For a stream of (key, time, order, word, analysis, score): key, run, word, analysis, score of
    each run of equal words of a key, once it has ended; the analysis is that of the best score, of
    equals the shortest, then the first. The query has to run with the state store ``ROCKS``."""
    at = F.when(F.col("word").isNotNull(), F.unix_micros(time))
    row = F.struct(at.alias("at"), F.col(order).cast("long").alias("ord"), "word", "analysis", F.col("score").cast("double").alias("score"))
    rows = stream.withWatermark(time, delay).select(F.col(key).alias("__key"), F.col(time).alias("__time"), at.alias("at"), F.to_json(row, {"ignoreNullFields": "false"}).alias("row"))
    kind = dict(stream.dtypes)[key]
    packs = rows.groupBy("__key").transformWithState(statefulProcessor=BestOfRuns(key, quiet_ms), outputStructType=f"`{key}` {kind}, runs string", outputMode="Append", timeMode="EventTime")
    return packs.select(key, F.explode(F.from_json("runs", _RUNS, {"mode": "FAILFAST"})).alias("__r")).select(key, "__r.*")


def with_marks(stream: DataFrame, marks: str, time: str) -> DataFrame:
    """The stream and the marks that ``mark`` leaves in a folder: rows that have a time and nothing
    else, and so only move the watermark."""
    times = stream.sparkSession.readStream.schema(f"`{time}` timestamp").parquet(marks)
    return stream.unionByName(times, allowMissingColumns=True)


def mark(spark: SparkSession, marks: str, time: str, at: str) -> None:
    """Say that nothing older than ``at`` will come: what still waits or is open before comes out."""
    spark.createDataFrame([(at,)], "at string").select(F.col("at").cast("timestamp").alias(time)).coalesce(1).write.mode("append").parquet(marks)


def run_to_end(started: Callable[[], StreamingQuery], spark: SparkSession) -> None:
    """A query over what is there, with the state store that timers need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        started().awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
