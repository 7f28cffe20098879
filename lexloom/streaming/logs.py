"""Streams: metrics from growing logs, stateless line filters, resumable batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.functions.gloss import keep_segmentation
from lexloom.functions.parse import log_metrics


def metrics(lines: DataFrame, column: str = "value") -> DataFrame:
    """(metric, value) of each log line, static or streaming, with its step."""
    found = log_metrics(F.col(column))
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in found.items() if n not in ("step", "checkpoint")))
    return lines.select(found["step"].alias("step"), F.explode(pairs).alias("m")).where("m.value is not null").select("step", "m.metric", "m.value")


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of log files as they come."""
    return spark.readStream.text(folder)


def segment_filter(lines: DataFrame) -> DataFrame:
    """The stream's ``word<TAB>seg-ment`` lines whose segments spell the word."""
    f = F.split("value", "\t")
    return lines.where((F.size(f) == 2) & keep_segmentation(F.get(f, F.lit(0)), F.get(f, F.lit(1))))


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each batch handled once, resumable from its checkpoint; ``every`` throttles, else all that
    is there is read and the query ends."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
