"""Writers. Ordered single-file exports are for results that one file should hold; the rest is
written in parallel and partitioned."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.ranking import sorted_places


def csv(df: DataFrame, path: str, only_if_any: bool = False) -> bool:
    if only_if_any and df.isEmpty():
        return False
    df.write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"')
    return True


def text_lines(df: DataFrame, path: str, column: str, order: str | None = None) -> None:
    """One column as lines; with an order, sorted by range into part files whose names sort alike."""
    rows = df.orderBy(order) if order else df
    rows.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).write.mode("overwrite").text(path)


def parallel_text(df: DataFrame, path: str, columns: list[str], order: str) -> None:
    """A folder for each column, part files in order; line i of each belongs to one row. The rows are
    staged once with the number of their part, by which every column is dealt, so all are cut at the
    same places, whatever has to be run again."""
    spark = df.sparkSession
    staged = f"{path}/_rows"
    df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()).write.mode("overwrite").parquet(staged)
    rows = spark.read.parquet(staged)
    parts = (rows.agg(F.max("__part")).first()[0] or 0) + 1
    dealt = rows.repartitionById(parts, "__part").sortWithinPartitions(order)
    for c in columns:
        dealt.select(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "\n", " ").alias("value")).write.mode("overwrite").text(f"{path}/{c}")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def by_field(df: DataFrame, path: str, keys: list[str], fields: list[str]) -> None:
    """Text files below key=value folders, one field each; null is an empty line."""
    long = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("value")) for f in fields))).alias("x"))
    long.select(*keys, "x.field", "x.value").write.mode("overwrite").partitionBy(*keys, "field").text(path)


def tee(df: DataFrame, path: str, condition) -> None:
    """Kept and removed rows, to two folders."""
    hit = F.coalesce(condition, F.lit(False))
    df.where(~hit).write.mode("overwrite").parquet(f"{path}/kept")
    df.where(hit).write.mode("overwrite").parquet(f"{path}/removed")


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def json_document(rows: DataFrame, path: str, order: list[str], name: str, metadata: dict[str, str]) -> int:
    """One nested JSON document, {"metadata": {...}, name: [row, ...]}, of rows in an order: text files
    that are the document one after another, in the order of their names, as many as the shuffle has
    parts, so no task holds more than its part. The number of rows."""
    spark = rows.sparkSession
    placed = sorted_places(rows, order, "__place")
    count = placed.count()
    one = F.to_json(F.struct(*(F.col(c) for c in rows.columns)), {"ignoreNullFields": "false"})
    body = placed.select(F.col("__place").cast("long").alias("p"), F.concat(one, F.when(F.col("__place") < count, ",").otherwise("")).alias("value"))
    head = f'{{"metadata": {json.dumps(metadata, ensure_ascii=False)}, {json.dumps(name, ensure_ascii=False)}: ['
    ends = spark.createDataFrame([(0, head), (count + 1, "]}")], "p long, value string")
    body.unionByName(ends).repartitionByRange("p").sortWithinPartitions("p").select("value").write.mode("overwrite").text(path)
    return count


def replaced(df: DataFrame, path: str) -> None:
    """A folder's table in place of the old one, which stays as a backup."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old, backup = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", path, f"{path}.bak"))
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs = old.getFileSystem(conf)
    fs.delete(backup, True)
    if fs.exists(old):
        fs.rename(old, backup)
    fs.rename(new, old)


def by_verdict(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("verdict").parquet(path)


def verdict_files(rows: DataFrame, path: str) -> None:
    """Lines ``source -> target`` of right pairs, of corrected ones (with the correction), and of
    both together, sorted by source."""
    line = lambda t: F.concat("source", F.lit(" -> "), t)
    right = rows.where("verdict = 'CORRECT'").select("source", line(F.col("target")).alias("line"))
    fixed = rows.where("verdict = 'INCORRECT' and correction <> ''").select("source", line(F.col("correction")).alias("line"))
    for name, part in (("correct", right), ("corrected", fixed), ("clean", right.union(fixed))):
        text_lines(part, f"{path}/{name}", "line", "source")


def keyed_csv(df: DataFrame, path: str, key: str) -> None:
    """A CSV table whose first column is the key."""
    csv(df.select(key, *(c for c in df.columns if c != key)), path)


def dictionary_export(top: DataFrame, statistics: DataFrame, path: str) -> None:
    """A dictionary (src, tgt, cnt, rank, confidence, is_primary) as JSON entries, as lines of best
    translations, as a table of all, and its statistics as (name, value) lines."""
    entry = F.sort_array(F.collect_list(F.struct("rank", "tgt", "cnt", "confidence")))
    json_lines(top.groupBy("src").agg(entry.alias("translations")), f"{path}/entries")
    text_lines(top.where("is_primary").select("src", F.concat("src", F.lit(" → "), "tgt").alias("line")), f"{path}/simple", "line", "src")
    csv(top.select("src", "tgt", "cnt", "is_primary", "confidence"), f"{path}/detailed")
    names = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in statistics.columns))
    text_lines(statistics.select(F.explode(names).alias("s")).select(F.concat_ws(": ", "s.name", "s.value").alias("line")), f"{path}/statistics", "line")


def sentence_scores(df: DataFrame, path: str, number: str, metrics: list[str]) -> None:
    """A CSV table of sentences, counted from 1, and their scores."""
    csv(df.orderBy(number).select((F.col(number) + 1).alias("Sentence ID"), *metrics), path)


def metric_table(df: DataFrame, path: str) -> None:
    """(metric, score, low, high) as a CSV table; what is missing is N/A."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    csv(df.select(F.col("metric").alias("Metric"), cell("score").alias("Score"), cell("low").alias("Lower Bound"), cell("high").alias("Upper Bound")), path)


def predictions_by_language(df: DataFrame, path: str, generated: str = "generated", language: str = "language") -> None:
    """Generated texts, trimmed and the empty one for none, below a folder for each language."""
    df.select(F.col(language).alias("language"), F.trim(F.coalesce(F.col(generated), F.lit(""))).alias("value")).write.mode("overwrite").partitionBy("language").text(path)


def appended(df: DataFrame, path: str, batch: str) -> None:
    """A batch of partial results; a repeated batch takes the place of its first try."""
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
