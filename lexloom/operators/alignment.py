"""Word-alignment training examples from parallel lines and a dictionary, and chat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.parse import masked_labels


def dictionary_alignments(words: DataFrame, dictionary: DataFrame, line: list[str]) -> DataFrame:
    """For (line, src array, tgt array): pairs of a source word and its dictionary target, where the
    target is in the sentence; (line, pos, source, target), the first entry of each word."""
    tokens = words.select(*line, F.col("tgt"), F.posexplode("src").alias("pos", "source"))
    met = tokens.join(dictionary.select(F.lower("src").alias("source"), F.col("tgt").alias("target")), "source")
    return met.where(F.array_contains(F.transform("tgt", lambda t: F.lower(t)), F.lower("target"))).select(*line, "pos", "source", "target")


def positional_lemmas(surface: Column, lemmas: Column, fallback) -> Column:
    """A lemma for each token: where the lists are equally long that of the token's last place, else
    the lemma at its place, or by a rule beyond the end."""
    last = lambda t: F.get(lemmas, F.size(surface) - F.array_position(F.reverse(surface), t).cast("int"))
    at = lambda t, i: F.when(i < F.size(lemmas), F.get(lemmas, i)).otherwise(fallback(t))
    return F.when(F.size(surface) == F.size(lemmas), F.transform(surface, last)).otherwise(F.transform(surface, at))


def examples(alignments: DataFrame, line: list[str], least: int = 2) -> DataFrame:
    """Alignments of each line in order; lines with fewer than ``least`` are left out."""
    pair = F.struct("pos", "source", "target")
    grouped = alignments.groupBy(*line).agg(F.sort_array(F.collect_list(pair)).alias("a"))
    pairs = F.transform("a", lambda x: F.array(x["source"], x["target"]))
    return grouped.select(*line, pairs.alias("alignments"), F.size("a").cast("long").alias("num_alignments")).where(F.col("num_alignments") >= least)


def example_statistics(made: DataFrame) -> DataFrame:
    return made.agg(F.count("*").alias("examples"), F.avg("num_alignments").alias("average"), F.min("num_alignments").alias("least"), F.max("num_alignments").alias("most"))


def chat(user: Column, assistant: Column) -> Column:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("user", user), turn("assistant", assistant))


def label_statistics(rows: DataFrame, ids: Column, prompt_length: Column, size: int) -> DataFrame:
    """Label places, those that count, and the masked share."""
    labels = rows.select(masked_labels(ids, prompt_length, size).alias("l"))
    out = labels.agg(F.sum(F.size("l")).cast("long").alias("total"), F.sum(F.size(F.filter("l", lambda x: x != -100))).cast("long").alias("live"))
    return out.withColumn("masked_share", F.coalesce(F.try_divide((F.col("total") - F.col("live")).cast("double"), F.col("total")), F.lit(0.0)))


def batches(rows: DataFrame, number: str, size: int) -> DataFrame:
    """Batch numbers and pair numbers of rows counted from 0."""
    return rows.withColumn("batch", F.floor(F.col(number) / size)).withColumn("pair_id", F.col("batch") * size + F.col(number) % size + 1)


def inference_statistics(rows: DataFrame) -> DataFrame:
    """Of answers (error, num_alignments): pairs, failures, success rate in percent, alignments and
    their average for each answer that came."""
    good = F.col("error").isNull()
    out = rows.agg(F.count("*").alias("pairs"), F.count_if(~good).alias("failed"), F.coalesce(F.sum(F.when(good, F.col("num_alignments"))), F.lit(0)).alias("alignments"))
    made = F.col("pairs") - F.col("failed")
    return out.withColumn("success_rate", F.coalesce(F.try_divide(100.0 * made, F.col("pairs")), F.lit(0.0))).withColumn("average", F.coalesce(F.try_divide(F.col("alignments").cast("double"), made), F.lit(0.0)))


def error_histogram(rows: DataFrame) -> DataFrame:
    return rows.where("error is not null").groupBy("error").agg(F.count("*").alias("cnt"))


def artefact(prompt: Column, output: Column, alignments: Column) -> Column:
    """An answer's prompt, output and alignments as one JSON document."""
    return F.to_json(F.struct(prompt.alias("prompt"), output.alias("output"), alignments.alias("alignments")))
