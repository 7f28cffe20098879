"""Corpus-level evaluation: BLEU, bins, bootstrap, wide results, comparisons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.metrics import bleu_effective, bleu_exponential, bleu_international, bleu_method1, bleu_stats, combined_bleu, let, precisions, sentence_bleu, summed, thirteen_a
from lexloom.operators.ranking import sorted_places
from lexloom.operators.staging import written


def corpus_bleu(pairs: DataFrame, hyp: str, ref: str, keys: list[str] | None = None, how=bleu_method1) -> DataFrame:
    """BLEU of all rows, or of each group: sums of row statistics, combined once."""
    rows = pairs.select(*(keys or []), bleu_stats(F.col(hyp), F.col(ref)).alias("s"))
    out = rows.groupBy(*keys).agg(*summed("s"), F.count("*").alias("pairs")) if keys else rows.agg(*summed("s"), F.count("*").alias("pairs"))
    return out.select(*(keys or []), "pairs", "hyp", "ref", combined_bleu(how).alias("bleu"))


def bleu_by_length(pairs: DataFrame, hyp: str, ref: str, width: int = 10) -> DataFrame:
    """BLEU by bins of the reference's length; bins of one row are left out."""
    binned = pairs.withColumn("bin", F.floor(F.size(ref) / width) * width)
    return corpus_bleu(binned, hyp, ref, ["bin"], bleu_exponential).where("pairs > 1")


def international_bleu(pairs: DataFrame, hyp: str, ref: str) -> DataFrame:
    """Corpus BLEU of texts by the usual rules of international scoring: pairs, lengths, brevity
    penalty, the precisions of each order in percent, and the score."""
    words = pairs.select(thirteen_a(F.col(hyp)).alias("h"), thirteen_a(F.col(ref)).alias("r"))
    rows = words.select(bleu_stats(F.col("h"), F.col("r"), least=0).alias("s"))
    return rows.agg(*summed("s"), F.count("*").alias("pairs")).select("pairs", "hyp", "ref", *precisions(), combined_bleu(bleu_international).alias("bleu"))


def international_sentence_bleu(hyp: Column, ref: Column) -> Column:
    """The same for one sentence, over the orders that it is long enough for."""
    words = F.struct(thirteen_a(hyp).alias("h"), thirteen_a(ref).alias("r"))
    return let(let(words, lambda z: bleu_stats(z["h"], z["r"], least=0)), lambda s: sentence_bleu(s, bleu_effective))


def bleu_sums(hyp: str, ref: str, orders: int = 4) -> tuple[dict[str, Column], Column]:
    """What ``bootstrap`` needs for BLEU: sums of a row, and the score of their totals."""
    s = bleu_stats(F.col(hyp), F.col(ref), orders)
    own = {f"{f}{n}": s[f][n - 1] for f in "mt" for n in range(1, orders + 1)} | {"hyp": s["hyp"], "ref": s["ref"]}
    return own, combined_bleu(bleu_exponential, orders)


#: Rows of a block: replicates are dealt to blocks first, and then inside each. It is part of what is drawn.
BLOCK = 4096
#: Draws that a task makes at once.
DRAWS = 1 << 20
#: The increment and multipliers of SplitMix64.
GAMMA, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(z: np.ndarray) -> np.ndarray:
    """SplitMix64's output for these states."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
        return z ^ (z >> np.uint64(31))


def draws(seed: int, stage: int, b: np.ndarray, block: int, j: np.ndarray) -> np.ndarray:
    """Uniform numbers from 0 to 1, the j-th of replicate b, of a stage and block."""
    start = mixed(mixed(mixed(np.array([seed + stage], np.uint64)) ^ b.astype(np.uint64)) ^ np.uint64(block))
    with np.errstate(over="ignore"):
        state = start + (j.astype(np.uint64) + np.uint64(1)) * np.uint64(GAMMA)
    return (mixed(state) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def bootstrap(rows: DataFrame, order: list[str], metric: tuple[dict[str, Column], Column], replicates: int = 1000, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(b, score): any metric that is a function of sums over rows, of each replicate of exactly as many
    draws with replacement as there are rows. metric: the sums by name, and the score as a column of
    these names; order: columns that tell rows apart.

    A replicate is drawn by splitting: first how many of its draws fall into each block of rows, then,
    inside the block, which rows they are. The first needs no rows, only their number; the second has a
    block's rows and the counts of its replicates in one place, and multiplies the replicates' row counts
    by the rows' sums. So no row is copied for a replicate, and what is shuffled is the rows once,
    a count for each block and replicate, and a row of sums for each replicate and task."""
    spark = rows.sparkSession
    sums, score = metric
    names = list(sums)
    slim = rows.select(*(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()))
    slim = written(slim, "sums")  # cutting ranges reads it twice
    n = slim.count()
    placed = sorted_places(slim, [f"__o{i}" for i in range(len(order))], "__at").withColumn("__block", F.floor((F.col("__at") - 1) / block).cast("long"))
    stats = placed.select("__block", ((F.col("__at") - 1) % block).alias("__pos"), *names)
    chunks = -(-n // DRAWS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                b, c = divmod(i, chunks)
                j = np.arange(c * DRAWS, min(n, (c + 1) * DRAWS))
                blocks, counts = np.unique(np.floor(draws(seed, 1, np.array([b]), 0, j) * n).astype(np.int64) // block, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), b)), pa.array(blocks), pa.array(counts.astype(np.int64))], names=["b", "__block", "k"])

    each = spark.range(replicates * chunks).mapInArrow(dealt, "b long, __block long, k long")
    counts = each.groupBy("b", "__block").agg(F.sum("k").alias("k"))

    def drawn(own: pa.Table, wanted: pa.Table) -> pa.Table:
        where, b, k = own.column("__block")[0].as_py(), np.asarray(wanted.column("b")), np.asarray(wanted.column("k"))
        x = np.stack([np.asarray(own.column(c)) for c in names], 1)[np.argsort(np.asarray(own.column("__pos")))]
        size = len(x)
        step = max(1, DRAWS // max(size, int(k.max(initial=1))))
        out = [np.zeros((0, len(names)))]
        for at in range(0, len(b), step):
            some = k[at : at + step]
            which = np.repeat(np.arange(len(some)), some)
            j = np.arange(len(which)) - np.repeat(np.cumsum(some) - some, some)
            rows = np.floor(draws(seed, 2, b[at : at + step][which], where, j) * size).astype(np.int64)
            out.append(np.bincount(which * size + rows, minlength=len(some) * size).reshape(len(some), size) @ x)
        made = np.concatenate(out)
        return pa.table([pa.array(b), pa.array(k), *(pa.array(made[:, i]) for i in range(len(names)))], names=["b", "__n", *names])

    schema = ", ".join(["b long, __n long", *(f"`{c}` double" for c in names)])
    met = stats.groupBy("__block").cogroup(counts.groupBy("__block")).applyInArrow(drawn, schema)
    return met.groupBy("b").agg(F.sum("__n").alias("draws"), *(F.sum(c).alias(c) for c in names)).select("b", "draws", score.alias("score"))


def interval(scores: DataFrame, replicates: int) -> DataFrame:
    """Mean and the 2.5 and 97.5 percent places of sorted replicate scores (a bounded number)."""
    s = F.array_sort(F.collect_list("score"))
    return scores.agg(F.avg("score").alias("mean"), F.get(s, F.lit(int(replicates * 0.025))).alias("low"), F.get(s, F.lit(int(replicates * 0.975))).alias("high"))


def wide(results: DataFrame, index: list[str], setting: str, value: str, settings: list[str]) -> DataFrame:
    """A column for each setting, empty where it has no result."""
    return results.groupBy(*index).pivot(setting, settings).agg(F.min(value)).select(*index, *(F.coalesce(F.col(s), F.lit("")).alias(s) for s in settings))


def compared(now: DataFrame, before: DataFrame) -> DataFrame:
    """Metrics of two runs and their change."""
    return now.join(before.select("metric", F.col("value").alias("previous")), "metric").withColumn("change", F.col("value") - F.col("previous"))


def macro_averages(rows: DataFrame, names: list[str]) -> DataFrame:
    """Each score's mean over the rows, in percent."""
    return rows.agg(*(F.coalesce(100 * F.avg(n), F.lit(0.0)).alias(n) for n in names))


def means(rows: DataFrame, names: list[str]) -> DataFrame:
    """Each metric's mean over the rows that have it, and how many do."""
    return rows.agg(*(F.avg(n).alias(n) for n in names), *(F.count(n).alias(f"n_{n}") for n in names))


def attached(rows: DataFrame, scores: DataFrame, position: str = "idx") -> DataFrame:
    """Rows with the scores that an outside model gave for their positions."""
    return rows.join(scores, position, "left")


def feature_similarity(values: DataFrame, pairs: DataFrame, least: int = 1) -> DataFrame:
    """For pairs (a, b) of entities of values (entity, parameter, value): shared parameters, all
    parameters of either, equal values, and matches over all; null under ``least`` shared."""
    sizes = values.groupBy("entity").agg(F.count_distinct("parameter").alias("n"))
    left = values.select(F.col("entity").alias("a"), "parameter", F.col("value").alias("va"))
    right = values.select(F.col("entity").alias("b"), "parameter", F.col("value").alias("vb"))
    met = pairs.join(left, "a").join(right, ["b", "parameter"]).groupBy("a", "b").agg(F.count("*").alias("shared"), F.count_if(F.col("va") == F.col("vb")).alias("matches"))
    out = pairs.join(met, ["a", "b"], "left").join(sizes.select(F.col("entity").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("entity").alias("b"), F.col("n").alias("nb")), "b")
    shared, matches = F.coalesce("shared", F.lit(0)), F.coalesce("matches", F.lit(0))
    total = F.col("na") + F.col("nb") - shared
    return out.select("a", "b", shared.alias("shared"), total.alias("total"), matches.alias("matches"), F.when(shared >= least, F.try_divide(matches, total)).alias("similarity"))
