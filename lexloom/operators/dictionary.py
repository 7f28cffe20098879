"""Bilingual dictionary induction from aligned words, and its application to texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import case_like, clean_word, is_number, split_base, tokens, turkish_lower
from lexloom.operators.sizes import broadcast_if_small, rows_if_small

#: English function words, by kind.
ENGLISH_FUNCTION_WORDS = tuple(dict.fromkeys("""
a an the
in on at to for with by from of about around between among through throughout during until till since before after above below over under behind beside beneath across along into onto within without
and but or nor so yet because although since unless while where if that than
is am are was were be been being have has had do does did will would shall should can could may might must
i me my mine myself you your yours yourself he him his himself she her hers herself it its itself we us our ours ourselves they them their theirs themselves
this that these those who whom whose which what
as not no yes all any each every some many much more most few little other another such only very too just even still rather quite somewhat
""".split()))


#: Bytes of tokens whose words a task replaces at once.
PART_BYTES = 4 << 20


def pharaoh_pairs(alignment: Column) -> Column:
    """array<struct<i, j>> of ``i-j`` items; malformed ones are left out."""
    made = F.transform(tokens(alignment), lambda a: F.struct(F.get(F.split(a, "-"), F.lit(0)).try_cast("int").alias("i"), F.get(F.split(a, "-"), F.lit(1)).try_cast("int").alias("j"), F.size(F.split(a, "-")).alias("n")))
    sound = F.filter(made, lambda x: (x["n"] == 2) & x["i"].isNotNull() & x["j"].isNotNull())
    return F.transform(sound, lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j")))


def monotone(src: Column, tgt: Column) -> Column:
    """The alignment of equal positions, as text."""
    n = F.least(F.size(src), F.size(tgt))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat_ws("-", i.cast("string"), i.cast("string"))), " ")).otherwise("")


def aligned_words(df: DataFrame, line: list[str], src: str, tgt: str, alignment: str) -> DataFrame:
    """A row for each aligned pair of words: line columns, pos, src, tgt. Pairs out of bounds go."""
    pairs = df.select(*line, F.col(src).alias("__s"), F.col(tgt).alias("__t"), F.posexplode(pharaoh_pairs(F.col(alignment))).alias("pos", "__p"))
    inside = (F.col("__p.i") < F.size("__s")) & (F.col("__p.j") < F.size("__t"))
    return pairs.where(inside).select(*line, "pos", F.get("__s", F.col("__p.i")).alias("src"), F.get("__t", F.col("__p.j")).alias("tgt"))


def count_pairs(words: DataFrame, order: list[str]) -> DataFrame:
    """Per (src, tgt): cnt and first_pos, the place where it was seen first."""
    return words.groupBy("src", "tgt").agg(F.count("*").alias("cnt"), F.min(F.struct(*order)).alias("first_pos"))


def best_translation(pairs: DataFrame) -> DataFrame:
    """Per src: the most frequent tgt, the first seen of equals, as a partial aggregate; and
    first_pos, where src was first seen."""
    best = F.min(F.struct((-F.col("cnt")).alias("n"), "first_pos", "tgt"))
    return pairs.groupBy("src").agg(best.alias("b"), F.min("first_pos").alias("first_pos")).select("src", F.col("b.tgt").alias("tgt"), (-F.col("b.n")).alias("cnt"), "first_pos")


def case_folded(dictionary: DataFrame) -> DataFrame:
    """Per lower-cased src: the entry of the spelling that came into the dictionary last, by where
    each was seen first."""
    return dictionary.groupBy(turkish_lower(F.col("src")).alias("low")).agg(F.max_by("tgt", F.struct("first_pos", "src")).alias("folded"))


def top_translations(pairs: DataFrame, most: int = 3, least: int = 1) -> DataFrame:
    """Per src: up to ``most`` translations with ``least`` counts, their rank, share of all of the
    word's counts, and whether they are primary."""
    kept = pairs.where(F.col("cnt") >= least)
    totals = kept.groupBy("src").agg(F.sum("cnt").alias("__of"))
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(F.desc("cnt"), "first_pos", "tgt"))).where(F.col("rank") <= most)
    return ranked.join(totals, "src").select("src", "tgt", "cnt", "rank", (F.col("cnt") / F.col("__of")).alias("confidence"), (F.col("rank") == 1).alias("is_primary"))


def without_function_words(pairs: DataFrame, words: tuple[str, ...] = ENGLISH_FUNCTION_WORDS, least: int = 2) -> DataFrame:
    """Pairs whose words, cleaned, are no function words and have some length."""
    keep = F.lit(True)
    for c in ("src", "tgt"):
        keep = keep & ~clean_word(F.col(c)).isin(*words) & (F.length(clean_word(F.col(c))) >= least)
    return pairs.where(keep)


def canonical_case(words: DataFrame, order: list[str]) -> DataFrame:
    """Per case-folded src: the surface form seen first, the forms, and occurrences."""
    first = F.min(F.struct(*order, "src"))
    return words.groupBy(F.lower("src").alias("folded")).agg(first["src"].alias("canonical"), F.count_distinct("src").alias("forms"), F.count("*").alias("cnt"))


def frequency_of_frequencies(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("cnt").agg(F.count("*").alias("pairs"))


def quality(pairs: DataFrame) -> DataFrame:
    """Words, those with several translations, and the mean and largest number of translations."""
    words = pairs.groupBy("src").agg(F.count("*").alias("n"))
    return words.agg(F.count("*").alias("words"), F.count_if(F.col("n") > 1).alias("ambiguous"), F.avg("n").alias("mean_translations"), F.max("n").alias("most"))


def rendered(top: DataFrame) -> DataFrame:
    """Lines ``src -> t1 (n), t2 (n)``."""
    item = F.struct("rank", F.concat(F.col("tgt"), F.lit(" ("), F.col("cnt").cast("string"), F.lit(")")).alias("s"))
    return top.groupBy("src").agg(F.sort_array(F.collect_list(item)).alias("ts")).select(F.concat(F.col("src"), F.lit(" -> "), F.array_join(F.transform("ts", lambda t: t["s"]), ", ")).alias("line"))


def _outcome(base: Column, tail: Column, exact: Column, folded: Column) -> Column:
    """struct<out, how> of a token by what the dictionary has for its base, as it is and case-folded."""
    number = is_number(base)
    how = F.when(number, "number").when(exact.isNotNull(), "exact").when(folded.isNotNull(), "folded").otherwise("kept")
    out = F.when(number, base).otherwise(F.coalesce(exact, case_like(base, folded), base))
    return F.struct(F.concat(out, tail).alias("out"), how.alias("how"))


def translated_tokens(texts: DataFrame, dictionary: DataFrame, line: str, text: Column) -> DataFrame:
    """A row for each token: line, pos, word, out, how: number, exact, folded or kept.

    The base before the first hyphen is looked up as it is, then case-folded with its case pattern
    carried over. The dictionary (src, tgt, first_pos) has one row for each src. While it is small it
    is broadcast and tokens are not shuffled; beyond, distinct bases are looked up, not tokens."""
    words = texts.select(F.col(line), F.posexplode(tokens(text)).alias("pos", "word"))
    return _translated(words, dictionary).select(line, "pos", "word", "out", "how")


def _translated(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    base, tail = split_base(F.col("word"))
    words = words.withColumn("base", base).withColumn("tail", tail)
    dictionary, small = broadcast_if_small(dictionary.select("src", "tgt", "first_pos"))
    exact = dictionary.select(F.col("src").alias("base"), F.col("tgt").alias("exact"))
    folded = case_folded(dictionary)
    if small:
        met = words.join(F.broadcast(exact), "base", "left").withColumn("low", turkish_lower(F.col("base"))).join(F.broadcast(folded), "low", "left")
    else:
        vocabulary = words.select("base").distinct().withColumn("low", turkish_lower(F.col("base")))
        met = words.join(vocabulary.join(exact, "base", "left").join(folded, "low", "left").drop("low"), "base", "left")
    found = _outcome(F.col("base"), F.col("tail"), F.col("exact"), F.col("folded"))
    return met.withColumn("__o", found).select("*", "__o.*").drop("__o", "base", "tail", "exact", "low", "folded")


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in parts of about ``PART_BYTES`` of tokens, so that what is made of a part stays
    small however many and long the rows of a batch are."""
    lists = batch.column(column)
    ends = np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))
    upto = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(lists.flatten()), np.int64) + 1)])[ends]
    at = 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + PART_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _replaced(batch: pa.RecordBatch, known: pa.Array, outs: pa.Array) -> pa.RecordBatch:
    """(line, n_tokens, n_replaced, text) of rows (line, w), by words and what they become."""
    w = batch.column("w")
    flat, sizes = w.flatten(), pc.list_value_length(w)
    at = pc.index_in(flat, value_set=known)
    hit = at.is_valid()
    ends = np.cumsum(np.asarray(sizes, np.int64))
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, pc.if_else(hit, pc.take(outs, at), flat)), " ")
    upto = np.concatenate([[0], np.cumsum(np.asarray(hit, np.int64))])
    return pa.RecordBatch.from_arrays([batch.column("line"), sizes.cast(pa.int64()), pa.array(np.diff(upto[np.concatenate([[0], ends])])), joined], names=["line", "n_tokens", "n_replaced", "text"])


def applied(texts: DataFrame, dictionary: DataFrame, line: str, text: Column) -> DataFrame:
    """Texts translated token by token: line, n_tokens, n_replaced, text; those without tokens go. What
    becomes of a token depends on its word alone, so distinct words are looked up first. While those
    that are replaced are few enough to broadcast, texts never leave their rows: a task replaces the
    words of a part of a batch of token lists at once. Beyond that, tokens are joined and meet again by line."""
    words = texts.select(F.explode(tokens(text)).alias("word")).distinct()
    found = rows_if_small(_translated(words, dictionary).where("how <> 'kept'").select("word", "out"))
    if found is None:
        return rejoined(translated_tokens(texts, dictionary, line, text), line).select(line, "n_tokens", "n_replaced", "text")
    lists = texts.select(F.col(line).alias("line"), tokens(text).alias("w")).where(F.size("w") > 0)
    shared = texts.sparkSession.sparkContext.broadcast((found.column("word").combine_chunks(), found.column("out").combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, outs = shared.value
        for batch in batches:
            for part in _parts(batch, "w"):
                yield _replaced(part, known, outs)
            del batch
            pa.default_memory_pool().release_unused()

    schema = T.StructType([lists.schema["line"], T.StructField("n_tokens", T.LongType()), T.StructField("n_replaced", T.LongType()), T.StructField("text", T.StringType())])
    return lists.mapInArrow(run, schema).withColumnRenamed("line", line)


def coverage_of_texts(texts: DataFrame, dictionary: DataFrame, text: Column, dictionary_size: Column | int | None = None) -> DataFrame:
    """``coverage`` of texts. What becomes of a token depends on its word alone, so words are counted
    first, and each distinct one is looked up once."""
    words = texts.select(F.explode(tokens(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return _covered(_translated(words, dictionary), dictionary_size)


def rejoined(translated: DataFrame, line: str) -> DataFrame:
    """Texts again, with how many tokens were replaced. A text's tokens meet in one row."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "out"))), lambda t: t["out"]), " ")
    return translated.groupBy(line).agg(F.count("*").alias("n_tokens"), F.count_if(F.col("how") != "kept").alias("n_replaced"), joined.alias("text"))


def coverage(translated: DataFrame, dictionary_size: Column | int | None = None) -> DataFrame:
    """Totals, rates and distinct words, replaced or not; numbers count as replaced. With the
    dictionary's size also which share of its entries was used, in percent. Words are counted
    first, so that no token is copied for a distinct count."""
    return _covered(translated.groupBy("word", "how").agg(F.count("*").alias("n")), dictionary_size)


def _covered(words: DataFrame, dictionary_size: Column | int | None) -> DataFrame:
    kept = F.col("how") == "kept"
    out = words.agg(
        F.sum("n").alias("total_words"), F.sum(F.when(~kept, F.col("n")).otherwise(0)).alias("replaced"), F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("not_replaced"),
        F.count_if(kept).alias("unique_not_replaced"), F.count_if(~kept).alias("unique_replaced"), F.count_if(F.col("how") == "exact").alias("used_exact"),
    ).withColumn("replacement_rate", F.coalesce(F.try_divide("replaced", "total_words"), F.lit(0.0)))
    return out if dictionary_size is None else out.withColumn("usage_rate", F.coalesce(F.try_divide(100.0 * F.col("used_exact"), F.lit(dictionary_size) if isinstance(dictionary_size, int) else dictionary_size), F.lit(0.0)))


def replacements(translated: DataFrame, line: str) -> tuple[DataFrame, DataFrame]:
    """(replaced words with their last value, words that were not replaced, in order)."""
    replaced = translated.where("how in ('exact', 'folded')").groupBy("word").agg(F.max_by("out", F.struct(line, "pos")).alias("out"))
    return replaced, translated.where("how = 'kept'").select("word").distinct().orderBy("word")


def removed_tokens(texts: DataFrame, text: Column, words: tuple[str, ...] = ENGLISH_FUNCTION_WORDS, least: int = 2) -> DataFrame:
    """Per lower-cased token: occurrences, and whether a filter by function words and length drops
    it. What stands before the first bar is a line's number and is no token."""
    body = F.when(F.contains(text, F.lit("|")), F.substr(text, F.locate("|", text) + 1)).otherwise(text)
    found = texts.select(F.explode(tokens(F.lower(body))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))
    return found.withColumn("removed", clean_word(F.col("word")).isin(*words) | (F.length(clean_word(F.col("word"))) < least))


def filtering_totals(removed: DataFrame) -> DataFrame:
    """Of ``removed_tokens``: words before and after, removed ones and their percentage."""
    out = removed.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("before"), F.coalesce(F.sum(F.when(~F.col("removed"), F.col("cnt"))), F.lit(0)).alias("after"))
    return out.select("before", "after", (F.col("before") - F.col("after")).alias("removed"), F.coalesce(F.try_divide(100.0 * (F.col("before") - F.col("after")), F.col("before")), F.lit(0.0)).alias("percentage"))


def alignment_counters(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """What a filter of pairs did: alignments and words before, and what is left."""
    one = lambda df, tag: df.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias(f"alignments_{tag}"), F.count_distinct("src").alias(f"words_{tag}"))
    out = one(pairs, "before").join(one(kept, "after"))
    return out.withColumn("filtered", F.col("alignments_before") - F.col("alignments_after"))


def filtered_line(text: Column, words: tuple[str, ...], least: int = 2, keep_function_words: bool = False) -> Column:
    """A line without function words and short tokens; an ``N|`` prefix stays."""
    prefix = F.regexp_extract(text, r"^(\d+\|)", 1)
    body = F.substr(text, F.length(prefix) + 1)
    drop = lambda t: (F.length(clean_word(t)) < least) | (clean_word(t).isin(*words) & F.lit(not keep_function_words))
    return F.concat(prefix, F.array_join(F.filter(tokens(body), lambda t: ~drop(t)), " "))
