"""Abbreviations learnt from texts, sentences that heed them, and words by what their spellings share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import phonology
from lexloom.operators.staging import written

#: A word is an abbreviation if of its occurrences before a dot so many hundredths at least are not
#: followed by a capital; and if a share of all dots at least stands after it, one in ``SHARE``, so
#: there are ``SHARE`` abbreviations at most, however large the texts are.
HUNDREDTHS, SHARE = 80, 2000


def dotted_words(texts: DataFrame, tokens: str) -> DataFrame:
    """(word, dots, open): for each lower-cased word before a dot how often there is something after the
    dot, and how often that does not begin with a capital. Sums of a row's words, so what is shuffled
    is a row for each word and task."""
    at = lambda i: F.get(F.col(tokens), i)
    places = F.filter(F.transform(tokens, lambda x, i: F.when((x == ".") & (i > 0) & (i + 1 < F.size(tokens)), i)), lambda i: i.isNotNull())
    pairs = F.transform(places, lambda i: F.struct(F.lower(at(i - 1)).alias("word"), at(i + 1).alias("next")))
    found = texts.select(F.explode(pairs).alias("p")).where(F.col("p.word").rlike(r"^\p{L}+$"))
    return found.groupBy("p.word").agg(F.count("*").alias("dots"), F.count_if(~F.col("p.next").rlike(r"^\p{Lu}")).alias("open"))


def abbreviations(texts: DataFrame, tokens: str, hundredths: int = HUNDREDTHS, share: int = SHARE) -> DataFrame:
    """(word, dots, open) of the words that are abbreviations by these texts."""
    counts = written(dotted_words(texts, tokens), "dots")
    total = counts.agg(F.sum("dots")).first()[0] or 0
    return counts.where((F.col("dots") * share >= total) & (F.col("open") * 100 >= hundredths * F.col("dots")))


def with_sentences(texts: DataFrame, tokens: str, known: DataFrame | None = None) -> DataFrame:
    """Texts with a column ``starts``: the places of the tokens that begin a sentence. known: the
    table of abbreviations (word), of ``SHARE`` rows at most, which goes along as one list."""
    if known is None:
        return texts.withColumn("starts", phonology.sentence_starts(F.col(tokens)))
    words = sorted(r[0] for r in known.select("word").collect())
    return texts.withColumn("starts", phonology.sentence_starts(F.col(tokens), F.array(*map(F.lit, words)).cast("array<string>")))


def spelling_groups(words: DataFrame) -> DataFrame:
    """(word, key, spellings, best) of words with how often each occurs (word, cnt): the key that all
    spellings of a word share, how many there are, and the most frequent one, of equals the first.
    A key's spellings are variants of a few letters, and meet as partial sums."""
    keyed = words.withColumn("key", phonology.variant_key(F.col("word")))
    groups = keyed.groupBy("key").agg(F.count("*").alias("spellings"), F.min(F.struct((-F.col("cnt")).alias("n"), "word"))["word"].alias("best"))
    return keyed.join(groups, "key").select("word", "key", "spellings", "best")
