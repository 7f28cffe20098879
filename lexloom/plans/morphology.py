"""Queries of words: segmentations by continuation classes, guesses for unknown words,
streamed runs, sentences and spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import phonology, text
from lexloom.operators import segmentation, sentences
from lexloom.operators.staging import new_folder, written
from lexloom.plans.catalogue import SQL, query, table
from lexloom.session import ship_package
from lexloom.streaming import runs

#: Endings that four of a thousand words have.
PER_MILLE = 4
_WORDS = "(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM {})"


def words_of(spark, sf_dir, name: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.explode(text.word_tokens(F.col("text"))).alias("word")).distinct()


_LEARNT = f"""w AS MATERIALIZED {_WORDS.format('documents')}, stems AS MATERIALIZED (SELECT word AS stem FROM w WHERE length(word) BETWEEN 3 AND 24),
cut AS (SELECT word, left(word, k) AS stem, substr(word, k + 1) AS ending FROM (SELECT word, unnest(range(3, least(length(word) - 1, 24) + 1)) AS k FROM w)),
split AS MATERIALIZED (SELECT cut.* FROM cut JOIN stems USING (stem)),
first AS MATERIALIZED (SELECT ending FROM split GROUP BY ending HAVING 1000 * count(*) >= {PER_MILLE} * (SELECT count(*) FROM w)),
second AS MATERIALIZED (SELECT a.ending AS before, b.ending FROM split a JOIN split b ON b.stem = a.word WHERE a.ending IN (SELECT ending FROM first) GROUP BY ALL HAVING 1000 * count(*) >= {PER_MILLE} * (SELECT count(*) FROM w)),
edges AS MATERIALIZED (SELECT 'Root' AS class, ending AS affix, '1:' || ending AS next FROM first UNION ALL SELECT '1:' || before, ending, '2' FROM second),
sizes AS (SELECT DISTINCT length(affix) AS k FROM edges)"""


@query(f"""
WITH RECURSIVE {_LEARNT}, seg(word, pos, class, path) AS (
  SELECT word, k, 'Root', left(word, k) FROM (SELECT word, unnest(range(3, least(length(word), 24) + 1)) AS k FROM w) JOIN stems ON stem = left(word, k)
  UNION ALL
  SELECT s.word, s.pos + s.k, e.next, s.path || '-' || e.affix FROM (SELECT seg.*, k, substr(word, pos + 1, k) AS piece FROM seg JOIN sizes ON pos + k <= length(word)) s JOIN edges e ON e.class = s.class AND e.affix = s.piece
) SELECT DISTINCT word, path AS segmentation FROM seg WHERE pos = length(word)
""")
def segmentations(spark, sf_dir):
    words = written(words_of(spark, sf_dir, "documents"), "words")
    stems, edges = segmentation.learnt(words, PER_MILLE)
    return segmentation.segmentations(words, stems, edges)


@query(f"""
WITH w AS MATERIALIZED {_WORDS.format('documents')}, u AS (SELECT word FROM {_WORDS.format('benchmark')} WHERE word NOT IN (SELECT word FROM w)),
x AS MATERIALIZED (SELECT ending, count(*) AS stems FROM (SELECT left(word, k) AS stem, substr(word, k + 1) AS ending FROM (SELECT word, unnest(range(2, least(length(word) - 1, 10) + 1)) AS k FROM w)) WHERE stem IN (SELECT word FROM w) GROUP BY ending HAVING count(*) >= 2),
g AS (SELECT word, left(word, k) AS stem, ending, stems FROM (SELECT word, unnest(range(2, least(length(word) - 1, 10) + 1)) AS k FROM u) JOIN x ON ending = substr(word, k + 1))
SELECT word, stem, ending, stems, CAST(row_number() OVER (PARTITION BY word ORDER BY stems DESC, length(ending) DESC) AS INTEGER) AS rank, length(ending) = max(length(ending)) OVER (PARTITION BY word) AS longest FROM g
""")
def guessed_words(spark, sf_dir):
    known = written(words_of(spark, sf_dir, "documents"), "words")
    unknown = words_of(spark, sf_dir, "benchmark").join(known, "word", "left_anti")
    return segmentation.guesses(unknown, segmentation.ending_index(known))


def tagged_lexicon(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The lexicon learnt from documents, with a tag for each affix."""
    stems, edges = segmentation.learnt(written(words_of(spark, sf_dir, "documents"), "words"), PER_MILLE)
    return stems, written(edges.withColumn("tag", F.when(F.col("affix") == "", "").otherwise(F.concat(F.lit("<"), "affix", F.lit(">")))), "lexicon")


def conversion_rules(edges: DataFrame) -> DataFrame:
    """(ord, old, new): tags of the other set, longer ones first, as one may begin like another; then two
    rules for what one set joins and the other does not; then some tags turned round, which few words
    bear out."""
    tags = edges.where("affix <> ''").select("affix").distinct()
    names = tags.select((1000 - F.length("affix")).alias("ord"), F.concat(F.lit("+"), "affix").alias("old"), F.concat(F.lit("<"), "affix", F.lit(">")).alias("new"))
    joined = edges.sparkSession.createDataFrame([(2000, "<e><s>", "<es>"), (2000, "<e><r>", "<er>")], "ord int, old string, new string")
    turned = tags.where("length(affix) = 2 and affix < 'f'").select(F.lit(3000).alias("ord"), F.concat(F.lit("<"), "affix", F.lit(">")).alias("old"), F.concat(F.lit("<"), F.reverse("affix"), F.lit(">")).alias("new"))
    rows = names.union(joined).union(turned)
    return rows.select(F.row_number().over(W.orderBy("ord", "old")).alias("ord"), "old", "new")  # a row for each affix


@query(f"""
WITH RECURSIVE {_LEARNT}, v AS MATERIALIZED {_WORDS.format('conversations')}, seg(word, pos, class, path) AS (
  SELECT word, k, 'Root', left(word, k) FROM (SELECT word, unnest(range(3, least(length(word), 24) + 1)) AS k FROM v) JOIN stems ON stem = left(word, k)
  UNION ALL
  SELECT s.word, s.pos + s.k, e.next, s.path || '+' || e.affix FROM (SELECT seg.*, k, substr(word, pos + 1, k) AS piece FROM seg JOIN sizes ON pos + k <= length(word)) s JOIN edges e ON e.class = s.class AND e.affix = s.piece
),
a AS (SELECT DISTINCT word AS surface, path AS analysis FROM seg WHERE pos = length(word)),
tags AS (SELECT DISTINCT affix FROM edges),
rules AS (SELECT 1000 - length(affix) AS ord, '+' || affix AS old, '<' || affix || '>' AS new FROM tags UNION ALL SELECT 2000, '<e><s>', '<es>' UNION ALL SELECT 2000, '<e><r>', '<er>' UNION ALL SELECT 3000, '<' || affix || '>', '<' || reverse(affix) || '>' FROM tags WHERE length(affix) = 2 AND affix < 'f'),
folded AS (SELECT list(old || chr(1) || new ORDER BY ord, old) AS r FROM rules),
n AS (SELECT surface, analysis, list_reduce(list_prepend(analysis, (SELECT r FROM folded)), lambda x, r: replace(x, split_part(r, chr(1), 1), split_part(r, chr(1), 2))) AS new FROM a),
g AS (SELECT *, split_part(new, '<', 1) AS stem, regexp_extract_all(new, '<([^>]*)>', 1) AS t FROM n)
SELECT surface, analysis, new, stem IN (SELECT stem FROM stems) AND stem || array_to_string(t, '') = surface AND CASE len(t) WHEN 0 THEN true WHEN 1 THEN t[1] IN (SELECT ending FROM first) WHEN 2 THEN t[1] IN (SELECT ending FROM first) AND (t[1] || chr(1) || t[2]) IN (SELECT before || chr(1) || ending FROM second) ELSE false END AS sound FROM g
""")
def converted_analyses(spark, sf_dir):
    """The words of conversations, analysed, told in another tag set, and converted back by rules."""
    stems, edges = tagged_lexicon(spark, sf_dir)
    words = words_of(spark, sf_dir, "conversations")
    other = segmentation.analyses(words, stems, edges).select(F.col("word").alias("surface"), F.replace(F.replace("analysis", F.lit("<"), F.lit("+")), F.lit(">"), F.lit("")).alias("analysis"))
    return segmentation.converted(other, conversion_rules(edges), stems, edges)


# -- streams ----------------------------------------------------------------------------------------

_DAY = 86_400_000


@query(SQL["run_best"])
def streamed_runs(spark, sf_dir):
    """The runs of ``run_best``, from a stream of the events; a mark after the last of them has the
    open runs come out. A key's runs are only cut where it is quiet for ten years."""
    ship_package(spark)
    folder = new_folder(spark, "runs")
    end = table(spark, sf_dir, "events").agg((F.max("ts") + F.make_dt_interval(F.lit(3653))).cast("string")).first()[0]
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema)
    stream = events.parquet(f"{sf_dir}/events.parque[t]")  # a pattern stands for one file as well as for a folder
    rows = stream.select("user_id", "ts", "event_id", F.col("event_type").alias("word"), F.col("props").alias("analysis"), F.col("value").alias("score"))
    runs.mark(spark, f"{folder}/marks", "ts", end)
    found = runs.best_of_runs(runs.with_marks(rows, f"{folder}/marks", "ts"), "user_id", "ts", "event_id", 3650 * _DAY)
    runs.run_to_end(lambda: found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(), spark)
    out = spark.read.schema("user_id long, run long, word string, analysis string, score double").parquet(f"{folder}/out")
    return out.select("user_id", "run", F.col("word").alias("event_type"), F.md5(F.col("analysis").cast("binary")).alias("best_md5"), F.col("score").alias("value"))


# -- sentences and spellings ------------------------------------------------------------------------

_TOKENS = phonology.PLAIN_TOKEN.replace("'", "''")
_QUOTED = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_MARKS, _OPENS, _CLOSES = (_QUOTED(x) for x in (phonology.SENTENCE_ENDS, phonology.OPENING, phonology.CLOSING))
_TOKENISED = f"""d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(text, '{_TOKENS}') AS t FROM documents),
x AS MATERIALIZED (SELECT doc_id, i, t[i] AS x, CASE WHEN i > 1 THEN t[i - 1] END AS before, t[i + 1] AS after FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM d)),
c AS (SELECT lower(before) AS word, count(*) AS dots, count(*) FILTER (NOT regexp_matches(after, '^\\p{{Lu}}')) AS open FROM x WHERE x = '.' AND before IS NOT NULL AND after IS NOT NULL AND regexp_full_match(lower(before), '\\p{{L}}+') GROUP BY 1),
known AS MATERIALIZED (SELECT word, dots, open FROM c WHERE dots * {sentences.SHARE} >= (SELECT sum(dots) FROM c) AND open * 100 >= {sentences.HUNDREDTHS} * dots)"""


def tokenised(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", phonology.sentence_tokens(F.col("text"), initials=False).alias("t"))


@query(f"WITH {_TOKENISED} SELECT word, dots, open FROM known")
def learnt_abbreviations(spark, sf_dir):
    return sentences.abbreviations(tokenised(spark, sf_dir), "t")


@query(f"""
WITH {_TOKENISED}, e AS (SELECT doc_id, i, x IN ({_MARKS}) AND NOT coalesce(regexp_full_match(before, '[0-9]+') OR lower(before) IN (SELECT word FROM known), false) AND after IS NOT NULL AND after NOT IN ({_MARKS})
  AND NOT (after IN ({_CLOSES}) AND coalesce(max(CASE WHEN x IN ({_OPENS}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i), 0) = 1) AS ends FROM x),
s AS (SELECT doc_id, count(*) FILTER (ends) + 1 AS n_sentences, '0' || coalesce(string_agg(',' || i, '' ORDER BY i) FILTER (ends), '') AS starts FROM e GROUP BY doc_id)
SELECT d.doc_id, len(t) AS n_tokens, coalesce(n_sentences, 0) AS n_sentences, md5(coalesce(starts, '')) AS starts_md5 FROM d LEFT JOIN s USING (doc_id)
""")
def document_sentences(spark, sf_dir):
    rows = written(tokenised(spark, sf_dir), "tokens")  # read twice
    found = sentences.with_sentences(rows, "t", sentences.abbreviations(rows, "t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size("starts").cast("long").alias("n_sentences"), F.md5(F.array_join("starts", ",").cast("binary")).alias("starts_md5"))


_KEY = f"translate(lower(translate(word, '{phonology.CAPITALS}', '{phonology.SMALL}')), 'âîûçğıöşü', 'aiucgiosu')"


@query(f"""
WITH w AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents) GROUP BY word), k AS (SELECT *, {_KEY} AS key FROM w)
SELECT word, key, count(*) OVER (PARTITION BY key) AS spellings, first(word) OVER (PARTITION BY key ORDER BY cnt DESC, word) AS best FROM k
""")
def spelling_variants(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(f"({text.WORD})"), F.lit(1))).alias("word"))
    return sentences.spelling_groups(words.groupBy("word").agg(F.count("*").alias("cnt")))
