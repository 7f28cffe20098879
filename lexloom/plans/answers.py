"""Queries of model output, logs and analyses: the raw text is put together from the tables, in Spark and
in SQL alike, and each side parses it by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import gloss, parse, text
from lexloom.operators import alignment, assessment
from lexloom.operators.staging import written
from lexloom.plans.catalogue import query, table

_WORDS = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+')"


def _quoted(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def _any(c: str, needles) -> str:
    return "(" + " OR ".join(f"contains({c}, '{n}')" for n in needles) + ")"


# -- verdicts ---------------------------------------------------------------------------------------

#: How an answer is worded, by the length of its text; {0} is a word of it, {1} the whole text.
_WORDINGS = (
    "<VERDICT>CORRECT</VERDICT>", "<verdict>incorrect</verdict> <correction>{0}</correction>", "Incorrect. {0}", "that is correct, {0}", "that is incorrect, not correct", "{1}",
    "<VERDICT>INCORRECT</VERDICT><CORRECTION>correct_english_lemma</CORRECTION>", "<VERDICT>INCORRECT</VERDICT><CORRECTION>{1}</CORRECTION>", "<VERDICT>INCORRECT</VERDICT> {0}", "correct",
    "<VERDICT>INCORRECT</VERDICT><CORRECTION> {0} </CORRECTION> as should be", "<VERDICT>INCORRECT</VERDICT><CORRECTION>this is {0}</CORRECTION>",
)
_SOURCES = ("NATO", "+", "42", "Izmir", "eu")


def _worded_sql(i: int) -> str:
    out = _WORDINGS[i]
    parts = [p for p in out.replace("{0}", "\0w\0").replace("{1}", "\0t\0").split("\0") if p]
    return " || ".join({"w": "w[3]", "t": "text"}.get(p) or f"'{p}'" for p in parts)


_ANSWERED = f"""q AS (SELECT conv_id, turn, text, length(text) AS n, list_concat({_WORDS}, ['a', 'b', 'c']) AS w FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN n % 3 = 0 THEN [{_quoted(_SOURCES)}][n // 3 % {len(_SOURCES)} + 1] ELSE w[1] END AS source, CASE WHEN n % 5 = 0 THEN w[1] ELSE w[2] END AS target,
  CASE n % {len(_WORDINGS)} {' '.join(f'WHEN {i} THEN {_worded_sql(i)}' for i in range(len(_WORDINGS)))} END AS response FROM q),
v AS (SELECT *, lower(trim(response)) AS low, upper(regexp_extract(response, '(?i)<VERDICT>(CORRECT|INCORRECT)</VERDICT>', 1)) AS tag, trim(regexp_extract(response, '(?is)<CORRECTION>(.*?)</CORRECTION>', 1)) AS tagged, trim(regexp_replace(trim(response), '(?i)<VERDICT>INCORRECT</VERDICT>', '', 'g')) AS rest FROM r),
s AS (SELECT *, CASE WHEN tag <> '' THEN tag WHEN starts_with(low, 'correct') THEN 'CORRECT' WHEN starts_with(low, 'incorrect') THEN 'INCORRECT' WHEN contains(replace(low, 'incorrect', ''), 'correct') AND NOT contains(low, 'incorrect') THEN 'CORRECT' ELSE 'UNCLEAR' END AS said FROM v),
f AS (SELECT *, CASE WHEN tagged = '' AND said = 'INCORRECT' AND rest <> '' AND NOT starts_with(rest, '<') THEN rest ELSE tagged END AS found FROM s),
c AS (SELECT *, CASE WHEN said = 'INCORRECT' AND ({_any('lower(found)', parse.PLACEHOLDERS)} OR length(found) > 50 OR {_any('lower(found)', parse.EXPLAINING)}) THEN '' ELSE found END AS fix FROM f),
i AS (SELECT conv_id, turn, source, target, lower(source) AS ls, lower(target) AS lt, CASE WHEN source = target AND said <> 'CORRECT' THEN 'CORRECT' ELSE said END AS said, CASE WHEN source = target AND said <> 'CORRECT' THEN '' ELSE fix END AS fix FROM c),
d AS (SELECT * REPLACE (CASE WHEN regexp_full_match(source, '\\p{{Nd}}+') AND fix <> '' AND NOT regexp_full_match(fix, '\\p{{Nd}}+') THEN source ELSE fix END AS fix) FROM i),
k AS (SELECT *, length(source) = 1 AND contains({_quoted([parse.SYMBOLS])}, source) AND source <> target AS symbol, ls IN ({_quoted(parse.ABBREVIATIONS)}) AND lt <> ls AND (length(target) > 10 OR NOT regexp_full_match(target, '\\p{{L}}+')) AS short,
  left(source, 1) = upper(left(source, 1)) AND left(source, 1) <> lower(left(source, 1)) AND regexp_full_match(source, '\\p{{L}}+') AND length(source) > 2 AND lt <> ls AND len(list_filter(string_split(left(ls, 3), ''), lambda x: x <> '' AND contains(lt, x))) = 0 AS name FROM d),
z AS (SELECT conv_id, turn, CASE WHEN symbol OR short OR name THEN 'INCORRECT' ELSE said END AS verdict, CASE WHEN short OR name THEN ls WHEN symbol THEN source ELSE fix END AS correction FROM k)"""


def answered(spark, sf_dir) -> DataFrame:
    """(conv_id, turn, source, target, response): a wording for each turn, filled with its words."""
    n = F.length("text")
    w = F.concat(F.regexp_extract_all("text", F.lit(f"({text.WORD})"), F.lit(1)), F.array(*map(F.lit, "abc")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", n.alias("n"), w.alias("w"))
    response = None
    for i, wording in enumerate(_WORDINGS):
        made = F.replace(F.replace(F.lit(wording), F.lit("{0}"), F.get("w", F.lit(2))), F.lit("{1}"), F.col("text"))
        response = F.when(F.col("n") % len(_WORDINGS) == i, made) if response is None else response.when(F.col("n") % len(_WORDINGS) == i, made)
    known = F.get(F.array(*map(F.lit, _SOURCES)), (F.floor(F.col("n") / 3) % len(_SOURCES)).cast("int"))
    source = F.when(F.col("n") % 3 == 0, known).otherwise(F.get("w", F.lit(0)))
    target = F.when(F.col("n") % 5 == 0, F.get("w", F.lit(0))).otherwise(F.get("w", F.lit(1)))
    return rows.select("conv_id", "turn", source.alias("source"), target.alias("target"), response.alias("response"))


@query(f"WITH {_ANSWERED} SELECT conv_id, turn, verdict, correction FROM z")
def verdict_branches(spark, sf_dir):
    return assessment.assessed(answered(spark, sf_dir)).select("conv_id", "turn", "verdict", "correction")


@query(f"""
WITH {_ANSWERED}
SELECT count(*) AS total, count(*) FILTER (verdict = 'CORRECT') AS correct, count(*) FILTER (verdict = 'INCORRECT') AS incorrect, count(*) FILTER (verdict = 'INCORRECT' AND correction <> '') AS corrected, count(*) FILTER (verdict = 'UNCLEAR') AS unclear,
  round(count(*) FILTER (verdict = 'CORRECT') / count(*), 6) AS accuracy, round(count(*) FILTER (verdict = 'INCORRECT' AND correction <> '') / count(*) FILTER (verdict = 'INCORRECT'), 6) AS correction_rate FROM z
""")
def verdict_rules(spark, sf_dir):
    out = assessment.summary(assessment.assessed(answered(spark, sf_dir)))
    return out.withColumn("accuracy", F.round("accuracy", 6)).withColumn("correction_rate", F.round("correction_rate", 6))


@query(f"WITH {_ANSWERED} SELECT r.source, CASE WHEN verdict = 'CORRECT' THEN r.target ELSE correction END AS target, count(*) AS cnt FROM z JOIN r USING (conv_id, turn) WHERE verdict = 'CORRECT' OR verdict = 'INCORRECT' AND correction <> '' GROUP BY ALL")
def assessed_dictionary(spark, sf_dir):
    """The dictionary that is left: right pairs, and wrong ones with their correction."""
    rows = written(assessment.assessed(answered(spark, sf_dir)), "assessed")  # read twice
    return assessment.clean_dictionary(rows).groupBy("source", "target").agg(F.count("*").alias("cnt"))


# -- alignments -------------------------------------------------------------------------------------

#: Answers about alignments: with both tags, the first alone, none, or nothing but words.
_ALIGNED = f"""q AS (SELECT conv_id, turn, length(text) AS n, {_WORDS} AS w FROM conversations),
l AS (SELECT conv_id, turn, n, w, array_to_string([w[i] || CASE WHEN i % 5 = 0 THEN ' = ' WHEN i % 7 = 0 THEN ' - ' || w[i] || ' - ' ELSE ' - ' END || w[i + 1] FOR i IN range(1, len(w))], chr(10)) AS lines FROM q),
a AS (SELECT conv_id, turn, CASE n % 5 WHEN 0 THEN '<alignments>' || chr(10) || lines || chr(10) || '</alignments>' WHEN 1 THEN 'so <alignments> ' || lines WHEN 2 THEN lines WHEN 3 THEN '<alignments> </alignments> ' || lines ELSE array_to_string(w, ' ') END AS answer,
  CASE WHEN n % 7 = 0 THEN w[1] WHEN n % 11 = 0 THEN 'memory' END AS error FROM l),
b AS (SELECT *, contains(answer, '<alignments>') AS opened, contains(answer, '</alignments>') AS closed, trim(CASE WHEN regexp_matches(answer, '(?s)<alignments>.*?</alignments>') THEN regexp_extract(answer, '(?s)<alignments>(.*?)</alignments>', 1) WHEN contains(answer, '<alignments>') THEN substr(answer, instr(answer, '<alignments>') + 12) ELSE answer END) AS block FROM a),
p AS (SELECT *, list_filter([{{'s': trim(split_part(x, ' - ', 1)), 't': trim(substr(x, instr(x, ' - ') + 3))}} FOR x IN list_filter([trim(y) FOR y IN string_split(block, chr(10))], lambda y: contains(y, ' - '))], lambda z: z.s <> '' AND z.t <> '') AS pairs FROM b)"""


def aligned_answers(spark, sf_dir) -> DataFrame:
    """(conv_id, turn, answer, error): lines of a turn's neighbouring words, in the forms that models use."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"), F.regexp_extract_all("text", F.lit(f"({text.WORD})"), F.lit(1)).alias("w"))
    places = F.when(F.size("w") < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))))
    at = lambda i: F.get("w", i - 1)
    mark = lambda i: F.when(i % 5 == 0, " = ").when(i % 7 == 0, F.concat(F.lit(" - "), at(i), F.lit(" - "))).otherwise(" - ")
    lines = F.array_join(F.transform(places, lambda i: F.concat(at(i), mark(i), at(i + 1))), "\n")
    rows = rows.withColumn("lines", lines)
    k, c = F.col("n") % 5, F.col("lines")
    answer = F.when(k == 0, F.concat(F.lit("<alignments>\n"), c, F.lit("\n</alignments>"))).when(k == 1, F.concat(F.lit("so <alignments> "), c)).when(k == 2, c).when(k == 3, F.concat(F.lit("<alignments> </alignments> "), c)).otherwise(F.array_join("w", " "))
    error = F.when(F.col("n") % 7 == 0, F.get("w", F.lit(0))).when(F.col("n") % 11 == 0, "memory")
    return rows.select("conv_id", "turn", answer.alias("answer"), error.alias("error"))


@query(f"WITH {_ALIGNED} SELECT conv_id, turn, opened AS has_start_tag, closed AS has_end_tag, opened AND closed AS has_alignment_tags, len(pairs) AS num_alignments, opened AND closed AND len(pairs) > 0 AS is_valid_format, array_to_string([z.s || '=' || z.t FOR z IN pairs], ' ') AS pairs FROM p")
def alignment_flags(spark, sf_dir):
    c = F.col("answer")
    pairs = F.array_join(F.transform(parse.tagged_alignments(c), lambda p: F.concat_ws("=", p["source"], p["target"])), " ")
    return aligned_answers(spark, sf_dir).select("conv_id", "turn", *(v.alias(k) for k, v in parse.alignment_flags(c).items()), pairs.alias("pairs"))


@query(f"""
WITH {_ALIGNED} SELECT count(*) AS pairs, count(error) AS failed, CAST(coalesce(sum(len(pairs)) FILTER (error IS NULL), 0) AS BIGINT) AS alignments, round(100.0 * (count(*) - count(error)) / count(*), 6) AS success_rate, round(sum(len(pairs)) FILTER (error IS NULL) / (count(*) - count(error)), 6) AS average FROM p
""")
def inference_statistics(spark, sf_dir):
    rows = aligned_answers(spark, sf_dir).select("error", F.size(parse.tagged_alignments(F.col("answer"))).cast("long").alias("num_alignments"))
    out = alignment.inference_statistics(rows)
    return out.withColumn("success_rate", F.round(F.col("success_rate").cast("double"), 6)).withColumn("average", F.round("average", 6))


@query(f"WITH {_ALIGNED} SELECT error, count(*) AS cnt FROM p WHERE error IS NOT NULL GROUP BY error")
def error_histogram(spark, sf_dir):
    return alignment.error_histogram(aligned_answers(spark, sf_dir))


# -- logs -------------------------------------------------------------------------------------------

_CENTS = "(CAST(floor(value) AS BIGINT) || '.' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0'))"
_NUMBER = "TRY_CAST(regexp_extract(line, '{}', 1) AS {})"


@query(f"""
WITH l AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'Step ' || event_id || '/' || user_id || '; Train avg loss: ' || {_CENTS} || ' lr: ' || {_CENTS} || 'e-3' WHEN 'view' THEN 'Epoch ' || user_id || ': Validation avg loss: ' || {_CENTS} || ', accuracy: ' || (event_id % 100) || ', ppl: ' || {_CENTS}
  WHEN 'purchase' THEN 'Saving checkpoint model_step_' || event_id || '.pt to ' || user_id ELSE event_type || ' ' || {_CENTS} END AS line FROM events)
SELECT event_id, {_NUMBER.format('Step ([0-9]+)', 'BIGINT')} AS step, {_NUMBER.format('Epoch ([0-9]+)', 'BIGINT')} AS epoch, {_NUMBER.format('Train .*?loss: ([0-9.]+)', 'DOUBLE')} AS train_loss, {_NUMBER.format('Validation .*?loss: ([0-9.]+)', 'DOUBLE')} AS valid_loss, {_NUMBER.format('lr: ([0-9.e-]+)', 'DOUBLE')} AS learning_rate,
  {_NUMBER.format('accuracy: ([0-9.]+)', 'DOUBLE')} AS accuracy, {_NUMBER.format('ppl: ([0-9.]+)', 'DOUBLE')} AS perplexity, nullif(regexp_extract(line, 'Saving checkpoint (.*?) to', 1), '') AS checkpoint FROM l
""")
def log_branches(spark, sf_dir):
    e, u, kind = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type")
    cents = F.concat(F.floor("value").cast("string"), F.lit("."), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"))
    line = (
        F.when(kind == "click", F.concat(F.lit("Step "), e, F.lit("/"), u, F.lit("; Train avg loss: "), cents, F.lit(" lr: "), cents, F.lit("e-3")))
        .when(kind == "view", F.concat(F.lit("Epoch "), u, F.lit(": Validation avg loss: "), cents, F.lit(", accuracy: "), (F.col("event_id") % 100).cast("string"), F.lit(", ppl: "), cents))
        .when(kind == "purchase", F.concat(F.lit("Saving checkpoint model_step_"), e, F.lit(".pt to "), u))
        .otherwise(F.concat(kind, F.lit(" "), cents))
    )
    return table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in parse.log_metrics(line).items()))


# -- analyses ---------------------------------------------------------------------------------------

_MAPPED = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in gloss.TAG_MAP.items()) + "}"
#: Tags of which analyses are put together: all known ones, in order, and one that is not.
_TAGS = (*gloss.TAG_MAP, "odd")


@query(f"""
WITH x AS (SELECT p_partkey, p_size, p_partkey % 6 AS k, string_split(p_name, ' ')[1] AS w, [{_quoted(_TAGS)}] AS t FROM part),
a AS (SELECT p_partkey, CASE k WHEN 0 THEN w WHEN 1 THEN w || ' ???' WHEN 2 THEN w || 'ler ' || w || '<' || t[p_partkey % {len(_TAGS)} + 1] || '>' ELSE w || '<N:' || t[p_size % {len(_TAGS)} + 1] || '><' || t[p_partkey % {len(_TAGS)} + 1] || '>' END AS analysis FROM x),
b AS (SELECT *, CASE WHEN regexp_matches(analysis, '^\\S+\\s+\\S') THEN string_split_regex(trim(analysis), '\\s+')[1] ELSE split_part(analysis, '<', 1) END AS word, regexp_extract_all(analysis, '<([^>]*)>', 1) AS inner_ FROM a),
c AS (SELECT *, list_concat(string_split(inner_[1], ':'), inner_[2:]) AS parts FROM b)
SELECT p_partkey, CASE WHEN contains(analysis, '???') THEN string_split_regex(trim(analysis), '\\s+')[1] WHEN NOT contains(analysis, '<') THEN analysis ELSE word || '-' || array_to_string([coalesce({_MAPPED}[p], upper(p)) FOR p IN parts], '-') END AS token FROM c
""")
def analysis_branches(spark, sf_dir):
    w, tags = F.get(F.split("p_name", " "), F.lit(0)), F.array(*map(F.lit, _TAGS))
    tag = lambda c: F.get(tags, (F.col(c) % len(_TAGS)).cast("int"))
    k = F.col("p_partkey") % 6
    analysis = F.when(k == 0, w).when(k == 1, F.concat(w, F.lit(" ???"))).when(k == 2, F.concat(w, F.lit("ler "), w, F.lit("<"), tag("p_partkey"), F.lit(">"))).otherwise(F.concat(w, F.lit("<N:"), tag("p_size"), F.lit("><"), tag("p_partkey"), F.lit(">")))
    return table(spark, sf_dir, "part").select("p_partkey", gloss.convert_analysis(analysis).alias("token"))


_BEGINS = [b for begins, *_ in parse.SURFACE_REWRITES for b in begins] + [""]
_LEADS = [(lead, old) for _, lead, old, _ in parse.SURFACE_REWRITES] + [("", "")]


def _rewrite(i: int) -> str:
    begins, lead, old, new = parse.SURFACE_REWRITES[i]
    met = " OR ".join(f"starts_with(surface, '{b}')" for b in begins)
    at = f"instr(analysis, '{old}')"
    return f"WHEN ({met}) AND starts_with(analysis, '{lead}') THEN CASE WHEN {at} = 0 THEN analysis ELSE left(analysis, {at} - 1) || '{new}' || substr(analysis, {at} + {len(old)}) END"


@query(f"""
WITH x AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS w, [{_quoted(_BEGINS)}][p_partkey % {len(_BEGINS)} + 1] || string_split(p_name, ' ')[1] AS surface, p_partkey // {len(_BEGINS)} % {len(_LEADS)} + 1 AS k FROM part),
a AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN [{_quoted(x for x, _ in _LEADS)}][k] ELSE [{_quoted(x for _, x in _LEADS)}][k] END || '<' || w || '><' || [{_quoted(x for _, x in _LEADS)}][k] AS analysis FROM x)
SELECT p_partkey, CASE {' '.join(map(_rewrite, range(len(parse.SURFACE_REWRITES))))} ELSE analysis END AS analysis FROM a
""")
def surface_rewrites(spark, sf_dir):
    w, key = F.get(F.split("p_name", " "), F.lit(0)), F.col("p_partkey")
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    k = F.floor(key / len(_BEGINS)) % len(_LEADS)
    old = pick([x for _, x in _LEADS], k)
    analysis = F.concat(F.when(key % 3 == 0, pick([x for x, _ in _LEADS], k)).otherwise(old), F.lit("<"), w, F.lit("><"), old)
    return table(spark, sf_dir, "part").select("p_partkey", parse.surface_rewritten(F.concat(pick(_BEGINS, key % len(_BEGINS)), w), analysis).alias("analysis"))
