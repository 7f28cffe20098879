"""Further queries of the catalogue: international scoring, reports, lemmas, retrieval, transducers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import gloss, metrics, parse, phonology, text
from lexloom.operators import alignment, assessment, corpus, dedup, dictionary, evaluation, lookup, retrieval
from lexloom.operators.ranking import sorted_places
from lexloom.plans.catalogue import _APPLIED, _BEST, _COUNTS, _LINES, _M1, _PARALLEL, _PRIO, _STATS, _SUMS, dictionary_pairs, docs_labels, gloss_lines, parallel, query, table

# -- evaluation -----------------------------------------------------------------------------------


def raw_pairs(spark, sf_dir) -> DataFrame:
    """(conv_id, turn, src, tgt): a user's turn and the assistant's next, as texts."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    return user.join(turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt")), ["conv_id", "turn"])


def _thirteen(c: str) -> str:
    out = f"' ' || {c} || ' '"
    for a, b in [("<skipped>", ""), ("-\\n", ""), ("\\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("([\\{-\\~\\[-\\` -\\&\\(-\\+\\:-\\@\\/])", " \\1 "), ("([^0-9])([\\.,])", "\\1 \\2 "), ("([\\.,])([^0-9])", " \\1 \\2"), ("([0-9])(-)", "\\1 \\2 ")]:
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return f"list_filter(string_split_regex(trim({out}), '\\s+'), lambda t: t <> '')"


_RAW = f"""pairs AS (SELECT u.conv_id, u.turn, {_thirteen('u.text')} AS src, {_thirteen('a.text')} AS tgt
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""
_STATS13 = _STATS.replace(_PARALLEL, _RAW).replace("greatest(len(tgt), 1)", "len(tgt)").replace("greatest(len(tgt) - 1, 1)", "greatest(len(tgt) - 1, 0)").replace("greatest(len(tgt) - 2, 1)", "greatest(len(tgt) - 2, 0)").replace("greatest(len(tgt) - 3, 1)", "greatest(len(tgt) - 3, 0)")
_BP = "CASE WHEN hyp > ref THEN 1.0 WHEN hyp = 0 THEN 0.0 ELSE exp(1 - ref / hyp) END"
_ZEROS = {n: " + ".join(f"CASE WHEN m{k} = 0 AND t{k} > 0 THEN 1 ELSE 0 END" for k in range(1, n + 1)) for n in range(1, 5)}
_LOGS = " + ".join(f"CASE WHEN t{n} = 0 THEN 0.0 WHEN m{n} = 0 THEN -ln(pow(2.0, {_ZEROS[n]}) * t{n}) ELSE ln(m{n} / t{n}) END" for n in range(1, 5))
_LIVE = " + ".join(f"CASE WHEN t{n} > 0 THEN 1 ELSE 0 END" for n in range(1, 5))
_INTER = f"CASE WHEN m1 + m2 + m3 + m4 = 0 OR hyp = 0 {{short}} THEN 0.0 ELSE 100 * {_BP} * exp(({_LOGS}) / greatest({_LIVE}, 1)) END"


@query(f"""
WITH {_STATS13}, x AS (SELECT count(*) AS pairs, {_SUMS} FROM s)
SELECT pairs, CAST(hyp AS BIGINT) AS hyp, CAST(ref AS BIGINT) AS ref, {', '.join(f'round(100.0 * m{n} / t{n}, 6) AS p{n}' for n in range(1, 5))}, round({_BP}, 6) AS bp, round({_INTER.format(short=f'OR ({_LIVE}) < 4')}, 6) AS bleu FROM x
""")
def international_bleu(spark, sf_dir):
    out = evaluation.international_bleu(raw_pairs(spark, sf_dir), "tgt", "src")
    return out.select("pairs", "hyp", "ref", *(F.round(c, 6).alias(c) for c in ("p1", "p2", "p3", "p4", "bp", "bleu")))


@query(f"WITH {_STATS13} SELECT conv_id, turn, round({_INTER.format(short='')}, 6) AS bleu FROM s")
def international_sentence_bleu(spark, sf_dir):
    return raw_pairs(spark, sf_dir).select("conv_id", "turn", F.round(evaluation.international_sentence_bleu(F.col("tgt"), F.col("src")), 6).alias("bleu"))


_LOWER = {k: f"CASE WHEN m1 = 0 OR hyp = 0 THEN 0.0 ELSE {_BP} * exp((" + " + ".join(f"ln(CASE WHEN m{n} = 0 THEN 0.1 ELSE m{n} END / t{n})" for n in range(1, k + 1)) + f") / {k}) END" for k in (1, 2, 3)}


@query(f"WITH {_STATS}, x AS (SELECT {_SUMS} FROM s) SELECT {', '.join(f'round({_LOWER[k]}, 6) AS bleu{k}' for k in (1, 2, 3))} FROM x")
def bleu_orders(spark, sf_dir):
    rows = parallel(spark, sf_dir).select(metrics.bleu_stats(F.col("tgt"), F.col("src")).alias("s")).agg(*metrics.summed("s"))
    return rows.select(*(F.round(metrics.combined_bleu(metrics.bleu_method1, k), 6).alias(f"bleu{k}") for k in (1, 2, 3)))


def _mixed(inner: str) -> str:
    """Rows of a table with a column z, with what SplitMix64 makes of it in its place."""
    for shift, times in ((30, evaluation.MIX_A), (27, evaluation.MIX_B)):
        inner = f"(SELECT * REPLACE ((xor(z, z >> {shift}) * {times}::UHUGEINT) & 18446744073709551615::UHUGEINT AS z) FROM {inner})"
    return f"(SELECT * REPLACE (xor(z, z >> 31) AS z) FROM {inner})"


def _uniform(inner: str, stage: int, seed: int = 42) -> str:
    """Rows (b, block, j, ...) with the uniform number u of each."""
    first = _mixed(f"(SELECT *, {seed + stage}::UHUGEINT AS z FROM {inner})")
    by_block = _mixed(f"(SELECT * REPLACE (xor(z, block::UHUGEINT) AS z) FROM {_mixed(f'(SELECT * REPLACE (xor(z, b::UHUGEINT) AS z) FROM {first})')})")
    last = _mixed(f"(SELECT * REPLACE ((z + (j + 1)::UHUGEINT * {evaluation.GAMMA}::UHUGEINT) & 18446744073709551615::UHUGEINT AS z) FROM {by_block})")
    return f"(SELECT * EXCLUDE (z), CAST(CAST(z >> 11 AS UBIGINT) AS DOUBLE) * {2.0**-53!r} AS u FROM {last})"


def _drawn(rows: str, sums: list[str], score: str, replicates: int) -> str:
    """n draws of each replicate: into blocks, and to rows inside them."""
    size = evaluation.BLOCK
    return f"""placed AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS at_ FROM {rows}), total AS (SELECT count(*) AS n FROM placed),
one AS (SELECT b, unnest(range((SELECT n FROM total))) AS j, 0 AS block FROM (SELECT unnest(range({replicates})) AS b)),
k AS MATERIALIZED (SELECT b, CAST(floor(u * (SELECT n FROM total)) AS BIGINT) // {size} AS block, count(*) AS k FROM {_uniform('one', 1)} GROUP BY ALL),
two AS (SELECT b, block, unnest(range(k)) AS j FROM k),
hit AS (SELECT b, block * {size} + CAST(floor(u * least({size}, (SELECT n FROM total) - block * {size})) AS BIGINT) AS at_ FROM {_uniform('two', 2)}),
x AS (SELECT b, {', '.join(f'sum(r0.{c}) AS {c}' for c in sums)} FROM hit JOIN placed r0 USING (at_) GROUP BY b),
scores AS (SELECT list_sort(list(score)) AS l, avg(score) AS mean FROM (SELECT {score} AS score FROM x))
SELECT round(mean, 6) AS mean, round(l[{int(replicates * 0.025) + 1}], 6) AS low, round(l[{int(replicates * 0.975) + 1}], 6) AS high FROM scores"""


_ZERO = {n: " + ".join(f"CASE WHEN m{k} = 0 THEN 1 ELSE 0 END" for k in range(1, n + 1)) for n in range(1, 5)}
_EXP = f"CASE WHEN m1 = 0 OR hyp = 0 THEN 0.0 ELSE 100 * {_BP} * exp((" + " + ".join(f"ln(CASE WHEN m{n} = 0 THEN 1 / (pow(2.0, {_ZERO[n]}) * t{n}) ELSE m{n} / t{n} END)" for n in range(1, 5)) + ") / 4) END"


def _interval(scores: DataFrame, replicates: int) -> DataFrame:
    return evaluation.interval(scores, replicates).select(*(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query(f"WITH {_STATS}, {_drawn('s', ['m1', 'm2', 'm3', 'm4', 't1', 't2', 't3', 't4', 'hyp', 'ref'], _EXP, 1000)}")
def bootstrap_ci(spark, sf_dir):
    return _interval(evaluation.bootstrap(parallel(spark, sf_dir), ["conv_id", "turn"], evaluation.bleu_sums("tgt", "src"), 1000), 1000)


@query(f"WITH {_PARALLEL}, r AS (SELECT conv_id, turn, len(tgt) AS h, len(src) AS r FROM pairs), {_drawn('r', ['h', 'r'], 'CASE WHEN r = 0 THEN 0.0 ELSE h / r END', 1000)}")
def bootstrap_length_ratio(spark, sf_dir):
    metric = {"h": F.size("tgt"), "r": F.size("src")}, F.coalesce(F.try_divide(F.col("h"), F.col("r")), F.lit(0.0))
    return _interval(evaluation.bootstrap(parallel(spark, sf_dir), ["conv_id", "turn"], metric, 1000), 1000)


def _chr_grams(side: str, items: str) -> str:
    letters = "list_filter(string_split(regexp_replace(text, '\\s+', '', 'g'), ''), lambda t: t <> '')"
    words = "list_filter(string_split_regex(trim(regexp_replace(text, '([[:punct:]])', ' \\1 ', 'g')), '\\s+'), lambda t: t <> '')"
    return f"""{side}u AS (SELECT item_id AS id, 'c' AS kind, unnest(range(1, 7)) AS n, {letters} AS x FROM {items} UNION ALL SELECT item_id, 'w', unnest(range(1, 3)), {words} FROM {items}),
{side}g AS (SELECT id, kind, n, g, count(*) AS c FROM (SELECT id, kind, n, unnest([array_to_string(x[i:i + n - 1], chr(1)) FOR i IN range(1, len(x) - n + 2)]) AS g FROM {side}u) GROUP BY ALL), {side}s AS (SELECT id, kind, n, greatest(len(x) - n + 1, 0) AS size FROM {side}u)"""


_CHRF = f"""WITH q AS (SELECT item_id, text FROM benchmark WHERE item_id % 100 = 0), {_chr_grams('q', 'q')}, {_chr_grams('c', 'benchmark')},
m AS (SELECT a.id AS qi, b.id AS ci, kind, n, sum(least(a.c, b.c)) AS m FROM qg a JOIN cg b USING (kind, n, g) GROUP BY ALL),
z AS (SELECT a.id AS qi, b.id AS ci, coalesce(m, 0) / a.size AS p, coalesce(m, 0) / b.size AS r FROM qs a JOIN cs b USING (kind, n) LEFT JOIN m ON m.qi = a.id AND m.ci = b.id AND m.kind = a.kind AND m.n = a.n WHERE a.size > 0 AND b.size > 0),
f AS (SELECT qi, ci, CASE WHEN avg(p) + avg(r) = 0 THEN 0.0 ELSE round(500 * avg(p) * avg(r) / (4 * avg(p) + avg(r)), 6) END AS score FROM z GROUP BY ALL),
t AS (SELECT f.* FROM f JOIN benchmark a ON a.item_id = qi JOIN benchmark b ON b.item_id = ci WHERE lower(a.text) <> lower(b.text)),"""


def _items(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "benchmark")
    return items.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), items.select(F.col("item_id").alias("cand_id"), F.col("text").alias("cand"))


def _chrf(a, b):
    return F.round(metrics.chrf(a, b), 6)


@query(f"{_CHRF} k AS (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY score DESC, ci) AS rank FROM t) SELECT qi AS query_id, ci AS cand_id, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3")
def chrf_topk(spark, sf_dir):
    return retrieval.scored_topk(*_items(spark, sf_dir), _chrf)


@query(f"""{_CHRF} w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM benchmark),
j AS (SELECT qi, ci, round(n / (len(a) + len(b) - n), 6) AS s FROM (SELECT a.item_id AS qi, b.item_id AS ci, a.t AS a, b.t AS b, len(list_intersect(a.t, b.t)) AS n FROM w a JOIN w b ON a.item_id % 100 = 0) WHERE n > 0),
first AS (SELECT qi, ci, s AS score, 0 AS turn FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY s DESC, ci) AS r FROM j) JOIN t USING (qi, ci) WHERE r <= 2),
a AS (SELECT * FROM first UNION ALL SELECT qi, ci, score, 1 FROM t WHERE NOT EXISTS (SELECT 1 FROM first x WHERE x.qi = t.qi AND x.ci = t.ci)),
k AS (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY turn, score DESC, ci) AS rank FROM a) SELECT qi AS query_id, ci AS cand_id, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 4""")
def retrieval_refill(spark, sf_dir):
    """The two best by words, the query itself among them, then the best by letters down to four."""
    queries, pool = _items(spark, sf_dir)
    words = lambda df, key, c: df.select(key, F.array_distinct(text.word_tokens(F.col(c))).alias("tokens"))
    best = retrieval.jaccard_topk(words(queries, "query_id", "query"), words(pool, "cand_id", "cand"), 2).withColumn("score", F.round("score", 6))
    return retrieval.refilled(best.select("query_id", "cand_id", "score"), queries, pool, _chrf, 4)


@query("""
WITH s AS (SELECT q.item_id AS query_id, c.item_id AS cand_id, md5('42:' || q.item_id || ':' || c.item_id) AS h FROM benchmark q JOIN benchmark c ON lower(q.text) <> lower(c.text) WHERE q.item_id % 100 = 0)
SELECT query_id, cand_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY left(h, 8) DESC, cand_id) AS rank FROM s) WHERE rank <= 5
""")
def random_examples(spark, sf_dir):
    return retrieval.random_examples(*_items(spark, sf_dir), 5).select("query_id", "cand_id", "rank")


_LABELS = "list_transform({x}, lambda w: CASE WHEN length(w) % 3 = 0 THEN 'NOUN' WHEN length(w) % 3 = 1 THEN 'VERB' ELSE 'X' END)"


def _labels(words):
    return F.transform(words, lambda w: F.when(F.length(w) % 3 == 0, "NOUN").when(F.length(w) % 3 == 1, "VERB").otherwise("X"))


_RECALL = "CASE WHEN len({r}) = 0 THEN CASE WHEN len({h}) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect({h}, {r})) / len({r}) END"
_OF = "list_distinct(list_filter({x}, lambda w: length(w) % 3 = {n}))"


def _pairs_of(x: str) -> str:
    marked = f"list_filter({x}, lambda w: length(w) % 3 < 2)"
    return f"list_distinct([m[i] || chr(1) || m[i + 1] FOR i IN range(1, len(m)) IF length(m[i]) % 3 = 0 AND length(m[i + 1]) % 3 = 1])".replace("m[", f"({marked})[").replace("len(m)", f"len({marked})")


@query(f"""
WITH {_PARALLEL}, t AS (SELECT src, tgt, {_OF.format(x='tgt', n=0)} AS hn, {_OF.format(x='src', n=0)} AS rn, {_OF.format(x='tgt', n=1)} AS hv, {_OF.format(x='src', n=1)} AS rv, {_pairs_of('tgt')} AS hp, {_pairs_of('src')} AS rp FROM pairs),
s AS (SELECT {_RECALL.format(h='hn', r='rn')} AS nouns, {_RECALL.format(h='hv', r='rv')} AS verbs, {_RECALL.format(h='hp', r='rp')} AS pairs,
  CASE WHEN len(rv) = 0 THEN CASE WHEN len(hv) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(hv, rv)) / len(rv) END AS tenses FROM t)
SELECT round(100 * avg(nouns), 6) AS nouns, round(100 * avg(verbs), 6) AS verbs, round(100 * avg(pairs), 6) AS pairs, round(100 * avg(tenses), 6) AS tenses FROM s
""")
def linguistic_accuracy(spark, sf_dir):
    """Tags come from an outside tagger in use; here a word's length stands in for one."""
    rows = parallel(spark, sf_dir).select("src", "tgt", _labels(F.col("src")).alias("rs"), _labels(F.col("tgt")).alias("hs"))
    of = lambda side, words, kind: metrics.labelled(F.col(side), F.col(words), kind)
    tense = lambda side, words: F.map_from_arrays(of(side, words, "VERB"), F.transform(of(side, words, "VERB"), lambda w: F.length(w) % 2))
    scored = rows.select(
        metrics.set_recall(of("hs", "tgt", "NOUN"), of("rs", "src", "NOUN")).alias("nouns"),
        metrics.set_recall(of("hs", "tgt", "VERB"), of("rs", "src", "VERB")).alias("verbs"),
        metrics.set_recall(metrics.adjacent(F.col("hs"), F.col("tgt"), "NOUN", "VERB"), metrics.adjacent(F.col("rs"), F.col("src"), "NOUN", "VERB")).alias("pairs"),
        metrics.map_agreement(tense("hs", "tgt"), tense("rs", "src")).alias("tenses"),
    )
    names = ["nouns", "verbs", "pairs", "tenses"]
    return evaluation.macro_averages(scored, names).select(*(F.round(n, 6).alias(n) for n in names))


# -- reports ----------------------------------------------------------------------------------------

_FW = ", ".join(f"'{w}'" for w in dictionary.ENGLISH_FUNCTION_WORDS)
_REMOVED = f"""w AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(string_split_regex(trim(lower(CASE WHEN contains(text, '|') THEN substr(text, instr(text, '|') + 1) ELSE text END), ' \t\n\r'), '\\s+')) AS word FROM conversations) WHERE word <> '' GROUP BY word),
r AS (SELECT *, regexp_replace(word, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') IN ({_FW}) OR length(regexp_replace(word, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')) < 2 AS removed FROM w)"""


@query(f"WITH {_REMOVED} SELECT word, cnt FROM r WHERE removed ORDER BY cnt DESC, word LIMIT 100")
def removed_words(spark, sf_dir):
    found = dictionary.removed_tokens(table(spark, sf_dir, "conversations"), F.col("text"))
    return found.where("removed").select("word", "cnt").orderBy(F.desc("cnt"), "word").limit(100)


@query(f"WITH {_REMOVED}, t AS (SELECT CAST(sum(cnt) AS BIGINT) AS b, CAST(coalesce(sum(cnt) FILTER (NOT removed), 0) AS BIGINT) AS a FROM r) SELECT b AS before, a AS after, b - a AS removed, round(100.0 * (b - a) / b, 6) AS percentage FROM t")
def filtering_totals(spark, sf_dir):
    found = dictionary.removed_tokens(table(spark, sf_dir, "conversations"), F.col("text"))
    return dictionary.filtering_totals(found).withColumn("percentage", F.round(F.col("percentage").cast("double"), 6))


@query(f"""WITH {_COUNTS}, k AS (SELECT * FROM counts WHERE src NOT IN ({_FW}) AND tgt NOT IN ({_FW}) AND length(src) >= 2 AND length(tgt) >= 2)
SELECT (SELECT CAST(sum(cnt) AS BIGINT) FROM counts) AS alignments_before, (SELECT count(DISTINCT src) FROM counts) AS words_before, CAST(sum(cnt) AS BIGINT) AS alignments_after, count(DISTINCT src) AS words_after, (SELECT CAST(sum(cnt) AS BIGINT) FROM counts) - CAST(sum(cnt) AS BIGINT) AS filtered FROM k""")
def alignment_counters(spark, sf_dir):
    pairs = dictionary_pairs(spark, sf_dir)
    return dictionary.alignment_counters(pairs, dictionary.without_function_words(pairs))


_DROPPED = f"""{_LINES}, x AS (SELECT p_partkey, i, tags[i] AS t FROM (SELECT *, unnest(range(1, 5)) AS i FROM lines)),
k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY {_PRIO.format(t='t')}, i) AS rk FROM x WHERE t NOT IN ('', 'PUNC'))"""


@query(f"WITH {_DROPPED} SELECT t AS tag, count(*) AS cnt, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percentage FROM k WHERE rk > 2 GROUP BY t")
def dropped_tag_shares(spark, sf_dir):
    found = gloss_lines(spark, sf_dir).select(F.explode(gloss.dropped_tags(gloss.tags(F.col("token")), 2)).alias("tag"))
    return corpus.shares(found, "tag").withColumn("percentage", F.round("percentage", 6))


@query(f"WITH {_DROPPED} SELECT t AS tag, count(*) AS cnt, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percentage FROM k WHERE rk <= 2 GROUP BY t ORDER BY cnt DESC, tag LIMIT 10")
def simplified_tag_shares(spark, sf_dir):
    found = gloss_lines(spark, sf_dir).select(F.explode(gloss.top_tags(gloss.tags(F.col("token")), 2)).alias("tag")).where(~F.col("tag").isin(*gloss.IGNORED))
    return corpus.shares(found, "tag").withColumn("percentage", F.round("percentage", 6)).orderBy(F.desc("cnt"), "tag").limit(10)


@query(f"WITH {_DROPPED} SELECT count(DISTINCT t) AS before, count(DISTINCT t) FILTER (rk <= 2) AS after FROM k")
def distinct_tags(spark, sf_dir):
    lines = gloss_lines(spark, sf_dir)
    one = lambda c, name: lines.select(F.explode(c).alias("t")).where(~F.col("t").isin(*gloss.IGNORED)).agg(F.count_distinct("t").alias(name))
    return one(gloss.tags(F.col("token")), "before").join(one(gloss.top_tags(gloss.tags(F.col("token")), 2), "after"))


@query("""
WITH c AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source), w AS (SELECT 'src' || (n_nationkey * 2) AS source FROM nation), m AS (SELECT c.n, w.source AS w FROM c FULL JOIN w USING (source))
SELECT count(n) AS keys, count(w) AS wanted, count(*) FILTER (n IS NOT NULL AND w IS NOT NULL) AS found, CAST(coalesce(sum(n) FILTER (w IS NOT NULL), 0) AS BIGINT) AS rows_found, CAST(sum(n) AS BIGINT) AS rows,
  round(100.0 * count(*) FILTER (n IS NOT NULL AND w IS NOT NULL) / count(w), 6) AS keys_percent, round(100.0 * coalesce(sum(n) FILTER (w IS NOT NULL), 0) / sum(n), 6) AS rows_percent FROM m
""")
def key_summary(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), (F.col("n_nationkey") * 2).cast("string")).alias("source"))
    out = corpus.key_summary(table(spark, sf_dir, "documents"), wanted, "source")
    return out.select("keys", "wanted", "found", "rows_found", "rows", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("keys_percent", "rows_percent")))


@query("""
SELECT lang AS key, coalesce(lang IN ('es', 'fr'), false) AS special, count(*) AS cnt FROM documents GROUP BY ALL UNION ALL SELECT NULL, coalesce(lang IN ('es', 'fr'), false), count(*) FROM documents GROUP BY 2
""")
def group_subtotals(spark, sf_dir):
    return corpus.subtotals(table(spark, sf_dir, "documents"), "lang", F.col("lang").isin("es", "fr")).select("key", "special", "cnt")


@query("""
SELECT min(doc_id) AS first_id, count(*) AS cnt, string_agg(coalesce(source, '') || ':' || doc_id, ' ' ORDER BY doc_id) AS places FROM documents GROUP BY text HAVING count(*) > 1
""")
def duplicate_occurrences(spark, sf_dir):
    rows = dedup.occurrence_lists(table(spark, sf_dir, "documents"), ["doc_id", "source"], dedup.key_hash("text"), 1_000_000)
    place = lambda p: F.concat(F.coalesce(p["source"], F.lit("")), F.lit(":"), p["doc_id"].cast("string"))
    return rows.select(F.col("first.doc_id").alias("first_id"), "cnt", F.array_join(F.transform("places", place), " ").alias("places"))


@query("""
WITH c AS (SELECT text, count(*) AS n FROM documents GROUP BY text) SELECT CAST(sum(n) AS BIGINT) AS entries, count(*) AS uniq, count(*) FILTER (n > 1) AS duplicated, CAST(sum(n - 1) AS BIGINT) AS excess FROM c
""")
def duplicated_keys(spark, sf_dir):
    return dedup.duplicated_keys(table(spark, sf_dir, "documents"), "doc_id", dedup.key_hash("text"))


@query("SELECT md5(left(text, 200)) AS md5, count(*) AS cnt, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_by_start_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.left("text", F.lit(200)).cast("binary")).alias("md5")).agg(F.count("*").alias("cnt"), F.min("doc_id").alias("first_id")).where("cnt > 1")


@query("""
SELECT split, doc_id, lang FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'eval' ELSE 'other' END AS split, doc_id, lang FROM documents) WHERE split IN ('train', 'eval', 'test') ORDER BY list_position(['train', 'eval', 'test'], split), doc_id LIMIT 1
""")
def sample_with_fallback(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 3 == 0, "test").when(F.col("doc_id") % 3 == 1, "eval").otherwise("other"))
    return corpus.first_of_splits(docs, "split", ("train", "eval", "test"), ["doc_id"], ["doc_id", "lang"])


@query("""
SELECT count(*) FILTER (trim(coalesce(text, '')) <> '' AND trim(coalesce(source, '')) <> '') AS kept, count(*) FILTER (NOT (trim(coalesce(text, '')) <> '' AND trim(coalesce(source, '')) <> '')) AS skipped FROM documents
""")
def kept_and_skipped(spark, sf_dir):
    return corpus.kept_and_skipped(table(spark, sf_dir, "documents"), ["text", "source"])


@query("""
SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(trim(text, ' \t\n\r'), '\\s+'), lambda t: t <> '' AND NOT contains('.,!?;:-—()"''', t)), ' ') AS line FROM conversations
""")
def without_marks(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.filter(text.tokens(F.col("text")), lambda t: ~text.is_skipped_mark(t)), " ").alias("line"))


# -- dictionaries and lemmas ------------------------------------------------------------------------

_CASED = """cp AS (SELECT u.conv_id, u.turn, regexp_extract_all(u.text, '[\\p{L}\\p{N}_]+') AS src, regexp_extract_all(a.text, '[\\p{L}\\p{N}_]+') AS tgt
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
cc AS (SELECT src[i] AS s, tgt[i] AS t, count(*) AS cnt, min(conv_id * 1000000000 + turn * 1000000 + i) AS seen FROM (SELECT *, unnest(range(1, least(len(src), len(tgt)) + 1)) AS i FROM cp) GROUP BY ALL),
cb AS (SELECT s, arg_min(t, (-cnt, seen, t)) AS t, min(seen) AS seen FROM cc GROUP BY s)"""


def cased_entries(spark, sf_dir) -> DataFrame:
    words = lambda c: F.regexp_extract_all(F.col(c), F.lit(f"({text.WORD})"), F.lit(1))
    lines = raw_pairs(spark, sf_dir).select("conv_id", "turn", words("src").alias("src"), words("tgt").alias("tgt"))
    lines = lines.withColumn("alignment", dictionary.monotone(F.col("src"), F.col("tgt")))
    pairs = dictionary.count_pairs(dictionary.aligned_words(lines, ["conv_id", "turn"], "src", "tgt", "alignment"), ["conv_id", "turn", "pos"])
    return dictionary.best_translation(pairs)


@query(f"WITH {_CASED} SELECT lower(s) AS low, arg_max(t, (seen, s)) AS folded, count(*) AS spellings FROM cb GROUP BY 1")
def case_folded_entries(spark, sf_dir):
    entries = cased_entries(spark, sf_dir)
    counts = entries.groupBy(text.turkish_lower(F.col("src")).alias("low")).agg(F.count("*").alias("spellings"))
    return dictionary.case_folded(entries).join(counts, "low").select("low", "folded", "spellings")


@query(f"""
WITH {_BEST}, l AS (SELECT src AS word, tgt AS lemma FROM best WHERE src <> tgt AND length(src) > 1),
w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM benchmark), x AS (SELECT w.word, lower(w.word) AS low, l.lemma AS known FROM w LEFT JOIN l ON l.word = lower(w.word))
SELECT word, coalesce(known, CASE WHEN low LIKE '%s' AND low NOT LIKE '%ss' AND length(low) > 3 THEN left(low, length(low) - 1) WHEN low LIKE '%ed' AND length(low) > 4 THEN left(low, length(low) - 2) WHEN low LIKE '%ing' AND length(low) > 5 THEN left(low, length(low) - 3) ELSE low END) AS lemma, coalesce(known, low) AS plain FROM x
""")
def lemma_lookup(spark, sf_dir):
    entries = dictionary.best_translation(dictionary_pairs(spark, sf_dir)).select("src", "tgt", F.lit(0).alias("line_no"))
    lemmas = lookup.lemma_entries(entries)
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(f"({text.WORD})"), F.lit(1))).alias("word")).distinct()
    plain = lookup.with_lemmas(words, lemmas, rules=False).withColumnRenamed("lemma", "plain")
    return lookup.with_lemmas(plain, lemmas).select("word", "lemma", "plain")


_RULE = "CASE WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN left(w, length(w) - 1) WHEN w LIKE '%ed' AND length(w) > 4 THEN left(w, length(w) - 2) WHEN w LIKE '%ing' AND length(w) > 5 THEN left(w, length(w) - 3) ELSE w END"


@query(f"""
WITH {_PARALLEL}, x AS (SELECT conv_id, turn, src, tgt, i, src[i] AS w FROM (SELECT *, unnest(range(1, len(src) + 1)) AS i FROM pairs)),
m AS (SELECT *, CASE WHEN len(src) = len(tgt) THEN tgt[list_max([j FOR j IN range(1, len(src) + 1) IF src[j] = w])] WHEN i <= len(tgt) THEN tgt[i] ELSE {_RULE} END AS lemma FROM x)
SELECT conv_id, turn, count(*) AS n, any_value(len(src) = len(tgt)) AS equal, count(*) FILTER (i > len(tgt)) AS beyond, md5(string_agg(lemma, ' ' ORDER BY i)) AS lemmas_md5 FROM m GROUP BY conv_id, turn
""")
def positional_lemmas(spark, sf_dir):
    """The other side's words as lemmas: by word where the sides are equally long, else by place, and by
    rule beyond the end."""
    rows = parallel(spark, sf_dir).where(F.size("src") > 0)
    lemmas = alignment.positional_lemmas(F.col("src"), F.col("tgt"), gloss.english_lemma)
    beyond = F.greatest(F.size("src") - F.size("tgt"), F.lit(0)).cast("long")
    return rows.select("conv_id", "turn", F.size("src").cast("long").alias("n"), (F.size("src") == F.size("tgt")).alias("equal"), beyond.alias("beyond"), F.md5(F.array_join(lemmas, " ").cast("binary")).alias("lemmas_md5"))


@query(f"""
WITH {_BEST}, d AS (SELECT src, tgt, cnt, row_number() OVER (ORDER BY src) AS ord FROM best WHERE cnt >= 2),
a AS (SELECT conv_id, turn, i, src[i] AS token, tgt FROM (SELECT *, unnest(range(1, len(src) + 1)) AS i FROM pairs)),
m AS (SELECT a.conv_id, a.turn, a.i, a.token, d.src, d.tgt AS t, CASE WHEN d.src = a.token THEN 0 ELSE 1 END AS rank, ord FROM a JOIN d ON (d.src = a.token OR length(d.src) > 2 AND (starts_with(a.token, d.src) OR starts_with(d.src, a.token))) AND list_contains(a.tgt, d.tgt)),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, i ORDER BY rank, ord) AS rk FROM m)
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, token, src, t AS tgt, CASE WHEN rank = 0 THEN 'exact' ELSE 'prefix' END AS how FROM b WHERE rk = 1
""")
def sentence_alignments(spark, sf_dir):
    entries = dictionary.best_translation(dictionary_pairs(spark, sf_dir)).where("cnt >= 2").select(F.col("src").alias("ord"), "src", "tgt")
    rows = parallel(spark, sf_dir).select("conv_id", "turn", F.col("src").alias("words"), F.col("tgt").alias("others"))
    return lookup.sentence_matches(rows, entries, ["conv_id", "turn"])


@query(f"""
WITH asked AS (SELECT DISTINCT n FROM (SELECT n_name || ' tongue' AS n FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT 'speech of ' || n_name FROM nation UNION ALL SELECT 'Japhug')),
ref AS (SELECT p_partkey AS ord, split_part(p_type, ' ', 1) || ' ' || (SELECT n_name FROM nation WHERE n_nationkey = p_partkey % 25) AS r, 'p' || p_partkey AS code FROM part),
hits AS (SELECT n, arg_min(code, (rank, ord)) AS code, min(rank) AS rank FROM (SELECT n, code, ord, CASE WHEN lower(n) = lower(r) THEN 1 WHEN contains(lower(n), lower(r)) OR contains(lower(r), lower(n)) THEN 2 WHEN len(list_filter(string_split_regex(lower(n), '\\s+'), lambda w: length(w) > 6 AND contains(lower(r), w))) > 0 THEN 3 END AS rank FROM asked, ref) WHERE rank < 3 GROUP BY n),
c AS (SELECT a.n, arg_min(x.code, n_nationkey) AS code FROM asked a JOIN nation ON contains(lower(a.n), lower(n_name)) JOIN (SELECT n_nationkey AS k, arg_min(code, ord) AS code FROM nation JOIN ref ON contains(lower(r), lower(n_name)) GROUP BY 1) x ON x.k = n_nationkey GROUP BY a.n),
w AS (SELECT n, arg_min(code, ord) AS code FROM asked, ref WHERE len(list_filter(string_split_regex(lower(n), '\\s+'), lambda w: length(w) > 3 AND contains(lower(r), w))) > 0 GROUP BY n)
SELECT a.n AS name, CASE WHEN a.n = 'Japhug' THEN 'jya' ELSE coalesce(h.code, w.code, c.code, lower(left(regexp_replace(a.n, '[^a-zA-Z]', '', 'g'), 3))) END AS code,
  CASE WHEN a.n = 'Japhug' THEN 'manual' ELSE coalesce(['exact', 'contains'][h.rank], CASE WHEN w.code IS NOT NULL THEN 'word' END, CASE WHEN c.code IS NOT NULL THEN 'country' END, 'fallback') END AS method
FROM asked a LEFT JOIN hits h ON h.n = a.n LEFT JOIN w ON w.n = a.n LEFT JOIN c ON c.n = a.n
""")
def name_match_countries(spark, sf_dir):
    nation, region, part = (table(spark, sf_dir, t) for t in ("nation", "region", "part"))
    one = lambda df, c: df.select(c.alias("name"))
    names = one(nation, F.concat("n_name", F.lit(" tongue"))).union(one(region, F.col("r_name"))).union(one(nation, F.concat(F.lit("speech of "), "n_name"))).union(one(region.limit(1), F.lit("Japhug")))
    few = part.join(F.broadcast(nation), F.col("n_nationkey") == F.col("p_partkey") % 25)
    ref = few.select(F.col("p_partkey").alias("ord"), F.concat(F.get(F.split("p_type", " "), F.lit(0)), F.lit(" "), "n_name").alias("name"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("code"))
    return lookup.resolve_names(names, ref, countries=nation.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name")))


# -- Turkish words ----------------------------------------------------------------------------------

_SPELL = """list_concat(CASE WHEN {h} = 0 THEN [] WHEN {h} = 1 THEN ['yüz'] ELSE [u[{h} + 1], 'yüz'] END, CASE WHEN {t} = 0 THEN [] ELSE [t[{t}]] END, CASE WHEN {d} = 0 THEN [] ELSE [u[{d} + 1]] END)"""


def _spell(n: str) -> str:
    return _SPELL.format(h=f"(({n}) // 100)", t=f"((({n}) // 10) % 10)", d=f"(({n}) % 10)")


@query(f"""
WITH w AS (SELECT p_partkey, p_partkey * 37 AS n, [{', '.join(repr(x) for x in phonology.UNITS)}] AS u, [{', '.join(repr(x) for x in phonology.TENS)}] AS t FROM part),
g AS (SELECT p_partkey, n, list_concat(CASE n // 1000000 WHEN 0 THEN [] ELSE list_concat({_spell('n // 1000000')}, ['milyon']) END, CASE n // 1000 % 1000 WHEN 0 THEN [] WHEN 1 THEN ['bin'] ELSE list_concat({_spell('n // 1000 % 1000')}, ['bin']) END, {_spell('n % 1000')}) AS l FROM w)
SELECT p_partkey, CASE WHEN n = 0 THEN 'sıfır' ELSE array_to_string(l, ' ') END AS spelled, CAST(n AS BIGINT) AS value FROM g
""")
def number_words(spark, sf_dir):
    words = phonology.spelled_number(F.col("p_partkey") * 37)
    return table(spark, sf_dir, "part").select("p_partkey", words.alias("w")).select("p_partkey", F.array_join("w", " ").alias("spelled"), phonology.number_value(F.col("w")).alias("value"))


_MARKS = ", ".join(repr(x) for x in phonology.SENTENCE_ENDS)
_QUOTED = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


@query(f"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '{phonology.PLAIN_TOKEN.replace("'", "''")}') AS t FROM conversations),
o AS (SELECT *, coalesce(list_position(list_transform(t, lambda x: x IN ({_QUOTED(phonology.OPENING)})), true), 0) AS first FROM t)
SELECT conv_id, turn, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5,
  len([i FOR i IN range(1, len(t) + 1) IF t[i] IN ({_MARKS}) AND NOT (i > 1 AND regexp_full_match(t[greatest(i - 1, 1)], '[0-9]+')) AND NOT (i < len(t) AND t[i + 1] IN ({_QUOTED(phonology.CLOSING)}) AND first > 0 AND first <= i - 1) AND NOT (i < len(t) AND t[i + 1] IN ({_MARKS}))]) AS n_ends FROM o
""")
def sentence_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", phonology.sentence_tokens(F.col("text"), initials=False).alias("t"))
    found = rows.select("conv_id", "turn", "t", phonology.sentences(F.col("t")).alias("s"))
    ends = F.size(F.filter("s", lambda x: F.element_at(x, -1).isin(*phonology.SENTENCE_ENDS))) - F.when((F.size("t") > 0) & F.col("open"), 1).otherwise(0)
    # a last sentence may end in a mark that ends none, after a number
    last = F.element_at("t", -1)
    spared = F.when(F.size("t") > 1, F.get("t", F.size("t") - 2).rlike("^[0-9]+$") & last.isin(*phonology.SENTENCE_ENDS)).otherwise(False)
    return found.withColumn("open", spared).select("conv_id", "turn", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"), ends.cast("long").alias("n_ends"))


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents)
SELECT w AS word, upper(replace(left(w, 1), 'i', 'İ')) || substr(w, 2) AS first, upper(replace(w, 'i', 'İ')) AS whole, translate(w, 'âîûÂÎÛ', 'aiuAİU') AS plain, translate(w, 'âîûÂÎÛçğıöşüÇĞİÖŞÜ', 'aiuAIUcgiosuCGIOSU') AS ascii FROM w WHERE regexp_full_match(w, '[a-zçğıöşüâîû]+')
""")
def case_variants(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(text.word_tokens(F.col("text"))).alias("word")).distinct().where(F.col("word").rlike("^[a-zçğıöşüâîû]+$"))
    return words.select("word", *(c.alias(n) for n, c in phonology.spellings(F.col("word")).items()))


@query()
def word_sounds(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(text.word_tokens(F.col("text"))).alias("word")).distinct()
    return words.where(F.col("word").rlike("^[a-zçğıöşüâîû]+$")).select("word", phonology.sounds(F.col("word")).alias("sounds"))


# -- documents and places ---------------------------------------------------------------------------


@query("SELECT item_id, coalesce(nullif(trim(text), ''), 'none') AS answer, 'none' AS missing, lower(text) AS folded, row_number() OVER (ORDER BY lower(text), item_id) AS place FROM benchmark")
def nested_fields(spark, sf_dir):
    """Fields of JSON documents with defaults, and places in an order that takes no heed of case,
    which are counted by range and not in one task."""
    items = table(spark, sf_dir, "benchmark")
    documents = items.select("item_id", F.lower("text").alias("folded"), F.to_json(F.struct(F.struct(F.trim("text").alias("generated")).alias("result"))).alias("d"))
    made = documents.select("item_id", "folded", parse.nested(F.col("d"), "$.result.generated", "none").alias("answer"), parse.nested(F.col("d"), "$.result.score", "none").alias("missing"))
    return sorted_places(made, ["folded", "item_id"], "place")


# -- smaller reports ----------------------------------------------------------------------------------


@query(f"WITH {_COUNTS} SELECT src, tgt, cnt FROM counts ORDER BY cnt DESC, src, tgt LIMIT 50")
def most_frequent_alignments(spark, sf_dir):
    return dictionary_pairs(spark, sf_dir).select("src", "tgt", "cnt").orderBy(F.desc("cnt"), "src", "tgt").limit(50)


@query(f"WITH {_COUNTS}, w AS (SELECT src, count(*) AS n FROM counts GROUP BY src) SELECT count(*) AS words, count(*) FILTER (n > 1) AS ambiguous, round(avg(n), 6) AS mean_translations, max(n) AS most FROM w")
def alignment_quality(spark, sf_dir):
    return dictionary.quality(dictionary_pairs(spark, sf_dir)).withColumn("mean_translations", F.round("mean_translations", 6))


@query(f"WITH {_LINES} SELECT t AS tag, count(*) AS cnt FROM (SELECT unnest(tags) AS t FROM lines) WHERE t NOT IN ('', 'PUNC') GROUP BY t")
def gloss_tag_frequency(spark, sf_dir):
    """Lines of a language code, which may look like a token, and one token."""
    lines = gloss_lines(spark, sf_dir).select(F.concat_ws(" ", F.lit("tur-PL"), "token").alias("line"))
    return gloss_counts(lines)


def gloss_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """Tags of all tokens but a line's first, which is its language code, counted."""
    found = lines.select(F.explode(F.flatten(F.transform(F.slice(text.tokens(F.col(line)), F.lit(2), F.greatest(F.size(text.tokens(F.col(line))), F.lit(1))), gloss.tags))).alias("tag"))
    return found.where(~F.col("tag").isin(*gloss.IGNORED)).groupBy("tag").agg(F.count("*").alias("cnt"))


@query("SELECT round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, count(quality) AS n_quality, count(toxic) AS n_toxic FROM documents LEFT JOIN labels USING (doc_id)")
def metric_means(spark, sf_dir):
    return evaluation.means(docs_labels(spark, sf_dir), ["quality", "toxic"]).select(F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"), "n_quality", "n_toxic")


@query("SELECT source, count(*) AS cnt FROM documents WHERE source IN (SELECT 'src' || (n_nationkey * 2) FROM nation) GROUP BY source")
def common_keys(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), (F.col("n_nationkey") * 2).cast("string")).alias("source"))
    return table(spark, sf_dir, "documents").join(wanted.distinct(), "source", "left_semi").groupBy("source").agg(F.count("*").alias("cnt"))


@query("SELECT lang, source, count(*) AS cnt FROM documents WHERE coalesce(lang, '') NOT IN ('es', 'fr') GROUP BY ALL ORDER BY cnt DESC, source DESC, lang LIMIT 20")
def top_other_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(~F.coalesce("lang", F.lit("")).isin("es", "fr"))
    return rows.groupBy("lang", "source").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), F.desc_nulls_first("source"), "lang").limit(20)


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def first_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").orderBy("doc_id").limit(5)


@query("""
WITH a AS (SELECT DISTINCT n FROM (SELECT r_name AS n FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT split_part(p_type, ' ', 1) FROM part)),
h AS (SELECT n, arg_min(n_name, (CASE WHEN lower(n) = lower(n_name) THEN 1 ELSE 2 END, n_nationkey)) AS m FROM a JOIN nation ON contains(lower(n), lower(n_name)) OR contains(lower(n_name), lower(n)) GROUP BY n)
SELECT a.n AS name, m AS matched, m IS NULL AS unmatched FROM a LEFT JOIN h ON h.n = a.n
""")
def name_matches(spark, sf_dir):
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("name")).union(table(spark, sf_dir, "nation").select("n_name")).union(table(spark, sf_dir, "part").select(F.get(F.split("p_type", " "), F.lit(0))))
    return lookup.match_names(names, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("r_name")))


_APPLIED_TURNS = _APPLIED.replace("SELECT doc_id, trim(text, ' \t\n\r') AS text", "SELECT conv_id * 1000 + turn AS doc_id, trim(text, ' \t\n\r') AS text").replace("FROM documents)),\nb AS", "FROM conversations)),\nb AS")


@query(f"""
WITH {_APPLIED_TURNS} SELECT count(*) AS total_words, count(*) FILTER (how <> 'kept') AS replaced, count(DISTINCT CASE WHEN how = 'exact' THEN w END) AS used_exact, round(100.0 * count(DISTINCT CASE WHEN how = 'exact' THEN w END) / (SELECT count(*) FROM d), 6) AS usage_rate FROM o
""")
def dictionary_usage(spark, sf_dir):
    entries = dictionary.best_translation(dictionary_pairs(spark, sf_dir)).where("cnt >= 2")
    turns = table(spark, sf_dir, "conversations").withColumn("line", F.col("conv_id") * 1000 + F.col("turn"))
    out = dictionary.coverage(dictionary.translated_tokens(turns, entries, "line", F.col("text")), entries.count())
    return out.select("total_words", "replaced", "used_exact", F.round(F.col("usage_rate").cast("double"), 6).alias("usage_rate"))


@query(f"""
WITH {_APPLIED_TURNS} SELECT w AS word, arg_max(r, doc_id * 100000 + i) AS out FROM o WHERE how IN ('exact', 'folded') GROUP BY w
""")
def replaced_words(spark, sf_dir):
    entries = dictionary.best_translation(dictionary_pairs(spark, sf_dir)).where("cnt >= 2")
    turns = table(spark, sf_dir, "conversations").withColumn("line", F.col("conv_id") * 1000 + F.col("turn"))
    return dictionary.replacements(dictionary.translated_tokens(turns, entries, "line", F.col("text")), "line")[0]
