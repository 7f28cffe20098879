"""Lookups by priority: exact, containment, prefixes. Theta joins run on distinct keys, through
shared grams, prefixes or targets, never row against row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.gloss import english_lemma
from lexloom.functions.text import fallback_code
from lexloom.operators.sizes import broadcast_if_small
from lexloom.operators.staging import written

#: Names that no method would resolve, and their codes.
KNOWN_CODES = {"Unknown language": "und", "Japhug": "jya", "Sanzhi": "xzr", "Pichi": "fpe", "Tsez": "ddo"}


#: Letters of the grams by which containment is looked up.
GRAM = 3


def _grams(c: str, n: Column | str) -> Column:
    """The distinct substrings of a text that have so many letters."""
    return F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(F.col(c), i, n))))


def contained(parts: DataFrame, wholes: DataFrame, q: int = GRAM) -> DataFrame:
    """(part, whole): for distinct texts, each part that is not empty with the wholes that it is in.
    Wholes are indexed by their grams; a part is looked up by one gram, the rarest of its own of
    ``q`` letters (or, if it is shorter, by itself), and what meets there is verified. So rows that
    meet are, for each part, as many as the wholes that have its rarest gram."""
    n = F.least(F.length("part"), F.lit(q))
    asked = parts.select("part").where("part <> ''").distinct().select("part", n.alias("n"), _grams("part", n).alias("gram"))
    lengths = F.array(*(F.lit(i) for i in range(1, q + 1)))
    by_length = wholes.select("whole").where("whole is not null").distinct().select("whole", F.explode(lengths).alias("n")).where(F.col("n") <= F.length("whole"))
    grams = by_length.select("whole", "n", _grams("whole", F.col("n")).alias("gram"))
    wanted = grams.join(asked.select("n").distinct(), "n", "left_semi").join(asked.select("gram").distinct(), "gram", "left_semi")
    index = written(wanted.select("gram", "whole"), "grams")
    counts = index.groupBy("gram").agg(F.count("*").alias("c"))
    # a gram that no whole has rules its part out, and comes first as null
    rarest = asked.join(counts, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "gram")).alias("g")).where("g.c > 0")
    return rarest.select("part", F.col("g.gram").alias("gram")).join(index, "gram").where(F.contains("whole", F.col("part"))).select("part", "whole")


def _first_entries(asked: DataFrame, ref: DataFrame, words: bool) -> DataFrame:
    """(low, best): for distinct lower-cased names the least of (rank, ord) of the entries (r, e) that
    each has: 1 equal, 2 one in the other, 3 a word of more than three letters in the entry. e is the
    first entry of its name r, a struct that begins with ord."""
    lows, rs = asked.select("low").where("low is not null").distinct(), ref.where("r is not null")
    equal = lows.select("low", F.col("low").alias("r"), F.lit(1).alias("rank"))
    parts = lambda df, c: df.select(F.col(c).alias("part"))
    wholes = lambda df, c: df.select(F.col(c).alias("whole"))
    longer = contained(parts(rs, "r"), wholes(lows, "low")).select(F.col("whole").alias("low"), F.col("part").alias("r"), F.lit(2).alias("rank"))
    shorter = contained(parts(lows, "low"), wholes(rs, "r")).select(F.col("part").alias("low"), F.col("whole").alias("r"), F.lit(2).alias("rank"))
    met = equal.unionByName(longer).unionByName(shorter)
    if words:
        each = lows.select("low", F.explode(F.array_distinct(F.split("low", r"\s+"))).alias("part")).where(F.length("part") > 3)
        by_word = contained(each.select("part"), wholes(rs, "r")).join(each, "part")
        met = met.unionByName(by_word.select("low", F.col("whole").alias("r"), F.lit(3).alias("rank")))
    best = F.min(F.struct("rank", "e")).alias("best")
    found = met.join(rs, "r").groupBy("low").agg(best)
    # an empty text is in every other: of entries one row stands for that, of names that with no letters
    ends = rs.agg(F.min("e").alias("first"), F.min(F.when(F.col("r") == "", F.col("e"))).alias("empty")).first()
    if ends["first"] is None:
        return found
    kind = rs.schema["e"].dataType
    lit = lambda row: F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind.fields, strict=True)))
    extra = [lows.where("low = ''").select("low", F.struct(F.lit(2).alias("rank"), lit(ends["first"]).alias("e")).alias("best"))]
    if ends["empty"] is not None:
        extra.append(lows.where("low <> ''").select("low", F.struct(F.lit(2).alias("rank"), lit(ends["empty"]).alias("e")).alias("best")))
    for one in extra:
        found = found.unionByName(one)
    return found.groupBy("low").agg(F.min("best").alias("best"))


def resolve_names(names: DataFrame, table: DataFrame, known: dict[str, str] | None = None, countries: DataFrame | None = None) -> DataFrame:
    """For distinct names and a reference table (ord, name, code): name, code, method: manual,
    exact, contains (either way, first of the table), word (of more than three letters), country (a
    name of ``countries`` (ord, name) in it that an entry of the table has in its name as well) or
    fallback. Names meet entries by grams (``contained``), so neither side has to be small."""
    known = KNOWN_CODES if known is None else known
    manual = F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), F.col("name")) if known else F.lit(None).cast("string")
    asked = written(names.select("name").distinct().withColumn("low", F.lower("name")), "names")
    ref = written(table.groupBy(F.lower("name").alias("r")).agg(F.min(F.struct("ord", "code")).alias("e")), "entries")
    hits = asked.join(_first_entries(asked, ref, words=True), "low", "left")
    if countries is not None:
        c = countries.groupBy(F.lower("name").alias("c")).agg(F.min("ord").alias("c_ord")).where("c <> ''")
        parts = c.select(F.col("c").alias("part"))
        spoken = contained(parts, ref.select(F.col("r").alias("whole"))).join(ref.withColumnRenamed("r", "whole"), "whole").groupBy("part").agg(F.min("e").alias("e"))
        spoken = spoken.join(c.withColumnRenamed("c", "part"), "part")
        by_country = contained(spoken.select("part"), asked.select(F.col("low").alias("whole"))).join(spoken, "part").groupBy(F.col("whole").alias("low")).agg(F.min_by("e.code", "c_ord").alias("c_code"))
        hits = hits.join(by_country, "low", "left")
    else:
        hits = hits.withColumn("c_code", F.lit(None).cast("string"))
    label = F.when(F.col("best.rank").isNotNull(), F.element_at(F.array(F.lit("exact"), F.lit("contains"), F.lit("word")), F.col("best.rank")))
    method = F.when(manual.isNotNull(), "manual").otherwise(F.coalesce(label, F.when(F.col("c_code").isNotNull(), "country"), F.lit("fallback")))
    return hits.select("name", F.coalesce(manual, "best.e.code", "c_code", fallback_code(F.col("name"))).alias("code"), method.alias("method"))


def match_names(names: DataFrame, table: DataFrame) -> DataFrame:
    """(name, matched, unmatched): for distinct names the entry of the table (ord, r_name) that is
    equal but for case, else the first that has it in its name, or the other way round."""
    asked = written(names.select("name").distinct().withColumn("low", F.lower("name")), "names")
    ref = written(table.groupBy(F.lower("r_name").alias("r")).agg(F.min(F.struct("ord", "r_name")).alias("e")), "entries")
    hits = asked.join(_first_entries(asked, ref, words=False), "low", "left")
    return hits.select("name", F.col("best.e.r_name").alias("matched"), F.col("best").isNull().alias("unmatched"))


def mapped(df: DataFrame, mapping: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """A left lookup with a default."""
    return df.join(mapping.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def prefix_matches(words: DataFrame, keys: DataFrame, least: int = 3) -> DataFrame:
    """For each word, the first key (by ord) of which one is the other's prefix. Both sides meet on
    equal prefixes: a word's against whole keys, and a key's against whole words."""
    prefixes = lambda c: F.explode(F.transform(F.sequence(F.lit(least), F.greatest(F.length(c), F.lit(least))), lambda n: F.left(F.col(c), n)))
    w, k = words.select("word").distinct().where(F.length("word") >= least), keys.select("ord", "key").where(F.length("key") >= least)
    longer = w.select("word", prefixes("word").alias("key")).join(k, "key").select("word", "ord", "key")
    shorter = k.select("ord", "key", prefixes("key").alias("word")).join(w, "word").select("word", "ord", "key")
    return longer.union(shorter).groupBy("word").agg(F.min_by("key", "ord").alias("key"), F.min("ord").alias("ord"))


def last_wins(pairs: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.max_by(value, order).alias(value))


def lemma_pairs(df: DataFrame, order: str, inflected: str, lemmas: str) -> DataFrame:
    """Inflected word and lemma of lines whose token lists are equally long; the last wins."""
    rows = df.where(F.size(inflected) == F.size(lemmas)).select(order, F.explode(F.arrays_zip(F.col(inflected).alias("a"), F.col(lemmas).alias("b"))).alias("z"))
    return last_wins(rows.select(order, F.col("z.a").alias("word"), F.col("z.b").alias("lemma")), "word", "lemma", order)


def lemma_entries(rows: DataFrame) -> DataFrame:
    """(word, lemma) in lower case of dictionary rows (line_no, src, tgt): what is its own lemma, or
    one character long, is left out; the last line of a word wins."""
    kept = rows.where((F.col("src") != F.col("tgt")) & (F.length("src") > 1))
    return last_wins(kept.select("line_no", F.lower("src").alias("word"), F.lower("tgt").alias("lemma")), "word", "lemma", "line_no")


def with_lemmas(words: DataFrame, lemmas: DataFrame, word: str = "word", rules: bool = True) -> DataFrame:
    """Column lemma: the known lemma of the lower-cased word, else by English rules, or with
    ``rules`` off the word itself in lower case."""
    table, _ = broadcast_if_small(lemmas.select(F.col("word").alias("__low"), F.col("lemma").alias("__known")))
    met = words.withColumn("__low", F.lower(word)).join(table, "__low", "left")
    lemma = english_lemma(F.col(word), F.col("__known")) if rules else F.coalesce("__known", "__low")
    return met.withColumn("lemma", lemma).drop("__low", "__known")


#: Targets of one token that stand for it; a token with more is looked up from the other side.
TARGETS = 32


def sentence_matches(lines: DataFrame, dictionary: DataFrame, line: list[str], least: int = 3, most: int = TARGETS) -> DataFrame:
    """(line..., pos, token, src, tgt, how): for lines (line..., words, others), others being the
    lower-cased words of the other side, for each word the entry of the dictionary (ord, src, tgt)
    whose target is among the others: the word's own (exact), else the first of those of which one is
    the other's prefix (prefix).

    The dictionary becomes an index by what a token can meet it with, a whole source (0) or a
    beginning of one (1), and by target: of each only the first entry. Distinct tokens, not their
    occurrences, look themselves and their beginnings up in it. A token with ``most`` targets at most
    then meets each of a line's other words that way; one with more, as one letter has, is found from
    the other side, by the targets among the other words, each of which knows such tokens as a list. So
    no row is made for each pair of a token and an entry, nor for each pair of words of a line, and
    no line's words travel with each of its tokens."""
    beginnings = lambda c, a: F.explode(F.when(F.length(c) >= a, F.transform(F.sequence(F.lit(a), F.length(c)), lambda n: F.left(F.col(c), n))))
    entry = F.struct("ord", "src", "tgt").alias("e")
    keys = dictionary.select(F.lower("tgt").alias("t"), "src", entry).where("src is not null and t is not null")
    whole = keys.select(F.lit(0).alias("kind"), F.col("src").alias("probe"), "t", "e")
    begun = keys.where(F.length("src") >= least).select(F.lit(1).alias("kind"), beginnings("src", 1).alias("probe"), "t", "e")
    index = whole.unionByName(begun).groupBy("kind", "probe", "t").agg(F.min("e").alias("e"))

    words = lines.select(*line, F.explode(F.array_distinct("words")).alias("token")).where("token is not null")
    distinct = written(words.select("token").distinct(), "tokens")
    own = distinct.select("token", F.lit(0).alias("kind"), F.col("token").alias("probe"), F.lit(0).alias("rank"))
    longer = distinct.select("token", F.lit(0).alias("kind"), beginnings("token", least).alias("probe"), F.lit(1).alias("rank"))
    shorter = distinct.select("token", F.lit(1).alias("kind"), F.col("token").alias("probe"), F.lit(1).alias("rank"))
    probes = own.unionByName(longer).unionByName(shorter)
    able = written(probes.join(index, ["kind", "probe"]).groupBy("token", "t").agg(F.min(F.struct("rank", "e")).alias("b")), "candidates")
    sizes = able.groupBy("token").agg(F.count("*").alias("n"))
    few, many = sizes.where(F.col("n") <= most).select("token"), sizes.where(F.col("n") > most).select("token")

    targets, _ = broadcast_if_small(able.select("t").distinct())
    others = lines.select(*line, F.explode(F.array_distinct("others")).alias("t")).join(targets, "t", "left_semi")
    near = words.join(able.select("token", "t").join(few, "token"), "token").join(others, [*line, "t"])
    hot, _ = broadcast_if_small(many)
    here = words.join(hot, "token").groupBy(*line).agg(F.collect_list("token").alias("hot"))
    by_target, _ = broadcast_if_small(able.join(hot, "token").groupBy("t").agg(F.collect_list(F.struct("token", "b")).alias("able")))
    # the matches of a line stay lists until the first of each token is found
    some = F.filter("able", lambda x: F.array_contains("hot", x["token"])).alias("some")
    lists = others.join(here, line).join(by_target, "t").select(*line, some).where(F.size("some") > 0)
    sorted_ = lists.groupBy(*line).agg(F.sort_array(F.flatten(F.collect_list("some"))).alias("s"))
    firsts = F.filter("s", lambda x, i: (i == 0) | (x["token"] != F.get("s", F.greatest(i - 1, F.lit(0)))["token"]))
    far = sorted_.select(*line, F.inline(firsts))
    close = near.select(*line, "token", "t").join(able, ["token", "t"]).groupBy(*line, "token").agg(F.min("b").alias("b"))
    best = close.unionByName(far)  # a token is in one of them
    found = best.groupBy(*line).agg(F.collect_list(F.struct("token", "b")).alias("found"))
    each = lines.join(found, line).select(*line, "found", F.posexplode("words").alias("pos", "token"))
    own = F.get(F.filter("found", lambda f: f["token"] == F.col("token")), F.lit(0))["b"]
    out = each.select(*line, "pos", "token", own.alias("b")).where("b is not null")
    return out.select(*line, "pos", "token", "b.e.src", "b.e.tgt", F.when(F.col("b.rank") == 0, "exact").otherwise("prefix").alias("how"))
