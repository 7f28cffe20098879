"""Words as a stem and a chain of affixes, by continuation classes: segmentation, analysis, generation,
and guesses for unknown words.

A lexicon is a table of edges (class, affix, next): in ``class``, ``affix`` may come, and what follows
is in ``next``. Stems (stem, class) say where a chain begins, and a chain may end where a class has an
edge to ``END``, without an affix. Edges between classes without an affix are allowed as well. A
column ``tag`` says what an edge stands for in an analysis, whether or not it has an affix; without
that column the affix stands for itself. With affixes and tags exchanged (``inverted``), the same
lexicon reads analyses and writes words.

Segmentation is a fixpoint over states (word, at, class): from this class on, the rest of the word
after ``at`` letters can be read to its end. It goes from the ends of words backwards, one semi-naive
step for each affix of the longest chain: only states that are new go on, so a word has a state for
each of its places and classes at most, however many chains share them. What the steps leave is a
lattice that holds every segmentation and nothing that does not lead to one; ``segmentations`` walks
it from the stems, ``counted`` only counts. Steps are written tables, so plans stay short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import dotted_fold
from lexloom.operators.sizes import broadcast_if_small
from lexloom.operators.staging import written

START, END = "Root", "#"
#: Letters of stems, least and most, when a lexicon is learnt; the stems of guesses have 2 to 10.
SHORTEST, LONGEST = 3, 24
GUESS_SHORTEST, GUESS_LONGEST = 2, 10


def _tagged(edges: DataFrame) -> DataFrame:
    return edges.select("class", "affix", "next", F.coalesce("tag", F.lit("")).alias("tag") if "tag" in edges.columns else F.col("affix").alias("tag"))


def inverted(edges: DataFrame) -> DataFrame:
    """The lexicon that reads tags and writes affixes."""
    return _tagged(edges).select("class", F.col("tag").alias("affix"), "next", F.col("affix").alias("tag"))


def without_empty(edges: DataFrame) -> DataFrame:
    """(class, affix, next, tag): the same language without edges that have no affix, but for those to
    ``END``: what a class can reach without an affix becomes its own, and the tags on the way go before
    it. A fixpoint over the classes; tags on a cycle without affixes have no end, and are an error."""
    edges = _tagged(edges)
    links = written(edges.where((F.col("affix") == "") & (F.col("next") != END)).select(F.col("class").alias("a"), F.col("next").alias("b"), "tag").distinct(), "links")
    if links.isEmpty():
        return edges
    reached = fresh = links
    while True:
        if not fresh.where("a = b and tag <> ''").isEmpty():
            raise ValueError("classes that lead back to themselves by tags alone make endless analyses")
        step = fresh.withColumnRenamed("tag", "__tag").join(links.select(F.col("a").alias("b"), F.col("b").alias("c"), "tag"), "b").select("a", F.col("c").alias("b"), F.concat("__tag", "tag").alias("tag")).distinct()
        fresh = written(step.join(reached, ["a", "b", "tag"], "left_anti"), "links")
        if fresh.isEmpty():
            break
        reached = written(reached.union(fresh), "links")
    own = edges.where((F.col("affix") != "") | (F.col("next") == END))
    lent = reached.withColumnRenamed("tag", "__tag").join(own.withColumnRenamed("class", "b"), "b").select(F.col("a").alias("class"), "affix", "next", F.concat("__tag", "tag").alias("tag"))
    return own.unionByName(lent).distinct()


def learnt(words: DataFrame, per_mille: int, shortest: int = SHORTEST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(stems, edges) of distinct words (word): an ending is what stands after a word that is itself
    one of the words. Endings that at least ``per_mille`` of a thousand words have follow a stem, each in
    a class of its own; an ending may follow another where at least as many have both, the word with
    the first being a word too. So the number of edges is bounded by that share and by the letters of
    a stem, not by the words."""
    stems = words.where(F.length("word").between(shortest, longest)).select(F.col("word").alias("stem"))
    cut = lambda df, least: df.withColumn("k", F.explode(F.when(F.length("word") > least, F.sequence(least, F.least(F.length("word") - 1, F.lit(longest))))))
    split = cut(words.select("word"), F.lit(shortest)).select("word", F.left("word", F.col("k")).alias("stem"), F.substr("word", F.col("k") + 1).alias("ending"))
    split = written(split.join(stems, "stem"), "splits")
    enough = F.col("n") * 1000 >= per_mille * words.count()
    first = written(split.groupBy("ending").agg(F.count("*").alias("n")).where(enough), "endings")
    small, _ = broadcast_if_small(first.select("ending"))
    inner = split.join(small, "ending", "left_semi").select(F.col("word").alias("stem"), F.col("ending").alias("before"))
    second = split.join(inner, "stem").groupBy("before", "ending").agg(F.count("*").alias("n")).where(enough)
    one = first.select(F.lit(START).alias("class"), F.col("ending").alias("affix"), F.concat(F.lit("1:"), "ending").alias("next"))
    two = second.select(F.concat(F.lit("1:"), "before").alias("class"), F.col("ending").alias("affix"), F.lit("2").alias("next"))
    chain = one.unionByName(two)
    final = chain.select(F.col("next").alias("class")).union(words.sparkSession.createDataFrame([(START,)], "class string")).distinct()
    edges = chain.unionByName(final.select("class", F.lit("").alias("affix"), F.lit(END).alias("next")))
    return written(stems.withColumn("class", F.lit(START)), "stems"), written(edges, "edges")


def lattice(words: DataFrame, edges: DataFrame) -> DataFrame:
    """(word, at, class, affix, to, next, tag): every step of every way to the end of a word, read from
    its end. A state's rows come from one step of the fixpoint, so none is repeated."""
    edges = without_empty(edges)
    ends = edges.where((F.col("affix") == "") & (F.col("next") == END)).select(F.col("class").alias("next"), F.col("tag").alias("__end")).distinct()
    own = edges.where("affix <> ''")
    last = own.join(ends, "next").select("class", "affix", F.lit(END).alias("next"), F.concat("tag", "__end").alias("tag"))  # to a class that may end, so to the end
    table, _ = broadcast_if_small(own.unionByName(last).distinct())
    sizes = [r[0] for r in table.select(F.length("affix")).distinct().collect()]  # as many as affixes have lengths
    states = written(words.select("word", F.length("word").alias("at"), F.lit(END).alias("class")).distinct(), "states")
    seen, steps = states, None
    while True:
        pieces = states.select("word", F.col("at").alias("to"), F.col("class").alias("next"), F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>")).alias("k")).where("k < to")
        pieces = pieces.withColumn("affix", F.substr("word", F.col("to") - F.col("k") + 1, F.col("k")))
        step = written(pieces.join(table, ["affix", "next"]).select("word", (F.col("to") - F.col("k")).alias("at"), "class", "affix", "to", "next", "tag"), "lattice")
        steps = step if steps is None else steps.unionByName(step)
        states = written(step.select("word", "at", "class").distinct().join(seen, ["word", "at", "class"], "left_anti"), "states")
        if states.isEmpty():
            return steps
        seen = seen.unionByName(states)


def _begun(words: DataFrame, stems: DataFrame, edges: DataFrame, steps: DataFrame) -> DataFrame:
    """(word, at, class, stem, end): the stems of words from which the end can be reached, with the tags
    of those that are whole words."""
    ends = without_empty(edges).where((F.col("affix") == "") & (F.col("next") == END)).select("class", F.col("tag").alias("end")).distinct()
    inner = steps.select("word", "at", "class").distinct().withColumn("stem", F.left("word", F.col("at")))
    some = inner.join(stems, ["stem", "class"]).select("word", "at", "class", "stem", F.lit("").alias("end"))
    whole = words.select("word").distinct().join(stems.join(ends, "class").select(F.col("stem").alias("word"), "end").distinct(), "word")
    return some.unionByName(whole.select("word", F.length("word").alias("at"), F.lit(END).alias("class"), F.col("word").alias("stem"), "end"))


def _walked(words: DataFrame, stems: DataFrame, edges: DataFrame, begin: Column, piece: Column) -> DataFrame:
    """(word, path): every way through the lattice. begin: the path of a stem (stem, end); piece: what a
    step (affix, tag) adds. Partial ways are only such as go on to the end."""
    steps = written(lattice(words, edges), "lattice")
    now = written(_begun(words, stems, edges, steps).select("word", "at", "class", begin.alias("path")), "paths")
    out = None
    while True:
        done = now.where(F.col("class") == END).select("word", "path")
        out = done if out is None else out.unionByName(done)
        going = now.where(F.col("class") != END).join(steps, ["word", "at", "class"])
        now = written(going.select("word", F.col("to").alias("at"), F.col("next").alias("class"), F.concat("path", piece).alias("path")), "paths")
        if now.isEmpty():
            return out.distinct()


def segmentations(words: DataFrame, stems: DataFrame, edges: DataFrame, mark: str = "-") -> DataFrame:
    """(word, segmentation): every way to read each distinct word as a stem and affixes, joined by
    ``mark``, each once."""
    return _walked(words, stems, edges, F.col("stem"), F.concat(F.lit(mark), "affix")).withColumnRenamed("path", "segmentation")


def analyses(words: DataFrame, stems: DataFrame, edges: DataFrame) -> DataFrame:
    """(word, analysis): the stem and the tags of every way to read each distinct word, each once."""
    return _walked(words, stems, edges, F.concat("stem", "end"), F.col("tag")).withColumnRenamed("path", "analysis")


def generated(wanted: DataFrame, stems: DataFrame, edges: DataFrame) -> DataFrame:
    """(analysis, surface): the words that each distinct analysis (analysis) stands for."""
    rows = analyses(wanted.select(F.col("analysis").alias("word")), stems, inverted(edges))
    return rows.select(F.col("word").alias("analysis"), F.col("analysis").alias("surface"))


#: Rules of a conversion at most; they are folded inside the row.
MOST_RULES = 10_000


def rewritten(rules: DataFrame, analysis: Column) -> Column:
    """An analysis after an ordered table of rules (ord, old, new), each applied to what the rules before
    it left, at every place where ``old`` stands. Context is part of both sides."""
    rows = rules.select("ord", "old", "new").orderBy("ord").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    table = F.array(*(F.struct(F.lit(r.old).alias("old"), F.lit(r.new).alias("new")) for r in rows)) if rows else F.array().cast("array<struct<old:string,new:string>>")
    return F.aggregate(table, analysis, lambda a, r: F.when(F.contains(a, r["old"]), F.replace(a, r["old"], r["new"])).otherwise(a))


def converted(rows: DataFrame, rules: DataFrame, stems: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (surface, analysis) of another tag set with columns new, the analysis under the rules, and
    sound: whether the lexicon makes the surface again from it, whatever its case."""
    made = written(rows.withColumn("new", rewritten(rules, F.col("analysis"))), "converted")
    again = generated(made.select(F.col("new").alias("analysis")).distinct(), stems, edges)
    kept = again.select(F.col("analysis").alias("new"), dotted_fold(F.col("surface")).alias("__low")).distinct().withColumn("__sound", F.lit(True))
    met = made.withColumn("__low", dotted_fold(F.col("surface"))).join(kept, ["new", "__low"], "left")
    return met.select(*rows.columns, "new", F.coalesce("__sound", F.lit(False)).alias("sound"))


def counted(words: DataFrame, stems: DataFrame, edges: DataFrame) -> DataFrame:
    """(word, ways, fewest): in how many ways each distinct word can be read by the lexicon's edges,
    and the fewest affixes of one, by sums over the lattice: as many rows as states, where listing
    the ways could take a number that grows by powers of the word's length."""
    steps = written(lattice(words, edges), "lattice")
    now = written(_begun(words, stems, edges, steps).select("word", "at", "class", "stem").distinct().groupBy("word", "at", "class").agg(F.count("*").cast("decimal(38,0)").alias("ways"), F.lit(0).alias("affixes")), "counts")
    out = None
    while True:
        done = now.where(F.col("class") == END).select("word", "ways", "affixes")
        out = done if out is None else out.unionByName(done)
        going = now.where(F.col("class") != END).join(steps, ["word", "at", "class"])
        step = going.groupBy("word", F.col("to").alias("__at"), "next").agg(F.sum("ways").cast("decimal(38,0)").alias("ways"), (F.min("affixes") + 1).alias("affixes"))
        now = written(step.select("word", F.col("__at").alias("at"), F.col("next").alias("class"), "ways", "affixes"), "counts")
        if now.isEmpty():
            return out.groupBy("word").agg(F.sum("ways").alias("ways"), F.min("affixes").alias("fewest"))


# -- guesses ----------------------------------------------------------------------------------------


def _splits(words: DataFrame, shortest: int, longest: int) -> DataFrame:
    """(word, stem, ending) for stems of so many letters, with something after them."""
    lengths = F.when(F.length("word") > shortest, F.sequence(F.lit(shortest), F.least(F.length("word") - 1, F.lit(longest))))
    return words.select("word", F.explode(lengths).alias("k")).select("word", F.left("word", F.col("k")).alias("stem"), F.substr("word", F.col("k") + 1).alias("ending"))


def ending_index(words: DataFrame, least: int = 2, shortest: int = GUESS_SHORTEST, longest: int = GUESS_LONGEST) -> DataFrame:
    """(ending, stems): endings of distinct words after a stem that is itself a word, and with how many
    stems each occurs, at least ``least``: how productive it is."""
    known = words.select(F.col("word").alias("stem")).where(F.length("stem").between(shortest, longest))
    return _splits(words, shortest, longest).join(known, "stem").groupBy("ending").agg(F.count("*").alias("stems")).where(F.col("stems") >= least)


def guesses(unknown: DataFrame, index: DataFrame, shortest: int = GUESS_SHORTEST, longest: int = GUESS_LONGEST) -> DataFrame:
    """(word, stem, ending, stems, rank, longest): for distinct unknown words every split into a stem
    of ``shortest`` to ``longest`` letters and an ending of the index, the most productive first, of
    equals the longer ending; ``longest`` marks the longest match of the index. A word has as many
    splits as stems have lengths, so its guesses are ranked inside a row."""
    table, _ = broadcast_if_small(index)
    met = _splits(unknown.select("word").distinct(), shortest, longest).join(table, "ending")
    order = F.struct((-F.col("stems")).alias("n"), (-F.length("ending")).alias("l"), "ending", "stem", "stems")
    rows = met.groupBy("word").agg(F.sort_array(F.collect_list(order)).alias("g"), F.max(F.length("ending")).alias("most"))
    return rows.select("word", "most", F.posexplode("g").alias("i", "g")).select("word", "g.stem", "g.ending", "g.stems", (F.col("i") + 1).alias("rank"), (F.length("g.ending") == F.col("most")).alias("longest"))
