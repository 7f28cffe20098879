"""Segmentation, guesses and streamed runs, against plain recursion and plain loops."""

import random

import pytest

from lexloom.operators import segmentation
from lexloom.streaming import runs

EDGES = [("Root", "ler", "Pl"), ("Root", "i", "Case"), ("Root", "de", "Case"), ("Pl", "", "Case0"), ("Case0", "i", "Case"), ("Case0", "de", "Case"), ("Case", "ki", "Root2"), ("Root2", "", "Root"), ("Case0", "", "#"), ("Case", "", "#"), ("Root", "", "#"), ("Root2", "", "#")]


def tables(spark, edges, stems):
    return spark.createDataFrame(stems, "stem string, class string"), spark.createDataFrame(edges, "class string, affix string, next string")


def ways(word, edges, stems):
    """All segmentations by plain recursion; classes reached without an affix are tracked, so cycles end."""

    def after(rest, state, passed=frozenset()):
        found = set()
        for c, a, n in edges:
            if c != state:
                continue
            if n == "#":
                found |= {()} if a == rest == "" else set()
            elif a == "":
                found |= after(rest, n, passed | {state}) if n not in passed else set()
            elif rest.startswith(a):
                found |= {(a, *x) for x in after(rest[len(a) :], n)}
        return found

    return {"-".join((s, *x)) for s, c in stems if word.startswith(s) for x in after(word[len(s) :], c)}


def test_segmentations_of_a_small_lexicon(spark):
    stems, edges = tables(spark, EDGES, [("ev", "Root"), ("evde", "Root"), ("el", "Root")])
    words = spark.createDataFrame([(w,) for w in ("evler", "evlerde", "evde", "evdeki", "evdekiler", "evdekilerdeki", "elki", "su", "", "ev", "ev", None)], "word string")
    got = {(r.word, r.segmentation) for r in segmentation.segmentations(words, stems, edges).collect()}
    assert got == {(w, s) for (w,) in words.collect() if w is not None for s in ways(w, EDGES, [("ev", "Root"), ("evde", "Root"), ("el", "Root")])}
    assert ("evdekilerdeki", "ev-de-ki-ler-de-ki") in got and ("evdeki", "evde-ki") not in got


@pytest.mark.parametrize("seed", range(2))
def test_segmentations_of_random_lexicons(spark, seed):
    rng = random.Random(seed)
    classes = ["Root", "A", "B", "C"]
    edges = sorted({(rng.choice(classes), rng.choice(["a", "b", "ab", "ba", "aab", ""]), rng.choice(classes[1:])) for _ in range(14)} | {(c, "", "#") for c in rng.sample(classes, 2)})
    stems = sorted({(rng.choice(["a", "ab", "b", "ba"]), rng.choice(classes[:2])) for _ in range(4)})
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 10))) for _ in range(60)})
    s, e = tables(spark, edges, stems)
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    want = {(w, x) for w in words for x in ways(w, edges, stems)}
    assert {(r.word, r.segmentation) for r in segmentation.segmentations(rows, s, e).collect()} == want


def test_ways_are_counted_and_not_listed(spark):
    """Of a word of n letters under affixes a and aa there are as many as Fibonacci has."""
    stems, edges = tables(spark, [("Root", "a", "Root"), ("Root", "aa", "Root"), ("Root", "", "#")], [("x", "Root")])
    rows = spark.createDataFrame([("x" + "a" * n,) for n in (0, 1, 2, 3, 12)], "word string")
    got = {len(r.word) - 1: (int(r.ways), r.fewest) for r in segmentation.counted(rows, stems, edges).collect()}
    assert got == {0: (1, 0), 1: (1, 1), 2: (2, 1), 3: (3, 2), 12: (233, 6)}


def test_a_word_has_a_state_for_each_place_and_class(spark):
    stems, edges = tables(spark, [("Root", "a", "Root"), ("Root", "aa", "Root"), ("Root", "", "#")], [("x", "Root")])
    steps = segmentation.lattice(spark.createDataFrame([("x" + "a" * 10,)], "word string"), edges)
    assert steps.count() == steps.distinct().count() <= 2 * 2 * 11


def test_a_lexicon_is_learnt_from_words(spark):
    words = ["walk", "talk", "jump"]
    rows = spark.createDataFrame([(w + e,) for w in words for e in ("", "er", "ers", "ed")], "word string")
    stems, edges = segmentation.learnt(rows, 200)
    found = {tuple(r) for r in edges.collect()}
    assert found == {("Root", "er", "1:er"), ("Root", "ers", "1:ers"), ("Root", "ed", "1:ed"), ("Root", "s", "1:s"), ("1:er", "s", "2"), *((c, "", "#") for c in ("Root", "1:er", "1:ers", "1:ed", "1:s", "2"))}
    got = {r.segmentation for r in segmentation.segmentations(rows, stems, edges).collect() if r.word == "walkers"}
    assert got == {"walkers", "walk-ers", "walk-er-s", "walker-s"}


#: A small noun: tags with and without an affix.
TAGGED = [("Root", "", "N", "<N>"), ("N", "ler", "Pl", "<pl>"), ("N", "", "Pl", ""), ("Pl", "i", "End", "<acc>"), ("Pl", "i", "End", "<p3s>"), ("Pl", "de", "End", "<loc>"), ("Pl", "", "End", ""), ("End", "", "#", ""), ("N", "li", "Adj", "<li>"), ("Adj", "", "#", "<Adj>"), ("Adj", "", "Root", "<Adj>")]


def tagged(spark, edges):
    return spark.createDataFrame(edges, "class string, affix string, next string, tag string")


def test_analyses_and_generation(spark):
    stems, edges = spark.createDataFrame([("ev", "Root"), ("evli", "Root")], "stem string, class string"), tagged(spark, TAGGED)
    words = spark.createDataFrame([(w,) for w in ("ev", "evler", "evleri", "evde", "evli", "evlilerde", "su")], "word string")
    got = {(r.word, r.analysis) for r in segmentation.analyses(words, stems, edges).collect()}
    assert got == {
        ("ev", "ev<N>"), ("evler", "ev<N><pl>"), ("evleri", "ev<N><pl><acc>"), ("evleri", "ev<N><pl><p3s>"), ("evde", "ev<N><loc>"), ("evli", "ev<N><li><Adj>"), ("evli", "ev<N><li><Adj><N>"), ("evli", "evli<N>"),
        ("evlilerde", "ev<N><li><Adj><N><pl><loc>"), ("evlilerde", "evli<N><pl><loc>"),
    }
    asked = spark.createDataFrame([(a,) for _, a in got] + [("ev<Adj>",), ("su<N>",), ("ev",)], "analysis string")
    assert {(r.surface, r.analysis) for r in segmentation.generated(asked, stems, edges).collect()} == got


def test_endless_analyses_are_refused(spark):
    edges = tagged(spark, [("Root", "", "A", "<x>"), ("A", "", "Root", ""), ("Root", "", "#", "")])
    with pytest.raises(ValueError, match="endless"):
        segmentation.without_empty(edges)


def test_conversion_by_ordered_rules(spark):
    stems, edges = spark.createDataFrame([("ev", "Root")], "stem string, class string"), tagged(spark, TAGGED)
    rules = spark.createDataFrame([(3, "+A3pl", "<pl>"), (1, "+Noun+A3sg", "<N>"), (2, "+Noun", "<N>"), (4, "+Loc", "<loc>"), (5, "+Acc", "<acc>"), (6, "+Pnon+Nom", "")], "ord int, old string, new string")
    rows = spark.createDataFrame([("Evlerde", "ev+Noun+A3pl+Loc", 1), ("evde", "ev+Noun+A3sg+Loc", 2), ("evi", "ev+Noun+A3sg+Loc", 3), ("ev", "ev+Noun+A3sg+Pnon+Nom", 4), ("ev", "ev+Verb", 5), (None, None, 6)], "surface string, analysis string, n int")
    got = sorted((r.n, r.new, r.sound) for r in segmentation.converted(rows, rules, stems, edges).collect())
    assert got == [(1, "ev<N><pl><loc>", True), (2, "ev<N><loc>", True), (3, "ev<N><loc>", False), (4, "ev<N>", True), (5, "ev+Verb", False), (6, None, False)]


def test_no_words_and_no_edges(spark):
    stems, edges = tables(spark, EDGES, [("ev", "Root")])
    none = spark.createDataFrame([], "word string")
    assert segmentation.segmentations(none, stems, edges).count() == 0
    assert [tuple(r) for r in segmentation.segmentations(spark.createDataFrame([("ev",)], "word string"), stems, edges.where("next = '#' and class = 'Root'")).collect()] == [("ev", "ev")]


def test_guesses(spark):
    known = spark.createDataFrame([(w,) for w in ("walk", "walking", "talk", "talking", "talks", "walks", "jump", "jumps", "sing", "sings", "ab", "abx")], "word string")
    index = segmentation.ending_index(known)
    assert {tuple(r) for r in index.collect()} == {("ing", 2), ("s", 4)}
    got = segmentation.guesses(spark.createDataFrame([("gluing",), ("blings",), ("xs",), ("abcdefghijks",), ("tings",), ("gluing",)], "word string"), index).collect()
    assert sorted(map(tuple, got)) == [("blings", "bling", "s", 4, 1, True), ("gluing", "glu", "ing", 2, 1, True), ("tings", "ting", "s", 4, 1, True)]


# streams

KIND = "doc string, at timestamp, ord long, word string, analysis string, score double"


def streamed(spark, tmp_path, parts, quiet_ms, delay="0 seconds"):
    """What comes out after each part; a text is a mark."""
    seen, out = [], []
    for part in parts:
        if isinstance(part, str):
            runs.mark(spark, f"{tmp_path}/marks", "at", part)
        else:
            rows = spark.createDataFrame(part, "doc string, at string, ord long, word string, analysis string, score double")
            rows.selectExpr("doc", "cast(at as timestamp) as at", "ord", "word", "analysis", "score").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for folder in ("in", "marks"):
            (tmp_path / folder).mkdir(exist_ok=True)
        stream = runs.with_marks(spark.readStream.schema(KIND).parquet(f"{tmp_path}/in"), f"{tmp_path}/marks", "at")
        found = runs.best_of_runs(stream, "doc", "at", "ord", quiet_ms, delay)
        batch: list = []
        runs.run_to_end(lambda found=found, batch=batch: found.writeStream.foreachBatch(lambda df, _: batch.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(), spark)
        out.append(sorted(batch, key=repr))
        seen += batch
    return out


def test_streamed_runs_come_out_with_the_last_one(spark, tmp_path):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    first = [("d", at(0), 0, "ev", "ev<N>", 0.5), ("d", at(2), 1, "gel", "gel<V>", 0.1), ("d", at(1), 2, "ev", "ev<V>", 0.9), ("d", at(2), 0, "gel", "gel", 0.1), (None, at(1), 0, "su", "su<N>", None), ("d", at(1), 9, None, "x", 9.0)]
    later = [("d", at(1), 3, "late", "late", 1.0), ("d", at(3), 0, "ev", "e<X>", 0.3), ("e", at(4), 0, "at", "at<N>", 1.0), ("e", at(4), 1, "at", "a<N>", 1.0)]
    got = streamed(spark, tmp_path, [first, later, "2024-01-02 00:00:00"], 3_600_000)
    assert got[0] == [("d", 1, "ev", "ev<V>", 0.9)] or got[0] == []  # by whether a batch without rows follows
    assert sorted(map(repr, got[0] + got[1] + got[2])) == sorted(map(repr, [("d", 1, "ev", "ev<V>", 0.9), ("d", 2, "gel", "gel", 0.1), ("d", 3, "ev", "e<X>", 0.3), ("e", 1, "at", "a<N>", 1.0), (None, 1, "su", "su<N>", None)]))
    assert ("d", 3, "ev", "e<X>", 0.3) in got[2] and ("e", 1, "at", "a<N>", 1.0) in got[2]


def test_a_quiet_key_is_closed_and_goes_on(spark, tmp_path):
    parts = [[("d", "2024-01-01 00:00:00", 0, "ev", "ev", 1.0)], [("x", "2024-01-01 09:00:00", 0, "y", "y", 1.0)], [("d", "2024-01-01 10:00:00", 0, "ev", "ev", 2.0)], "2024-01-02 00:00:00"]
    got = streamed(spark, tmp_path, parts, 3_600_000)
    assert sorted(x for part in got for x in part) == [("d", 1, "ev", "ev", 1.0), ("d", 2, "ev", "ev", 2.0), ("x", 1, "y", "y", 1.0)]
    assert ("d", 1, "ev", "ev", 1.0) in got[0] + got[1] + got[2]
