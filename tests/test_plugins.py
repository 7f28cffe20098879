"""Plug-in boundaries."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import parse
from lexloom.operators import alignment, plugins
from lexloom.sources import readers


def test_generated(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "prompt string").coalesce(1)
    got = sorted(map(tuple, plugins.generated(df, model, size=3).collect()))
    assert got == [("a", "A", None), ("bad", None, "no"), ("c", "C", None)]


def test_scored_and_tagged(spark):
    df = spark.createDataFrame([("a b", "a"), ("c", "c d e")], "hyp string, ref string")
    out = plugins.scored(df, lambda rows: [len(h) - len(r) for h, r in rows], ["hyp", "ref"])
    assert sorted(r.score for r in out.collect()) == [-4.0, 2.0]
    told = plugins.tagged(df, lambda t: [(w, "N" if w > "b" else "V") for w in t.split()], "ref").collect()
    assert sorted(r.labels for r in told) == [["N", "N", "N"], ["V"]]
    assert {r.labels for r in plugins.tagged(df, None, "ref").collect()} == {None}


def test_transducers(spark):
    words = spark.createDataFrame([("evler",), ("xyz",), ("q",), ("gel",)], "word string")
    known = {"evler": ["ev<N><pl>"], "gel": ["gel<V>"]}
    made = plugins.analysed_or_guessed(words, lambda w: known.get(w, []), lambda w: [f"{w}<N>"])
    assert {(r.word, r.analysis, r.guessed) for r in made.collect()} == {("evler", "ev<N><pl>", False), ("gel", "gel<V>", False), ("xyz", "xyz<N>", True), ("q", "???", False)}
    parts = plugins.segmented(words, lambda w: ["ev-ler", "ev-lar"] if w == "evler" else [w])
    assert {(r.word, r.analysis) for r in parts.collect()} == {("evler", "ev-ler"), ("xyz", "xyz"), ("q", "q"), ("gel", "gel")}
    rows = spark.createDataFrame([("evler", "ev", "+Noun+A3pl"), ("su", "su", "+Noun+A3pl"), ("o", "o", "+Odd")], "surface string, lemma string, tags string")
    mapping = spark.createDataFrame([("+Noun+A3pl", "<N><pl>")], "tags string, new_tags string")
    got = plugins.converted(rows, mapping, lambda a: [a.split("<")[0] + "ler"])
    assert {(r.surface, r.analysis, r.sound) for r in got.collect()} == {("evler", "ev<N><pl>", True), ("su", "su<N><pl>", False), ("o", None, False)}
    many = spark.range(30_000).selectExpr("cast(id as string) as line").repartition(3)
    assert sorted(int(r.line) for r in plugins.piped(many, "rev").selectExpr("reverse(line) as line").collect()) == list(range(30_000))
    assert [r.line for r in plugins.piped(spark.createDataFrame([(None,), ("é",)], "line string").coalesce(1), "sed s/^/x/").collect()] == ["x", "xé"]
    assert plugins.piped(many, "head -n 2").count() == 6 and plugins.piped(many.limit(0), "cat").count() == 0
    with pytest.raises(Exception, match="ended with status"):
        plugins.piped(many, "false").count()
    assert sorted(r.line for r in plugins.piped(spark.createDataFrame([("b",), ("a",)], "line string"), "tr a-z A-Z").collect()) == ["A", "B"]


def test_answers(spark):
    one = spark.range(1)
    flags = one.select(*(c.alias(n) for n, c in parse.alignment_flags(F.lit("x <alignments> a - b")).items())).first()
    assert flags.asDict() == {"has_start_tag": True, "has_end_tag": False, "has_alignment_tags": False, "num_alignments": 1, "is_valid_format": False}
    doc = one.select(alignment.artefact(F.lit("p"), F.lit("o"), F.array(F.lit("a"))).alias("d")).first().d
    assert doc == '{"prompt":"p","output":"o","alignments":["a"]}'


def test_staged(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/b")
    assert readers.staged(spark, f"{tmp_path}/a", f"{tmp_path}/b").count() == 3
    assert readers.columns(spark, f"{tmp_path}/b", ["id"]).columns == ["id"]
    with pytest.raises(FileNotFoundError):
        readers.staged(spark, f"{tmp_path}/a")
