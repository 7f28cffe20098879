"""Sentences by the transition table, learnt abbreviations and spelling groups, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import phonology
from lexloom.operators import sentences

ENDS, OPENS, CLOSES = phonology.SENTENCE_ENDS, phonology.OPENING, phonology.CLOSING


def starts(tokens, known=()):
    out = [0] if tokens else []
    for i in range(len(tokens) - 1):
        spared = i > 0 and (tokens[i - 1].isdigit() or tokens[i - 1].lower() in known)
        opened = any(t in OPENS for t in tokens[: i + 1])
        if tokens[i] in ENDS and not spared and tokens[i + 1] not in ENDS and not (tokens[i + 1] in CLOSES and opened):
            out.append(i + 1)
    return out


@pytest.mark.parametrize("known", [(), ("dr", "prof")])
def test_the_table_against_the_rule(spark, known):
    rng = random.Random(3)
    alphabet = ["ev", "Dr", "prof", "12", ".", "?", "!", "...", "(", ")", '"', "''", "“", "”", ",", "x"]
    rows = [(i, [rng.choice(alphabet) for _ in range(rng.randrange(14))]) for i in range(400)] + [(400, []), (401, None)]
    texts = spark.createDataFrame(rows, "id int, t array<string>")
    table = spark.createDataFrame([(w, 1, 1) for w in known], "word string, dots long, open long") if known else None
    got = {r.id: r.starts for r in sentences.with_sentences(texts, "t", table).collect()}
    assert got == {i: None if t is None else starts(t, known) for i, t in rows}


def test_long_texts_have_all_their_sentences(spark):
    tokens = ["a", "."] * 3000
    got = spark.createDataFrame([(tokens,)], "t array<string>").select(phonology.sentence_starts(F.col("t")).alias("s")).first().s
    assert got == list(range(0, 6000, 2))


def test_the_reference_cases(spark):
    def cut(text, known=None):
        row = spark.createDataFrame([(text,)], "x string").select(phonology.sentence_tokens("x").alias("t"))
        made = sentences.with_sentences(row, "t", None if known is None else spark.createDataFrame([(w,) for w in known], "word string")).first()
        return [" ".join(made.t[a:b]) for a, b in zip(made.starts, [*made.starts[1:], len(made.t)], strict=True)]

    assert cut("Geldi. Gitti mi? Evet!") == ["Geldi .", "Gitti mi ?", "Evet !"]
    assert cut("2. kat. Tamam...") == ["2 . kat .", "Tamam ..."]
    assert cut("Prof. Ali geldi. Tamam", ["prof"]) == ["Prof . Ali geldi .", "Tamam"]
    assert cut("“Geldi.” dedi. Sonra gitti.") == ["“ Geldi . ” dedi .", "Sonra gitti ."]


def test_abbreviations_are_learnt(spark):
    text = "prof . ali geldi . Sonra dr . veli geldi . Ama prof . ali gitti . Ne var . Ne yok . prof"
    rows = spark.createDataFrame([(text.split(" "),), ([],), (None,), (["."],), (["a", "."],)], "t array<string>")
    counts = {r.word: (r.dots, r.open) for r in sentences.dotted_words(rows, "t").collect()}
    assert counts == {"prof": (2, 2), "geldi": (2, 0), "dr": (1, 1), "gitti": (1, 0), "var": (1, 0), "yok": (1, 1)}
    assert {r.word for r in sentences.abbreviations(rows, "t").collect()} == {"prof", "dr", "yok"}
    assert {r.word for r in sentences.abbreviations(rows, "t", share=4).collect()} == {"prof"}
    assert sentences.abbreviations(rows.limit(0), "t").count() == 0


def test_spellings_meet(spark):
    words = ["kâr", "KÂR", "kar", "Kar", "ışık", "IŞIK", "Işık", "isik", "İzmir", "izmir", "IZMIR", "straße", "日本", "x1", ""]
    rows = spark.createDataFrame([(w, 1 + (w == "kar") + (w == "Işık")) for w in words], "word string, cnt long")
    got = {r.word: (r.spellings, r.best) for r in sentences.spelling_groups(rows).collect()}
    assert {got[w] for w in words[:4]} == {(4, "kar")} and {got[w] for w in words[4:8]} == {(4, "Işık")}
    assert {got[w] for w in words[8:11]} == {(3, "IZMIR")} and got["日本"] == (1, "日本") and got[""] == (1, "")
    for w in ("ışık", "kâr"):  # every listed variant has the word's own key
        row = spark.createDataFrame([(w,)], "w string").select(F.explode(phonology.case_variants(F.col("w"))).alias("v"), phonology.variant_key(F.col("w")).alias("k"))
        assert {r[0] for r in row.select(phonology.variant_key(F.col("v")) == F.col("k")).collect()} == {True}
