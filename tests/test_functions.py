"""Small cases of the column builders, with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from lexloom.functions import gloss, metrics, parse, phonology, text
from lexloom.operators import retrieval


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x):
    return F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)


@pytest.mark.parametrize(("make", "want"), [
    (lambda: text.clean_word(lit("İstanbul,")), "istanbul"),
    (lambda: text.turkish_lower(lit("İIAŞ")), "iiaş"),
    (lambda: text.dotted_fold(lit("İI")), "iı"),
    (lambda: text.capitalize(lit("eLMA ağacı")), "Elma ağacı"),
    (lambda: text.case_like(lit("EV"), lit("house")), "HOUSE"),
    (lambda: text.case_like(lit("Ev"), lit("house")), "House"),
    (lambda: text.case_like(lit("ev"), lit("hOuse")), "hOuse"),
    (lambda: text.collapse(lit(" a\n b  ")), "a b"),
    (lambda: text.first_token(lit("  ")), "unknown"),
    (lambda: text.code_in_parentheses(lit("Uspanteko (uspa1245)")), "uspa1245"),
    (lambda: text.base_name(lit("Uspanteko (uspa1245)")), "Uspanteko"),
    (lambda: text.fallback_code(lit("Ab-cd")), "abc"),
    (lambda: text.fallback_code(lit("12")), "und"),
    (lambda: text.is_number(lit("3.14")), True),
    (lambda: text.is_number(lit("3.1.4")), False),
    (lambda: text.is_number(lit(".")), False),
    (lambda: text.shorten(lit("x" * 60)), "x" * 47 + "..."),
    (lambda: text.detokenize(lit("3 . 14 %")), "3. 14%"),
    (lambda: text.detokenize(lit("▁Mr ▁. ▁X ▁( ▁a ▁) ▁!")), "Mr. X (a)!"),
    (lambda: text.fix_numbers(lit("1 , 000 at 12 : 30 on 01 / 02 / 2023")), "1,000 at 12:30 on 01/02/2023"),
    (lambda: text.hyphenate(lit("elektrik")), "e-lekt-rik"),
    (lambda: text.hyphenate(lit("okulda")), "o-kul-da"),
    (lambda: text.hyphenate(lit("saat")), "sa-at"),
    (lambda: F.concat_ws("|", text.split_punctuation(lit("a,b 3,5 (c)."))), "a|,|b|3,5|(|c|)|."),
    (lambda: text.lower_words(lit("ABC DEf Ğx1Y")), "aBC def ğx1Y"),
    (lambda: text.ascii_fold(lit("çığır")), "cigir"),
    (lambda: gloss.convert_analysis(lit("oku<V><past><p1s>")), "oku-V-PST-1SG"),
    (lambda: gloss.convert_analysis(lit("Ali<N:prop>")), "Ali-NOM-PROP"),
    (lambda: gloss.convert_analysis(lit("xyz ???")), "xyz"),
    (lambda: gloss.convert_analysis(lit("plain")), "plain"),
    (lambda: gloss.simplify_tag(lit("CV:INCE")), "CV"),
    (lambda: gloss.simplify_tag(lit("COND")), None),
    (lambda: gloss.simplify_tag(lit("PL")), "PL"),
    (lambda: gloss.render(lit("ev"), gloss.top_tags(lit(["ACC", "PL", "NOM", "LIK"]), 2)), "ev-NOM-PL"),
    (lambda: gloss.per_token(lit("tur ev-NOM-PL-V"), lambda t: gloss.render(gloss.base(t), gloss.without_pos(gloss.tags(t)))), "tur ev-PL-V"),
    (lambda: gloss.per_token(lit("tur ev-NOM-PL-V"), lambda t: gloss.render(gloss.base(t), gloss.without_pos(gloss.tags(t), True))), "tur ev-PL"),
    (lambda: gloss.clean_line(lit("'Ev'-NOM gel, ... A'B")), "ev-NOM gel ab"),
    (lambda: gloss.english_lemma(lit("goes")), "goe"),
    (lambda: gloss.english_lemma(lit("glass")), "glass"),
    (lambda: gloss.english_lemma(lit("walked")), "walk"),
    (lambda: gloss.keep_segmentation(lit("Evler"), lit("ev-ler")), True),
    (lambda: gloss.analysis_failed(lit(["a+?"])), True),
    (lambda: gloss.analysis_failed(lit(["a<N>"])), False),
    (lambda: parse.first_translation(lit("<translation>\nHi\n</translation> x")), "Hi"),
    (lambda: parse.first_translation(lit("no tags")), "no tags"),
    (lambda: parse.verdict(lit("<verdict>incorrect</verdict>")), "INCORRECT"),
    (lambda: parse.verdict(lit("It is correct")), "CORRECT"),
    (lambda: parse.correction(lit("<VERDICT>INCORRECT</VERDICT><CORRECTION>dog</CORRECTION>")), "dog"),
    (lambda: parse.correction(lit("<VERDICT>INCORRECT</VERDICT> cat")), "cat"),
    (lambda: parse.correction(lit("<VERDICT>INCORRECT</VERDICT><CORRECTION>this is a dog</CORRECTION>")), ""),
    (lambda: F.to_json(parse.alignment_pairs(lit("a - b\nbad\nc - d\n### end\ne - f"))), '[{"source":"a","target":"b"},{"source":"c","target":"d"}]'),
    (lambda: parse.slug(lit("Give: the best answer!")), "give_the_best"),
    (lambda: parse.filled("{x} and {x}", x=lit("a")), "a and a"),
    (lambda: metrics.jaccard(lit(["a", "b", "c"]), lit(["b", "c", "d"])), 0.5),
    (lambda: metrics.overlap(lit(["a", "a", "b"]), lit(["a", "b", "b"])), 2),
])
def test_cases(spark, make, want):
    assert value(spark, make()) == want


def test_validated_rules(spark):
    rows = spark.createDataFrame([("a", "a", "INCORRECT", "b"), ("12", "x", "INCORRECT", "y"), ("!", "x", "CORRECT", ""), ("nato", "a very long text", "CORRECT", ""), ("Ankara", "xyz", "CORRECT", "")], "source string, target string, v string, c string")
    said, fix = parse.validated(F.col("source"), F.col("target"), F.col("v"), F.col("c"))
    assert [tuple(r) for r in rows.select(said, fix).collect()] == [("CORRECT", ""), ("INCORRECT", "12"), ("INCORRECT", "!"), ("INCORRECT", "nato"), ("INCORRECT", "ankara")]


def test_bleu_and_chrf(spark):
    same = lit("the cat sat on the mat".split())
    stats = metrics.bleu_stats(same, same)
    assert value(spark, metrics.sentence_bleu(stats)) == pytest.approx(1.0)
    assert value(spark, metrics.sentence_bleu(stats, metrics.bleu_exponential)) == pytest.approx(100.0)
    half = metrics.bleu_stats(lit(["a", "b"]), lit(["a", "c"]))
    want = math.exp((math.log(1 / 2) + 3 * math.log(0.1)) / 4)
    assert value(spark, metrics.sentence_bleu(half)) == pytest.approx(want)
    assert value(spark, metrics.chrf(lit("a cat"), lit("a cat"))) == pytest.approx(100.0)
    assert value(spark, metrics.chrf(lit("xx"), lit("yy"))) == 0.0
    assert value(spark, metrics.chrf(lit(""), lit("yy"))) == 0.0
    assert value(spark, F.concat_ws("|", metrics.thirteen_a(lit("Hi, 3.5 (x)!")))) == "Hi|,|3.5|(|x|)|!"


def test_template_parts():
    whole = "Task.\nHere are some examples\n<translation>x</translation>\nIn: a\nNow translate:\n{input_text}"
    assert retrieval.template_parts(whole) == ("Task.\nHere are some examples", "Now translate:\n{input_text}")
    assert retrieval.template_parts("Say\nIt: {input_text}\nend") == ("Say", "It: {input_text}\nend")
    assert retrieval.template_parts("nothing") == ("nothing", "")


def test_phonology(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(phonology.syllables(F.lit(w))) for w in ("Araba", "saat", "Türkçe", "IŞIK", "kontrol")] == ["a.ra.ba", "sa.at", "türk.çe", "ı.şık", "kont.rol"]
    assert [one(phonology.sounds(F.lit(w))) for w in ("baba", "ev", "dağ", "çiçek")] == ["bɑbˈɑ", "ˈev", "dˈɑ:", "tʃʰitʃʰˈec" + "ʰ"]
    assert one(phonology.case_variants(F.lit("ışık"))) == ["ışık", "Işık", "IŞIK", "isik"]
    assert one(phonology.case_variants(F.lit("kâr")))[:4] == ["kâr", "Kâr", "KÂR", "kar"]
    text = 'Dr. Ali 3.5 kilo aldı. "Gel!" dedi... Saat 5. sırada. A. Veli\'nin evi?'
    tokens = one(phonology.sentence_tokens(F.lit(text)))
    assert tokens[:5] == ["Dr", ".", "Ali", "3.5", "kilo"] and "A." in tokens and "Veli'nin" in tokens and "..." in tokens
    found = one(phonology.sentences(F.array(*(F.lit(t) for t in tokens)), ("Dr",)))
    assert [" ".join(s) for s in found] == ["Dr . Ali 3.5 kilo aldı .", '" Gel ! " dedi ...', "Saat 5 . sırada .", "A. Veli'nin evi ?"]
    assert one(phonology.sentences(F.array(F.lit("a"), F.lit("b")))) == [["a", "b"]] and one(phonology.sentences(F.array().cast("array<string>"))) == []


def test_number_words(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 15, 100, 101, 234, 1000, 1001, 2345, 10_000, 100_100, 1_000_000, 987_654_321, 5_000_000_000_007)], "n long")
    words = phonology.spelled_number(F.col("n"))
    assert [(r.n, r.v) for r in df.select("n", phonology.number_value(words).alias("v")).collect()] == [(r.n, r.n) for r in df.collect()]
    assert " ".join(df.where("n = 2345").select(words.alias("w")).first().w) == "iki bin üç yüz kırk beş"
    assert spark.range(1).select(phonology.number_value(F.array(F.lit("kedi"))).alias("v")).first().v is None
