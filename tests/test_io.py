"""Readers, writers and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from lexloom.operators import alignment, corpus, dictionary, lookup, morph
from lexloom.plans import report
from lexloom.sources import readers, writers
from lexloom.streaming import logs


def put(tmp_path, name, body):
    (tmp_path / name).write_text(body, encoding="utf-8")
    return f"file://{tmp_path / name}"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_lines_keep_blanks_and_places(spark, tmp_path):
    path = put(tmp_path, "a.txt", " one \n\nthree\n")
    want = [(0, "one"), (1, ""), (2, "three")]
    assert rows(readers.lines(spark, path), "line_no") == want
    assert readers.lines(spark, put(tmp_path, "empty.txt", "")).count() == 0
    many = put(tmp_path, "many.txt", "".join(f"{i} x\r\n" if i % 3 else f"{i} a\rb\n" for i in range(500)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        split = readers.lines(spark, many)
        assert split.rdd.getNumPartitions() > 5
        assert rows(split, "line_no") == [(i, f"{i} x" if i % 3 else f"{i} a\rb") for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert rows(readers.non_blank(readers.lines(spark, path)), "line_no") == [(0, "one"), (1, "three")]


def test_pairs_modes(spark, tmp_path):
    a, b = put(tmp_path, "s", "a\n\nc\nd\n"), put(tmp_path, "t", "A\nB\nC\n")
    assert rows(readers.pairs(spark, a, b, "keep"), "line_no") == [(0, "a", "A"), (1, "", "B"), (2, "c", "C")]
    assert rows(readers.pairs(spark, a, b), "line_no") == [(0, "a", "A"), (2, "c", "C")]
    assert rows(readers.pairs(spark, a, b, "side"), "line_no") == [(0, "a", "A"), (1, "c", "B"), (2, "d", "C")]
    with pytest.raises(ValueError):
        readers.zipped(readers.lines(spark, a), readers.lines(spark, b), names=["x", "y"], strict=True)


def test_dictionaries(spark, tmp_path):
    lines = readers.lines(spark, put(tmp_path, "d", "a -> b\n\nx\n -> y\na -> c\n"))
    assert rows(readers.dictionary(lines), "src") == [("a", "c")]
    assert [r[3] for r in rows(readers.dictionary_audit(lines), "line_no")] == [None, "empty line", "missing separator", "empty source", None]
    mapping = readers.lines(spark, put(tmp_path, "m", "# x\n## Core Mappings\npl -> PL\n## Special Cases\nq -> Q\n"))
    assert rows(readers.sectioned_mapping(mapping), "src") == [("pl", "PL")]
    pairs = readers.separated_pairs(spark, put(tmp_path, "w", "ev<sep>house gel\n"))
    assert rows(pairs, "pos") == [(0, 0, "ev", "house")]


def test_dictionary_scans(spark, tmp_path):
    lines = readers.lines(spark, put(tmp_path, "d", "a -> b\nc->d\n\na -> e\nx\n"))
    good, bad = readers.strict_pairs(lines)
    assert rows(good, "line_no") == [(0, "a", "b"), (3, "a", "e")] and [r[1] for r in rows(bad, "line_no")] == ["c->d", "x"]
    assert [r[1] for r in rows(readers.keys(lines), "line_no")] == ["a", "c", "a"]
    assert rows(readers.repeated_entries(lines), "line_no") == [(3, "a", "e", 0)]
    entries = spark.createDataFrame([(0, "Cats", "cat"), (1, "dog", "dog"), (2, "x", "y"), (3, "cats", "feline")], "line_no int, src string, tgt string")
    assert rows(lookup.lemma_entries(entries), "word") == [("cats", "feline")]
    assert readers.settings(spark, put(tmp_path, "y", "# c\nmodel:\n  layers: 2 # two\n  name: 'a'\nseed: 42\n")) == {"model.layers": "2", "model.name": "a", "seed": "42"}
    report = readers.length_report(lines, lines.limit(2), names=["s", "t"])
    assert rows(report, "side") == [("s", 5, 3), ("t", 2, 0)]


def test_non_blank_cap(spark, tmp_path):
    lines = readers.lines(spark, put(tmp_path, "a", "a\n\nb\n\nc\n"))
    assert rows(readers.non_blank(lines, cap=3), "line_no") == [(0, "a"), (1, "b")]


def test_exports(spark, tmp_path):
    top = spark.createDataFrame([("ev", "house", 3, 1, 0.75, True), ("ev", "home", 1, 2, 0.25, False)], "src string, tgt string, cnt long, rank int, confidence double, is_primary boolean")
    writers.dictionary_export(top, spark.range(1).selectExpr("1 as entries", "75.0 as rate"), f"{tmp_path}/d")
    assert [r.value for r in spark.read.text(f"{tmp_path}/d/simple").collect()] == ["ev → house"]
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/d/statistics").collect()) == ["entries: 1", "rate: 75.0"]
    assert spark.read.json(f"{tmp_path}/d/entries").first().translations[1].tgt == "home"
    assert spark.read.csv(f"{tmp_path}/d/detailed", header=True).count() == 2
    scores = spark.createDataFrame([(0, 1.5), (1, None)], "n int, bleu double")
    writers.sentence_scores(scores, f"{tmp_path}/s", "n", ["bleu"])
    assert spark.read.csv(f"{tmp_path}/s", header=True).columns == ["Sentence ID", "bleu"]
    writers.metric_table(spark.createDataFrame([("bleu", 1.0, None, None)], "metric string, score double, low double, high double"), f"{tmp_path}/m")
    assert tuple(spark.read.csv(f"{tmp_path}/m", header=True).first()) == ("bleu", "1.0", "N/A", "N/A")
    made = spark.createDataFrame([("tr", " a "), ("tr", None), ("en", "b")], "language string, generated string")
    writers.predictions_by_language(made, f"{tmp_path}/p")
    assert sorted((r.language, r.value) for r in spark.read.text(f"{tmp_path}/p").collect()) == [("en", "b"), ("tr", ""), ("tr", "a")]
    rated = spark.createDataFrame([("a", "b", "CORRECT", ""), ("c", "d", "INCORRECT", "e"), ("f", "g", "UNCLEAR", "")], "source string, target string, verdict string, correction string")
    writers.verdict_files(rated, f"{tmp_path}/v")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/v/clean").collect()) == ["a -> b", "c -> e"]
    writers.keyed_csv(made, f"{tmp_path}/k", "generated")
    assert spark.read.csv(f"{tmp_path}/k", header=True).columns == ["generated", "language"]


def test_nested_document(spark, tmp_path):
    rows = spark.createDataFrame([(i, f'söz "{i}"', {f"w{i}": [f"w{i}<N>", "x"]} if i % 3 else None) for i in range(40)], "sentence_id long, text string, analyses map<string,array<string>>").repartition(5)
    for part, want in ((rows, 40), (rows.limit(0), 0)):
        assert writers.json_document(part, f"{tmp_path}/d", ["sentence_id"], "sentences", {"input_file": "a"}) == want
        whole = json.loads("".join(f.read_text() for f in sorted((tmp_path / "d").glob("part-*"))))
        assert whole["metadata"] == {"input_file": "a"}
        assert [(s["sentence_id"], s["text"], s["analyses"]) for s in whole["sentences"]] == [(r.sentence_id, r.text, r.analyses) for r in part.orderBy("sentence_id").collect()]


def test_lexicon_includes(spark, tmp_path):
    put(tmp_path, "nouns", "ev N; ! house\nsu Nsu;\n")
    put(tmp_path, "verbs", '#include "nouns"\ngel V;\n')
    path = put(tmp_path, "all", '#include "nouns"\n#include "verbs"\nve Cnj;\n')
    assert rows(readers.lexicon_with_includes(spark, path), "file", "line_no") == [("all", 2, "ve", "Cnj"), ("nouns", 0, "ev", "N"), ("nouns", 1, "su", "Nsu"), ("verbs", 1, "gel", "V")]


def test_reports(spark, tmp_path, capsys):
    df = spark.createDataFrame([("a", 0.5)], "name string, value double")
    made = report.sections("All", {"One": df, "Two": df})
    assert made.startswith("# All\n\n## One\n\n| name | value |") and made.count("| a | 0.5000 |") == 2
    report.tee(made, f"{tmp_path}/r.md")
    assert capsys.readouterr().out.startswith("# All") and (tmp_path / "r.md").read_text().startswith("# All")


def test_positional_lemmas(spark):
    one = lambda s, m: spark.createDataFrame([(s, m)], "s array<string>, m array<string>").select(alignment.positional_lemmas(F.col("s"), F.col("m"), F.upper).alias("x")).first().x
    assert one(["a", "b", "a"], ["x", "y", "z"]) == ["z", "y", "z"]
    assert one(["a", "b", "c"], ["x", "y"]) == ["x", "y", "C"]


def test_fallbacks(spark):
    df = spark.range(3).withColumnRenamed("id", "n")
    assert sorted((r.n, r.split) for r in corpus.head_tail_split(df, "n", 3, share=1.0, fallback=1).collect()) == [(0, "train"), (1, "train"), (2, "eval"), (2, "train")]
    assert corpus.from_line(df, "n", 0).count() == 3 and corpus.from_line(df, "n", 3).count() == 1
    rows_ = df.selectExpr("n", "if(n = 0, 'test', 'eval') as split")
    assert corpus.first_of_splits(rows_, "split", ("train", "eval", "test"), ["n"], ["n"]).first().n == 1


def test_blocks_and_runs(spark, tmp_path):
    lines = readers.lines(spark, put(tmp_path, "r", "-1.0: ev ev<N>\n-0.5: ev ev<V>\nbad\n\n-2.0: gel gel<V>\n"))
    found = readers.disambiguated(lines)
    assert [r[1:4] for r in rows(found, "line_no")] == [(0, -1.0, "ev"), (0, -0.5, "ev"), (1, -2.0, "gel")]
    best = morph.best_of_runs(morph.runs(found, ["block"], ["line_no"], "word"), ["block"], "word", "analysis", "prob", "line_no")
    assert sorted(r.analysis for r in best.collect()) == ["ev<V>", "gel<V>"]


def test_tables(spark, tmp_path):
    assert rows(readers.tsv(spark, put(tmp_path, "t.tsv", "n\ts\tt\n1\ta b\t\"q\n2\tx\n")), "line_no") == [(1, 1, "a b", '"q')]
    assert rows(readers.pipe_table(spark, put(tmp_path, "p", "| a | b |\n|---|---|\n| x | y |\n"), ["a", "b"]), "line_no") == [(2, "x", "y")]
    good, bad = readers.jsonl(spark, put(tmp_path, "j", '{"a": 1}\nnope\n'), "a long")
    assert rows(good, "a") == [(1,)] and bad.count() == 1
    assert rows(readers.lexicon(readers.lines(spark, put(tmp_path, "l", "! c\nev N; ! x\nbad\n"))), "line_no") == [(1, "ev", "N")]
    assert readers.file_hashes(spark, str(tmp_path)).count() == 4


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", "A", "CORRECT"), (1, "b\nc", None, "UNCLEAR")], "line_no long, s string, t string, verdict string")
    writers.parallel_text(df, f"{tmp_path}/out", ["s", "t"], "line_no")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out/s").collect()) == ["a", "b c"]
    writers.by_verdict(df, f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v").where("verdict = 'UNCLEAR'").count() == 1
    for _ in range(2):
        writers.replaced(df, f"{tmp_path}/r")
        writers.appended(df, f"{tmp_path}/a", "b0")
    assert spark.read.parquet(f"{tmp_path}/r.bak").count() == 2 and spark.read.parquet(f"{tmp_path}/a").count() == 2
    writers.tee(df, f"{tmp_path}/tee", F.col("t") == "A")
    assert spark.read.parquet(f"{tmp_path}/tee/kept").count() == 1
    assert not writers.csv(df.limit(0), f"{tmp_path}/c", only_if_any=True)


def test_log_stream(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    put(tmp_path, "logs/a.log", "Step 5; Train avg loss: 1.5 lr: 0.1\nnothing\n")
    seen = []
    for _ in range(2):  # the second run finds nothing new
        q = logs.run_batches(logs.metrics(logs.tail(spark, f"{tmp_path}/logs")), lambda df, _: seen.extend(tuple(r) for r in df.collect()), f"{tmp_path}/ck")
        q.awaitTermination(60)
    assert sorted(seen) == [(5, "learning_rate", 0.1), (5, "train_loss", 1.5)]


@pytest.mark.parametrize(("n", "want"), [(1, 1), (10, 4), (0, 0)])
def test_subset_sizes(spark, n, want):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    assert corpus.stratified_subset(df, "lang", ("es",), "doc_id").count() == want


def test_split_sizes(spark):
    df = spark.range(19).withColumnRenamed("id", "doc_id")
    got = {r.split: r["count"] for r in corpus.split(df, "doc_id").groupBy("split").count().collect()}
    assert got == {"train": 15, "valid": 1, "test": 3}


def test_pharaoh(spark):
    row = spark.range(1).select(dictionary.pharaoh_pairs(F.lit("0-1 x-2 3 4-")).alias("p")).first()
    assert [tuple(p) for p in row.p] == [(0, 1)]
