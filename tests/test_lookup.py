"""Containment, sentence matches, places and resampling, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions.text import fallback_code
from lexloom.operators import dictionary, evaluation, lookup, ranking, sizes, staging


def some_words(rng, n, letters="abc", most=7):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("q", [1, 2, 3])
def test_contained(spark, q):
    rng = random.Random(q)
    parts, wholes = some_words(rng, 60), some_words(rng, 60, most=12)
    got = lookup.contained(spark.createDataFrame([(p,) for p in [*parts, None]], "part string"), spark.createDataFrame([(w,) for w in [*wholes, None]], "whole string"), q)
    assert sorted(map(tuple, got.collect())) == sorted({(p, w) for p in parts for w in wholes if p and p in w})


def plans(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("empties", [False, True])
def test_names_meet_entries(spark, empties):
    rng = random.Random(4)
    make = lambda n: [" ".join(w for w in some_words(rng, 2, "abd", 9) if w) for _ in range(n)]
    names = [*make(40), "ABDA abd", None] + ["", " "] * empties
    entries = [(i, r, f"c{i}") for i, r in enumerate([*make(30), None])] + [(90, "", "none")] * empties
    entries = [e for e in entries if empties or e[1] != ""]
    table = spark.createDataFrame(entries, "ord int, name string, code string")
    asked = spark.createDataFrame([(n,) for n in names if empties or n != ""], "name string")
    found = lookup.resolve_names(asked, table, known={})
    assert "NestedLoop" not in plans(found) and "Cartesian" not in plans(found)
    got = {r["name"]: (r["code"], r["method"]) for r in found.collect()}

    def rank(n, r):
        n, r = n.lower(), r.lower()
        return 1 if n == r else 2 if n in r or r in n else 3 if any(len(w) > 3 and w in r for w in n.split()) else None

    codes = {r["name"]: r["c"] for r in asked.distinct().withColumn("c", fallback_code(F.col("name"))).collect()}
    want = {}
    for n in {r["name"] for r in asked.collect()}:
        hits = sorted((rank(n, r), o, c) for o, r, c in entries if n is not None and r is not None and rank(n, r))
        want[n] = (hits[0][2], {1: "exact", 2: "contains", 3: "word"}[hits[0][0]]) if hits else (codes[n], "fallback")
    assert got == want
    matched = {r["name"]: r["matched"] for r in lookup.match_names(asked, table.select("ord", F.col("name").alias("r_name"))).collect()}
    for n in want:
        hits = sorted((rank(n, r), o, r) for o, r, _ in entries if n is not None and r is not None and rank(n, r) in (1, 2))
        assert matched[n] == (hits[0][2] if hits else None)


@pytest.mark.parametrize("most", [0, 2, 64])
def test_sentence_matches(spark, most):
    rng = random.Random(8)
    words = some_words(rng, 200, "ab", 6)
    entries = sorted({(w or "a", rng.choice(words)) for w in words[:60]})
    entries = [(i, s, t) for i, (s, t) in enumerate(rng.sample(entries, len(entries)))]
    lines = [(n, [rng.choice(words[:120]) for _ in range(rng.randrange(6))], [rng.choice(words).lower() for _ in range(rng.randrange(6))]) for n in range(30)] + [(40, [None, "a"], ["a", None]), (41, ["a"], None), (42, None, ["a"])]
    table = spark.createDataFrame(lines, "line int, words array<string>, others array<string>")
    got = lookup.sentence_matches(table, spark.createDataFrame(entries, "ord int, src string, tgt string"), ["line"], most=most)
    want = []
    for n, tokens, others in lines:
        for p, token in enumerate(tokens or []):
            if token is None or others is None:
                continue
            able = [(0 if s == token else 1, o, s, t) for o, s, t in entries if t.lower() in others and (s == token or len(s) > 2 and (token.startswith(s) or token and s.startswith(token)))]
            if able:
                rank, _, s, t = min(able)
                want.append((n, p, token, s, t, "exact" if rank == 0 else "prefix"))
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_places_of_skewed_rows(spark, monkeypatch):
    """Half of all rows share a beginning, and a quarter are equal: no range has twice the mean."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 4 == 0, "same").when(F.col("id") % 4 == 1, F.concat(F.lit("same"), F.col("id").cast("string"))).otherwise(F.md5(F.col("id").cast("string").cast("binary"))).alias("t"), (F.col("id") % 7).alias("k"))
    kept = []
    monkeypatch.setattr(ranking, "written", lambda df, label: kept.append(staging.written(df, label)) or kept[-1])
    placed = ranking.sorted_places(rows.repartition(8), ["t", "k"], partitions=16)
    sizes = [r[1] for r in kept[0].groupBy(F.shiftright("__id", 33)).count().collect()]
    assert len(sizes) > 12 and max(sizes) < 2 * 20_000 / 16
    got = placed.orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 20_001))
    keys = [(r.t, r.k) for r in got]
    assert keys == sorted(keys)


def test_places_of_nulls_and_none(spark):
    rows = spark.createDataFrame([("b",), (None,), ("a",), (None,)], "t string")
    assert [(r.t, r.place) for r in ranking.sorted_places(rows, ["t"]).orderBy("place").collect()] == [(None, 1), (None, 2), ("a", 3), ("b", 4)]
    assert ranking.sorted_places(rows.limit(0), ["t"]).count() == 0


def plain_bootstrap(x, replicates, block, seed=42):
    """The same draws one after another."""
    n, out = len(x), []
    for b in range(replicates):
        counts = {}
        for j in range(n):
            k = int(np.floor(evaluation.draws(seed, 1, np.array([b]), 0, np.array([j]))[0] * n)) // block
            counts[k] = counts.get(k, 0) + 1
        rows = [k * block + int(np.floor(evaluation.draws(seed, 2, np.array([b]), k, np.array([j]))[0] * min(block, n - k * block))) for k, c in counts.items() for j in range(c)]
        assert len(rows) == n
        out.append((b, n, sum(x[r] for r in rows) / n))
    return out


@pytest.mark.parametrize("block", [4, 1000])
def test_replicates_have_n_draws(spark, monkeypatch, block):
    x = [float(i * i % 17) for i in range(30)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, v double").repartition(3)
    metric = {"s": F.col("v"), "one": F.lit(1)}, F.col("s") / F.col("one")
    for at_once in (evaluation.DRAWS, 7):
        monkeypatch.setattr(evaluation, "DRAWS", at_once)
        got = evaluation.bootstrap(rows, ["id"], metric, 25, block=block).orderBy("b").collect()
        assert [(r.b, r.draws, round(r.score, 9)) for r in got] == [(b, n, round(s, 9)) for b, n, s in plain_bootstrap(x, 25, block)]


def test_draws_are_uniform():
    u = evaluation.draws(1, 2, np.repeat(np.arange(50), 4000), 3, np.tile(np.arange(4000), 50))
    assert abs(u.mean() - 0.5) < 0.003 and abs(np.bincount((u * 10).astype(int)) / len(u) - 0.1).max() < 0.004
    assert len(np.unique(u)) == len(u)


def test_no_rows_have_no_replicates(spark):
    rows = spark.createDataFrame([], "id long, v double")
    assert evaluation.bootstrap(rows, ["id"], ({"s": F.col("v")}, F.col("s")), 5).count() == 0


def test_texts_are_translated_in_their_rows(spark, monkeypatch):
    rng = random.Random(2)
    words = ["ev", "Ev", "EV", "EV-NOM", "ev-", "-x", "12", "1.5-PL", "İzmir", "izmir-PL", "kedi", "gel-V-PST", "", "é"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(60)] + [(60, None), (61, "  \n\t "), (None, "ev ev"), (62, "ev"), (62, "ev")]
    texts = spark.createDataFrame(rows, "doc long, text string").repartition(3).withColumn("w", F.lit(1))
    entries = spark.createDataFrame([("ev", "house", 0), ("izmir", "smyrna", 1), ("gel", "come", 2), ("é", "e", 3)], "src string, tgt string, first_pos int")
    got = dictionary.applied(texts, entries, "doc", F.col("text"))
    by_tokens = dictionary.rejoined(dictionary.translated_tokens(texts.where("doc < 62"), entries, "doc", F.col("text")), "doc")
    assert sorted(tuple(r) for r in got.where("doc < 62").collect()) == sorted((r.doc, r.n_tokens, r.n_replaced, r.text) for r in by_tokens.collect())
    assert sorted((str(r.doc), r.n_tokens, r.text) for r in got.where("doc is null or doc = 62").collect()) == [("62", 1, "house"), ("62", 1, "house"), ("None", 2, "house house")]
    monkeypatch.setattr(sizes, "MOST_BYTES", 0)
    joined = dictionary.applied(texts.where("doc < 62"), entries, "doc", F.col("text"))
    assert sorted(map(tuple, joined.collect())) == sorted(tuple(r) for r in got.where("doc < 62").collect())
    assert dictionary.applied(texts.limit(0), entries, "doc", F.col("text")).count() == 0


def test_coverage_counts_words_first(spark):
    texts = spark.createDataFrame([(0, "ev kedi ev 12"), (1, None), (2, "EV at")], "doc long, text string")
    entries = spark.createDataFrame([("ev", "house", 0)], "src string, tgt string, first_pos int")
    one = dictionary.coverage_of_texts(texts, entries, F.col("text"), 1).first()
    assert one == dictionary.coverage(dictionary.translated_tokens(texts, entries, "doc", F.col("text")), 1).first()
    assert (one.total_words, one.replaced, one.used_exact) == (6, 4, 1)
