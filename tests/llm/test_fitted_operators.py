"""Near-dedup, toxicity, HTML templates and the pipeline."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lexloom.llm import html_template, minhash, toxicity
from lexloom.llm._text import Words
from lexloom.llm.components import connected_components


def classes_by_hand(rows, idf, threshold=0.8):
    h, w, b = minhash.weighted_shingles(Words(pa.array([t or "" for _, t in rows])), idf)
    sets = [dict(zip(h[x:y].tolist(), w[x:y].tolist(), strict=True)) for x, y in zip(b, b[1:], strict=False)]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = sum(min(v, sets[j][k]) for k, v in sets[i].items() if k in sets[j])
            every = sum(sets[i].values()) + sum(sets[j].values()) - both
            if (rows[i][1] or "") == (rows[j][1] or "") or every and both / every >= threshold:
                top[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("most", [4096, 8])
def test_near_classes(spark, rng, most):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 60, 150]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 3, 12])):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = minhash.document_frequencies(df)
    want = classes_by_hand(rows, (found.words, found.weights()))
    got = {r.doc_id: r.class_id for r in minhash.near_classes(df, most=most).collect()}
    assert got == want
    assert sorted(r.doc_id for r in minhash.keep_one(df).collect()) == sorted(set(want.values()))


def near_copies(rng, n, length, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(length)]
    rows = []
    for i in range(n):
        copy = list(base)
        for at in rng.sample(range(length), rng.choice(edits)):
            copy[at] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    return rows


def both_ways(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = minhash.document_frequencies(df)
    return {r.doc_id: r.class_id for r in minhash.near_classes(df, **how).collect()}, classes_by_hand(rows, (found.words, found.weights()))


def test_partners_beyond_the_best_three(spark, rng):
    got, want = both_ways(spark, near_copies(rng, 300, 400, [5, 6, 7]))
    assert 1 < len(set(want.values())) < 300
    assert got == want


def test_large_buckets_are_not_cut(spark, rng):
    got, want = both_ways(spark, near_copies(rng, 200, 400, [5, 6, 7]), most=8, block=(16, 32), block_bytes=(20_000, 60_000))
    assert 1 < len(set(want.values())) < 200
    assert got == want


def test_one_class_of_many(spark, rng):
    """Copies, each near to one text but not to each other: every one joins its class."""
    got, want = both_ways(spark, near_copies(rng, 1000, 120, [0, 2, 2, 2]))
    assert max(list(want.values()).count(c) for c in set(want.values())) > 900
    assert sum(got[d] == want[d] for d in want) >= 0.99 * len(want)


def test_frequencies(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "b")], "doc_id long, text string")
    found = minhash.document_frequencies(df)
    assert sorted(found.df.tolist()) == [1, 1, 3] and found.n == 4 and found.others == 0
    few = minhash.document_frequencies(df, known=1)
    assert few.df.tolist() == [3] and few.others == 1 and few.weights()[-1] > few.weights()[0]


def test_rows_with_one_id(spark, rng):
    (_, one), (_, two) = near_copies(rng, 2, 300, [1])
    other = " ".join(f"q{i}" for i in range(50))
    df = spark.createDataFrame([(1, one), (5, other), (5, two), (7, other)], "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_classes(df).collect())) == [(1, 1), (5, 1), (5, 5), (7, 5)]
    assert sorted(map(tuple, minhash.keep_one(df).collect())) == [(1, one), (5, other)]


def test_sampling_follows_similarity():
    idf = np.zeros(0, np.uint64), np.ones(1)
    gen = np.random.default_rng(3)
    a = [f"w{i}" for i in gen.integers(0, 10**6, 400)]
    b = [*a[:300], *(f"v{i}" for i in gen.integers(0, 10**6, 100))]
    one, two = (minhash.weighted_shingles(Words(pa.array([" ".join(x)])), idf) for x in (a, b))
    exact = minhash.similarities(one, two)[0]
    drawn = (minhash.signatures(*one, 2000) == minhash.signatures(*two, 2000)).mean()
    assert abs(exact - drawn) < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 40), (40, 50), (50, 30), (60, 60)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {30: 30, 40: 30, 50: 30}


def labelled(spark, rng, n=600):
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("ra", "se", "ni", "po", "vu")]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        for _ in range(toxic * rng.randrange(2, 5)):
            words[rng.randrange(len(words))] = rng.choice(["grunk", "zorbs"]) + rng.choice(["", "en", "ish"])
        if rng.random() < (0.8 if toxic else 0.1):  # a group that toxic texts mention more often
            words.insert(0, "muslim")
        rows.append((i, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity(spark, rng):
    data = labelled(spark, rng)
    docs, labels = data.drop("toxic"), data.select("doc_id", "toxic")
    out = toxicity.report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 80
    assert sum(r.predicted == r.toxic for r in out) >= 0.97 * len(out)
    probe = spark.createDataFrame([(1, "kara muslim lose mini"), (2, "kara lose mini"), (3, "kara grunken lose"), (4, None), (5, "")], "doc_id long, text string")
    free = {r.doc_id: r.score for r in toxicity.score(probe, toxicity.train(docs, labels, cf_weight=0.0)).collect()}
    held = {r.doc_id: r.score for r in toxicity.score(probe, toxicity.train(docs, labels)).collect()}
    assert held[1] - held[2] < free[1] - free[2] and held[1] < 0.5 < held[3]
    assert held[4] == held[5]
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert {r.score for r in toxicity.report(docs, labels.limit(0)).collect()} == {0.0}


def test_toxicity_does_not_depend_on_partitions(spark, rng):
    data = labelled(spark, rng, 300)
    scores = []
    for parts in (1, 7):
        docs = data.drop("toxic").repartition(parts)
        scores.append(sorted((r.doc_id, r.score) for r in toxicity.report(docs, data.select("doc_id", "toxic")).collect()))
    assert np.allclose([x for _, x in scores[0]], [x for _, x in scores[1]], atol=1e-9)


def test_toxicity_held_out_and_neutral_mentions(spark):
    """On the supplied labels: accuracy on rows that were not learnt from, and neutral mentions."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).join(labels.where("toxic is not null"), "doc_id").where(toxicity.held_out("doc_id")).collect()
    assert len(out) > 40 and sum((r.score >= 0.5) == (r.toxic == 1) for r in out) >= 0.95 * len(out)
    terms = [t for kind in toxicity.IDENTITY_KINDS for t in kind]
    probe = spark.createDataFrame([(i, f"the {t} of the town read a book and on the way home met a friend") for i, t in enumerate(terms)], "doc_id long, text string")
    assert sum(r.score >= 0.5 for r in toxicity.score(probe, model).collect()) == 0


FRAME = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/x'>menu</a></ul></nav><div class='ad'>buy &amp; save</div>{}<footer>&copy; us</footer></body></html>"


def test_html(spark):
    article = "<article><h1>Head&nbsp;{0}</h1><p><b>Bold {0}<br><p>a &lt;b\n c</p><aside>no</aside></article><div class='comments'>me too</div>"
    bare = "<div class='x'><p>First {0} text that is long</p><p>second {0}</p></div><div class='y'>same everywhere</div>"
    rows = [(i, "http://h/1", FRAME.format(article.format(i))) for i in range(4)] + [(10 + i, "http://g/1", FRAME.format(bare.format(i))) for i in range(6)]
    rows += [(20, None, None), (21, "", ""), (22, "http://z/", "plain &am"), (23, "http://z/", "<article><p>cut <b>off"), (24, "x", "<p>" + "w " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (200_000, 0):  # templates broadcast, and joined
        got = {r.page_id: r for r in html_template.extract(pages, broadcast_tokens=limit).collect()}
        assert len(got) == len(rows)
        assert [got[i].text for i in range(4)] == [f"Head {i}\nBold {i}\na <b c" for i in range(4)]
        assert [got[10 + i].text for i in range(6)] == [f"First {i} text that is long\nsecond {i}" for i in range(6)]
        assert [got[i].text for i in (20, 21, 22, 23)] == ["", "", "plain &am", "cut off"]
        assert got[24].n_chars == 99_999
    classes = {r.host: r.classes for r in html_template.deduce(pages).collect()}
    assert "h" in classes and "g" in classes and "z" not in classes


def pages_of(spark, sources, host="h"):
    return spark.createDataFrame([(i, f"http://{host}/{i}", x) for i, x in enumerate(sources)], "page_id long, url string, html string")


def without_template(sources):
    return [html_template.Page(x).main_text() for x in sources]


def test_html_by_template_alone(spark):
    """No element or name says what is what: only that menus, notices and ends repeat."""
    body = "<div class='qa'><div class='qb'><a href='/a'>one</a> <a href='/b'>page {0}</a></div><div class='qc'><div class='qd'>head {0}</div><div class='qe'>text of {0}<div class='qf'>more {0}</div></div></div><div class='qg'>all rights</div></div>"
    sources = [body.format(i) for i in range(8)]
    got = {r.page_id: r.text for r in html_template.extract(pages_of(spark, sources)).collect()}
    assert [got[i] for i in range(8)] == [f"head {i}\ntext of {i}\nmore {i}" for i in range(8)]
    assert sum(got[i] != t for i, t in enumerate(without_template(sources))) == 8


def test_html_inside_articles(spark):
    notice = "<div class='zz'>Support us today</div><div class='share-of-voice'>Share {0} of voice</div>"
    sources = [f"<article><h1>Head {i}</h1>{notice.format(i) if i < 12 else ''}<p>{'long text ' * 9}{i}</p></article><article><p>second {i}</p></article>" for i in range(12)]
    sources[3] = sources[3].replace("<article><p>", "<article><div class='side'>Side A of the record</div><p>")
    got = {r.page_id: r.text for r in html_template.extract(pages_of(spark, sources)).collect()}
    assert all("Support us" not in t and t.endswith(f"second {i}") and t.startswith(f"Head {i}\n") for i, t in got.items())
    assert "Side A of the record" in got[3] and "Side A of the record" in without_template(sources)[3]
    copies = ["<article><h1>Same</h1><p>words of all</p></article>"] * 9
    assert {r.text for r in html_template.extract(pages_of(spark, copies)).collect()} == {"Same\nwords of all"}


def test_classes_by_hand(spark, rng):
    sources = [f"<div class='a'>{'<p>x</p>' * rng.randrange(3)}<ul>{''.join(f'<li>{rng.randrange(3)}</li>' for _ in range(rng.randrange(4)))}</ul></div><div class='b'>{'same' if rng.random() < 0.8 else i}</div>" for i in range(8)]
    counts: dict = {}
    for i, x in enumerate(sources):
        for t, _, _ in html_template.Page(x).tokens:
            counts.setdefault(html_template.token_hash(t), [0] * 8)[i] += 1
    by_vector: dict = {}
    for t, v in counts.items():
        if sum(map(bool, v)) >= 3:
            by_vector.setdefault(tuple(v), set()).add(t)
    want = {frozenset(x) for x in by_vector.values() if len(x) >= 2}
    found: dict = {}
    for c in html_template.deduce(pages_of(spark, sources)).first().classes:
        found.setdefault(c.vector, set()).add(c.token)
    assert {frozenset(x) for x in found.values()} == want


def test_html_awkward(spark):
    pages = spark.createDataFrame([(None, "http://h/", "<p>a"), (1, None, "<p>b"), (1, None, "<p>b"), (2, "u", None)], "page_id long, url string, html string").selectExpr("*", "1 as id", "'' as host", "2 as classes", "0 as text")
    got = sorted(map(tuple, html_template.extract(pages).select("page_id", "text", "n_chars").collect()), key=str)
    assert got == sorted([(None, "a", 1), (1, "b", 1), (1, "b", 1), (2, "", 0)], key=str)
    assert html_template.extract(pages.limit(0)).count() == 0


SAID = "She said yes and went away for a long time."


@pytest.mark.parametrize(
    "page",
    [
        '<article class="post comments-open"><p>{}</p></article>',
        '<body class="single comments-open"><div><p>{}</p></div></body>',
        '<div class="side-by-side"><p>{}</p></div>',
        '<div class="share-of-voice"><p>{}</p></div>',
        '<body><form action=x><p>{}</p><select><option>a</select></form></body>',
        '<div class="content-sidebar-wrap"><article><p>{}</p></article><div class="sidebar">links</div></div>',
        '<article><p class=x">{}</article>',
        '<p title="a > b" hidden>no</p><p data-t=a=b/c>{}</p>',
        '<article><p>{}</p><form>subscribe <input></form></article><div id="comments"><article class="comment"><p>great post, and a comment that is much longer than the post that it is about</p></article></div>',
        '<div class="ad">buy</div><p>{}</p><form>subscribe</form><div class=comments>no no no no no no no no no no no no no no no no no no no no no no no no no no no</div>',
        '<div class="related-posts"><a href=x>one</a> <a href=y>another post that is not this one</a></div><p>{}</p>',
    ],
)
def test_html_class_words_only_confirm(page):
    assert html_template.Page(page.format(SAID)).main_text() == SAID


def test_html_quotes_inside_values_and_without_end():
    read = lambda x: html_template.Page(x).main_text()
    assert read("<p data-t=it's>I don't know.</p><p>He can't.</p>") == "I don't know.\nHe can't."
    assert read('<p a="x>y" b=\'<p>\' c>text</p>') == "text"
    assert read('one<p a="never closed>text') == "one"
    assert read("<div class=comment>only this</div>") == "only this"
    for odd in ("<a " + "b " * 50_000, "<a " + 'b="c ' * 50_000, "<" * 50_000, ("<p " + " " * 1000) * 50, "<div class=ad>" * 50_000 + "x"):
        read(odd)  # in linear time


def test_html_keeps_all_parts():
    split = "<div class='title'><h1>Head</h1></div><div class='body'><section class='a'><p>a long first part</p></section><section class='b'><p>second</p></section></div>"
    assert html_template.Page(FRAME.format(split)).main_text() == "Head\na long first part\nsecond"
    several = "<main><h1>Head</h1><article><p>a long first part</p></article><article><p>second</p></article><div class='share'>no</div></main>"
    assert html_template.Page(FRAME.format(several)).main_text() == "Head\na long first part\nsecond"


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf_dir)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert 0 < len(rows) <= seen.count()
        seen = spark.createDataFrame(rows, docs.schema)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in whole} == {r.doc_id for r in seen.collect()}
    assert all(r.n_tokens == len(r.token_ids) for r in whole)


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(0, 0), (1, None), (2, 1), (3, 0), (None, 1), (3, 1)], "doc_id long, toxic int").selectExpr("*", "1 as text", "0 as id")
    scored = toxicity.report(awkward, labels).collect()
    assert len(scored) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert [r.held_out for r in scored if r.doc_id is None] == [False]
    assert toxicity.report(awkward.limit(0), labels).count() == 0
    got = {r.doc_id: r.class_id for r in minhash.near_classes(awkward).collect()}
    assert got[4] == got[3] == 3 and got[1] == got[0] == 0 and None not in got
    kept = minhash.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id is null").count() == 1
    assert minhash.near_classes(awkward.limit(0)).count() == 0


def test_stages_on_awkward_rows(spark, awkward, sf_dir):
    """Each stage keeps the columns, and clean rows of any kind; and takes an empty table."""
    odd = awkward.withColumnRenamed("key", "row").withColumnRenamed("digest", "others")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns, name
        texts = [r.text for r in out.collect()]
        assert "stray row" in texts and "a" in texts and (None in texts or "" in texts), name
        assert stage(spark, odd.limit(0), sf_dir).count() == 0, name
    name, last = corpus_pipeline.STAGES[-1]
    assert last(spark, odd, sf_dir).count() == odd.count() and last(spark, odd.limit(0), sf_dir).count() == 0
