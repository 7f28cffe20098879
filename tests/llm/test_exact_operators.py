"""Operators whose results a brute-force version gives exactly."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexloom.llm import bpe, decontam, line_dedup, mpeg, suffix_dedup, token_shards, warc
from lexloom.llm.suffix_array import adjacent_prefixes, two_stage_sort, words_at

from .conftest import texts


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("least", [1, 4, 12])
def test_line_dedup(spark, rng, least):
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5))) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(8)))) for i in range(60)] + [(60, None), (61, "\n\n")]
    want = sorted(line_dedup.brute_force(docs, least))
    assert rows_of(line_dedup.report(frame(spark, docs), min_words=least)) == want
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, docs), min_words=least).collect()}
    for d, n, removed, _, digest in want:
        assert (d in kept) == (not removed or removed < n)
        if d in kept:
            assert hashlib.sha256((kept[d] or "").encode()).hexdigest() == digest


def test_line_dedup_of_rows_with_one_id(spark):
    one, other = ("\n".join(f"{a} {i} b c d e f g h" for i in range(12)) for a in "xy")
    docs = spark.createDataFrame([(1, one, 5), (7, one, 6), (7, other, 7), (7, other, 8), (None, one, 9)], "doc_id long, text string, __runs int").selectExpr("*", "1 as runs", "2 as row", "3 as key", "'' as id")
    got = sorted((r.n_removed for r in line_dedup.report(docs.where("doc_id is not null")).collect()))
    assert got == [0, 0, 0, 12]
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns
    assert sorted((r["__runs"], r.text) for r in kept.collect()) == [(5, one), (7, other), (8, other), (9, one)]


def test_only_minima_travel(spark, rng):
    """Of windows of w lines about 2 / (w + 1) of the positions are selected."""
    docs = [(i, "\n".join(f"{rng.random()} a b c" for _ in range(400))) for i in range(20)]
    slim = frame(spark, docs).selectExpr("doc_id as id", "text as body", "0L as key")
    assert line_dedup._selected(slim, 45).count() < 0.35 * 20 * 400


def test_many_blocks_read_the_documents_twice(spark, rng):
    docs = texts(rng, 60, "abcd  ", 60) + [(60, None), (61, "x y z"), (61, "a b c d e f g")]
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7)))) for i in range(50)]
    table = spark.createDataFrame(items, "item_id long, text string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    source = frame(spark, docs)
    got = rows_of(decontam.report(source.mapInArrow(counted, source.schema), table, window=3, block_bytes=12))
    assert got == sorted(decontam.brute_force(docs, items, 3))
    assert 0 < read.value <= 2 * len(docs)
    parts = [rows_of(decontam.decontaminate(source.where("text is not null"), table, window=3, block_bytes=b)) for b in (12, 1_000_000)]
    assert parts[0] == parts[1]


def test_windows_are_marked_in_chunks(spark, rng, monkeypatch):
    monkeypatch.setattr(decontam, "MARKS", 5)
    docs = texts(rng, 40, "abc  ", 40)
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))) for i in range(20)]
    got = rows_of(decontam.report(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), window=2, block_bytes=9))
    assert got == sorted(decontam.brute_force(docs, items, 2))


@pytest.mark.parametrize(("window", "block"), [(2, 1_000_000), (4, 1_000_000), (3, 60)])
def test_decontamination(spark, rng, window, block):
    docs = texts(rng, 80, "abcd  ", 60) + [(80, None), (81, ""), (82, "A b C d")]
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(7)))) for i in range(14)] + [(14, None), (15, "a b c d"), (16, "a b c d")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontam.brute_force(docs, items, window))
    assert rows_of(decontam.report(frame(spark, docs), table, window=window, block_bytes=block)) == want
    clean = {r.doc_id: r.text for r in decontam.decontaminate(frame(spark, docs), table, window=window, max_coverage=1.0, block_bytes=block).collect()}
    assert all(clean[d] == t for (d, t), w in zip(sorted(docs), want, strict=True) if not w[2])
    assert rows_of(decontam.report(frame(spark, docs), table.limit(0), window=window)) == [(d, n, 0, 0, hashlib.sha256(b"").hexdigest(), False) for d, n, *_ in want]


@pytest.mark.parametrize("hot", [50_000, 3])
def test_suffix_dedup(spark, rng, hot):
    parts = ["".join(rng.choice("abcé ") for _ in range(rng.choice([30, 55, 80, 200]))) for _ in range(12)]
    noise = lambda: "".join(rng.choice("xyz ") for _ in range(rng.randrange(60)))
    docs = [(i * 3 % 151, "".join(rng.choice([rng.choice(parts)[rng.randrange(5) :], noise()]) for _ in range(rng.randrange(6)))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, "a" * 49), (1003, "a" * 50), (1004, "a" * 300)] + [(2000 + i, docs[5][1]) for i in range(4)]
    docs += [docs[9], (docs[9][0], docs[11][1] + parts[0]), (3000, docs[11][1] + parts[0] + "q"), (docs[12][0], None)]
    assert rows_of(suffix_dedup.report(frame(spark, docs), hot=hot, sampled=1)) == sorted(suffix_dedup.brute_force(docs))
    assert suffix_dedup.report(frame(spark, docs).limit(0)).count() == 0


def test_suffix_array():
    gen = np.random.default_rng(1)
    for _ in range(30):
        text = (gen.integers(0, gen.integers(2, 6), gen.integers(60, 400)) + gen.integers(0, 250)).astype(np.uint8)
        wanted = np.flatnonzero(gen.random(len(text) - 49) < 0.7)
        words = words_at(text)
        order = two_stage_sort(text, wanted, 50, words)
        spelled = [text[i : i + 50].tobytes() for i in order]
        assert sorted(order) == sorted(wanted) and spelled == sorted(spelled)
        common = adjacent_prefixes(order, 50, words)
        for a, b, n in zip(spelled, spelled[1:], common[1:], strict=False):
            assert n == next((k for k in range(50) if a[k] != b[k]), 50)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_is_the_library(spark, rng, library):
    alphabets = ["ab", "abc '", "the and of in\n  ", "aé ñß　\x1c\x85١²ⅷ一", "𝒜𐐀🙂 a'", "'st'llve' d\t\n"]
    docs = [(i, "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([0, 1, 9, 200])))) for i in range(200)]
    docs += [(300, None), (301, "a" * 5000), (302, " " * 3000 + "x"), (303, "x<|endoftext|> y"), (304, "ab" * 40_000), (305, "the " * 30_000)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert rows_of(bpe.encode(frame(spark, docs))) == sorted(want)
    full = {r.doc_id: r.token_ids for r in bpe.encode(frame(spark, docs), with_ids=True).collect()}
    assert full[304] == library.encode("ab" * 40_000, add_special_tokens=False).ids


def test_transducer_keeps_no_more_than_its_lookahead(library):
    coder = bpe.ByteBPE(bpe.load(bpe.default_vocabulary()))
    most = 0

    def parts():
        nonlocal most
        for _ in range(5000):
            yield b"abcabd"
            most = max(most, len(stream.gi_frame.f_locals["last"]))

    stream = coder.stream(parts())
    assert list(stream) == library.encode("abcabd" * 5000, add_special_tokens=False).ids
    assert coder.lookahead == max(len(a + b) for a, b in bpe.load(bpe.default_vocabulary())["merges"])
    assert most <= 5 * coder.lookahead + len(b"abcabd")


def test_digests_of_long_texts(library):
    batch = bpe.Batch(bpe.ByteBPE(bpe.load(bpe.default_vocabulary())))
    text = "the of and é 12 " * 70_000
    ids = library.encode(text, add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert batch.is_odd(text) and batch.digests(text) == (len(ids), sha(",".join(map(str, ids))), sha(text))
    assert batch.digests("") == (0, sha(""), sha(""))


def walked(media):
    """Frames and payload of our own streams, by the formula of MPEG-1 Layer III and nothing else."""
    at = 10 + int("".join(f"{b:07b}" for b in media[6:10]), 2)
    size = int(media[10:at].split(b"payload-bytes\0")[1])
    kbits = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    offsets, bodies = [], []
    while media[at : at + 3] != b"TAG":
        assert media[at : at + 2] == b"\xff\xfa"
        length = 144_000 * kbits[media[at + 2] >> 4] // 44_100
        if media[at + 23 : at + 27] != b"Xing":
            offsets.append(at)
            bodies.append(media[at + 23 : at + length])
        at += length
    return offsets, b"".join(bodies)[:size]


def test_mpeg_other_streams():
    for head, length, samples, rate in ((b"\xff\xf3\x84\xc0", 192, 576, 24000), (b"\xff\xe3\x88\xc0", 576, 576, 8000), (b"\xff\xfd\x84\x00", 384, 1152, 48000), (b"\xff\xff\x84\x00", 256, 384, 48000)):
        stream = (head + bytes(length - 4)) * 5
        p = mpeg.parse(b"junk" + stream)
        assert (len(p.offsets), p.samples, p.rate, p.skipped) == (5, 5 * samples, rate, 4), head
    frame = b"\xff\xfb\x94\x00"
    table = frame + bytes(32) + b"VBRI" + (1).to_bytes(2, "big") + bytes(4) + (5 * 384).to_bytes(4, "big") + (4).to_bytes(4, "big") + bytes(8)
    p = mpeg.parse(table + bytes(384 - len(table)) + (frame + bytes(380)) * 4)
    assert p.table[:3] == ("VBRI", 4, 5 * 384) and p.table_holds() and len(p.offsets) == 4
    tag = b"ID3\x03\0\0" + bytes((0, 0, 0, 15)) + b"TIT2" + (5).to_bytes(4, "big") + b"\0\0" + b"\x01\xff\xfeH\0"
    old = b"TAG" + b"Title".ljust(30, b"\0") + b"Band".ljust(30, b"\0") + bytes(30) + b"1999" + bytes(28) + b"\0\x07" + b"\xff"
    p = mpeg.parse(tag + (frame + bytes(380)) * 2 + old)
    assert p.tags["TIT2"] == "H" and p.tags["title"] == "Title" and p.tags["artist"] == "Band" and p.tags["year"] == "1999" and p.tags["track"] == "7"


def test_mpeg_round_trip(spark, rng):
    for n in (64, 128, 1024, 5056, 99_968):
        payload = bytes(rng.randrange(256) for _ in range(n))
        media = mpeg.mux(payload)
        p = mpeg.parse(media)
        assert p.payload() == payload and not p.skipped and not p.bad_crc
        assert p.table[:2] == ("Xing", len(p.offsets)) and p.table_holds() and p.samples == 1152 * len(p.offsets)
        assert walked(media) == (p.offsets, payload)
        assert all(mpeg.header_at(media, at) for at in p.offsets)
        noisy = mpeg.parse(b"\xff\xfb\x00junk" + media[media.index(b"\xff\xfa") :])  # resynchronises
        assert noisy.skipped == 7 and b"".join(noisy.bodies)[:n] == payload
        broken = bytearray(media)
        broken[p.offsets[0] + 10] ^= 1  # side information
        assert mpeg.parse(bytes(broken)).bad_crc == 1
    docs = [(0, None), (1, "x"), (2, "é" * 32), (3, "y" * 3000)]
    for r in mpeg.media_features(frame(spark, docs)).collect():
        raw = (dict(docs)[r.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


@pytest.mark.parametrize("sent", [1000, 0])
def test_warc(spark, rng, sent):
    same, small = "<p>" + "x" * 200, "tiny"
    rows = [(5, "http://a/1", same), (3, "http://a/2", same), (9, None, same), (4, "http://b\r\n/", small), (2, "u", small), (7, "v", None), (8, "w", "WARC/1.1\r\n\r\n" * 20), (11, "w", "é\n\r\n" * 100)]
    rows += [(None, "n", same), (None, "n", small), (None, None, "only " * 50), (12, "w", same + "2"), (12, "w", same + "3"), (12, "w", same + "3")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as id", "2 as digest", "'' as own", "0 as page")
    got = warc.archive_report(pages, sent=sent, archive_bytes=400).collect()
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min((k for k, _, h in rows if h == html and k is not None), default=None)
        again = len(raw) >= 100 and first is not None and first != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert warc.archive_report(pages.limit(0)).count() == 0
    odd = ["a\r\nb", "", " ", "é/%2F"]
    named = spark.createDataFrame([(i, "u", same) for i in odd], "page_id string, url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc.archive_report(named).collect()} == {(i, None if i == min(odd) else min(odd)) for i in odd}


def test_warc_members(spark, tmp_path):
    """Each record is a gzip member of its own, and every file begins with what it is."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", "<p>" + "y" * (200 + i % 3)) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("*.warc.gz")
    data, kinds = file.read_bytes(), []
    while data.strip(b"\0"):
        member = zlib.decompressobj(31)
        text = member.decompress(data)
        data = member.unused_data
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        kinds.append(text.split(b"WARC-Type: ")[1].split(b"\r\n")[0])
    assert kinds[0] == b"warcinfo" and kinds.count(b"response") == 3 and kinds.count(b"revisit") == 17
    whole = warc.read(spark, f"file://{tmp_path}/w", with_payload=True)
    assert sorted(r.payload.decode() for r in whole.where("payload is not null").collect()) == sorted("<p>" + "y" * (200 + i) for i in range(3))


def test_permutation_is_one():
    for n in (1, 2, 3, 5, 16, 17, 1000, 70_000):
        assert sorted(token_shards.permute(np.arange(n), n)) == list(range(n))
    assert token_shards.permute(np.arange(100), 100).tolist() != token_shards.permute(np.arange(100), 100, key=1).tolist()


def test_shards(spark, rng, library, tmp_path):
    docs = texts(rng, 60, "the of and \n", 900) + [(100, None), (101, "")]
    total = token_shards.write(frame(spark, docs), f"file://{tmp_path}/s", seq_len=32, per_shard=8)
    shards = spark.read.parquet(f"file://{tmp_path}/s").collect()
    assert sorted(r.first_slot for r in shards) == list(range(0, total, 8)) and {r.stride for r in shards} == {16 + 64}
    ids: dict = {}
    for s in shards:
        for k in range(s.n_slots):
            record = s.data[k * s.stride : (k + 1) * s.stride]
            head = np.frombuffer(record[:16], token_shards.HEAD)[0]
            ids.setdefault(int(head["doc"]), {})[int(head["part"])] = np.frombuffer(record[16 : 16 + 2 * head["n"]], "<u2").tolist()
    for d, t in docs:
        assert [x for _, part in sorted(ids.get(d, {}).items()) for x in part] == library.encode(t or "", add_special_tokens=False).ids
    again = token_shards.write(frame(spark, docs[::-1], 3), f"file://{tmp_path}/t", seq_len=32, per_shard=8)
    whole = rows_of(token_shards.read(spark, f"file://{tmp_path}/s", seq_len=32, per_shard=8))
    assert again == total and rows_of(token_shards.read(spark, f"file://{tmp_path}/t", seq_len=32, per_shard=8)) == whole
    plan = token_shards.read(spark, f"file://{tmp_path}/s", from_slot=13, seq_len=32, per_shard=8)._jdf.queryExecution().toString()
    assert "GreaterThan(first_slot,5)" in plan
    assert [r[0] for r in whole] == list(range(total))
    assert rows_of(token_shards.read(spark, f"file://{tmp_path}/s", from_slot=13, seq_len=32, per_shard=8)) == whole[13:]


ITEM = "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11"


def test_awkward_rows(spark, awkward):
    docs = awkward.where("doc_id is not null")
    n = docs.count()
    assert line_dedup.report(docs).count() == suffix_dedup.report(docs).count() == bpe.encode(docs).count() == mpeg.media_features(docs).count() == n
    assert line_dedup.dedup_lines(awkward).columns == awkward.columns
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    hit = {r.doc_id: r.contaminated for r in decontam.report(docs, items).collect()}
    assert hit == {0: False, 1: False, 2: False, 3: True, 4: True, 5: False, 6: False, 7: False}
    assert decontam.decontaminate(awkward, items).columns == awkward.columns
    assert token_shards.report(awkward).count() > 0


def test_awkward_values(spark, awkward, library):
    """Null ids, repeated rows and odd columns: each row has the result of its text."""
    rows = [(r.doc_id, r.text or "") for r in awkward.collect()]
    sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
    key = lambda r: (r[0] is None, *map(str, r))
    ids = [library.encode(t, add_special_tokens=False).ids for _, t in rows]
    want = [(d, len(i), sha(",".join(map(str, i))), sha(t)) for (d, t), i in zip(rows, ids, strict=True)]
    assert sorted(map(tuple, bpe.encode(awkward).collect()), key=key) == sorted(want, key=key)
    padded = [t.encode() + bytes(max(64, -(-len(t.encode()) // 64) * 64) - len(t.encode())) for _, t in rows]
    want = [(d, len(t.encode()), len(p), sha(p)) for (d, t), p in zip(rows, padded, strict=True)]
    media = mpeg.media_features(awkward)
    assert sorted(map(tuple, media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256").collect()), key=key) == sorted(want, key=key)
    assert media.where("feature not like '%stored=ok' or feature not like '%/ok;%'").count() == 0
    items = spark.createDataFrame([(1, ITEM), (None, "one two"), (2, None)], "item_id long, text string").selectExpr("*", "1 as id", "'' as body", "0 as runs")
    want = sorted(decontam.brute_force(rows, [(1, ITEM)]), key=key)
    assert sorted(map(tuple, decontam.report(awkward, items).collect()), key=key) == want
    kept = {r.doc_id: r.text for r in decontam.decontaminate(awkward.withColumnRenamed("id", "others"), items, max_coverage=1.0).collect()}
    assert len(kept) == len({d for d, _ in rows}) and kept[None] == "stray row" and "word5 " not in kept[3][:80]
    told = {(r.doc_id, r.part): r.n_tokens for r in token_shards.report(awkward).collect()}
    assert sum(told.values()) == sum(map(len, ids)) - len(ids[6]) and told[-1, 0] == len(ids[-1])  # equal rows are one key here
    kept = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(awkward).collect()]
    assert len(kept) == len(rows) - 1 and (None, "stray row") in kept and 4 not in dict(kept)  # 4 is 3 again


def test_empty_tables(spark, awkward):
    none = awkward.limit(0)
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    for made in (bpe.encode(none), mpeg.media_features(none), line_dedup.report(none), line_dedup.dedup_lines(none), decontam.report(none, items), decontam.decontaminate(none, items), token_shards.report(none), suffix_dedup.report(none)):
        assert made.count() == 0
