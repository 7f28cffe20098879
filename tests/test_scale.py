"""Steps that once grew faster than their input: their results on odd rows, and their plans."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexloom.functions import metrics
from lexloom.operators import cosine, dictionary, morph, retrieval
from lexloom.plans import catalogue
from lexloom.streaming import runs


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def vectors(spark, n=400):
    draw = random.Random(5)
    rows = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(n)]
    for i in range(0, n, 7):
        rows[i] = rows[(i * 3) % n]  # equal ones
    for i in range(3, n, 11):
        rows[i] = [2 * x for x in rows[(i * 5) % n]]  # equal but for their length
    odd = [None, None, [], [0.0] * 6, [-0.0] * 6, [1.0, None, 2.0, 0.0, 0.0, 0.0], [1.0, None, 2.0, 0.0, 0.0, 0.0], [math.nan] * 6, [math.inf, 1.0, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [2.0, 4.0], [1e-200] * 6, [1e200] * 6]
    rows = [[float(np.float32(x)) for x in r] for r in rows] + odd
    order = [*range(len(rows))]
    draw.shuffle(order)
    return spark.createDataFrame([(i, rows[j]) for i, j in enumerate(order)], "vec_id long, embedding array<double>")


def test_cosine_by_products_is_the_same(spark, monkeypatch):
    table = vectors(spark)
    pool = table.select(F.col("vec_id").alias("cand_id"), F.col("embedding").alias("cand"))
    queries = table.where("vec_id % 3 = 0 or size(embedding) is null or size(embedding) <> 6 or embedding[0] = 0 or embedding[0] > 1e30 or embedding[1] is null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    told = retrieval.scored_topk(queries, pool, lambda a, b: F.round(metrics.cosine(a, b), 6), 4)
    want = sorted(map(repr, told.collect()))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        for size, rows in ((cosine.WAVE_BYTES, 10_000), (4000, 10_000), (cosine.WAVE_BYTES, 7)):
            monkeypatch.setattr(cosine, "WAVE_BYTES", size)
            spark.conf.set(batch, rows)
            got = retrieval.cosine_topk(queries, pool.coalesce(1) if rows == 7 else pool, 4)
            assert got.dtypes == told.dtypes
            assert sorted(map(repr, got.select(*told.columns).collect())) == want
    finally:
        spark.conf.unset(batch)
    assert retrieval.cosine_topk(queries.where("false"), pool).count() == 0
    assert retrieval.cosine_topk(queries, pool.where("false")).count() == 0


def test_cosine_has_no_nested_loop(spark):
    table = vectors(spark)
    plan = plan_of(retrieval.cosine_topk(table.selectExpr("vec_id as query_id", "embedding as query"), table.selectExpr("vec_id as cand_id", "embedding as cand")))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def words_table(spark, tmp_path, texts):
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_most_analysed_words_shuffle_words_alone(spark, tmp_path):
    texts = ["a b a b a c", "A b, a D", None, "", "...", "last", "a a", "_x 1 _x 2"]
    made = catalogue.most_analysed_words(spark, words_table(spark, tmp_path, texts))
    split = lambda t: "".join(c if c.isalnum() or c == "_" else " " for c in (t or "").lower()).split()
    rows = [(i, w, x) for i, t in enumerate(texts) for w, x in zip(split(t), [*split(t)[1:], None], strict=False)]
    rows = spark.createDataFrame(rows, "doc_id long, word string, nxt string")
    want = morph.word_analyses(rows, ["doc_id", "word"], "nxt").groupBy("word").agg(F.sum("analyses").alias("n")).orderBy(F.desc("n"), "word").limit(10)
    assert [tuple(r) for r in made.collect()] == [tuple(r) for r in want.collect()]
    assert made.count() == 8 and ("last", 0) in [tuple(r) for r in made.collect()]
    exchanges = [line for line in plan_of(made).split("\n") if "Exchange hashpartitioning" in line]
    assert exchanges and not any("doc_id" in line or "nxt" in line for line in exchanges)


class Calls:
    """A state, timers and a watermark that count the calls."""

    def __init__(self, watermark=0):
        self.held, self.calls, self.watermark = [], 0, watermark

    def __getattr__(self, name):
        def call(*values):
            self.calls += 1
            if name in ("getListState", "getValueState"):
                return Calls()
            if name == "appendValue":
                self.held.append(values[0])
            if name == "update":
                self.held = [values[0]]
            return iter(self.held)

        return call

    def get(self):
        self.calls += 1
        return self.held[0] if self.held and isinstance(self.held[0][0], int) and len(self.held[0]) == 6 else iter(self.held) if self.held else None

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_rows_of_a_key_go_to_the_state_in_packs():
    made = runs.BestOfRuns("user", 1000)
    made.init(Calls())
    line = lambda i: json.dumps({"at": i * 1000, "ord": i, "word": f"w{i // 3}", "analysis": "x", "score": float(i)})
    rows = [("u", None, i * 1000, line(i)) for i in range(5000)] + [("u", None, None, line(9))]
    assert [*made.handleInputRows(("u",), iter(rows), None)] == []
    assert made.waiting.calls <= 5
    out = [*made.handleExpiredTimer(("u",), Calls(10**9), None)]
    found = [run for row in out for run in json.loads(row.runs)]
    assert [(r["run"], r["word"], r["score"]) for r in found] == [(i + 1, f"w{i}", min(3.0 * i + 2, 4999.0)) for i in range(1667)]
    assert len(out) == 2


def test_runs_keep_odd_texts_and_scores(spark, tmp_path):
    rows = [("d", "2024-01-01 00:00:00", 0, 'a"\\\n,é😀', "[{x", math.nan), ("d", "2024-01-01 00:00:01", 1, "", None, math.inf), ("d", "2024-01-01 00:00:02", 2, "b", "", -math.inf), ("d", "2024-01-01 00:00:03", 3, "c", "y", 0.1 + 0.2), ("d", "2024-01-01 00:00:04", 4, "e", "y", None)]
    spark.createDataFrame(rows, "doc string, at string, ord long, word string, analysis string, score double").withColumn("at", F.col("at").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    runs.mark(spark, f"{tmp_path}/marks", "at", "2025-01-01 00:00:00")
    stream = runs.with_marks(spark.readStream.schema("doc string, at timestamp, ord long, word string, analysis string, score double").parquet(f"{tmp_path}/in"), f"{tmp_path}/marks", "at")
    found, got = runs.best_of_runs(stream, "doc", "at", "ord", 1000), []
    runs.run_to_end(lambda: found.writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(), spark)
    assert sorted(map(repr, got)) == sorted(repr(("d", i + 1, w, a, s)) for i, (_, _, _, w, a, s) in enumerate(rows))


def test_words_are_replaced_in_bounded_parts():
    known, outs = pa.array(["ev", "su"]), pa.array(["house", "water"])
    texts = [["ev"] * 3, ["x" * 50] * 40, [], ["su", "é", "ev"], *[["su", f"w{i}"] * 100 for i in range(3000)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.list_(pa.string()))], names=["line", "w"])
    whole = dictionary._replaced(batch, known, outs)
    for size in (100, 50_000):
        old, dictionary.PART_BYTES = dictionary.PART_BYTES, size
        try:
            parts = [*dictionary._parts(batch, "w")]
        finally:
            dictionary.PART_BYTES = old
        most = max(sum(len(t.encode()) + 1 for t in p.column("w").flatten().to_pylist()) for p in parts if p.num_rows > 1)
        assert most <= size or all(p.num_rows == 1 for p in parts)
        assert pa.Table.from_batches([dictionary._replaced(p, known, outs) for p in parts]).to_pylist() == whole.to_pylist()
    assert [*dictionary._parts(batch.slice(0, 0), "w")] == []
    assert whole.to_pylist()[3] == {"line": 3, "n_tokens": 3, "n_replaced": 2, "text": "water é house"}


def test_applied_peaks_below_a_batch():
    text = [[f"word{i % 50}" for i in range(2000)]] * 4000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(text))), pa.array(text, pa.list_(pa.string()))], names=["line", "w"])
    pool = pa.default_memory_pool()
    before = pool.bytes_allocated()
    most = 0
    for part in dictionary._parts(batch, "w"):
        made = dictionary._replaced(part, pa.array(["word1"]), pa.array(["x"]))
        most = max(most, pool.bytes_allocated() - before)
        del made
    assert most < batch.nbytes / 4
