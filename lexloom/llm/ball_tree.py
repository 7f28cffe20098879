"""Hard-negative mining by branch and bound over ball trees (operator 13).

Rows are packed where they lie into blocks (``vectors``), and each block gets a tree: rows are split
by label while a node has several, then at the middle of the distances to two far points. A node has
the ball round its rows (centre and radius) and the range of their labels. For an anchor q the inner
products with a node's rows lie between q.centre - |q| radius and q.centre + |q| radius.

Two passes go over the blocks, for one wave of anchors after another. The first finds an anchor's
positives, its best rows of its own label: a node is pruned if its labels leave the anchor's out, or if
its upper bound is strictly under the k-th best score known so far. The second searches a window of
scores for each anchor and positive, from ``LOW`` hundredths of the positive's score to all of it, for
rows of other labels: a node is pruned if its upper bound is under the window, its lower bound over it,
its upper bound strictly under the k-th best within the window, or all its rows have the anchor's
label. Bounds are widened by ``SLACK``. Leaves are scored exactly, in whole numbers. Anchors go down a
tree together, and what a task has found bounds its further blocks; each task's best rows are merged
by a ranking that Spark cuts before it shuffles.

Anchors are read from the blocks themselves and broadcast in waves of ``WAVE_BYTES``; a wave's
positives, k for each anchor, are broadcast with it. Every block is a row of a written table, so a
lost executor costs a re-read. A label that most rows have is spread over all blocks.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part;
an anchor is a row whose id is divisible by ``every``; a null id is no anchor and keeps its label, but
is found, and ranks after other ids of equal score; rows that share an id are rows of their own, and
only the anchor's own row is not among its positives; ties go to the smaller id; a positive whose score
is negative has no negatives, as its window is empty, and one without any returns no row; of vectors of
unequal length the shorter goes on with zeros; scores are exact within a long, with components held
within ``vectors.MOST``; labels may be any long; an empty table gives an empty result; other columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm._text import dumped, lean, loaded
from lexloom.llm.storage import materialise
from lexloom.llm.vectors import SLACK, Block, exact_kind, firsts, pack, queries_of, waves_of, widened

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 5
#: A negative's score is at least so many hundredths of the positive's.
LOW = 80
LEAF = 64


@dataclass(slots=True)
class BallTree:
    """Of each node: centre, radius, range of its rows, first child (0: a leaf), least and greatest label."""

    centre: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    child: np.ndarray
    least: np.ndarray
    most: np.ndarray


def ball_tree(block: Block, leaf: int = LEAF) -> tuple[np.ndarray, BallTree]:
    """An order of the rows, and the tree over them in that order."""
    order, points = np.arange(len(block.row)), block.x.astype(np.float64)
    nodes = [(0, len(order))] if len(order) else []
    centre, radius, child, least, most = [], [], [], [], []
    i = 0
    while i < len(nodes):
        a, b = nodes[i]
        rows = order[a:b]
        own, label = points[rows], block.label[rows]
        middle = own.mean(0)
        far = np.sqrt(((own - middle) ** 2).sum(1))
        centre.append(middle)
        radius.append(float(far.max()))
        least.append(label.min())
        most.append(label.max())
        child.append(0)
        i += 1
        if b - a <= leaf:
            continue
        if least[-1] != most[-1]:
            key = label
        elif radius[-1]:
            one = own[far.argmax()]
            d = np.sqrt(((own - one) ** 2).sum(1))
            key = d - np.sqrt(((own - own[d.argmax()]) ** 2).sum(1))
        else:
            key = far  # copies of one vector: any halves do
        by = np.argsort(key, kind="stable")
        cut = (b - a) // 2
        if least[-1] != most[-1]:  # between two labels, nearest to the middle
            cuts = np.flatnonzero(np.diff(key[by]) != 0) + 1
            cut = int(cuts[np.abs(cuts - cut).argmin()])
        order[a:b] = rows[by]
        child[-1] = len(nodes)
        nodes += [(a, a + cut), (a + cut, b)]
    lo, hi = np.array(nodes, np.int64).reshape(-1, 2).T
    tree = BallTree(np.array(centre).reshape(len(nodes), points.shape[1]), np.array(radius), lo, hi, np.array(child, np.int64), np.array(least, np.int64), np.array(most, np.int64))
    return order, tree


def _dump(block: Block) -> dict[str, bytes]:
    order, t = ball_tree(block)
    return {"block": block.take(order).dump(), "tree": dumped(np.array(t.centre.shape, np.int64), t.centre, t.radius, t.lo, t.hi, t.child, t.least, t.most)}


def _load(body: bytes) -> BallTree:
    shape, centre, *rest = loaded(body, "i8", "f8", "f8", "i8", "i8", "i8", "i8", "i8")
    return BallTree(centre.reshape(shape), *rest)


@dataclass(slots=True)
class Wanted:
    """Searches: the anchor of each (its place in the wave), whether it is for the anchor's own label,
    and the scores it takes."""

    anchor: np.ndarray
    same: bool
    low: np.ndarray
    high: np.ndarray


def search(block: Block, tree: BallTree, q: Block, wanted: Wanted, k: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Triples (search, row, score) among which are all of each search's k first rows, and how many
    rows were scored. ``best`` holds the k highest scores that each search has found, and rises."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    width = max(block.x.shape[1], q.x.shape[1])
    x, y = widened(block.x, width), widened(q.x, width)
    exact = np.float64 if exact_kind(x, y) is not np.int64 else np.int64
    whole, x = y.astype(exact), x.astype(exact)
    y = y.astype(np.float64)
    length = np.sqrt((y**2).sum(1))
    reach = length * np.sqrt((widened(block.x, width).astype(np.float64) ** 2).sum(1).max(initial=0)) * SLACK + SLACK
    centre = np.pad(tree.centre, ((0, 0), (0, width - tree.centre.shape[1])))
    scored = 0
    todo = [(0, np.arange(len(wanted.anchor)))] if len(tree.radius) else []
    while todo:
        node, some = todo.pop()
        a = wanted.anchor[some]
        label = q.label[a]
        middle, off = y[a] @ centre[node], length[a] * tree.radius[node] * (1 + SLACK) + reach[a]
        fits = (tree.least[node] <= label) & (label <= tree.most[node]) if wanted.same else (tree.least[node] != label) | (tree.most[node] != label)
        keep = fits & (middle + off >= np.maximum(wanted.low[some], best[some, 0])) & (middle - off <= wanted.high[some])
        some = some[keep]
        if not some.size:
            continue
        if tree.child[node]:
            todo += [(int(tree.child[node]) + 1, some), (int(tree.child[node]), some)]
            continue
        at = np.arange(tree.lo[node], tree.hi[node])
        anchors, which = np.unique(wanted.anchor[some], return_inverse=True)
        score = whole[anchors] @ x[at].T
        scored += score.size
        score = score[which]
        a = anchors[which]
        able = (block.label[at][None, :] == q.label[a][:, None]) == wanted.same
        if wanted.same:
            able &= block.row[at][None, :] != q.row[a][:, None]
        able &= (score >= np.maximum(wanted.low[some], best[some, 0])[:, None]) & (score <= wanted.high[some][:, None])
        hit = np.flatnonzero(able.any(1))
        if not hit.size:
            continue
        some, able, score = some[hit], able[hit], score[hit].astype(np.float64 if exact is np.float64 else np.int64)
        held = np.concatenate([best[some], np.where(able, score, best[some, :1])], axis=1)  # the k-th again changes nothing
        best[some] = np.sort(np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k :], axis=1)
        able &= score >= best[some, :1]
        r, c = np.nonzero(able)
        found.append((some[r], at[c], score[r, c].astype(np.int64)))
    none = np.zeros(0, np.int64)
    s, r, v = (np.concatenate([none, *(f[i] for f in found)]) for i in range(3))
    return s, r, v, scored


_LOWEST = -(1 << 62)


def _hits(blocks: DataFrame, wave: Block, wanted: Wanted, k: int) -> DataFrame:
    """Per task the k first rows of each search: search, vec_id, score."""
    shared = blocks.sparkSession.sparkContext.broadcast((wave, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, wanted = shared.value
        best = np.full((len(wanted.anchor), k), _LOWEST, np.int64)
        none = np.zeros(0, np.int64)
        held = (none, none, none.astype(bool), none)  # search, score, has, id
        for batch in batches:
            for body, tree in zip(batch.column("block").to_pylist(), batch.column("tree").to_pylist(), strict=True):
                block = Block.load(body)
                s, r, score, _ = search(block, _load(tree), q, wanted, k, best)
                key, score, has, ids = (np.concatenate(x) for x in zip(held, (s, score, block.has[r], block.ids[r]), strict=True))
                some = firsts(key, score, has, ids, k)
                held = tuple(x[some] for x in (key, score, has, ids))
        key, score, has, ids = held
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids, mask=~has), pa.array(score)], names=["search", "vec_id", "score"])

    rows = blocks.select("block", "tree").mapInArrow(lean(run), "search long, vec_id long, score long")
    order = W.partitionBy("search").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def forest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, relabel=None) -> DataFrame:
    """The table of blocks with their trees. relabel: a column made of the id and the label."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"), F.col(label_col).cast("long").alias("label")).where("label is not null")
    return pack(rows, "ball-trees", scale, _dump, "id", "x", "label" if relabel is None else relabel(F.col("id"), F.col("label")))


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, scale: int = SCALE, relabel=None) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score."""
    spark = vectors.sparkSession
    blocks = forest(vectors, id_col, vector_col, label_col, scale, relabel)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = None
    for wave in waves_of(queries_of(blocks, every)):
        n = len(wave.row)
        anyone = Wanted(np.arange(n), True, np.full(n, _LOWEST), np.full(n, -_LOWEST))
        kept, _ = materialise(_hits(blocks, wave, anyone, positives), "positives")
        first = kept.orderBy("search", "rank").toArrow()  # positives times a wave at most
        anchor, score = np.asarray(first.column("search")), np.asarray(first.column("score"))
        least = np.array([-((-low * s) // 100) for s in score.tolist()], np.int64)  # rounded up
        windows = Wanted(anchor, False, least, score)
        told = pa.table({"search": pa.array(np.arange(len(anchor))), "anchor_id": pa.array(wave.ids[anchor]), "positive_id": first.column("vec_id"), "positive_score": first.column("score")})
        pairs = spark.createDataFrame(told, "search long, anchor_id long, positive_id long, positive_score long")
        hits = _hits(blocks, wave, windows, negatives).join(F.broadcast(pairs), "search")
        found, _ = materialise(hits.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def report(vectors: DataFrame) -> DataFrame:
    """With every seventh id under the next label."""
    return mine(vectors, relabel=lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label))


ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM kept a JOIN kept c ON a.vec_id % {EVERY} = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS p FROM scored WHERE same
  ) WHERE p <= {POSITIVES}
), negatives AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
  WHERE {LOW} * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= {NEGATIVES}
"""
