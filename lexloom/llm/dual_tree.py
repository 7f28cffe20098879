"""Centroid clustering by dual-tree Lloyd (operator 11).

Vectors are packed once into blocks (``vectors``), and each block gets a cover tree: a node is a
representative, and its children are points of it that are more than the next smaller radius apart,
each with the points within that radius of it, its own among them. The members of a node lie
together, so prefix sums give the sum of any node at once.

Every round builds a cover tree over the centroids too, and walks both trees in step. A pair of nodes
(n, c) has a lower bound, the distance of the representatives less both radii, and the representative
of c bounds from above how far n's points are from their nearest centroid. Pairs whose lower bound is
over the least upper bound of n, its ancestors' included, are pruned. A node with one centroid left
gives it all its members by the prefix sums; what arrives as a leaf is compared exactly, in whole
numbers, ties to the smaller number. Bounds are widened by ``SLACK``, so rounding prunes nothing that
could tie. All pairs of a level are handled as arrays, in pieces of bounded size.

A round reads each block once, where it lies, and shuffles one row of sums for each task and cluster;
the driver sees as many rows as there are centroids. Centroids are broadcast, ``CENTROID_BYTES`` at
most, which is checked. Blocks are a written table, so a lost executor costs a re-read. No key gathers
rows: copies of one vector are points at distance 0 in trees of bounded size.

Defined results: null vectors, vectors of another length than ``dims``, and such as hold a null or
non-finite component are not kept and return no row; components are held within bounds that squared
distances as long allow (``vectors.MOST``, halved; |x| up to 32,768 at the scale of 1024); a null id
is kept, is hashed as an empty text and comes back as null; rows with one id are vectors of their own,
and seeds with equal hashes are taken in the order of their components; with fewer kept vectors than
clusters there are as many clusters as vectors; equal centroids give all to the smaller number, and
the others, being empty, stay; an empty table gives an empty result; an inertia beyond a long is null;
other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._text import dumped, lean, loaded
from lexloom.llm.storage import materialise
from lexloom.llm.vectors import MOST, SLACK, Block, pack

SCALE, DIMS, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, 3
#: Vectors with components up to this have squared distances within a long, for up to 512 components.
REACH = MOST >> 1
LEAF = 8
BASE = 1.5
#: Pairs compared at once.
PAIRS = 1 << 14
#: Distances of points and centroids held at once, but for whole leaves.
COMPARED = 1 << 20
CENTROID_BYTES = 64 << 20


@dataclass(slots=True)
class CoverTree:
    """Points in the order of their nodes; of each node its representative's place, its radius, the
    range of its members, and that of its children."""

    order: np.ndarray
    rep: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    child: np.ndarray
    children: np.ndarray


def _from(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    d = points - one
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def cover_tree(points: np.ndarray, leaf: int = LEAF, base: float = BASE) -> CoverTree:
    """The cover tree of these points (rows, as float)."""
    n = len(points)
    order = np.arange(n)
    rep, radius, lo, hi, child, children = [0], [0.0], [0], [n], [0], [0]
    todo = [(0, _from(points, points[0]))] if n else []
    while todo:
        node, far = todo.pop()
        a, b = lo[node], hi[node]
        radius[node] = float(far.max())
        if b - a <= leaf or radius[node] == 0:
            continue
        within = base ** (np.ceil(np.log(radius[node]) / np.log(base)) - 1)
        members, left, groups = order[a:b].copy(), np.arange(b - a), []
        near = far
        while left.size:  # the first child has the node's own representative
            inside = near <= within
            groups.append((left[inside], near[inside]))
            left = left[~inside]
            if left.size:
                near = _from(points[members[left]], points[members[left[0]]])
        child[node], children[node] = len(rep), len(groups)
        at = a
        for own, near in groups:
            order[at : at + len(own)] = members[own]
            rep.append(at)
            radius.append(0.0)
            lo.append(at)
            hi.append(at + len(own))
            child.append(0)
            children.append(0)
            todo.append((len(rep) - 1, near))
            at += len(own)
    rep, lo, hi, child, children = (np.array(x, np.int64) for x in (rep, lo, hi, child, children))
    return CoverTree(order, rep, np.array(radius), lo, hi, child, children)


def _dump(block: Block) -> dict[str, bytes]:
    block.x = np.clip(block.x, -REACH, REACH)
    tree = cover_tree(block.x.astype(np.float64)) if len(block.row) else cover_tree(np.zeros((0, 1)))
    return {"block": block.take(tree.order).dump(), "tree": dumped(tree.rep, tree.radius, tree.lo, tree.hi, tree.child, tree.children)}


def _load(body: bytes, n: int) -> CoverTree:
    return CoverTree(np.arange(n), *loaded(body, "i8", "f8", "i8", "i8", "i8", "i8"))


class Centroids:
    """Centroids as whole numbers, and their cover tree, whose leaves are single (or equal) centroids."""

    def __init__(self, centres: list[list[int]]):
        self.x = np.array(centres, np.int64)
        tree = cover_tree(self.x.astype(np.float64), leaf=1)
        self.tree = tree
        self.points = self.x[tree.order].astype(np.float64)
        self.number = np.array([int(tree.order[a:b].min()) for a, b in zip(tree.lo, tree.hi, strict=True)])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def nearest(x: np.ndarray, tree: CoverTree, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid's number for each point of a tree, and the nodes of which all members have
    one (its number, or -1): the walk over both trees."""
    ct, points = centroids.tree, x.astype(np.float64)
    owner = np.full(len(x), -1, np.int64)
    whole = np.full(len(tree.rep), -1, np.int64)
    least = np.full(len(tree.rep), np.inf)  # no point of the node is farther from its nearest centroid
    n, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    late_n, late_c = [], []  # leaves against single centroids
    while n.size:
        d = np.concatenate([np.sqrt(((points[tree.rep[n[i : i + PAIRS]]] - centroids.points[ct.rep[c[i : i + PAIRS]]]) ** 2).sum(1)) for i in range(0, len(n), PAIRS)])
        np.minimum.at(least, n, d * (1 + SLACK) + tree.radius[n] * (1 + SLACK))
        low = d * (1 - SLACK) - (tree.radius[n] + ct.radius[c]) * (1 + SLACK)
        kept = low <= least[n] * (1 + SLACK)
        n, c = n[kept], c[kept]
        single = ct.children[c] == 0
        alone = (np.bincount(n, minlength=len(whole))[n] == 1) & single
        whole[n[alone]] = centroids.number[c[alone]]
        n, c, single = n[~alone], c[~alone], single[~alone]
        inner = tree.children[n] > 0
        # a leaf waits for the end only when every centroid node that it still meets is single
        open_leaf = np.zeros(len(whole), bool)
        open_leaf[n[~inner & ~single]] = True
        ready = ~inner & single & ~open_leaf[n]
        late_n.append(n[ready])
        late_c.append(c[ready])
        n, c, single, inner = n[~ready], c[~ready], single[~ready], inner[~ready]
        many = np.where(single, 1, ct.children[c])
        n, inner = np.repeat(n, many), np.repeat(inner, many)
        c = _ranges(np.where(single, c, ct.child[c]), many)
        many = np.where(inner, tree.children[n], 1)
        above, c = np.repeat(n, many), np.repeat(c, many)
        n = _ranges(np.where(inner, tree.child[n], n), many)
        least[n] = np.minimum(least[n], least[above])
    for node in np.flatnonzero(whole >= 0).tolist():
        owner[tree.lo[node] : tree.hi[node]] = whole[node]
    n, c = np.concatenate(late_n or [n]), np.concatenate(late_c or [c])
    order = np.argsort(n, kind="stable")
    n, number = n[order], centroids.number[c[order]]
    same = tree.radius[n] == 0  # copies of one point are compared once
    sizes = np.where(same, 1, tree.hi[n] - tree.lo[n])
    upto = np.cumsum(sizes)
    at = 0
    while at < len(n):  # pieces of whole leaves
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + COMPARED, "right")))
        end = int(np.searchsorted(n, n[end - 1], "right"))
        point = _ranges(tree.lo[n[at:end]], sizes[at:end])
        numbers = np.repeat(number[at:end], sizes[at:end])
        far = np.concatenate([((x[point[i : i + PAIRS]].astype(np.int64) - centroids.x[numbers[i : i + PAIRS]]) ** 2).sum(1) for i in range(0, len(point), PAIRS)])
        order = np.lexsort((numbers, far, point))
        first = order[np.concatenate([[True], point[order][1:] != point[order][:-1]])]
        owner[point[first]] = numbers[first]
        at = end
    for node in np.unique(n[same]).tolist():
        owner[tree.lo[node] : tree.hi[node]] = owner[tree.lo[node]]
    return owner, whole


def _sums(blocks: DataFrame, centres: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that has vectors their number and their sum."""
    k, dims = len(centres), len(centres[0])
    shared = blocks.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(shared.value)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for body, tree_body in zip(batch.column("block").to_pylist(), batch.column("tree").to_pylist(), strict=True):
                x = Block.load(body).x
                tree = _load(tree_body, len(x))
                owner, whole = nearest(x, tree, centroids)
                upto = np.concatenate([np.zeros((1, dims), np.int64), np.cumsum(x, axis=0, dtype=np.int64)])
                nodes = np.flatnonzero(whole >= 0)
                np.add.at(counts, whole[nodes], tree.hi[nodes] - tree.lo[nodes])
                np.add.at(sums, whole[nodes], upto[tree.hi[nodes]] - upto[tree.lo[nodes]])
                inside = np.zeros(len(x) + 1, np.int64)
                np.add.at(inside, tree.lo[nodes], 1)
                np.add.at(inside, tree.hi[nodes], -1)
                rest = np.flatnonzero(np.cumsum(inside)[:-1] == 0)
                np.add.at(counts, owner[rest], 1)
                np.add.at(sums, owner[rest], x[rest].astype(np.int64))
        live = np.flatnonzero(counts)
        if live.size:
            yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(counts[live]), pa.array(list(sums[live]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = blocks.select("block", "tree").mapInArrow(lean(run), "cluster long, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("d", "s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in each.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        found.setdefault(r.cluster, (r.n, [0] * dims))[1][r.d] = int(r.s)
    return found


def _seeds(blocks: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes, of each task and then of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[int]]] = []
        for batch in batches:
            for body in batch.column("block").to_pylist():
                b = Block.load(body)
                hashed = [hashlib.sha256(f"{seed}:{i if h else ''}".encode()).hexdigest() for i, h in zip(b.ids.tolist(), b.has.tolist(), strict=True)]
                some = sorted(range(len(hashed)), key=hashed.__getitem__)
                cut = hashed[some[min(k, len(some)) - 1]]
                best = sorted(best + [(hashed[i], b.x[i].tolist()) for i in some if hashed[i] <= cut])[:k]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best]), pa.array([x for _, x in best], pa.list_(pa.int64()))], names=["hash", "x"])

    return [list(r.x) for r in blocks.select("block").mapInArrow(lean(run), "hash string, x array<long>").orderBy("hash", "x").limit(k).collect()]


def fit(blocks: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> list[list[int]]:
    """The centroids after ``rounds`` rounds."""
    if clusters * dims * 8 > CENTROID_BYTES:
        raise ValueError(f"{clusters} centroids of {dims} components are more than {CENTROID_BYTES} bytes to broadcast")
    centres = _seeds(blocks, clusters, seed)
    for _ in range(rounds if centres else 0):
        found = _sums(blocks, centres)
        centres = [[s // found[j][0] for s in found[j][1]] if j in found else c for j, c in enumerate(centres)]
    return centres


def assign(blocks: DataFrame, centres: list[list[int]], id_col: str = "vec_id") -> DataFrame:
    """Per vector: id, cluster, distance (squared)."""
    shared = blocks.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(shared.value) if shared.value else None
        for batch in batches:
            for body, tree_body in zip(batch.column("block").to_pylist(), batch.column("tree").to_pylist(), strict=True):
                b = Block.load(body)
                owner, _ = nearest(b.x, _load(tree_body, len(b.x)), centroids)
                d = b.x.astype(np.int64) - centroids.x[owner]
                yield pa.RecordBatch.from_arrays([pa.array(b.ids, mask=~b.has), pa.array(owner.astype(np.int32)), pa.array(np.einsum("ij,ij->i", d, d))], names=["id", "cluster", "distance"])

    return blocks.select("block", "tree").mapInArrow(lean(run), "id long, cluster int, distance long").withColumnRenamed("id", id_col)


def trees(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, dims: int = DIMS) -> DataFrame:
    """The table of blocks with their cover trees; only vectors of ``dims`` components are kept."""
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x")).where(F.size("x") == dims)
    return pack(kept, "cover-trees", scale, _dump, "id", "x")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, dims: int = DIMS) -> DataFrame:
    """Per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    blocks = trees(vectors, id_col, vector_col, scale, dims)
    centres = fit(blocks, clusters, rounds, seed, dims)
    assigned, _ = materialise(assign(blocks, centres, id_col), "assigned")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(total.alias("s")).collect()}
    whole = sum(inertia.values())
    as_long = lambda v: v if v < 1 << 63 else None
    rows = [(j, as_long(inertia.get(j, 0)), as_long(whole), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centres)]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, dims: int = DIMS) -> str:
    """One round of SQL after another."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
), points AS MATERIALIZED (
  SELECT vec_id, unnest(range({dims})) AS d, unnest(v) AS x FROM kept
), seeds AS (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR))) - 1 AS c, v FROM kept
), c0 AS MATERIALIZED (
  SELECT CAST(c AS INTEGER) AS c, unnest(range({dims})) AS d, unnest(v) AS x FROM seeds WHERE c < {clusters}
)"""
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""d{r} AS (
  SELECT p.vec_id, m.c, sum((p.x - m.x) * (p.x - m.x)) AS dist FROM points p JOIN c{r} m ON p.d = m.d GROUP BY p.vec_id, m.c
), a{r} AS MATERIALIZED (
  SELECT vec_id, c, dist FROM (SELECT vec_id, c, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist, c) AS k FROM d{r}) WHERE k = 1
)"""
        )
        if r < rounds:
            parts.append(
                f"""n{r} AS (
  SELECT a.c, p.d, CAST(floor(CAST(sum(p.x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM a{r} a JOIN points p ON a.vec_id = p.vec_id GROUP BY a.c, p.d
), c{r + 1} AS MATERIALIZED (
  SELECT m.c, m.d, coalesce(n.x, m.x) AS x FROM c{r} m LEFT JOIN n{r} n ON m.c = n.c AND m.d = n.d
)"""
            )
    return (
        "WITH "
        + ", ".join(parts)
        + f""", h AS (
  SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c
), i AS (
  SELECT c, CAST(sum(dist) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY c
), t AS (
  SELECT CAST(sum(dist) AS BIGINT) AS inertia FROM a{rounds}
)
SELECT a.vec_id, a.c AS cluster, CAST(a.dist AS BIGINT) AS distance, i.cluster_inertia, t.inertia, h.centroid_sha256
FROM a{rounds} a JOIN i ON a.c = i.c JOIN h ON a.c = h.c CROSS JOIN t"""
    )


ORACLE_SQL = _oracle()
