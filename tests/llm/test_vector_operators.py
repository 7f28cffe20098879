"""Clustering, search and hard negatives over vectors, against brute force."""

import hashlib
import math

import numpy as np
import pytest

from lexloom.llm import ball_tree, dual_tree, impact_index, vectors
from lexloom.llm.vectors import Block, firsts

NAN, INF = float("nan"), float("inf")


def block(x, label=None):
    n = len(x)
    return Block(np.arange(n), np.arange(n), np.ones(n, bool), np.zeros(n, np.int64) if label is None else np.asarray(label, np.int64), np.asarray(x).astype(np.int32))


def some_points(rng, trial, n, dims):
    """Small whole numbers with many ties, or values of several magnitudes."""
    return rng.integers(-6, 7, (n, dims)) if trial % 2 else np.floor(rng.normal(0, 1, (n, dims)) * rng.choice([1, 50, 5000, 1e6]))


def whole(v, scale):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(scale * x) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


@pytest.fixture(scope="module")
def rows():
    """Ids, vectors and labels: copies, repeated ids, nulls, odd lengths."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (6, 64))
    made = [(i, (centres[i % 6] + rng.normal(0, 0.05 + 0.4 * (i % 3), 64)).round(3).tolist(), i % 4) for i in range(330)]
    made += [(1000 + i, made[3][1], i % 4) for i in range(60)]  # one vector many times
    made += [(100, made[5][1], 1), (100, made[5][1], 1), (200, [0.0] * 64, 2), (None, made[7][1], 3), (None, made[100][1], 0)]
    made += [(500, None, 1), (520, [NAN] * 64, 1), (540, [INF] + [0.0] * 63, 1), (560, [None] + [0.5] * 63, 2), (580, made[9][1], None), (300, [0.1] * 64, -7), (7, [9e9] + [0.0] * 63, 5)]
    return [r for r in made if r[1] is None or r[1][0] != 9e9]


@pytest.fixture(scope="module")
def table(spark, rows):
    kind = "vec_id long, embedding array<double>, label int, rank int, score string, id string, x int, bytes int"
    return spark.createDataFrame([(*r, 1, "s", "i", 2, 3) for r in rows], kind).repartition(5).cache()


def test_whole_numbers_are_floors_within_bounds():
    got = vectors.whole_numbers(np.array([0.1, -0.1, 1e30, -1e30, 2.5]), 64)
    assert got.tolist() == [6, -7, vectors.MOST, -vectors.MOST, 160]


def test_blocks_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(vectors, "BLOCK_CELLS", 40)
    own = [[1.0] * n for n in (3, 0, 12, 2, 100, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(list(range(8))), pa.array(own, pa.list_(pa.float64())), pa.array([0] * 8)], names=["id", "vector", "label"])
    made = list(vectors._blocks(iter([batch, batch]), 1))
    assert all(b.x.size <= 40 or len(b.row) == 1 for b in made)
    assert [r for b in made for r in b.row.tolist()] == list(range(14))
    assert [int(s) for b in made for s in b.x.sum(1)] == [3, 0, 12, 2, 100, 1, 1] * 2


# clustering


@pytest.mark.parametrize("trial", range(24))
def test_both_trees_give_the_nearest(trial):
    rng = np.random.default_rng(trial)
    n, k, dims = int(rng.integers(1, 300)), int(rng.integers(1, 40)), int(rng.integers(1, 6))
    x = some_points(rng, trial, n, dims).astype(np.int32)
    centres = [x[i].tolist() for i in rng.integers(0, n, k)]
    tree = dual_tree.cover_tree(x.astype(float))
    x = x[tree.order]
    far = ((x[:, None, :].astype(np.int64) - np.array(centres)[None]) ** 2).sum(2)
    assert dual_tree.nearest(x, tree, dual_tree.Centroids(centres))[0].tolist() == far.argmin(1).tolist()


def test_a_cover_tree_covers_and_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, 3)) * 100
    t = dual_tree.cover_tree(x)
    x = x[t.order]
    for node in range(len(t.rep)):
        far = np.sqrt(((x[t.lo[node] : t.hi[node]] - x[t.rep[node]]) ** 2).sum(1))
        assert far.max() == pytest.approx(t.radius[node])
        if t.children[node]:
            kids = np.arange(t.child[node], t.child[node] + t.children[node])
            assert t.lo[kids[0]] == t.lo[node] and t.hi[kids[-1]] == t.hi[node] and t.rep[kids[0]] == t.rep[node]
            within = dual_tree.BASE ** (math.ceil(math.log(t.radius[node], dual_tree.BASE)) - 1)
            assert (t.radius[kids] <= within + 1e-9).all()
            own = x[t.rep[kids]]
            gaps = np.sqrt(((own[:, None] - own[None]) ** 2).sum(2)) + np.eye(len(kids)) * 1e9
            assert gaps.min() > within


def test_close_groups_are_assigned_whole(monkeypatch):
    """Where vectors lie in tight groups, nodes are settled by bounds, and few pairs compared."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-1000, 1000, (8, 16))
    x = (centres[rng.integers(0, 8, 1500)] + rng.integers(-3, 4, (1500, 16))).astype(np.int32)
    tree = dual_tree.cover_tree(x.astype(float))
    owner, nodes = dual_tree.nearest(x[tree.order], tree, dual_tree.Centroids(centres.tolist()))
    settled = np.flatnonzero(nodes >= 0)
    assert (tree.hi[settled] - tree.lo[settled]).sum() == 1500 and len(settled) <= 64


def lloyd(rows, k, rounds):
    kept = [(i, v) for i, x, _ in rows if x is not None and len(x) == 64 and (v := whole(x, 1024))]
    hashed = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in hashed[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centres)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    own = {j: sum(d for _, c, d in out if c == j) for j in range(len(centres))}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, own[j], sum(own.values()), shas[j]) for i, j, d in out), key=repr)


@pytest.mark.parametrize(("k", "rounds"), [(8, 4), (1, 1), (500, 1)])
def test_clusters(table, rows, k, rounds):
    got = dual_tree.cluster(table, clusters=k, rounds=rounds)
    assert sorted(map(tuple, got.collect()), key=repr) == lloyd(rows, k, rounds)


def test_too_many_centroids_are_refused(table):
    with pytest.raises(ValueError, match="broadcast"):
        dual_tree.cluster(table, clusters=1 << 20)


# search


@pytest.mark.parametrize("trial", range(24))
def test_an_index_finds_the_best(trial):
    rng = np.random.default_rng(trial)
    n, dims, k = int(rng.integers(1, 300)), int(rng.integers(1, 9)), int(rng.integers(1, 25))
    b = block(some_points(rng, trial, n, dims))
    q = b.take(np.arange(0, n, 7))
    c, r, s, _ = impact_index.search(b, impact_index.index_of(b)["index"], q, np.full(len(q.row), -np.inf), k)
    score = q.x.astype(np.int64) @ b.x.astype(np.int64).T
    want = [(i, int(j), int(score[i, j])) for i in range(len(q.row)) for j in [j for j in np.lexsort((b.ids, -score[i])) if b.row[j] != q.row[i]][:k]]
    assert [(int(c[g]), int(b.ids[r[g]]), int(s[g])) for g in firsts(c, s, b.has[r], b.ids[r], k)] == want


def test_segments_come_by_descending_impact():
    rng = np.random.default_rng(4)
    b = block(rng.integers(-900, 900, (200, 5)))
    segments, rows, stops, missing = vectors.loaded(impact_index.index_of(b)["index"], "i8", "i4", "i8", "f8")
    segments = segments.reshape(-1, 3)
    assert (np.diff(np.abs(segments[:, 1])) <= 0).all()
    assert len(set(np.abs(segments[:, 1]).tolist())) <= impact_index.LEVELS
    assert len(rows) == segments[-1, 2] and stops[-1] == len(segments)
    missing = missing.reshape(len(stops), -1)
    assert (np.diff(missing, axis=0) <= 1e-9).all() and (missing[-1] > 0).any()  # what quantising cut off


def test_a_search_stops_on_proof():
    """With a good floor, segments of low impact are not read."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 30, (1500, 32))
    x[::50] = x[0] + rng.normal(0, 2, (30, 32))
    b = block(np.floor(x))
    made = impact_index.index_of(b)["index"]
    q = b.take(np.array([0, 50, 100]))
    _, r, _, read = impact_index.search(b, made, q, np.full(3, -np.inf), 20)
    assert read < 0.8 * len(vectors.loaded(made, "i8", "i4", "i8", "f8")[1]) and len(r) <= 3 * 0.03 * 1500


def best_by_rows(rows, scale):
    kept = [(i, v, label) for i, x, label in rows if x is not None and (v := whole(x, scale)) is not None]
    order = lambda c: (-c[1], c[0] is None, c[0] or 0)
    return kept, order


@pytest.mark.parametrize(("k", "wave"), [(20, 8 << 20), (3, 2000), (2000, 8 << 20)])
def test_top_k(table, rows, monkeypatch, k, wave):
    monkeypatch.setattr(vectors, "WAVE_BYTES", wave)
    kept, order = best_by_rows(rows, 64)
    want = []
    for a, (i, v, _) in enumerate(kept):
        if i is not None and i % 20 == 0:
            found = sorted(((j, dot(v, w)) for b, (j, w, _) in enumerate(kept) if b != a), key=order)[:k]
            want += [(i, rank, j, s) for rank, (j, s) in enumerate(found, 1)]
    assert sorted(map(tuple, impact_index.top_k(table, k=k).collect()), key=repr) == sorted(want, key=repr)


def test_top_k_of_unequal_lengths(spark):
    own = [(20, [1.0, 2.0]), (1, [3.0]), (2, []), (3, [1.0, 1.0, 9.0]), (4, [-1.0, 0.0])]
    got = impact_index.top_k(spark.createDataFrame(own, "vec_id long, embedding array<float>"), scale=1).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r["rank"])] == [(20, 1, 1, 3), (20, 2, 3, 3), (20, 3, 2, 0), (20, 4, 4, -1)]


# hard negatives


@pytest.mark.parametrize("trial", range(24))
def test_a_ball_tree_finds_the_first(trial):
    rng = np.random.default_rng(trial)
    n, dims, k = int(rng.integers(1, 300)), int(rng.integers(1, 9)), int(rng.integers(1, 7))
    b = block(some_points(rng, trial, n, dims), rng.integers(0, 4, n))
    order, tree = ball_tree.ball_tree(b, 8)
    q, packed = b.take(np.arange(0, n, 7)), b.take(order)
    score, m = q.x.astype(np.int64) @ b.x.astype(np.int64).T, len(q.row)
    for same in (True, False):
        low = np.full(m, -(2**62)) if same else np.quantile(score, 0.3, axis=1).astype(np.int64)
        high = np.full(m, 2**62) if same else np.quantile(score, 0.8, axis=1).astype(np.int64)
        s, r, v, _ = ball_tree.search(packed, tree, q, ball_tree.Wanted(np.arange(m), same, low, high), k, np.full((m, k), -(2**62)))
        able = lambda i, j: b.row[j] != q.row[i] and (b.label[j] == q.label[i]) == same and low[i] <= score[i, j] <= high[i]  # noqa: E731, B023
        want = [(i, int(j), int(score[i, j])) for i in range(m) for j in [j for j in np.lexsort((b.ids, -score[i])) if able(i, j)][:k]]
        assert [(int(s[g]), int(packed.ids[r[g]]), int(v[g])) for g in firsts(s, v, packed.has[r], packed.ids[r], k)] == want


def test_nodes_outside_the_window_are_pruned():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 200, (10, 16))
    which = rng.integers(0, 10, 2000)
    b = block(np.floor(centres[which] + rng.normal(0, 2, (2000, 16))), which % 3)
    order, tree = ball_tree.ball_tree(b)
    q, b = b.take(np.array([0])), b.take(order)
    far = (q.x.astype(np.int64) @ b.x.astype(np.int64).T)[0]
    low, high = np.quantile(far, [0.4, 0.6]).astype(np.int64)
    *_, scored = ball_tree.search(b, tree, q, ball_tree.Wanted(np.array([0]), False, np.array([low]), np.array([high])), 5, np.full((1, 5), -(2**62)))
    assert 0 < scored < 800


@pytest.mark.parametrize("wave", [8 << 20, 2000])
def test_hard_negatives(table, rows, monkeypatch, wave):
    monkeypatch.setattr(vectors, "WAVE_BYTES", wave)
    kept, order = best_by_rows([r for r in rows if r[2] is not None], 256)
    kept = [(i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in kept]
    want = []
    for a, (i, v, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(j, dot(v, w), other == label) for b, (j, w, other) in enumerate(kept) if b != a]
        for p, ps, _ in sorted((c for c in scored if c[2]), key=order)[:5]:
            found = sorted((c for c in scored if not c[2] and 80 * ps <= 100 * c[1] <= 100 * ps), key=order)[:5]
            want += [(i, p, rank, j, ps, ns) for rank, (j, ns, _) in enumerate(found, 1)]
    assert want and sorted(map(tuple, ball_tree.report(table).collect()), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    nulls = spark.createDataFrame([(0, None, None), (100, [None], 1)], none.schema)
    for t in (none, nulls):
        for made in (dual_tree.cluster(t), impact_index.top_k(t), ball_tree.report(t)):
            assert made.count() == 0
    assert dual_tree.cluster(none).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
