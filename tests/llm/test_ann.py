import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann
from quarry.llm.ann import AnnParams, Cell, KDTree, Projection, chi_square_bound, nearest, usable


def brute(rows, every=50, k=5):
    """Rows (id, vector) that take part; the exact answer as a set of (query, rank, id) and the scores."""
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in fine:
        if q % every == 0:
            near = sorted({(-float(a @ b / np.sqrt((a @ a) * (b @ b))), i) for i, b in fine if i != q and len(b) == len(a)})
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_chi_square():
    assert chi_square_bound(8, 0.95) == pytest.approx(15.507, abs=1e-3)


@pytest.mark.parametrize("cell_rows", [256, 100_000])
def test_recall_against_brute_force(spark, cell_rows):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 24))
    data = [(i, (centres[i % 30] + rng.standard_normal(24) * (0.3 if i % 2 else 3)).astype(np.float32).tolist()) for i in range(3000)]
    data += [(4000 + i, data[0][1]) for i in range(200)]
    data += [(9000, None), (9050, [0.0] * 24), (9100, [float("nan")] * 24), (9150, [None] + [1.0] * 23), (9200, [1.0, 2.0]), (9201, [2.0, 1.0]), (9250, []), (None, data[3][1]), data[7]]
    df = spark.createDataFrame([(i, v, 3, 0.5) for i, v in data], "vec_id long, embedding array<float>, rank int, score double").repartition(4)
    got = {}
    for r in sorted(nearest(df, params=AnnParams(cell_rows=cell_rows)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(data)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert got[4000] == [(i, pytest.approx(1)) for i in (0, 4001, 4002, 4003, 4004)] and [i for i, _ in got[9200]] == [9201]
    exact = {i: np.array(v, float) for i, v in data if v}
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and len(near) == len(want[q])
        assert all(s == pytest.approx(exact[q] @ exact[i] / np.linalg.norm(exact[q]) / np.linalg.norm(exact[i]), abs=1e-12) for i, s in near)


def test_empty_table(spark):
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize(("cosine", "most"), [(0.95, 0.05), (0.9, 0.1), (0.8, 0.2)])
def test_stops_early_where_there_are_neighbours(spark, cosine, most):
    """Groups of about twenty vectors of that cosine: recall stays over 0.9 while few vectors are verified."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((250, 48))
    own, noise = centres[rng.integers(0, 250, 5000)], rng.standard_normal((5000, 48))
    vectors = own / np.linalg.norm(own, axis=1, keepdims=True) * cosine**0.5 + noise / np.linalg.norm(noise, axis=1, keepdims=True) * (1 - cosine) ** 0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = nearest(df, params=AnnParams(cell_rows=2048)).collect()
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 5000, 50):
        score = units @ units[q]
        score[q] = -2
        hits += len({r.vec_id for r in rows if r.query_id == q} & set(np.argsort(-score)[:5].tolist()))
    assert hits >= 0.95 * 500
    assert np.mean([r.verified for r in rows if r["rank"] == 1]) < most * 5000


def pairwise(cell, queries, projected, farthest):
    """The cell's search, pair by pair: leaves by distance, one, two, four ... at a time, each point tested and scored alone."""
    farthest, verified, found = np.maximum(farthest, 1e-9), np.zeros(len(queries), int), []
    points, norms = cell.tests[:, :-2], np.sqrt((queries * queries).sum(axis=1))
    for q in range(len(queries)):
        apart = (np.maximum(np.maximum(cell.tree.low - projected[q], projected[q] - cell.tree.high), 0) ** 2).sum(axis=1)
        order, best, at, step = np.argsort(apart, kind="stable"), [], 0, 1
        while at < len(order):
            leaves = [x for x in order[at : at + step] if apart[x] <= cell.bound * farthest[q]]
            if not leaves:
                break
            point = np.concatenate([np.arange(cell.tree.starts[x], cell.tree.starts[x + 1]) for x in leaves])
            off = projected[q] - points[point]
            point = point[(off * off).sum(axis=1) <= cell.bound * farthest[q]]
            verified[q] += len(point)
            scores = (cell.vectors[point] * queries[q]).sum(axis=1) / (cell.norms[point] * norms[q])
            best = sorted([*best, *zip(-scores, cell.ids[point], strict=True)])[: cell.k]
            if len(best) == cell.k:
                farthest[q] = max(min(farthest[q], 2 + 2 * best[-1][0]), 1e-9)
            at, step = at + step, 2 * step
        found.append([(i, -s) for s, i in best])
    return found, verified


@pytest.mark.parametrize("known", [4.0, 1.2, 0.9])
def test_search_of_a_cell_equals_pairs(known):
    """The same neighbours, scores to the last bit and counts; none farther than what is known to be enough."""
    rng = np.random.default_rng(9)
    params, projection = AnnParams(leaf=32), Projection(32, AnnParams())
    vectors = rng.standard_normal((1500, 32)) * rng.uniform(0.01, 100, (1500, 1))
    vectors[100:120], vectors[200:205] = vectors[99], vectors[99] * 2
    cell = Cell(rng.permutation(1500), vectors, projection, params)
    queries = np.concatenate([vectors[90:210], rng.standard_normal((80, 32))])
    row, ids, scores, verified = cell.search(queries, projection(queries), np.full(200, known))
    want, counts = pairwise(cell, queries, projection(queries), np.full(200, known))
    assert verified.tolist() == counts.tolist()
    assert (2 - 2 * scores <= known + 1e-3).all()
    for q in range(200):
        near = [x for x in want[q] if 2 - 2 * x[1] <= known]
        assert list(zip(ids[row == q], scores[row == q], strict=True))[: len(near)] == near


def test_search_of_a_cell_is_not_by_pairs():
    """Without neighbours to find, a verified vector costs far less than fetching and scoring it alone does."""
    rng = np.random.default_rng(2)
    projection, vectors = Projection(64, AnnParams()), rng.standard_normal((4096, 64))
    cell, queries = Cell(np.arange(4096), vectors, projection, AnnParams()), rng.standard_normal((512, 64))
    took = []
    for _ in range(3):
        start = time.process_time()
        verified = cell.search(queries, projection(queries), np.full(512, 4.0))[3].sum()
        took.append(time.process_time() - start)
    who, point = np.repeat(np.arange(512), 1024), np.tile(rng.permutation(4096)[:1024], 512)
    start = time.process_time()
    for lo in range(0, len(who), 1 << 16):
        (cell.vectors[point[lo : lo + (1 << 16)]] * queries[who[lo : lo + (1 << 16)]]).sum(axis=1)
    assert min(took) / verified < 0.6 * (time.process_time() - start) / len(who)


def test_distances_to_leaves():
    rng = np.random.default_rng(3)
    points, asked = rng.standard_normal((500, 4)), rng.standard_normal((300, 4))
    for tree in (KDTree(points, 16), KDTree(points, 16, tight=False), KDTree(points[:0], 16, tight=False)):
        off = np.maximum(np.maximum(tree.low - asked[:, None], asked[:, None] - tree.high), 0)
        assert np.allclose(tree.distances(asked), (off * off).sum(axis=2)) and tree.distances(asked[:0]).shape == (0, len(tree.low))


def test_equal_vectors_and_repeated_rows(spark, monkeypatch):
    """Rows of one id and vector count once, 0.0 is -0.0, and no row is dealt or sorted by its vector."""
    plans, kept = [], ann.stored

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(ann, "stored", seen)
    rows = [(i % 9 + 1, [1.0, 0.0 if i % 2 else -0.0]) for i in range(90)] + [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [-0.0, 3.0]), (101, [0.0, 3.0]), (50, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in nearest(df.where(F.col("embedding")[0] != 2)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {50: [1, 2, 3, 4, 5], 100: [101, 1, 2, 3, 4]}
    assert nearest(df).where("query_id = 50").count() == 5
    assert not [line for plan in plans for line in plan.splitlines() if ("hashpartitioning(" in line or " Sort [" in line) and "vector" in line]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_usable(spark, kind):
    inf, nan = float("inf"), float("nan")
    fine = [[1.0, -1.0], [0.0, 1.0], [-1.0, 0.0], [-2.0, -1.0], [1e-30]]
    odd = [None, [], [0.0, 0.0], [-0.0, 0.0], [1.0, None], [None, None], [0.0, None], [nan, 1.0], [nan], [inf, 1.0], [1.0, -inf], [-inf, inf], [None, inf], [None, nan]]
    df = spark.createDataFrame([(v, True) for v in fine] + [(v, False) for v in odd], f"v array<{kind}>, fine boolean")
    assert df.where(usable(F.col("v")).isNull() | (usable(F.col("v")) != F.col("fine"))).count() == 0
    assert [r[0] for r in spark.createDataFrame([([1, 0],), ([0, 0],), ([None, 2],)], "v array<int>").select(usable(F.col("v"))).collect()] == [True, False, False]
