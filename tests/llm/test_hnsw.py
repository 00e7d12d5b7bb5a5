import numpy as np
import pytest

from quarry.llm.hnsw import Graph, HnswParams, _unit, linked, near_duplicates, summed


def sample(seed, n=2500, d=32):
    rng = np.random.default_rng(seed)
    far = rng.standard_normal((n, d))
    near = far[rng.integers(0, 60, n // 3)] + 0.12 * rng.standard_normal((n // 3, d))
    pairs = far[100 : 100 + n // 5] + 0.2 * rng.standard_normal((n // 5, d))
    return np.concatenate([far, near, pairs])[rng.permutation(n + n // 3 + n // 5)].astype(np.float32).astype(np.float64)


def pairs_of(vectors, cosine=0.93):
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return set(zip(*map(np.ndarray.tolist, np.nonzero(np.triu(units @ units.T >= cosine, 1)))))


def found_pairs(hits, shift=0):
    return {(min(a, q + shift), max(a, q + shift)) for q, a in zip(*map(np.ndarray.tolist, np.nonzero(hits)))}


def test_graph_recall():
    vectors, params = sample(0), HnswParams()
    found = found_pairs(linked(vectors, Graph(_unit(vectors), params), None, params))
    true = pairs_of(vectors)
    assert found <= true and len(found) >= 0.98 * len(true)
    half = len(vectors) // 2
    left = Graph(_unit(vectors[:half]), params)
    across = found_pairs(linked(vectors[:half], left, vectors[half:], params), half)
    true = {(a, b) for a, b in true if a < half <= b}
    assert across <= true and len(across) >= 0.98 * len(true)


def test_few_links_are_all_found():
    """So few that a sample would hold none: the audit goes on until it has seen enough or everything."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((3000, 32))
    vectors[1500:1510] = vectors[:10] + 0.1 * rng.standard_normal((10, 32))
    params = HnswParams()
    true = pairs_of(vectors)
    assert len(true) == 10 and found_pairs(linked(vectors, Graph(_unit(vectors), params), None, params)) == true


def test_dense_group_gives_a_row_each():
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal(16) + 0.02 * rng.standard_normal((900, 16))
    params, ids = HnswParams(), np.arange(900) + 7
    hits = linked(vectors, Graph(_unit(vectors), params), None, params)
    rows = summed(hits, ids, np.full(900, 2), None, None)
    assert len(rows) == 900 and (rows["more"] == 2 * 899).all() and (rows["root"] == 7).all()


@pytest.mark.parametrize("shard_rows", [300, 8192])
def test_query_against_brute_force(spark, shard_rows):
    vectors = sample(1, 600, 16)
    data = [(i, v.tolist(), i % 3) for i, v in enumerate(vectors)]
    data += [(5000 + i, data[4][1], data[4][2]) for i in range(150)] + [(6000, data[4][1], None), (6001, [0.0] * 16, 1), (6002, None, 1)]
    data += [(6003, [float("inf")] + [1.0] * 15, 1), (6004, [None] * 16, 1), (6005, [1.0, 0.0], 1), (6006, [2.0, 0.1], 1), (None, data[4][1], 1), (7, data[7][1], 1)]
    got = near_duplicates(spark.createDataFrame([(*d, 9, 9) for d in data], "vec_id long, embedding array<float>, label int, size int, cid int"), HnswParams(shard_rows=shard_rows)).collect()
    fit = [(i, np.array(v, float), label) for i, v, label in data if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, root = {}, {i: i for i, *_ in fit}
    near = []
    for k, (i, v, label) in enumerate(fit):
        for j, w, other in fit[k + 1 :]:
            if label == other and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                near.append((i, j))
    for _ in range(30):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    for i, j in near:
        links[i] = links.get(i, 0) + 1
        links[j] = links.get(j, 0) + (i != j)
    assert len(got) == len(data)
    right = sum((r.component_id, r.n_links) == (root.get(r.vec_id, r.vec_id), links.get(r.vec_id, 0)) for r in got if r.vec_id != 7)
    assert right >= 0.97 * (len(got) - 2)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
