import re

import numpy as np
import pytest
import xxhash

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.components import components
from quarry.llm.simhash import BKTree, Shingler, distinct, link, may_be_similar, near_duplicates, nearest_prints, parity, prefixes, shard_keys


def plain_print(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            if (m := min(root[a], root[b])) != root[a] or m != root[b]:
                root[a] = root[b] = m
                changed = True
    return root


def cloud(seed, n=1500):
    """Random fingerprints with clusters a few bits around some of them."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    near = base[rng.integers(0, 40, n)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    return np.unique(np.concatenate([base, near, np.array([0, 1, 3, (1 << 64) - 1], np.uint64)]))


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_tree_finds_all_within_radius(radius):
    prints = cloud(radius)
    found = {(int(q), int(a)) for qs, ats in BKTree(prints).within(prints, radius) for q, a in zip(qs, ats)}
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= radius
    assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))


@pytest.mark.parametrize("hot", [20, 100_000])
def test_links_connect_as_all_pairs(spark, hot):
    prints = cloud(7, 700)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    shared = shard_keys(df, 2, hot).toPandas()
    groups = shared.groupby(["mask", "value"])["fp"].apply(set)
    a, b = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None]) <= 2, 1))
    signed = prints.view(np.int64).tolist()
    together = {(x, y) for g in groups for x in g for y in g}
    assert all((signed[i], signed[j]) in together for i, j in zip(a, b))
    got = {r.node: r.root for r in components(link(df, 2, 256)).collect()}
    want = plain_components(signed, [(signed[i], signed[j]) for i, j in zip(a, b)])
    assert {n: got.get(n, n) for n in signed} == want


def test_query_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"Wörd{i}" for i in range(50)]
    texts = [" ".join(rng.choice(vocabulary, k)) for k in (1, 2, 3, 4, 40, 300, 900)]
    texts += [texts[5] + " x", texts[6] + "\x0b y", texts[6].replace("Wörd1 ", "W\xa0 ", 1), None, "", " \n\t", texts[4].upper(), "a" * 50_000, texts[4], texts[4]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "lonely words here"), (None, texts[6]), (3, texts[3])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    prints = [plain_print(t) for _, t in rows]
    distinct = sorted(set(prints))
    root = plain_components(distinct, [(a, b) for a in distinct for b in distinct if a < b and bin(a ^ b).count("1") <= 2])
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    assert got == sorted(((i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints)), key=str)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (99, 98), (98, 99)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {**dict.fromkeys(range(61), 0), 98: 98, 99: 98}


@settings(deadline=None)
@given(st.lists(st.text("abAB \t", max_size=30), max_size=8), st.integers(1, 5))
def test_shingles_are_equal_where_their_words_are(texts, size):
    hashes, counts = Shingler(size)([t.encode() for t in texts])
    lists = [re.findall(r"[^ \t]+", t.lower()) for t in texts]
    runs = [[tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else [] for w in lists]
    assert counts.tolist() == [len(r) for r in runs]
    flat = [r for own in runs for r in own]
    assert len(set(zip(hashes.tolist(), flat))) == len(set(flat)) == len(set(hashes.tolist()))
    own, sizes = distinct(hashes, counts)
    assert sizes.tolist() == [len(set(r)) for r in runs] and len(own) == sizes.sum()


@settings(deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([0.5, 0.8, 0.95]))
def test_no_similar_pair_is_ruled_out(seed, shared, left, right, least):
    """Neither by parities nor by prefixes, with some shingles common."""
    rng = np.random.default_rng(seed)
    hashes = rng.integers(0, 1 << 63, shared + left + right, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    a, b = np.unique(hashes[: shared + left]), np.unique(np.concatenate([hashes[:shared], hashes[shared + left :]]))
    if shared >= least * (shared + left + right):
        assert may_be_similar([parity(a)], [parity(b)], np.array([len(a)]), np.array([len(b)]), least)[0]
        often = np.zeros(min(5, shared), [("hash", "<u8"), ("rank", "<i4")])
        often["hash"], often["rank"] = hashes[: len(often)], np.arange(len(often))
        _, sizes, firsts, n = prefixes(np.concatenate([a, b]), np.array([len(a), len(b)]), np.sort(often, order="hash"), least)
        assert sizes.tolist() == [len(a), len(b)] and set(firsts[: n[0]].tolist()) & set(firsts[n[0] :].tolist())


def test_parities_rule_most_others_out():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, int(n), dtype=np.uint64)) for n in rng.integers(40, 600, 60)]
    marks, sizes = [parity(s) for s in sets], np.array([len(s) for s in sets])
    a, b = np.triu_indices(60, 1)
    left = may_be_similar([marks[i] for i in a], [marks[i] for i in b], sizes[a], sizes[b], 0.8)
    assert left.mean() < 0.01


def test_nearest_prints(spark):
    prints = cloud(5, 600).view(np.int64).tolist()
    base, asked = prints[::2], prints[1::2]
    frame = lambda x: spark.createDataFrame([(p,) for p in x], "fp long")
    got = {(r.asked, r.fp) for r in nearest_prints(frame(base), frame(asked), 3, most=2, shard_rows=128).collect()}
    apart = lambda x, y: bin((x ^ y) & (1 << 64) - 1).count("1")
    assert got and all(apart(x, y) <= 3 for x, y in got)
    for x in asked:
        near = min((apart(x, y) for y in base), default=64)
        if near <= 3:
            assert min(apart(x, y) for a, y in got if a == x) == near
