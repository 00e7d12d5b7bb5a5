import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.suffix import SuffixParams, anchors, common_prefixes, dedup, suffix_array


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept digest) of each text."""
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, dtype=int)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = 1
        kept = bytes(b for b, g in zip(t, gone[1:-1]) if not g)
        out.append((len(t), len(t) - len(kept), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@settings(deadline=None, max_examples=80)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=12), st.integers(1, 30), st.integers(1, 40))
def test_suffixes_are_sorted_and_measured(texts, most, first):
    data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    starts = np.minimum(sizes, first)
    order, rank = suffix_array(data, sizes)
    common = common_prefixes(data, sizes, order, rank, starts, most)
    suffixes = [(t[i:], k, i) for k, t in enumerate(texts) for i in range(len(t))]
    # an end comes before every byte, and ends in order of their texts
    want = sorted(range(len(suffixes)), key=lambda i: ([b + 1 for b in suffixes[i][0]] + [0], suffixes[i][1]))
    assert order.tolist() == want and rank[order].tolist() == list(range(len(data)))
    for i, (own, k, nth) in enumerate(suffixes):
        if nth >= starts[k]:
            assert common[i] == -1
            continue
        other = suffixes[order[rank[i] - 1]][0] if rank[i] else b""
        assert common[i] == min(most, next((n for n, (x, y) in enumerate(zip(own, other)) if x != y), min(len(own), len(other))))


@pytest.mark.parametrize("kind", ["random", "periodic"])
def test_every_string_has_its_anchor(kind):
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 99 if kind == "random" else 98, n, dtype=np.uint8)) for n in (20, 21, 50, 400)]
    params = SuffixParams(length=20, gram=6)
    text, _, place, far, near = anchors(texts, params)
    starts = Counter((t, p - b) for t, p, f, n in zip(text.tolist(), place.tolist(), far.tolist(), near.tolist()) for b in range(n, f + 1))
    assert starts == Counter((t, s) for t, x in enumerate(texts) for s in range(len(x) - 19))


def corpus(seed):
    rng = np.random.default_rng(seed)
    words = [bytes(rng.integers(97, 105, k, dtype=np.uint8)).decode() for k in (2, 3, 4, 5) for _ in range(12)] + ["é", "ß\x00"]
    prose = lambda n: " ".join(rng.choice(words, n))
    passage = prose(40)
    texts = [prose(int(n)) for n in rng.integers(1, 120, 60)]
    for i in range(0, 60, 3):
        at = int(rng.integers(0, len(texts[i]) + 1))
        texts[i] = texts[i][:at] + passage[int(rng.integers(0, 30)) :] + texts[i][at:]
    texts += [t[:60] + "#" + t[60:] for t in texts[:15]] + texts[20:25] + ["a" * 300, "ab" * 200, "", "a" * 40, "\x00" * 90]
    return texts


@pytest.mark.parametrize(("seed", "hot", "rows"), [(0, 16_000, 50), (1, 3, 10_000), (2, 16_000, 10_000)])
def test_query_against_brute_force(spark, seed, hot, rows):
    texts = corpus(seed)
    data = [(i, t, 1, b"x") for i, t in enumerate(texts)] + [(None, None, 1, b"x"), (3, texts[3], 1, b"x"), (None, "short", 1, b"")]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_bytes int, key binary").repartition(4)
    got = dedup(docs, SuffixParams(length=40, gram=12, hot_rows=hot, shard_rows=rows)).collect()
    want = brute([(t or "").encode() for _, t, *_ in data], 40)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(i), *w) for (i, *_), w in zip(data, want))
    assert sum(w[1] for w in want) > 1000


def test_empty_table(spark):
    assert dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
