import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm.simhash import drop_near_copies
from quarry.llm.suffix import SuffixParams, cut_documents

SF = "/root/testdata/sf0.001"


def words(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def similarity(a, b):
    a, b = words(a), words(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [list(rng.choice(vocabulary, 400)) for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:10]:
        for k in (1, 2, 3):
            copy = list(b)
            copy[50 * k] = "changed"
            texts.append(" ".join(copy))
    texts += [texts[0], "", None, "a b", "a b"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, texts[1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in drop_near_copies(docs).collect()}
    assert kept == {*range(40), 71, 73}
    assert drop_near_copies(docs.limit(0)).columns == docs.columns


def test_cut_documents(spark):
    rng = np.random.default_rng(3)
    passage = "é".join(map(str, rng.integers(0, 9, 60)))
    rows = [(i, f"{rng.integers(1 << 60)}{passage}{rng.integers(1 << 60)}", "en", "s", 7) for i in range(3)] + [(9, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in cut_documents(docs, SuffixParams(length=60, gram=20)).collect()}
    assert len(got) == 4 and got[9].text is None
    assert all(passage not in got[i].text and got[i].n_chars == len(got[i].text) < 60 for i in range(3))


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs[-1], SF).write.parquet(path)
        docs.append(spark.read.parquet(path))
    return docs


def test_stages_keep_the_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert steps[-1].columns[:3] == ["doc_id", "start", "length"]


def test_each_stage_takes_effect(steps):
    counts = [s.count() for s in steps]
    assert counts[0] > counts[1] >= counts[2] and all(counts)


def test_no_near_copy_is_left(steps):
    texts = [r.text for r in steps[2].collect()]
    left = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if len(words(a)) > 3 and similarity(a, b) > 0.97]
    assert not left
    first = {r.text for r in steps[1].collect()}
    gone = first - set(texts)
    assert all(max(similarity(g, t) for t in texts) >= 0.8 for g in gone)


def test_packing_covers_what_mixing_took(steps):
    taken = steps[4].groupBy("doc_id").count().collect()
    packed = {r.doc_id: r.n for r in steps[5].where("start = 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert packed == {r.doc_id: r["count"] for r in taken}


def greedy(texts):
    kept = []
    for i, t in enumerate(texts):
        if all(similarity(t, texts[k]) < 0.8 for k in kept):
            kept.append(i)
    return set(kept)


def test_pairs_at_the_least_similarity_are_found(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for n in (9, 12, 30, 60, 61, 90, 130) * 6:
        base = list(rng.choice(vocabulary, n))
        texts.append(" ".join(base))
        for at in (1, n // 2, n - 1):
            texts.append(" ".join([*base[:at], "changed", *base[at + 1 :]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = greedy(texts)
    assert {r.doc_id for r in drop_near_copies(docs).collect()} == want and len(want) < len(texts) - 60
    assert {r.doc_id for r in drop_near_copies(docs, crowd=2).collect()} == want


@pytest.mark.parametrize("crowd", [2, 64])
def test_copies_of_many_unlike_texts_go(spark, crowd):
    """Equal fingerprints, from one shingle that is repeated, but nothing else shared."""
    texts = ["x " * 300 + " ".join(f"t{i}w{k}" for k in range(20)) for i in range(9)]
    rows = [(100 * copy + i, t) for copy in range(3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_near_copies(docs, crowd=crowd).collect()) == list(range(9))


ODD = "doc_id long, text string, lang string, source string, n_chars long, tokens int, quality_score double, domain string, __row int, `a.b` string, __key string, row int"


def odd_docs(spark):
    """Extra columns named like those that stages use inside, and texts of every kind."""
    passage = " ".join(f"shared{k}" for k in range(60))
    texts = [f"some words of {i} " + " ".join(f"w{i}x{k}" for k in range(30)) for i in range(40)] + [f"{passage} tail{i}" for i in range(3)]
    texts += [None, "", "short", "long " + " ".join(f"v{k}" for k in range(150_000)), texts[0], texts[1] + " more"]
    rows = [(i, t, ("en", None, "de")[i % 3], (f"src{i % 5}", None)[i % 7 == 0], None if t is None else len(t), 5, 0.25, "here", -7, "dot", "key", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id at all", "en", "src1", 12, 5, 0.25, "here", -7, "dot", "key", 3)], ODD).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows_and_names(spark, name):
    docs = odd_docs(spark).persist()
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} and all(r.length == len(r.ids) for r in rows)
    else:
        assert out.columns == docs.columns and rows
        assert {(r.tokens, r.quality_score, r.domain, r["__row"], r["a.b"], r["__key"], r.row) for r in rows} == {(5, 0.25, "here", -7, "dot", "key", 3)}
        before = {r.doc_id: r.text for r in docs.collect()}
        same = {"quality", "near copies"}
        assert all(r.text == before[r.doc_id] if name in same else len(r.text or "") <= len(before[r.doc_id] or "") for r in rows)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.columns == out.columns and empty.count() == 0
    docs.unpersist()


def test_mixing_takes_no_more_tokens_than_granted(spark):
    from quarry.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    granted = mixing.plan(docs, mixing.QUERY)[0]
    leaves = docs.select(*(c.alias(n) for n, c in mixing.leaf_columns().items()), mixing.words(F.col("text")).alias("n")).groupBy(*mixing.LEVELS).agg(F.sum("n").alias("supply"))
    want = granted.join(leaves, list(mixing.LEVELS)).agg(F.sum(F.col("full") * F.col("supply") + F.col("rest"))).first()[0]
    got = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, SF).agg(F.sum(mixing.words(F.col("text")))).first()[0]
    assert got == want


def test_operators_keep_columns_named_like_their_own(spark):
    docs = odd_docs(spark).where("doc_id > 35 or doc_id is null")
    want = {"__row": -7, "__key": "key", "a.b": "dot", "tokens": 5}
    for out in (drop_near_copies(docs), cut_documents(docs)):
        rows = out.collect()
        assert out.columns == docs.columns and rows and all(r[c] == v for r in rows for c, v in want.items())
