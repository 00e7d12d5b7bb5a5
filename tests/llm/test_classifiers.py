import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quarry.llm import language, quality
from quarry.llm.compression import Logistic, SizeModel, gather

SF = "/root/testdata/sf0.01"
WORDS = {"en": "the and that with have this will your from they know want been good much some time very when come here just like long make many over such take than them well were".split(), "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split()}


def sentence(rng, lang, n=60):
    return " ".join(rng.choice(WORDS[lang], n)) + "."


def held(doc_id, folds, which):
    return zlib.crc32(str(doc_id).encode()) % folds == which


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, sentence(rng, "en" if i % 3 else "de"), "en" if i % 3 else "de", "s", 9, 0.5) for i in range(300)]
    junk = [(300 + i, "@@ ## " * int(rng.integers(20, 60)) + sentence(rng, "en", 5), "en", "s", 9, 0.5) for i in range(150)]
    odd = [(900, None, None, None, None, None), (901, "", "en", "s", 0, 0.5), (902, "12 34 !!", "en", "s", 8, 0.5), (None, sentence(rng, "de"), "de", "s", 9, 0.5), (904, "Und " * 60_000, None, "s", 9, 0.5), (5, sentence(rng, "en"), "en", "s", 1, 0.5)]
    return spark.createDataFrame(rows + junk + odd, "doc_id long, text string, lang string, source string, n_chars long, quality_score double").repartition(3)


def test_quality_learns_and_holds_out(spark, docs):
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 450, 2)] + [(None, 1, 0), (7, None, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == held(r.doc_id, 3, 1) for r in rows if r.doc_id is not None)
    unseen = [r for r in rows if r.doc_id is not None and r.doc_id < 450 and r.doc_id % 2]
    assert np.mean([r.predicted == (r.doc_id < 300) for r in unseen]) > 0.97


def test_quality_ignores_held_out_labels(spark, docs):
    own = [(i, int(i < 300)) for i in range(450)]
    both = [spark.createDataFrame([(i, q if not held(i, 3, 1) else flip(q)) for i, q in own], "doc_id long, quality int") for flip in (lambda q: q, lambda q: 1 - q)]
    one, two = ({(r.doc_id, r.score) for r in quality.classify(docs.where("doc_id < 450 and doc_id <> 5"), b).collect()} for b in both)
    assert one == two


def test_quality_of_one_class_and_of_nothing(spark, docs):
    one = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, one).collect()} == {1.0}
    assert {r.score for r in quality.classify(docs, one.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), one).count() == 0


def test_score_keeps_columns(spark, docs):
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(450)], "doc_id long, quality int")
    scored = quality.score(docs, quality.fit(docs, labels))
    assert scored.columns == ["doc_id", "text", "lang", "source", "n_chars", "quality_score"] and scored.count() == docs.count()


def test_language(spark, docs):
    rows = {(r.doc_id, r.lang_pred): r for r in language.identify(docs).collect()}
    assert len(rows) >= 455 and all(r.held_out == held(r.doc_id, 4, 2) for r in rows.values() if r.doc_id is not None)
    fine = [(i, lang) for i, lang in rows if i is not None and i < 300 and i != 5]
    assert np.mean([lang == ("en" if i % 3 else "de") for i, lang in fine]) > 0.99
    for i in (900, 901, 902):
        assert rows[i, "und"].score == 0 and rows[i, "und"].rejected
    assert (904, "de") in rows and (None, "de") in rows
    strict = language.identify(docs, language.LanguageParams(margin=2.0, keep_rejected=False)).select("lang_pred").distinct().collect()
    assert [r[0] for r in strict] == ["und"]


def test_all_languages_are_learned(spark):
    """More languages than dictionaries of full room, and languages of only short or only long texts."""
    letters = "bcdfghjklm"
    word = [f"{letters[i // 10]}a{letters[i % 10]}o" for i in range(5)]
    rows = [(100 * i + k, f"{w} {w}u {w}i " * (2 + 2000 * (i == 3) if i != 4 else 1), f"l{i}") for i, w in enumerate(word) for k in range(20 - i)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs, language.LanguageParams(languages=3)).join(docs, "doc_id").collect()
    assert all(r.lang_pred == r.lang for r in got) and len({r.lang for r in got}) == 5


def test_language_without_labels_or_rows(spark, docs):
    from pyspark.sql import functions as F

    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unknown).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.classify(table, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.85


def plain_size(raw, level, text, piece=0):
    """Compressed size of a text, by the library alone."""
    held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None
    if held:
        held.precompute_compress(level=level)
    made = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False, dict_data=held)
    return sum(len(made.compress(text[i : i + (piece or len(text) or 1)])) for i in range(0, max(1, len(text)), piece or max(1, len(text))))


def test_quality_against_plain_python(spark, docs):
    """The whole fit and score again, without Spark: dictionaries from even rows in hash order, a logistic curve from odd ones."""
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(450)], "doc_id long, quality int")
    params = quality.QualityParams(dictionary_bytes=4096, sample_rows=60, sample_chars=400, piece=128)
    own = docs.where("doc_id < 450 and doc_id <> 5").select("doc_id", "text")
    rows = own.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).collect()
    learn = sorted((r for r in rows if not held(r.doc_id, 3, 1)), key=lambda r: (r.h, r.doc_id))
    texts = [[r.text[:400].encode() for r in learn if (r.doc_id < 300) == good][:60] for good in (True, False)]
    raw = []
    for own_texts in texts:
        taken = b""
        for t in own_texts[::2]:
            if len(taken) + len(t) + 1 > 4096 + (not taken):
                break
            taken += (b"\n" if taken else b"") + t
        raw.append(taken)
    assert raw == [gather(t[::2], 4096)[0] for t in texts]

    def measure(t):
        good, bad = (plain_size(r, params.level, t, 128) for r in raw)
        return (bad - good) / max(1, len(t))

    x = np.array([measure(t) for own_texts in texts for t in own_texts[1::2]])
    y = np.repeat([1.0, 0.0], [len(t[1::2]) for t in texts])
    total = [sum((r.doc_id < 300) == good for r in learn) for good in (True, False)]
    curve = Logistic(x[:, None], y, np.where(y == 1, total[0] / (y == 1).sum(), total[1] / (y == 0).sum()))
    got = {r.doc_id: r.score for r in quality.classify(own, labels, params).collect()}
    assert got == {r.doc_id: pytest.approx(float(curve(np.array([[measure(r.text.encode())]]))[0]), abs=1e-9) for r in rows}


def test_language_against_plain_python(spark, docs):
    """Every text's sizes again, under dictionaries put together in plain Python."""
    params = language.LanguageParams(dictionary_bytes=3000, sample_rows=80, level=5)
    rows = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("h")).collect()
    raw = {}
    for name in ("en", "de"):
        own = [r for r in rows if r.lang == name and not (r.doc_id is not None and held(r.doc_id, 4, 2)) and r.text and 32 <= len(r.text) <= 8192]
        own.sort(key=lambda r: (r.h, r.doc_id is not None, r.doc_id or 0))
        raw[name] = gather(dict.fromkeys(language.normalise(r.text) for r in own[:80]), 3000)[0]
    got = language.identify(docs, params).collect()
    want = {}
    for r in rows:
        sizes = {n: plain_size(d, 5, language.normalise(r.text)) for n, d in raw.items()}
        named = min(("en", "de"), key=sizes.get) if r.text and any(c.isalpha() for c in r.text) else "und"
        want.setdefault((r.doc_id, named), 0)
        want[r.doc_id, named] += 1
    found = {}
    for r in got:
        found[r.doc_id, r.lang_pred] = found.get((r.doc_id, r.lang_pred), 0) + 1
    assert found == want


def test_quality_learns_from_classes_of_long_texts(spark):
    rows = [(i, ("good words here " if i % 2 else "bad stuff there ") * 1500) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)


def test_parts():
    assert gather([b"aa", b"b" * 9, b"c"], 8) == (b"aa", 1)
    sizes = SizeModel([b"", b"the quick brown fox " * 20], 3).sizes([b"the quick brown fox", b""])
    assert sizes[0, 1] < sizes[0, 0]
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    p = Logistic(x, np.array([0, 0, 1, 1.0]), np.ones(4))(x)
    assert (np.diff(p) > 0).all() and p[0] < 0.5 < p[3]
