import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm.packing import ChunkTokenizer, PackingParams, WholeTokenizer, pieces, sequences, tokenizer_at

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello world, it's 42!", "Straße, naïve; ÄÖ| × ÷a à. b..", "<|startoftext|>", "a<|STARTOFTEXT|>b <|startoftext|>.", "", None, "a" * 5000, "x y ́z é <|endoftext|>in<|startoftext|> side", " \t\n ", "\x1c\x1d odd \x85 spaces　here",
    "ΑΣ ΟΔΟΣ İstanbul ǅ", "word " * 6000, "tail\x00nul", "I'VE they'll don't", "Hello world, it's 42!",
]


def plain(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def test_chunks_equal_whole_texts():
    texts = [(t or "").encode() for t in TEXTS]
    ids, counts = ChunkTokenizer(PATH, room_bytes=10).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain(t)[:-1] for t in TEXTS]


@pytest.mark.parametrize("parts", [1, 3])
def test_pieces_cover_each_id_once(spark, parts):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "no id", 7), (3, "again", 7)], "doc_id long, text string, start int").repartition(parts)
    rows = pieces(docs, PackingParams(PATH)).collect()
    wanted = {i: plain(t) for i, t in enumerate(TEXTS)} | {None: plain("no id")}
    at = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    flat = [s * 2048 + o for s, o, _ in at]
    assert flat[0] == 0 and all(a + n == b for a, (_, _, n), b in zip(flat, at, flat[1:]))
    assert all(o + n <= 2048 for _, o, n in at)
    for r in rows:
        ids = plain("again") if r.doc_id == 3 and r.doc_tokens == len(plain("again")) else wanted[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in rows) == sum(map(len, wanted.values())) + len(plain("again"))
    whole = sequences(docs, PackingParams(PATH)).collect()
    last = max(r.sequence_id for r in whole)
    assert all(len(r.ids) == 2048 for r in whole if r.sequence_id != last)


def test_empty_table(spark):
    assert pieces(spark.createDataFrame([], "doc_id long, text string"), PackingParams(PATH)).count() == 0


def test_other_tokenizers_encode_whole_texts(spark):
    """A byte-level vocabulary, where white space is part of ids."""
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert isinstance(tokenizer_at(PATH), ChunkTokenizer) and isinstance(tokenizer_at(other), WholeTokenizer)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    got = {}
    for r in sorted(pieces(docs, PackingParams(other), keep_ids=True).collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(r.ids)
    plain_ids = Tokenizer.from_file(other)
    assert got == {i: [*plain_ids.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
