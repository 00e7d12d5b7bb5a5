"""Concatenate and cut: all token streams stand end to end and are cut into fixed windows. Pass one tokenises and keeps each
partition's running totals; prefix sums over the partition totals give every document its global offset; pass two cuts."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_text, slices, stored, to_bytes


@dataclass(frozen=True)
class PackingParams:
    """tokenizer: path of a tokenizers file of any model, the same on every executor. end_id: follows each document's ids."""

    tokenizer: str
    window: int = 2048
    end_id: int = 1
    pad_id: int = 0


_LETTER = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
#: Chunks of one or two words of the vocabulary's splitter: letters, letters with marks after them.
_SIMPLE = re.compile(_LETTER + rb"+([.,;:!?|]*)")
_WORD_END, _MARK = "</w>", "<|startoftext|>"


class Growing:
    """An array that is extended in place, with room to spare."""

    def __init__(self, kind: type) -> None:
        self.held, self.count = np.zeros(1 << 12, kind), 0

    def extend(self, more: np.ndarray) -> None:
        end = self.count + len(more)
        if end > len(self.held):
            wider = np.zeros(max(end, 2 * len(self.held)), self.held.dtype)
            wider[: self.count] = self.held[: self.count]
            self.held = wider
        self.held[self.count : end] = more
        self.count = end


def _loaded(path: str) -> object:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ChunkTokenizer:
    """Ids of texts under a byte-pair tokenizer with word ends that lowers case and drops white space: no id spans ASCII white
    space, so each distinct chunk between white space is encoded once and texts are put together from chunks in numpy. New
    chunks are encoded joined: simple ones by spaces, as the ids that end words tell them apart, others by a special token.
    The table starts anew when it outgrows its room."""

    def __init__(self, tokenizer: object, room_bytes: int = 128 << 20) -> None:
        """tokenizer: one of the tokenizers library, or a file's path."""
        self.tokenizer, self.room = _loaded(tokenizer) if isinstance(tokenizer, str) else tokenizer, room_bytes
        self.mark = self.tokenizer.token_to_id(_MARK)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.begins, self.sizes, self.used = Growing(np.uint32), Growing(np.int64), Growing(np.int64), 0

    def _joined(self, chunks: list[bytes], by: str, size: int = 256) -> np.ndarray:
        texts = [by.join([c.decode() for c in chunks[i : i + size]]) + by for i in range(0, len(chunks), size)]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.concatenate([np.zeros(0, np.uint32), *(np.array(f.ids, dtype=np.uint32) for f in found)])

    def _learn(self, new: list[bytes]) -> None:
        simple, words, other, alone = [], [], [], []
        for chunk in new:
            if found := _SIMPLE.fullmatch(chunk):
                simple.append(chunk)
                words.append(2 if found[1] else 1)
            elif _MARK.encode() in chunk:
                alone.append(chunk)
            else:
                other.append(chunk)
        ids = self._joined(simple, " ")
        ends = np.concatenate([[0], np.flatnonzero(self.ends_word[ids]) + 1])[np.cumsum([0, *words])]
        marked = self._joined(other, _MARK)
        at = np.flatnonzero(marked == self.mark)
        lone = [np.array(self.tokenizer.encode(c.decode(), add_special_tokens=False).ids, dtype=np.uint32) for c in alone]
        lengths = np.concatenate([np.diff(ends), np.diff(at, prepend=-1) - 1, [len(x) for x in lone]]).astype(np.int64)
        self.index.update(zip(simple + other + alone, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.begins.extend(self.flat.count + np.cumsum(lengths) - lengths)
        self.sizes.extend(lengths)
        self.flat.extend(np.concatenate([ids, marked[marked != self.mark], *lone]))
        self.used += sum(map(len, new)) + 4 * int(lengths.sum()) + 130 * len(new)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text."""
        if self.used > self.room:
            self._clear()
        chunks = [(t if b"<|" in t else t.lower()).split() for t in texts]  # special tokens are looked for before case is lowered
        words = list(chain.from_iterable(chunks))
        at = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        if len(missing := np.flatnonzero(at < 0)):
            self._learn(list(dict.fromkeys(words[i] for i in missing.tolist())))
            at[missing] = [self.index[words[i]] for i in missing.tolist()]
        lengths = self.sizes.held[at]
        ends = np.cumsum(lengths)
        ids = self.flat.held[np.repeat(self.begins.held[at] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, chunks)])].astype(np.int64)
        return ids, np.diff(bounds)


class WholeTokenizer:
    """Ids of texts under any tokenizer, each text encoded as it stands."""

    def __init__(self, tokenizer: object) -> None:
        self.tokenizer = tokenizer

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [f.ids for f in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        counts = np.array([len(f) for f in found], dtype=np.int64)
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(counts.sum())), counts


#: Texts that tell whether chunks between white space can be encoded by themselves.
_PROBES = ("Ab cd, ef.\n\tGH ij's  12 3.5 x_y", "über Straße  naïve\u00a0z é!? \u4e2d\u6587 \U0001f600 a\u0301b", "<|startoftext|>Ab</w> <|endoftext|> http://x.y/z?q=1 &amp; #a @b")


def by_chunks(tokenizer: object) -> bool:
    """Whether ChunkTokenizer is right for a tokenizer: byte pairs with word ends, lowered case, white space dropped."""
    model = json.loads(tokenizer.to_str())
    known = tokenizer.get_vocab()
    if model["model"].get("type") != "BPE" or model["model"].get("end_of_word_suffix") != _WORD_END or _MARK not in known or "Lowercase" not in json.dumps(model["normalizer"]):
        return False
    whole = np.concatenate([np.array(tokenizer.encode(p, add_special_tokens=False).ids, np.uint32) for p in _PROBES])
    return bool(np.array_equal(ChunkTokenizer(tokenizer).encode([p.encode() for p in _PROBES])[0], whole))


@lru_cache(maxsize=2)
def tokenizer_at(path: str) -> ChunkTokenizer | WholeTokenizer:
    """One for each Python worker, kept from task to task."""
    tokenizer = _loaded(path)
    return ChunkTokenizer(tokenizer) if by_chunks(tokenizer) else WholeTokenizer(tokenizer)


def tokenise(docs: DataFrame, params: PackingParams) -> DataFrame:
    """Pass one: doc_id, ids (little-endian binary: 16 bits an id if the vocabulary allows, else 32; without end_id), n (with
    it), part, start: the ids before the document in its partition. Stored, so that parts and starts stay as they are."""
    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, before = tokenizer_at(params.tokenizer), 0
        width = id_width(tokenizer.tokenizer.get_vocab_size())
        for batch in batches:
            for part in slices(batch, 1):
                ids, counts = tokenizer.encode(to_bytes(part.column(1)))
                ends = np.cumsum(counts)
                raw = ids.astype(f"<u{width}").tobytes()
                blobs = pa.Array.from_buffers(
                    pa.binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], ends * width]).astype("<i4").tobytes()), pa.py_buffer(raw)]
                )
                with_end = counts + 1
                starts = before + np.cumsum(with_end) - with_end
                before += int(with_end.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), blobs, pa.array(with_end, pa.int64()), pa.array(np.full(len(counts), width), pa.int32()), pa.array(starts, pa.int64())],
                    names=["doc_id", "ids", "n", "width", "start"],
                )

    tokens = map_text(narrow, run, f"doc_id {kind}, ids binary, n long, width int, start long")
    return stored(tokens.withColumn("part", F.spark_partition_id()))


def id_width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def bases(tokens: DataFrame) -> dict[int, int]:
    """Global offset of each part: prefix sums over one total per partition (the driver tracks as many tasks anyway)."""
    totals = sorted(tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())
    ends = np.cumsum([t["n"] for t in totals])
    return {t["part"]: int(end) - t["n"] for t, end in zip(totals, ends, strict=True)}


def pieces(docs: DataFrame, params: PackingParams, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, then boundary facts: whether the
    piece begins and ends its document, and sequence_tokens, the window's tokens before padding; with keep_ids, ids too.

    Documents stand in the order of the input's partitions and rows. A null or empty text is its end_id alone; a null id and
    repeated rows are documents like any other; a document longer than a window is cut as often as needed; an empty table
    gives no rows. Only the last window can be short."""
    tokens = tokenise(docs, params)
    base = bases(tokens)
    total = sum(r["n"] for r in tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect())
    kind = docs.schema["doc_id"].dataType.simpleString()
    window, end_id = params.window, params.end_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 1):
                yield _cut_rows(rows, base, total, window, end_id, keep_ids)

    schema = (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "begins boolean, ends boolean, sequence_tokens long"
    )
    return map_text(tokens.select("doc_id", "ids", "n", "width", "start", "part"), run, schema + ", ids array<int>" * keep_ids)


def _cut_rows(rows: pa.RecordBatch, base: dict[int, int], total: int, window: int, end_id: int, keep_ids: bool) -> pa.RecordBatch:
    n = rows.column(2).to_numpy()
    width = rows.column(3)[0].as_py()
    first = rows.column(4).to_numpy() + np.array([base[p] for p in rows.column(5).to_pylist()], dtype=np.int64)
    parts = (first + n - 1) // window - first // window + 1
    row = np.repeat(np.arange(len(n)), parts)
    sequence = first[row] // window + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, end = np.maximum(first[row], sequence * window), np.minimum(first[row] + n[row], (sequence + 1) * window)
    start, length = begin - first[row], end - begin
    whole = [np.append(np.frombuffer(b, f"<u{width}"), end_id).astype("<u4") for b in to_bytes(rows.column(1))]
    cuts = [whole[r][s : s + k] for r, s, k in zip(row, start, length, strict=True)]
    columns = [
        rows.column(0).take(pa.array(row)),
        *(pa.array(x, pa.int64()) for x in (start, length, [zlib.crc32(c.tobytes()) for c in cuts], n[row], sequence, begin - sequence * window)),
        pa.array(start == 0),
        pa.array(start + length == n[row]),
        pa.array(np.minimum(window, total - sequence * window), pa.int64()),
    ]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "begins", "ends", "sequence_tokens"]
    if keep_ids:
        columns.append(pa.array([c.astype(np.int32) for c in cuts], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


def sequences(docs: DataFrame, params: PackingParams) -> DataFrame:
    """The training rows: sequence_id, ids, tokens. ids are padded with pad_id to the window, unless the tokens are a power of
    two. A sequence gathers at most a window of ids, whatever the documents' sizes."""
    cuts = pieces(docs, params, keep_ids=True)
    joined = cuts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("cuts"), F.max("sequence_tokens").alias("tokens"))
    power = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    padding = F.when(power, 0).otherwise(params.window - F.col("tokens")).cast("int")
    ids = F.concat(F.flatten(F.transform("cuts", lambda c: c["ids"])), F.array_repeat(F.lit(params.pad_id), padding))
    return joined.select("sequence_id", ids.alias("ids"), "tokens")
