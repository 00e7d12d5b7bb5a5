"""Suffix-array dedup: finds every byte covered by a string of `length` bytes that also starts anywhere else.

Anchors. Of the grams in a string of `length` bytes, the least by hash (leftmost of equals) is its anchor, so equal strings have
equal anchors at equal offsets. Strings whose anchor's hash occurs once can't repeat; the others, as regions of text around
their anchors, go to the shard of that hash.
Shards. A shard sorts all suffixes of its distinct regions by Larsson and Sadakane's refinement, measures the common prefixes of
neighbours by Kasai's walk, and a string repeats where a neighbour shares `length` bytes or its region stands there twice.
Across shards. Anchors too common for one shard are merged over all shards by their strings' digests."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import discard, few, fresh, map_text, quoted, slices, stored, to_bytes

_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_OTHER_ODD = tuple(np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_PLACE = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class SuffixParams:
    """length: of a repeated string. gram: bytes of an anchor. shard_rows: anchors of a shard. hot_rows: an anchor with more
    occurrences is merged across shards."""

    length: int = 200
    gram: int = 56
    shard_rows: int = 8_000
    hot_rows: int = 16_000

    def __post_init__(self) -> None:
        if not 0 <= self.length - self.gram < 256 or self.gram < 1:
            raise ValueError("length - gram must be 0 to 255, as distances to an anchor are kept in a byte")


def gram_hashes(data: np.ndarray, size: int, odd: tuple[np.uint64, ...] = _ODD) -> np.ndarray:
    """A 64-bit hash of each run of size bytes, by doubling."""

    def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = left * odd[1]
        out += right * odd[2]
        out ^= out >> np.uint64(31)
        return out

    out = (data.astype(np.uint64) + np.uint64(1)) * odd[0]
    out ^= out >> np.uint64(29)
    span = 1
    while span * 2 <= size:
        out, span = joined(out[:-span], out[span:]), span * 2
    if span < size:
        out = joined(out[: span - size], out[size - span :])
    out *= odd[0]
    out ^= out >> np.uint64(32)
    return out


def anchors(texts: list[bytes], params: SuffixParams) -> tuple[np.ndarray, ...]:
    """For texts of at least length bytes: arrays (text, hash, place, back_far, back_near), one entry per anchor: the strings
    that it anchors begin back_far, ..., back_near bytes before its place in its text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    found: list[tuple[np.ndarray, ...]] = []
    lo = 0
    while lo < len(texts):  # the places in a portion of texts fit 24 bits
        hi = lo + 1
        while hi < len(texts) and ends[hi] - (ends[lo] - sizes[lo]) < 1 << 20:
            hi += 1
        found += _anchors(texts[lo:hi], lo, params) if hi - lo > 1 or sizes[lo] < 1 << 21 else _long_anchors(texts[lo], lo, params)
        lo = hi
    return tuple(np.concatenate([f[i] for f in found]) for i in range(5)) if found else tuple(np.zeros(0, np.int64) for _ in range(5))


def _long_anchors(text: bytes, number: int, params: SuffixParams) -> list[tuple[np.ndarray, ...]]:
    """A very long text in portions that overlap by length - 1 bytes, so that each string lies within one."""
    out, step = [], 1 << 20
    for start in range(0, max(1, len(text) - params.length + 1), step):
        for part in _anchors([text[start : start + step + params.length - 1]], number, params):
            out.append((part[0], part[1], part[2] + start, part[3], part[4]))
    return out


def _anchors(texts: list[bytes], first: int, params: SuffixParams) -> list[tuple[np.ndarray, ...]]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    full = gram_hashes(data, params.gram)
    least = (full & ~_PLACE) | np.arange(len(full), dtype=np.uint64)
    window, span = params.length - params.gram + 1, 1
    while span * 2 <= window:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < window:
        least = np.minimum(least[: span - window], least[window - span :])
    counts = sizes - params.length + 1
    starts = np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    text = np.repeat(np.arange(len(texts)), counts)
    at = (least[starts] & _PLACE).astype(np.int64)
    head = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], len(at)) - 1
    place, text = at[heads], text[heads]
    return [(text + first, full[place].view(np.int64), place - begins[text], place - starts[heads], place - starts[tails])]


def _in_order(key: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the sorted keys (0 to below - 1) stood, and the keys. Sorting values is ten times as fast as sorting places,
    so the place stands in the low bits, if there is room."""
    low = int(len(key)).bit_length()
    if (below - 1).bit_length() + low > 64:
        by = np.argsort(key, kind="stable")
        return by, key[by]
    packed = key.astype(np.uint64) << np.uint64(low) | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64((1 << low) - 1)).astype(np.int64), packed >> np.uint64(low)


def suffix_array(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes of the texts that stand end to end in data with these sizes, and each position's rank in it. A
    text's end comes before every byte, and ends in order of their texts, so no two suffixes tie.

    Larsson and Sadakane: suffixes are sorted by their first bytes (four, at once); then, step by step, those of each tied group
    by the rank of the suffix that begins where the sorted bytes end, which doubles the bytes sorted by. What is alone in its
    group is not touched again."""
    n, texts = len(data), len(sizes)
    text = np.repeat(np.arange(texts, dtype=np.int32), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    word = np.zeros(n, np.uint64)
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint64)
    for k in range(4):
        word = word << np.uint64(8) | np.where(room > k, padded[k : n + k], np.uint64(0))
    order, word = _in_order(word * np.uint64(5) + np.minimum(room, 4).astype(np.uint64), 5 << 32)
    new = np.ones(n, dtype=bool)
    new[1:] = word[1:] != word[:-1]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = ~new
    tied[:-1] |= ~new[1:]
    place, at, span, head = np.flatnonzero(tied), order[tied], 4, new[tied]
    while len(at):
        later = np.where(room[at] > span, rank[np.minimum(at + span, n - 1)] + np.int64(texts), text[at])
        group = np.cumsum(head) - 1
        by, key = _in_order(group * (n + texts) + later, (int(group[-1]) + 1) * (n + texts))
        at = at[by]
        order[place] = at  # place is in order of rank, as the sorted keys are
        head = np.ones(len(key), dtype=bool)
        head[1:] = key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(head, place, 0))
        left = ~head
        left[:-1] |= ~head[1:]
        place, at, span, head = place[left], at[left], span * 2, head[left]
    return order, rank


def common_prefixes(data: np.ndarray, sizes: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """For the first starts positions of each text, the bytes (most, if more) in common with the suffix before it in the order;
    -1 for other positions.

    Kasai: in order of text, the next suffix has at least one byte less in common with the one before it, so bytes are not
    compared again. All texts are walked side by side, a position at a time."""
    n = len(data)
    ends = np.cumsum(sizes)
    end_of = np.repeat(ends, sizes)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.as_strided(padded, (n + 1, 8), (1, 1)).copy().view("<u8").ravel()
    out = np.full(n, -1, np.int32)
    begins, known = ends - sizes, np.zeros(len(sizes), np.int64)
    by_length = np.argsort(-starts, kind="stable")
    active = np.searchsorted(-starts[by_length], -np.arange(int(starts.max()) if len(starts) else 0), side="left")
    for step, count in enumerate(active.tolist()):
        own = by_length[:count]
        at = begins[own] + step
        above = rank[at]
        other = order[above - 1]  # of the first in the order: the last one, set right below
        limit = np.minimum(np.minimum(end_of[at] - at, end_of[other] - other), most)
        limit[above == 0] = 0
        same = np.minimum(np.maximum(known[own] - 1, 0), limit)
        todo = np.flatnonzero(same < limit)
        while len(todo):
            apart = word[at[todo] + same[todo]] ^ word[other[todo] + same[todo]]
            low = apart & (~apart + np.uint64(1))  # its lowest set bit stands in the first byte that differs
            equal = np.where(apart == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3)
            same[todo] = np.minimum(same[todo] + equal, limit[todo])
            todo = todo[(apart == 0) & (same[todo] < limit[todo])]
        known[own] = same
        out[at] = same
    return out


def repeated_starts(regions: list[bytes], far: np.ndarray, near: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """matched[row, back]: whether the string that begins back bytes before the row's anchor occurs again. A region runs from far
    bytes before the anchor to length bytes after the nearest start; a row of weight over 1 stands for as many equal ones."""
    data = np.frombuffer(b"".join(regions), np.uint8)
    sizes = np.array([len(r) for r in regions], dtype=np.int64)
    starts = far - near + 1
    order, rank = suffix_array(data, sizes)
    common = common_prefixes(data, sizes, order, rank, starts, length)
    hit = np.flatnonzero(common >= length)
    matched_at = np.zeros(len(data), dtype=bool)
    matched_at[hit] = matched_at[order[rank[hit] - 1]] = True
    row = np.repeat(np.arange(len(regions)), starts)
    nth = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    matched = np.zeros((len(regions), int(far.max()) + 1), dtype=bool)
    matched[row, far[row] - nth] = matched_at[(np.cumsum(sizes) - sizes)[row] + nth] | (weight[row] > 1)
    return matched


def _shard(columns: list[list], params: SuffixParams) -> pa.RecordBatch:
    """Spans of a shard. columns: hash, key, place, far, near, region, copied."""
    classes: dict[tuple, int] = {}
    number = np.array([classes.setdefault(x, len(classes)) for x in zip(columns[0], columns[5], columns[3], strict=True)])
    count = np.bincount(number, weights=1 + np.array(columns[6], dtype=np.int64))
    distinct = list(classes)
    far = np.array([c[2] for c in distinct])
    near = params.length + far - np.array([len(c[1]) for c in distinct])
    matched = repeated_starts([c[1] for c in distinct], far, near, count, params.length)
    edge = np.diff(np.pad(matched, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1  # runs of back, nearest first
    cuts = np.searchsorted(row, np.arange(len(distinct) + 1))
    wanted = np.flatnonzero(np.array(columns[6]) == 0)
    runs = cuts[number[wanted] + 1] - cuts[number[wanted]]
    who = np.repeat(wanted, runs)
    run = np.arange(len(who)) + np.repeat(cuts[number[wanted]] - (np.cumsum(runs) - runs), runs)
    place = np.array(columns[2], dtype=np.int64)[who]
    return _spans([columns[1][i] for i in who.tolist()], place - last[run], place - first[run] + params.length)


def _spans(keys: list[bytes], starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["key", "start", "end"])


def _distinct(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Texts of a partition with their keys, each text twice at most (more copies add nothing); a slice at a time."""
    seen: dict[bytes, int] = {}
    for batch in batches:
        for part in slices(batch, 0):
            keys, texts = [], []
            for text in to_bytes(part.column(0)):
                if len(text) < least:
                    continue
                key = hashlib.md5(text, usedforsecurity=False).digest()
                if (times := seen.get(key, 0)) < 2:
                    seen[key] = times + 1
                    keys.append(key)
                    texts.append(text)
            if len(seen) > 1 << 20:
                seen.clear()
            yield keys, texts


def _short(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)[:, 0]


def _anchor_table(docs: DataFrame, params: SuffixParams) -> DataFrame:
    """hash, short (half of the text's key), packed: place, far and near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _distinct(batches, params.length):
            if texts:
                text, hashes, place, far, near = anchors(texts, params)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(_short(keys)[text]), pa.array(place << 16 | far << 8 | near)], names=["hash", "short", "packed"])

    return map_text(docs.select("text"), run, "hash long, short long, packed long")


def _text_table(docs: DataFrame, params: SuffixParams) -> DataFrame:
    """short, key, text: each text of a partition twice at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _distinct(batches, params.length):
            yield pa.RecordBatch.from_arrays([pa.array(_short(keys)) if keys else pa.array([], pa.int64()), pa.array(keys, pa.binary()), pa.array(texts, pa.binary())], names=["short", "key", "text"])

    return map_text(docs.select("text"), run, "short long, key binary, text binary")


def _regions(texts: DataFrame, candidates: DataFrame, length: int) -> DataFrame:
    """hash, hot, key, place, far, near, region, copied (1 if the text stands there more than once), for every distinct text and
    each of its candidates. Texts and candidates of a key meet in sorted order, a text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, places = None, {}, {}

        def flush(out: list[list]) -> None:
            for key, (text, times) in held.items():
                for packed, (value, hot) in places.items():
                    place, far, near = packed >> 16, packed >> 8 & 255, packed & 255
                    if place - far >= 0 and place - near + length <= len(text):
                        for column, x in zip(out, (value, hot, key, place, far, near, text[place - far : place - near + length], int(times > 1)), strict=True):
                            column.append(x)

        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for short, key, text, value, packed, hot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if short != now:
                    flush(out)
                    now, held, places = short, {}, {}
                if key is not None:
                    held[key] = (text, held.get(key, (text, 0))[1] + 1)
                elif held:
                    places[packed] = (value, hot)
            yield rows(out)
        out = [[] for _ in range(8)]
        flush(out)
        yield rows(out)

    def rows(out: list[list]) -> pa.RecordBatch:
        types = [pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["hash", "hot", "key", "place", "far", "near", "region", "copied"])

    none = F.lit(None)
    left = texts.select("short", "key", "text", none.cast("long").alias("hash"), none.cast("long").alias("packed"), none.cast("boolean").alias("hot"))
    right = candidates.select("short", none.cast("binary").alias("key"), none.cast("binary").alias("text"), "hash", "packed", "hot")
    both = left.unionByName(right).repartition("short").sortWithinPartitions("short", F.col("key").isNull())
    return map_text(both, run, "hash long, hot boolean, key binary, place long, far long, near long, region binary, copied long")


def _shard_spans(regions: DataFrame, params: SuffixParams) -> DataFrame:
    """key, start, end of matched strings, run together: rows come sorted by hash, and a shard is as many whole groups as
    have about shard_rows rows."""
    names = ["hash", "key", "place", "far", "near", "region", "copied"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in names]
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            start = 0
            for end in [*(np.flatnonzero(np.diff(batch.column(0).to_numpy())) + 1).tolist(), batch.num_rows]:
                if len(held[0]) >= params.shard_rows and held[0][-1] != columns[0][start]:
                    yield _shard(held, params)
                    held = [[] for _ in names]
                for own, new in zip(held, columns, strict=True):
                    own += new[start:end]
                start = end
        if held[0]:
            yield _shard(held, params)

    return map_text(regions.select(*names).repartition("hash").sortWithinPartitions("hash"), run, "key binary, start long, end long")


def _hot_spans(regions: DataFrame, params: SuffixParams) -> DataFrame:
    """The same for anchors too common for a shard: their strings are counted by digest over all shards, added up within each
    task first, and looked up again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                keys, place, far, regions, copied = (part.column(i) for i in range(5))
                data = np.frombuffer(b"".join(regions.to_pylist()), np.uint8)
                sizes = np.array([len(r) for r in regions.to_pylist()], dtype=np.int64)
                counts = sizes - params.length + 1
                row = np.repeat(np.arange(len(sizes)), counts)
                nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                at = (np.cumsum(sizes) - sizes)[row] + nth
                digest = [pa.array(gram_hashes(data, params.length, odd)[at].view(np.int64)) for odd in (_ODD, _OTHER_ODD)]
                start = pa.array((place.to_numpy() - far.to_numpy())[row] + nth)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), start, *digest, copied.take(pa.array(row))], names=["key", "start", "high", "low", "copied"])

    strings = map_text(regions.select("key", "place", "far", "region", "copied"), run, "key binary, start long, high long, low long, copied long")
    twice = stored(strings.groupBy("high", "low").agg(F.sum(F.col("copied") + 1).alias("n")).where("n > 1").select("high", "low"))
    return strings.where("copied = 0").join(few(twice), ["high", "low"], "left_semi").select("key", "start", (F.col("start") + params.length).alias("end"))


def _settle(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps, which it does when the driver's JVM collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(docs: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    """key (md5 of the text), spans: for each text that stands there once, what to cut from it: sorted, disjoint, maximal
    (start, end) byte ranges. Texts that stand there more often repeat as a whole and have no row."""
    spark = docs.sparkSession
    table = stored(_anchor_table(docs, params))
    counts = table.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    repeated = stored(counts.select("hash", (F.col("n") > params.hot_rows).alias("hot")))
    candidates = stored(table.join(repeated, "hash").select("short", "hash", "packed", "hot"))
    _settle(spark)
    regions = _regions(_text_table(docs, params), candidates, params.length)
    if repeated.where("hot").isEmpty():
        spans = _shard_spans(regions, params)
    else:
        regions = stored(regions)
        spans = _shard_spans(regions.where("not hot"), params).unionByName(_hot_spans(regions.where("hot"), params))
    spans = stored(spans)
    discard(table, repeated, candidates, regions)
    _settle(spark)
    return spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("found"))


def _merged(found: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for span in found:
        start, end = span["start"], span["end"]
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def cut_texts(docs: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    """By distinct text: key, kept (the bytes left), n_removed, n_spans, for texts that stand there once and lose something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                kept, removed, spans = [], [], []
                for text, found in zip(to_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                    cuts = _merged(found)
                    ends = [0, *(e for _, e in cuts)]
                    starts = [*(s for s, _ in cuts), len(text)]
                    kept.append(b"".join(text[e:s] for e, s in zip(ends, starts, strict=True)))
                    removed.append(len(text) - len(kept[-1]))
                    spans.append(len(cuts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], names=["key", "kept", "n_removed", "n_spans"])

    found = repeated_spans(docs, params)
    joined = _text_table(docs, params).select("key", "text").join(found, "key")
    return map_text(joined, run, "key binary, kept binary, n_removed long, n_spans long")


def dedup(docs: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256. A text that stands there more than once is removed
    wholly if it has length bytes, as one span. Null counts as empty; shorter texts keep everything; repeated rows and null ids
    are documents like any other; matches never cross documents; an empty table gives no rows."""
    light = cut_texts(docs, params).select("key", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", F.unhex(F.md5(text)).alias("key"), F.length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    many = rows.where(F.col("n_bytes") >= params.length).groupBy("key").agg(F.count("*").alias("n"), F.max("n_bytes").alias("all")).where("n > 1")
    copies = many.select("key", F.col("all").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    facts = light.unionByName(copies)
    zero = F.lit(0).cast("long")
    return rows.join(facts, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )


def cut_documents(docs: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    """docs with every repeated string cut from text and n_chars, where there is one, set to what is left; all rows stay. A
    character that a cut leaves in part goes. Texts that stand there more than once and have length bytes become empty. Null and
    shorter texts stay as they are, and so do other columns."""
    plain = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    key, kept = fresh(docs, "__key"), fresh(docs, "__text")
    keyed = docs.withColumn(key, F.unhex(F.md5(plain)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b.decode(errors="ignore") for b in to_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, kept])

    left = map_text(cut_texts(docs, params).select("key", "kept"), run, f"`{key}` binary, `{kept}` string")
    many = keyed.where(F.octet_length("text") >= params.length).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    facts = stored(left.unionByName(many.select(key, F.lit("").alias(kept))))
    _settle(docs.sparkSession)
    done = keyed.join(facts, key, "left").withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(kept).isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*(quoted(c) for c in docs.columns))
