"""SimHash near-dedup: fingerprints of word shingles, linked within a Hamming radius by BK-trees.

Fingerprints within r bits agree wholly on one of r + 1 blocks of bits, so each fingerprint goes to the shards of its r + 1
block values and all its links are found there. A shard builds one BK-tree (children keyed by their integer distance to the
parent) and its own members search it along the edges within the radius."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import discard, few, fresh, give_back, map_text, quoted, slices, stored, to_bytes
from quarry.llm.components import components, local_roots

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 with seed 42 of each run of size words, of the whole sequence if it is shorter, of nothing without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts hashes, the 64 bits that are set in over half of them; zero for an empty run. Bits are summed in
    byte lanes of 64-bit words, at most 255 words at a time."""
    out = np.zeros(len(counts), np.uint64)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    per = counts[filled]
    blocks = -(-per // 255)
    first = np.repeat(np.cumsum(per) - per, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    lanes = np.stack([np.add.reduceat((hashes >> np.uint64(k)) & _LANES, first) for k in range(8)], axis=1)
    sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8, 8).astype(np.int64), np.cumsum(blocks) - blocks, axis=0)
    bits = (2 * sums > per[:, None, None]).transpose(0, 2, 1)  # byte, then bit in it
    out[filled] = np.packbits(bits.astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs with fp (long, the fingerprint's 64 bits), in place of any column of that name; narrow. Null text has no words."""
    docs = docs.drop("fp")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, at):
                found = [np.array(shingle_hashes(t, shingle), np.uint64) for t in to_bytes(rows.column(at))]
                prints = majority_bits(np.concatenate([*found, np.zeros(0, np.uint64)]), np.array([len(f) for f in found], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(prints.view(np.int64))], names=[*rows.schema.names, "fp"])

    return map_text(docs, run, T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())]))


class BKTree:
    """A BK-tree over distinct 64-bit fingerprints, built and searched level by level for all members at once."""

    def __init__(self, prints: np.ndarray) -> None:
        n = len(prints)
        self.prints, self.node = prints, np.arange(n)
        parent, distance = np.full(n, -1), np.zeros(n, np.int64)
        rest, group = np.arange(1, n), np.zeros(max(n - 1, 0), np.int64)  # group: the node that each stands below
        while len(rest):
            d = np.bitwise_count(prints[rest] ^ prints[group]).astype(np.int64)
            key = group * 65 + d
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            head = np.concatenate([[True], key[1:] != key[:-1]])
            heads = rest[head]  # the first of each (parent, distance) becomes the child
            parent[heads], distance[heads] = key[head] // 65, key[head] % 65
            group = np.repeat(heads, np.diff(np.append(np.flatnonzero(head), len(rest))))[~head]
            rest = rest[~head]
        order = np.argsort(parent * 65 + distance, kind="stable")
        order = order[parent[order] >= 0]
        self.child, self.key = order, (parent * 65 + distance)[order]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, member number) of the pairs at most radius apart, in portions; members are found from the root along
        edges whose distance lies within radius of the query's distance to their upper end."""
        if not len(self.prints):
            return
        q, at = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        todo = [(q, at)]
        while todo:
            q, at = todo.pop()
            if len(q) > 1 << 15:  # depth first in portions, so that the frontier stays small
                todo += [(q[i : i + (1 << 14)], at[i : i + (1 << 14)]) for i in range(0, len(q), 1 << 14)]
                continue
            d = np.bitwise_count(queries[q] ^ self.prints[at]).astype(np.int64)
            if (hit := d <= radius).any():
                yield q[hit], at[hit]
            low = np.searchsorted(self.key, at * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.key, at * 65 + np.minimum(d + radius, 64), side="right")
            n = high - low
            if total := int(n.sum()):
                edge = np.arange(total) + np.repeat(low - np.cumsum(n) + n, n)
                todo.append((np.repeat(q, n), self.child[edge]))


def _masks(bits: int, parts: int) -> list[int]:
    """The set bits of a mask, split into parts masks of nearly equal size."""
    places = [k for k in range(64) if bits >> k & 1]
    return [sum(1 << k for k in places[len(places) * i // parts : len(places) * (i + 1) // parts]) for i in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _exploded(masks: list[int]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for m in masks)))


def shard_keys(prints: DataFrame, radius: int, hot: int) -> DataFrame:
    """fp, mask, value: any two fingerprints at most radius apart share a (mask, value). A value with over hot fingerprints is
    split by further blocks of its other bits, which its near pairs share in turn."""
    full = (1 << 64) - 1
    masks = _masks(full, radius + 1)
    keys = prints.select("fp", _exploded(masks).alias("k")).select("fp", "k.mask", "k.value")
    for _ in range(3):
        finer = {m: [m | x for x in _masks(full & ~m, radius + 1)] for m in masks if bin(full & ~m).count("1") > radius}
        crowded = stored(keys.groupBy("mask", "value").count().where(F.col("count") > hot).drop("count"))
        if not finer or crowded.isEmpty():
            break
        kept = keys.join(crowded, ["mask", "value"], "left_anti").select("fp", "mask", "value")
        split = keys.join(crowded, ["mask", "value"], "left_semi")
        pieces = [split.where(F.col("mask") == _signed(m)).select("fp", _exploded(x).alias("k")).select("fp", "k.mask", "k.value") for m, x in finer.items()]
        for piece in pieces:
            kept = kept.unionByName(piece)
        keys, masks = kept, [x for more in finer.values() for x in more]
    return keys


def link(prints: DataFrame, radius: int = 2, shard_rows: int = 1 << 15) -> DataFrame:
    """prints: distinct fp. Gives edges a, b of a forest in which fingerprints are connected as by all links within radius."""
    keys = shard_keys(prints, radius, shard_rows)
    shards = max(1, -(-prints.count() * (radius + 1) // shard_rows))

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        members = np.unique(shard["fp"].to_numpy().view(np.uint64))
        tree, root = BKTree(members), None
        for start in range(0, len(members), 4096):
            for q, at in tree.within(members[start : start + 4096], radius):
                q = q + start
                root = local_roots(len(members), q[q > at], at[q > at], root)
        if root is None:
            root = np.arange(len(members))
        own = np.flatnonzero(root != np.arange(len(members)))
        give_back()
        return pd.DataFrame({"a": members[own].view(np.int64), "b": members[root[own]].view(np.int64)})

    sharded = keys.select("fp", F.pmod(F.xxhash64("mask", "value"), F.lit(shards)).alias("shard"))
    return sharded.repartition(min(shards, 8192), "shard").groupBy("shard").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach. Texts
    without words (null ones too) have fingerprint zero, which links like any other; repeated rows each get a row; a null id
    never names a component that has another, and an empty table gives no rows. Links are looked for between the distinct
    fingerprints only, so copies cost nothing more."""
    kept = stored(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"))
    classes = stored(kept.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(link(classes.select("fp"), radius))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = stored(named.groupBy("root").agg(F.min("first").alias("component_id")))
    ids = stored(named.join(few(least), "root").select("fp", "component_id"))
    discard(classes, least)
    return kept.join(few(ids), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class Shingler:
    """Hashes of the runs of size words of many texts at once: each distinct word is hashed once, and runs are mixed from their
    words' hashes in numpy. A text with fewer words has one run, a text without words none."""

    def __init__(self, size: int) -> None:
        self.size, self.known = size, {}

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' hashes end to end, repeats included, and how many each has."""
        split = [t.translate(_LOWER).split() for t in texts]
        flat = list(chain.from_iterable(split))
        if len(self.known) > 1 << 20:
            self.known.clear()
        self.known.update((w, xxhash.xxh64_intdigest(w, 42)) for w in set(flat).difference(self.known))
        words = np.fromiter(map(self.known.__getitem__, flat), dtype=np.uint64, count=len(flat))
        counts = np.array([len(s) for s in split], dtype=np.int64)
        begins = np.cumsum(counts) - counts
        runs = np.maximum(counts - self.size + 1, np.minimum(counts, 1))
        mixed = words[: max(0, len(words) - self.size + 1)]
        for k in range(1, self.size):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[0] + words[k : len(mixed) + k]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[1]
        mixed ^= mixed >> np.uint64(31)
        at = np.arange(runs.sum()) + np.repeat(begins - np.cumsum(runs) + runs, runs)
        short = np.flatnonzero((counts > 0) & (counts < self.size))
        out = np.concatenate([mixed, np.zeros(self.size, np.uint64)])[np.minimum(at, len(mixed))]
        out[(np.cumsum(runs) - 1)[short]] = np.array([xxhash.xxh64_intdigest(b" ".join(split[i]), 43) for i in short.tolist()], np.uint64)
        return out, runs


def distinct(hashes: np.ndarray, counts: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each run of counts hashes without repeats, in order of hash, or of last (by hash value the same) and then hash."""
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, text) if last is None else (hashes, last, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=len(counts))


def _blobs(hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    ends = np.cumsum(counts)
    return [hashes[e - n : e].astype("<u8").tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def _shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """rows (place, text) with the text's distinct shingles, as 64-bit hashes in order, packed into the column shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for batch in batches:
            for part in slices(batch, 1):
                packed = _blobs(*distinct(*shingles(to_bytes(part.column(1)))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["place", "shingles"])

    return map_text(rows.select("place", "text"), run, "place long, shingles binary")


def prefixes(hashes: np.ndarray, counts: np.ndarray, common: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sets in runs of counts hashes, in an order that puts common ones (sorted by value; rank: their order) last, with their
    sizes, then the first hashes of each set, with their numbers. Sets whose Jaccard similarity is at least that share one
    of those, whatever the order, as more than the rest of either is shared."""
    last = np.zeros(len(hashes), np.int32)
    if len(common) and len(hashes):
        at = np.minimum(np.searchsorted(common["hash"], hashes), len(common) - 1)
        last = np.where(common["hash"][at] == hashes, common["rank"][at] + 1, 0)
    hashes, counts = distinct(hashes, counts, last)
    firsts = np.where(counts > 0, counts - np.ceil(least * counts - 1e-9).astype(np.int64) + 1, 0)
    nth = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    return hashes, counts, hashes[nth < np.repeat(firsts, counts)], firsts


def _common(texts: DataFrame, size: int, total: int, most: int = 1 << 18) -> np.ndarray:
    """Shingles that a sixteenth of the texts (more of a small table) hold most often. They set an order only: none is left out."""
    share = max(1 / 16, min(1.0, 4096 / max(total, 1)))
    sample = texts.where(F.pmod(F.xxhash64("text", F.lit(31)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for batch in batches:
            for part in slices(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array(distinct(*shingles(to_bytes(part.column(0))))[0].view(np.int64))], names=["token"])

    often = map_text(sample.select("text"), run, "token long").groupBy("token").count().where("count >= 4")
    found = often.orderBy(F.desc("count"), "token").limit(most).toArrow().column("token").to_numpy().view(np.uint64)
    common = np.zeros(len(found), [("hash", "<u8"), ("rank", "<i4")])
    common["hash"], common["rank"] = found, np.arange(len(found))[::-1]
    return np.sort(common, order="hash")


def _sketches(texts: DataFrame, size: int, least: float, common: np.ndarray) -> DataFrame:
    """texts (row, doc_id, text): row, doc_id, n (distinct shingles), digest and parity of their set, fp (fingerprint), prefix."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for batch in batches:
            for part in slices(batch, 2):
                hashes, runs = shingles(to_bytes(part.column(2)))
                prints = majority_bits(hashes, runs)
                sets, counts, firsts, n = prefixes(hashes, runs, common, least)
                digests = pa.array([xxhash.xxh128_digest(x) for x in _blobs(sets, counts)], pa.binary())
                ends = np.cumsum(counts).tolist()
                parities = pa.array([parity(sets[a:b]) for a, b in zip([0, *ends], ends, strict=False)], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(firsts.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts, pa.int64()), digests, parities, pa.array(prints.view(np.int64)), lists],
                    names=["row", "doc_id", "n", "digest", "parity", "fp", "prefix"],
                )

    return map_text(texts.select("row", "doc_id", "text"), run, f"row long, doc_id {kind}, n long, digest binary, parity binary, fp long, prefix array<long>")


def nearest_prints(base: DataFrame, asked: DataFrame, radius: int, most: int = 4, shard_rows: int = 1 << 15) -> DataFrame:
    """base, asked: distinct fp. Gives asked, fp: fingerprints of base within radius of one asked, the nearest few of each shard
    (others are left to whoever asks). A shard's BK-tree holds its part of base."""
    both = base.select("fp", F.lit(1).alias("own"), F.lit(0).alias("ask")).unionByName(asked.select("fp", F.lit(0).alias("own"), F.lit(1).alias("ask")))
    both = stored(both.groupBy("fp").agg(F.max("own").alias("own"), F.max("ask").alias("ask")))
    keys = shard_keys(both, radius, shard_rows)
    shards = max(1, -(-both.count() * (radius + 1) // shard_rows))

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.drop_duplicates("fp")
        prints = shard["fp"].to_numpy().view(np.uint64)
        members, queries = prints[shard["own"].to_numpy() == 1], prints[shard["ask"].to_numpy() == 1]
        tree, found = BKTree(members), [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for start in range(0, len(queries), 4096):
            hits = list(tree.within(part := queries[start : start + 4096], radius))
            if not hits:
                continue
            q, at = (np.concatenate(x) for x in zip(*hits, strict=True))
            apart = np.bitwise_count(part[q] ^ members[at])
            order = np.lexsort((members[at], apart, q))
            q, at = q[order], at[order]
            heads = np.flatnonzero(np.diff(q, prepend=-1))
            near = np.arange(len(q)) - np.repeat(heads, np.diff(np.append(heads, len(q)))) < most
            found.append((part[q[near]], members[at[near]]))
        give_back()
        return pd.DataFrame({n: np.concatenate(x).view(np.int64) for n, x in zip(("asked", "fp"), zip(*found, strict=True), strict=True)})

    sharded = keys.join(few(both), "fp").select("fp", "own", "ask", F.pmod(F.xxhash64("mask", "value"), F.lit(shards)).alias("shard"))
    done = stored(sharded.repartition(min(shards, 8192), "shard").groupBy("shard").applyInPandas(run, "asked long, fp long").distinct())
    discard(both)
    return done


def parity(hashes: np.ndarray) -> bytes:
    """For a set of hashes, whether an odd number of them ends in each of as many bit patterns as the set is large, or more."""
    bits = 1 << max(6, int(len(hashes)).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(a: list[bytes], b: list[bytes], n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of n and m hashes can have the similarity by their sizes and their parities a and b. Each hash that one of two sets lacks
    changes one parity, so no fewer differ in hashes than in parities; similar sets differ in (n + m) (1 - least) / (1 + least)
    hashes at most. The longer parity is folded to the length of the shorter one."""
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    apart = np.zeros(len(a), np.int64)
    for key in np.unique(size_a << 32 | size_b).tolist():
        own = np.flatnonzero((size_a == key >> 32) & (size_b == key & 0xFFFFFFFF))
        sides = [np.frombuffer(b"".join(x[i] for i in own.tolist()), "<u8").reshape(len(own), -1) for x in (a, b)]
        wide = min(x.shape[1] for x in sides)
        while max(x.shape[1] for x in sides) > wide:
            sides = [x if x.shape[1] == wide else x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :] for x in sides]
        apart[own] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1)
    sized = np.minimum(n, m) + 1e-9 >= least * np.maximum(n, m)
    return sized & (apart <= (n + m) * (1 - least) / (1 + least) + 1e-9)


def _possible(pairs: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """The pairs (place, first) that may_be_similar() by marks (place, n, parity): a small fraction of the sets' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            fit = may_be_similar(to_bytes(batch.column(4)), to_bytes(batch.column(5)), n, m, least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["place", "first"]).filter(pa.array(fit, pa.bool_()))

    other = marks.select(F.col("place").alias("first"), F.col("n").alias("m"), F.col("parity").alias("other"))
    both = pairs.join(marks, "place").join(other, "first").select("place", "first", "n", "m", "parity", "other")
    return map_text(both, run, "place long, first long")


def _similar(pairs: DataFrame, texts: DataFrame, reps: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (place, first) of places in reps (place, row, n, parity) whose texts (row, text) have at least that Jaccard
    similarity; stored."""
    pairs = stored(_possible(pairs, reps.select("place", "n", "parity"), least))
    own = stored(pairs.select("place").union(pairs.select("first")).distinct().join(few(reps.select("place", "row")), "place"))
    sets = stored(_shingle_sets(texts.join(few(own), "row"), size))
    both = pairs.join(sets, "place").join(sets.select(F.col("place").alias("first"), F.col("shingles").alias("other")), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for a, b in zip(to_bytes(batch.column(2)), to_bytes(batch.column(3)), strict=True):
                shared = len(np.intersect1d(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), assume_unique=True))
                alike.append(shared + 1e-9 >= least * ((len(a) + len(b)) // 8 - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["place", "first"]).filter(pa.array(alike, pa.bool_()))

    done = stored(map_text(both.select("place", "first", "shingles", "other"), run, "place long, first long"))
    discard(pairs, own, sets)
    return done


def _sized(a: Column, b: Column, least: float) -> Column:
    """Whether sets of a and b shingles can be that similar."""
    return F.least(a, b) + 1e-9 >= least * F.greatest(a, b)


def _later(edges: DataFrame) -> DataFrame:
    """edges (place, first: similar, first before place; stored): the places that go if each, in order, goes when similar to one
    that stayed before it. In a round, those that nothing left comes before stay and what is similar to them goes."""
    gone = []
    while not edges.isEmpty():
        sure = stored(edges.select(F.col("first").alias("stays")).distinct().join(edges.select(F.col("place").alias("stays")).distinct(), "stays", "left_anti"))
        out = stored(edges.join(few(sure).withColumnRenamed("stays", "first"), "first", "left_semi").select("place").distinct())
        settled = few(stored(sure.select("stays").union(out.select("place"))))
        rest = edges.join(settled.withColumnRenamed("stays", "first"), "first", "left_anti").join(settled.withColumnRenamed("stays", "place"), "place", "left_anti")
        rest = stored(rest.select("place", "first"))
        discard(edges, sure)
        gone.append(out)
        edges = rest
    return reduce(DataFrame.union, gone)


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 3, crowd: int = 64) -> DataFrame:
    """The rows of docs without near copies, all columns kept: in order of doc_id (nulls last), a row goes if its word shingles
    have at least the similarity with those of a row that stays. So no two such rows are left, and each row gone has one.

    Equal sets of shingles count as one. Candidates come from the fingerprints first: rows near one that is sure to stay are
    found in BK-trees, compared in full, and go. Similarity of 0.8 can differ in more bits than any radius bears, so what is
    left is looked at exactly: sets that are similar share a shingle of their prefixes, and all pairs that do are compared.
    A row is sure to stay if no earlier one shares such a shingle. While a row meets more than crowd others per shingle on
    average, rows are compared with those sure to stay only, and what is similar goes: a large group takes work in proportion.
    All pairs of a shingle's remaining rows are compared then. Texts without words are one group; repeated rows are copies; an empty table gives no rows."""
    mark = fresh(docs, "__row")
    numbered = stored(docs.withColumn(mark, F.monotonically_increasing_id()))
    texts = numbered.select(F.col(mark).alias("row"), "doc_id", "text")
    found = stored(_sketches(texts, shingle, similarity, _common(texts, shingle, numbered.count())))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    reps = stored(found.select("digest", order.alias("place")).groupBy("digest").agg(F.min("place").alias("place")).orderBy("place").select(F.col("place.row").alias("row"), F.monotonically_increasing_id().alias("place")))
    reps = stored(found.select("row", "n", "fp", "parity").join(few(reps), "row"))
    gone = [stored(found.select("row").join(few(reps.select("row")), "row", "left_anti"))]  # rows from here on, places until then
    out: list[DataFrame] = []

    posts = found.select("row", "prefix").join(few(reps.select("row", "place", "n")), "row").select("place", "n", F.explode("prefix").alias("token"))
    sizes = reps.select(F.col("place").alias("head"), F.col("n").alias("m"))
    shared = posts.groupBy("token").agg(F.min("place").alias("head"), F.count("*").alias("held")).where("held > 1")
    live = stored(posts.join(shared, "token").select("token", "place", "n", "head", "held"))
    discard(found)

    def settled(live: DataFrame, places: DataFrame) -> DataFrame:
        """live without the places, and without shingles that one row is left of."""
        left = live.join(few(stored(places.distinct())), "place", "left_anti").select("token", "place", "n")
        again = left.groupBy("token").agg(F.min("place").alias("head"), F.count("*").alias("held")).where("held > 1")
        rest = stored(left.join(again, "token").select("token", "place", "n", "head", "held"))
        discard(live)
        return rest

    def ahead(live: DataFrame) -> DataFrame:
        """The places that no earlier one shares a shingle with."""
        return stored(live.groupBy("place").agg(F.min(F.col("place") == F.col("head")).alias("sure")).where("sure").select("place"))

    sure = ahead(live)
    marked = stored(live.select("place").distinct().join(few(reps.select("place", "fp")), "place"))
    base = marked.join(few(sure), "place", "left_semi").groupBy("fp").agg(F.min("place").alias("first"))
    asked = marked.join(few(sure), "place", "left_anti")
    near = nearest_prints(base.select("fp"), asked.select("fp").distinct(), radius)
    pairs = asked.withColumnRenamed("fp", "asked").join(near, "asked").join(base, "fp").where(F.col("place") > F.col("first")).select("place", "first")
    judged = _similar(pairs, texts, reps, shingle, similarity)
    out.append(judged.select("place").distinct())
    live = settled(live, out[-1])
    discard(sure, marked, near)

    before, idle = None, 0
    while True:
        held = live.where(F.col("place") == F.col("head")).agg(F.sum("held"), F.sum(F.col("held") * F.col("held"))).first()
        idle = idle + 1 if before is not None and held[1] > 0.75 * before else 0
        if not held[0] or held[1] <= crowd * held[0] or idle > 3:  # where comparing with heads does not help, all pairs are compared
            break
        before = min(held[1], before or held[1])
        sure = ahead(live)
        pairs = live.join(few(sure.withColumnRenamed("place", "head")), "head", "left_semi").where(F.col("place") != F.col("head")).select("place", "n", "head").distinct()
        pairs = pairs.join(few(sizes), "head").where(_sized(F.col("n"), F.col("m"), similarity)).select("place", F.col("head").alias("first"))
        judged = _similar(pairs, texts, reps, shingle, similarity)
        out.append(judged.select("place").distinct())
        live = settled(live, sure.union(out[-1]))
        discard(sure)
    other = live.select("token", F.col("place").alias("first"), F.col("n").alias("m"))
    pairs = live.join(other, "token").where((F.col("place") > F.col("first")) & _sized(F.col("n"), F.col("m"), similarity))
    edges = _similar(pairs.select("place", "first").distinct(), texts, reps, shingle, similarity)
    if not edges.isEmpty():
        out.append(_later(edges))
    places = stored(reduce(DataFrame.union, out).distinct())
    rows = places.join(few(reps.select("place", "row")), "place").select("row")
    done = stored(reduce(DataFrame.union, [*gone, rows]).withColumnRenamed("row", mark))
    discard(live, reps, *gone)
    return numbered.join(few(done), mark, "left_anti").select(*(quoted(c) for c in docs.columns))
