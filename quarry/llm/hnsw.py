"""Embedding near-dedup: a hierarchical navigable small-world graph per shard of a label; every shard of the label is queried,
beams widen until audits against all of the shard pass, cosines are verified in double precision, and links make components.

Links leave a task as counts and a spanning forest, a row per vector, so a dense group of n vectors gives n rows, not n * n."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.ann import usable
from quarry.llm.common import discard, few, stored
from quarry.llm.components import components, local_roots


@dataclass(frozen=True)
class HnswParams:
    """cosine: least of a link. shard_rows: distinct vectors of a shard. degree: edges of a node (twice as many on the lowest
    layer). build_beam, beam: of insertion and the first search. audit: queries compared with all of a shard at a time, until
    they have audit_links links or none is left; recall: the share of those that the search must have found, else the beam
    doubles."""

    cosine: float = 0.93
    shard_rows: int = 4096
    degree: int = 12
    build_beam: int = 48
    beam: int = 48
    audit: int = 256
    audit_links: int = 128
    recall: float = 0.995
    seed: int = 11


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))).astype(np.float32)


class Graph:
    """Nodes stand in order of their level, highest first, so layer l is the first sizes[l] nodes. Insertion goes in batches,
    whose nodes see the graph before them and each other."""

    def __init__(self, units: np.ndarray, params: HnswParams) -> None:
        self.units, self.params = units, params
        n = len(units)
        levels = np.sort(np.floor(-np.log(1 - np.random.default_rng(params.seed).random(n)) / np.log(params.degree)).astype(int))[::-1]
        self.sizes = [int((levels >= level).sum()) for level in range(levels[0] + 1)] if n else []
        self.edges = [np.full((size, params.degree * (2 if level == 0 else 1)), -1, np.int32) for level, size in enumerate(self.sizes)]
        start = 0
        while start < n:
            end = min(n, start + min(512, max(32, start // 2)))
            self._insert(start, end)
            start = end

    def _insert(self, start: int, end: int) -> None:
        new = np.arange(start, end)
        queries = self.units[new]
        among = queries @ queries.T
        np.fill_diagonal(among, -np.inf)
        entry = np.zeros((len(new), 1), np.int32)
        for level in range(len(self.sizes) - 1, -1, -1):
            beam = self.params.build_beam if level == 0 else 8
            if start:
                ids, sims = self.search_layer(queries, entry, level, beam)
                entry = ids[:, :4] if level == 0 else ids[:, :1]
            else:
                ids, sims = np.full((len(new), 1), -1, np.int32), np.full((len(new), 1), -np.inf, np.float32)
            inside = int(min(end, self.sizes[level]) - start)  # new nodes of this layer
            if inside <= 0:
                continue
            close = among[:inside, :inside]
            near = np.argsort(-close, axis=1)[:, :16]
            ids = np.concatenate([ids[:inside], (new[near]).astype(np.int32)], axis=1)
            sims = np.concatenate([sims[:inside], np.take_along_axis(close, near, axis=1)], axis=1)
            ids = np.where(np.isfinite(sims), ids, -1)
            chosen = self._choose(ids, sims, self.params.degree)
            self.edges[level][new[:inside], : chosen.shape[1]] = chosen
            self._link_back(level, new[:inside], chosen)

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """The nearest that aren't nearer to one chosen before than to the node itself, filled up with the nearest others."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        among = np.einsum("qcd,qed->qce", self.units[ids], self.units[ids], optimize=True)
        kept = np.zeros(ids.shape, dtype=bool)
        for c in range(ids.shape[1]):
            blocked = ((among[:, c] > sims[:, c, None]) & kept).any(axis=1)
            kept[:, c] = (ids[:, c] >= 0) & ~blocked
        rank = np.argsort(np.where(kept, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, rank, axis=1)

    def _link_back(self, level: int, sources: np.ndarray, chosen: np.ndarray) -> None:
        edges = self.edges[level]
        source, slot = np.nonzero(chosen >= 0)
        target = chosen[source, slot]
        by = np.argsort(target, kind="stable")
        target, source = target[by], sources[source[by]]
        heads = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, int)
        counts = np.diff(np.append(heads, len(target)))
        nth = np.arange(len(target)) - np.repeat(heads, counts)
        wide = 16
        added = np.full((len(heads), wide), -1, np.int32)
        row = np.repeat(np.arange(len(heads)), counts)
        added[row[nth < wide], nth[nth < wide]] = source[nth < wide]
        for lo in range(0, len(heads), 1024):
            nodes = target[heads[lo : lo + 1024]]
            ids = np.concatenate([edges[nodes], added[lo : lo + 1024]], axis=1)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.where(ids >= 0, np.einsum("qcd,qd->qc", self.units[ids], self.units[nodes], optimize=True), -np.inf)
            edges[nodes] = self._choose(ids, sims, edges.shape[1])

    def search_layer(self, queries: np.ndarray, entry: np.ndarray, level: int, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Best-first beam search for all queries at once; each step opens the best width unopened nodes of each beam."""
        n, edges = self.sizes[level], self.edges[level]
        beam = min(beam, n)
        count = len(queries)
        visited = np.zeros((count, n), dtype=bool)
        ids, sims = np.full((count, beam), -1, np.int32), np.full((count, beam), -np.inf, np.float32)
        opened = np.zeros((count, beam), dtype=bool)
        fresh = np.unique(np.repeat(np.arange(count), entry.shape[1])[entry.ravel() >= 0] * n + entry.ravel()[entry.ravel() >= 0])
        while len(fresh):
            row, node = fresh // n, fresh % n
            visited[row, node] = True
            found = np.einsum("ij,ij->i", self.units[node], queries[row])
            rows, first, per = np.unique(row, return_index=True, return_counts=True)
            nth = np.arange(len(row)) - np.repeat(first, per)
            more_ids = np.full((len(rows), per.max()), -1, np.int32)
            more_sims = np.full((len(rows), per.max()), -np.inf, np.float32)
            at = np.repeat(np.arange(len(rows)), per)
            more_ids[at, nth], more_sims[at, nth] = node, found
            all_sims = np.concatenate([sims[rows], more_sims], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            sims[rows] = np.take_along_axis(all_sims, order, axis=1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], more_ids], axis=1), order, axis=1)
            opened[rows] = np.take_along_axis(np.concatenate([opened[rows], np.zeros(more_ids.shape, dtype=bool)], axis=1), order, axis=1)
            waiting = ~opened & (ids >= 0)
            pick = waiting & (np.cumsum(waiting, axis=1) <= width)
            opened |= pick
            row, slot = np.nonzero(pick)
            nodes = edges[ids[row, slot]]
            row, nodes = np.repeat(row, nodes.shape[1]), nodes.ravel()
            good = nodes >= 0
            row, nodes = row[good], nodes[good]
            new = ~visited[row, nodes]
            fresh = np.unique(row[new] * n + nodes[new])
        return ids, sims

    def within(self, queries: np.ndarray, least: float, beam: int, own: np.ndarray | None) -> np.ndarray:
        """hits[query, node]: similarities of least or more that are found. own: nodes to start from besides the upper layers'
        best. A query whose whole beam is that near stands in a dense group and is compared with all nodes."""
        hits = np.zeros((len(queries), self.sizes[0]), dtype=bool)
        for lo in range(0, len(queries), 512):
            part = queries[lo : lo + 512]
            entry = np.zeros((len(part), 1), np.int32)
            for level in range(len(self.sizes) - 1, 0, -1):
                entry = self.search_layer(part, entry, level, 4)[0][:, :1]
            if own is not None:
                entry = np.concatenate([entry, own[lo : lo + 512, None]], axis=1)
            ids, sims = self.search_layer(part, entry, 0, beam)
            row, slot = np.nonzero(sims >= least)
            hits[lo + row, ids[row, slot]] = True
            if len(full := np.flatnonzero(sims[:, -1] >= least)):
                hits[lo + full] = part[full] @ self.units.T >= least
        return hits


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _points(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and times of a shard."""
    held = np.load(io.BytesIO(blob))
    return held["ids"], held["vectors"].astype(np.float64), held["times"]


def _graph(blob: bytes, vectors: np.ndarray, params: HnswParams) -> Graph:
    held = np.load(io.BytesIO(blob))
    graph = Graph.__new__(Graph)
    graph.units, graph.params = _unit(vectors), params
    graph.edges = [held[f"edges{level}"] for level in range(len(held.files))]
    graph.sizes = [len(e) for e in graph.edges]
    return graph


def linked(vectors: np.ndarray, graph: Graph, queries: np.ndarray | None, params: HnswParams) -> np.ndarray:
    """hits[query, node]: links between queries (None: the graph's own vectors) and the vectors of a graph, verified in double
    precision; never of a node with itself.

    Audited: queries in random order are compared with all nodes until they have audit_links links, or all are compared. Unless
    the search has found enough of those, the beam doubles. What the audit saw counts as found."""
    same = queries is None
    queries = vectors if same else queries
    units, near = _unit(queries), params.cosine - 1e-4  # float32 candidates
    spread, truth, seen = np.random.default_rng(params.seed).permutation(len(units)), [], 0
    while len(truth) * params.audit < len(units) and seen < params.audit_links:
        block = spread[len(truth) * params.audit : (len(truth) + 1) * params.audit]
        truth.append(units[block] @ graph.units.T >= near)
        seen += int(truth[-1].sum()) - same * len(block)
    spot = spread[: len(truth) * params.audit]
    true, beam = np.concatenate(truth), params.beam
    while True:
        hits = graph.within(units, near, beam, np.arange(len(vectors), dtype=np.int32) if same else None)
        if len(spot) == len(units) or beam >= len(vectors) or (hits[spot] & true).sum() >= params.recall * true.sum():
            break
        beam *= 2
    hits[spot] |= true
    if same:
        np.fill_diagonal(hits, False)
        hits |= hits.T
    for lo in range(0, len(units), 256):
        q, a = np.nonzero(hits[lo : lo + 256])
        for at in range(0, len(q), 1 << 16):
            row, node = q[at : at + (1 << 16)] + lo, a[at : at + (1 << 16)]
            open_ = np.einsum("ij,ij->i", units[row], graph.units[node]) < params.cosine + 1e-4
            row, node = row[open_], node[open_]
            x, y = queries[row], vectors[node]
            cosine = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            hits[row, node] = cosine >= params.cosine
    return hits


def summed(hits: np.ndarray, ids: np.ndarray, times: np.ndarray, others: np.ndarray | None, other_times: np.ndarray | None) -> pd.DataFrame:
    """cid, more, root for each vector with a link: the rows it is linked to, and the first vector that links reach from it.
    others: ids of the queries, if they aren't the ids themselves."""
    n = len(ids)
    names, weight, shift = (ids, times, 0) if others is None else (np.concatenate([ids, others]), np.concatenate([times, other_times]), n)
    more, root = np.zeros(len(names), np.int64), np.arange(len(names))
    for lo in range(0, len(hits), 256):
        block = hits[lo : lo + 256]
        rows = slice(shift + lo, shift + lo + len(block))
        more[rows] += np.rint(block @ times.astype(np.float64)).astype(np.int64)
        if others is not None:
            more[:n] += np.rint(weight[rows].astype(np.float64) @ block).astype(np.int64)
        q, a = np.nonzero(block)
        root = local_roots(len(names), q + shift + lo, a, root)
    own = np.flatnonzero(more)
    return pd.DataFrame({"cid": names[own], "more": more[own], "root": names[root[own]]})


def links(classes: DataFrame, params: HnswParams) -> DataFrame:
    """classes: label, size, cid, vector, times. Gives cid, more, root, from every pair of shards of a label and size: rows
    that the vector is linked to there, and one that links reach from it."""
    counts = classes.groupBy("label", "size").agg(F.ceil(F.count("*") / params.shard_rows).alias("shards"))
    dealt = classes.join(F.broadcast(counts), ["label", "size"]).withColumn("shard", F.pmod(F.xxhash64("cid"), F.col("shards")))  # a row per label

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cid")
        vectors = np.stack(rows["vector"].to_list()).astype(np.float64)
        graph = Graph(_unit(vectors), params)
        single = vectors.astype(np.float32)
        points = _pack(ids=rows["cid"].to_numpy(), vectors=single if (single == vectors).all() else vectors, times=rows["times"].to_numpy())
        edges = _pack(**{f"edges{level}": e for level, e in enumerate(graph.edges)})
        return pd.DataFrame({"label": rows["label"].iloc[:1], "size": rows["size"].iloc[:1], "shard": rows["shard"].iloc[:1], "points": [points], "edges": [edges]})

    kind = classes.schema["label"].dataType.simpleString()
    graphs = stored(dealt.groupBy("label", "size", "shard").applyInPandas(build, f"label {kind}, size int, shard long, points binary, edges binary"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for points, edges, queries in zip(rows["points"], rows["edges"], rows["queries"], strict=True):
            ids, vectors, times = _points(points)
            others, asked, other_times = _points(queries) if queries is not None else (None, None, None)
            found.append(summed(linked(vectors, _graph(edges, vectors, params), asked, params), ids, times, others, other_times))
        return pd.concat(found)

    right = graphs.select("label", "size", F.col("shard").alias("other"), F.col("points").alias("queries"))
    pairs = graphs.join(right.where("other > 0"), ["label", "size"]).where(F.col("shard") < F.col("other"))
    own = graphs.withColumn("other", F.col("shard")).withColumn("queries", F.lit(None).cast("binary"))
    done = stored(own.unionByName(pairs).groupBy("label", "size", "shard", "other").applyInPandas(search, "cid long, more long, root long"))
    discard(graphs)
    return done


def near_duplicates(vectors: DataFrame, params: HnswParams = HnswParams()) -> DataFrame:
    """One row per vector: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept (it is
    that one). Only rows of equal, non-null label and equal length link. Null ids or labels, and vectors that are null, empty,
    zero or hold null or non-finite components link with nothing and keep their own id (kept is false without an id). Equal
    vectors of a label are one class in the graph, counted as often as they stand there; an empty table gives no rows."""
    fit = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("vector"), fit.alias("fit"))
    classes = rows.where("fit").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"))
    classes = stored(classes.withColumn("size", F.size("vector")).withColumn("cid", F.monotonically_increasing_id()))
    found = links(classes.select("label", "size", "cid", "vector", "times"), params)
    degree = found.groupBy("cid").agg(F.sum("more").alias("more"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    named = classes.select("cid", "least", "times").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = stored(named.join(degree, "cid", "left").select("cid", "least", "root", (F.col("times") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")))
    first = stored(named.groupBy("root").agg(F.min("least").alias("component_id")))
    facts = stored(named.join(few(first), "root").select("cid", "n_links", "component_id"))
    discard(found, named, first)
    facts = classes.select("label", "vector", "cid").join(few(facts), "cid").drop("cid")
    inside = rows.where("fit").join(facts, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    outside = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.unionByName(outside).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def sql(params: HnswParams = HnswParams()) -> str:
    """DuckDB SQL for near_duplicates() with all links found: every audit compares small labels whole."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
fit AS MATERIALIZED (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM fit a JOIN fit b ON a.label = b.label AND len(a.e) = len(b.e) WHERE a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= {params.cosine}),
reach AS (SELECT r AS a, r AS b FROM fit UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT reach.a, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY 1),
found AS (SELECT v.vec_id, coalesce((SELECT count(*) FROM links WHERE links.a = v.r), 0) AS n_links, coalesce(component_id, v.vec_id) AS component_id FROM v LEFT JOIN least ON least.a = v.r)
SELECT vec_id, n_links, component_id, coalesce(vec_id = component_id, FALSE) AS kept FROM found"""
