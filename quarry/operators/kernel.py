"""Joins of table occurrences, and the counts that rules are scored by.

Row counts keep multiplicity. Key counts are distinct, so inputs are made distinct first, and in a join tree every occurrence
that holds no key becomes a semi-join, leaf by leaf, so self-joins over common values never multiply rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import combinations, permutations, product

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.joingraph import Alias, Cell, Edge, aliases
from quarry.sources.catalog import Catalog, Constraints, canon

#: Counts that go into one job (more make its plan slow to prepare), and jobs that are prepared and run side by side.
BATCH, JOBS = 12, 4


def name(cell: Cell) -> str:
    return f"{cell.table}_{cell.occurrence}__{cell.column}"


def cells(edges: Iterable[Edge]) -> set[Cell]:
    return {c for e in edges for c in (e.left, e.right)}


def _kind(catalog: Catalog, cell: Cell):
    if cell.column not in catalog[cell.table].columns:
        raise KeyError(f"no column {cell.column} in {cell.table}")
    return catalog[cell.table].schema[cell.column].dataType


def equals(catalog: Catalog, a: Cell, b: Cell) -> Column:
    """Equality; columns of different types compare as text, so no cast can fail."""
    ka, kb = _kind(catalog, a), _kind(catalog, b)
    left, right = F.col(name(a)), F.col(name(b))
    numbers = {"tinyint", "smallint", "int", "bigint"}
    if ka == kb or {ka.simpleString(), kb.simpleString()} <= numbers:
        return left == right
    return canon(left, ka) == canon(right, kb)


def occurrence(catalog: Catalog, alias: Alias, needed: Iterable[Cell], edges: Iterable[Edge]) -> DataFrame:
    """The needed columns of an occurrence under names of their own, where equalities inside the row hold."""
    table, number = alias
    own = sorted({c for c in needed if c.alias == alias})
    for c in own:
        _kind(catalog, c)
    out = catalog[table].select(*(F.col(f"`{c.column}`").alias(name(c)) for c in own))
    inside = [equals(catalog, e.left, e.right) for e in sorted(edges) if e.aliases == {alias}]
    return out.where(reduce(Column.__and__, inside)) if inside else out


def walk(edges: Iterable[Edge]) -> list[tuple[Alias, list[Edge]]]:
    """Occurrences in an order in which each next one is joined to those before it, with the equalities to them."""
    left = sorted(e for e in edges if len(e.aliases) == 2)
    todo = sorted(aliases(edges))
    order: list[tuple[Alias, list[Edge]]] = [(todo.pop(0), [])] if todo else []
    done = {a for a, _ in order}
    while todo:
        step = next((a for a in todo if any(a in e.aliases and e.aliases & done for e in left)), None)
        if step is None:
            raise ValueError("the equalities leave occurrences unconnected")
        todo.remove(step)
        done.add(step)
        on = [e for e in left if step in e.aliases and e.aliases <= done]
        left = [e for e in left if e not in on]
        order.append((step, on))
    return order


def joined(catalog: Catalog, edges: Iterable[Edge], needed: Iterable[Cell] | None = None, distinct: bool = False, disjoint: bool = False) -> DataFrame:
    """The inner join of all occurrences. disjoint: occurrences of one table differ in every column of its primary key."""
    edges = set(edges)
    wanted = cells(edges) | set(needed or ())
    keys = catalog.constraints.primary
    if disjoint:
        wanted |= {Cell(t, o, c) for t, o in aliases(edges) for c in keys.get(t, ())}
    out: DataFrame | None = None
    done: list[Alias] = []
    for alias, on in walk(edges):
        part = occurrence(catalog, alias, wanted, edges)
        part = part.distinct() if distinct else part
        if out is None:
            out = part
        else:
            conditions = [equals(catalog, e.left, e.right) for e in on]
            if disjoint:
                twins = [a for a in done if a[0] == alias[0]]
                conditions += [F.col(name(Cell(*a, c))) != F.col(name(Cell(*alias, c))) for a in twins for c in keys.get(alias[0], ())]
            out = out.join(part, reduce(Column.__and__, conditions), "inner")
        done.append(alias)
    if out is None:
        raise ValueError("a join needs an equality")
    return out


def count_rows(catalog: Catalog, edges: Iterable[Edge], disjoint: bool = False) -> DataFrame:
    """One row, n: rows of the join. Its rows are never made: each occurrence is counted per value of its joined columns, and
    after each join what no equality to come needs is summed away. disjoint: occurrences of one table differ in every column of
    its primary key; joins with such columns equal are counted and taken off in turn (inclusion and exclusion)."""
    edges = set(edges)
    keys = catalog.constraints.primary
    own = sorted(aliases(edges))
    same = [Edge.of(Cell(*a, c), Cell(*b, c)) for a, b in combinations(own, 2) if disjoint and a[0] == b[0] for c in keys.get(a[0], ())]
    if len(same) > 6:
        return joined(catalog, edges, disjoint=True).agg(F.count("*").alias("n"))
    filled = cells(same)  # a null key differs from nothing
    signed = [_weighed(catalog, edges | set(part), filled).select((F.col("n") * (-1) ** size).alias("n")) for size in range(len(same) + 1) for part in combinations(same, size)]
    return reduce(DataFrame.unionAll, signed).agg(F.sum("n").alias("n"))


def _weighed(catalog: Catalog, edges: set[Edge], filled: set[Cell]) -> DataFrame:
    """One row, n: rows of the join in which the filled cells aren't null."""
    out: DataFrame | None = None
    todo = walk(edges)
    for at, (alias, on) in enumerate(todo):
        needed = cells(edges) | filled
        part = occurrence(catalog, alias, needed, edges)
        part = part.where(reduce(Column.__and__, (F.col(name(c)).isNotNull() for c in sorted(filled) if c.alias == alias), F.lit(True)))
        still = {c for later, es in todo[at + 1 :] for e in es for c in (e.left, e.right)}
        used = {c for e in on for c in (e.left, e.right) if c.alias == alias} | {c for c in still if c.alias == alias}
        part = part.where(reduce(Column.__and__, (F.col(name(c)).isNotNull() for c in sorted(used)), F.lit(True)))
        part = part.groupBy(*(name(c) for c in sorted(used))).agg(F.count("*").alias("weight" if out is None else "times"))
        if out is not None:
            part = out.join(part, reduce(Column.__and__, (equals(catalog, e.left, e.right) for e in on)), "inner")
            kept = [name(c) for c in sorted(still) if name(c) in part.columns]
            part = part.groupBy(*kept).agg(F.sum(F.col("weight") * F.col("times")).alias("weight"))
        out = part
    if out is None:
        raise ValueError("a join needs an equality")
    return out.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n"))


def exceeds(catalog: Catalog, edges: Iterable[Edge], threshold: int, disjoint: bool = False) -> DataFrame:
    """One row, passed: whether the join has more than threshold rows, which are counted and not made."""
    return count_rows(catalog, edges, disjoint).select((F.col("n") > threshold).alias("passed"))


def keys_of(catalog: Catalog, edges: Iterable[Edge], keys: Sequence[Cell], reduced: bool = True) -> DataFrame:
    """Distinct tuples of keys in the join."""
    edges, keys = set(edges), list(keys)
    if reduced and (fold := _tree(edges, {k.alias for k in keys})):
        out = _folded(catalog, edges, keys, *fold)
    else:
        out = joined(catalog, edges, keys, distinct=reduced)
    return out.select(*(F.col(name(k)) for k in keys)).distinct()


def count_keys(catalog: Catalog, edges: Iterable[Edge], keys: Sequence[Cell], reduced: bool = True) -> DataFrame:
    """One row, n: distinct tuples of keys in the join; tuples with nulls count."""
    return keys_of(catalog, edges, keys, reduced).agg(F.count("*").alias("n"))


def filled_keys(catalog: Catalog, edges: Iterable[Edge], keys: Sequence[Cell]) -> DataFrame:
    """Distinct tuples of keys without nulls, in the join or, without equalities, in their one occurrence: values that a rule's
    variables can take."""
    found = keys_of(catalog, edges, keys) if edges else occurrence(catalog, keys[0].alias, keys, ()).distinct()
    return found.dropna()


def _tree(edges: set[Edge], key_aliases: set[Alias]) -> tuple[list[Alias], dict[Alias, set[Alias]]] | None:
    """Leaves that hold no key in an order to take them off a join tree, with their neighbours; None if it has a cycle."""
    links: dict[Alias, set[Alias]] = {a: set() for a in aliases(edges)}
    for e in edges:
        if len(pair := sorted(e.aliases)) == 2:
            links[pair[0]].add(pair[1])
            links[pair[1]].add(pair[0])
    if sum(map(len, links.values())) != 2 * (len(links) - 1) or not key_aliases <= set(links):
        return None
    rest, order = {a: set(n) for a, n in links.items()}, []
    while leaf := next((a for a in sorted(rest) if len(rest[a]) == 1 and a not in key_aliases), None):
        order.append(leaf)
        for other in rest.pop(leaf):
            rest[other].discard(leaf)
    return order, links


def _folded(catalog: Catalog, edges: set[Edge], keys: list[Cell], leaves: list[Alias], links: dict[Alias, set[Alias]]) -> DataFrame:
    wanted = cells(edges) | set(keys)
    held = {a: occurrence(catalog, a, wanted, edges) for a in links}
    gone: set[Alias] = set()

    def condition(a: Alias, b: Alias) -> Column:
        return reduce(Column.__and__, (equals(catalog, e.left, e.right) for e in sorted(edges) if e.aliases == {a, b}))

    for leaf in leaves:
        other = next(iter(links[leaf] - gone))
        touching = sorted(name(c) for e in edges if e.aliases == {leaf, other} for c in (e.left, e.right) if c.alias == leaf)
        held[other] = held[other].join(held[leaf].select(*touching).distinct(), condition(leaf, other), "left_semi")
        gone.add(leaf)
    rest = sorted(set(links) - gone)
    still = cells(e for e in edges if len(e.aliases) == 2 and not e.aliases & gone) | set(keys)  # what the folded leaves needed is over
    for alias in rest:
        held[alias] = held[alias].select(*sorted(name(c) for c in still if c.alias == alias))
    out, done = held[rest[0]].distinct(), {rest[0]}
    while len(done) < len(rest):
        step = next(a for a in rest if a not in done and links[a] & done)
        other = next(iter(links[step] & done))
        out = out.join(held[step].distinct(), condition(step, other), "inner")
        done.add(step)
    return out


class Projection:
    """The distinct tuples of a table's columns as numbers, of which equal texts (of any type) have equal ones; -1 for null."""

    def __init__(self, columns: tuple[str, ...], rows: np.ndarray) -> None:
        self.columns, self.rows = columns, rows

    def of(self, columns: Sequence[str]) -> np.ndarray:
        return self.rows[:, [self.columns.index(c) for c in columns]]


def _different(rows: np.ndarray) -> np.ndarray:
    """The different rows."""
    if not rows.shape[1]:
        return rows[:1]
    if rows.shape[1] == 1:
        return np.unique(rows[:, 0])[:, None]
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])] if len(rows) else rows


def _meet(left: np.ndarray, right: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Row numbers of the pairs of equal rows; None if there are more than that."""
    if left.shape[1] == 1:
        a, b = left[:, 0], right[:, 0]
    else:
        number = np.unique(np.concatenate([left, right]), axis=0, return_inverse=True)[1].ravel()
        a, b = number[: len(left)], number[len(left) :]
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a), np.searchsorted(b[order], a, side="right")
    n = high - low
    if (total := int(n.sum())) > most:
        return None
    return np.repeat(np.arange(len(a)), n), order[np.arange(total) + np.repeat(low - np.cumsum(n) + n, n)]


class Counter:
    """Counts of key tuples, each asked once. Equal joins with equal keys are one question, also when they differ in occurrence
    numbers alone.

    Rule discovery asks thousands of questions about few projections. The distinct projection of each table on its joined columns
    is kept by Spark; one of at most local_rows tuples is also fetched, once, and questions about such alone are answered from
    them here, unless a join grows past meet_rows. All others are joins in Spark, many to a job."""

    def __init__(self, catalog: Catalog, local_rows: int = 1 << 16, meet_rows: int = 1 << 21) -> None:
        self.catalog, self.local_rows, self.meet_rows = catalog, local_rows, meet_rows
        self.known: dict[tuple, int] = {}
        self.asked = {"questions": 0, "repeated": 0, "here": 0, "jobs": 0}
        self._held: dict[str, Projection | None] = {}
        self._codes: dict[str, int] = {}
        self._kept: list[DataFrame] = []
        self._session = next(iter(catalog.tables.values())).sparkSession

    def prepare(self, used: Iterable[Cell]) -> Counter:
        """Keeps the distinct projections on the columns of these cells and fetches the small ones, tables side by side."""
        columns: dict[str, set[str]] = {}
        for c in used:
            _kind(self.catalog, c)
            columns.setdefault(c.table, set()).add(c.column)
        tables = dict(self.catalog.tables)
        for table, own in columns.items():
            tables[table] = self.catalog[table].select(*(F.col(f"`{c}`") for c in sorted(own))).distinct().persist()
            self._kept.append(tables[table])
        self.catalog = Catalog(tables, Constraints(self.catalog.constraints.primary))
        with ThreadPoolExecutor(JOBS) as pool:
            found = list(pool.map(inheritable_thread_target(self._session)(self._fetched), columns))
        for table, texts in zip(columns, found, strict=True):
            self._held[table] = None if texts is None else self._numbered(texts)
        return self

    def _fetched(self, table: str) -> pa.Table | None:
        df = self.catalog[table]
        texts = df.select(*(canon(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields)).limit(self.local_rows + 1).toArrow()
        self.asked["jobs"] += 1
        return texts if texts.num_rows <= self.local_rows else None

    def _numbered(self, texts: pa.Table) -> Projection:
        number = lambda t: -1 if t is None else self._codes.setdefault(t, len(self._codes))
        rows = [np.fromiter(map(number, c.to_pylist()), np.int64, texts.num_rows) for c in texts.columns]
        return Projection(tuple(texts.column_names), np.stack(rows, axis=1) if rows else np.zeros((texts.num_rows, 0), np.int64))

    def close(self) -> None:
        for df in self._kept:
            df.unpersist()
        self._kept.clear()

    @staticmethod
    def _question(edges: Iterable[Edge], keys: Iterable[Cell]) -> tuple:
        """The question with occurrences numbered so that questions which differ in numbers alone are equal: the least of all
        numberings (occurrences of a table are few)."""
        edges, keys = list(edges), list(keys)
        own: dict[str, list[int]] = {}
        for table, number in sorted(aliases(edges) | {k.alias for k in keys}):
            own.setdefault(table, []).append(number)
        forms = []
        for order in product(*(permutations(range(len(o))) for o in own.values())):
            new = {(t, o): n for (t, os), numbers in zip(own.items(), order, strict=True) for o, n in zip(os, numbers, strict=True)}
            moved = lambda c, new=new: Cell(c.table, new[c.alias], c.column)
            forms.append((sorted(Edge.of(moved(e.left), moved(e.right)) for e in edges), sorted(map(moved, keys))))
        least = min(forms)
        return frozenset(least[0]), frozenset(least[1])

    def ask(self, questions: Iterable[tuple[Iterable[Edge], Iterable[Cell]]]) -> None:
        """questions: (edges, keys); without edges the keys are those of one occurrence."""
        asked = [self._question(*q) for q in questions]
        new = [q for q in dict.fromkeys(asked) if q not in self.known]
        self.asked["questions"] += len(asked)
        self.asked["repeated"] += len(asked) - len(new)
        left = []
        for q in new:
            if (n := self._here(*q)) is None:
                left.append(q)
            else:
                self.known[q] = n
                self.asked["here"] += 1
        parts = [left[lo : lo + BATCH] for lo in range(0, len(left), BATCH)]

        def answer(part: list[tuple]) -> list[tuple[tuple, int]]:
            counted = [self._count(edges, keys).select(F.lit(i).alias("i"), "n") for i, (edges, keys) in enumerate(part)]
            return [(part[r["i"]], r["n"]) for r in reduce(DataFrame.unionAll, counted).collect()]  # BATCH rows at most

        if parts:
            self.asked["jobs"] += len(parts)
            with ThreadPoolExecutor(JOBS) as pool:
                for found in pool.map(inheritable_thread_target(self._session)(answer), parts):
                    self.known.update(found)

    def _here(self, edges: frozenset[Edge], keys: frozenset[Cell]) -> int | None:
        """The answer from fetched projections; None without them."""
        wanted = cells(edges) | keys
        if any(self._held.get(c.table) is None for c in wanted):
            return None
        steps = walk(edges) if edges else [(next(iter(keys)).alias, [])]
        names: list[Cell] = []
        out = np.zeros((1, 0), np.int64)
        for at, (alias, on) in enumerate(steps):
            own = sorted(c for c in wanted if c.alias == alias)
            rows = self._held[alias[0]].of([c.column for c in own])
            rows = rows[(rows >= 0).all(axis=1)]
            for e in edges:
                if e.aliases == {alias}:
                    rows = rows[rows[:, own.index(e.left)] == rows[:, own.index(e.right)]]
            rows = _different(rows)
            if on:
                ends = [(e.left, e.right) if e.right.alias == alias else (e.right, e.left) for e in on]
                met = _meet(out[:, [names.index(a) for a, _ in ends]], rows[:, [own.index(b) for _, b in ends]], self.meet_rows)
                if met is None:
                    return None
                rows = np.concatenate([out[met[0]], rows[met[1]]], axis=1)
            names = names + own
            still = {c for _, es in steps[at + 1 :] for e in es for c in (e.left, e.right)} | keys
            kept = [i for i, c in enumerate(names) if c in still]
            out, names = _different(rows[:, kept]), [names[i] for i in kept]
        return len(out)

    def _count(self, edges: frozenset[Edge], keys: frozenset[Cell]) -> DataFrame:
        return filled_keys(self.catalog, edges, sorted(keys)).agg(F.count("*").alias("n"))

    def __getitem__(self, question: tuple[Iterable[Edge], Iterable[Cell]]) -> int:
        if self._question(*question) not in self.known:
            self.ask([question])
        return self.known[self._question(*question)]
