"""Candidate rules as sets of equalities between columns of table occurrences. All of this is metadata on the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, permutations, product
from typing import NamedTuple


class Cell(NamedTuple):
    """A column of an occurrence of a table."""

    table: str
    occurrence: int
    column: str

    @property
    def alias(self) -> tuple[str, int]:
        return self.table, self.occurrence

    def __str__(self) -> str:
        return f"{self.table}_{self.occurrence}.{self.column}"


class Edge(NamedTuple):
    """An equality; the lesser end stands first."""

    left: Cell
    right: Cell

    @classmethod
    def of(cls, a: Cell, b: Cell) -> Edge:
        return cls(min(a, b), max(a, b))

    @property
    def aliases(self) -> set[tuple[str, int]]:
        return {self.left.alias, self.right.alias}


Rule = frozenset  # of Edge
Alias = tuple[str, int]


def chains(edges: Iterable[Edge]) -> list[tuple[Cell, ...]]:
    """Classes of cells that the equalities make equal, each sorted, in order of their least cell."""
    root: dict[Cell, Cell] = {}

    def find(cell: Cell) -> Cell:
        root.setdefault(cell, cell)
        while root[cell] != cell:
            root[cell] = cell = root[root[cell]]
        return cell

    for e in edges:
        a, b = find(e.left), find(e.right)
        root[max(a, b)] = min(a, b)
    out: dict[Cell, list[Cell]] = {}
    for cell in sorted(root):
        out.setdefault(find(cell), []).append(cell)
    return sorted(tuple(c) for c in out.values())


def stars(classes: Iterable[Iterable[Cell]]) -> Rule:
    """The normal form of equality classes: their least cell equals each other one."""
    out = set()
    for own in classes:
        members = sorted(own)
        out |= {Edge(members[0], other) for other in members[1:]}
    return frozenset(out)


def is_normal(edges: Rule) -> bool:
    return stars(chains(edges)) == edges


def aliases(edges: Iterable[Edge]) -> set[Alias]:
    return {a for e in edges for a in e.aliases}


def consecutive(edges: Iterable[Edge]) -> bool:
    """Whether the occurrences of each table are 0, 1, ... without a gap."""
    own: dict[str, set[int]] = {}
    for table, occurrence in aliases(edges):
        own.setdefault(table, set()).add(occurrence)
    return all(o == set(range(len(o))) for o in own.values())


def possible_edges(pairs: Iterable[tuple[tuple[str, str], tuple[str, str]]], max_occurrence: int, caps: dict[tuple[str, str], int] | None = None) -> list[Edge]:
    """Equalities between occurrences (0 to max_occurrence - 1) of compatible columns; caps: the highest occurrence of a column."""
    caps = caps or {}
    found = set()
    for (t1, c1), (t2, c2) in pairs:
        for o1 in range(max_occurrence):
            for o2 in range(max_occurrence):
                a, b = Cell(t1, o1, c1), Cell(t2, o2, c2)
                if a != b and all(caps.get((c.table, c.column), o) >= o for c, o in ((a, o1), (b, o2))):
                    found.add(Edge.of(a, b))
    return sorted(found)


def splits(edges: Rule, max_head: int = 1) -> Iterator[tuple[frozenset[Alias], frozenset[Alias]]]:
    """(body, head) partitions of the occurrences with both sides filled and at most max_head head occurrences."""
    own = sorted(aliases(edges))
    for size in range(1, min(max_head, len(own) - 1) + 1):
        for head in combinations(own, size):
            yield frozenset(own) - frozenset(head), frozenset(head)


def uses_repeated_table_once(edges: Rule) -> bool:
    """Whether a table that occurs more than once has a least occurrence with a single joined end: such splits are rejected."""
    ends: dict[Alias, int] = {}
    for e in edges:
        for cell in (e.left, e.right):
            ends[cell.alias] = ends.get(cell.alias, 0) + 1
    tables: dict[str, list[int]] = {}
    for table, occurrence in ends:
        tables.setdefault(table, []).append(occurrence)
    return any(len(o) > 1 and ends[t, min(o)] == 1 for t, o in tables.items())


def canonical(edges: Rule) -> tuple:
    """A key that is equal for rules which differ only in the numbering of occurrences."""
    own: dict[str, list[int]] = {}
    for table, occurrence in sorted(aliases(edges)):
        own.setdefault(table, []).append(occurrence)
    best = None
    for order in product(*(permutations(range(len(o))) for o in own.values())):
        new = {(t, o): p for (t, os), perm in zip(own.items(), order, strict=True) for o, p in zip(os, perm, strict=True)}
        classes = [[Cell(c.table, new[c.alias], c.column) for c in chain] for chain in chains(edges)]
        key = tuple(sorted(stars(classes)))
        best = key if best is None or key < best else best
    return best or ()
