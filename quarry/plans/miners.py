"""Miners by name, with one way to call them: discover(catalog, **params) gives rows of kind, rule, support and confidence."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import ilp
from quarry.operators.triples import mine_horn, path_rules, triples
from quarry.operators.values import ValueIndex
from quarry.plans import discovery
from quarry.sources.catalog import Catalog


class Miner(ABC):
    """kind: of its rules, as rule records name it."""

    name: str
    kind: str

    @abstractmethod
    def rows(self, catalog: Catalog, **params: object) -> DataFrame:
        """rule, support, confidence."""

    def discover(self, catalog: Catalog, **params: object) -> DataFrame:
        found = self.rows(catalog, **params)
        return found.select(F.lit(self.name).alias("miner"), F.lit(self.kind).alias("kind"), "rule", F.col("support").cast("double").alias("support"), F.col("confidence").cast("double").alias("confidence"))


class Dependencies(Miner):
    """Tuple-generating dependencies; params of plans.discovery.discover()."""

    name, kind = "tgd", "TGDRule"

    def rows(self, catalog: Catalog, **params: object) -> DataFrame:
        return discovery.discover(catalog, **params).select("rule", F.col("ref_support").alias("support"), F.col("ref_confidence").alias("confidence"))


class Inclusions(Miner):
    """Unary inclusion dependencies, exact or partial: least (1.0), same_table (True). support: shared values over the values of
    both; confidence: over the dependant's."""

    name, kind = "inclusion", "InclusionDependency"

    def rows(self, catalog: Catalog, least: float = 1.0, same_table: bool = True) -> DataFrame:
        found = ValueIndex(catalog).inclusions(least, same_table)
        return found.select(F.concat_ws(" ⊆ ", "dependant", "referenced").alias("rule"), F.col("jaccard").alias("support"), F.col("coverage").alias("confidence"))


class Horns(Miner):
    """Closed Horn rules over triples: length (2), min_support (1), min_coverage (0.01). support: head coverage."""

    name, kind = "horn", "HornRule"

    def rows(self, catalog: Catalog, length: int = 2, min_support: int = 1, min_coverage: float = 0.01) -> DataFrame:
        found = mine_horn(triples(catalog), length, min_support, min_coverage)
        return found.select("rule", F.col("head_coverage").alias("support"), F.col("pca_confidence").alias("confidence"))


class Paths(Miner):
    """Path rules with constants over triples: length (2), min_support (2), sample (None: all), seed. support: subjects."""

    name, kind = "path", "HornRule"

    def rows(self, catalog: Catalog, length: int = 2, min_support: int = 2, sample: float | None = None, seed: int = 0) -> DataFrame:
        return path_rules(triples(catalog), length, min_support, sample, seed).select("rule", "support", "confidence")


class Covers(Miner):
    """For each table, bodies of joins that cover its rows, chosen greedily: heads (all tables that have a compatible partner),
    max_literals (2), min_shared (4). support: the share of rows that a body adds; confidence 1, as there are no negatives."""

    name, kind = "cover", "HornRule"

    def rows(self, catalog: Catalog, heads: Iterable[str] | None = None, max_literals: int = 2, min_shared: int = 4) -> DataFrame:
        pairs = [(r["left"], r["right"]) for r in ValueIndex(catalog).compatible(min_shared).select("left", "right").collect()]  # columns squared
        joined = {p.split(".", 1)[0] for both in pairs for p in both if both[0].split(".", 1)[0] != both[1].split(".", 1)[0]}
        rows = []
        for table in sorted(joined if heads is None else heads):
            total = ilp.examples(catalog, table).count()
            chosen, _ = ilp.learn(catalog, table, pairs, max_literals)
            rows += [(f"{table} :- {body}", n / total, 1.0) for body, n in chosen]
        spark = next(iter(catalog.tables.values())).sparkSession
        return spark.createDataFrame(rows, "rule string, support double, confidence double")


MINERS: dict[str, Miner] = {m.name: m for m in (Dependencies(), Inclusions(), Horns(), Paths(), Covers())}


def miner(name: str) -> Miner:
    """The miner of that name, in any case; an unknown one raises."""
    if name.lower() not in MINERS:
        raise ValueError(f"no miner {name}; there are {', '.join(sorted(MINERS))}")
    return MINERS[name.lower()]
