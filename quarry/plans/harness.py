"""Runs of discovery under many settings: traversal orders, growing bounds, growing data, and whole studies; each run is a row."""

from __future__ import annotations

import json
import resource
import time
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.discovery import compatible_edges, discover
from quarry.plans.miners import miner
from quarry.plans.monitor import time_limit
from quarry.sources.catalog import Catalog

#: The orders and heuristics that are compared with each other.
TRAVERSALS = (("dfs", None), ("bfs", None), ("cost", "naive"), ("cost", "table_size"), ("cost", "join_selectivity"), ("cost", "hybrid"))
RUN = "run string, algorithm string, dataset string, parameters string, status string, duration double, first_rule_s double, candidates long, rules long, rules_per_s double, driver_mb double, error string"


class Tracker:
    """Runs as lines of JSON in a folder: parameters, measures and artifacts of each, appended as they end."""

    def __init__(self, folder: str) -> None:
        self.path = Path(folder) / "runs.jsonl"
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def log(self, parameters: dict, measures: dict, artifacts: Iterable[str] = ()) -> str:
        run = uuid.uuid4().hex
        line = {"run": run, "at": time.strftime("%Y-%m-%dT%H:%M:%S"), "parameters": parameters, "measures": measures, "artifacts": list(artifacts)}
        with self.path.open("a", encoding="utf-8") as file:
            file.write(json.dumps(line, default=str) + "\n")
        return run

    def runs(self) -> list[dict]:
        return [json.loads(line) for line in self.path.read_text(encoding="utf-8").splitlines()] if self.path.exists() else []


def measured(work: Callable[[dict], int], algorithm: str, dataset: str, parameters: dict, tracker: Tracker | None = None) -> tuple:
    """A row of RUN: work(report) gives its number of rules. What fails, or runs into its time limit, is a row as well. driver_mb
    is the Python driver's peak so far."""
    report: dict = {}
    began, status, error, rules = time.monotonic(), "done", None, None
    try:
        rules = work(report)
    except TimeoutError as reason:
        status, error = "timeout", str(reason)
    except Exception as reason:  # a failed run is a result
        status, error = "failed", f"{type(reason).__name__}: {str(reason)[:300]}"
    seconds = time.monotonic() - began
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    per_s = rules / seconds if rules is not None and seconds else None
    row = (uuid.uuid4().hex, algorithm, dataset, json.dumps(parameters, default=str, sort_keys=True), status, seconds, report.get("first_rule_s"), report.get("candidates"), rules, per_s, peak, error)
    if tracker:
        tracker.log({"algorithm": algorithm, "dataset": dataset, **parameters}, {"status": status, "duration": seconds, "rules": rules, **report})
    return row


def _frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RUN)


def traversals(spark: SparkSession, catalog: Catalog, dataset: str = "data", timeout_s: float | None = None, tracker: Tracker | None = None, **bounds: object) -> DataFrame:
    """A row per traversal of the same search; compatible columns are looked for once."""
    edges = compatible_edges(catalog, int(bounds.get("max_occurrence", 3)))  # type: ignore[arg-type]
    rows = []
    for order, heuristic in TRAVERSALS:
        settings = {"order": order, "heuristic": heuristic, **bounds}
        rows.append(measured(lambda report, s=settings: discover(catalog, edges=edges, timeout_s=timeout_s, report=report, **s).count(), "tgd", dataset, settings, tracker))
    return _frame(spark, rows)


def sensitivity(spark: SparkSession, catalog: Catalog, sizes: Iterable[int] = (1, 2, 3), dataset: str = "data", timeout_s: float | None = None, tracker: Tracker | None = None, **bounds: object) -> tuple[DataFrame, DataFrame]:
    """A row per bound on tables, and max_tables, tables, n: how many rules have so many tables under each bound."""
    rows, counts = [], []
    for most in sizes:
        def work(report: dict, most: int = most) -> int:
            found = discover(catalog, max_tables=most, timeout_s=timeout_s, report=report, **bounds)
            counts.extend((most, r["tables"], r["count"]) for r in found.groupBy("tables").count().collect())
            return report["rules"]

        rows.append(measured(work, "tgd", dataset, {"max_tables": most, **bounds}, tracker))
    return _frame(spark, rows), spark.createDataFrame(counts, "max_tables int, tables int, n long")


def scalability(spark: SparkSession, made: Callable[[SparkSession, int], Catalog], sizes: Iterable[int], timeout_s: float | None = None, tracker: Tracker | None = None, **bounds: object) -> DataFrame:
    """A row per number of rows of a generated catalog."""
    rows = []
    for size in sizes:
        def work(report: dict, size: int = size) -> int:
            return discover(made(spark, size), timeout_s=timeout_s, report=report, **bounds).count()

        rows.append(measured(work, "tgd", f"{size} rows", {"rows": size, **bounds}, tracker))
    return _frame(spark, rows)


def study(spark: SparkSession, catalogs: dict[str, Catalog], plan: dict[str, dict], folder: str, repeats: int = 1, timeout_s: float | None = 300) -> DataFrame:
    """Every miner of plan (name: its params) on every catalog: rules go to folder/miner/dataset, runs are tracked in folder, and
    a row per run comes back. An unknown miner raises before anything runs."""
    named = {name: miner(name) for name in plan}
    tracker, rows = Tracker(folder), []
    for dataset, catalog in catalogs.items():
        for name, own in named.items():
            for _ in range(repeats):
                def work(report: dict, own=own, name=name, catalog=catalog, dataset=dataset) -> int:
                    with time_limit(spark, timeout_s):
                        path = f"{folder}/{name}/{dataset}"
                        own.discover(catalog, **plan[name]).write.mode("overwrite").parquet(path)
                        return spark.read.parquet(path).count()

                rows.append(measured(work, name, dataset, plan[name], tracker))
    return _frame(spark, rows)
