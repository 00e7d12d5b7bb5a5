"""Statistical reports over measured runs: each algorithm on each dataset, and algorithms against each other."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import stats

METRICS = ("support", "confidence", "accuracy", "duration")


def by_algorithm(runs: DataFrame, metrics: tuple[str, ...] = METRICS, by: tuple[str, ...] = ("algorithm", "dataset")) -> DataFrame:
    """metric, by, n, mean, std, median, min, max and the 95 % interval of the mean, for the metrics that runs has. A metric without
    a value in a group has no row there."""
    parts = [stats.with_interval(stats.describe(runs, m, list(by))).select(F.lit(m).alias("metric"), "*") for m in metrics if m in runs.columns]
    if not parts:
        raise ValueError(f"none of {', '.join(metrics)} is a column")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pairwise(runs: DataFrame, metrics: tuple[str, ...] = METRICS, parametric: bool = True, level: float = 0.05) -> DataFrame:
    """metric, dataset, a, b, test, statistic, p_value, effect, significant: each two algorithms on each dataset where both have
    values. Algorithms and datasets are few: each pair is a few aggregates."""
    present = sorted({(r["dataset"], r["algorithm"]) for r in runs.select("dataset", "algorithm").distinct().collect()})
    rows = []
    for metric in (m for m in metrics if m in runs.columns):
        for dataset in dict.fromkeys(d for d, _ in present):
            own = runs.where((F.col("dataset") == dataset) & F.col(metric).isNotNull())
            held = {r["algorithm"] for r in own.select("algorithm").distinct().collect()}
            for a, b in combinations(sorted(held), 2):
                found = stats.compare_groups(own, metric, "algorithm", a, b, parametric)
                effect = None if found["effect"] is None else float(found["effect"])
                rows.append((metric, dataset, a, b, found["test"], float(found["statistic"]), float(found["p_value"]), effect, bool(found["p_value"] < level)))
    schema = "metric string, dataset string, a string, b string, test string, statistic double, p_value double, effect double, significant boolean"
    return runs.sparkSession.createDataFrame(rows, schema)


def markdown(runs: DataFrame, title: str = "Runs", metrics: tuple[str, ...] = METRICS) -> str:
    """Both as Markdown tables; they have a row per algorithm, dataset and metric, and per pair of algorithms."""
    lines = [f"# {title}", "", "| metric | algorithm | dataset | n | mean | std | median | interval |", "|-|-|-|-|-|-|-|-|"]
    for r in by_algorithm(runs, metrics).orderBy("metric", "algorithm", "dataset").collect():
        lines.append(f"| {r['metric']} | {r['algorithm']} | {r['dataset']} | {r['n']} | {r['mean']:.4f} | {r['std']:.4f} | {r['median']:.4f} | {r['ci_low']:.4f} to {r['ci_high']:.4f} |")
    lines += ["", "| metric | dataset | algorithms | test | statistic | p | effect |", "|-|-|-|-|-|-|-|"]
    for r in pairwise(runs, metrics).orderBy("metric", "dataset", "a", "b").collect():
        effect = "-" if r["effect"] is None else f"{r['effect']:.3f}"
        lines.append(f"| {r['metric']} | {r['dataset']} | {r['a']}, {r['b']} | {r['test']} | {r['statistic']:.4f} | {r['p_value']:.4f}{' *' if r['significant'] else ''} | {effect} |")
    return "\n".join(lines) + "\n"
