"""Command line: discover, mine, inds, triples, metrics, coverage, stats, report, bench, info."""

from __future__ import annotations

import argparse
import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import reports, stats
from quarry.operators import coverage, scoring
from quarry.operators.triples import triples
from quarry.operators.values import ValueIndex
from quarry.plans import harness
from quarry.plans.discovery import compatible_edges, discover
from quarry.plans.graph import graph_measures, neighbour_links
from quarry.plans.miners import MINERS, miner
from quarry.plans.monitor import time_limit
from quarry.sources import sinks
from quarry.sources.catalog import Catalog, Constraints
from quarry.sources.config import Settings, load_yaml


def open_catalog(spark: SparkSession, folder: str, spec: str | None) -> Catalog:
    """The tables of a folder (name.parquet, or name.csv with a header); spec: YAML with primary (table: [columns]) and foreign
    (table.column: table.column), and optionally tables (table: [columns])."""
    found = load_yaml(spec) if spec else {}
    foreign = {tuple(k.split(".", 1)): tuple(v.split(".", 1)) for k, v in found.get("foreign", {}).items()}
    keys = Constraints({t: tuple(c) for t, c in found.get("primary", {}).items()}, foreign)
    names = {p.stem: p.suffix for p in Path(folder).iterdir() if p.suffix in (".parquet", ".csv")} if "://" not in folder else {}
    wanted = found.get("tables") or dict.fromkeys(names)
    if any(names.get(n) == ".csv" for n in wanted):
        return Catalog.csv(spark, folder, wanted, keys)
    return Catalog.parquet(spark, folder, wanted, keys)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quarry", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("discover", "mine", "inds", "triples", "metrics", "bench", "info"):
        own = sub.add_parser(name)
        own.add_argument("folder")
        own.add_argument("--spec", help="YAML of keys and references")
        own.add_argument("--results", default="results")
    for name in ("discover", "bench"):
        for flag, kind in (("--max-tables", int), ("--max-edges", int), ("--max-occurrence", int), ("--order", str), ("--heuristic", str), ("--config", str), ("--timeout-s", int)):
            sub.choices[name].add_argument(flag, type=kind)
    sub.choices["bench"].add_argument("--kind", choices=("traversals", "sensitivity"), default="traversals")
    sub.choices["mine"].add_argument("--miner", choices=sorted(MINERS), required=True)
    sub.choices["mine"].add_argument("--param", nargs="*", default=[], help="name=value, values as JSON")
    sub.choices["mine"].add_argument("--timeout-s", type=float)
    sub.choices["inds"].add_argument("--least", type=float, default=1.0)
    sub.choices["metrics"].add_argument("--rules", nargs="+", required=True, help="JSON files of miners' rules")
    own = sub.add_parser("coverage")
    own.add_argument("own", help="a JSON file of rules")
    own.add_argument("other", help="the rules to be covered")
    own.add_argument("--least", type=float, default=0.8)
    for name in ("stats", "report"):
        own = sub.add_parser(name)
        own.add_argument("runs", help="a folder of JSON rows")
    sub.choices["stats"].add_argument("--value", default="duration")
    sub.choices["stats"].add_argument("--by", nargs="*", default=["algorithm"])
    sub.choices["report"].add_argument("--out", default="report.md")
    return out


def rule_set(spark: SparkSession, path: str) -> DataFrame:
    """rule_id, tables, body_vars, head_vars, inclusion, from a file of rule records."""
    from quarry.functions.rules import InclusionDependency, from_json

    rows = []
    for i, raw in enumerate(scoring.read_rules(path)):
        rule = from_json(raw)
        if isinstance(rule, InclusionDependency):
            rows.append((f"{i:06d}", [rule.table_dependant, rule.table_referenced], [], [], True))
            continue
        body, head = getattr(rule, "body", ()), getattr(rule, "head", ())
        variables = [sorted({v for p in side for v in (p.variable1, p.variable2)}) for side in (body, head)]
        rows.append((f"{i:06d}", sorted({p.relation.split(".")[0] for p in (*body, *head)}), *variables, False))
    return spark.createDataFrame(rows, "rule_id string, tables array<string>, body_vars array<string>, head_vars array<string>, inclusion boolean")


def _on_catalog(spark: SparkSession, args: argparse.Namespace) -> dict:
    catalog = open_catalog(spark, args.folder, args.spec)
    Path(args.results).mkdir(parents=True, exist_ok=True)
    if args.command in ("discover", "bench"):
        own = Settings.read(args.config or "", **{k: getattr(args, k) for k in ("max_tables", "max_edges", "max_occurrence", "order", "heuristic", "timeout_s")})
        bounds = {"max_occurrence": own.max_occurrence, "max_edges": own.max_edges}
    if args.command == "discover":
        report: dict = {}
        with time_limit(spark, own.timeout_s):
            edges = compatible_edges(catalog, own.max_occurrence)
            found = discover(catalog, max_tables=own.max_tables, order=own.order, heuristic=own.heuristic, edges=edges, timeout_s=own.timeout_s, report=report, **bounds)
            found.write.mode("overwrite").json(f"{args.results}/rules")
            named = found.withColumnsRenamed({"rule": "display", "ref_support": "accuracy", "ref_confidence": "confidence"})
            sinks.write_report(named, f"{args.results}/report.md", "Rules", {"tables": len(catalog.tables)})
            sinks.write_adjacency(ValueIndex(catalog).compatible(), f"{args.results}/compatibility")
            sinks.write_discovery_facts(f"{args.results}/discovery.json", report, edges)
            return {"rules": report["rules"]}
    if args.command == "bench":
        run = harness.traversals if args.kind == "traversals" else lambda *a, **k: harness.sensitivity(*a, **k)[0]
        more = {"max_tables": own.max_tables} if args.kind == "traversals" else {}
        rows = run(spark, catalog, dataset=Path(args.folder).name, timeout_s=own.timeout_s, tracker=harness.Tracker(args.results), **bounds, **more)
        return {"runs": [r.asDict() for r in rows.collect()]}  # a row per run
    if args.command == "mine":
        params = {k: json.loads(v) for k, v in (p.split("=", 1) for p in args.param)}
        with time_limit(spark, args.timeout_s):
            path = f"{args.results}/{args.miner}"
            miner(args.miner).discover(catalog, **params).write.mode("overwrite").parquet(path)
            return {"rules": spark.read.parquet(path).count()}
    if args.command == "inds":
        found = ValueIndex(catalog).inclusions(args.least)
        found.write.mode("overwrite").json(f"{args.results}/inclusions")
        return {"inclusions": spark.read.json(f"{args.results}/inclusions").count()}
    if args.command == "triples":
        facts = triples(catalog)
        sinks.write_tsv(facts, f"{args.results}/triples_tsv")
        sinks.write_turtle(facts, f"{args.results}/triples_turtle")
        return {"triples": facts.count()}
    if args.command == "metrics":
        rows, summary = scoring.rescore(catalog, args.rules)
        rows.drop("record").write.mode("overwrite").json(f"{args.results}/metrics")
        return {"miners": [r.asDict() for r in summary.orderBy("miner").collect()]}  # a row per miner
    edges = compatible_edges(catalog, 1)
    graph = graph_measures(sorted(edges), neighbour_links(edges))
    return {"tables": catalog.row_counts(), "attributes": [str(a) for a in catalog.attributes()], "graph": graph}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
    began = time.time()
    if args.command == "stats":
        rows = stats.with_interval(stats.describe(spark.read.json(args.runs), args.value, args.by)).orderBy(*args.by)
        out: dict = {"rows": [r.asDict() for r in rows.limit(1000).collect()]}
    elif args.command == "report":
        Path(args.out).write_text(reports.markdown(spark.read.json(args.runs)), encoding="utf-8")
        out = {"report": args.out}
    elif args.command == "coverage":
        own, other = rule_set(spark, args.own), rule_set(spark, args.other)
        row = coverage.completeness(own, other, args.least).first()
        pairs, share = coverage.greedy_coverage(own, other, args.least)
        out = {"coverage": share, "matches": len(pairs), **row.asDict(), "overlap": coverage.miner_overlap(own, other, args.least).select(F.count_distinct("other_id")).first()[0]}
    else:
        out = _on_catalog(spark, args)
        sinks.write_statistics(f"{args.results}/statistics.json", out | {"seconds": round(time.time() - began, 3)})
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
