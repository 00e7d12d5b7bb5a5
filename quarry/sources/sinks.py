"""Where results go: folders of CSV, TSV, Turtle and JSON files, written by the executors, and small reports."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.rules import RuleTable, top_rules
from quarry.sources.catalog import Catalog

SEPARATOR = "___sep___"


def write_csv(catalog: Catalog, folder: str) -> None:
    """A folder of header files per table."""
    for name, table in catalog.tables.items():
        table.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_tsv(triples: DataFrame, folder: str) -> None:
    """Subject, predicate and object with tabs between, and nothing escaped."""
    triples.select(F.concat_ws("\t", "subject", "predicate", "object").alias("value")).write.mode("overwrite").text(folder)


def read_tsv(spark, folder: str) -> DataFrame:
    parts = F.split("value", "\t", 3)
    return spark.read.text(folder).select(*(parts[i].alias(n) for i, n in enumerate(("subject", "predicate", "object"))))


def turtle(triples: DataFrame) -> DataFrame:
    """value: a statement per triple; an object that is quoted on both ends is a literal, others are names."""
    safe = lambda c: F.concat(F.lit("ex:"), F.regexp_replace(c, r"[^\p{L}\p{N}_.]", "_"))
    quoted = (F.length("object") >= 2) & F.col("object").startswith('"') & F.col("object").endswith('"')
    named = F.when(quoted, F.col("object")).otherwise(safe("object"))
    return triples.select(F.concat(F.concat_ws(" ", safe("subject"), safe("predicate"), named), F.lit(" .")).alias("value"))


def write_turtle(triples: DataFrame, folder: str) -> None:
    """The prefix in a file of its own, the statements as many files; together they are one document in any order of statements."""
    spark = triples.sparkSession
    spark.createDataFrame([("@prefix ex: <http://example.org/> .",)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/prefix")
    turtle(triples).write.mode("overwrite").text(f"{folder}/statements")


def adjacency(compatible: DataFrame) -> DataFrame:
    """attribute, compatible: each attribute with the sorted others it is compatible with, either way round."""
    mark = lambda c: F.replace(c, F.lit("."), F.lit(SEPARATOR))
    pairs = compatible.select(mark(F.col("left")).alias("attribute"), mark(F.col("right")).alias("other"))
    both = pairs.unionByName(pairs.select(F.col("other").alias("attribute"), F.col("attribute").alias("other")))
    return both.groupBy("attribute").agg(F.sort_array(F.collect_set("other")).alias("compatible"))


def write_adjacency(compatible: DataFrame, folder: str) -> None:
    adjacency(compatible).write.mode("overwrite").json(folder)


def write_report(rules: DataFrame, path: str, title: str, facts: dict[str, object] | None = None, n: int = 5) -> str:
    """A Markdown report on the driver: facts of the run, the number of rules and the best of them."""
    lines = [f"# {title}", "", *(f"- {k}: {v}" for k, v in (facts or {}).items()), f"- rules: {rules.count()}", "", "| rule | accuracy | confidence |", "|-|-|-|"]
    lines += [f"| {r['display']} | {r['accuracy']:.4f} | {r['confidence']:.4f} |" for r in top_rules(rules, n).collect()]
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return path


def write_statistics(path: str, measures: dict[str, object]) -> None:
    Path(path).write_text(json.dumps(measures, indent=2, sort_keys=True, default=str), encoding="utf-8")


def write_rules(spark, rules: Iterable, folder: str) -> None:
    RuleTable(list(rules)).append(spark, folder)


def latex_table(rows: DataFrame, columns: list[str], caption: str, limit: int = 200) -> str:
    """A LaTeX table of a bounded number of rows."""
    escape = lambda x: str(x).replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("&", r"\&").replace("%", r"\%")
    body = [" & ".join(escape(r[c]) for c in columns) + r" \\" for r in rows.select(*columns).limit(limit).collect()]
    head = " & ".join(map(escape, columns)) + r" \\ \hline"
    return "\n".join([r"\begin{table}", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{{'l' * len(columns)}}}", head, *body, r"\end{tabular}", r"\end{table}"])


def write_discovery_facts(path: str, report: dict, edges: Iterable | None = None) -> None:
    """Seconds of discovery's phases and how its questions were answered, as discover() reports them; with edges, the graph of
    equalities too: its nodes, and for each the ones that can follow."""
    out: dict = {"measures": report}
    if edges is not None:
        own = sorted(set(edges))
        nodes = [f"{e.left} = {e.right}" for e in own]
        follow: dict[str, list[str]] = {n: [] for n in nodes}
        for i, a in enumerate(own):
            for j, b in enumerate(own):
                if i != j and a.aliases & b.aliases:
                    follow[nodes[i]].append(nodes[j])
        out["graph"] = {"nodes": nodes, "links": follow}
    write_statistics(path, out)


def tikz_plot(rows: DataFrame, x: str, y: str, series: str, x_label: str, y_label: str, log: bool = False, limit: int = 1000) -> str:
    """A TikZ picture of a line per series over a bounded number of points; points without a number are left out."""
    points: dict[str, list[tuple[float, float]]] = {}
    kept = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(series).cast("string").alias("s"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    for r in kept.orderBy("s", "x").limit(limit).collect():
        points.setdefault(r["s"], []).append((r["x"], r["y"]))
    escape = lambda t: t.replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    lines = [r"\begin{tikzpicture}", rf"\begin{{{'loglogaxis' if log else 'axis'}}}[xlabel={{{escape(x_label)}}}, ylabel={{{escape(y_label)}}}, legend pos=north west]"]
    for name, own in points.items():
        lines += [r"\addplot coordinates {" + " ".join(f"({a:g},{b:g})" for a, b in own) + "};", rf"\addlegendentry{{{escape(name)}}}"]
    return "\n".join([*lines, rf"\end{{{'loglogaxis' if log else 'axis'}}}", r"\end{tikzpicture}"])
