"""Rules of other miners, checked and scored against the catalog they came from: do their tables exist, are their scores whole, and
what stands in for scores that their files don't state."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.ranks import by_rows, inverse_rows, stated_or
from quarry.functions.rules import InclusionDependency, RuleRecord, from_json
from quarry.functions.stats import valid_metric
from quarry.operators.values import ind_measures
from quarry.sources.catalog import Catalog

#: Whose rules they are: the forms that each one's records must have.
KINDS = {"inclusion": "InclusionDependency", "tgd": "TGDRule", "horn": "HornRule", "path": "TGDRule", "cover": "TGDRule"}
#: Scores that are counts, not shares.
COUNTS = ("positive_examples", "body_size", "head_size", "pca_body_size")
SCORES = ("confidence", "support", "accuracy", "head_coverage", "std_confidence", "pca_confidence")

RECORDS = "rule_id long, miner string, kind string, display string, tables array<string>, body_tables array<string>, accuracy double, confidence double, record string"


def table_of(relation: str) -> str:
    """The table that a relation's name stands for: table_0 of an occurrence, or the part before the column."""
    return re.sub(r"_\d+$", "", relation.split(".")[0])


def records(spark: SparkSession, miner: str, rules: list[dict]) -> DataFrame:
    """Rows of RECORDS from rule records as other miners' JSON holds them."""
    rows = []
    for i, raw in enumerate(rules):
        rule: RuleRecord = from_json(raw)
        if isinstance(rule, InclusionDependency):
            body, every = [rule.table_dependant], [rule.table_dependant, rule.table_referenced]
        else:
            body = [table_of(p.relation) for p in getattr(rule, "body", ())]
            every = body + [table_of(p.relation) for p in getattr(rule, "head", ())]
        number = lambda k, raw=raw: float(raw[k]) if isinstance(raw.get(k), (int, float)) and not isinstance(raw.get(k), bool) else None
        rows.append((i, miner, type(rule).__name__, str(raw.get("display") or ""), sorted(set(every)), body, number("accuracy"), number("confidence"), json.dumps(raw, ensure_ascii=False)))
    return spark.createDataFrame(rows, RECORDS)


def with_tables(rules: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds correct: every table is in the catalog (rules of fewer than two predicates count as correct, inclusions never do so), and
    rows: those of the first body table, null if it isn't there."""
    sizes = catalog.row_counts()
    spark = rules.sparkSession
    known = spark.createDataFrame(list(sizes.items()), "first string, rows long")
    missing = F.size(F.array_except("tables", F.array(*map(F.lit, sizes)))) == 0
    simple = (F.col("kind") != "InclusionDependency") & (F.size("tables") < 2) & (F.size("body_tables") < 2)
    return rules.withColumn("correct", missing | simple).withColumn("first", F.get("body_tables", F.lit(0))).join(F.broadcast(known), "first", "left").drop("first")  # a row per table


def scored(rules: DataFrame, catalog: Catalog) -> DataFrame:
    """with_tables(), then support and score: what the file states or else a fallback. Inclusions are measured on the data; rules of
    the horn kind fall back to 100 over the rows of their table, others to a share of 1000 rows."""
    checked = with_tables(rules, catalog)
    rows = F.coalesce("rows", F.lit(0))
    fallback = F.when(F.col("miner") == "horn", inverse_rows(rows)).otherwise(by_rows(rows))
    out = checked.withColumn("support", stated_or(F.coalesce("accuracy", F.lit(-1.0)), fallback)).withColumn("score", stated_or(F.coalesce("confidence", F.lit(-1.0)), F.lit(0.0)))
    inclusions = [(r["rule_id"], from_json(json.loads(r["record"]))) for r in out.where(F.col("kind") == "InclusionDependency").select("rule_id", "record").collect()]  # rules, not data
    if not inclusions:
        return out
    pairs = {i: (f"{d.table_dependant}.{d.columns_dependant[0]}", f"{d.table_referenced}.{d.columns_referenced[0]}") for i, d in inclusions}
    measured = ind_measures(catalog, sorted(set(pairs.values())))
    ids = out.sparkSession.createDataFrame([(i, *p) for i, p in pairs.items()], "rule_id long, dependant string, referenced string")
    found = ids.join(measured, ["dependant", "referenced"]).select("rule_id", F.col("support").alias("__s"), F.col("confidence").alias("__c"), F.col("valid").alias("__v"))
    both = out.join(F.broadcast(found), "rule_id", "left")  # a row per rule
    return both.withColumns({"support": F.coalesce("__s", "support"), "score": F.coalesce("__c", "score"), "correct": F.coalesce("__v", "correct")}).drop("__s", "__c", "__v")


def faults(miner: str, rule: dict) -> list[str]:
    """What is wrong with one record: scores that are no shares, and what a miner's records must have."""
    out = []
    for name in (*SCORES, *COUNTS):
        if name in rule:
            value = rule[name]
            if value is None or not isinstance(value, (int, float)) or value != value or value in (float("inf"), float("-inf")):
                out.append(f"{name} is no number")
            elif name in SCORES and name != "accuracy" and not 0 <= value <= 1 or name in COUNTS and value < 0:
                out.append(f"{name} is out of range")
    if miner == "inclusion" and rule.get("type", "InclusionDependency") != "InclusionDependency":
        out.append(f"type is {rule['type']}")
    if miner == "cover" and "clauses" not in rule and "body" not in rule:
        out.append("neither clauses nor body")
    return out


def checked(rows: DataFrame, scores: tuple[str, ...] = ("support", "score")) -> DataFrame:
    """One row per miner: rules, valid (every score a number from 0 to 1), correct."""
    fine = F.lit(True)
    for c in scores:
        fine = fine & valid_metric(F.col(c))
    return rows.groupBy("miner").agg(F.count("*").alias("rules"), F.count_if(fine).alias("valid"), F.count_if("correct").alias("correct"))


def miner_of(path: str, rules: list[dict]) -> str:
    """Whose file it is, by its name or else by the form of its first rule; tgd if nothing tells."""
    name = Path(path).stem.lower()
    for found in sorted(KINDS):
        if found in re.split(r"[^a-z]+", name):
            return found
    first = rules[0] if rules else {}
    if "table_dependant" in first:
        return "inclusion"
    if "clauses" in first or ":-" in str(first.get("display", "")):
        return "cover"
    return "horn" if first.get("type") == "HornRule" else "path" if "<=" in str(first.get("display", "")) else "tgd"


def read_rules(path: str) -> list[dict]:
    """A file that holds a list of records, one record, or one a line."""
    text = Path(path).read_text(encoding="utf-8").strip()
    if not text:
        return []
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        return [json.loads(line) for line in text.splitlines() if line.strip()]
    return found if isinstance(found, list) else [found]


def rescore(catalog: Catalog, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of scored() for the rules of all files, with their file, and per miner: rules, mean support and score, valid, correct,
    faults. Files are rule sets: they are read on the driver."""
    spark = next(iter(catalog.tables.values())).sparkSession
    parts, wrong = [], {}
    for path in paths:
        raw = read_rules(path)
        miner = miner_of(path, raw)
        wrong[miner] = wrong.get(miner, 0) + sum(bool(faults(miner, r)) for r in raw)
        parts.append(scored(records(spark, miner, raw), catalog).withColumn("file", F.lit(Path(path).name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    bad = spark.createDataFrame(list(wrong.items()), "miner string, faulty long")
    means = out.groupBy("miner").agg(F.avg("support").alias("mean_support"), F.avg("score").alias("mean_score"))
    return out, checked(out).join(means, "miner").join(F.broadcast(bad), "miner")  # a row per miner
