"""Readers of what other rule miners write."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.rules import HornRule, InclusionDependency, Predicate, TGDRule

_TRIPLE = re.compile(r"\?(\w+)\s+(\S+)\s+\?(\w+)")
_CALL = re.compile(r"([\w.]+)\(((?:[^()]|\([^()]*\))*)\)")


def parse_inclusion(line: str) -> InclusionDependency | None:
    """A line with one dictionary that names dependant and referenced columns as table.column lists; None for anything else."""
    try:
        record = ast.literal_eval(line.strip())
        left, right = (record[k]["columnIdentifiers"][0] for k in ("dependant", "referenced"))
        plain = lambda x: re.sub(r"\.csv$", "", x["tableIdentifier"])
        return InclusionDependency(plain(left), (left["columnIdentifier"],), plain(right), (right["columnIdentifier"],), line.strip())
    except (ValueError, SyntaxError, KeyError, IndexError, TypeError):
        return None


def closed_rules(spark: SparkSession, path: str) -> DataFrame:
    """display, body, head, confidence, support from lines "?a r ?b ... => ?a q ?b <tab> confidence <tab> support"."""
    parts = F.split("value", "\t")
    rule = F.split(parts[0], "=>")
    rows = spark.read.text(path).where(F.col("value").contains("=>") & (F.size(parts) >= 3))
    return rows.select(parts[0].alias("display"), F.trim(rule[0]).alias("body"), F.trim(rule[1]).alias("head"), F.expr("try_cast(split(value, '\t')[1] as double)").alias("confidence"), F.expr("try_cast(split(value, '\t')[2] as double)").alias("support"))


def parse_closed(line: str) -> TGDRule | None:
    """One such line. A relation of three dotted parts, a.b.c, stands for two predicates, by a.b and a.c."""
    rule, *numbers = line.rstrip("\n").split("\t")
    body, arrow, head = rule.partition("=>")
    if not arrow or not numbers:
        return None

    def read(text: str) -> tuple[Predicate, ...]:
        out = []
        for a, relation, b in _TRIPLE.findall(text):
            parts = relation.split(".")
            names = [relation] if len(parts) < 3 else [f"{parts[0]}.{parts[1]}", f"{parts[0]}.{parts[2]}"]
            out += [Predicate(a, n, b) for n in names]
        return tuple(out)

    return TGDRule(read(body), read(head), rule.strip(), -1.0, float(numbers[0]))


def path_rules(spark: SparkSession, path: str) -> DataFrame:
    """support, correct, confidence, rule from lines of four columns with tabs between."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(parts) >= 4)
    cast = lambda i, t: F.expr(f"try_cast(split(value, '\t')[{i}] as {t})")
    return rows.select(cast(0, "bigint").alias("support"), cast(1, "bigint").alias("correct"), cast(2, "double").alias("confidence"), parts[3].alias("rule"))


def parse_path(rule: str) -> HornRule | None:
    """head(X,Y) <= b(X,A), c(A,Y), or the same with => and sides turned; arguments may hold one level of parentheses."""
    left, mark, right = rule.partition("<=")
    if not mark:
        right, mark, left = rule.partition("=>")
    if not mark:
        return None

    def read(text: str) -> tuple[Predicate, ...]:
        out = []
        for relation, inside in _CALL.findall(text):
            first, _, second = inside.partition(",")
            out.append(Predicate(first.strip(), relation, second.strip()))
        return tuple(out)

    return HornRule(read(right), read(left), rule.strip())


_SCORE = {k: re.compile(rf"\b{k}\w*\s*[=:]\s*([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", re.IGNORECASE) for k in ("conf", "supp")}


def parse_free(line: str) -> TGDRule | None:
    """A rule anywhere in a line without tabs, with scores as conf=0.5 or support: 0.1 beside it; None without a rule."""
    plain = _SCORE["supp"].sub(" ", _SCORE["conf"].sub(" ", line))
    rule = parse_path(plain)
    if rule is None or not rule.body or not rule.head:
        return None
    found = {k: float(m[1]) if (m := p.search(line)) else -1.0 for k, p in _SCORE.items()}
    display = f"{', '.join(map(str, rule.body))} => {', '.join(map(str, rule.head))}"
    return TGDRule(rule.body, rule.head, display, found["supp"], found["conf"])


def parse_rule_line(line: str) -> TGDRule | None:
    """A line of four columns with tabs between, or else free text; comments and other lines give None."""
    text = line.strip()
    if not text or text.startswith("#"):
        return None
    parts = text.split("\t")
    if len(parts) >= 4 and (rule := parse_path(parts[3])) and rule.body and rule.head:
        try:
            return TGDRule(rule.body, rule.head, parts[3].strip(), -1.0, float(parts[2]))
        except ValueError:
            pass
    return parse_free(text)


def unwrapped(lines: list[str]) -> list[str]:
    """Lines of a terminal's output as they were before it broke them: a line that ends in a comma, an open parenthesis or an arrow
    goes on in the next one."""
    out: list[str] = []
    for line in lines:
        text = line.rstrip("\n")
        before = out[-1].rstrip() if out else ""
        if before and (before.endswith((",", "<=", "=>", "(", "&")) or before.count("(") > before.count(")")):
            out[-1] = before + " " + text.strip()
        else:
            out.append(text)
    return out


def log_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row: first and last timestamp of a log, seconds between them, and the last stated number of rules."""
    lines = spark.read.text(path)
    stamp = F.to_timestamp(F.regexp_extract("value", r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1), "yyyy-MM-dd HH:mm:ss")
    timed = lines.where(F.col("value").rlike(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d")).select(stamp.alias("at"))
    number = F.regexp_extract("value", r"(\d+)\s+rules", 1)
    stated = lines.where(F.col("value").rlike(r"\d+\s+rules")).select(number.cast("long").alias("n"), F.monotonically_increasing_id().alias("line"))
    rules = stated.agg(F.max_by("n", "line").alias("rules"))
    ends = timed.agg(F.min("at").alias("first"), F.max("at").alias("last"))
    return ends.crossJoin(rules).withColumn("seconds", F.unix_timestamp("last") - F.unix_timestamp("first"))  # one row each
