"""Rules that cover examples: every row of a head table is an example, a body is a chain of semi-joins, and a small set of
bodies that covers most examples is chosen greedily."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.catalog import Catalog, Constraints, canon

#: A body literal: local column, table, its column; or a further step from a table that stands there already.
Literal = tuple[str, str, str]


def examples(catalog: Catalog, table: str) -> DataFrame:
    """The table's distinct rows with a key, example, that follows from their values; a null is a value of its own there."""
    df = catalog[table].distinct()
    fields = F.struct(*(canon(F.col(f"`{f.name}`"), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema.fields)))
    return df.withColumn("example", F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256))


def covered(catalog: Catalog, table: str, bodies: dict[str, list[Literal]]) -> DataFrame:
    """body, example: the examples that satisfy every literal of a body."""
    base = examples(catalog, table)
    parts = []
    for name, literals in bodies.items():
        rows = base
        for own, other, key in literals:
            rows = rows.join(catalog[other].select(F.col(key).alias(own)).where(F.col(own).isNotNull()).distinct(), own, "left_semi")
        parts.append(rows.select(F.lit(name).alias("body"), "example"))
    return reduce(DataFrame.unionByName, parts)


def coverage(catalog: Catalog, table: str, bodies: dict[str, list[Literal]]) -> DataFrame:
    """body, literals, covered, uncovered, of all the head table's distinct rows."""
    total = examples(catalog, table).agg(F.count("*").alias("total"))
    sizes = F.create_map(*(x for n, b in bodies.items() for x in (F.lit(n), F.lit(len(b)))))
    names = catalog[table].sparkSession.createDataFrame([(n,) for n in bodies], "body string")
    counts = covered(catalog, table, bodies).groupBy("body").agg(F.count("*").alias("covered"))
    full = names.join(counts, "body", "left").crossJoin(total)  # one row
    hit = F.coalesce("covered", F.lit(0))
    return full.select("body", sizes[F.col("body")].alias("literals"), hit.alias("covered"), (F.col("total") - hit).alias("uncovered"))


def bodies_for(catalog: Catalog, table: str, pairs: list[tuple[str, str]], max_literals: int = 2) -> dict[str, list[Literal]]:
    """Bodies of at most max_literals joins from the table's columns to compatible columns of other tables."""
    steps = []
    for a, b in pairs:
        for left, right in ((a, b), (b, a)):
            (t, c), (o, k) = left.split(".", 1), right.split(".", 1)
            if t == table and o != table:
                steps.append((c, o, k))
    steps = sorted(set(steps))
    return {" & ".join(f"{o}.{k}={c}" for c, o, k in own): list(own) for n in range(1, max_literals + 1) for own in combinations(steps, n)}


def greedy_cover(coverage_rows: DataFrame, literals: dict[str, int], most: int = 10) -> list[tuple[str, int]]:
    """Bodies, with the examples each adds, chosen by added examples per literal until nothing is added. A round counts and
    removes in Spark; the driver sees one row per body."""
    left, chosen = coverage_rows.distinct().persist(), []
    try:
        for _ in range(most):
            gains = [(r["body"], r["n"]) for r in left.groupBy("body").agg(F.count("*").alias("n")).collect()]
            if not gains:
                break
            body, gain = max(gains, key=lambda g: (g[1] / literals[g[0]], -literals[g[0]], g[0]))
            chosen.append((body, gain))
            done = left.where(F.col("body") == body).select("example")
            rest = left.join(done, "example", "left_anti").persist()
            rest.count()
            left.unpersist()
            left = rest
    finally:
        left.unpersist()
    return chosen


def learn(
    catalog: Catalog, table: str, pairs: list[tuple[str, str]], max_literals: int = 2, most: int = 10, excluded: DataFrame | None = None
) -> tuple[list[tuple[str, int]], dict[str, int]]:
    """Bodies for the rows of table, chosen greedily from those that cover examples, and how many were tried and pruned. Bodies are
    generated by size; one that covers nothing has no larger one (more literals cover no more), and one that covers what a
    part of it covers adds nothing and is not grown. excluded: rows of table's columns that a body may not cover (it is still
    grown, as more literals may leave them out); a size's bodies are counted in one job."""
    steps = sorted({s for body in bodies_for(catalog, table, pairs, 1).values() for s in body})
    facts = {"tried": 0, "empty": 0, "subsumed": 0, "inconsistent": 0}
    name = lambda body: " & ".join(f"{o}.{k}={c}" for c, o, k in body)
    alive: dict[tuple, int] = {(): examples(catalog, table).count()}
    kept: dict[str, list[Literal]] = {}
    wrong: set[str] = set()
    against = Catalog({**catalog.tables, table: excluded.select(*catalog[table].columns)}, Constraints()) if excluded is not None else None
    for size in range(1, max_literals + 1):
        bodies = [b for b in combinations(steps, size) if all(part in alive for part in combinations(b, size - 1))]
        if not bodies:
            break
        named = {name(b): list(b) for b in bodies}
        counts = {r["body"]: r["covered"] for r in coverage(catalog, table, named).collect()}  # a row per body
        if against is not None:
            wrong |= {r["body"] for r in coverage(against, table, named).collect() if r["covered"]}
        facts["tried"] += len(bodies)
        for body in bodies:
            n, same = counts[name(body)], [p for p in combinations(body, size - 1) if p and alive[p] == counts[name(body)]]
            if not n:
                facts["empty"] += 1
            elif any(name(p) not in wrong or name(body) in wrong for p in same):
                facts["subsumed"] += 1
            else:
                alive[body] = n
                if name(body) in wrong:
                    facts["inconsistent"] += 1
                else:
                    kept[name(body)] = list(body)
    if not kept:
        return [], facts
    return greedy_cover(covered(catalog, table, kept), {n: len(b) for n, b in kept.items()}, most), facts


def prolog_name(text: Column, lossy: bool = False) -> Column:
    """A constant's name: integers stay; else lower case letters, digits and underscores (lossy: letters alone, which makes T1 and
    T10 one); an empty name is an underscore."""
    kept = F.lower(F.regexp_replace(text, "[^A-Za-z]" if lossy else "[^A-Za-z0-9_]", ""))
    return F.when(text.rlike(r"^-?\d+$"), text).when(kept == "", "_").otherwise(kept)


def prolog_facts(catalog: Catalog, table: str, lossy: bool = False) -> DataFrame:
    """line: a fact per row."""
    df = catalog[table]
    arguments = [prolog_name(F.coalesce(F.col(c).cast("string"), F.lit("")), lossy) for c in df.columns]
    return df.select(F.concat(F.lit(table.lower() + "("), F.concat_ws(",", *arguments), F.lit(").")).alias("line"))


def prolog_problem(catalog: Catalog, head: str, folder: str, max_body: int | None = None, lossy: bool = False) -> None:
    """Writes exs (positive examples), bk (facts of the other tables) and bias, as folders of text."""
    facts = prolog_facts(catalog, head, lossy).select(F.concat(F.lit("pos("), F.regexp_replace("line", r"\.$", ""), F.lit(").")).alias("value"))
    facts.write.mode("overwrite").text(f"{folder}/exs")
    others = [t for t in catalog.tables if t != head]
    if others:
        reduce(DataFrame.unionByName, (prolog_facts(catalog, t, lossy) for t in others)).write.mode("overwrite").text(f"{folder}/bk")
    lines = [f"head_pred({head.lower()},{len(catalog[head].columns)})."]
    lines += [f"body_pred({t.lower()},{len(catalog[t].columns)})." for t in others]
    lines += [f"max_body({max_body or max(3, len(catalog.tables) - 1)})."]
    catalog[head].sparkSession.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/bias")
