"""Tables as subject-predicate-object triples, and Horn rules over them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.catalog import Catalog, canon


def sanitised(text: Column) -> Column:
    """Anything but letters and digits becomes an underscore."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "_")


def triples(catalog: Catalog, fk_object: str = "value") -> DataFrame:
    """subject, predicate, object of every table with a primary key and more than one column. A row with a null key gives none,
    nulls and key columns give none, unless the column is a foreign key: then the object is the referenced row's subject.
    fk_object="reference" builds that object from the local column named like the referenced one, and skips without such."""
    if fk_object not in ("value", "reference"):
        raise ValueError("fk_object is value or reference")
    parts = []
    for table, df in catalog.tables.items():
        keys = catalog.constraints.primary.get(table, ())
        if not keys or len(df.columns) < 2:
            continue
        text = {f.name: canon(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
        present = reduce(Column.__and__, (F.col(f"`{k}`").isNotNull() for k in keys))
        subject = sanitised(F.concat_ws("_", F.lit(table), *(text[k] for k in keys)))
        cells = []
        for column in df.columns:
            target = catalog.constraints.foreign.get((table, column))
            predicate = F.lit(f"{table}.{column}")
            if target:
                value = text[column] if fk_object == "value" else text.get(target[1])
                if value is not None:
                    cells.append(F.struct(predicate.alias("predicate"), F.when(value.isNotNull(), sanitised(F.concat_ws("_", F.lit(target[0]), value))).alias("object")))
            elif column not in keys:
                literal = F.concat(F.lit('"'), F.replace(text[column], F.lit('"'), F.lit('\\"')), F.lit('"'))
                cells.append(F.struct(predicate.alias("predicate"), literal.alias("object")))
        if cells:
            rows = df.where(present).select(subject.alias("subject"), F.inline(F.array(*cells)))
            parts.append(rows.where(F.col("object").isNotNull()))
    if not parts:
        raise ValueError("no table has a primary key and another column")
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Atom:
    relation: str
    first: str
    second: str


@dataclass(frozen=True)
class Horn:
    """body implies head(x, y) of its first and second variable."""

    head: Atom
    body: tuple[Atom, ...]

    def __str__(self) -> str:
        show = lambda a: f"{a.relation}({a.first},{a.second})"
        return f"{' & '.join(map(show, self.body))} => {show(self.head)}"


def _atom(facts: DataFrame, atom: Atom) -> DataFrame:
    own = facts.where(F.col("predicate") == atom.relation)
    if atom.first == atom.second:
        return own.where(F.col("subject") == F.col("object")).select(F.col("subject").alias(atom.first)).distinct()
    return own.select(F.col("subject").alias(atom.first), F.col("object").alias(atom.second)).distinct()


def body_pairs(facts: DataFrame, rule: Horn) -> DataFrame:
    """Distinct values of the head's variables that satisfy the body; a variable is dropped, and rows made distinct, as soon as
    no atom to come needs it."""
    wanted = [rule.head.first, rule.head.second]
    atoms, out = list(rule.body), None
    while atoms:
        at = next((i for i, a in enumerate(atoms) if out is None or {a.first, a.second} & set(out.columns)), None)
        if at is None:
            raise ValueError(f"{rule} isn't connected")
        part = _atom(facts, atoms.pop(at))
        out = part if out is None else out.join(part, [c for c in part.columns if c in out.columns])
        needed = set(wanted) | {v for a in atoms for v in (a.first, a.second)}
        out = out.select(*[c for c in out.columns if c in needed]).distinct()
    if not set(wanted) <= set(out.columns):
        raise ValueError(f"{rule} isn't closed: the body leaves a head variable open")
    return out.select(*dict.fromkeys(wanted))


def horn_measures(facts: DataFrame, rules: list[Horn]) -> DataFrame:
    """rule, support, body_size, pca_size, head_size, head_coverage, confidence, pca_confidence. Facts of a relation are read once
    for all rules that have it: sizes of heads come from one grouping."""
    parts = []
    sizes = facts.select("predicate", "subject", "object").distinct().groupBy("predicate").agg(F.count("*").alias("head_size"))
    for rule in rules:
        x, y = rule.head.first, rule.head.second
        head, body = _atom(facts, rule.head), body_pairs(facts, rule)
        flagged = body.join(head.withColumn("hit", F.lit(1)), [x, y], "left").join(head.select(x).distinct().withColumn("known", F.lit(1)), x, "left")
        counts = flagged.agg(F.count("*").alias("body_size"), F.count("hit").alias("support"), F.count("known").alias("pca_size"))
        parts.append(counts.select(F.lit(str(rule)).alias("rule"), F.lit(rule.head.relation).alias("predicate"), "support", "body_size", "pca_size"))
    counted = reduce(DataFrame.unionByName, parts).join(F.broadcast(sizes), "predicate", "left").withColumn("head_size", F.coalesce("head_size", F.lit(0)))  # a row per relation
    share = lambda b: F.when(F.col(b) > 0, F.col("support") / F.nullif(F.col(b), F.lit(0))).otherwise(0.0)
    return counted.select(
        "rule", "support", "body_size", "pca_size", "head_size",
        share("head_size").alias("head_coverage"), share("body_size").alias("confidence"), share("pca_size").alias("pca_confidence"),
    )


def horn_candidates(relations: list[str], length: int = 2) -> list[Horn]:
    """Connected, closed rules with length - 1 body atoms (1 or 2) over the relations; none restates its head."""
    out = []
    for head in relations:
        h = Atom(head, "x", "y")
        for p in relations:
            out += [Horn(h, (a,)) for a in (Atom(p, "x", "y"), Atom(p, "y", "x")) if a != h]
            for q in relations if length > 2 else ():
                out += [Horn(h, (a, b)) for a in (Atom(p, "x", "z"), Atom(p, "z", "x")) for b in (Atom(q, "z", "y"), Atom(q, "y", "z"))]
    return out


def mine_horn(facts: DataFrame, length: int = 2, min_support: int = 1, min_coverage: float = 0.0) -> DataFrame:
    """The measures of all rules of horn_candidates() over the facts' relations that reach the thresholds; relations are schema-sized.

    All rules are measured at once, not one by one: facts are turned both ways, bodies are what one of them, or two end to end,
    lead from x to y, and their pairs meet the heads' facts once by (x, y), for support, and once by x, for what is known."""
    spark = facts.sparkSession
    held = facts.select("subject", "predicate", "object").distinct().persist()
    try:
        relations = sorted(r["predicate"] for r in held.select("predicate").distinct().collect())
        rules = horn_candidates(relations, length)
        schema = "rule string, support long, body_size long, pca_size long, head_size long, head_coverage double, confidence double, pca_confidence double"
        if not rules:
            return spark.createDataFrame([], schema)

        def turned(first: str, second: str) -> DataFrame:
            """body, from, to: every fact under the text of its atom from first to second, and from second to first."""
            atom = lambda a, b: F.concat("predicate", F.lit(f"({a},{b})"))
            ways = F.array(*(F.struct(atom(a, b).alias("body"), F.col(c).alias("from"), F.col(d).alias("to")) for a, b, c, d in ((first, second, "subject", "object"), (second, first, "object", "subject"))))
            return held.select(F.inline(ways))

        pairs = turned("x", "y").select("body", F.col("from").alias("x"), F.col("to").alias("y"))
        if length > 2:
            left = turned("x", "z").select(F.col("body").alias("a"), F.col("from").alias("x"), F.col("to").alias("z"))
            right = turned("z", "y").select(F.col("body").alias("b"), F.col("from").alias("z"), F.col("to").alias("y"))
            pairs = pairs.unionByName(left.join(right, "z").select(F.concat_ws(" & ", "a", "b").alias("body"), "x", "y"))
        pairs = pairs.distinct().persist()
        heads = held.select(F.col("predicate").alias("head"), F.col("subject").alias("x"), F.col("object").alias("y"))
        key = ["body", "head"]
        support = pairs.join(heads, ["x", "y"]).groupBy(*key).agg(F.count("*").alias("support"))
        known = pairs.join(heads.select("head", "x").distinct(), "x").groupBy(*key).agg(F.count("*").alias("pca_size"))
        wanted = spark.createDataFrame([(str(r), str(r).split(" => ")[0], r.head.relation) for r in rules], "rule string, body string, head string")
        found = (
            wanted.join(support, key, "left").join(known, key, "left")
            .join(pairs.groupBy("body").agg(F.count("*").alias("body_size")), "body", "left")
            .join(heads.groupBy("head").agg(F.count("*").alias("head_size")), "head", "left")
        )
        counts = found.select("rule", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "body_size", "pca_size", "head_size")))
        share = lambda c: F.when(F.col(c) > 0, F.col("support") / F.nullif(F.col(c), F.lit(0))).otherwise(0.0)
        measured = counts.withColumns({"head_coverage": share("head_size"), "confidence": share("body_size"), "pca_confidence": share("pca_size")})
        kept = measured.where((F.col("support") >= min_support) & (F.col("head_coverage") >= min_coverage)).collect()  # a row per rule
        pairs.unpersist()
    finally:
        held.unpersist()
    return spark.createDataFrame(kept, schema)


def constant_rules(facts: DataFrame, min_support: int = 2) -> DataFrame:
    """body_predicate, body_object, head_predicate, head_object, support, body_size, confidence: subjects with one fact that have
    another one as well, with constants. A subject's facts are as many as its columns, so pairs are bounded by the schema;
    facts too rare to reach the support are left out before any pair is made."""
    facts = facts.select("subject", "predicate", "object").distinct()
    sizes = facts.groupBy("predicate", "object").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)
    common = facts.join(sizes, ["predicate", "object"])
    body = common.select("subject", F.col("predicate").alias("body_predicate"), F.col("object").alias("body_object"), F.col("n").alias("body_size"))
    head = common.select("subject", F.col("predicate").alias("head_predicate"), F.col("object").alias("head_object"))
    both = body.join(head, "subject").where(F.col("body_predicate") != F.col("head_predicate"))
    keys = ["body_predicate", "body_object", "head_predicate", "head_object"]
    found = both.groupBy(*keys).agg(F.count("*").alias("support"), F.max("body_size").alias("body_size"))
    return found.where(F.col("support") >= min_support).withColumn("confidence", F.col("support") / F.col("body_size"))


def path_rules(facts: DataFrame, length: int = 2, min_support: int = 2, sample: float | None = None, seed: int = 0) -> DataFrame:
    """rule, support, body_size, confidence: head(X, c) by a path of facts that begins at X and ends in a constant d, of up to
    length steps (1 or 2), as subjects with and without the head. A second step goes through the object that the first ends in,
    from its own facts. sample: the share of subjects that paths begin at, by seed; all facts may continue them.

    An entity's own facts are as many as its columns, so a path's continuations are bounded by the schema; path ends and heads
    rarer than min_support are left out before they meet."""
    if length not in (1, 2):
        raise ValueError("length is 1 or 2")
    facts = facts.select("subject", "predicate", "object").distinct()
    begins = facts if sample is None else facts.where(F.pmod(F.xxhash64("subject", F.lit(seed)), F.lit(1 << 20)) < int(sample * (1 << 20)))
    ends = [begins.select("subject", F.concat(F.col("predicate"), F.lit("(X,"), F.col("object"), F.lit(")")).alias("body"))]
    if length == 2:
        second = facts.select(F.col("subject").alias("node"), F.col("predicate").alias("next"), F.col("object").alias("end"))
        long = begins.withColumnRenamed("object", "node").join(second, "node").where(F.col("end") != F.col("subject"))
        body = F.concat(F.col("predicate"), F.lit("(X,A), "), F.col("next"), F.lit("(A,"), F.col("end"), F.lit(")"))
        ends.append(long.select("subject", body.alias("body")))
    bodies = reduce(DataFrame.unionByName, ends).distinct()
    common = bodies.join(bodies.groupBy("body").agg(F.count("*").alias("body_size")).where(F.col("body_size") >= min_support), "body")
    heads = begins.select("subject", F.concat(F.col("predicate"), F.lit("(X,"), F.col("object"), F.lit(")")).alias("head"))
    wanted = heads.join(heads.groupBy("head").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_support).drop("__n"), "head")
    met = common.join(wanted, "subject").where((F.col("head") != F.col("body")) & ~F.startswith("body", F.concat(F.substring_index("head", ",", 1), F.lit(","))))
    found = met.groupBy("head", "body").agg(F.count("*").alias("support"), F.max("body_size").alias("body_size")).where(F.col("support") >= min_support)
    return found.select(F.concat_ws(" <= ", "head", "body").alias("rule"), "support", "body_size", (F.col("support") / F.col("body_size")).alias("confidence"))
