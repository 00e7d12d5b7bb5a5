"""Rule sets against each other: matching, coverage, completeness, precision and recall. Inputs have a row per rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_table(name: Column) -> Column:
    """Lower case without occurrence marks: every _0 goes."""
    return F.lower(F.replace(name, F.lit("_0"), F.lit("")))


def tables_match(left: Column, right: Column, least: float = 0.8, by: str = "smaller") -> Column:
    """Whether two arrays of tables share at least that part of the smaller (or larger) one."""
    size = (F.least if by == "smaller" else F.greatest)(F.size(F.array_distinct(left)), F.size(F.array_distinct(right)))
    return (size > 0) & (F.size(F.array_intersect(left, right)) >= least * size)


def joinable(body: Column, head: Column, is_inclusion: Column) -> Column:
    """Inclusions always; else body and head share a variable."""
    return is_inclusion | F.coalesce(F.arrays_overlap(body, head), F.lit(False))


def _matches(own: DataFrame, other: DataFrame, least: float) -> DataFrame:
    """(own id, other id) of rules that match: an inclusion matches if both its tables are in the rule, others by shared tables.
    Candidates come from an equi-join on a table name, so only rules that share one are compared."""
    a = own.select(F.col("rule_id").alias("own"), F.transform("tables", normal_table).alias("t"), F.col("inclusion").alias("i"))
    b = other.select(F.col("rule_id").alias("other"), F.transform("tables", normal_table).alias("u"), F.col("inclusion").alias("j"))
    near = a.withColumn("k", F.explode(F.array_distinct("t"))).join(b.withColumn("k", F.explode(F.array_distinct("u"))), "k")
    held = F.when(F.col("j"), F.size(F.array_except("u", "t")) == 0).when(F.col("i"), F.size(F.array_except("t", "u")) == 0)
    return near.where(held.otherwise(tables_match(F.col("t"), F.col("u"), least))).select("own", "other").distinct()


def completeness(own: DataFrame, other: DataFrame, least: float = 0.8) -> DataFrame:
    """One row: joinable others, matched ones, and their share. own, other: rule_id, tables, body_vars, head_vars, inclusion."""
    wanted = other.where(joinable(F.col("body_vars"), F.col("head_vars"), F.col("inclusion")))
    hit = _matches(own, wanted, least).select(F.col("other").alias("rule_id")).distinct().withColumn("hit", F.lit(1))
    counts = wanted.join(hit, "rule_id", "left").agg(F.count("*").alias("joinable"), F.count("hit").alias("matched"))
    return counts.withColumn("completeness", F.when(F.col("joinable") > 0, F.col("matched") / F.col("joinable")).otherwise(0.0))


def greedy_coverage(own: DataFrame, other: DataFrame, least: float = 0.8) -> tuple[list[tuple[str, str]], float]:
    """Each own rule, in order of id, takes the first other rule that matches and is free; the pairs and the others' share.
    Order-dependent, so it runs on the driver over ids of matching rules: rule sets, not data."""
    taken, found, done = set(), [], None
    for r in _matches(own, other, least).orderBy("own", "other").toLocalIterator():  # a partition at a time
        if r["own"] != done and r["other"] not in taken:
            taken.add(r["other"])
            found.append((r["own"], r["other"]))
            done = r["own"]
    total = other.count()
    return found, len(found) / total if total else 0.0


def compared(own: DataFrame, other: DataFrame, keys: list[str], numbers: dict[str, float] | None = None) -> DataFrame:
    """other with matched: whether a rule of own has equal keys (null-safe) and numbers within their tolerances."""
    left = other.select(*other.columns, F.monotonically_increasing_id().alias("__id"))
    right = own.select(*(F.col(c).alias(f"__{c}") for c in [*keys, *(numbers or {})]))
    condition = F.lit(True)
    for k in keys:
        condition &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    for c, most in (numbers or {}).items():
        condition &= F.abs(F.col(c) - F.col(f"__{c}")) <= most
    hit = left.join(right, condition, "left_semi").select("__id").withColumn("matched", F.lit(True))
    return left.join(hit, "__id", "left").withColumn("matched", F.coalesce("matched", F.lit(False))).drop("__id")


def coverage_summary(matched: DataFrame) -> DataFrame:
    """One row from compared(): coverage over all rules and over those both correct and compatible (1 if there are none)."""
    good = F.col("correct") & F.col("compatible")
    counts = matched.agg(
        F.count("*").alias("n"), F.count_if("matched").alias("hits"), F.count_if(good).alias("n_good"), F.count_if(good & F.col("matched")).alias("hits_good")
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    return counts.select(share("hits", "n").alias("coverage_all"), share("hits_good", "n_good").alias("coverage_good"))


def precision_recall(found: DataFrame, truth: DataFrame, key: str = "signature") -> DataFrame:
    """One row: true_positives, false_positives, false_negatives, precision, recall, f1 of distinct normalised signatures."""
    plain = lambda df: df.select(F.lower(F.trim(key)).alias("s")).where(F.col("s").isNotNull()).distinct()
    both = plain(found).withColumn("f", F.lit(1)).join(plain(truth).withColumn("t", F.lit(1)), "s", "full_outer")
    hit, extra, missed = (F.count_if(c) for c in (F.col("f").isNotNull() & F.col("t").isNotNull(), F.col("t").isNull(), F.col("f").isNull()))
    counts = both.agg(hit.alias("true_positives"), extra.alias("false_positives"), missed.alias("false_negatives"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    return counts.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def horn_compatible(rules: DataFrame, compatible: DataFrame) -> DataFrame:
    """rules: rule_id, body (array of relations), head (array of relations), compared place by place; adds compatible: whether every
    pair is among the compatible ones (left, right, either way round)."""
    either = compatible.select("left", "right").unionByName(compatible.select(F.col("right").alias("left"), F.col("left").alias("right"))).distinct()
    pairs = rules.select("rule_id", F.inline(F.arrays_zip("body", "head"))).where(F.col("body").isNotNull() & F.col("head").isNotNull())
    bad = pairs.join(either, (F.col("body") == F.col("left")) & (F.col("head") == F.col("right")), "left_anti").select("rule_id").distinct()
    return rules.join(bad.withColumn("bad", F.lit(True)), "rule_id", "left").withColumn("compatible", F.col("bad").isNull()).drop("bad")


def clause_compatible(predicates: DataFrame, compatible: DataFrame) -> DataFrame:
    """predicates: rule_id, relation, variable, one row per argument; gives rule_id, compatible: whether each two relations that
    share a variable are compatible. A rule's arguments are a few, so its pairs are too."""
    either = compatible.select("left", "right").unionByName(compatible.select(F.col("right").alias("left"), F.col("left").alias("right"))).distinct()
    a = predicates.select("rule_id", "variable", F.col("relation").alias("r1")).distinct()
    b = predicates.select("rule_id", "variable", F.col("relation").alias("r2")).distinct()
    pairs = a.join(b, ["rule_id", "variable"]).where(F.col("r1") < F.col("r2"))
    bad = pairs.join(either, (F.col("r1") == F.col("left")) & (F.col("r2") == F.col("right")), "left_anti").select("rule_id").distinct().withColumn("bad", F.lit(True))
    return predicates.select("rule_id").distinct().join(bad, "rule_id", "left").select("rule_id", F.col("bad").isNull().alias("compatible"))


def transitively_compatible(compatible: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (left, right) with compatible: whether right is reached from left by compatible pairs, either way round, or is it. A
    round extends what is reached by one pair, from the wanted lefts only; rounds are as many as the longest shortest path.
    Relations are schema-sized, so what is reached has columns squared rows at most."""
    either = compatible.select("left", "right").unionByName(compatible.select(F.col("right").alias("left"), F.col("left").alias("right"))).distinct().persist()
    reached = wanted.select("left", F.col("left").alias("right")).distinct().persist()
    before = -1
    while (size := reached.count()) != before:
        before = size
        step = reached.join(either.select(F.col("left").alias("right"), F.col("right").alias("next")), "right").select("left", F.col("next").alias("right"))
        grown = reached.unionByName(step).distinct().persist()
        grown.count()
        reached.unpersist()
        reached = grown
    either.unpersist()
    found = reached.withColumn("hit", F.lit(True))
    return wanted.join(found, ["left", "right"], "left").select(*wanted.columns, F.coalesce("hit", F.lit(False)).alias("compatible"))


#: A rule of one variable and one atom on each side, as rules.display() writes it.
_ONE_VARIABLE = r"^∀ (\w+): (\w+)_\d+\((\w+)=\1\) ⇒ (\w+)_\d+\((\w+)=\1\)$"


def as_inclusions(rules: DataFrame, text: str = "rule") -> DataFrame:
    """rules that state an inclusion, with dependant and referenced ("table.column"); others have no row."""
    own = rules.where(F.col(text).rlike(_ONE_VARIABLE))
    part = lambda i: F.regexp_extract(text, _ONE_VARIABLE, i)
    return own.withColumns({"dependant": F.concat_ws(".", part(2), part(3)), "referenced": F.concat_ws(".", part(4), part(5))})


def miner_overlap(own: DataFrame, other: DataFrame, least: float = 0.8) -> DataFrame:
    """own_id, other_id, similarity: rules of two miners (rule_id, tables) whose tables are shared by that part of the larger set or
    more. Only rules that share a table meet."""
    a = own.select(F.col("rule_id").alias("own_id"), F.array_distinct(F.transform("tables", normal_table)).alias("t"))
    b = other.select(F.col("rule_id").alias("other_id"), F.array_distinct(F.transform("tables", normal_table)).alias("u"))
    met = a.withColumn("k", F.explode("t")).join(b.withColumn("k", F.explode("u")), "k").drop("k")
    share = F.size(F.array_intersect("t", "u")) / F.greatest(F.size("t"), F.size("u"))
    return met.select("own_id", "other_id", share.alias("similarity")).where(F.col("similarity") >= least).distinct()


def inclusion_overlap(inclusions: DataFrame, rules: DataFrame, text: str = "rule") -> DataFrame:
    """The inclusions (dependant, referenced) that a rule of one variable states as well."""
    stated = as_inclusions(rules, text).select("dependant", "referenced").distinct()
    return inclusions.join(stated, ["dependant", "referenced"], "left_semi")
