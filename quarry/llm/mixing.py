"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Weights go down a tree (domain, language, source): a node shares its budget among its children by weight, no child gets more
than its supply allows, and what a child lacks goes to its siblings; a node's own supply is that of its leaves, so a whole
family's shortage goes to the family's siblings in turn. Each leaf then takes a prefix of tokens in seeded order, epoch after
epoch. All amounts are whole tokens."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, stored

LEVELS = ("domain", "language", "origin")
#: Leaf plans are broadcast up to this many leaves (about 100 bytes each) and joined by shuffle beyond.
BROADCAST_LEAVES = 1 << 17
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    """weights: by level, the whole weight of each name among its siblings (others: 1; 0: nothing). budget_percent: of all
    tokens. max_epochs: how often a document may be taken."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    budget_percent: int = 60
    max_epochs: int = 2
    seed: int = 17


def words(text: Column) -> Column:
    """Tokens of a text, counted as words; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """Sources end in a number; four domains by it, and one for the rest."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), F.expr("pmod(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) as int), 4)").cast("string"))).otherwise("other")


def leaf_columns() -> dict[str, Column]:
    return {
        "domain": domain_of(F.col("source")),
        "language": F.coalesce("lang", F.lit("unknown")),
        "origin": F.coalesce("source", F.lit("unknown")),
    }


def _weight(level: str, params: MixParams) -> Column:
    named = params.weights.get(level, {})
    return F.coalesce(reduce(lambda c, kv: c.when(F.col(level) == kv[0], kv[1]), named.items(), F.when(F.lit(False), 0)), F.lit(1)).cast("long")


def share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes: parents, name, cap, weight, budget (of the parent, at most the sum of its caps). Adds grant: the budget shared by
    weight, no more than cap each. In order of cap / weight, a node is full if its cap is within its share of what the ones
    before it left; the rest share the remainder by weight, and odd tokens go one each by name."""
    group = Window.partitionBy(*parents)
    order = group.orderBy(F.col("cap") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    live = nodes.where(F.col("weight") > 0)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    full = live.withColumn("full", F.col("cap") * open_weight <= left * F.col("weight"))
    rest = full.withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0)))
    pool = F.sum(F.when(~F.col("full"), F.col("weight"))).over(group)
    part = rest.withColumn("pool", pool).withColumn("part", F.when(F.col("full"), F.lit(0)).otherwise(F.expr("(rest * weight) div pool")).cast("long"))
    odd = part.withColumn("odd", F.col("rest") - F.sum("part").over(group))
    rank = F.row_number().over(Window.partitionBy(*parents, "full").orderBy(name))
    grant = F.when(F.col("full"), F.col("cap")).otherwise(F.col("part") + F.when(rank <= F.col("odd"), 1).otherwise(0))
    done = odd.withColumn("grant", grant.cast("long")).drop("full", "rest", "part", "pool", "odd")
    return done.unionByName(nodes.where(F.col("weight") <= 0).withColumn("grant", F.lit(0).cast("long")))


def budgets(leaves: DataFrame, params: MixParams) -> DataFrame:
    """leaves: domain, language, origin, supply (tokens). Adds grant, in tokens. Nodes of weight 0 offer nothing upwards."""
    live = leaves
    for level in LEVELS:
        live = live.withColumn(f"w_{level}", _weight(level, params))
    open_leaf = (F.col("w_domain") > 0) & (F.col("w_language") > 0) & (F.col("w_origin") > 0)
    live = live.withColumn("cap", F.when(open_leaf, F.col("supply") * params.max_epochs).otherwise(0).cast("long"))
    total = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("all_tokens"))
    above = total.select(F.floor(F.col("all_tokens") * params.budget_percent / 100).cast("long").alias("grant"))
    parents: list[str] = []
    for level in LEVELS:
        nodes = live.groupBy(*parents, level).agg(F.sum("cap").alias("cap"), F.max(f"w_{level}").alias("weight"))
        if parents:
            nodes = nodes.join(above.select(*parents, F.col("grant").alias("budget")), parents)
        else:
            nodes = nodes.crossJoin(F.broadcast(above.select(F.col("grant").alias("budget"))))  # one row
        nodes = nodes.withColumn("budget", F.least("budget", F.sum("cap").over(Window.partitionBy(*parents))))
        above = share(nodes, parents, level)
        parents.append(level)
    return leaves.join(above.select(*LEVELS, "grant"), list(LEVELS))


def _order(epoch: Column, params: MixParams) -> Column:
    return F.md5(F.concat(F.lit(f"{params.seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def plan(docs: DataFrame, params: MixParams) -> tuple[DataFrame, int, int]:
    """One row per leaf: full (whole epochs taken), rest (tokens of the next epoch), bucket (where the next epoch's prefix ends,
    by leading digits of the order) and before (tokens in the buckets ahead of it); then the digits used, and the leaves."""
    light = stored(docs.select("doc_id", *(c.alias(n) for n, c in leaf_columns().items()), words(F.col("text")).alias("tokens")))
    leaves = light.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"), F.count("*").alias("rows"))
    granted = budgets(leaves, params).where(F.col("grant") > 0)
    granted = stored(granted.withColumn("full", F.expr("grant div supply")).withColumn("rest", F.col("grant") - F.col("full") * F.col("supply")))
    size = granted.agg(F.coalesce(F.max("rows"), F.lit(0)), F.count("*")).first()
    digits = 1
    while size[0] >> (4 * digits) > 1000 and digits < 7:
        digits += 1
    few = size[1] <= BROADCAST_LEAVES
    parts = granted.where(F.col("rest") > 0).select(*LEVELS, "full", "rest")
    coded = light.join(F.broadcast(parts) if few else parts, list(LEVELS)).withColumn("bucket", F.substring(_order(F.col("full"), params), 1, digits))
    sums = coded.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    through = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    ends = sums.withColumn("through", through).withColumn("before", F.col("through") - F.col("tokens"))
    ends = ends.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("through"))).select(*LEVELS, "bucket", "before")
    leaf_plan = stored(granted.join(ends, list(LEVELS), "left").select(*LEVELS, "full", "rest", "bucket", "before"))
    discard(light, granted)
    return leaf_plan, digits, size[1]


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The rows taken: every column of docs, then domain, language, origin, epoch, tokens, take_tokens (all of tokens, but for
    the document that a leaf's budget ends in). Columns of those names in docs are replaced.

    Null lang and source are the leaf "unknown"; null and empty texts have no tokens, come along in whole epochs and, like
    others, in the prefix of a partial one if they stand before its end. A null id has an order of its own; repeated rows
    count as often as they stand there. A leaf's rows meet in no task: only those of the bucket that a prefix ends in do."""
    leaf_plan, digits, leaves = plan(docs, params)
    own = docs.drop(*LEVELS, "epoch", "tokens", "take_tokens")
    names = [n for n in own.columns]
    keyed = own.withColumns({f"__{n}": c for n, c in leaf_columns().items()})
    ahead = leaf_plan.select(*(F.col(n).alias(f"__{n}") for n in LEVELS), *(F.col(n).alias(f"__{n}") for n in ("full", "rest", "bucket", "before")))
    keyed = keyed.join(F.broadcast(ahead) if leaves <= BROADCAST_LEAVES else ahead, [f"__{n}" for n in LEVELS])
    keyed = keyed.withColumn("__order", _order(F.col("__full"), params))
    here = F.substring("__order", 1, digits)

    whole = F.when(F.col("__full") > 0, F.sequence(F.lit(0).cast("long"), F.col("__full") - 1)).otherwise(F.array().cast("array<bigint>"))
    also = F.when(F.coalesce(here < F.col("__bucket"), F.lit(False)), F.array("__full")).otherwise(F.array().cast("array<bigint>"))
    plain = keyed.withColumn("__epochs", F.concat(whole, also)).where(F.size("__epochs") > 0)
    plain = plain.withColumn("__tokens", words(F.col("text"))).withColumn("__take", F.col("__tokens")).withColumn("__epoch", F.explode("__epochs"))

    edge = keyed.where(here == F.col("__bucket")).withColumn("__tokens", words(F.col("text")))
    ordered = Window.partitionBy(*(f"__{n}" for n in LEVELS)).orderBy("__order", "__tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("__start", F.col("__before") + F.coalesce(F.sum("__tokens").over(ordered), F.lit(0)))
    edge = edge.where(F.col("__start") < F.col("__rest")).withColumn("__take", F.least("__tokens", F.col("__rest") - F.col("__start"))).withColumn("__epoch", F.col("__full"))

    out = [*names, *(F.col(f"__{n}").alias(n) for n in (*LEVELS, "epoch", "tokens")), F.col("__take").alias("take_tokens")]
    return plain.select(*out).unionByName(edge.select(*out))


def taken(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The rows of mix() in the columns of docs: the text of a document that a leaf's budget ends in is cut behind its
    take_tokens-th word, and n_chars, where there is one, set to what is left."""
    cut = F.col("take_tokens") < F.col("tokens")
    ahead = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    out = mix(docs, params).withColumn("text", F.when(cut, F.array_join(F.slice(ahead, 1, F.col("take_tokens").cast("int")), "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


#: The query's targets: domains 4 : 3 : 2 : 1, languages 5 : 2 : 2 : 1, the hot source half of each other one.
QUERY = MixParams(
    weights={
        "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
        "language": {"en": 5, "de": 2, "fr": 2, "es": 1},
        "origin": {"src0": 1, **{f"src{i}": 2 for i in range(1, 20)}},
    }
)


def mixed(docs: DataFrame, params: MixParams = QUERY) -> DataFrame:
    """The digest of mix(): doc_id, domain, language, origin, epoch, tokens, take_tokens."""
    return mix(docs.select("doc_id", "text", "lang", "source"), params).select("doc_id", *LEVELS, "epoch", "tokens", "take_tokens")


def sql(params: MixParams = QUERY) -> str:
    """DuckDB SQL for mixed()."""

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in params.weights.get(level, {}).items())
        return f"CASE {level} {cases} ELSE 1 END" if cases else "1"

    def step(level: str, parents: list[str], above: str) -> str:
        keys = ", ".join(parents)
        by = f"PARTITION BY {keys}" if parents else ""
        join = f"JOIN {above} USING ({keys})" if parents else f"CROSS JOIN {above}"
        cols = ", ".join([*parents, level])
        return f"""
n_{level} AS (SELECT {cols}, cap, weight, least(granted, sum(cap) OVER ({by})) AS budget
  FROM (SELECT {cols}, sum(cap) AS cap, max(w_{level}) AS weight FROM caps GROUP BY {cols}) {join}),
f_{level} AS (SELECT *, cap * (sum(weight) OVER ({by}) - coalesce(sum(weight) OVER o, 0)) <= (budget - coalesce(sum(cap) OVER o, 0)) * weight AS is_full
  FROM n_{level} WHERE weight > 0 WINDOW o AS ({by} ORDER BY cap::DOUBLE / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r_{level} AS (SELECT *, budget - coalesce(sum(cap) FILTER (is_full) OVER ({by}), 0) AS rest, sum(weight) FILTER (NOT is_full) OVER ({by}) AS pool FROM f_{level}),
p_{level} AS (SELECT *, CASE WHEN is_full THEN 0 ELSE (rest * weight) // pool END AS part FROM r_{level}),
q_{level} AS (SELECT *, rest - sum(part) OVER ({by}) AS odd, row_number() OVER (PARTITION BY {', '.join([*parents, 'is_full'])} ORDER BY {level}) AS nth FROM p_{level}),
g_{level} AS (SELECT {cols}, CASE WHEN is_full THEN cap ELSE part + CASE WHEN nth <= odd THEN 1 ELSE 0 END END::BIGINT AS granted FROM q_{level})"""

    order = f"md5(concat('{params.seed}:', e, ':', coalesce(doc_id::VARCHAR, 'null')))"
    return f"""
WITH docs AS (SELECT doc_id, CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) <> '' THEN concat('d', TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER) % 4) ELSE 'other' END AS domain,
    coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS origin, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, language, origin, sum(tokens)::BIGINT AS supply FROM docs GROUP BY ALL),
weighted AS (SELECT *, {weight('domain')} AS w_domain, {weight('language')} AS w_language, {weight('origin')} AS w_origin FROM leaves),
caps AS (SELECT *, CASE WHEN least(w_domain, w_language, w_origin) > 0 THEN supply * {params.max_epochs} ELSE 0 END AS cap FROM weighted),
g_root AS (SELECT floor(sum(supply) * {params.budget_percent} / 100)::BIGINT AS granted FROM leaves),
{','.join(step(level, list(LEVELS[:i]), f"g_{('root', *LEVELS)[i]}") for i, level in enumerate(LEVELS))},
leafplan AS (SELECT domain, language, origin, granted // supply AS full_epochs, granted - (granted // supply) * supply AS rest FROM g_origin JOIN leaves USING (domain, language, origin) WHERE granted > 0),
whole AS (SELECT doc_id, domain, language, origin, unnest(range(full_epochs)) AS epoch, tokens, tokens AS take_tokens FROM docs JOIN leafplan USING (domain, language, origin)),
ordered AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY h, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at
  FROM (SELECT *, {order} AS h FROM (SELECT *, full_epochs AS e FROM docs JOIN leafplan USING (domain, language, origin) WHERE rest > 0)))
SELECT doc_id, domain, language, origin, epoch::BIGINT AS epoch, tokens, take_tokens FROM whole
UNION ALL
SELECT doc_id, domain, language, origin, e::BIGINT, tokens, least(tokens, rest - start_at)::BIGINT FROM ordered WHERE start_at < rest"""
