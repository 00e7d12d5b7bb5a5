"""The relational queries by name, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import ranks, reports, rules, stats
from quarry.operators import coverage, ilp, kernel, values
from quarry.operators import triples as facts
from quarry.operators.triples import Atom, Horn
from quarry.plans import discovery
from quarry.plans.discovery import Split
from quarry.plans.joingraph import Cell, Edge, possible_edges, splits, uses_repeated_table_once
from quarry.plans.search import enumerate_rules
from quarry.sources import sinks
from quarry.sources.catalog import Catalog, Constraints

PRIMARY = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",), "pages": ("page_id",), "benchmark": ("item_id",),
    "embeddings": ("vec_id",), "conversations": ("conv_id", "turn"),
}
FOREIGN = {
    ("nation", "n_regionkey"): ("region", "r_regionkey"), ("customer", "c_nationkey"): ("nation", "n_nationkey"), ("supplier", "s_nationkey"): ("nation", "n_nationkey"),
    ("orders", "o_custkey"): ("customer", "c_custkey"), ("lineitem", "l_orderkey"): ("orders", "o_orderkey"), ("lineitem", "l_partkey"): ("part", "p_partkey"),
    ("lineitem", "l_suppkey"): ("supplier", "s_suppkey"), ("labels", "doc_id"): ("documents", "doc_id"), ("events", "user_id"): ("customer", "c_custkey"),
}
#: Every column of integers or texts: what the value index covers, in catalog order.
INDEXED = {
    "benchmark": ("item_id", "text"), "conversations": ("conv_id", "turn", "role", "text"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "embeddings": ("vec_id", "label"), "events": ("event_id", "user_id", "event_type", "props"), "labels": ("doc_id", "quality", "toxic"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"), "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "pages": ("page_id", "url", "html"), "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size"),
    "region": ("r_regionkey", "r_name"), "supplier": ("s_suppkey", "s_name", "s_nationkey"),
}
DIMENSIONS = ("customer", "nation", "region", "supplier")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def catalog(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = tuple(INDEXED), indexed: bool = True) -> Catalog:
    wanted = {t: INDEXED[t] if indexed else None for t in tables}
    return Catalog.parquet(spark, sf_dir, wanted, Constraints(PRIMARY, {k: v for k, v in FOREIGN.items() if k[0] in tables and v[0] in tables}))


def cell(text: str, occurrence: int = 0) -> Cell:
    return Cell(text.split(".")[0], occurrence, text.split(".")[1])


def edge(a: str, b: str, oa: int = 0, ob: int = 0) -> Edge:
    return Edge.of(cell(a, oa), cell(b, ob))


# Value index and inclusion dependencies

_INDEX = "idx AS (" + " UNION ".join(f"SELECT '{t}.{c}' AS attribute, CAST({c} AS VARCHAR) AS value FROM {t} WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> ''" for t, cs in INDEXED.items() for c in cs) + ")"
_SIZES = f"{_INDEX}, sizes AS (SELECT attribute, count(*) AS n FROM idx GROUP BY 1)"
_PAIRS = f"""{_SIZES}, pairs AS (SELECT a.attribute AS l, b.attribute AS r, count(*) AS n_ab FROM idx a JOIN idx b USING (value) GROUP BY 1, 2),
measured AS (SELECT l, r, n_ab, x.n AS n_a, y.n AS n_b FROM pairs JOIN sizes x ON x.attribute = l JOIN sizes y ON y.attribute = r)"""
_PLACE = "CASE {0} " + " ".join(f"WHEN '{t}.{c}' THEN {i}" for i, (t, c) in enumerate((t, c) for t, cs in INDEXED.items() for c in cs)) + " END"
_ORDERED = f"{_PLACE.format('l')} < {_PLACE.format('r')}"


def index(spark: SparkSession, sf_dir: str) -> values.ValueIndex:
    return values.ValueIndex(catalog(spark, sf_dir))


@query(f"WITH {_SIZES} SELECT attribute, CAST(n AS BIGINT) AS n FROM sizes")
def attr_value_index(spark, sf_dir):
    """Distinct values of every attribute."""
    found = index(spark, sf_dir)
    return found.sizes().select(found.named("attr").alias("attribute"), "n")


@query(f'WITH {_PAIRS} SELECT l AS "left", r AS "right", n_ab FROM measured WHERE {_ORDERED}')
def attr_overlap(spark, sf_dir):
    return index(spark, sf_dir).measured().select("left", "right", "n_ab")


@query(f'WITH {_PAIRS} SELECT l AS "left", r AS "right", round(n_ab::DOUBLE / (n_a + n_b - n_ab), 9) AS jaccard FROM measured WHERE {_ORDERED}')
def attr_jaccard(spark, sf_dir):
    return index(spark, sf_dir).measured().select("left", "right", F.round("jaccard", 9).alias("jaccard"))


_KEYS = "(VALUES " + ", ".join(f"('{t}.{c}', '{rt}.{rc}')" for (t, c), (rt, rc) in FOREIGN.items()) + ") k(l, r)"


@query(
    f"""WITH {_PAIRS} SELECT coalesce(p.l, k.l) AS "left", coalesce(p.r, k.r) AS "right", coalesce(n_ab, 0) AS n_ab, k.l IS NOT NULL AS declared
FROM (SELECT * FROM measured WHERE {_ORDERED} OR l = r) p FULL JOIN (SELECT * FROM {_KEYS} WHERE {_ORDERED}) k ON p.l = k.l AND p.r = k.r WHERE n_ab > 3 OR k.l IS NOT NULL"""
)
def attr_compatible(spark, sf_dir):
    return index(spark, sf_dir).compatible()


@query(f"""WITH {_PAIRS}, e AS (SELECT l, r FROM measured WHERE ({_ORDERED} OR l = r) AND n_ab > 3 UNION SELECT l, r FROM {_KEYS} WHERE {_ORDERED}), b AS (SELECT l, r FROM e UNION SELECT r, l FROM e)
SELECT replace(l, '.', '___sep___') AS attribute, array_to_string(list_sort(list(replace(r, '.', '___sep___'))), ' ') AS compatible FROM b GROUP BY 1""")
def attr_adjacency(spark, sf_dir):
    """The compatibility graph as it is written to JSON."""
    return sinks.adjacency(index(spark, sf_dir).compatible()).withColumn("compatible", F.concat_ws(" ", "compatible"))


def _inclusion_sql(least: str, other: str = "") -> str:
    return f"WITH {_PAIRS} SELECT l AS dependant, r AS referenced, n_ab, n_a, round(n_ab::DOUBLE / n_a, 9) AS coverage FROM measured WHERE l <> r AND n_ab::DOUBLE / n_a >= {least} {other}"


def _inclusions(spark, sf_dir, least, same_table=True):
    return index(spark, sf_dir).inclusions(least, same_table).drop("jaccard").withColumn("coverage", F.round("coverage", 9))


@query(_inclusion_sql("1"))
def ind_exact(spark, sf_dir):
    return _inclusions(spark, sf_dir, 1.0)


@query(_inclusion_sql("0.75", "AND split_part(l, '.', 1) <> split_part(r, '.', 1)"))
def ind_partial_75(spark, sf_dir):
    return _inclusions(spark, sf_dir, 0.75, same_table=False)


@query(_inclusion_sql("0.7", "AND split_part(l, '.', 1) <> split_part(r, '.', 1)"))
def ind_partial_70(spark, sf_dir):
    return _inclusions(spark, sf_dir, 0.7, same_table=False)


IND_PAIRS = [
    ("documents.doc_id", "labels.doc_id"), ("orders.o_orderkey", "lineitem.l_orderkey"), ("customer.c_custkey", "events.user_id"), ("part.p_partkey", "customer.c_custkey"),
    ("part.p_size", "nation.n_nationkey"), ("nation.n_nationkey", "supplier.s_nationkey"), ("orders.o_custkey", "customer.c_custkey"),
]


def _ind_sql(columns: str) -> str:
    def one(d: str, r: str) -> str:
        (t, c), (u, k) = d.split("."), r.split(".")
        overlap = f"(SELECT count(DISTINCT {t}.{c}) FROM {t} WHERE {t}.{c} IN (SELECT {k} FROM {u}))"
        return f"SELECT '{d}' AS dependant, '{r}' AS referenced, {overlap} AS overlap, (SELECT count(*) FROM {t}) AS n_d, (SELECT count(*) FROM {u}) AS n_r"

    return f"SELECT {columns} FROM ({' UNION ALL '.join(one(*p) for p in IND_PAIRS)})"


@query(_ind_sql("dependant, referenced, overlap, round(overlap::DOUBLE / (n_d + n_r), 9) AS support, round(overlap::DOUBLE / n_d, 9) AS confidence"))
def ind_support_confidence(spark, sf_dir):
    found = values.ind_measures(catalog(spark, sf_dir), IND_PAIRS)
    return found.select("dependant", "referenced", "overlap", F.round("support", 9).alias("support"), F.round("confidence", 9).alias("confidence"))


@query(_ind_sql("dependant, referenced, overlap > 0 AS valid"))
def ind_validity(spark, sf_dir):
    return values.ind_measures(catalog(spark, sf_dir), IND_PAIRS).select("dependant", "referenced", "valid")


@query("""SELECT 'customer' AS tbl, count(*) AS n FROM customer c LEFT JOIN events e ON e.user_id = c.c_custkey WHERE e.user_id IS NULL
UNION ALL SELECT 'orders', count(*) FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL
UNION ALL SELECT 'labels', count(*) FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL""")
def fk_orphans(spark, sf_dir):
    c = catalog(spark, sf_dir, ("customer", "events", "orders", "lineitem", "labels", "documents"))
    checks = [("customer", "c_custkey", "events", "user_id"), ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("labels", "doc_id", "documents", "doc_id")]
    parts = [values.orphans(c, *k).agg(F.count("*").alias("n")).select(F.lit(k[0]).alias("tbl"), "n") for k in checks]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Join kernel


@query("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey")
def join_count_2way(spark, sf_dir):
    return kernel.count_rows(catalog(spark, sf_dir), [edge("orders.o_custkey", "customer.c_custkey")])


@query("SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def join_count_3way(spark, sf_dir):
    return kernel.count_rows(catalog(spark, sf_dir), [edge("lineitem.l_orderkey", "orders.o_orderkey"), edge("orders.o_custkey", "customer.c_custkey")])


@query("SELECT count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey")
def join_count_self(spark, sf_dir):
    return kernel.count_rows(catalog(spark, sf_dir), [edge("orders.o_custkey", "orders.o_custkey", 0, 1)])


@query("SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey = c_custkey")
def join_count_cycle(spark, sf_dir):
    edges = [edge("customer.c_nationkey", "nation.n_nationkey"), edge("supplier.s_nationkey", "nation.n_nationkey"), edge("supplier.s_suppkey", "customer.c_custkey")]
    return kernel.count_rows(catalog(spark, sf_dir), edges)


@query("SELECT count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = l_linenumber")
def join_count_intra(spark, sf_dir):
    return kernel.count_rows(catalog(spark, sf_dir), [edge("lineitem.l_partkey", "part.p_partkey"), edge("lineitem.l_suppkey", "lineitem.l_linenumber")])


@query("SELECT count(*) AS n FROM (SELECT DISTINCT c_custkey, o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey)")
def join_distinct_keys(spark, sf_dir):
    edges = [edge("orders.o_custkey", "customer.c_custkey"), edge("lineitem.l_orderkey", "orders.o_orderkey")]
    return kernel.count_keys(catalog(spark, sf_dir), edges, [cell("customer.c_custkey"), cell("orders.o_orderpriority")])


@query("SELECT t AS threshold, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) > t AS passed FROM (VALUES (0), (100), (100000000)) v(t)")
def threshold_check(spark, sf_dir):
    c, edges = catalog(spark, sf_dir), [edge("orders.o_custkey", "customer.c_custkey")]
    parts = [kernel.exceeds(c, edges, t).select(F.lit(t).alias("threshold"), "passed") for t in (0, 100, 100_000_000)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT count(*) AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def disjoint_self_join(spark, sf_dir):
    return kernel.count_rows(catalog(spark, sf_dir), [edge("supplier.s_nationkey", "supplier.s_nationkey", 0, 1)], disjoint=True)


@query("SELECT count(*) AS n FROM documents JOIN customer ON CAST(c_custkey AS VARCHAR) = regexp_replace(source, 'none', '') WHERE lang IS NOT NULL")
def join_mixed_types(spark, sf_dir):
    """A text column joined to an integer one by text; no source is a number, so no row joins and no cast fails."""
    return kernel.count_rows(catalog(spark, sf_dir), [edge("documents.source", "customer.c_custkey")])


@query("SELECT count(*) AS n FROM lineitem JOIN part ON CAST(l_quantity AS DECIMAL(12, 2)) = p_size")
def join_decimal(spark, sf_dir):
    """Decimals joined to integers: 7.00 is 7."""
    c = catalog(spark, sf_dir, ("lineitem", "part"), indexed=False)
    quantities = c["lineitem"].select(F.col("l_quantity").cast("decimal(12,2)").alias("l_quantity"))
    return kernel.count_rows(Catalog({"lineitem": quantities, "part": c["part"]}), [edge("lineitem.l_quantity", "part.p_size")])


@query("SELECT count(*) AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey JOIN customer c ON b.c_mktsegment = c.c_mktsegment WHERE a.c_custkey <> b.c_custkey AND a.c_custkey <> c.c_custkey AND b.c_custkey <> c.c_custkey")
def disjoint_three(spark, sf_dir):
    """Three occurrences that differ in their keys, counted without making any of their rows."""
    edges = [edge("customer.c_nationkey", "customer.c_nationkey", 0, 1), edge("customer.c_mktsegment", "customer.c_mktsegment", 1, 2)]
    return kernel.count_rows(catalog(spark, sf_dir, ("customer",)), edges, disjoint=True)


@query("SELECT n_nationkey, n_name FROM nation")
def table_scan(spark, sf_dir):
    return catalog(spark, sf_dir).scan("nation", ["n_nationkey", "missing", "n_name"])


# Rules

_T1 = [edge("part.p_partkey", "customer.c_custkey"), edge("part.p_size", "supplier.s_nationkey")]
RULES = {
    "size_nation": Split(frozenset(_T1), frozenset({("part", 0), ("supplier", 0)}), frozenset({("customer", 0)})),
    "orders_customer": Split(frozenset([edge("orders.o_custkey", "customer.c_custkey")]), frozenset({("orders", 0)}), frozenset({("customer", 0)})),
    "customer_events": Split(frozenset([edge("customer.c_custkey", "events.user_id")]), frozenset({("customer", 0)}), frozenset({("events", 0)})),
}
_JOINT = "(SELECT count(DISTINCT p_partkey) FROM part JOIN supplier ON p_size = s_nationkey JOIN customer ON c_custkey = p_partkey)"
_BODY = "(SELECT count(DISTINCT p_partkey) FROM part JOIN supplier ON p_size = s_nationkey)"
_CUSTOMERS = "(SELECT count(DISTINCT c_custkey) FROM customer)"
_HEADS = "(SELECT count(DISTINCT c_custkey) FROM customer JOIN part ON p_partkey = c_custkey)"
_OC, _OB = "(SELECT count(DISTINCT o_custkey) FROM orders JOIN customer ON o_custkey = c_custkey)", "(SELECT count(DISTINCT o_custkey) FROM orders)"
_CE, _EU = "(SELECT count(DISTINCT c_custkey) FROM customer JOIN events ON user_id = c_custkey)", "(SELECT count(DISTINCT user_id) FROM events)"


@query(f"""SELECT rule_id, joint, CASE WHEN touching_body = 0 THEN 0 ELSE round(joint::DOUBLE / touching_body, 9) END AS ref_support, CASE WHEN touching_head = 0 THEN 0 ELSE round(joint::DOUBLE / touching_head, 9) END AS ref_confidence
FROM (SELECT 'size_nation' AS rule_id, {_JOINT} AS joint, {_JOINT} AS touching_body, {_HEADS} AS touching_head UNION ALL SELECT 'orders_customer', {_OC}, {_OC}, {_OC} UNION ALL SELECT 'customer_events', {_CE}, {_CE}, {_CE})""")
def rule_metrics_reference(spark, sf_dir):
    found = discovery.score_rules(catalog(spark, sf_dir), RULES)
    return found.select("rule_id", "joint", F.round("ref_support", 9).alias("ref_support"), F.round("ref_confidence", 9).alias("ref_confidence"))


@query(f"""SELECT rule_id, joint, body, head, round(joint::DOUBLE / body, 9) AS precision, round(joint::DOUBLE / head, 9) AS head_coverage
FROM (SELECT 'size_nation' AS rule_id, {_JOINT} AS joint, {_BODY} AS body, {_CUSTOMERS} AS head UNION ALL SELECT 'orders_customer', {_OC}, {_OB}, {_CUSTOMERS} UNION ALL SELECT 'customer_events', {_CE}, {_CUSTOMERS}, {_EU})""")
def rule_metrics_strict(spark, sf_dir):
    found = discovery.score_rules(catalog(spark, sf_dir), RULES)
    return found.select("rule_id", "joint", F.col("body_alone").alias("body"), F.col("head_alone").alias("head"), F.round("precision", 9).alias("precision"), F.round("head_coverage", 9).alias("head_coverage"))


_FK_PAIRS = [(k, v) for k, v in FOREIGN.items() if k[0] in DIMENSIONS + ("orders",) and v[0] in DIMENSIONS + ("orders",)]
_FK_EDGES = possible_edges(_FK_PAIRS, 1)
_TWO = [Split(r, b, h) for r in enumerate_rules(_FK_EDGES, 3, 2) for b, h in splits(r)]


def _split_sql(split: Split) -> str:
    """Counts of a split by plain SQL: no rewriting of any kind."""
    tables = sorted(split.body | split.head)
    alias = lambda a: f"{a[0]}_{a[1]}"
    col = lambda c: f"{c.table}_{c.occurrence}.{c.column}"

    def count(aliases, edges, keys) -> str:
        where = " AND ".join(f"{col(e.left)} = {col(e.right)}" for e in sorted(edges)) or "TRUE"
        filled = " AND ".join(f"{col(k)} IS NOT NULL" for k in keys)
        return f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(map(col, keys))} FROM {', '.join(f'{a[0]} AS {alias(a)}' for a in sorted(aliases))} WHERE {where} AND {filled}))"

    within = lambda side: [e for e in split.inside(side)]
    body, head = split.keys(split.body), split.keys(split.head)
    text = rules.display(split.rule, split.body, split.head)
    return f"SELECT '{text}' AS rule, {count(tables, split.rule, body)} AS joint, {count(split.body, within(split.body), body)} AS body, {count(split.head, within(split.head), head)} AS head"


def _listed(splits_: list[Split]) -> str:
    inner = " UNION ALL ".join(_split_sql(s) for s in splits_)
    return f"SELECT rule, joint, body, head, round(joint::DOUBLE / body, 9) AS precision, round(joint::DOUBLE / head, 9) AS head_coverage FROM ({inner}) WHERE joint > 0"


def _rules(spark, sf_dir, splits_) -> DataFrame:
    c = catalog(spark, sf_dir, ("customer", "nation", "region", "supplier", "orders"))
    rows = [r for r in discovery.score(c, splits_) if r[3] > 0]
    found = spark.createDataFrame(rows, discovery.SCHEMA)
    return found.select("rule", "joint", F.col("body_alone").alias("body"), F.col("head_alone").alias("head"), F.round("precision", 9).alias("precision"), F.round("head_coverage", 9).alias("head_coverage"))


@query(_listed([s for s in _TWO if len(s.rule) == 1]))
def tgd_one_edge(spark, sf_dir):
    return _rules(spark, sf_dir, [s for s in _TWO if len(s.rule) == 1])


@query(_listed([s for s in _TWO if len(s.rule) == 2]))
def tgd_two_edge(spark, sf_dir):
    return _rules(spark, sf_dir, [s for s in _TWO if len(s.rule) == 2])


#: What discovery over nation, region and supplier may find compatible: integers with each other, names with themselves.
_SEARCHED = ("nation", "region", "supplier")
_INTEGERS = [("nation", "n_nationkey"), ("nation", "n_regionkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey"), ("supplier", "s_nationkey")]
_NAMES = [("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name")]
_MAYBE = possible_edges([(a, b) for i, a in enumerate(_INTEGERS) for b in _INTEGERS[i:]] + [(n, n) for n in _NAMES], 2)


def _discovered_sql(max_tables: int, max_edges: int) -> str:
    """Every rule of the search space by plain SQL, kept if the data make all its equalities compatible."""
    place = {f"{t}.{c}": i for i, (t, c) in enumerate((t, c) for t in sorted(INDEXED) for c in INDEXED[t])}
    col = lambda c: f"{c.table}_{c.occurrence}.{c.column}"

    def count(edges, keys) -> str:
        own = sorted({a for e in edges for a in e.aliases} | {k.alias for k in keys})
        where = [f"{col(e.left)} = {col(e.right)}" for e in sorted(edges)] + [f"{col(k)} IS NOT NULL" for k in keys]
        return f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(map(col, keys))} FROM {', '.join(f'{t} AS {t}_{o}' for t, o in own)} WHERE {' AND '.join(where)}))"

    parts = []
    for rule in enumerate_rules(_MAYBE, max_tables, max_edges):
        if uses_repeated_table_once(rule):
            continue
        needed = {tuple(sorted((f"{e.left.table}.{e.left.column}", f"{e.right.table}.{e.right.column}"), key=place.__getitem__)) for e in rule}
        guard = f"(SELECT count(*) FROM ok WHERE (l, r) IN ({', '.join(f'({a!r}, {b!r})' for a, b in sorted(needed))})) = {len(needed)}"
        for body, head in splits(rule):
            split = Split(rule, body, head)
            if split.shared:
                numbers = ", ".join(f"{' * '.join(count(*q) for q in several)} AS {name}" for name, several in discovery.questions(split).items())
                text = rules.display(rule, body, head)
                parts.append(f"SELECT '{text}' AS rule, {len({a for e in rule for a in e.aliases})} AS tables, {len(rule)} AS edges, {numbers} WHERE {guard}")
    shares = {"ref_support": "body_touching", "ref_confidence": "head_touching", "precision": "body_alone", "head_coverage": "head_alone"}
    ratios = ", ".join(f"CASE WHEN {of} > 0 THEN round(joint::DOUBLE / {of}, 9) ELSE 0 END AS {name}" for name, of in shares.items())
    known = ", ".join(f"'{t}.{c}'" for t in _SEARCHED for c in INDEXED[t])
    return f"""WITH {_PAIRS}, ok AS (SELECT l, r FROM measured WHERE ({_ORDERED} OR l = r) AND n_ab > 3 AND l IN ({known}) AND r IN ({known}) UNION SELECT l, r FROM {_KEYS} WHERE {_ORDERED})
SELECT rule, tables, edges, joint, body_touching, head_touching, body_alone, head_alone, {ratios} FROM ({" UNION ALL ".join(parts)}) WHERE joint > 0"""


@query(_discovered_sql(2, 2))
def tgd_discovery(spark, sf_dir):
    """Bounded discovery over compatible columns of nation, region and supplier, self-joins included."""
    found = discovery.discover(catalog(spark, sf_dir, _SEARCHED), max_occurrence=2, max_tables=2, max_edges=2, heuristic="hybrid", order="cost")
    return found.withColumns({c: F.round(c, 9) for c in ("ref_support", "ref_confidence", "precision", "head_coverage")})


@query()
def tgd_discovery_wide(spark, sf_dir):
    """Discovery at the usual bounds: three occurrences, three tables, six equalities, all compatible columns of the same tables,
    rules that differ in occurrence numbers alone given once."""
    found = discovery.discover(catalog(spark, sf_dir, _SEARCHED), max_occurrence=3, max_tables=3, max_edges=6, dedupe="isomorphic")
    return found.withColumns({c: F.round(c, 9) for c in ("ref_support", "ref_confidence", "precision", "head_coverage")})


@query(f"""WITH r AS ({_listed([s for s in _TWO if len(s.rule) == 1])}) SELECT rule, regexp_replace(rule, '^∀ (\\w+): (\\w+)_\\d+\\((\\w+)=\\w+\\) ⇒ .*$', '\\2.\\3') AS dependant, regexp_replace(rule, '^.* ⇒ (\\w+)_\\d+\\((\\w+)=\\w+\\)$', '\\1.\\2') AS referenced FROM r""")
def rule_inclusions(spark, sf_dir):
    """Rules of one variable as inclusion dependencies."""
    return coverage.as_inclusions(_rules(spark, sf_dir, [s for s in _TWO if len(s.rule) == 1])).select("rule", "dependant", "referenced")


@query("""SELECT count(*) FILTER (holds) AS holding, count(*) FILTER (NOT holds) AS failing FROM (SELECT n_nationkey, EXISTS (SELECT 1 FROM supplier, customer WHERE s_nationkey = n_nationkey AND c_nationkey = n_nationkey) AS holds FROM (SELECT DISTINCT n_nationkey FROM nation))""")
def existential_rule(spark, sf_dir):
    """For each nation some supplier and some customer exist: a head of two atoms with variables of its own."""
    edges = frozenset([edge("customer.c_nationkey", "nation.n_nationkey"), edge("customer.c_nationkey", "supplier.s_nationkey")])
    split = Split(edges, frozenset({("nation", 0)}), frozenset({("supplier", 0), ("customer", 0)}))
    return discovery.confirmed(catalog(spark, sf_dir), split).agg(F.count_if("holds").alias("holding"), F.count_if(~F.col("holds")).alias("failing"))


@query("""SELECT p_partkey, EXISTS (SELECT 1 FROM customer WHERE c_custkey = p_partkey) AS holds FROM (SELECT DISTINCT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = p_size))""")
def rule_tp_fn(spark, sf_dir):
    """The body's keys of a rule, and whether its head holds for each."""
    return discovery.confirmed(catalog(spark, sf_dir), RULES["size_nation"]).withColumnRenamed("part_0__p_partkey", "p_partkey")


@query(f"SELECT rule, precision AS accuracy FROM ({_listed([s for s in _TWO if len(s.rule) == 2])}) ORDER BY accuracy DESC, rule LIMIT 5")
def top5_rules(spark, sf_dir):
    found = _rules(spark, sf_dir, [s for s in _TWO if len(s.rule) == 2]).select(F.col("rule").alias("display"), F.col("precision").alias("accuracy"))
    return rules.top_rules(found).select(F.col("display").alias("rule"), "accuracy")


# Triples and Horn rules

_SAFE = "regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '_', 'g')"


def _triples_sql(by_value: bool) -> str:
    parts = []
    for t in DIMENSIONS:
        key = PRIMARY[t][0]
        subject = _SAFE.format(f"concat('{t}_', CAST({key} AS VARCHAR))")
        for c in INDEXED[t]:
            target = FOREIGN.get((t, c))
            if target:
                local = c if by_value else (target[1] if target[1] in INDEXED[t] else None)
                if local:
                    parts.append(f"SELECT {subject} AS subject, '{t}.{c}' AS predicate, " + _SAFE.format(f"concat('{target[0]}_', CAST({local} AS VARCHAR))") + f" AS object FROM {t} WHERE {key} IS NOT NULL AND {local} IS NOT NULL")
            elif c != key:
                parts.append(f"SELECT {subject} AS subject, '{t}.{c}' AS predicate, concat('\"', replace(CAST({c} AS VARCHAR), '\"', '\\\"'), '\"') AS object FROM {t} WHERE {key} IS NOT NULL AND {c} IS NOT NULL")
    return " UNION ALL ".join(parts)


def _facts(spark, sf_dir, **how) -> DataFrame:
    return facts.triples(catalog(spark, sf_dir, DIMENSIONS), **how)


@query(f"SELECT subject, predicate, object FROM ({_triples_sql(True)})")
def triples(spark, sf_dir):
    return _facts(spark, sf_dir)


@query(f"SELECT subject, predicate, object FROM ({_triples_sql(False)})")
def triples_fk_reference(spark, sf_dir):
    return _facts(spark, sf_dir, fk_object="reference")


@query(f"""SELECT concat('ex:', {_SAFE.format("subject").replace("]'", "_.]'")}, ' ex:', {_SAFE.format("predicate").replace("]'", "_.]'")}, ' ', CASE WHEN starts_with(object, '"') AND ends_with(object, '"') AND length(object) >= 2 THEN object ELSE concat('ex:', {_SAFE.format("object").replace("]'", "_.]'")}) END, ' .') AS value FROM ({_triples_sql(True)})""")
def triples_turtle(spark, sf_dir):
    return sinks.turtle(_facts(spark, sf_dir))


HORN = {
    "same_region": Horn(Atom("customer.c_nationkey", "x", "y"), (Atom("supplier.s_nationkey", "z", "y"), Atom("customer.c_nationkey", "x", "y"))),
    "name_of_segment": Horn(Atom("customer.c_mktsegment", "x", "y"), (Atom("customer.c_nationkey", "x", "z"), Atom("nation.n_name", "z", "y"))),
    "nation_by_region": Horn(Atom("nation.n_regionkey", "x", "y"), (Atom("supplier.s_nationkey", "z", "x"), Atom("nation.n_regionkey", "x", "y"))),
}


def _horn_sql(columns: str, rules_: dict[str, Horn] | None = None) -> str:
    def one(name: str, rule: Horn) -> str:
        facts_ = lambda i: f"u{i}"
        place: dict[str, str] = {}
        where = []
        for i, a in enumerate(rule.body):
            where.append(f"{facts_(i)}.predicate = '{a.relation}'")
            for v, c in ((a.first, "subject"), (a.second, "object")):
                if v in place:
                    where.append(f"{place[v]} = {facts_(i)}.{c}")
                place.setdefault(v, f"{facts_(i)}.{c}")
        body = f"(SELECT DISTINCT {place['x']} AS x, {place['y']} AS y FROM {', '.join(f't AS {facts_(i)}' for i in range(len(rule.body)))} WHERE {' AND '.join(where)})"
        head = f"(SELECT DISTINCT subject AS x, object AS y FROM t WHERE predicate = '{rule.head.relation}')"
        return f"""SELECT '{name}' AS rule_id, (SELECT count(*) FROM {body} JOIN {head} USING (x, y)) AS support, (SELECT count(*) FROM {body}) AS body_size,
(SELECT count(*) FROM {body} WHERE x IN (SELECT x FROM {head})) AS pca_size, (SELECT count(*) FROM {head}) AS head_size"""

    ratios = "CASE WHEN {0} > 0 THEN round(support::DOUBLE / {0}, 9) ELSE 0 END AS {1}"
    named = {"head_coverage": ratios.format("head_size", "head_coverage"), "confidence": ratios.format("body_size", "confidence"), "pca_confidence": ratios.format("pca_size", "pca_confidence")}
    wanted = ", ".join(named.get(c, c) for c in columns.split(", "))
    return f"WITH t AS ({_triples_sql(True)}) SELECT {wanted} FROM ({' UNION ALL '.join(one(*kv) for kv in (rules_ or HORN).items())})"


def _horn(spark, sf_dir, *columns) -> DataFrame:
    found = facts.horn_measures(_facts(spark, sf_dir), list(HORN.values()))
    names = F.create_map(*(F.lit(x) for n, r in HORN.items() for x in (str(r), n)))
    ratios = {c: F.round(c, 9) for c in ("head_coverage", "confidence", "pca_confidence")}
    return found.withColumns(ratios).withColumn("rule_id", names[F.col("rule")]).select(*columns)


@query(_horn_sql("rule_id, support, body_size, confidence"))
def horn_confidence(spark, sf_dir):
    return _horn(spark, sf_dir, "rule_id", "support", "body_size", "confidence")


@query(_horn_sql("rule_id, support, head_size, head_coverage"))
def horn_head_coverage(spark, sf_dir):
    return _horn(spark, sf_dir, "rule_id", "support", "head_size", "head_coverage")


@query(_horn_sql("rule_id, support, pca_size, pca_confidence"))
def horn_pca(spark, sf_dir):
    return _horn(spark, sf_dir, "rule_id", "support", "pca_size", "pca_confidence")


_MINED = ("nation.n_regionkey", "supplier.s_nationkey")


@query(_horn_sql("rule_id AS rule, support, body_size, pca_size, head_size, head_coverage, confidence, pca_confidence", {str(r): r for r in facts.horn_candidates(list(_MINED), 3)}))
def horn_mining(spark, sf_dir):
    """The measures of all Horn rules with one or two body atoms over the references of nation and supplier."""
    own = facts.triples(catalog(spark, sf_dir, ("nation", "region", "supplier")))
    found = facts.mine_horn(own.where(F.col("predicate").isin(*_MINED)), length=3, min_support=0)
    return found.withColumns({c: F.round(c, 9) for c in ("head_coverage", "confidence", "pca_confidence")})


@query(f"""WITH t AS (SELECT DISTINCT * FROM ({_triples_sql(True)})), e AS (SELECT DISTINCT subject, concat(predicate, '(X,', object, ')') AS body, concat(predicate, '(X,') AS first FROM t
UNION SELECT a.subject, concat(a.predicate, '(X,A), ', b.predicate, '(A,', b.object, ')'), concat(a.predicate, '(X,') FROM t a JOIN t b ON a.object = b.subject WHERE b.object <> a.subject),
n AS (SELECT body, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 20), h AS (SELECT DISTINCT subject, concat(predicate, '(X,', object, ')') AS head, concat(predicate, '(X,') AS first FROM t),
m AS (SELECT head FROM h GROUP BY 1 HAVING count(*) >= 20)
SELECT concat(h.head, ' <= ', e.body) AS rule, count(*) AS support, any_value(n.n) AS body_size, round(count(*)::DOUBLE / any_value(n.n), 9) AS confidence
FROM e JOIN n USING (body) JOIN h USING (subject) JOIN m USING (head) WHERE h.first <> e.first GROUP BY h.head, e.body HAVING count(*) >= 20""")
def path_rules(spark, sf_dir):
    """Path rules of one and two steps that hold for twenty subjects or more."""
    return facts.path_rules(_facts(spark, sf_dir), 2, 20).withColumn("confidence", F.round("confidence", 9))


@query(f"""WITH t AS (SELECT DISTINCT * FROM ({_triples_sql(True)})), n AS (SELECT predicate, object, count(*) AS n FROM t GROUP BY 1, 2),
f AS (SELECT a.predicate AS body_predicate, a.object AS body_object, b.predicate AS head_predicate, b.object AS head_object, count(*) AS support FROM t a JOIN t b USING (subject) WHERE a.predicate <> b.predicate GROUP BY 1, 2, 3, 4)
SELECT body_predicate, body_object, head_predicate, head_object, support, n AS body_size, round(support::DOUBLE / n, 9) AS confidence FROM f JOIN n ON body_predicate = predicate AND body_object = object WHERE support >= 2""")
def path_constant_rules(spark, sf_dir):
    return facts.constant_rules(_facts(spark, sf_dir)).withColumn("confidence", F.round("confidence", 9))


# Covering rules

BODIES = {
    "by nation": [("c_nationkey", "supplier", "s_nationkey")], "by events": [("c_custkey", "events", "user_id")], "by part": [("c_custkey", "part", "p_partkey")],
    "by nation and orders": [("c_nationkey", "nation", "n_nationkey"), ("c_custkey", "orders", "o_custkey")],
}
_COVER = " UNION ALL ".join(
    f"SELECT '{n}' AS body, {len(b)} AS literals, count(*) FILTER ({' AND '.join(f'{own} IN (SELECT {k} FROM {t})' for own, t, k in b)}) AS covered, count(*) AS total FROM c" for n, b in BODIES.items()
)


@query(f"WITH c AS (SELECT DISTINCT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer) SELECT body, literals, covered, total - covered AS uncovered FROM ({_COVER})")
def ilp_coverage(spark, sf_dir):
    return ilp.coverage(catalog(spark, sf_dir), "customer", BODIES)


def _greedy_sql() -> str:
    """The greedy choice unrolled: as many rounds as bodies."""
    cov = " UNION ALL ".join(f"SELECT '{n}' AS body, {len(b)} AS literals, c_custkey, c_name, c_nationkey, c_mktsegment FROM c WHERE {' AND '.join(f'{own} IN (SELECT {k} FROM {t})' for own, t, k in b)}" for n, b in BODIES.items())
    steps = [f"c AS (SELECT DISTINCT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer), r0 AS ({cov})"]
    for i in range(len(BODIES)):
        steps.append(f"s{i + 1} AS (SELECT {i + 1} AS rank, body, count(*) AS added FROM r{i} GROUP BY body, literals ORDER BY count(*)::DOUBLE / literals DESC, literals, body DESC LIMIT 1)")
        steps.append(f"r{i + 1} AS (SELECT * FROM r{i} WHERE c_custkey NOT IN (SELECT c_custkey FROM r{i} WHERE body = (SELECT body FROM s{i + 1})))")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT rank, body, added FROM s{i + 1}" for i in range(len(BODIES)))


@query(_greedy_sql())
def ilp_greedy_cover(spark, sf_dir):
    chosen = ilp.greedy_cover(ilp.covered(catalog(spark, sf_dir), "customer", BODIES), {n: len(b) for n, b in BODIES.items()})
    return spark.createDataFrame([(i + 1, body, n) for i, (body, n) in enumerate(chosen)], "rank int, body string, added long")


_HOLES = "SELECT DISTINCT CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS a, CASE WHEN c_custkey % 3 <> 1 THEN c_nationkey END AS b FROM customer"


@query(f"WITH h AS ({_HOLES}) SELECT 'a' AS body, count(*) FILTER (a IN (SELECT s_nationkey FROM supplier)) AS examples FROM h UNION ALL SELECT 'b', count(*) FILTER (b IN (SELECT n_nationkey FROM nation)) FROM h UNION ALL SELECT 'all', count(*) FROM h")
def ilp_null_examples(spark, sf_dir):
    """Examples that differ only in which column is null are different ones."""
    c = catalog(spark, sf_dir, ("customer", "supplier", "nation"))
    third, nation = F.pmod("c_custkey", F.lit(3)), F.col("c_nationkey")
    head = c["customer"].select(F.when(third != 0, nation).alias("a"), F.when(third != 1, nation).alias("b"))
    holed = Catalog({"h": head, "supplier": c["supplier"], "nation": c["nation"]})
    found = ilp.covered(holed, "h", {"a": [("a", "supplier", "s_nationkey")], "b": [("b", "nation", "n_nationkey")]})
    found = found.unionByName(ilp.examples(holed, "h").select(F.lit("all").alias("body"), "example"))
    return found.distinct().groupBy("body").agg(F.count("*").alias("examples"))


@query("SELECT concat('region(', CAST(r_regionkey AS VARCHAR), ',', CASE WHEN regexp_replace(lower(r_name), '[^a-z0-9_]', '', 'g') = '' THEN '_' ELSE regexp_replace(lower(r_name), '[^a-z0-9_]', '', 'g') END, ').') AS line FROM region")
def prolog_facts(spark, sf_dir):
    return ilp.prolog_facts(catalog(spark, sf_dir), "region")


# Rule sets: signatures of exact inclusions against the declared references

_FOUND = f"WITH {_PAIRS}, found AS (SELECT DISTINCT lower(concat(l, ' in ', r)) AS s FROM measured WHERE l <> r AND n_ab = n_a), truth AS (SELECT lower(concat(l, ' in ', r)) AS s FROM {_KEYS})"


def _truth(spark) -> DataFrame:
    return spark.createDataFrame([(f"{t}.{c} in {rt}.{rc}",) for (t, c), (rt, rc) in FOREIGN.items()], "signature string")


@query(f"""{_FOUND}, n AS (SELECT (SELECT count(*) FROM found JOIN truth USING (s)) AS tp, (SELECT count(*) FROM found) AS f, (SELECT count(*) FROM truth) AS t)
SELECT tp AS true_positives, f - tp AS false_positives, t - tp AS false_negatives, round(tp::DOUBLE / f, 9) AS precision, round(tp::DOUBLE / t, 9) AS recall, round(2.0 * tp / (f + t), 9) AS f1 FROM n""")
def rule_precision_recall(spark, sf_dir):
    found = index(spark, sf_dir).inclusions().select(F.concat_ws(" in ", "dependant", "referenced").alias("signature"))
    return coverage.precision_recall(found, _truth(spark)).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"{_FOUND} SELECT s AS signature, s IN (SELECT s FROM found) AS matched FROM truth")
def coverage_compared(spark, sf_dir):
    found = index(spark, sf_dir).inclusions().select(F.concat_ws(" in ", "dependant", "referenced").alias("signature"))
    return coverage.compared(found, _truth(spark), ["signature"])


@query(f"""WITH {_PAIRS}, own AS (SELECT DISTINCT split_part(l, '.', 1) AS a, split_part(r, '.', 1) AS b FROM measured WHERE l <> r AND n_ab = n_a),
other AS (SELECT split_part(l, '.', 1) AS a, split_part(r, '.', 1) AS b FROM {_KEYS})
SELECT count(*) AS joinable, count(*) FILTER (hit) AS matched, round(count(*) FILTER (hit)::DOUBLE / count(*), 9) AS completeness
FROM (SELECT EXISTS (SELECT 1 FROM own WHERE (own.a = other.a AND own.b = other.b) OR (own.a = other.b AND own.b = other.a)) AS hit FROM other)""")
def coverage_semi(spark, sf_dir):
    """The declared references as a rule set, and how many of them an exact inclusion between the same tables matches."""
    rule = lambda df, l, r: df.select(
        F.concat_ws(" in ", l, r).alias("rule_id"), F.array(F.substring_index(l, ".", 1), F.substring_index(r, ".", 1)).alias("tables"),
        F.array().cast("array<string>").alias("body_vars"), F.array().cast("array<string>").alias("head_vars"), F.lit(True).alias("inclusion"),
    )
    declared = spark.createDataFrame([(f"{t}.{c}", f"{rt}.{rc}") for (t, c), (rt, rc) in FOREIGN.items()], "l string, r string")
    found = coverage.completeness(rule(index(spark, sf_dir).inclusions(), "dependant", "referenced"), rule(declared, "l", "r"))
    return found.withColumn("completeness", F.round("completeness", 9))


_PAIR_VALUES = "(VALUES " + ", ".join(f"('{t}.{c}', '{rt}.{rc}')" for (t, c), (rt, rc) in FOREIGN.items()) + ") k(l, r)"


@query(f"""WITH RECURSIVE e AS (SELECT l AS a, r AS b FROM {_PAIR_VALUES} UNION SELECT r, l FROM {_PAIR_VALUES}), n AS (SELECT DISTINCT a FROM e),
w AS (SELECT a AS l, a AS r FROM n UNION SELECT w.l, e.b FROM w JOIN e ON e.a = w.r) SELECT x.a AS "left", y.a AS "right", EXISTS (SELECT 1 FROM w WHERE w.l = x.a AND w.r = y.a) AS compatible FROM n x, n y""")
def transitive_compatibility(spark, sf_dir):
    """Which columns of declared references reach each other."""
    declared = spark.createDataFrame([(f"{t}.{c}", f"{rt}.{rc}") for (t, c), (rt, rc) in FOREIGN.items()], "left string, right string")
    ends = sorted({e for r in FOREIGN.items() for e in (".".join(r[0]), ".".join(r[1]))})
    wanted = spark.createDataFrame([(a, b) for a in ends for b in ends], "left string, right string")
    return coverage.transitively_compatible(declared, wanted)


_TABLE_SETS = "(VALUES " + ", ".join(f"({i}, ['{t}', '{rt}'])" for i, ((t, _), (rt, _)) in enumerate(FOREIGN.items())) + ") k(i, t)"


@query(f"""SELECT own_id, other_id, n::DOUBLE / m AS similarity FROM (SELECT a.i AS own_id, b.i AS other_id, len(list_intersect(a.t, b.t)) AS n, greatest(len(list_distinct(a.t)), len(list_distinct(b.t))) AS m FROM (SELECT i, t FROM {_TABLE_SETS}) a, (SELECT i, t FROM {_TABLE_SETS}) b) WHERE n > 0 AND n::DOUBLE / m >= 0.5""")
def overlapping_rules(spark, sf_dir):
    """Rules of two sets that share half of the tables of the larger one."""
    own = spark.createDataFrame([(i, [f"{t}_0", rt.upper()]) for i, ((t, _), (rt, _)) in enumerate(FOREIGN.items())], "rule_id int, tables array<string>")
    return coverage.miner_overlap(own, own, 0.5)


# Statistics


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(median(value), 6) AS median, min(value) AS min, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY 1""")
def stats_descriptive(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value")
    return stats.describe(events, "value", ["event_type"]).withColumns({c: F.round(c, 6) for c in ("mean", "std", "median")})


@query("""SELECT event_type, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(list_sort(list(v))[count(*) // 2 + 1], 6) AS upper_median, round(avg((v >= 0.8)::INT), 6) AS share_high, round(avg((v < 0.5)::INT), 6) AS share_low
FROM (SELECT event_type, value / (SELECT max(value) FROM events) AS v FROM events WHERE value IS NOT NULL) GROUP BY 1""")
def stats_alt(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value")
    scaled = events.crossJoin(F.broadcast(events.agg(F.max("value").alias("most")))).select("event_type", (F.col("value") / F.col("most")).alias("v"))  # one row
    found = stats.alternative(scaled, "v", ["event_type"])
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std", "upper_median", "share_high", "share_low")})


@query("""SELECT count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(list_sort(list(v))[count(*) // 2 + 1], 6) AS upper_median, round(avg((v >= 0.8)::INT), 6) AS share_high, round(avg((v < 0.5)::INT), 6) AS share_low
FROM (SELECT value / (SELECT max(value) FROM events) AS v FROM events WHERE value IS NOT NULL)""")
def stats_alt_all(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("value")
    scaled = events.crossJoin(F.broadcast(events.agg(F.max("value").alias("most")))).select((F.col("value") / F.col("most")).alias("v"))  # one row
    return stats.alternative(scaled, "v").withColumns({c: F.round(c, 6) for c in ("mean", "std", "upper_median", "share_high", "share_low")})


@query("""SELECT 'duration' AS metric, event_type AS algorithm, concat('d', user_id % 3) AS dataset, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(median(value), 6) AS median, min(value) AS min, max(value) AS max
FROM events WHERE value IS NOT NULL GROUP BY 2, 3""")
def stats_report(spark, sf_dir):
    """The report's table, over events as if they were runs."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    runs = events.select(F.col("event_type").alias("algorithm"), F.concat(F.lit("d"), F.col("user_id") % 3).alias("dataset"), F.col("value").alias("duration"))
    return reports.by_algorithm(runs).drop("ci_low", "ci_high").withColumns({c: F.round(c, 6) for c in ("mean", "std", "median")})


@query(f"""WITH {_PAIRS} SELECT band, count(*) AS n FROM (SELECT CASE WHEN c < 0.5 THEN 'low' WHEN c < 0.8 THEN 'fair' WHEN c < 0.9 THEN 'good' ELSE 'excellent' END AS band FROM (SELECT n_ab::DOUBLE / n_a AS c FROM measured WHERE l <> r)) GROUP BY 1""")
def stats_quality_bands(spark, sf_dir):
    found = index(spark, sf_dir).inclusions(0.0)
    return found.select(stats.band(F.col("coverage"), "confidence").alias("band")).groupBy("band").agg(F.count("*").alias("n"))


_SIDES = "FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"


@query(f"""WITH m AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v {_SIDES} GROUP BY 1),
p AS (SELECT a.n AS na, b.n AS nb, a.m - b.m AS gap, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS pooled FROM m a, m b WHERE a.g = 'BUILDING' AND b.g = 'MACHINERY')
SELECT na AS n_a, nb AS n_b, round(gap / sqrt(pooled * (1.0 / na + 1.0 / nb)), 6) AS t, na + nb - 2 AS df, round(abs(gap) / sqrt(pooled), 6) AS cohen_d FROM p""")
def t_statistic(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    found = stats.t_test(customers, "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY")
    return found.select("n_a", "n_b", F.round("t", 6).alias("t"), "df", F.round("cohen_d", 6).alias("cohen_d"))


@query(f"""WITH r AS (SELECT c_mktsegment AS g, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS r {_SIDES}),
s AS (SELECT sum(r) FILTER (g = 'BUILDING') AS ra, count(*) FILTER (g = 'BUILDING') AS na, count(*) FILTER (g = 'MACHINERY') AS nb FROM r)
SELECT na AS n_a, nb AS n_b, round(CAST(ra AS DOUBLE) - na * (na + 1) / 2.0, 3)::DOUBLE AS u, round(abs(1 - 2 * (ra - na * (na + 1) / 2.0) / (na * nb)), 6)::DOUBLE AS rank_biserial FROM s""")
def u_statistic(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    found = stats.u_test(customers, "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY")
    return found.select("n_a", "n_b", F.round(F.col("u").cast("double"), 3).alias("u"), F.round(F.col("rank_biserial").cast("double"), 6).alias("rank_biserial"))


@query("""SELECT round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_a - mean_b, 6) AS difference, round((mean_a - mean_b) / mean_b * 100, 6) AS percent, CASE WHEN mean_a < mean_b THEN 'BUILDING' ELSE 'MACHINERY' END AS faster
FROM (SELECT avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS mean_a, avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS mean_b FROM customer)""")
def time_comparison(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    found = stats.compare_times(customers, "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY")
    return found.withColumns({c: F.round(c, 6) for c in ("mean_a", "mean_b", "difference", "percent")})


@query("SELECT count(*) FILTER (value IS NOT NULL AND value BETWEEN 0 AND 1) AS valid, count(*) AS n FROM events")
def metric_validation(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.agg(F.count_if(stats.valid_metric(F.col("value"))).alias("valid"), F.count("*").alias("n"))


@query("SELECT t AS tbl, round(least(1, n / 1000.0), 9)::DOUBLE AS by_rows, round(least(1, 100.0 / n), 9)::DOUBLE AS inverse_rows FROM (SELECT 'region' AS t, count(*) AS n FROM region UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders)")
def fallback_scores(spark, sf_dir):
    sizes = catalog(spark, sf_dir, ("region", "customer", "orders")).row_counts()
    rows = spark.createDataFrame(list(sizes.items()), "tbl string, n long")
    return rows.select("tbl", F.round(ranks.by_rows(F.col("n")), 9).alias("by_rows"), F.round(ranks.inverse_rows(F.col("n")), 9).alias("inverse_rows"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    """Repeated displays among rule texts, here over order keys written as texts."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("display"))
    return rules.repeated_displays(orders).select(F.col("display").alias("o_custkey"), "n")


