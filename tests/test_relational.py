import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import coverage, ilp, kernel, triples as facts
from quarry.operators.kernel import Counter
from quarry.operators.triples import Atom, Horn
from quarry.operators.values import ValueIndex, ind_measures, orphans
from quarry.plans.discovery import Split, confirmed, discover, score
from quarry.plans.joingraph import Cell, Edge, aliases, possible_edges, splits
from quarry.plans.search import enumerate_rules
from quarry.sources.catalog import Catalog, Constraints, canon


def small(spark, seed=0, rows=12, values=5):
    """Random tables with nulls and repeated rows, and their rows in Python."""
    rng = random.Random(seed)
    shape = {"a": ("x", "w"), "b": ("y", "z"), "c": ("z", "v")}
    held = {t: [tuple(rng.choice([None, *range(values)]) for _ in cs) for _ in range(rows)] for t, cs in shape.items()}
    tables = {t: spark.createDataFrame(held[t], ", ".join(f"{c} long" for c in cs)) for t, cs in shape.items()}
    return Catalog(tables, Constraints({"a": ("x",)}, {("b", "y"): ("a", "x")})), {t: [dict(zip(cs, r)) for r in held[t]] for t, cs in shape.items()}


def brute_join(data, edges):
    """All combinations of rows, one per occurrence, where the equalities hold."""
    own = sorted(aliases(edges))
    for rows in itertools.product(*(data[t] for t, _ in own)):
        at = dict(zip(own, rows))
        value = lambda c: at[c.alias][c.column]
        if all(value(e.left) is not None and value(e.left) == value(e.right) for e in edges):
            yield at


PAIRS = [(("a", "x"), ("b", "y")), (("b", "z"), ("c", "z")), (("a", "w"), ("c", "v")), (("a", "x"), ("a", "w"))]


@pytest.mark.parametrize("seed", range(2))
def test_kernel_equals_brute_force(spark, seed):
    catalog, data = small(spark, seed)
    rules = [r for r in enumerate_rules(possible_edges(PAIRS, 2), 3, 3)]
    for rule in random.Random(seed).sample(rules, 8):
        joined = list(brute_join(data, rule))
        keys = sorted(kernel.cells(rule))[:2]
        want = len({tuple(at[k.alias][k.column] for k in keys) for at in joined})
        assert kernel.count_rows(catalog, rule).first()["n"] == len(joined)
        assert kernel.count_keys(catalog, rule, keys).first()["n"] == want
        assert kernel.count_keys(catalog, rule, keys, reduced=False).first()["n"] == want
        assert kernel.exceeds(catalog, rule, 3).first()["passed"] == (len(joined) > 3)


def test_scores_equal_brute_force(spark):
    catalog, data = small(spark, 5)
    rules = [r for r in enumerate_rules(possible_edges(PAIRS, 1), 3, 2) if len(aliases(r)) > 1]
    found = [Split(r, b, h) for r in rules for b, h in splits(r)]
    found = [s for s in found if s.shared]
    for split, row in zip(found, score(catalog, found), strict=True):
        def keys(edges, side, over):
            own = split.keys(side)
            if edges or len(over) > 1:
                rows = [dict(zip(sorted(over), combo)) for combo in itertools.product(*(data[t] for t, _ in sorted(over)))]
                value = lambda at, c: at[c.alias][c.column]
                rows = [at for at in rows if all(value(at, e.left) is not None and value(at, e.left) == value(at, e.right) for e in edges)]
            else:
                rows = [{next(iter(over)): r} for r in data[next(iter(over))[0]]]
            tuples = {tuple(at[k.alias][k.column] for k in own) for at in rows}
            return len({t for t in tuples if None not in t})

        assert row[3] == keys(split.rule, split.body, aliases(split.rule))
        assert row[6] == keys(split.inside(split.body), split.body, split.body)
        assert row[7] == keys(split.inside(split.head), split.head, split.head)


def test_one_edge_rules_score_one_by_the_reference_formula(spark):
    catalog, _ = small(spark, 1)
    split = Split(frozenset([Edge.of(Cell("a", 0, "x"), Cell("b", 0, "y"))]), frozenset({("a", 0)}), frozenset({("b", 0)}))
    row = next(score(catalog, [split]))
    assert row[8:10] == (1.0, 1.0) and row[10] <= 1.0
    marks = confirmed(catalog, split).groupBy("holds").count().collect()
    assert sum(r["count"] for r in marks if r["holds"]) == row[3] and sum(r["count"] for r in marks) == row[6]


def test_counter_asks_once(spark):
    catalog, _ = small(spark)
    counter = Counter(catalog)
    question = ([Edge.of(Cell("a", 0, "x"), Cell("b", 0, "y"))], [Cell("a", 0, "x")])
    first = counter[question]
    counter.catalog = None
    assert counter[question] == first


def test_unconnected_join_raises(spark):
    catalog, _ = small(spark)
    far = [Edge.of(Cell("a", 0, "x"), Cell("b", 0, "y")), Edge.of(Cell("c", 0, "z"), Cell("c", 1, "z"))]
    with pytest.raises(ValueError):
        kernel.joined(catalog, far)
    with pytest.raises(KeyError):
        kernel.joined(catalog, [Edge.of(Cell("a", 0, "nope"), Cell("b", 0, "y"))])
    with pytest.raises(KeyError):
        catalog["nope"]


def test_disjoint_occurrences_differ_in_their_keys(spark):
    df = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "id int, v int")
    catalog = Catalog({"t": df}, Constraints({"t": ("id",)}))
    edges = [Edge.of(Cell("t", 0, "v"), Cell("t", 1, "v"))]
    assert kernel.count_rows(catalog, edges).first()["n"] == 5 and kernel.count_rows(catalog, edges, disjoint=True).first()["n"] == 2


def test_key_tuples_with_nulls_count(spark):
    a = spark.createDataFrame([(1, 1), (1, None), (2, 2)], "k int, v int")
    catalog = Catalog({"a": a, "b": a.select(F.col("k").alias("j")).distinct()})
    edges = [Edge.of(Cell("a", 0, "k"), Cell("b", 0, "j"))]
    assert kernel.count_keys(catalog, edges, [Cell("a", 0, "k"), Cell("a", 0, "v")]).first()["n"] == 3


def test_empty_joins_prune(spark):
    a = spark.createDataFrame([(1, 1)], "x int, w int")
    catalog = Catalog({"a": a, "b": spark.createDataFrame([(2, 1)], "y int, z int"), "c": spark.createDataFrame([(1,)], "v int")})
    edges = possible_edges([(("a", "x"), ("b", "y")), (("a", "w"), ("c", "v"))], 1)
    assert {r["rule"] for r in discover(catalog, edges=edges, prune_empty=True).collect()} == {r["rule"] for r in discover(catalog, edges=edges).collect()}


@pytest.fixture(scope="module")
def comparison(spark):
    """Students, departments and courses with planted violations: a share of distinct values and of rows that differ."""
    names = spark.createDataFrame([(f"SN{i:03}", f"n{i}") for i in range(1, 101)], "arg1 string, arg2 string")
    students = [(f"S{i:03}", f"SN{i:03}" if i > 5 else "SN999", None if i in (10, 11, 12, 13, 14) else "BAD" if 20 <= i < 25 else f"D{i % 5}") for i in range(1, 101)]
    courses = [(f"C{i:02}", "P999" if i < 2 else f"P{i % 20:02}") for i in range(50)]
    return Catalog(
        {
            "students": spark.createDataFrame(students, "arg1 string, arg2 string, arg3 string"), "student_names": names,
            "departments": spark.createDataFrame([(f"D{i}",) for i in range(5)], "arg1 string"), "courses": spark.createDataFrame(courses, "arg1 string, arg3 string"),
            "professors": spark.createDataFrame([(f"P{i:02}",) for i in range(20)], "arg1 string"),
        },
        Constraints({"students": ("arg1",)}, {("students", "arg2"): ("student_names", "arg1")}),
    )


def test_inclusions_by_distinct_values_and_rows(comparison):
    index = ValueIndex(comparison)
    got = {(r.dependant, r.referenced): (r.n_ab, r.n_a) for r in index.inclusions(0.0).collect()}
    assert got["students.arg2", "student_names.arg1"] == (95, 96)
    assert got["students.arg3", "departments.arg1"] == (5, 6)
    assert got["courses.arg3", "professors.arg1"] == (20, 21)
    rows = ind_measures(comparison, [("courses.arg3", "professors.arg1"), ("courses.nope", "professors.arg1")]).collect()
    assert [(r.overlap, r.confidence, r.valid) for r in rows] == [(20, 20 / 50, True), (0, 0.0, False)]
    assert orphans(comparison, "students", "arg2", "student_names", "arg1").count() == 5


def test_null_policy_and_threshold(spark):
    a = spark.createDataFrame([("1",), ("2",), ("3",), (None,), ("",)], "k string")
    catalog = Catalog({"a": a, "b": a.withColumnRenamed("k", "j")})
    shared = lambda **how: ValueIndex(catalog, **how).measured().first()["n_ab"]
    assert shared() == 3 and shared(nulls="literal") == 4
    pairs = lambda index, **how: {(r.left, r.right) for r in index.compatible(**how).collect()}
    assert pairs(ValueIndex(catalog)) == set() and ("a.k", "b.j") in pairs(ValueIndex(catalog, nulls="literal"))
    declared = Catalog({"a": a, "b": a.withColumnRenamed("k", "j")}, Constraints(foreign={("a", "k"): ("b", "j")}))
    assert pairs(ValueIndex(declared)) == {("a.k", "b.j")} and pairs(ValueIndex(declared), foreign_keys=False) == set()
    assert ("a.k", "b.j") in pairs(ValueIndex(catalog), min_jaccard=0.05)
    with pytest.raises(ValueError):
        ValueIndex(catalog, nulls="keep")


def test_canonical_text(spark):
    row = spark.sql("SELECT 7L AS i, 1e3D AS d, 0.5D AS f, true AS b, timestamp '2024-01-02 03:04:05.6' AS t, 'x' AS s, CAST(NULL AS BOOLEAN) AS n")
    got = row.select(*(canon(F.col(f.name), f.dataType).alias(f.name) for f in row.schema.fields)).first().asDict()
    assert got == {"i": "7", "d": "1000", "f": "0.5", "b": "True", "t": "2024-01-02 03:04:05.600000", "s": "x", "n": None}


def blog(spark):
    users = spark.createDataFrame([(1, "Ann \"A\"", "a@x"), (2, "Bob", "b@x")], "id int, name string, email string")
    posts = spark.createDataFrame([(10, 1, "t1", "c1"), (11, 1, "t2", "c2"), (12, 2, "t3", None)], "id int, user_id int, title string, content string")
    comments = spark.createDataFrame([(5, 10, 2, "hi"), (6, 11, 1, "yo"), (7, 12, None, "no")], "id int, post_id int, user_id int, comment string")
    keys = {t: ("id",) for t in ("users", "posts", "comments")}
    refs = {("posts", "user_id"): ("users", "id"), ("comments", "post_id"): ("posts", "id"), ("comments", "user_id"): ("users", "id")}
    return Catalog({"users": users, "posts": posts, "comments": comments, "lone": users.select("id")}, Constraints(keys, refs))


def test_triples_golden(spark):
    got = {tuple(r) for r in facts.triples(blog(spark)).collect()}
    assert len(got) == 4 + 8 + 8
    assert ("users_1", "users.name", '"Ann \\"A\\""') in got
    assert ("posts_10", "posts.user_id", "users_1") in got and ("comments_5", "comments.user_id", "users_2") in got
    parity = {tuple(r) for r in facts.triples(blog(spark), fk_object="reference").collect()}
    assert ("comments_5", "comments.user_id", "users_5") in parity and ("posts_10", "posts.user_id", "users_10") in parity


def test_horn_measures_against_brute_force(spark):
    rng = random.Random(4)
    rows = {(f"e{rng.randrange(6)}", rng.choice("pqr"), f"e{rng.randrange(6)}") for _ in range(50)}
    df = spark.createDataFrame(sorted(rows), "subject string, predicate string, object string")
    rules = facts.horn_candidates(["p", "q"], 3)[::5] + [Horn(Atom("p", "x", "y"), (Atom("q", "x", "z"), Atom("r", "z", "z"), Atom("q", "z", "y")))]
    got = {r.rule: (r.support, r.body_size, r.pca_size, r.head_size) for r in facts.horn_measures(df, rules).collect()}
    for rule in rules:
        names = sorted({v for a in rule.body for v in (a.first, a.second)})
        body = set()
        for values in itertools.product([f"e{i}" for i in range(6)], repeat=len(names)):
            at = dict(zip(names, values))
            if all((at[a.first], a.relation, at[a.second]) in rows for a in rule.body):
                body.add((at["x"], at["y"]))
        head = {(s, o) for s, p, o in rows if p == rule.head.relation}
        assert got[str(rule)] == (len(body & head), len(body), len([b for b in body if any(b[0] == s for s, _ in head)]), len(head))
    with pytest.raises(ValueError):
        facts.body_pairs(df, Horn(Atom("p", "x", "y"), (Atom("q", "x", "z"),)))
    with pytest.raises(ValueError):
        facts.body_pairs(df, Horn(Atom("p", "x", "y"), (Atom("q", "x", "x"), Atom("q", "y", "y"))))
    mined = {r.rule for r in facts.mine_horn(df, min_support=2).collect()}
    assert mined == {str(r) for r in facts.horn_candidates(["p", "q", "r"]) if (m := facts.horn_measures(df, [r]).first()).support >= 2}


def test_examples_covered(spark):
    catalog, data = small(spark, 3)
    bodies = {"one": [("x", "b", "y")], "both": [("x", "b", "y"), ("w", "c", "v")]}
    rows = {tuple(r.values()) for r in data["a"]}
    ys, vs = ({r[c] for r in data[t]} - {None} for t, c in (("b", "y"), ("c", "v")))
    got = {r.body: (r.literals, r.covered, r.uncovered) for r in ilp.coverage(catalog, "a", bodies).collect()}
    one = sum(x in ys for x, _ in rows)
    assert got["one"] == (1, one, len(rows) - one) and got["both"][1] == sum(x in ys and w in vs for x, w in rows)
    assert ilp.greedy_cover(ilp.covered(catalog, "a", bodies), {n: len(b) for n, b in bodies.items()})[0] == ("one", one)
    assert set(ilp.bodies_for(catalog, "a", [("a.x", "b.y"), ("c.v", "a.w")])) == {"b.y=x", "c.v=w", "c.v=w & b.y=x"}
    names = spark.createDataFrame([("T1",), ("T10",), ("-5",), ("!",), ("",)], "v string")
    assert [r[0] for r in names.select(ilp.prolog_name(F.col("v"))).collect()] == ["t1", "t10", "-5", "_", "_"]
    assert [r[0] for r in names.select(ilp.prolog_name(F.col("v"), lossy=True)).collect()] == ["t", "t", "-5", "_", "_"]


def rule_set(spark, rows):
    return spark.createDataFrame(rows, "rule_id string, tables array<string>, body_vars array<string>, head_vars array<string>, inclusion boolean")


def test_rule_sets(spark):
    own = rule_set(spark, [("o1", ["A_0", "b_0", "c_0"], ["x"], ["x"], False), ("o2", ["d_0", "e_0"], ["x"], ["x"], False)])
    other = rule_set(spark, [("i1", ["a", "b"], [], [], True), ("i2", ["a", "z"], [], [], True), ("t1", ["d", "e"], ["u"], ["u"], False), ("t2", ["d", "e"], ["u"], ["v"], False)])
    row = coverage.completeness(own, other).first()
    assert (row.joinable, row.matched) == (3, 2)
    pairs, share = coverage.greedy_coverage(own, other)
    assert pairs == [("o1", "i1"), ("o2", "t1")] and share == 0.5
    found = spark.createDataFrame([("A in B",), ("x in y",)], "signature string")
    truth = spark.createDataFrame([("a in b ",), ("c in d",), ("e in f",)], "signature string")
    row = coverage.precision_recall(found, truth).first()
    assert (row.true_positives, row.false_positives, row.false_negatives, row.precision) == (1, 1, 2, 0.5) and row.f1 == pytest.approx(0.4)


def test_strict_comparison(spark):
    own = spark.createDataFrame([("a", 0.5), (None, 0.1)], "k string, v double")
    other = spark.createDataFrame([("a", 0.52, True, True), ("a", 0.9, True, False), (None, 0.1, True, True), ("b", 0.5, False, True)], "k string, v double, correct boolean, compatible boolean")
    row = coverage.coverage_summary(coverage.compared(own, other, ["k"], {"v": 0.05})).first()
    assert (row.coverage_all, row.coverage_good) == (0.5, 1.0)
    assert coverage.coverage_summary(coverage.compared(own, other.limit(0), ["k"])).first() == (1.0, 1.0)


def test_compatibility_of_rules(spark):
    pairs = spark.createDataFrame([("r", "s"), ("s", "t")], "left string, right string")
    rules = spark.createDataFrame([("1", ["r"], ["s"]), ("2", ["t", "r"], ["s", "t"])], "rule_id string, body array<string>, head array<string>")
    assert {r.rule_id: r.compatible for r in coverage.horn_compatible(rules, pairs).collect()} == {"1": True, "2": False}
    predicates = spark.createDataFrame([("1", "r", "x"), ("1", "s", "x"), ("2", "r", "x"), ("2", "t", "x"), ("3", "r", "x")], "rule_id string, relation string, variable string")
    assert {r.rule_id: r.compatible for r in coverage.clause_compatible(predicates, pairs).collect()} == {"1": True, "2": False, "3": True}


def test_catalog_checks(spark):
    df = spark.createDataFrame([(1, [1])], "id int, list array<int>")
    with pytest.raises(ValueError):
        Catalog({"t": df}, Constraints(foreign={("t", "nope"): ("t", "id")}))
    with pytest.raises(ValueError):
        Catalog({})
    catalog = Catalog({"t": df}, Constraints({"t": ("id",)}))
    assert [(str(a), a.domain, a.is_key) for a in catalog.attributes()] == [("t.id", "int", True)] and len(catalog.attributes(False)) == 2
    assert catalog.row_counts() == {"t": 1} and isinstance(catalog.scan("t", ["x", "id"]).schema["id"].dataType, T.IntegerType)
