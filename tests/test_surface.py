import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.cli import main
from quarry.functions import reports, rules as R, stats
from quarry.operators import coverage, ilp, kernel, scoring
from quarry.operators.kernel import Counter
from quarry.operators.triples import path_rules
from quarry.operators.values import ValueIndex, ind_measures
from quarry.plans import harness
from quarry.plans.discovery import discover
from quarry.plans.graph import graph_measures, neighbour_links
from quarry.plans.joingraph import Cell, Edge, possible_edges
from quarry.plans.miners import MINERS, miner
from quarry.plans.monitor import time_limit
from quarry.plans.search import enumerate_rules
from quarry.sources import generators, miners, sinks
from quarry.sources.catalog import Catalog, Constraints
from tests.test_relational import PAIRS, brute_join, small


def test_decimals_join_integers(spark):
    a = spark.sql("SELECT CAST(v AS DECIMAL(10, 2)) AS x FROM VALUES (1), (2), (0), (10.5), (100) t(v)")
    b = spark.createDataFrame([(1,), (2,), (0,), (100,), (None,)], "y long")
    catalog = Catalog({"a": a, "b": b})
    edges = [Edge.of(Cell("a", 0, "x"), Cell("b", 0, "y"))]
    assert kernel.count_rows(catalog, edges).first()["n"] == 4
    assert kernel.count_keys(catalog, edges, [Cell("a", 0, "x")]).first()["n"] == 4
    assert kernel.count_keys(Catalog({"a": a, "b": a.withColumnRenamed("x", "y")}), edges, [Cell("a", 0, "x")]).first()["n"] == 5


def test_counts_have_an_aggregate_under_every_join(spark):
    catalog, _ = small(spark)
    rows = kernel.count_rows(catalog, [Edge.of(Cell("b", 0, "z"), Cell("c", 0, "z"))])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    joins = plan[plan.index("Join") :]
    assert joins.count("Aggregate") == 2


@pytest.mark.parametrize("composite", [False, True])
def test_disjoint_counts_against_brute_force(spark, composite):
    rng = random.Random(7)
    rows = [(i if i % 5 else None, rng.randrange(3), rng.randrange(4)) for i in range(14)]
    catalog = Catalog({"t": spark.createDataFrame(rows, "k int, j int, v int")}, Constraints({"t": ("k", "j") if composite else ("k",)}))
    keys = (0, 1) if composite else (0,)
    edges = [Edge.of(Cell("t", 0, "v"), Cell("t", 1, "v")), Edge.of(Cell("t", 1, "v"), Cell("t", 2, "v"))][: 1 if composite else 2]
    n = 0
    for a in rows:
        for b in rows:
            for c in rows if len(edges) == 2 else [None]:
                own = [a, b] + ([c] if c else [])
                same = all(x[2] == a[2] for x in own)
                apart = all(x[k] is not None and y[k] is not None and x[k] != y[k] for i, x in enumerate(own) for y in own[:i] for k in keys)
                n += same and apart
    assert kernel.count_rows(catalog, edges, disjoint=True).first()["n"] == n


@pytest.mark.parametrize("seed", range(2))
def test_questions_answered_here_equal_those_in_spark(spark, seed):
    catalog, data = small(spark, seed)
    rules = random.Random(seed).sample(list(enumerate_rules(possible_edges(PAIRS, 2), 3, 3)), 25)
    asked = [(r, sorted(kernel.cells(r))[: 1 + i % 3]) for i, r in enumerate(rules)] + [([], [Cell("a", 0, "x"), Cell("a", 0, "w")])]
    here = Counter(catalog).prepare(c for r, k in asked for c in (*kernel.cells(r), *k))
    here.ask(asked)
    far = Counter(catalog, local_rows=0).prepare(c for r, k in asked for c in (*kernel.cells(r), *k))
    tight = Counter(catalog, meet_rows=0).prepare(c for r, k in asked for c in (*kernel.cells(r), *k))
    some = asked[:6] + asked[-1:]
    far.ask(some)
    tight.ask(some)
    assert here.asked["jobs"] == 3 and here.asked["here"] > 0 and far.asked["here"] == 0
    for q in some:
        assert here[q] == far[q] == tight[q]
    for rule, keys in asked[:-1]:
        want = {tuple(at[k.alias][k.column] for k in keys) for at in brute_join(data, rule)}
        assert here[rule, keys] == len({t for t in want if None not in t})
    for counter in (here, far, tight):
        counter.close()


def test_discovery_reports_and_stops(spark):
    catalog, _ = small(spark, 2)
    report = {}
    found = discover(catalog, 2, 2, 2, edges=possible_edges(PAIRS, 2), report=report)
    assert report["rules"] == found.count() > 0 and {"compatibility_s", "preparation_s", "candidates", "first_rule_s", "seconds", "questions"} <= set(report)
    with pytest.raises(TimeoutError):
        discover(catalog, 3, 3, 4, edges=possible_edges(PAIRS, 3), timeout_s=0.01)
    began = time.monotonic()
    with pytest.raises(TimeoutError), time_limit(spark, 1.5):
        spark.range(0, 1 << 40, 1, 4).selectExpr("sum(sqrt(id))").collect()
    assert time.monotonic() - began < 60
    with time_limit(spark, None) as clock:
        assert not clock.over and spark.range(3).count() == 3
    assert spark.range(5).count() == 5


def test_declared_pairs_have_their_count(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    catalog = Catalog({"a": a, "b": a.withColumnRenamed("k", "j")}, Constraints(foreign={("a", "k"): ("b", "j")}))
    assert [tuple(r) for r in ValueIndex(catalog).compatible().collect()] == [("a.k", "b.j", 2, True)]


def test_long_texts_are_indexed_whole(spark):
    long = "x" * 5000
    a = spark.createDataFrame([(long + "1",), (long + "2",), (long,)], "k string")
    b = spark.createDataFrame([(long + "1",), (long + "3",), (long,)], "j string")
    rows = ValueIndex(Catalog({"a": a, "b": b})).measured().collect()
    assert [(r.n_ab, r.n_a, r.n_b) for r in rows] == [(2, 3, 3)]


def test_inclusion_threshold_counts_joined_rows(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (1,), (3,)], "j long")
    catalog = Catalog({"a": a, "b": b})
    rows = [ind_measures(catalog, [("a.k", "b.j"), ("b.j", "a.k"), ("a.k", "z.q")], threshold=t).collect() for t in (0.5, 4)]
    assert [(r.dependant, r.overlap, r.joined, r.confidence, r.support) for r in sorted(rows[0], key=str)] == [("a.k", 1, 4, 0.25, 1 / 7), ("a.k", 0, 0, 0.0, 0.0), ("b.j", 1, 4, 1 / 3, 1 / 7)]
    assert [r.valid for r in sorted(rows[0], key=str)] == [True, False, True] and not any(r.valid for r in rows[1])


def test_other_shapes_of_rule_json():
    horn = {"type": "HornRule", "body": ["Predicate(variable1='x', relation='r', variable2='y')"], "head": "Predicate(variable1='x', relation='h', variable2='y')", "display": "d", "correct": None, "compatible": True}
    rule = R.from_json(horn)
    assert rule.head == (R.Predicate("x", "h", "y"),) and rule.compatible is True and R.from_json(R.to_json(rule)) == rule
    denial = {"type": "DenialConstraint", "table": "t", "conditions": ["age NOT > 30", "name = Ann Lee"], "correct": True, "compatible": None}
    assert R.from_json(denial).conditions == (R.DenialCondition("age", ">", "30", True), R.DenialCondition("name", "=", "Ann Lee"))
    assert R.parse_condition({"column_1": "a", "operator": "in", "value": ["x", "y"], "negation": True}) == R.DenialCondition("a", "in", "x, y", True)
    assert R.from_json({"body": [], "head": [], "display": None}).display == ""
    with pytest.raises(ValueError):
        R.parse_condition("age")


def test_examples_keep_nulls_apart(spark):
    head = spark.createDataFrame([(None, "a"), ("a", None), ("a", "a"), ("a", "a")], "x string, y string")
    catalog = Catalog({"h": head, "p": spark.createDataFrame([("a",)], "v string")})
    assert ilp.examples(catalog, "h").select("example").distinct().count() == 3
    chosen = ilp.greedy_cover(ilp.covered(catalog, "h", {"x": [("x", "p", "v")], "y": [("y", "p", "v")]}), {"x": 1, "y": 1})
    assert [n for _, n in chosen] == [2, 1]


def test_learning_prunes(spark):
    catalog, data = small(spark, 3)
    pairs = [("a.x", "b.y"), ("a.w", "c.v"), ("a.x", "empty.v")]
    held = Catalog({**catalog.tables, "empty": spark.createDataFrame([], "v long")}, catalog.constraints)
    chosen, facts = ilp.learn(held, "a", pairs, 2)
    assert facts["empty"] == 1 and facts["tried"] == 4 and chosen  # no body of two goes on from the empty one
    bad = spark.createDataFrame([(data["b"][0]["y"] or 0, None)], "x long, w long")
    chosen, facts = ilp.learn(held, "a", pairs, 1, excluded=bad)
    assert all("b.y" not in body for body, _ in chosen) or not facts["inconsistent"]


def test_medians_of_any_size(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.exponential(size=30_000), 3)
    df = spark.createDataFrame([(float(v), "ab"[i % 2] if i % 7 else None) for i, v in enumerate(values)], "v double, g string").repartition(3)
    groups = {r.g: r for r in stats.describe(df, "v", ["g"]).collect()}
    other = {r.g: r for r in stats.alternative(df, "v", ["g"]).collect()}
    for name in ("a", "b", None):
        own = np.sort([v for i, v in enumerate(values) if ("ab"[i % 2] if i % 7 else None) == name])
        assert groups[name].median == pytest.approx(np.median(own)) and groups[name].n == len(own) and other[name].upper_median == own[len(own) // 2]
    assert stats.describe(df, "v").first().median == pytest.approx(np.median(values)) and stats.alternative(df, "v").first().upper_median == np.sort(values)[15_000]
    nothing = stats.alternative(df.limit(0), "v").first()
    assert nothing.n == 0 and nothing.upper_median is None and stats.describe(df.limit(0), "v", ["g"]).count() == 0


def test_reports(spark):
    runs = spark.createDataFrame([(a, d, float(v)) for a, d, vs in (("x", "p", (1, 2, 3)), ("y", "p", (4, 5, 6)), ("x", "q", (1,)), ("y", "q", (2,))) for v in vs], "algorithm string, dataset string, duration double")
    rows = {(r.algorithm, r.dataset): r for r in reports.by_algorithm(runs).collect()}
    assert rows["x", "p"].mean == 2 and rows["y", "q"].std == 0 and rows["x", "p"].ci_low == pytest.approx(2 - 4.302653 / math.sqrt(3), abs=1e-4)
    pairs = {(r.dataset, r.test): r for r in reports.pairwise(runs).collect()}
    assert set(pairs) == {("p", "t"), ("q", "u")} and pairs["p", "t"].significant and not pairs["q", "u"].significant
    assert "| duration | p | x, y | t |" in reports.markdown(runs)
    with pytest.raises(ValueError):
        reports.by_algorithm(runs.drop("duration"))


def test_graph_measures():
    path = graph_measures("abcd", [("a", "b"), ("b", "c"), ("c", "d")])
    assert (path["diameter"], path["components"], path["density"], path["average_distance"]) == (3, 1, 0.5, pytest.approx(10 / 6))
    assert path["average_betweenness"] == pytest.approx((2 / 3 + 2 / 3) / 4) and path["global_clustering"] == 0 and path["algebraic_connectivity"] == pytest.approx(2 - math.sqrt(2))
    assert path["assortativity"] == pytest.approx(-0.5) and path["modularity"] == pytest.approx(1 / 6)
    two = graph_measures("abcdef", [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f")])
    assert two["diameter"] == math.inf and two["components"] == 2 and two["average_clustering"] == 1 and two["modularity"] == pytest.approx(0.5) and math.isnan(two["assortativity"])
    assert graph_measures([], []) == {} and graph_measures(["a"], [])["density"] == 0
    edges = possible_edges([(("a", "x"), ("b", "y")), (("b", "y"), ("c", "z"))], 1)
    assert neighbour_links(edges) == [tuple(edges)]


def test_registry(spark):
    catalog = generators.clinic(spark, 30)
    with pytest.raises(ValueError):
        miner("best")
    assert set(MINERS) == {"tgd", "inclusion", "horn", "path", "cover"}
    found = miner("Inclusion").discover(catalog, least=0.9)
    assert found.columns == ["miner", "kind", "rule", "support", "confidence"]
    assert "visit.arg1 ⊆ visit_name.arg1" in {r.rule for r in found.collect()}
    small_one = Catalog({t: catalog[t] for t in ("visit", "visit_name", "visit_type")}, Constraints(catalog.constraints.primary, {k: v for k, v in catalog.constraints.foreign.items() if k[0] == "visit"}))
    for name, params in (("tgd", {"max_occurrence": 1, "max_edges": 1}), ("horn", {}), ("path", {"length": 1}), ("cover", {"max_literals": 1})):
        rows = miner(name).discover(small_one, **params).collect()
        assert all(r.miner == name and r.support > 0 for r in rows) and (rows or name in ("horn", "path"))


def test_imperfect_generators(spark):
    data = generators.university(spark, seed=3)
    assert data.row_counts() == {"courses": 50, "course_names": 50, "departments": 5, "professors": 20, "professor_names": 20, "students": 100, "student_names": 100}
    got = {(r.dependant, r.referenced): (r.n_ab, r.n_a) for r in ValueIndex(data).inclusions(0.0).collect()}
    assert got["students.arg2", "student_names.arg1"] == (95, 96) and got["students.arg3", "departments.arg1"] == (5, 6)
    assert data["students"].where("arg3 is null").count() == 5 and data["courses"].where("arg3 = 'P999'").count() == 2
    star = generators.clinic(spark, 100, missing=5, odd_share=0.2, seed=1)
    assert star["visit_name"].count() == 95 and 5 < star["visit"].where("arg2 = '9'").count() < 40


def test_path_rules_against_brute_force(spark):
    rng = random.Random(9)
    rows = {(f"e{rng.randrange(12)}", rng.choice("pqr"), rng.choice([f"e{rng.randrange(12)}", f"v{rng.randrange(3)}"])) for _ in range(70)}
    df = spark.createDataFrame(sorted(rows), "subject string, predicate string, object string")
    body, head = {}, {}
    for s, p, o in rows:
        body.setdefault((p, f"{p}(X,{o})"), set()).add(s)
        head.setdefault((p, f"{p}(X,{o})"), set()).add(s)
        for s2, q, e in rows:
            if s2 == o and e != s:
                body.setdefault((p, f"{p}(X,A), {q}(A,{e})"), set()).add(s)
    want = {(f"{h} <= {b}", len(x & y), len(x)) for (p, b), x in body.items() for (q, h), y in head.items() if p != q and len(x) >= 2 and len(y) >= 2 and len(x & y) >= 2}
    assert {(r.rule, r.support, r.body_size) for r in path_rules(df).collect()} == want
    part = {r.rule for r in path_rules(df, sample=0.5, seed=4).collect()}
    assert part == {r.rule for r in path_rules(df, sample=0.5, seed=4).collect()} and len(part) < len(want)
    with pytest.raises(ValueError):
        path_rules(df, 3)


def test_free_text_and_wrapped_lines(spark, tmp_path):
    rule = miners.parse_rule_line("h(X,Y) <= b(X,A), c(A,Y)  conf=0.5 support: 0.25")
    assert [p.relation for p in rule.body] == ["b", "c"] and (rule.accuracy, rule.confidence) == (0.25, 0.5)
    assert miners.parse_rule_line("7\t3\t0.75\th(X,Y) <= b(X,Y)").confidence == 0.75
    assert miners.parse_rule_line("# h(X,Y) <= b(X,Y)") is None and miners.parse_rule_line("learning 5 rules") is None
    assert miners.unwrapped(["7\t3\t0.5\th(X,Y) <= b(X,A),", "  c(A,", "Y)", "next"]) == ["7\t3\t0.5\th(X,Y) <= b(X,A), c(A, Y)", "next"]
    (tmp_path / "log").write_text("2024-01-01 10:00:00 has 90 rules so far\n2024-01-01 10:01:30 left 42 rules\n")
    assert miners.log_facts(spark, str(tmp_path / "log")).first().rules == 42


def test_rule_set_operators(spark):
    compatible = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "left string, right string")
    wanted = spark.createDataFrame([("a", "c"), ("c", "a"), ("a", "x"), ("q", "q")], "left string, right string")
    assert {(r.left, r.right): r.compatible for r in coverage.transitively_compatible(compatible, wanted).collect()} == {("a", "c"): True, ("c", "a"): True, ("a", "x"): False, ("q", "q"): True}
    texts = ["∀ x0: visit_0(arg2=x0) ⇒ kind_0(arg1=x0)", "∀ x0, y0: a_0(b=x0, c=y0) ⇒ d_0(e=x0)", "∀ x0: a_0(b=x0) ⇒ ∃ z0: d_0(e=x0, f=z0)"]
    rules = spark.createDataFrame([(t,) for t in texts], "rule string")
    assert [(r.dependant, r.referenced) for r in coverage.as_inclusions(rules).collect()] == [("visit.arg2", "kind.arg1")]
    inclusions = spark.createDataFrame([("visit.arg2", "kind.arg1"), ("o.p", "q.r")], "dependant string, referenced string")
    assert coverage.inclusion_overlap(inclusions, rules).collect() == [("visit.arg2", "kind.arg1")]


IND = {"type": "InclusionDependency", "table_dependant": "visit", "columns_dependant": ["arg1"], "table_referenced": "visit_name", "columns_referenced": ["arg1"]}
TGD = {"type": "TGDRule", "body": ["Predicate(variable1='arg1', relation='visit_0', variable2='x0')"], "head": ["Predicate(variable1='arg1', relation='visit_name_0', variable2='x0')"], "display": "d", "accuracy": 0.5, "confidence": 0.9}


def test_scores_of_other_miners(spark, tmp_path):
    catalog = generators.clinic(spark, 40, missing=10)
    files = {"inclusion_run.json": [IND], "tgd_run.json": [TGD, TGD | {"accuracy": -1.0, "body": ["Predicate(variable1='a', relation='gone_0', variable2='x0')"], "confidence": 2.0}]}
    for name, held in files.items():
        (tmp_path / name).write_text(json.dumps(held))
    rows, summary = scoring.rescore(catalog, [str(tmp_path / n) for n in files])
    got = {(r.miner, r.rule_id): r for r in rows.collect()}
    assert got["inclusion", 0].score == 30 / 40 and got["inclusion", 0].support == 30 / 70 and got["inclusion", 0].correct
    assert (got["tgd", 0].support, got["tgd", 0].score, got["tgd", 0].correct) == (0.5, 0.9, True)
    assert (got["tgd", 1].support, got["tgd", 1].correct) == (0.0, False)
    by_miner = {r.miner: r for r in summary.collect()}
    assert (by_miner["tgd"].rules, by_miner["tgd"].valid, by_miner["tgd"].correct, by_miner["tgd"].faulty) == (2, 1, 1, 1)
    lone = scoring.with_tables(scoring.records(spark, "horn", [{"type": "HornRule", "body": [], "head": "h(a, b)"}]), catalog).first()
    assert lone.correct and lone.rows is None
    horn = {"type": "HornRule", "body": ["visit.arg1(a, b)"], "head": "visit_name.arg1(a, b)"}
    assert scoring.scored(scoring.records(spark, "horn", [horn]), catalog).first().support == 1.0  # 100 over 40 rows, at most 1
    assert scoring.scored(scoring.records(spark, "path", [horn]), catalog).first().support == 0.04
    assert scoring.faults("inclusion", {"type": "TGDRule"}) and scoring.faults("cover", {}) and not scoring.faults("tgd", TGD) and scoring.faults("horn", {"pca_confidence": 2, "body_size": 5}) == ["pca_confidence is out of range"]
    assert scoring.miner_of("x.json", [IND]) == "inclusion" and scoring.miner_of("a_horn_b.json", []) == "horn" and scoring.miner_of("x.json", [{"display": "a :- b"}]) == "cover"


def test_harness(spark, tmp_path):
    catalog, _ = small(spark, 4)
    few = Catalog({t: catalog[t] for t in ("a", "b")}, Constraints({}, {}))
    tracker = harness.Tracker(str(tmp_path))
    rows = harness.traversals(spark, few, "small", tracker=tracker, max_occurrence=1, max_edges=1).collect()
    assert len(rows) == 6 and {r.status for r in rows} == {"done"} and len({r.rules for r in rows}) == 1 and len(tracker.runs()) == 6
    runs, counts = harness.sensitivity(spark, few, (1, 2), max_occurrence=1, max_edges=1)
    assert runs.count() == 2 and all(r.tables <= r.max_tables for r in counts.collect())
    grown = harness.scalability(spark, lambda s, n: Catalog({"a": s.range(n)}), [10, 20], max_occurrence=2, max_edges=1).collect()
    assert [json.loads(r.parameters)["rows"] for r in grown] == [10, 20]
    failed = harness.measured(lambda report: 1 // 0, "tgd", "d", {})
    late = harness.measured(lambda report: discover(few, timeout_s=0.001).count(), "tgd", "d", {})
    assert failed[4] == "failed" and late[4] == "timeout"
    done = harness.study(spark, {"s": few}, {"inclusion": {"least": 0.5}}, str(tmp_path / "study"))
    assert done.first().status == "done" and spark.read.parquet(str(tmp_path / "study/inclusion/s")).count() == done.first().rules
    with pytest.raises(ValueError):
        harness.study(spark, {"s": few}, {"nope": {}}, str(tmp_path / "other"))


def test_pictures_and_facts(spark, tmp_path):
    rows = spark.createDataFrame([("a_b", 1.0, 2.0), ("a_b", 2.0, 4.0), ("c", 1.0, None)], "s string, x double, y double")
    text = sinks.tikz_plot(rows, "x", "y", "s", "rows", "seconds")
    assert "(1,2) (2,4)" in text and r"\addlegendentry{a\_b}" in text and "{c}" not in text
    edges = possible_edges([(("a", "x"), ("b", "y")), (("b", "y"), ("c", "z"))], 1)
    sinks.write_discovery_facts(str(tmp_path / "f.json"), {"seconds": 1.5}, edges)
    held = json.loads((tmp_path / "f.json").read_text())
    assert held["measures"]["seconds"] == 1.5 and held["graph"]["links"]["a_0.x = b_0.y"] == ["b_0.y = c_0.z"]


def test_command_line_of_the_rest(spark, tmp_path):
    for name in ("region", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"in/{name}.parquet"))
    out = ["--results", str(tmp_path / "out")]
    folder = str(tmp_path / "in")
    (tmp_path / "inclusion.json").write_text(json.dumps([{**IND, "table_dependant": "nation", "columns_dependant": ["n_regionkey"], "table_referenced": "region", "columns_referenced": ["r_regionkey"]}]))
    found = main(["metrics", folder, *out, "--rules", str(tmp_path / "inclusion.json")], spark)["miners"][0]
    assert (found["miner"], found["rules"], found["correct"], found["faulty"]) == ("inclusion", 1, 1, 0)
    (tmp_path / "tgd.json").write_text(json.dumps([{"body": ["Predicate(variable1='n_regionkey', relation='nation_0', variable2='x0')"], "head": ["Predicate(variable1='r_regionkey', relation='region_0', variable2='x0')"], "display": "t"}]))
    got = main(["coverage", str(tmp_path / "tgd.json"), str(tmp_path / "inclusion.json")], spark)
    assert (got["coverage"], got["completeness"], got["overlap"]) == (1.0, 1.0, 1)
    assert main(["mine", folder, *out, "--miner", "inclusion", "--param", "least=0.9"], spark)["rules"] >= 2
    runs = main(["bench", folder, *out, "--max-occurrence", "1", "--max-edges", "1", "--max-tables", "2"], spark)["runs"]
    assert len(runs) == 6 and all(r["status"] == "done" for r in runs)
    assert main(["info", folder, *out], spark)["graph"]["nodes"] > 0
    spark.createDataFrame([("x", "d", 1.0), ("x", "d", 2.0), ("y", "d", 5.0), ("y", "d", 6.0)], "algorithm string, dataset string, duration double").write.json(str(tmp_path / "runs"))
    assert main(["report", str(tmp_path / "runs"), "--out", str(tmp_path / "r.md")], spark)["report"] and "interval" in (tmp_path / "r.md").read_text()


def test_catalog_of_text_files(spark, tmp_path):
    (tmp_path / "people.csv").write_text("id,name\n1,Ann\n2,\n")
    held = Catalog.csv(spark, str(tmp_path), ["people"], Constraints({"people": ("id",)}))
    assert [tuple(r) for r in held["people"].orderBy("id").collect()] == [("1", "Ann"), ("2", None)]
    kept = Catalog.csv(spark, str(tmp_path), ["people"], empty_is_null=False)
    assert [r.name for r in kept["people"].orderBy("id").collect()] == ["Ann", ""]


def test_catalog_of_a_database(spark):
    """Derby comes with Spark."""
    url = "jdbc:derby:memory:held;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.format("jdbc").options(url=url, dbtable="T", **options).save()
    held = Catalog.jdbc(spark, url, ["T"], Constraints({"T": ("k",)}), **options)
    assert held.row_counts() == {"T": 2} and {str(a) for a in held.attributes()} == {"T.k", "T.v"}
    assert sorted(r[0] for r in held.scan("T", ["v", "none"]).collect()) == ["a", "b"]
