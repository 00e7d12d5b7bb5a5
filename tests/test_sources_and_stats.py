import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.cli import main
from quarry.functions import ranks, stats
from quarry.functions.rules import Predicate
from quarry.operators.triples import triples
from quarry.operators.values import ValueIndex
from quarry.sources import generators, miners, sinks
from quarry.sources.catalog import Catalog, Constraints
from quarry.sources.config import Settings, load_yaml


def test_sinks_round_trip(spark, tmp_path):
    people = spark.createDataFrame([(1, 'O"Hara', 2), (2, "tab b", None)], "id int, name string, boss int")
    catalog = Catalog({"people": people}, Constraints({"people": ("id",)}, {("people", "boss"): ("people", "id")}))
    sinks.write_csv(catalog, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/people")).count() == 2
    facts = triples(catalog)
    sinks.write_tsv(facts, str(tmp_path / "tsv"))
    assert set(sinks.read_tsv(spark, str(tmp_path / "tsv")).collect()) == set(facts.collect())
    sinks.write_turtle(facts, str(tmp_path / "ttl"))
    lines = {r.value for r in spark.read.text(str(tmp_path / "ttl/statements")).collect()}
    assert 'ex:people_1 ex:people.name "O\\"Hara" .' in lines and "ex:people_1 ex:people.boss ex:people_2 ." in lines
    sinks.write_adjacency(spark.createDataFrame([("a.x", "b.y")], "left string, right string"), str(tmp_path / "adj"))
    assert {r.attribute: r.compatible for r in spark.read.json(str(tmp_path / "adj")).collect()} == {"a___sep___x": ["b___sep___y"], "b___sep___y": ["a___sep___x"]}
    rules = spark.createDataFrame([("r1", 0.5, 0.1), ("r2", 0.9, 0.2)], "display string, accuracy double, confidence double")
    text = open(sinks.write_report(rules, str(tmp_path / "r.md"), "Run", {"seconds": 3})).read()
    assert text.index("r2") < text.index("r1") and "- rules: 2" in text
    assert r"a\_b & 50\% \\" in sinks.latex_table(spark.createDataFrame([("a_b", "50%")], "x string, y string"), ["x", "y"], "t")


def test_miner_files(spark, tmp_path):
    line = "{'type': 'ind', 'dependant': {'columnIdentifiers': [{'tableIdentifier': 'a.csv', 'columnIdentifier': 'x'}]}, 'referenced': {'columnIdentifiers': [{'tableIdentifier': 'b.csv', 'columnIdentifier': 'y'}]}}"
    found = miners.parse_inclusion(line)
    assert (found.table_dependant, found.columns_dependant, found.table_referenced) == ("a", ("x",), "b") and miners.parse_inclusion("oops") is None
    closed = "?a r ?b  ?b a.b.c ?c => ?a q ?c\t0.75\t0.5"
    rule = miners.parse_closed(closed)
    assert [p.relation for p in rule.body] == ["r", "a.b", "a.c"] and rule.head == (Predicate("a", "q", "c"),) and rule.confidence == 0.75 and rule.accuracy == -1
    (tmp_path / "c.tsv").write_text(closed + "\nLoaded 5\n")
    row = miners.closed_rules(spark, str(tmp_path / "c.tsv")).collect()
    assert len(row) == 1 and (row[0].confidence, row[0].support) == (0.75, 0.5)
    (tmp_path / "p.tsv").write_text("10\t5\t0.5\tr(X,Y) <= s(X,A), t(A,Y)\nnoise\n")
    row = miners.path_rules(spark, str(tmp_path / "p.tsv")).first()
    assert (row.support, row.correct, row.confidence) == (10, 5, 0.5)
    assert [p.relation for p in miners.parse_path(row.rule).body] == ["s", "t"] and miners.parse_path("s(X,f(a)) => r(X,b)").body[0].variable2 == "f(a)"
    (tmp_path / "log").write_text("2024-01-01 10:00:00 begin\n2024-01-01 10:01:30 found 42 rules\n")
    row = miners.log_facts(spark, str(tmp_path / "log")).first()
    assert (row.seconds, row.rules) == (90, 42)


def test_generators(spark):
    chain = generators.chain(spark, 500, 3, seed=1)
    assert all(n == 166 for n in chain.row_counts().values())
    found = {(r.dependant, r.referenced): r.coverage for r in ValueIndex(chain).inclusions(0.99).collect()}
    assert found["table2.table1_id", "table1.id"] == 1.0
    assert set(generators.patients(spark, 20).row_counts().values()) == {20}
    shop = generators.shop(spark, 1000)
    both = shop["orders"].join(shop["customers"], "customer_id").where(shop["orders"]["city"] != shop["customers"]["city"])
    assert both.count() == 0 and sum(shop.row_counts().values()) == 1000
    nulls = generators.broken(shop["orders"], "customer_id", 0.3, None, seed=2).where("customer_id is null").count()
    assert 70 < nulls < 170


def test_settings(tmp_path):
    assert load_yaml(str(tmp_path / "none.yaml")) == {}
    (tmp_path / "s.yaml").write_text("max_tables: 2\norder: dfs\n")
    assert Settings.read(str(tmp_path / "s.yaml"), order="cost", heuristic=None) == Settings(max_tables=2, order="cost")
    (tmp_path / "bad.yaml").write_text("what: 1\n")
    with pytest.raises(ValueError):
        Settings.read(str(tmp_path / "bad.yaml"))


def test_command_line(spark, tmp_path):
    for name in ("region", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"in/{name}.parquet"))
    (tmp_path / "spec.yaml").write_text("primary: {region: [r_regionkey], nation: [n_nationkey]}\nforeign: {nation.n_regionkey: region.r_regionkey}\n")
    shared = [str(tmp_path / "in"), "--spec", str(tmp_path / "spec.yaml"), "--results", str(tmp_path / "out")]
    assert main(["info", *shared], spark)["tables"] == {"nation": 25, "region": 5}
    assert main(["inds", *shared], spark)["inclusions"] >= 2
    assert main(["triples", *shared], spark)["triples"] == 5 + 50
    assert main(["discover", *shared, "--max-tables", "2", "--max-edges", "1", "--max-occurrence", "1"], spark)["rules"] >= 2
    assert json.loads((tmp_path / "out/statistics.json").read_text())["rules"] >= 2
    (tmp_path / "runs.json").write_text("\n".join(json.dumps({"algorithm": a, "duration": d}) for a, d in (("x", 1), ("x", 3), ("y", 5))))
    rows = main(["stats", str(tmp_path / "runs.json")], spark)["rows"]
    assert [(r["algorithm"], r["n"], r["mean"], r["std"]) for r in rows] == [("x", 2, 2.0, math.sqrt(2)), ("y", 1, 5.0, 0.0)]
    assert rows[0]["ci_high"] == pytest.approx(2 + 12.7062 * 1, abs=1e-3)


def frame(spark, a, b):
    return spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, v double")


def test_t_distribution():
    assert stats.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and stats.t_quantile(0.975, 4) == pytest.approx(2.776445, abs=1e-5)
    assert stats.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248) and stats.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)


def test_comparisons(spark):
    row = stats.t_test(frame(spark, [1, 2, 3, 4], [3, 4, 5, 6]), "v", "g", "a", "b").first()
    assert row.t == pytest.approx(-2.190890, abs=1e-6) and row.cohen_d == pytest.approx(1.549193, abs=1e-6)
    assert stats.t_test(frame(spark, [1], [2, 3]), "v", "g", "a", "b").first().t is None
    assert stats.compare_groups(frame(spark, [1], [2, 3]), "v", "g", "a", "b")["test"] == "u"
    found = stats.compare_groups(frame(spark, [1, 2, 3, 4], [3, 4, 5, 6]), "v", "g", "a", "b")
    assert found["test"] == "t" and found["p_value"] == pytest.approx(0.0710, abs=1e-3)
    row = stats.compare_times(frame(spark, [2], [0]), "v", "g", "a", "b").first()
    assert row.percent == math.inf and row.faster == "b"


@pytest.mark.parametrize("seed", range(3))
def test_u_against_brute_force(spark, seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(8) for _ in range(n)] for n in (25, 31))
    row = stats.u_test(frame(spark, a, b), "v", "g", "a", "b").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert float(row.u) == u and float(row.rank_biserial) == pytest.approx(abs(1 - 2 * u / (25 * 31)))
    assert row.z >= 0


def test_descriptive(spark):
    df = frame(spark, [1, 2, 3, 10], [5])
    rows = {r.g: r for r in stats.describe(df, "v", ["g"]).collect()}
    assert (rows["a"].median, rows["a"].min, rows["a"].max, rows["b"].std) == (2.5, 1, 10, 0.0)
    other = {r.g: r for r in stats.alternative(df, "v", ["g"]).collect()}
    assert other["a"].upper_median == 3 and other["a"].std == pytest.approx(math.sqrt(12.5))
    bands = spark.createDataFrame([(x,) for x in (0.49, 0.5, 0.8, 0.95, None)], "v double").select(stats.band(F.col("v"), "confidence")).collect()
    assert [r[0] for r in bands] == ["low", "fair", "good", "excellent", None]
    odd = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.1, float("nan"), float("inf"), None)], "v double")
    assert [r[0] for r in odd.select(stats.valid_metric(F.col("v"))).collect()] == [True, True, False, False, False, False]
    assert [r[0] for r in odd.select(stats.valid_metric(F.col("v"), False)).collect()] == [True, True, True, False, False, False]


def test_fallback_scores(spark):
    rows = spark.createDataFrame([(0,), (50,), (5000,)], "n long")
    got = rows.select(ranks.by_rows(F.col("n")), ranks.inverse_rows(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.5), (0.05, 1.0), (1.0, 0.02)]
    assert rows.select(ranks.stated_or(F.col("n").cast("double"), F.lit(0.3))).first()[0] == 0.3
