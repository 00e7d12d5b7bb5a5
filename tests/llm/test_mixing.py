import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarry.llm import mixing
from quarry.llm.mixing import MixParams, mix, mixed, share, sql


@settings(deadline=None, max_examples=12, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 5)), min_size=1, max_size=6), st.integers(0, 200))
def test_shares(spark, nodes, budget):
    budget = min(budget, sum(c for c, w in nodes if w))
    df = spark.createDataFrame([("p", f"n{i}", c, w, budget) for i, (c, w) in enumerate(nodes)], "parent string, name string, cap long, weight long, budget long")
    rows = share(df, ["parent"], "name").collect()
    assert sum(r.grant for r in rows) == (budget if any(w for _, w in nodes) else 0) and all(0 <= r.grant <= r.cap for r in rows)
    short = [r for r in rows if r.grant < r.cap and r.weight]
    for a in rows:
        for b in short:
            if a.weight:  # none that is full got more for its weight than one that is not, but for an odd token
                assert (a.grant - 1) * b.weight <= (b.grant + 1) * a.weight


def rows_of(spark, docs, params):
    return sorted(map(tuple, mixed(docs, params).collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (i % 17), ("en", "de", None)[i % 3], f"src{i % 7 if i % 2 else 0}", 1, "clash", 5) for i in range(700)]
    rows += [(None, "a b c", "en", "src1", 1, "clash", 5), (3, rows[3][1], "de", "src3", 1, "clash", 5), (3, rows[3][1], "de", "src3", 1, "clash", 5), (9000, None, "fr", None, 0, "clash", 5), (9001, "x y", "fr", "site", 0, "clash", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, domain string, epoch int").repartition(4)


@pytest.mark.parametrize("params", [mixing.QUERY, MixParams(budget_percent=100, max_epochs=3), MixParams({"language": {"en": 0, "de": 7}}, 150, 3, 4), MixParams({"domain": {"d0": 9}}, 30, 1)])
def test_equals_sql(spark, docs, params):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(sql(params))
    names = [d[0] for d in want.description]
    got = mixed(docs, params)
    assert names == got.columns
    assert rows_of(spark, docs, params) == sorted(want.fetchall(), key=str)


def test_budget_is_met_and_columns_stay(spark, docs):
    out = mix(docs, MixParams(budget_percent=50, max_epochs=2))
    total = sum(len((r.text or "").split()) for r in docs.collect())
    taken = out.collect()
    assert sum(r.take_tokens for r in taken) == total // 2
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "domain", "language", "origin", "epoch", "tokens", "take_tokens"]


def test_same_seed_same_choice(spark, docs):
    assert rows_of(spark, docs, mixing.QUERY) == rows_of(spark, docs.repartition(7), mixing.QUERY)


def test_empty_table(spark, docs):
    assert mixed(docs.limit(0)).count() == 0


def test_taken_texts_hold_the_budget(spark, docs):
    params = MixParams(budget_percent=37, max_epochs=2)
    total = sum(len((r.text or "").split()) for r in docs.collect())
    spaced = docs.drop("domain", "epoch").withColumn("text", mixing.F.concat(mixing.F.lit(" \t"), "text"))
    out = mixing.taken(spaced, params)
    rows = out.collect()
    assert out.columns == spaced.columns and sum(len((r.text or "").split()) for r in rows) == total * 37 // 100
    whole = {(r.doc_id, r.text) for r in spaced.collect()}
    cut = [r for r in rows if (r.doc_id, r.text) not in whole]
    assert cut and all(r.n_chars == len(r.text) and any(i == r.doc_id and t.startswith(r.text) for i, t in whole if t) for r in cut)
