"""All facts in one pass against the operators that read each input on their own."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import marts, rules, signal_pass
from factloom.operators import steps as st
from factloom.plans import load_all
from factloom.plans.registry import Tables

load_all()
from factloom.plans.mart_queries import _facts, _quality  # noqa: E402
from factloom.plans.step_queries import _control, _deps, _identifiers  # noqa: E402

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, ROOT)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_dependencies_and_identifiers_are_those_of_the_operators(t):
    assert rows(signal_pass.dependencies(_facts(t))) == rows(_deps(t).select("signal_id", "bucket", "value"))
    assert rows(signal_pass.identifiers(_facts(t))) == rows(_identifiers(t).select("signal_id", "identifier"))


@pytest.mark.parametrize("field", ["interfaces", "invocations", "logging", "errors", "steps", "relationships", "triggers"])
def test_counts_are_those_of_the_operators(t, field):
    steps, trig = t.view("steps"), t.view("triggers")
    own = {
        "interfaces": lambda: st.interfaces(steps, trig), "invocations": lambda: st.invocations(steps), "logging": lambda: st.logging(steps),
        "errors": lambda: st.errors(steps, _control(t)), "steps": lambda: steps, "relationships": lambda: t.view("relations"), "triggers": lambda: trig,
    }[field]()
    want = {r.signal_id: r["count"] for r in own.groupBy("signal_id").count().collect()}
    got = {r.signal_id: r[field] for r in signal_pass.presence(_facts(t)).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if k in got} and len(got) == t.view("signals").count()


def test_one_signal_with_most_steps(spark):
    rnd, names = random.Random(3), ["kind string", "component string", "name string", "family string", "module string"]
    signals = spark.createDataFrame([(1, "workflow", "c", "hot", "f", "m", "/a/{orderId}"), (2, "db", "c", "none", "f", "m", None)], "signal_id long, " + ", ".join(names) + ", path string")
    kinds = ["jdbc", "jms", "http", "log", "mapper", "process", None]
    steps = [(1 if i % 30 else 2, i, i, i, rnd.choice(["a", "errorPath", "auditLog", None]), rnd.choice(kinds), f"Db{i % 40}", f"SELECT a FROM t{i % 9}", f"q{i % 5}", f"P{i % 60}", "OrderId,x", "http://u", "GET") for i in range(3000)]
    cols = "signal_id long, pos int, k1 long, k2 long, name string, connector string, datasource string, sql_text string, destination string, called_process string, inputs_keys string, url string, method string"
    steps = spark.createDataFrame(steps, cols)
    rel = spark.createDataFrame([(1, "calls", "s", "activity", "sql_table", "T1", "reads")] * 5, "signal_id long, rel_type string, source_name string, source_type string, target_kind string, target_ref string, operation string")
    trig = spark.createDataFrame([(1, "http", "start", "GET", "/x")], "signal_id long, type string, name string, method string, path string")
    moves = spark.createDataFrame([], "signal_id long, src string, dst string, condition string")
    found = signal_pass.facts(signals, steps, rel, trig, moves)
    got = {r.signal_id: r for r in signal_pass.presence(found).collect()}
    for field, own in {"interfaces": st.interfaces(steps, trig), "invocations": st.invocations(steps), "logging": st.logging(steps), "errors": st.errors(steps, moves)}.items():
        assert {r.signal_id: r["count"] for r in own.groupBy("signal_id").count().collect()} == {k: r[field] for k, r in got.items() if r[field]}, field
    data = st.data_access(steps, rel)
    assert rows(signal_pass.dependencies(found)) == rows(st.dependencies(st.invocations(steps), data, st.backfill_dependencies(rel)).select("signal_id", "bucket", "value"))
    assert got[1].steps + got[2].steps == 3000 and got[1].relationships == 5 and got[2].name == "none"


@pytest.mark.parametrize("make", [_quality, lambda t: signal_pass.dependencies(_facts(t))])
def test_plan_reads_what_was_written_and_little_else(t, make):
    plan = make(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 and plan.count("Exchange hashpartitioning") <= 6


def test_worklist_order_and_entries(spark):
    cols = "signal_id long, name string, component string, family string, score long, interfaces long, invocations long, processes long, has_details boolean, ok boolean"
    q = spark.createDataFrame([
        (1, "b", "c1", "fam", 14, 1, 0, 0, True, True), (2, "a", "c1", "fam", 15, 0, 0, 0, True, True), (3, "z", "c2", "fam", 30, 9, 9, 9, True, False),
        (4, "low", "bin", "other", 2, 0, 0, 0, True, True), (5, "x", "c4", "bare", 1, 0, 0, 0, False, False)], cols)
    shared = spark.createDataFrame([(1, 2)], "signal_id long, shared_data long")
    clusters = spark.createDataFrame([("orders-core",), ("orders-core",)], "slug string")
    got = [tuple(r) for r in marts.worklist(q, shared, clusters, F.col("ok"), skip=("bin",)).collect()]
    assert got == [
        ("b – Process Brief", "process", 1, 17, "high"), ("a – Process Brief", "process", 1, 15, "high"),
        ("Orders Core – Constellation Brief", "constellation", 2, None, None), ("fam – Family Brief", "family", 2, None, None), ("other – Family Brief", "family", 2, None, None),
        ("Anti-Pattern Register", "quality", 3, None, None), ("c1 – Component Brief", "component", 3, None, None), ("c2 – Component Brief", "component", 3, None, None),
        ("low – Process Brief", "process", 4, 2, "low"), ("Repository Comprehensive Narrative", "repo_final", 5, None, None)]
    assert marts.worklist(q.limit(0), shared, clusters.limit(0), rules.F.lit(True)).count() == 0
