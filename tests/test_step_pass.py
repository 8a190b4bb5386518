"""Step queries in one exchange per signal, against the joined operators and with hot signals."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import hot
from factloom.operators import steps as st
from factloom.plans import views  # noqa: F401
from factloom.plans.registry import Tables
from factloom.plans.step_queries import _control

ROOT = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark):
    """All steps of the first 300 signals; 40 signals are one, with several triggers, and some have no id."""
    t = Tables(spark, ROOT)
    key = F.when(F.col("signal_id") < 40, 7).when(F.col("signal_id") % 50 == 0, None).otherwise(F.col("signal_id"))
    # a step of the joined signal keeps a place of its own
    moved = lambda df: df.filter("signal_id < 300").withColumns({"k1": F.col("k1") * 1000 + F.col("signal_id"), "signal_id": key})
    steps, relations = moved(t.view("steps")), moved(t.view("relations"))
    triggers = t.view("triggers").filter("signal_id < 300 AND signal_id % 3 > 0").withColumn("signal_id", key)
    return steps, triggers, _control(t).filter("signal_id < 300").withColumn("signal_id", key), relations


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def both(monkeypatch, make):
    """Without and with hot signals."""
    plain = make()
    with monkeypatch.context() as m:
        m.setattr(hot, "GROUP", 60)
        m.setattr(hot, "SHARE", 10)
        m.setattr(hot, "COUNTERS", 1 << 8)
        split = make()
    assert "__hot" not in plain._jdf.queryExecution().optimizedPlan().toString() and "__hot" in split._jdf.queryExecution().optimizedPlan().toString()
    return rows(plain), rows(split)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_activities(tables, monkeypatch):
    steps = tables[0].select("signal_id", *st.ORDER, "name")
    plain, split = both(monkeypatch, lambda: st.activities(steps))
    assert plain == split and len(plain) == steps.count()
    assert plain == rows(st._activities_far(steps)) and exchanges(st.activities(steps)) == 1


def test_transitions(tables, monkeypatch):
    three = tables[:3]
    plain, split = both(monkeypatch, lambda: st.step_transitions(*three))
    assert plain == split == rows(st.transitions(three[0], st._least_start(*three))) and exchanges(st.step_transitions(*three)) <= 3


def test_flow(tables, monkeypatch):
    plain, split = both(monkeypatch, lambda: st.flow_links(*tables))
    nodes, edges = st.flow_graph(tables[0], tables[1], st.transitions(tables[0], st._least_start(*tables[:3])), tables[3])
    want = edges.unionByName(nodes.select("signal_id", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.concat(F.lit("node:"), "type").alias("kind")))
    assert plain == split == rows(want)


def test_traces(tables, monkeypatch):
    steps, triggers, _, relations = tables
    plain, split = both(monkeypatch, lambda: st.traces(steps, triggers, relations))
    deps = st.dependencies(st.invocations(steps), st.data_access(steps, relations), st.backfill_dependencies(relations))
    assert plain == split == rows(st.traceability(st.interfaces(steps, triggers), steps, deps))
