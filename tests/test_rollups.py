"""Rollups against small records worked out by hand."""

import random

import pytest

from factloom.operators import rollups


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_context_keeps_the_first_records_and_the_first_entries(spark):
    records = spark.createDataFrame([("g", i) for i in range(9)] + [("h", 20), ("h", 20), (None, 30)], "group string, id int")
    entries = [(i, "steps", k, f"s{k}") for i in (0, 5, 6, 20, 30) for k in range(3, 0, -1)] + [(0, "steps", 1, "s1"), (0, "unknown", 0, "x"), (0, "errors", None, "e"), (99, "steps", 0, "y")]
    sections = spark.createDataFrame(entries, "id int, section string, at int, item string")
    got = rows(rollups.compact_context(records, sections, {"steps": 2}))
    want = [("g", 0, "steps", 1, "s1"), ("g", 0, "steps", 2, "s1"), ("g", 0, "errors", 1, "e")]
    for g, i in (("g", 5), ("h", 20), (None, 30)):  # record 6 is the seventh of its group
        want += [(g, i, "steps", 1, "s1"), (g, i, "steps", 2, "s2")]
    assert got == sorted(want, key=repr)
    assert rows(rollups.compact_context(records.limit(0), sections)) == []


def test_every_limit_holds_and_one_record_may_hold_most_entries(spark):
    caps = {s: n for s, n in rollups.LIMITS.items() if s not in ("context", "evidence_index")}
    assert len(rollups.LIMITS) == 16
    records = spark.createDataFrame([("g", 1), ("g", 2)], "group string, id int")
    sections = spark.range(60_000).selectExpr("if(id % 10 = 0, 2, 1) AS id", f"element_at(array({', '.join(repr(s) for s in caps)}), cast(id % {len(caps)} as int) + 1) AS section", "id AS at", "cast(id AS string) AS item")
    got = rollups.compact_context(records, sections).groupBy("id", "section").count().collect()
    assert {(r["id"], r["section"]): r["count"] for r in got if r["id"] == 1} == {(1, s): n for s, n in caps.items()}


def test_evidence_of_a_group_counts_once(spark):
    ctx = spark.createDataFrame([("g", 1, "evidence", 1, "a"), ("g", 1, "evidence", 2, "b"), ("g", 2, "evidence", 1, "a"), ("g", 2, "steps", 1, "z"), ("h", 3, "evidence", 1, "a")],
                                "group string, id int, section string, rn bigint, item string")
    assert rows(rollups.evidence_index(ctx, {"evidence_index": 1})) == [("g", "a"), ("h", "a")]
    assert rows(rollups.evidence_index(ctx)) == [("g", "a"), ("g", "b"), ("h", "a")]


def test_io_summary_follows_order_and_caps(spark):
    values = [(1, "inputs", k, f"v{k % 3}") for k in range(15)] + [(1, "outputs", 0, None), (1, "other", 0, "x"), (2, "outputs", 0, "o")]
    idents = [(1, f"id{k:02}") for k in range(20)] * 2 + [(2, None)]
    got = rows(rollups.io_summary(spark.createDataFrame(values, "signal_id int, part string, at int, value string"), spark.createDataFrame(idents, "signal_id int, identifier string")))
    want = [(1, "inputs", k + 1, f"v{k % 3}") for k in range(10)] + [(1, "identifiers", k + 1, f"id{k:02}") for k in range(12)] + [(2, "outputs", 1, "o")]
    assert got == sorted(want, key=repr)


def test_names_are_numbered_as_first_seen(spark):
    rng = random.Random(3)
    data = [(rng.choice(["big"] * 9 + ["b", None]), rng.choice(["x", "y"]), rng.choice(["", None, "n1", "n2", "n3", "n4"]), rng.randrange(50)) for _ in range(400)]
    first = {}
    for c, lst, name, at in data:
        if name:
            first[c, lst, name] = min(at, first.get((c, lst, name), at))
    want = []
    for group in {k[:2] for k in first}:
        for rn, (_, name) in enumerate(sorted((at, k[2]) for k, at in first.items() if k[:2] == group), 1):
            want.append((*group, rn, name))
    assert rows(rollups.first_names(spark.createDataFrame(data, "component string, list string, name string, at int"))) == sorted(want, key=repr)


def test_component_without_steps_or_triggers_stays(spark):
    signals = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "signal_id int, component string")
    steps = spark.createDataFrame([(1, "http"), (1, "http"), (2, None), (2, "jms"), (4, ""), (9, "sql")], "signal_id int, connector string")
    triggers = spark.createDataFrame([(1, "timer"), (2, "http"), (2, "timer"), (4, None)], "signal_id int, type string")
    assert rows(rollups.component_insights(signals, steps, triggers)) == sorted(
        [("a", 2, 4, 2, "http,jms", "http,timer"), ("b", 1, 0, 0, "", ""), (None, 1, 1, 0, "", "")], key=repr)


def test_interfaces_of_a_family_count_once(spark):
    procs = spark.createDataFrame([("p", "f"), ("q", "f"), ("r", None)], "process string, family string")
    offers = spark.createDataFrame([("p", "http", "GET", "/a")] * 2 + [("p", "http", None, "/a"), ("p", "http", "", "/a"), ("q", "http", "GET", "/a"), ("x", "http", "GET", "/a")],
                                   "process string, kind string, method string, endpoint string")
    assert rows(rollups.family_interfaces(procs, offers)) == [("f", "p", "http", "", "/a"), ("f", "p", "http", "GET", "/a"), ("f", "q", "http", "GET", "/a")]


def test_changes_fall_into_six_lists(spark):
    data = [("c", "workflows", "added", 1), ("c", "routes", "added", 2), ("c", None, "removed", 3), ("", "workflows", "modified", 4), (None, "workflows", "removed", 5)]
    entries = rollups.change_entries(spark.createDataFrame(data, "component string, kind string, change string, key int"))
    assert rows(entries) == [("c", "added_integrations", 2), ("c", "added_workflows", 1), ("c", "removed_integrations", 3), ("ungrouped", "modified_workflows", 4), ("ungrouped", "removed_workflows", 5)]
    got = {r["component"]: r.asDict() for r in rollups.change_counts(entries).collect()}
    assert got["c"] == {"component": "c", "added_workflows": 1, "removed_workflows": 0, "modified_workflows": 0, "added_integrations": 1, "removed_integrations": 1, "modified_integrations": 0}
    assert len(got) == 2


def test_evidence_of_a_cluster_takes_two_of_each_member(spark):
    members = spark.createDataFrame([("k", f"n{i}") for i in range(5)] + [("m", "z")], "cluster string, id string")
    evidence = spark.createDataFrame([(f"n{i}", k, f"e{k}") for i in range(5) for k in range(3)] + [("lost", 0, "e")], "id string, at int, item string")
    assert rows(rollups.cluster_evidence(members, evidence)) == [("k", i * 2 + k + 1, f"n{i}", f"e{k}") for i in range(3) for k in range(2)]


@pytest.mark.parametrize("ends, integrity", [([], 1.0), ([("a", "b")], 1.0), ([("a", "b"), ("b", "gone")], 0.0), ([("a", None)], 0.0), ([("B", "a")], 0.0)])
def test_transitions_must_end_at_steps(spark, ends, integrity):
    steps = spark.createDataFrame([(1, "a", "http", "s", None, None, None), (1, "b", "Custom", None, None, None, None), (1, None, None, None, None, "u", None), (2, "gone", "MyFileReader", None, None, None, None)],
                                  "signal_id int, name string, connector string, sql_text string, destination string, url string, called_process string")
    trans = spark.createDataFrame([(1, a, b) for a, b in ends], "signal_id int, src string, dst string")
    got = {r["signal_id"]: r for r in rollups.step_coverage(steps, trans).collect()}
    assert (got[1]["known_ratio"], got[1]["evidence_ratio"], got[1]["transition_integrity"]) == (0.333, 0.667, integrity)
    assert (got[2]["known_ratio"], got[2]["transition_integrity"]) == (1.0, 1.0)


def test_coverage_counts_files_signals_and_errors_with_totals(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "path string, extractor string")
    got = rows(rollups.extractor_coverage(pairs(("r/a.js", "x"), ("r/b.js", "x"), ("q/c", "y")), pairs(("r/a.js", "x"), ("r/a.js", "x")), pairs(("q/c", "y"))))
    assert got == sorted([("x", "r", 2, 2, 0), ("x", None, 2, 2, 0), ("y", "q", 1, 0, 1), ("y", None, 1, 0, 1), (None, None, 3, 2, 1)], key=repr)


def test_control_edges_come_from_transitions_where_none_are_given(spark):
    rel = spark.createDataFrame([(1, "transition", "a", "b", "ok", None), (1, "transition", "a", "c", None, "else"), (1, "calls", "a", "d", None, None), (1, "transition", "a", "", None, None), (1, "transition", None, "b", None, None), (2, "transition", "a", "b", "ok", None)],
                                "signal_id int, rel_type string, source_name string, target_name string, operation string, branch string")
    given = spark.createDataFrame([(2, "x", "y")], "signal_id int, src string, dst string")
    assert rows(rollups.backfill_control_edges(rel, given)) == [(1, "a", "else", "c"), (1, "a", "ok", "b")]
