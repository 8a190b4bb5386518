"""Plans and results of queries whose cost grew faster than their input, and of checks that read small data only."""

import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from factloom.operators import facts, graph, marts, signal_pass
from factloom.plans.mart_queries import _facts
from factloom.plans.registry import Tables
from factloom.session import Rounds
from tools.check import compare


def test_relationships_walk_a_file_once(spark):
    action = {"type": "Http", "inputs": {"method": 7, "uri": "https://h/x"}}
    other = {"type": "ApiConnection", "inputs": {"method": "post", "path": "/t", "host": {"connection": {"name": "shared_sql"}}}, "runAfter": {"b": [], "a": []}}
    body = {"triggers": {"t1": {}, "t2": {}}, "actions": {"a": action, "b": "no node", "c": other}}
    defs = facts.workflow_definitions(spark.createDataFrame([("f", json.dumps(body))], "path string, text string"))
    got = {(r.source_type, r.source, r.kind, r.ref, r.operation) for r in facts.workflow_relationships(defs).collect()}
    begun = {("trigger", t, "action", a, "calls") for t in ("t1", "t2") for a in ("a", "b")}
    assert got == begun | {("action", "a", "http", "https://h/x", "calls"), ("action", "c", "sql", "/t", "reads")}
    rows = {r.name: r for r in facts.flatten_actions(defs).collect()}
    assert rows["a"].method == "7" and rows["b"].type is None and rows["c"].run_after == ["a", "b"] and rows["a"].run_after is None
    plan = facts.workflow_relationships(defs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and plan.count("MapInArrow") == 1


def against_sql(spark, name, folder, **tables):
    """The query and its check SQL over tables of a few rows."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    return compare(spark, str(folder), name, entry.queries()[name], entry.oracle_sql()[name], con)


def test_files_of_one_path_count_once(spark, tmp_path):
    docs = spark.range(1, 1303).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"))
    status, *_, note = against_sql(spark, "extractor_routing", tmp_path, documents=docs)
    assert status == "ok", note


def test_titles_with_every_entity(spark, tmp_path):
    html = "<title> a &lt;b&gt; &quot;c&quot;\x0b\n&#39;d&#39;&nbsp;&amp;lt; &amp; e</title><h1 class='x'>&quot;f&quot;</h1>"
    pages = spark.createDataFrame([(1, "u", html), (2, "u", "<h1></h1>"), (3, "u", None)], "page_id long, url string, html string")
    status, n, *_, note = against_sql(spark, "page_title_facts", tmp_path, pages=pages)
    assert (status, n) == ("ok", 2), note


def pair_sums(ids, pairs):
    """Betweenness by counting: for every s, t the share of shortest paths that pass a node."""
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in ids}
    dist, count = {}, {}
    for s in ids:
        d, c, level = {s: 0}, {s: 1}, [s]
        while level:
            later = []
            for x in level:
                for y in near[x]:
                    if y not in d:
                        d[y], c[y] = d[x] + 1, 0
                        later.append(y)
                    if d[y] == d[x] + 1:
                        c[y] += c[x]
            level = later
        dist[s], count[s] = d, c
    raw = {i: sum(count[s][i] * count[i][t] / count[s][t] for s in ids for t in ids
                  if len({s, t, i}) == 3 and t in dist[s] and i in dist[s] and dist[s][i] + dist[i][t] == dist[s][t]) for i in ids}
    return {i: raw[i] / ((len(ids) - 1) * (len(ids) - 2)) for i in ids}


def test_twins_count_as_all_of_them(spark):
    pairs = [(f"a{i}", f"b{j}") for i in range(4) for j in range(3)] + [("b0", "c"), ("c", "d")] + [("d", f"leaf{i}") for i in range(4)] + [("d", "e"), ("e", "f"), ("f", "c")]
    pairs += [("x0", f"y{i}") for i in range(3)] + [(f"p{i}", f"q{j}") for i in range(2) for j in range(2)]
    ids = sorted({x for p in pairs for x in p} | {"alone"})
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    edges = spark.createDataFrame([(*p, "t") for p in pairs], "src string, dst string, type string")
    want = pair_sums(ids, pairs)
    for most in (1000, 0):
        got = {r.id: r.betweenness for r in graph.betweenness(nodes, edges, max_nodes=most).collect()}
        assert got == pytest.approx(want), most
        assert {r.id for r in graph.articulation_points(nodes, edges, max_nodes=most).collect()} == {"b0", "c", "d", "x0"}, most


def test_pairs_of_twins_do_not_grow_with_them(spark):
    made = spark.range(40).select(F.concat(F.lit("a"), "id").alias("u")).crossJoin(spark.range(200).select(F.concat(F.lit("b"), "id").alias("v")))
    fewer, twins = graph._without_twins(graph.undirected(made.toDF("src", "dst")), Rounds(spark, depth=1 << 30))
    assert fewer.count() == 8 and twins.count() == 240 and twins.select("twin").distinct().count() == 2
    assert sorted(r.n for r in fewer.select("u", "n").distinct().collect()) == [1, 1, 39, 199]


def test_peers_of_one_group_are_many_tasks(spark):
    p = spark.range(2000).select(F.concat(F.lit("p"), "id").alias("process"), F.lit("c").alias("component"), F.when(F.col("id") < 50, "f").alias("family"), F.lit(None).cast("string").alias("module"))
    asked = p.filter("process IN ('p1', 'p77')").select("process")
    calls = spark.createDataFrame([("p1", "p2"), ("p1", "p2"), ("p1", "p1"), ("p9", "p77")], "src string, dst string")
    uses = spark.createDataFrame([("p1", "datastore", "v"), ("p3", "datastore", "v"), ("p1", "datastore", "w"), ("p3", "datastore", "w")], "process string, kind string, value string")
    out = marts.dependency_slice(p, calls, uses, asked)
    n = {(r.process, r.relation): r["count"] for r in out.groupBy("process", "relation").count().collect()}
    assert n == {
        ("p1", "calls"): 2, ("p77", "called_by"): 1, ("p1", "shared_datastore_with"): 1, ("p1", "component_peers"): 1999,
        ("p77", "component_peers"): 1999, ("p1", "family_peers"): 49,
    }
    held = out.filter("relation = 'component_peers'").groupBy(F.spark_partition_id()).count().collect()
    assert len(held) >= 8 and max(r["count"] for r in held) < 1000


def test_pairs_are_dealt_before_they_are_made_distinct(spark, tmp_path):
    p = spark.createDataFrame([(f"p{i}", None, None, None) for i in range(6)], "process string, component string, family string, module string")
    calls = spark.createDataFrame([], "src string, dst string")
    rows = [(f"p{i}", kind, v) for i in range(5) for kind in ("datastore", "identifier") for v in ("v", "w")] + [("p5", "datastore", "alone")]
    spark.createDataFrame(rows + rows[:7], "process string, kind string, value string").write.parquet(f"{tmp_path}/uses")
    out = marts.dependency_slice(p, calls, spark.read.parquet(f"{tmp_path}/uses"), p.filter("process IN ('p1', 'p5')").select("process"))
    assert sorted(map(tuple, out.collect())) == sorted(("p1", f"shared_{k}_with", f"p{i}") for i in (0, 2, 3, 4) for k in ("datastore", "identifier"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # neither the uses nor the pairs meet an exchange of their own to become distinct
    assert not re.search(r"Exchange hashpartitioning\(\w+#\d+, kind#\d+, value#", plan)
    assert re.search(r"Exchange hashpartitioning\(process#\d+, peer#\d+, \d+\), REPARTITION_BY_NUM", plan)


def test_what_reads_the_facts_exchanges_a_row_per_signal(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(signal_pass.dependencies(_facts(t)))
    assert plan(signal_pass.presence(_facts(t))).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["facet_scores", "feature_rollup", "cluster_summary"])
def test_edges_are_made_once(spark, name, monkeypatch):
    made, keep = [], Rounds.keep
    monkeypatch.setattr(Rounds, "keep", lambda self, df, *a, **b: made.append(any("lineitem" in f for f in df.inputFiles())) or keep(self, df, *a, **b))
    out = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert sum(made) == 1 and not any("lineitem" in f for f in out.inputFiles())
