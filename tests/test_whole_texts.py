"""Facts over line breaks, malformed and real-shaped XML, tree paths, removals and batches."""

from pyspark.sql import functions as F

from factloom.operators import facts, ordered, retrieval
from factloom.sources import corpus
from factloom.streaming import streams


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_routes_and_calls_over_two_lines(spark):
    f = files(spark, ("a.js", "const x = 1;\napp.get(\n  '/users/:id',\n  h);\nrouter.post('/a', h)\n\n axios.get(\n 'https://svc.local/x')\n"))
    got = sorted((r.line, r.method, r.route) for r in facts.source_routes(f).collect())
    assert got == [(2, "GET", "/users/:id"), (5, "POST", "/a")]
    calls = [(r.line, r.rule_id, r.value) for r in facts.rule_facts(f, facts.TEXT_RULES).collect()]
    assert calls == [(7, "client_call", "https://svc.local/x")]


def test_lines_of_many_hits(spark):
    text = "\n".join(f"event e{i}" if i % 3 else "none" for i in range(50))
    got = sorted((r.line, r.value) for r in facts.rule_facts(files(spark, ("a.srw", text)), facts.SCRIPT_RULES).filter("rule_id = 'event'").collect())
    assert got == [(i + 1, f"e{i}") for i in range(50) if i % 3]


def test_malformed_xml_is_a_failure_and_no_more(spark):
    f = files(spark, ("good.xml", '<?xml version="1.0"?>\n<!-- c --><a><b x="1"/></a>'), ("bad.xml", "<a><b></a>"), ("two.bwp", "<a/><b x='2'/>"), ("none.xml", "no < xml"), ("ok.json", "{}"), ("bad.json", "{"))
    got = sorted((r.path, r.value) for r in facts.xml_attributes(f, {"b": "//b/@x"}).collect())
    assert got == [("good.xml", "1"), ("two.bwp", "2")]
    assert sorted(r.path for r in facts.parse_failures(f).collect()) == ["bad.json", "bad.xml", "none.xml"]
    acts, moves = facts.process_activities(f)
    assert acts.count() == 0 and moves.count() == 0


def test_process_in_its_usual_shapes(spark):
    text = """<?xml version="1.0"?>
<bpws:process name="shop.Order" xmlns:bpws="u" xmlns:xmi="x">
  <bpws:receiveEvent id="r1" name="OnHttp" type="bw.http.HTTPReceiver"/>
  <!-- <bpws:invoke name="Ghost"/> -->
  <bpws:invoke xmi:id="i1" displayName="Call &amp; Wait"/>
  <activity name="Store" type="bw.JDBCUpdate"/>
  <activity name="Store" type="again"/>
  <transition sourceRef="r1" targetRef="i1"/>
  <bpws:transition><bpws:from value="i1"/><bpws:to>Store</bpws:to></bpws:transition>
  <controlTransition from="Store"/>
</bpws:process>"""
    acts, moves = facts.process_activities(files(spark, ("p.bwp", text)))
    assert [(r.name, r.connector) for r in acts.orderBy("pos").collect()] == [("shop.Order", None), ("OnHttp", "http"), ("Call & Wait", "process"), ("Store", "jdbc")]
    assert sorted((r.src, r.dst) for r in moves.collect()) == [("Call & Wait", "Store"), ("OnHttp", "Call & Wait")]


def test_statement_verb_is_the_word_it_opens_with(spark):
    rows = facts.sql_statements(files(spark, ("a.srw", "dw_x.update()\nselect a from t;\ninsert into u values (1);"))).collect()
    assert [(r.verb, r.crud) for r in sorted(rows, key=lambda r: r.pos)] == [("UPDATE", "write"), ("INSERT", "write")]


def test_tree_paths_and_sizes(spark, tmp_path):
    root = tmp_path / "r"
    deep = root / ("x" + str(root).strip("/"))
    deep.mkdir(parents=True)
    (deep / "y.py").write_text("a")
    (root / "z.txt").write_text("b" * 50)
    got = sorted(r.path for r in corpus.read_tree(spark, str(root)).collect())
    assert got == sorted([str((deep / "y.py").relative_to(root)), "z.txt"])
    assert [r.size_bytes for r in corpus.read_tree(spark, str(root), max_bytes=10).collect()] == [1]


def test_nested_actions_to_any_depth():
    tree = {"leaf": {"type": "Http"}}
    for i in range(300):
        tree = {f"n{i}": {"type": "Scope", "actions": tree}}
    rows = list(facts.nested_actions(tree))
    assert len(rows) == 301 and max(r[2] for r in rows) == 300
    switch = {"s": {"type": "Switch", "cases": {"a": {"actions": {"x": {}}}, "b": {}}, "default": {"actions": {"y": 5}}}, "p": {"type": "ParallelBranch", "actions": {"branches": [{"actions": {"z": {}}}]}}}
    assert sorted((r[0], r[1], r[3]) for r in facts.nested_actions(switch) if r[0]) == [("p", "Parallel.Branch1", "z"), ("s", "Switch.Default", "y"), ("s", "Switch.a", "x")]


def test_feed_reports_removed_keys(spark, tmp_path):
    step = streams.change_feed("key", f"{tmp_path}/v", f"{tmp_path}/f", tombstone="gone")
    schema = "key bigint, n bigint, gone boolean, version int"
    step(spark.createDataFrame([(1, 1, False, 0), (2, 1, None, 0), (3, 1, False, 0)], schema), 0)
    step(spark.createDataFrame([(1, 2, False, 1), (2, 1, True, 1), (4, 1, False, 1), (9, 0, True, 1)], schema), 1)
    got = sorted((r.key, r.change) for r in spark.read.parquet(f"{tmp_path}/f").filter("batch = 1").collect())
    assert got == [(1, "modified"), (2, "removed"), (4, "added")]


def test_numbering_all_rows(spark):
    df = spark.range(0, 1000, 1, 7).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("name"))
    got = ordered.global_index(df, ["name"], "no").orderBy("name").collect()
    assert [r.no for r in got] == list(range(1, 1001))


def test_queries_in_blocks_give_the_same_hits(spark, monkeypatch):
    vec = lambda i: [float((i * 7) % 11 - 5), float(i % 5), 1.0]
    chunks = spark.createDataFrame([(i, vec(i)) for i in range(60)], "chunk_id int, vector array<float>")
    queries = spark.createDataFrame([(i, vec(i + 3)) for i in range(25)], "query_id int, vector array<float>")
    rows = lambda df: sorted((r.query_id, r.chunk_id, r["rank"]) for r in df.collect())
    whole = rows(retrieval.top_k(queries, chunks, 4))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 10)
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 7)
    assert rows(retrieval.top_k(queries, chunks, 4)) == whole


def test_marks_in_a_text_make_no_phantom_hits(spark):
    files = spark.createDataFrame([("a.js", "app.get<\x01>('/a')\napp.get(\n'/users/:id')\n\x01 router.put('/x', h)")], "path string, text string")
    got = sorted((r.line, r.method, r.route) for r in facts.source_routes(files).collect())
    assert got == [(2, "GET", "/users/:id"), (4, "PUT", "/x")]


def test_many_named_elements(spark):
    import time

    body = "".join(f'<activity name="n{i % 40000}" id="i{i}" type="t.jdbc"/>' for i in range(50_000))
    moves = "".join(f'<transition from="i{i}" to="n{i + 1}"/>' for i in range(0, 3000))
    files = spark.createDataFrame([("p.bwp", f"<p>{body}{moves}</p>")], "path string, text string")
    acts, trans = facts.process_activities(files)
    began = time.time()
    names = [r.name for r in acts.orderBy("pos").collect()]
    assert names[:40_000] == [f"n{i}" for i in range(40_000)] and len(names) == 40_000
    assert {(r.src, r.dst) for r in trans.collect()} == {(f"n{i}", f"n{i + 1}") for i in range(3000)}
    assert time.time() - began < 60
