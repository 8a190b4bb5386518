"""Graph, component, distance and centrality queries on the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import graph, marts, rollups
from factloom.plans import views  # noqa: F401  (registers the shared views)
from factloom.plans.registry import query, view
from factloom.session import Rounds

view("geo_pairs", "SELECT DISTINCT u, v FROM (SELECT src AS u, dst AS v FROM $geo_edges UNION ALL SELECT dst, src FROM $geo_edges) WHERE u <> v")
view("geo_weighted", "SELECT src, dst, min(CASE type WHEN 'depends_on' THEN 0.5 WHEN 'publishes_to' THEN 1.5 ELSE 1.0 END) AS w FROM $geo_edges GROUP BY 1, 2")

# smallest reachable id per node, by closure
_COMPONENTS = """
    RECURSIVE cc(id, r) AS (SELECT id, id FROM $geo_nodes UNION SELECT p.v, cc.r FROM cc JOIN $geo_pairs p ON p.u = cc.id)"""


def _geo(t):
    return t.view("geo_nodes"), t.view("geo_edges")


def _geo_kept(t):
    """The graph written once, for queries that look at it several times: its edges come from all line items."""
    keep = lambda name: t.kept(name, lambda: Rounds(t.spark).keep(t.view(name)))
    return keep("geo_nodes"), keep("geo_edges")


def _scored(t):
    """Nodes, edges, distance features and cut nodes of the written graph."""
    nodes, edges = _geo_kept(t)
    markers = nodes.filter("type = 'Component'").select("id")
    return nodes, edges, graph.distance_features(nodes, graph.marker_distances(edges, markers)), graph.articulation_points(nodes, edges)


@query("graph_degrees", """
    SELECT type, id, degree FROM (SELECT n.type, n.id, count(e.i) AS degree, row_number() OVER (PARTITION BY n.type ORDER BY count(e.i) DESC, n.id) AS rn
      FROM $geo_nodes n LEFT JOIN (SELECT src AS i FROM (SELECT DISTINCT src, dst FROM $geo_edges) UNION ALL SELECT dst FROM (SELECT DISTINCT src, dst FROM $geo_edges)) e ON e.i = n.id GROUP BY 1, 2) WHERE rn <= 3""")
def graph_degrees(t):
    from factloom.operators.ordered import top_per_key

    nodes, edges = _geo(t)
    return top_per_key(graph.degrees(nodes, edges).select("type", "id", "degree"), ["type"], [F.desc("degree"), F.col("id")], 3)


@query("type_degrees", """
    SELECT id, key, count(*) AS n FROM (
      SELECT src AS id, unnest([type || '_out', 'deg_out']) AS key FROM $geo_edges UNION ALL SELECT dst, unnest([type || '_in', 'deg_in']) FROM $geo_edges) GROUP BY 1, 2""")
def type_degrees(t):
    return graph.type_degrees(t.view("geo_edges"))


@query("edge_weights", "SELECT type, CAST(CASE type WHEN 'depends_on' THEN 0.5 WHEN 'publishes_to' THEN 1.5 ELSE 1.0 END AS DOUBLE) AS weight, count(*) AS n FROM $geo_edges GROUP BY 1, 2")
def edge_weights(t):
    e = t.view("geo_edges").select("type", graph.edge_weight(F.col("type")).alias("weight"))
    return e.groupBy("type", "weight").agg(F.count(F.lit(1)).alias("n"))


@query("components", f"WITH {_COMPONENTS} SELECT id, min(r) AS component FROM cc GROUP BY 1")
def components(t):
    return graph.connected_components(*_geo(t))


@query("page_components", """
    WITH RECURSIVE e AS (SELECT DISTINCT 'page:' || CAST(page_id AS STRING) AS p, 'link:' || unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS l FROM pages),
    b AS (SELECT p AS u, l AS v FROM e UNION SELECT l, p FROM e), n AS (SELECT DISTINCT u AS id FROM b UNION SELECT 'page:' || CAST(page_id AS STRING) FROM pages),
    cc(id, r) AS (SELECT id, id FROM n UNION SELECT b.v, cc.r FROM cc JOIN b ON b.u = cc.id),
    m AS (SELECT id, min(r) AS component FROM cc GROUP BY 1)
    SELECT component, count(*) AS members FROM m GROUP BY 1""")
def page_components(t):
    links = t.pages.select(
        F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("src"),
        F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("h"),
    ).select("src", F.concat(F.lit("link:"), "h").alias("dst"))
    pages = t.pages.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("id"))
    nodes = pages.unionByName(links.select(F.col("dst").alias("id"))).distinct()
    return graph.connected_components(nodes, links).groupBy("component").agg(F.count(F.lit(1)).alias("members"))


_MARKERS = "SELECT id AS m FROM $geo_nodes WHERE type = 'Component'"
_DIST = f"""
    RECURSIVE d(m, node, dist) AS (SELECT m, m, CAST(0 AS DOUBLE) FROM ({_MARKERS}) UNION
      SELECT d.m, w.dst, d.dist + w.w FROM d JOIN $geo_weighted w ON w.src = d.node WHERE d.dist < 8),
    best AS (SELECT m AS marker, node, min(dist) AS dist FROM d GROUP BY 1, 2)"""


def _markers(t):
    return t.view("geo_nodes").filter("type = 'Component'").select("id")


@query("marker_distances", f"WITH {_DIST} SELECT marker, node, dist FROM best")
def marker_distances(t):
    return graph.marker_distances(t.view("geo_edges"), _markers(t))


@query("distance_features", f"""
    WITH {_DIST} SELECT n.id, min_by(b.marker, (b.dist, b.marker)) AS nearest_marker, min(b.dist) AS nearest_distance, avg(b.dist) AS avg_distance,
      quantile_cont(b.dist, 0.5) AS p50, quantile_cont(b.dist, 0.9) AS p90, count(b.dist) FILTER (b.dist <= 4) AS anchors_within_r, avg(b.dist) FILTER (b.dist <= 4) AS avg_anchor_distance
    FROM $geo_nodes n LEFT JOIN best b ON b.node = n.id GROUP BY 1""")
def distance_features(t):
    return graph.distance_features(t.view("geo_nodes"), graph.marker_distances(t.view("geo_edges"), _markers(t)))


# shortest path counts by level, then n^3 pair dependencies
_BETWEEN = """
    RECURSIVE lv(s, node, l) AS (SELECT id, id, 0 FROM $geo_nodes UNION ALL SELECT DISTINCT lv.s, p.v, lv.l + 1 FROM lv JOIN $geo_pairs p ON p.u = lv.node WHERE lv.l < 40),
    d AS (SELECT s, node, min(l) AS l FROM lv GROUP BY 1, 2),
    f(s, node, l, paths) AS (SELECT id, id, 0, CAST(1 AS DOUBLE) FROM $geo_nodes UNION ALL
      SELECT f.s, p.v, f.l + 1, sum(f.paths) FROM f JOIN $geo_pairs p ON p.u = f.node JOIN d ON d.s = f.s AND d.node = p.v AND d.l = f.l + 1 GROUP BY 1, 2, 3),
    dep AS (SELECT a.node AS id, sum(a.paths * b.paths / st.paths) AS raw FROM f a JOIN f b ON b.s = a.node JOIN f st ON st.s = a.s AND st.node = b.node
      WHERE a.s <> a.node AND b.node <> a.node AND b.node <> a.s AND a.l + b.l = st.l GROUP BY 1),
    bc AS (SELECT n.id, n.type, coalesce(dep.raw, 0) / ((SELECT count(*) FROM $geo_nodes) - 1) / ((SELECT count(*) FROM $geo_nodes) - 2) AS betweenness FROM $geo_nodes n LEFT JOIN dep ON dep.id = n.id)"""


@query("central_nodes", f"WITH {_BETWEEN} SELECT id, round(betweenness, 9) AS betweenness FROM bc")
def central_nodes(t):
    return graph.betweenness(*_geo(t)).select("id", F.round("betweenness", 9).alias("betweenness"))


# a node is a cut node when a walk that avoids it misses part of its component
_CUT = f"""
    {_COMPONENTS}, comp AS (SELECT id, min(r) AS component FROM cc GROUP BY 1), sz AS (SELECT component, count(*) AS n FROM comp GROUP BY 1),
    st AS (SELECT c.id AS x, min(o.id) AS s FROM comp c JOIN comp o ON o.component = c.component AND o.id <> c.id GROUP BY 1),
    rw(x, node) AS (SELECT x, s FROM st UNION SELECT rw.x, p.v FROM rw JOIN $geo_pairs p ON p.u = rw.node WHERE p.v <> rw.x),
    cut AS (SELECT rw.x AS id FROM rw JOIN comp ON comp.id = rw.x JOIN sz ON sz.component = comp.component GROUP BY rw.x, sz.n HAVING count(*) < sz.n - 1)"""


@query("cut_nodes", f"WITH {_CUT} SELECT id FROM cut")
def cut_nodes(t):
    return graph.articulation_points(*_geo(t))


@query("cut_nodes_joined", f"WITH {_CUT} SELECT id FROM cut")
def cut_nodes_joined(t):
    """The same result by the path meant for components too large for one task."""
    return graph.articulation_points(*_geo(t), max_nodes=0)


@query("marker_selection", f"""
    WITH {_BETWEEN}, deg AS (SELECT n.id, n.type, count(e.i) AS degree FROM $geo_nodes n LEFT JOIN (SELECT src AS i FROM (SELECT DISTINCT src, dst FROM $geo_edges) UNION ALL SELECT dst FROM (SELECT DISTINCT src, dst FROM $geo_edges)) e ON e.i = n.id GROUP BY 1, 2),
    u AS (SELECT 'Component:ASIA' AS id, 0 AS stage UNION ALL SELECT * FROM (SELECT id, 1 FROM bc ORDER BY round(betweenness, 12) DESC, id LIMIT 3)
      UNION ALL SELECT * FROM (SELECT id, 2 FROM deg WHERE type IN ('Workflow', 'API', 'Operation') ORDER BY degree DESC, id LIMIT 3))
    SELECT id, CAST(min(stage) AS INT) AS stage FROM u GROUP BY 1""")
def marker_selection(t):
    nodes, edges = _geo_kept(t)
    central = graph.betweenness(nodes, edges).withColumn("betweenness", F.round("betweenness", 12))
    return graph.select_markers(nodes, edges, central, k=3, include=("Component:ASIA",)).select("id", "stage")


@query("facet_scores", f"""
    WITH {_CUT.replace('RECURSIVE', 'RECURSIVE', 1)}, {_DIST.replace('RECURSIVE', '')},
    near AS (SELECT node, min(dist) AS dist FROM best WHERE node IN (SELECT id FROM $geo_nodes) GROUP BY 1),
    c AS (SELECT count(*) FILTER (type = 'Operation') AS ops, count(*) FILTER (type = 'API') AS apis, count(*) FILTER (type = 'MessageTopic') AS events, count(*) FILTER (type = 'Datastore') AS dbs,
      count(*) FILTER (type = 'InfraResource') AS infra, count(*) FILTER (type = 'Doc') AS docs, count(*) AS n FROM $geo_nodes),
    x AS (SELECT c.*, 0.3 * (ops > 0)::INT + 0.2 * (apis > 0)::INT + 0.2 * (events > 0)::INT + 0.15 * (dbs > 0)::INT + 0.1 * (infra > 0)::INT + 0.05 * (docs > 0)::INT AS base,
      (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM $geo_edges)) AS e, (SELECT avg(dist) FROM near) AS an, (SELECT count(*) FROM near) AS re, (SELECT count(*) FROM near WHERE dist <= 4) AS nr, (SELECT count(*) FROM cut) AS art FROM c)
    SELECT ops, apis, events, dbs, infra, docs, n, e, round(CAST(base AS DOUBLE), 3) AS base_score, round(CAST(0.7 * base + 0.1 / (1 + an) + 0.1 * nr / n + 0.1 * re / n - least(0.15, art / n * 0.5) AS DOUBLE), 3) AS score,
      round(an, 3) AS avg_nearest, round(re / n, 3) AS reachable_ratio, nr AS anchors_within_r, art AS articulation, round(e / (n * (n - 1)), 6) AS density FROM x""")
def facet_scores(t):
    return marts.blended_score(*_scored(t))


@query("alternate_facet_score", """
    WITH c AS (SELECT count(*) FILTER (type = 'Operation') AS ops, count(*) FILTER (type = 'API') AS apis, count(*) FILTER (type = 'Datastore') AS dbs, count(*) FILTER (type = 'InfraResource') AS infra,
      count(*) FILTER (type = 'Doc') AS docs, CAST(count(*) AS DOUBLE) AS n, (SELECT count(*) FROM $geo_edges) AS e FROM $geo_nodes),
    r AS (SELECT least(1.0, ops / greatest(1, ops + apis)) AS cover, least(1.0, (apis + dbs) / n) AS schema, least(1.0, e / greatest(1, ops)) AS link, least(1.0, infra / n) AS rt, least(1.0, docs / n) AS doc FROM c)
    SELECT round(least(1.0, 0.4 * cover + 0.2 * schema + 0.15 * link + 0.1 * rt + 0.05 * doc + 0.05 - 0.01), 3) AS score, round(cover, 3) AS op_coverage, round(schema, 3) AS schema_evidence, round(link, 3) AS link_integrity,
      round(rt, 3) AS runtime_alignment, round(doc, 3) AS doc_alignment FROM r""")
def alternate_facet_score(t):
    return marts.alternate_score(*_geo(t))


@query("graph_health", f"WITH {_COMPONENTS} SELECT (SELECT count(*) FROM $geo_nodes) AS nodes, (SELECT count(*) FROM $geo_edges) AS edges, (SELECT count(DISTINCT c) FROM (SELECT id, min(r) AS c FROM cc GROUP BY 1)) AS components")
def graph_health(t):
    nodes, edges = _geo_kept(t)
    return marts.graph_health(nodes, edges, graph.connected_components(nodes, edges))


# ---------------------------------------------------------------- clusters
view("geo_buckets", """
    SELECT *, CASE WHEN file IS NULL THEN NULL ELSE split_part(file, '/', 1) || '/' || split_part(file, '/', 2) END AS bucket FROM $geo_nodes""")

_CLUSTERS = """
    RECURSIVE lk AS (SELECT u, v FROM $geo_pairs UNION SELECT a.id, b.k FROM $geo_nodes a JOIN (SELECT component, min(id) AS k FROM $geo_nodes GROUP BY 1) b ON a.component = b.component
        UNION SELECT a.id, b.k FROM $geo_buckets a JOIN (SELECT bucket, min(id) AS k FROM $geo_buckets GROUP BY 1) b ON a.bucket = b.bucket),
    sy AS (SELECT u, v FROM lk UNION SELECT v, u FROM lk),
    cc(id, r) AS (SELECT id, id FROM $geo_nodes UNION SELECT sy.v, cc.r FROM cc JOIN sy ON sy.u = cc.id),
    mem AS (SELECT n.*, k.cluster FROM $geo_buckets n JOIN (SELECT id, min(r) AS cluster FROM cc GROUP BY 1) k ON k.id = n.id)"""


@query("cluster_summary", f"""
    WITH {_CLUSTERS}, e AS (SELECT a.cluster, count(*) AS edge_count, count(*) FILTER (g.type IN ('calls', 'invokes', 'triggers', 'publishes', 'subscribes', 'depends_on')) AS call_edges
      FROM $geo_edges g JOIN mem a ON a.id = g.src JOIN mem b ON b.id = g.dst AND a.cluster = b.cluster GROUP BY 1),
    s AS (SELECT cluster, count(*) AS node_count, count(*) FILTER (type IN ('API', 'Workflow', 'Operation')) AS entry_points, count(*) FILTER (type = 'Datastore') AS datastores,
      count(DISTINCT component) AS components, count(DISTINCT bucket) AS buckets FROM mem GROUP BY 1)
    SELECT s.*, coalesce(edge_count, 0) AS edge_count, coalesce(call_edges, 0) AS call_edges,
      round(CAST(least(1.0, CASE WHEN entry_points > 0 THEN 0.4 ELSE 0.1 END + CASE WHEN components > 1 THEN 0.3 ELSE 0.15 END + least(0.3, node_count / 20.0)) AS DOUBLE), 3) AS score
    FROM s LEFT JOIN e ON e.cluster = s.cluster""")
def cluster_summary(t):
    nodes, edges = _geo_kept(t)
    return marts.cluster_summary(marts.cluster_members(nodes, edges), edges)


@query("cluster_evidence", f"""
    WITH {_CLUSTERS}, e AS (SELECT src AS id, type || ' ' || dst AS item, dst AS place, row_number() OVER (PARTITION BY src ORDER BY dst, type || ' ' || dst) AS no FROM $geo_edges)
    SELECT cluster, rn, id, item FROM (SELECT cluster, e.id, item, row_number() OVER (PARTITION BY cluster ORDER BY e.id, place, item) AS rn FROM e JOIN mem ON mem.id = e.id WHERE no <= 2) WHERE rn <= 6""")
def cluster_evidence(t):
    nodes, edges = _geo_kept(t)
    evidence = edges.select(F.col("src").alias("id"), F.col("dst").alias("at"), F.concat_ws(" ", "type", "dst").alias("item"))
    return rollups.cluster_evidence(marts.cluster_members(nodes, edges), evidence)


@query("cluster_types", f"WITH {_CLUSTERS} SELECT cluster, type, count(*) AS n, CAST(dense_rank() OVER (ORDER BY cluster) AS BIGINT) AS cluster_no FROM mem GROUP BY 1, 2")
def cluster_types(t):
    from factloom.operators import ordered

    counts = marts.cluster_members(*_geo(t)).groupBy("cluster", "type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(ordered.global_index(counts.select("cluster").distinct(), ["cluster"], "cluster_no"), "cluster")


@query("feature_rollup", f"""
    WITH {_CUT}, {_DIST.replace('RECURSIVE', '')},
    f AS (SELECT n.id, coalesce(n.component, 'ungrouped') AS component, min(b.dist) AS nearest, quantile_cont(b.dist, 0.5) AS p50, quantile_cont(b.dist, 0.9) AS p90, count(b.dist) FILTER (b.dist <= 4) AS near,
      n.id IN (SELECT id FROM cut) AS is_cut FROM $geo_nodes n LEFT JOIN best b ON b.node = n.id GROUP BY n.id, n.component)
    SELECT component, count(*) AS total, count(*) FILTER (near >= 1) AS covered, round(avg(nearest), 3) AS avg_nearest, round(avg(p50), 3) AS p50, round(avg(p90), 3) AS p90, count(*) FILTER (is_cut) AS articulation FROM f GROUP BY 1""")
def feature_rollup(t):
    nodes, _, feats, cut = _scored(t)
    cut = cut.withColumn("is_cut", F.lit(True))
    rows = nodes.select("id", F.coalesce("component", F.lit("ungrouped")).alias("component")).join(feats, "id", "left").join(cut, "id", "left")
    return rows.groupBy("component").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("anchors_within_r") >= 1).alias("covered"), F.round(F.avg("nearest_distance"), 3).alias("avg_nearest"),
        F.round(F.avg("p50"), 3).alias("p50"), F.round(F.avg("p90"), 3).alias("p90"), F.count_if(F.col("is_cut")).alias("articulation"),
    )


# ---------------------------------------------------------------- graph assembly
view("typed_signals", """
    SELECT CASE WHEN kind = 'db' THEN 'doc' ELSE kind END AS kind, name, method, path, CAST(NULL AS STRING) AS api, component,
      CASE WHEN signal_id % 4 = 0 THEN 'https://h/workflows/flow' || CAST(custkey AS STRING) || '/triggers/m/run' END AS calls_url FROM $signals
    UNION ALL SELECT 'api', n_name, NULL, NULL, NULL, n_name, NULL FROM {nation}
    UNION ALL SELECT 'op', 'x', 'GET', '/' || lower(s_name), n_name, n_name, NULL FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""")


@query("graph_assembly", """
    WITH s AS (SELECT *, CASE kind WHEN 'api' THEN 'API' WHEN 'op' THEN 'Operation' WHEN 'workflow' THEN 'Workflow' WHEN 'doc' THEN 'Doc' END AS type FROM $typed_signals WHERE kind IN ('api', 'op', 'workflow', 'doc')),
    n AS (SELECT type || ':' || CASE WHEN kind = 'op' THEN method || ' ' || path ELSE name END AS id, min(type) AS type, min(component) AS component FROM s GROUP BY 1),
    e AS (SELECT DISTINCT 'API:' || api AS src, 'Operation:' || method || ' ' || path AS dst, 'exposes' AS type FROM s WHERE kind = 'op' AND api IS NOT NULL
      UNION ALL SELECT DISTINCT 'Workflow:' || name, 'Workflow:' || regexp_extract(calls_url, '/workflows/([^/]+)/', 1), 'calls' FROM s WHERE kind = 'workflow' AND calls_url IS NOT NULL
      UNION ALL SELECT 'Component:' || component, id, 'owns' FROM n UNION ALL SELECT id, 'Component:' || component, 'member_of' FROM n)
    SELECT 'node' AS part, type, count(*) AS n FROM (SELECT id, type FROM n UNION ALL SELECT DISTINCT 'Component:' || component, 'Component' FROM n) GROUP BY 2
    UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY 2""")
def graph_assembly(t):
    nodes, edges = graph.build_graph(t.view("typed_signals"))
    a = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("part"), "type", "n")
    b = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("part"), "type", "n")
    return a.unionByName(b)


@query("record_features", """
    WITH s AS (SELECT signal_id, kind, component, upper(substr(kind, 1, 1)) || substr(kind, 2) || ':' || name AS node_id FROM $signals),
    e AS (SELECT 'Component:' || min(component) AS src, node_id AS dst FROM s WHERE kind IN ('workflow', 'route') GROUP BY node_id),
    d AS (SELECT id, count(*) AS degree FROM (SELECT src, dst, unnest([src, dst]) AS id FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)) GROUP BY 1)
    SELECT signal_id, node_id, CAST(degree AS INT) AS degree FROM s LEFT JOIN d ON d.id = s.node_id""")
def record_features(t):
    sig = t.view("signals")
    graph_in = sig.select("kind", "name", "method", "path", F.lit(None).cast("string").alias("api"), "component", F.lit(None).cast("string").alias("calls_url"))
    nodes, edges = graph.build_graph(graph_in, core_only=False)
    deg = graph.degrees(nodes, edges).select(F.col("id").alias("node_id"), F.col("degree").cast("int"))
    ids = sig.select("signal_id", graph.node_id(F.col("kind"), F.col("name"), F.col("method"), F.col("path")).alias("node_id"))
    return ids.join(deg, "node_id", "left")
