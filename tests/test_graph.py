"""Graph operators against brute force on small random graphs."""

import heapq
import itertools
import random

import pytest

from pyspark.sql import functions as F

from factloom.operators import graph, hot

SEEDS = [1, 2, 3]


def random_graph(seed, n=18, m=20):
    rnd = random.Random(seed)
    names = [f"n{i:02d}" for i in range(n)]
    edges = {tuple(rnd.sample(names, 2)) for _ in range(m)}
    return names, [(a, b, rnd.choice(["calls", "depends_on", "publishes_to"])) for a, b in sorted(edges)]


def frames(spark, names, edges):
    return spark.createDataFrame([(x, "API") for x in names], "id string, type string"), spark.createDataFrame(edges, "src string, dst string, type string")


def neighbours(names, edges):
    adj = {x: set() for x in names}
    for a, b, _ in edges:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    return adj


def parts(adj, without=None):
    left, out = set(adj) - {without}, []
    while left:
        todo, seen = [min(left)], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo.extend(adj[x] - {without} - seen)
        out.append(seen)
        left -= seen
    return out


@pytest.mark.parametrize("seed", SEEDS)
def test_components_are_labelled_by_smallest_member(spark, seed):
    names, edges = random_graph(seed)
    got = {r.id: r.component for r in graph.connected_components(*frames(spark, names, edges)).collect()}
    want = {x: min(p) for p in parts(neighbours(names, edges)) for x in p}
    assert got == want


def test_components_of_a_long_path_and_a_star(spark):
    names = [f"p{i:03d}" for i in range(60)] + [f"s{i:03d}" for i in range(60)]
    edges = [(f"p{i:03d}", f"p{i + 1:03d}", "calls") for i in range(59)] + [("s030", f"s{i:03d}", "calls") for i in range(60) if i != 30]
    got = {r.id: r.component for r in graph.connected_components(*frames(spark, names, edges)).collect()}
    assert set(got.values()) == {"p000", "s000"}


@pytest.mark.parametrize("seed", SEEDS[:2])
def test_cut_nodes_both_ways(spark, seed):
    names, edges = random_graph(seed)
    adj = neighbours(names, edges)
    base = len(parts(adj))
    want = sorted(x for x in names if adj[x] and len(parts(adj, x)) > base)
    f = frames(spark, names, edges)
    assert sorted(r.id for r in graph.articulation_points(*f).collect()) == want
    assert sorted(r.id for r in graph.articulation_points(*f, max_nodes=0).collect()) == want


def paths_from(adj, s):
    dist, count, queue = {s: 0}, {s: 1}, [s]
    for x in queue:
        for y in adj[x]:
            if y not in dist:
                dist[y], count[y] = dist[x] + 1, 0
                queue.append(y)
            if dist[y] == dist[x] + 1:
                count[y] += count[x]
    return dist, count


@pytest.mark.parametrize("seed", SEEDS[:1])
def test_betweenness_both_ways(spark, seed):
    names, edges = random_graph(seed)
    adj = neighbours(names, edges)
    found = {x: paths_from(adj, x) for x in names}
    want = dict.fromkeys(names, 0.0)
    for s, t in itertools.permutations(names, 2):
        if t not in found[s][0]:
            continue
        for v in names:
            if v not in (s, t) and v in found[s][0] and t in found[v][0] and found[s][0][v] + found[v][0][t] == found[s][0][t]:
                want[v] += found[s][1][v] * found[v][1][t] / found[s][1][t]
    scale = (len(names) - 1) * (len(names) - 2)
    f = frames(spark, names, edges)
    for limit in (5000, 0):
        got = {r.id: r.betweenness for r in graph.betweenness(*f, max_nodes=limit).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[x] - want[x] / scale) < 1e-9 for x in names)


@pytest.mark.parametrize("seed", SEEDS)
def test_distances_are_shortest(spark, seed):
    names, edges = random_graph(seed)
    weight = {"calls": 1.0, "depends_on": 0.5, "publishes_to": 1.5}
    nodes, es = frames(spark, names, edges)
    markers = ["n00", "n05"]
    got = {(r.marker, r.node): r.dist for r in graph.marker_distances(es, nodes.filter(nodes.id.isin(markers))).collect()}
    want = {}
    for m in markers:
        heap, best = [(0.0, m)], {}
        while heap:
            d, x = heapq.heappop(heap)
            if x in best:
                continue
            best[x] = d
            for a, b, t in edges:
                if a == x and b not in best:
                    heapq.heappush(heap, (d + weight[t], b))
        want |= {(m, x): d for x, d in best.items()}
    assert got == want


def test_distances_are_written_a_few_times_at_most(spark, monkeypatch):
    n = 30  # a path with a mesh beside it: more rounds than a level holds, and distances that are improved later
    names = [f"p{i:03}" for i in range(n)]
    pairs = [(names[i], names[i + 1], "calls") for i in range(n - 1)] + [(names[i], names[min(i + 2, n - 1)], "publishes_to") for i in range(0, n - 1, 3)]
    nodes = spark.createDataFrame([(x,) for x in names], "id string")
    es = spark.createDataFrame(pairs, "src string, dst string, type string")
    written = []
    keep = graph.Rounds.keep

    def counted(self, df, *args, **kw):
        out = keep(self, df, *args, **kw)
        if "dist" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(graph.Rounds, "keep", counted)
    got = {r.node: r.dist for r in graph.marker_distances(es, nodes.filter("id = 'p000'")).collect()}
    want = {names[0]: 0.0}
    for i, x in enumerate(names):  # edges lead to later nodes only
        for a, b, t in pairs:
            if a == x:
                want[b] = min(want.get(b, 1e9), want[x] + {"calls": 1.0, "publishes_to": 1.5}[t])
    assert got == want
    assert len(written) > graph.FAN + 1
    assert sum(written) <= 3 * len(got)


def test_one_hub_is_one_cluster(spark):
    nodes = spark.createDataFrame(
        [("Component:orders", "Component", "orders", "orders", None), ("API:getOrders", "API", "getOrders", "orders", "svc/orders.py")],
        "id string, type string, name string, component string, file string",
    )
    edges = spark.createDataFrame([("Component:orders", "API:getOrders", "owns")], "src string, dst string, type string")
    from factloom.operators import marts

    row = marts.cluster_summary(marts.cluster_members(nodes, edges), edges).collect()
    assert len(row) == 1 and row[0].node_count == 2 and row[0].components == 1 and row[0].entry_points == 1
    assert row[0].score == 0.65


def test_marker_fallback_and_excludes(spark):
    names, edges = random_graph(4)
    nodes, es = frames(spark, names, edges)
    plain = nodes.withColumn("type", nodes.id)
    got = graph.select_markers(plain, es, None, k=2)
    assert got.count() == 2 and {r.stage for r in got.collect()} == {3}
    kept = graph.select_markers(nodes, es, None, k=2, include=("n01",), exclude=("n01",))
    assert "n01" not in {r.id for r in kept.collect()}


@pytest.mark.parametrize("hub", [0, 20_000])
def test_a_hub_of_most_pairs_is_dealt_over_slots(spark, hub):
    """A star with the least or the largest id at its centre, beside short paths."""
    nodes = spark.range(60_000)
    star = nodes.filter(f"id <= 20000 AND id <> {hub}").select(F.lit(hub).cast("long").alias("src"), F.col("id").alias("dst"))
    paths = nodes.filter("id > 20000 AND id % 4 <> 0 AND id < 59999").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.connected_components(nodes, star.unionByName(paths))
    want = F.when(F.col("id") <= 20_000, 0).when(F.col("id") == 59_999, 59_997).otherwise(F.greatest(F.lit(20_001), F.floor((F.col("id") - 1) / 4) * 4 + 1))
    assert got.count() == 60_000 and got.filter(F.col("component") != want).count() == 0


def test_split_join_deals_a_hot_key_evenly_and_keeps_rows(spark):
    rows = spark.range(50_000).select(F.when(F.col("id") % 10 > 0, F.lit("hot")).when(F.col("id") > 40, F.col("id").cast("string")).alias("k"), "id")
    table = rows.select("k").distinct().withColumn("value", F.length("k"))
    marks = hot.hot_keys(rows.groupBy("k").count().withColumnRenamed("count", "n"), "k", 50_000)
    assert [r.k for r in marks.collect()] == ["hot"]
    got = hot.split_join(rows, table, "k", marks, ["id"])
    assert got.count() == rows.filter("k IS NOT NULL").count() == got.select("id").distinct().count()
    assert got.filter("value <> length(k)").count() == 0
    whole = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = hot.split_join(rows, table, "k", marks, ["id"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", whole)
    sizes = sorted(r["count"] for r in parts)
    assert len(sizes) > 3 and sizes[-1] <= 1.5 * sizes[len(sizes) // 2]
