"""Graph operators over ``nodes(id, type, ...)`` and ``edges(src, dst, type)`` tables."""

from __future__ import annotations

import sys
from collections import deque
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.vocab import DEFAULT_EDGE_WEIGHT, EDGE_WEIGHTS
from factloom.operators.hot import hot_keys, split_join
from factloom.operators.ordered import first_per_key
from factloom.session import Rounds

# executors get the grouped functions with the task, whether or not the package is installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _rows() -> dict[str, Column]:
    return {"n": F.count(F.lit(1))}


# ---------------------------------------------------------------- building blocks
def undirected(edges: DataFrame) -> DataFrame:
    """Distinct ``(u, v)`` pairs in both directions, loops dropped."""
    pairs = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u <> v")
    return pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def edge_weight(label: Column) -> Column:
    """Weight by edge label, 1.0 when the label has none."""
    w = F.lit(None).cast("double")
    for name, value in EDGE_WEIGHTS.items():
        w = F.when(label == name, F.lit(value)).otherwise(w)
    return F.coalesce(w, F.lit(DEFAULT_EDGE_WEIGHT))


def weighted_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges collapse to the smallest weight."""
    return (
        edges.filter("src IS NOT NULL AND dst IS NOT NULL")
        .groupBy("src", "dst")
        .agg(F.min(edge_weight(F.col("type"))).alias("weight"))
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In + out degree over collapsed edges; isolated nodes get 0."""
    simple = edges.select("src", "dst").distinct()
    ends = simple.select(F.col("src").alias("id")).unionAll(simple.select(F.col("dst").alias("id")))
    deg = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(deg, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))


def type_degrees(edges: DataFrame) -> DataFrame:
    """Edge label x direction counts per node in long form, with deg_in / deg_out totals."""
    label = F.coalesce(F.col("type"), F.lit("__any__"))
    out = edges.select(F.col("src").alias("id"), F.concat(label, F.lit("_out")).alias("key"), F.lit("deg_out").alias("total"))
    inn = edges.select(F.col("dst").alias("id"), F.concat(label, F.lit("_in")).alias("key"), F.lit("deg_in").alias("total"))
    both = out.unionByName(inn)
    keyed = both.select("id", F.explode(F.array("key", "total")).alias("key"))
    return keyed.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- connected components
def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)`` where component is the smallest member id.

    Alternating large-star / small-star contraction.  Every step is a map-side combined ``min`` per node,
    met again by the node's pairs; a hub's pairs are dealt over slots for that (``hot.split_join``), so a
    node that holds a large share of all pairs is no single task's work in any round.
    """
    rounds = Rounds(nodes.sparkSession)
    known = nodes.select("id").distinct()
    pairs = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("src <> dst").distinct()
    watch = {"n": F.count(F.lit(1)), "x": F.expr("bit_xor(xxhash64(u, v))")}
    cur = rounds.keep(pairs, watch=watch)
    hubs = _hubs(_both_ways(cur), rounds.seen["n"])
    for end, other in (("u", "v"), ("v", "u")):
        cur = split_join(cur, known.withColumnRenamed("id", end), end, None if hubs is None else hubs.withColumnRenamed("u", end), [other])
    cur = rounds.keep(cur.select("u", "v"), watch=watch)
    mark = None
    while rounds.seen != mark:
        mark, both = rounds.seen, _both_ways(cur)
        hubs = _hubs(both, mark["n"])
        large = _with_least(both, hubs).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        # a node has no more smaller neighbours here than it had neighbours before, so the same hubs are split
        down = large.filter("u <> v").distinct()
        # the larger end meets its least neighbour, the others go on to meet that one
        small = _with_least(down, hubs).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        cur = rounds.keep(small.distinct(), watch=watch)
    label = cur.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return known.join(label, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _hubs(both: DataFrame, pairs: int) -> DataFrame | None:
    return hot_keys(both.groupBy("u").agg(F.count(F.lit(1)).alias("n")), "u", 2 * pairs)


def _with_least(pairs: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``(u, v, m)``: every pair with the least v of its u."""
    return split_join(pairs, pairs.groupBy("u").agg(F.min("v").alias("m")), "u", hubs, ["v"])


# ---------------------------------------------------------------- weighted distances
#: Tables of improved distances that a level holds before they are merged into one table of the next level.
FAN = 16


def marker_distances(edges: DataFrame, markers: DataFrame) -> DataFrame:
    """``(marker, node, dist)`` shortest weighted distance along directed edges.

    Frontier relaxation over a delta store: a round writes only the distances that it improved, and those are
    the next frontier.  ``FAN`` such tables are merged into one of the next level, so a distance is written once
    per level, twice up to 256 rounds.  Earlier distances are looked up for the pairs a round reached and no
    others, by a semi-join whose reached side is small in most rounds.
    """
    spark = edges.sparkSession
    runs = Rounds(spark, depth=FAN + 1)  # what is merged is gone a level's length later
    fixed = Rounds(spark, depth=1)
    hops = fixed.keep(weighted_edges(edges))
    least = lambda df: df.groupBy("marker", "node").agg(F.min("dist").alias("dist"))
    frontier = runs.keep(markers.select(F.col("id").alias("marker"), F.col("id").alias("node"), F.lit(0.0).alias("dist")).distinct(), "level0")
    levels = [[frontier]]
    while True:
        held = reduce(DataFrame.unionByName, [run for level in levels for run in level])
        reached = least(
            frontier.join(hops, frontier["node"] == hops["src"]).select("marker", F.col("dst").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"))
        )
        known = held.join(reached.select("marker", "node"), ["marker", "node"], "left_semi")
        both = reached.withColumn("old", F.lit(None).cast("double")).unionByName(known.select("marker", "node", F.lit(None).cast("double").alias("dist"), F.col("dist").alias("old")))
        best = both.groupBy("marker", "node").agg(F.min("dist").alias("dist"), F.min("old").alias("old"))
        frontier = runs.keep(best.filter("old IS NULL OR dist < old").select("marker", "node", "dist"), "level0", watch=_rows())
        if not runs.seen["n"]:
            return least(held)
        levels[0].append(frontier)
        for at, level in enumerate(levels):
            if len(level) == FAN:
                merged = runs.keep(least(reduce(DataFrame.unionByName, level)), f"level{at + 1}")
                level.clear()
                if at + 1 == len(levels):
                    levels.append([])
                levels[at + 1].append(merged)


def distance_features(nodes: DataFrame, distances: DataFrame, radius: int = 4) -> DataFrame:
    """Nearest marker, averages, percentiles and anchors within ``radius`` per node (NULL = unreachable)."""
    inside = F.when(F.col("dist") <= radius, F.col("dist"))
    feats = distances.groupBy(F.col("node").alias("id")).agg(
        F.min(F.struct("dist", "marker")).alias("near"),
        F.avg("dist").alias("avg_distance"),
        F.expr("percentile(dist, 0.5)").alias("p50"),
        F.expr("percentile(dist, 0.9)").alias("p90"),
        F.count(inside).alias("anchors_within_r"),
        F.avg(inside).alias("avg_anchor_distance"),
    )
    return nodes.select("id").join(feats, "id", "left").select(
        "id",
        F.col("near.marker").alias("nearest_marker"),
        F.col("near.dist").alias("nearest_distance"),
        "avg_distance",
        "p50",
        "p90",
        F.coalesce("anchors_within_r", F.lit(0)).cast("bigint").alias("anchors_within_r"),
        "avg_anchor_distance",
    )


# ---------------------------------------------------------------- centrality
# A cut-node pass is linear in the component; a betweenness pass is nodes x edges.
SMALL_COMPONENT = {"nodes": 5_000, "edges": 200_000}
SMALL_BETWEENNESS = {"nodes": 1_000, "edges": 20_000}


def _without_twins(pairs: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """``(u, v, n, twin)``: the undirected pairs between nodes that are kept, two of each class of twins; and every ``(u, twin)``.

    Twins have the same neighbours, so all of them have the same paths to the rest.  The least of a class stays for
    itself and the greatest for its other ``n`` members; ``twin`` is the least.  Classes are found by digests and
    then counted: members of a class that do not share each neighbour all stay for themselves.
    """
    pairs = rounds.keep(pairs.select("u", "v"), "all")
    words = [F.conv(F.substring(F.sha2(F.col("v").cast("string"), 256), at, 15), 16, 10).cast("bigint") for at in (1, 16, 31, 46)]
    marks = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("d"), *[F.bit_xor(w).alias(f"w{i}") for i, w in enumerate(words)])
    alike = ["d", *[f"w{i}" for i in range(len(words))]]
    classes = marks.groupBy(*alike).agg(F.min("u").alias("twin"), F.max("u").alias("last"), F.count(F.lit(1)).alias("size"))
    member = rounds.keep(marks.join(classes, alike).select("u", "twin", "last", "size"), "twins")
    shared = pairs.join(member.filter("size > 1"), "u").groupBy("twin", "v").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    unlike = shared.filter("n <> size").select("twin").distinct().withColumn("unlike", F.lit(True))
    kept = member.join(unlike, "twin", "left").select(
        "u", F.when(F.col("unlike"), F.col("u")).otherwise(F.col("twin")).alias("twin"),
        F.when(F.col("unlike") | (F.col("u") == F.col("twin")), 1).when(F.col("u") == F.col("last"), F.col("size") - 1).cast("bigint").alias("n"),
    )
    kept = rounds.keep(kept, "kept")
    stay = kept.filter("n IS NOT NULL")
    return rounds.keep(pairs.join(stay, "u").join(stay.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v", "n", "twin"), "fewer"), kept.select("u", "twin")


def _split_by_size(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int):
    """Undirected edges without twins, labelled with their component, small components apart from large ones."""
    rounds = Rounds(nodes.sparkSession, depth=1 << 30)
    pairs = undirected(edges)
    for end in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    fewer, twins = _without_twins(pairs, rounds)
    ends = fewer.select(F.col("u").alias("id")).distinct()
    comp = rounds.keep(connected_components(ends, fewer.select(F.col("u").alias("src"), F.col("v").alias("dst"))), "comp")
    labelled = rounds.keep(fewer.join(comp.withColumnRenamed("id", "u"), "u"), "pairs")
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("nodes")).join(
        labelled.groupBy("component").agg(F.count(F.lit(1)).alias("m")), "component"
    )
    small_ids = sizes.filter((F.col("nodes") <= max_nodes) & (F.col("m") <= 2 * max_edges)).select("component")
    small = labelled.join(small_ids, "component", "left_semi")
    large = labelled.join(small_ids, "component", "left_anti")
    return small, large, twins, rounds


def _adjacency(pdf: pd.DataFrame) -> dict:
    adj: dict = {}
    for u, v in zip(pdf["u"], pdf["v"]):
        adj.setdefault(u, []).append(v)
    return adj


def _pair_dependency(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sum of source dependencies per class of twins of one bounded component."""
    adj = _adjacency(pdf)
    n, twin = dict(zip(pdf["u"], pdf["n"])), dict(zip(pdf["u"], pdf["twin"]))
    size: dict = {}
    for x in adj:
        size[twin[x]] = size.get(twin[x], 0) + n[x]
    score = dict.fromkeys(size, 0.0)
    for s in size:
        dist, paths, order, queue = {s: 0}, {s: 1.0}, [], deque([s])
        while queue:
            x = queue.popleft()
            order.append(x)
            for y in adj[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    paths[y] = 0.0
                    queue.append(y)
                if dist[y] == dist[x] + 1:
                    paths[y] += n[x] * paths[x]
        dep = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in adj[y]:
                if dist[x] == dist[y] - 1:
                    dep[x] += n[y] * paths[x] / paths[y] * (1.0 + dep[y])
            if twin[y] == s != y:  # the other members are sources to each of them but itself
                score[s] += (size[s] - 1) * dep[y]
            elif twin[y] == y != s:
                score[y] += size[s] * dep[y]
    return pd.DataFrame({"id": list(score), "raw": list(score.values())})


def _pair_dependency_frames(pairs: DataFrame, rounds: Rounds) -> DataFrame:
    """The same sums for components of any size: level-synchronous search from a member of every class
    kept as ``(s, node, level, paths)`` rows, then dependencies pushed back level by level."""
    kinds = rounds.keep(pairs.groupBy(F.col("u").alias("node")).agg(F.min("n").alias("n"), F.min("twin").alias("twin")), "kinds")
    sizes = kinds.groupBy(F.col("twin").alias("s")).agg(F.sum("n").alias("size"))
    ids = sizes.select("s")
    levels = [rounds.keep(ids.select("s", F.col("s").alias("node"), F.lit(1.0).alias("paths")), "lv")]
    while True:
        step = (
            levels[-1].join(pairs, F.col("node") == F.col("u"))
            .groupBy("s", F.col("v").alias("node"))
            .agg(F.sum(F.col("n") * F.col("paths")).alias("paths"))
        )
        for old in levels[-2:]:
            step = step.join(old.select("s", "node"), ["s", "node"], "left_anti")
        nxt = rounds.keep(step, "lv", watch=_rows())
        if not rounds.seen["n"]:
            break
        levels.append(nxt)
    dep = None
    total = None
    for here, above in zip(reversed(levels[1:]), reversed(levels[:-1])):
        cur = here.withColumn("dep", F.lit(0.0)) if dep is None else here.join(dep, ["s", "node"], "left").fillna(0.0, ["dep"])
        # the other members of a class are sources to each of them but itself
        times = F.when(F.col("twin") == F.col("s"), F.col("size") - 1).when(F.col("twin") == F.col("node"), F.col("size"))
        part = cur.join(kinds.select("node", "twin"), "node").join(sizes, "s").groupBy(F.col("twin").alias("id")).agg(F.sum(times * F.col("dep")).alias("raw"))
        total = part if total is None else total.unionByName(part)
        share = (
            cur.join(pairs, F.col("node") == F.col("u"))
            .select("s", F.col("v").alias("node"), (F.col("n") * (1.0 + F.col("dep")) / F.col("paths")).alias("share"))
        )
        dep = rounds.keep(
            above.join(share, ["s", "node"])
            .groupBy("s", "node")
            .agg((F.max("paths") * F.sum("share")).alias("dep")),
            "dep",
        )
    if total is None:
        return ids.select(F.col("s").alias("id"), F.lit(0.0).alias("raw"))
    return total.groupBy("id").agg(F.sum("raw").alias("raw"))


def betweenness(
    nodes: DataFrame, edges: DataFrame, max_nodes: int = SMALL_BETWEENNESS["nodes"], max_edges: int = SMALL_BETWEENNESS["edges"]
) -> DataFrame:
    """Exact normalised betweenness on the undirected graph: ``(id, betweenness)``.

    Paths are counted between classes of twins (nodes with the same neighbours), each weighted by its members.
    Components up to the size bound run as one bounded pandas group each; larger ones run as
    joins, so no component size is dropped or sampled.
    """
    small, large, twins, rounds = _split_by_size(nodes, edges, max_nodes, max_edges)
    id_type = nodes.schema["id"].dataType.simpleString()
    raw = small.groupBy("component").applyInPandas(_pair_dependency, f"id {id_type}, raw double")
    if not large.isEmpty():
        raw = raw.unionByName(_pair_dependency_frames(large.select("u", "v", "n", "twin"), rounds))
    raw = twins.join(raw.withColumnRenamed("id", "twin"), "twin").select(F.col("u").alias("id"), "raw")
    n = nodes.select("id").distinct().count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.select("id").distinct().join(raw, "id", "left").select(
        "id", (F.coalesce("raw", F.lit(0.0)) * scale).alias("betweenness")
    )


# ---------------------------------------------------------------- articulation points
def _cut_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Articulation points of one bounded component (iterative depth-first low-points)."""
    adj = _adjacency(pdf)
    found, seen, low = set(), {}, {}
    for root in adj:
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        kids = 0
        stack = [(root, None, iter(adj[root]))]
        while stack:
            x, up, rest = stack[-1]
            nxt = next(rest, None)
            if nxt is None:
                stack.pop()
                if up is not None:
                    low[up] = min(low[up], low[x])
                    if up != root and low[x] >= seen[up]:
                        found.add(up)
                    kids += up == root
            elif nxt not in seen:
                seen[nxt] = low[nxt] = len(seen)
                stack.append((nxt, x, iter(adj[nxt])))
            elif nxt != up:
                low[x] = min(low[x], seen[nxt])
        if kids > 1:
            found.add(root)
    ids = pdf["u"].drop_duplicates()
    return ids[ids.isin(found)].to_frame("id")


def _cut_nodes_frames(pairs: DataFrame, rounds: Rounds) -> DataFrame:
    """Articulation points for components of any size, as joins.

    A hop tree is grown from each component's smallest id.  Every non-tree edge closes a
    cycle: its two ends climb the tree together, tying the tree edges they pass into one
    block.  Blocks are the connected components of those ties; a node is a cut node when
    the tree edges at it fall into more than one block.
    """
    roots = pairs.select(F.col("component").alias("id")).distinct()
    lv = rounds.keep(roots.select("id", F.lit(None).cast(pairs.schema["u"].dataType).alias("up"), F.lit(0).alias("level")), "tree")
    tree = [lv]
    while True:
        nxt = lv.join(pairs, lv["id"] == pairs["u"]).groupBy(F.col("v").alias("id")).agg(F.min("u").alias("up"))
        for old in tree[-2:]:
            nxt = nxt.join(old.select("id"), "id", "left_anti")
        lv = rounds.keep(nxt.withColumn("level", F.lit(len(tree))), "tree", watch=_rows())
        if not rounds.seen["n"]:
            break
        tree.append(lv)
    whole = tree[0]
    for t in tree[1:]:
        whole = whole.unionByName(t)
    whole = rounds.keep(whole, "whole")
    look = lambda side: whole.select(
        F.col("id").alias(side), F.col("up").alias("up_" + side), F.col("level").alias("lv_" + side)
    )
    climb = pairs.filter("u < v").select(F.col("u").alias("a"), F.col("v").alias("b"))
    climb = climb.join(look("a"), "a").join(look("b"), "b").filter(
        "NOT (up_a <=> b) AND NOT (up_b <=> a)"
    )
    ties = None
    while True:
        # the deeper end moves alone; level ends move together until they meet
        deeper_a, deeper_b = F.col("lv_a") > F.col("lv_b"), F.col("lv_b") > F.col("lv_a")
        climb = rounds.keep(
            climb.select(
                "a", "b", "up_a", "up_b", deeper_a.alias("only_a"), deeper_b.alias("only_b")
            ).withColumn("meet", ~F.col("only_a") & ~F.col("only_b") & F.col("up_a").eqNullSafe(F.col("up_b"))),
            "climb",
            watch=_rows(),
        )
        if not rounds.seen["n"]:
            break
        go = climb.filter("NOT meet")
        tie = (
            climb.filter("NOT only_a AND NOT only_b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
            .unionByName(go.filter("NOT only_b").select(F.col("a").alias("src"), F.col("up_a").alias("dst")))
            .unionByName(go.filter("NOT only_a").select(F.col("b").alias("src"), F.col("up_b").alias("dst")))
        )
        tie = rounds.keep(tie.distinct(), "ties")
        ties = tie if ties is None else ties.unionByName(tie)
        moved = go.select(
            F.when(F.col("only_b"), F.col("a")).otherwise(F.col("up_a")).alias("a"),
            F.when(F.col("only_a"), F.col("b")).otherwise(F.col("up_b")).alias("b"),
        )
        moved = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
        climb = moved.join(look("a"), "a").join(look("b"), "b")
    tree_edges = whole.filter("up IS NOT NULL").select("id", "up")
    if ties is None:
        blocks = tree_edges.select("id", F.col("id").alias("block"))
    else:
        blocks = connected_components(tree_edges.select("id"), ties).withColumnRenamed("component", "block")
    touch = tree_edges.join(blocks, "id")
    ends = touch.select("id", "block").unionByName(touch.select(F.col("up").alias("id"), "block"))
    return ends.groupBy("id").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).filter("lo <> hi").select("id")


def articulation_points(
    nodes: DataFrame, edges: DataFrame, max_nodes: int = SMALL_COMPONENT["nodes"], max_edges: int = SMALL_COMPONENT["edges"]
) -> DataFrame:
    """``(id)`` of every node whose removal splits its component.

    Of nodes with the same neighbours two are looked at: none of them is a cut node, and two hold together or
    apart what all of them do.
    """
    small, large, _, rounds = _split_by_size(nodes, edges, max_nodes, max_edges)
    id_type = nodes.schema["id"].dataType.simpleString()
    cut = small.groupBy("component").applyInPandas(_cut_nodes, f"id {id_type}")
    if not large.isEmpty():
        cut = cut.unionByName(_cut_nodes_frames(large, rounds))
    return cut


# ---------------------------------------------------------------- markers and assembly
def select_markers(
    nodes: DataFrame,
    edges: DataFrame,
    central: DataFrame | None,
    k: int = 3,
    include: tuple[str, ...] = (),
    exclude: tuple[str, ...] = (),
    candidate_types: tuple[str, ...] = ("Workflow", "API", "Operation"),
) -> DataFrame:
    """Marker ids in order: included ids, top-k structural, top-k by degree among candidates.

    Falls back to the top-degree nodes of any type when nothing else qualifies.
    """
    bad = F.col("id").isin(*exclude) if exclude else F.lit(False)
    parts = []
    if include:
        parts.append(nodes.filter(F.col("id").isin(*include)).filter(~bad).select("id", F.lit(0).alias("stage"), F.lit(0.0).alias("score")))
    if central is not None:
        top = central.filter(~bad).orderBy(F.desc("betweenness"), "id").limit(k)
        parts.append(top.select("id", F.lit(1).alias("stage"), F.col("betweenness").alias("score")))
    deg = degrees(nodes, edges).filter(~bad)
    business = deg.filter(F.col("type").isin(*candidate_types)).orderBy(F.desc("degree"), "id").limit(k)
    parts.append(business.select("id", F.lit(2).alias("stage"), F.col("degree").cast("double").alias("score")))
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.unionByName(p)
    picked = Rounds(nodes.sparkSession).keep(picked)  # a few rows, so that centrality runs once
    none = picked.agg((F.count(F.lit(1)) == 0).alias("__none"))
    rest = deg.orderBy(F.desc("degree"), "id").limit(max(1, k)).select("id", F.lit(3).alias("stage"), F.col("degree").cast("double").alias("score"))
    picked = picked.unionByName(rest.join(F.broadcast(none), F.col("__none")).drop("__none"))
    return first_per_key(picked, ["id"], ["stage"])


def build_graph(signals: DataFrame, core_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from ``signals(kind, name, method, path, api, component, calls_url)``.

    Kinds api / op / workflow / doc become nodes; ``core_only=False`` adds db, infra, event
    and route nodes.  Components become hubs owning their members.
    """
    kinds = {"api": "API", "op": "Operation", "workflow": "Workflow", "doc": "Doc"}
    if not core_only:
        kinds |= {"db": "Datastore", "infra": "InfraResource", "event": "MessageTopic", "route": "Route"}
    typ = F.lit(None).cast("string")
    for kind, label in kinds.items():
        typ = F.when(F.col("kind") == kind, F.lit(label)).otherwise(typ)
    name = F.when(
        F.col("kind") == "op",
        F.concat_ws(" ", F.coalesce("method", F.lit("OP")), F.coalesce("path", F.lit(""))),
    ).otherwise(F.coalesce("name", "kind"))
    base = signals.withColumn("type", typ).filter("type IS NOT NULL").withColumn("name", name)
    base = base.withColumn("id", F.concat_ws(":", "type", "name"))
    nodes = base.groupBy("id").agg(
        F.min("type").alias("type"), F.min("name").alias("name"), F.min("component").alias("component")
    )
    exposes = base.filter("kind = 'op' AND api IS NOT NULL").select(
        F.concat(F.lit("API:"), "api").alias("src"), F.col("id").alias("dst"), F.lit("exposes").alias("type")
    )
    callee = F.regexp_extract("calls_url", "/workflows/([^/]+)/triggers/([^/]+)/run", 1)
    calls = base.filter("kind = 'workflow'").withColumn("callee", callee).filter("callee <> ''").select(
        F.col("id").alias("src"), F.concat(F.lit("Workflow:"), "callee").alias("dst"), F.lit("calls").alias("type")
    )
    member = nodes.filter("component IS NOT NULL")
    hub = F.concat(F.lit("Component:"), "component")
    hubs = member.select(hub.alias("id"), F.lit("Component").alias("type"), F.col("component").alias("name"), "component").distinct()
    owns = member.select(hub.alias("src"), F.col("id").alias("dst"), F.lit("owns").alias("type"))
    owned = member.select(F.col("id").alias("src"), hub.alias("dst"), F.lit("member_of").alias("type"))
    edges = exposes.unionByName(calls).unionByName(owns).unionByName(owned).distinct()
    return nodes.unionByName(hubs), edges


def node_id(kind: Column, name: Column, method: Column, path: Column) -> Column:
    """Graph node id a signal maps to, used to attach features to records."""
    lowered = F.lower(kind)
    return (
        F.when(lowered == "api", F.concat(F.lit("API:"), F.coalesce(name, F.lit("api"))))
        .when(lowered == "op", F.concat(F.lit("Operation:"), F.coalesce(method, F.lit("OP")), F.lit(" "), F.coalesce(path, F.lit(""))))
        .when(lowered == "workflow", F.concat(F.lit("Workflow:"), F.coalesce(name, F.lit("workflow"))))
        .when(lowered == "doc", F.concat(F.lit("Doc:"), F.coalesce(name, F.lit("doc"))))
        .otherwise(F.concat(F.initcap(lowered), F.lit(":"), F.coalesce(name, lowered)))
    )


def bucket_chain(members: DataFrame, bucket: str, member: str) -> DataFrame:
    """n-1 edges per bucket: every member ties to its smallest member, which connects it like a
    chain but needs only a map-side combined ``min`` instead of an ordered pass over the bucket."""
    m = members.select(bucket, member).distinct()
    anchor = m.groupBy(bucket).agg(F.min(member).alias("src"))
    return m.join(anchor, bucket).filter(F.col("src") != F.col(member)).select("src", F.col(member).alias("dst"))
