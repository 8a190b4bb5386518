"""Rollups: facets, coverage, quality, families, worklists and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions import vocab
from factloom.operators import graph, ordered
from factloom.operators.hot import TASK_ROWS


# ---------------------------------------------------------------- graph facets
# Node type -> facet, and the weight of its presence.
FACETS = {"Operation": "ops", "API": "apis", "MessageTopic": "events", "Datastore": "dbs", "InfraResource": "infra", "Doc": "docs"}
FACET_WEIGHTS = {"ops": 0.30, "apis": 0.20, "events": 0.20, "dbs": 0.15, "infra": 0.10, "docs": 0.05}


def facet_counts(nodes: DataFrame) -> DataFrame:
    """One row of node counts by facet, with the presence-weighted base score."""
    counts = nodes.agg(*[F.count_if(F.col("type") == typ).alias(name) for typ, name in FACETS.items()], F.count(F.lit(1)).alias("n"))
    base = sum((F.when(F.col(f) > 0, F.lit(w)).otherwise(0.0) for f, w in FACET_WEIGHTS.items()), F.lit(0.0))
    return counts.withColumn("base_score", F.least(F.lit(1.0), base))


def blended_score(nodes: DataFrame, edges: DataFrame, features: DataFrame, cut_nodes: DataFrame, radius: int = 4) -> DataFrame:
    """Base score blended with distance, coverage and reachability, minus a structure penalty.

    Every input is reduced to one row before the rows meet.
    """
    one = lambda df: df.withColumn("one", F.lit(1))
    f = one(facet_counts(nodes))
    e = one(edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("e")))
    d = one(features.agg(F.avg("nearest_distance").alias("avg_nearest"), F.count("nearest_distance").alias("reachable"), F.count_if(F.col("nearest_distance") <= radius).alias("near")))
    a = one(cut_nodes.agg(F.count(F.lit(1)).alias("articulation")))
    r = f.join(e, "one").join(d, "one").join(a, "one").drop("one")
    n = F.greatest(F.col("n"), F.lit(1))
    quality = F.when(F.col("reachable") > 0, 1.0 / (1.0 + F.col("avg_nearest"))).otherwise(0.0)
    penalty = F.when(F.col("n") >= 20, F.least(F.lit(0.15), F.col("articulation") / n * 0.5)).otherwise(0.0)
    score = 0.70 * F.col("base_score") + 0.10 * quality + 0.10 * F.col("near") / n + 0.10 * F.col("reachable") / n - penalty
    density = F.when(F.col("n") > 1, F.col("e") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return r.select(
        *FACET_WEIGHTS, "n", "e", F.round("base_score", 3).alias("base_score"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3).alias("score"), F.round("avg_nearest", 3).alias("avg_nearest"),
        F.round(F.col("reachable") / n, 3).alias("reachable_ratio"), F.col("near").alias("anchors_within_r"), "articulation", F.round(density, 6).alias("density"),
    )


def alternate_score(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ratio-based facet score."""
    r = facet_counts(nodes).withColumn("one", F.lit(1)).join(edges.agg(F.count(F.lit(1)).alias("e")).withColumn("one", F.lit(1)), "one")
    n = F.greatest(F.col("n"), F.lit(1))
    cap = lambda c: F.least(F.lit(1.0), c)
    cover = cap(F.col("ops") / F.greatest(F.lit(1), F.col("ops") + F.col("apis")))
    schema = cap((F.col("apis") + F.col("dbs")) / n)
    link = cap(F.col("e") / F.greatest(F.lit(1), F.col("ops")))
    runtime, doc = cap(F.col("infra") / n), cap(F.col("docs") / n)
    parsed = F.when(F.col("n") > 0, 1.0).otherwise(0.0)
    score = cap(0.40 * cover + 0.20 * schema + 0.15 * link + 0.10 * runtime + 0.05 * doc + 0.05 * parsed - 0.10 * 0.1)
    return r.select(
        F.round(score, 3).alias("score"), F.round(cover, 3).alias("op_coverage"), F.round(schema, 3).alias("schema_evidence"),
        F.round(link, 3).alias("link_integrity"), F.round(runtime, 3).alias("runtime_alignment"), F.round(doc, 3).alias("doc_alignment"),
    )


def graph_health(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """Nodes, edges and weakly connected components."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes")).withColumn("one", F.lit(1))
    e = edges.agg(F.count(F.lit(1)).alias("edges")).withColumn("one", F.lit(1))
    c = components.agg(F.countDistinct("component").alias("components")).withColumn("one", F.lit(1))
    return n.join(e, "one").join(c, "one").drop("one")


# ---------------------------------------------------------------- clusters of connected nodes
def cluster_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their cluster: connected through edges, a shared component or a shared repository bucket."""
    by_comp = graph.bucket_chain(nodes.filter("component IS NOT NULL"), "component", "id")
    bucketed = nodes.withColumn("bucket", tx.repo_bucket(F.col("file"))).filter("bucket IS NOT NULL")
    by_repo = graph.bucket_chain(bucketed, "bucket", "id")
    links = edges.select("src", "dst").unionByName(by_comp).unionByName(by_repo)
    comp = graph.connected_components(nodes, links).withColumnRenamed("component", "cluster")
    return nodes.withColumn("bucket", tx.repo_bucket(F.col("file"))).join(comp, "id")


def cluster_summary(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Size, edges, entry points, stores, diversity and score per cluster.

    Distinct counts come from small pre-aggregated pairs, so a cluster holding most nodes is
    still summed by many tasks.
    """
    base = members.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("node_count"), F.count_if(F.col("type").isin("API", "Workflow", "Operation")).alias("entry_points"),
        F.count_if(F.lower("type").isin("datastore", "database")).alias("datastores"),
    )
    distinct = lambda col, out: members.filter(F.col(col).isNotNull()).select("cluster", col).distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias(out))
    home = members.select(F.col("id").alias("src"), "cluster")
    inner = edges.join(home, "src").join(members.select(F.col("id").alias("dst"), F.col("cluster").alias("c2")), "dst").filter("cluster = c2")
    ec = inner.groupBy("cluster").agg(F.count(F.lit(1)).alias("edge_count"), F.count_if(F.lower("type").isin(*vocab.CALL_EDGE_TYPES)).alias("call_edges"))
    out = base.join(ec, "cluster", "left").join(distinct("component", "components"), "cluster", "left").join(distinct("bucket", "buckets"), "cluster", "left")
    out = out.fillna(0, ["edge_count", "call_edges", "components", "buckets"])
    score = F.when(F.col("entry_points") > 0, 0.4).otherwise(0.1) + F.when(F.col("components") > 1, 0.3).otherwise(0.15) + F.least(F.lit(0.3), F.col("node_count") / 20.0)
    return out.withColumn("score", F.round(F.least(F.lit(1.0), score), 3))


# ---------------------------------------------------------------- shared values and families
def value_hubs(members: DataFrame) -> DataFrame:
    """Values used by more than one process: ``(kind, value, members)`` from ``members(process, kind, value)``."""
    return members.distinct().groupBy("kind", "value").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")


def hub_edges(members: DataFrame) -> DataFrame:
    """Sharing as process -> value edges.

    The pairs of a value's n users are all implied by n hub edges; storing the hubs keeps the
    result whole and linear where a hot value would give n * n pairs.
    """
    m = members.distinct()
    return m.join(value_hubs(m), ["kind", "value"])


def shared_with(members: DataFrame, asked: DataFrame) -> DataFrame:
    """The sharing pairs of the processes asked for: ``(process, peer, kind, value)``."""
    return _sharing(members.distinct(), asked.select("process").distinct())


def _sharing(members: DataFrame, asked: DataFrame) -> DataFrame:
    mine = members.join(asked, "process", "left_semi").withColumnRenamed("process", "me")
    return mine.join(members, ["kind", "value"]).filter("me <> process").select(F.col("me").alias("process"), F.col("process").alias("peer"), "kind", "value")


def _sharers(members: DataFrame, asked: DataFrame) -> DataFrame:
    """The others that share a value of a kind with each asked process, once each: ``(process, relation, peer)``.

    Repeated ``members`` do no harm, as pairs are made distinct anyway.  A pair seldom meets again in its task, so pairs are
    dealt first and made distinct there, in tasks whose number grows with ``members``; they neither fill memory before the
    exchange nor spill after it.
    """
    tasks = max(members.sparkSession.sparkContext.defaultParallelism, members.count() // TASK_ROWS + 1)
    pairs = _sharing(members, asked).select("process", "kind", "peer").repartition(tasks, "process", "peer").distinct()
    return pairs.select("process", F.concat(F.lit("shared_"), "kind", F.lit("_with")).alias("relation"), "peer")


def dependency_slice(processes: DataFrame, calls: DataFrame, members: DataFrame, asked: DataFrame, include_self: bool = False) -> DataFrame:
    """Related processes of those asked for, in long form ``(process, relation, peer)``.

    ``processes(process, component, family, module)``, ``calls(src, dst)``.
    """
    a = asked.select("process").distinct()
    calls = calls.distinct()
    parts = [
        calls.join(a.withColumnRenamed("process", "src"), "src", "left_semi").select(F.col("src").alias("process"), F.lit("calls").alias("relation"), F.col("dst").alias("peer")),
        calls.filter("src <> dst").join(a.withColumnRenamed("process", "dst"), "dst", "left_semi").select(F.col("dst").alias("process"), F.lit("called_by").alias("relation"), F.col("src").alias("peer")),
        _sharers(members, a),
        _peers(processes, a),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("peer IS NOT NULL AND peer <> ''")  # each part is distinct and has relations of its own


def _peers(processes: DataFrame, asked: DataFrame) -> DataFrame:
    """The others of each asked process's component, family and module.

    A few groups hold everything, so members are dealt over slots, those asked repeated per slot; a number of
    partitions keeps Spark from merging tasks whose input is small but whose pairs are many.
    """
    slots = 4 * processes.sparkSession.sparkContext.defaultParallelism
    levels = [F.struct(F.lit(c + "_peers").alias("relation"), F.col(c).alias("group")) for c in ("component", "family", "module")]
    rows = processes.select("process", F.explode(F.array(*levels)).alias("l")).select("process", "l.*").filter("group IS NOT NULL").distinct()
    slot = F.pmod(F.xxhash64("process"), F.lit(slots))
    mine = rows.join(asked, "process", "left_semi").select(F.col("process").alias("me"), "relation", "group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint"))).alias("slot"))
    keys = ["relation", "group", "slot"]
    dealt = rows.withColumn("slot", slot).repartition(slots, *keys)
    return dealt.join(mine.repartition(slots, *keys), keys).filter("me <> process").select(F.col("me").alias("process"), "relation", F.col("process").alias("peer"))


def memberships(processes: DataFrame) -> DataFrame:
    """``(process, level, group)`` for groups of more than one process."""
    rows = processes.select("process", F.explode(F.create_map(*[x for c in ("component", "family", "module") for x in (F.lit(c), F.col(c))])).alias("level", "group"))
    rows = rows.filter("group IS NOT NULL").distinct()
    sizes = rows.groupBy("level", "group").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return rows.join(sizes, ["level", "group"])


def family_insights(processes: DataFrame, calls: DataFrame, members: DataFrame) -> DataFrame:
    """Members, shared values and calls inside and out per family."""
    fam = processes.select("process", "family")
    n = fam.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    shared = members.distinct().join(fam, "process").groupBy("family", "kind", "value").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    sh = shared.groupBy("family").agg(F.count_if(F.col("kind") == "datastore").alias("shared_datastores"), F.count_if(F.col("kind") == "identifier").alias("shared_identifiers"))
    c = calls.join(fam.select(F.col("process").alias("src"), F.col("family")), "src").join(fam.select(F.col("process").alias("dst"), F.col("family").alias("to_family")), "dst", "left")
    cc = c.groupBy("family").agg(F.count_if(F.col("family") == F.col("to_family")).alias("intra_calls"), F.count_if(~F.col("family").eqNullSafe(F.col("to_family"))).alias("cross_calls"))
    return n.join(sh, "family", "left").join(cc, "family", "left").fillna(0)


def cross_family_calls(processes: DataFrame, calls: DataFrame, samples: int = 3) -> DataFrame:
    """Calls between families: count and the first few samples in name order."""
    fam = processes.select("process", "family")
    c = calls.join(fam.select(F.col("process").alias("src"), "family"), "src").join(fam.select(F.col("process").alias("dst"), F.col("family").alias("to_family")), "dst", "left")
    c = c.withColumn("to_family", F.coalesce("to_family", F.lit("unknown"))).filter("family <> to_family")
    c = c.withColumn("sample", F.concat_ws(" -> ", "src", "dst"))
    counts = c.groupBy("family", "to_family").agg(F.count(F.lit(1)).alias("calls"))
    top = ordered.top_per_key(c.select("family", "to_family", "sample").distinct(), ["family", "to_family"], [F.col("sample")], samples)
    text = top.groupBy("family", "to_family").agg(F.array_join(F.array_sort(F.collect_list("sample")), "; ").alias("samples"))
    return counts.join(text, ["family", "to_family"])


def cross_family_values(processes: DataFrame, members: DataFrame, asked: DataFrame, same_family: bool = False) -> DataFrame:
    """Values the asked families share with others, per unordered family pair: ``(fam_a, fam_b, kind, value)``.

    Values are first reduced to distinct (family, kind, value), so process pairs never appear.
    With ``same_family`` values shared inside one family count as that family's pair with itself.
    """
    held = members.distinct().join(processes.select("process", "family"), "process").groupBy("family", "kind", "value").agg(F.count(F.lit(1)).alias("users"))
    mine = held.join(asked.select("family").distinct(), "family", "left_semi").select(F.col("family").alias("me"), "kind", "value")
    pairs = held.join(mine, ["kind", "value"])
    pairs = pairs.filter((F.col("me") != F.col("family")) | ((F.col("users") > 1) if same_family else F.lit(False)))
    return pairs.select(F.least("me", "family").alias("fam_a"), F.greatest("me", "family").alias("fam_b"), "kind", "value").distinct()


# ---------------------------------------------------------------- coverage and quality
SCAFFOLD_FIELDS = ("identifiers", "datastores", "processes", "calls", "logging", "errors")


def missing_fields(presence: DataFrame) -> DataFrame:
    lost = F.array_compact(F.array(*[F.when(F.col(f) == 0, F.lit(f)) for f in SCAFFOLD_FIELDS]))
    return presence.withColumn("missing", lost)


def scaffold_coverage(presence: DataFrame, by: str, samples: int = 5) -> DataFrame:
    """Tracked signals, filled fields and up to five samples with gaps, per extractor."""
    m = missing_fields(presence)
    agg = m.groupBy(by).agg(F.count(F.lit(1)).alias("tracked"), *[F.count_if(F.col(f) > 0).alias("with_" + f) for f in SCAFFOLD_FIELDS])
    gaps = ordered.top_per_key(m.filter(F.size("missing") > 0).select(by, "signal_id"), [by], [F.col("signal_id")], samples)
    s = gaps.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("signal_id")), ",").alias("samples"))
    return agg.join(s, by, "left")


# Coverage thresholds.
COVERAGE_LIMITS = {"max_no_scaffold": 5, "min_io": 5, "min_calls": 3, "min_logging": 1, "min_errors": 1}


def coverage_gate(presence: DataFrame, limits: dict[str, int] = COVERAGE_LIMITS) -> DataFrame:
    """Coverage metrics over rows with gaps, and the thresholds they fail."""
    m = missing_fields(presence).filter(F.size("missing") > 0)
    lacks = lambda *fs: F.arrays_overlap("missing", F.array(*[F.lit(f) for f in fs]))
    r = m.agg(
        F.count(F.lit(1)).alias("gaps"), F.count_if(F.size("missing") == len(SCAFFOLD_FIELDS)).alias("missing_scaffold"),
        F.count_if(~lacks("identifiers", "datastores", "processes")).alias("with_io"), F.count_if(~lacks("calls")).alias("with_calls"),
        F.count_if(~lacks("logging")).alias("with_logging"), F.count_if(~lacks("errors")).alias("with_errors"),
    )
    fails = F.array_compact(F.array(
        F.when(F.col("missing_scaffold") > limits["max_no_scaffold"], F.lit(f"missing_scaffold>{limits['max_no_scaffold']}")),
        F.when(F.col("with_io") < limits["min_io"], F.lit(f"with_io<{limits['min_io']}")),
        F.when(F.col("with_calls") < limits["min_calls"], F.lit(f"with_calls<{limits['min_calls']}")),
        F.when(F.col("with_logging") < limits["min_logging"], F.lit(f"with_logging<{limits['min_logging']}")),
        F.when(F.col("with_errors") < limits["min_errors"], F.lit(f"with_errors<{limits['min_errors']}")),
    ))
    return r.withColumn("failures", F.array_join(fails, ","))


def process_quality(presence: DataFrame) -> DataFrame:
    """Weighted, capped quality score; expects the presence columns plus steps, interfaces,
    invocations, triggers and relationships counts."""
    cap3 = lambda c: F.least(F.col(c), F.lit(3))
    flag = lambda c, n: F.when(F.col(c) > 0, n).otherwise(0)
    score = (
        F.col("identifiers") * 3 + F.col("datastores") * 2 + F.col("processes") * 2 + F.col("steps") + cap3("interfaces") + cap3("relationships")
        + flag("triggers", 2) + cap3("invocations") + cap3("services") + flag("errors", 1) + flag("logging", 1)
    )
    p = presence.withColumn("score", score.cast("bigint"))
    return p.withColumn("has_details", (F.col("score") >= 5) | (F.col("steps") > 0) | (F.col("relationships") > 0)).withColumn(
        "priority", tx.priority(F.col("score"))
    ).withColumn("band", tx.band(F.col("score")))


#: Standing entries of a worklist.
STANDING = (("Anti-Pattern Register", "quality", 3), ("Repository Comprehensive Narrative", "repo_final", 5))


def worklist(quality: DataFrame, shared: DataFrame, clusters: DataFrame, eligible: Column, skip: tuple[str, ...] = ()) -> DataFrame:
    """Documents to write, in order: ``(title, category, priority, score, band)``.

    Processes come by richness: quality score, interfaces, invocations, calls and shared datastores together.
    Components and families follow where one of their processes has details; ``skip`` names components left out
    (lower case).  ``clusters(slug)`` give an entry each; the standing entries exist once there is any record.
    """
    none, no_band = F.lit(None).cast("bigint").alias("score"), F.lit(None).cast("string").alias("band")
    entry = lambda name, label: F.concat(name, F.lit(f" – {label} Brief")).alias("title")
    rich = F.col("score") + F.col("interfaces") + F.col("invocations") + F.col("processes") + F.coalesce("shared_data", F.lit(0))
    rows = quality.join(shared, "signal_id", "left").filter(eligible).withColumn("score", rich.cast("bigint"))
    out = rows.select(entry(F.col("name"), "Process"), F.lit("process").alias("category"), tx.priority(F.col("score")).alias("priority"), "score", tx.band(F.col("score")).alias("band"))
    per = quality.groupBy("component", "family").agg(F.bool_or("has_details").alias("d")).filter("d")
    groups = {"component": per.filter(~F.lower("component").isin(*skip)) if skip else per, "family": per}
    for level, found in groups.items():
        names = found.select(level).distinct().filter(F.col(level).isNotNull())
        out = out.unionByName(names.select(entry(F.col(level), level.capitalize()), F.lit(level).alias("category"), F.lit(3 if level == "component" else 2).alias("priority"), none, no_band))
    named = F.initcap(F.replace("slug", F.lit("-"), F.lit(" ")))
    out = out.unionByName(clusters.select("slug").distinct().select(entry(named, "Constellation"), F.lit("constellation").alias("category"), F.lit(2).alias("priority"), none, no_band))
    standing = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(c).alias("category"), F.lit(p).alias("priority")) for t, c, p in STANDING])
    some = quality.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.explode(standing).alias("s")).select("s.*", none, no_band)
    return out.unionByName(some).orderBy("priority", F.col("score").desc_nulls_last(), "title")


# ---------------------------------------------------------------- budgets
def apply_budget(docs: DataFrame, group: str, order: str, length: Column, budget: int) -> DataFrame:
    """Documents taken per group until the character budget is reached.

    ``taken`` is the characters kept: all of a document, a part of the one that straddles the
    budget, 0 for those after it.  The straddler ends the packing.
    """
    d = docs.withColumn("__len", length.cast("bigint"))
    d = ordered.running_total(d, [group], [order], F.col("__len"), "cum")
    before = F.col("cum") - F.col("__len")
    taken = F.when(F.col("cum") <= budget, F.col("__len")).when(before < budget, budget - before).otherwise(0)
    return d.withColumn("taken", taken.cast("bigint")).withColumn("truncated", (F.col("cum") > budget) & (before < budget)).drop("__len")


def limit_items(items: DataFrame, group: str, order: str, k: int = 8) -> DataFrame:
    """First ``k`` items per group and how many more there are."""
    total = items.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    top = ordered.top_per_key(items, [group], [F.col(order)], k)
    text = top.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(order)), ",").alias("shown"))
    more = F.when(F.col("total") > k, F.concat(F.lit("... (+"), (F.col("total") - k).cast("string"), F.lit(" more)")))
    return text.join(total, group).select(group, "shown", more.alias("more"))
