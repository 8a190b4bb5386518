"""Rollups that documents are written from: insights, change lists, context under limits, coverage.

Lists that have no cap by definition stay long tables, a row per entry, so a component that holds a third
of all records is no single row; capped lists are pruned to their cap in every task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import ordered

#: How much of each section goes into the context of a group.
LIMITS = {
    "context": 6, "evidence_index": 300, "evidence": 8, "steps": 40, "relationships": 40, "interfaces": 10, "invocations": 10, "logging": 10,
    "errors": 10, "artifact_relationships": 30, "code_entities": 30, "integrations": 20, "ui_components": 20, "process_diagrams": 10,
    "business_entities": 15, "extrapolations": 10,
}
#: Inputs, outputs and identifiers of a record's summary.
IO_LIMITS = {"inputs": 10, "outputs": 10, "identifiers": 12}
#: Words that make a connector a known one.
KNOWN_CONNECTORS = ("http", "rest", "soap", "jdbc", "sql", "jms", "mapper", "callprocess", "process", "bw", "timer", "file")
#: Fixed value: where records without a component go.
UNGROUPED = "ungrouped"


# ---------------------------------------------------------------- context under limits
def compact_context(records: DataFrame, sections: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """``(group, id, section, rn, item)``: the first records of a group with the first entries of their sections.

    ``records(group, id)``, ``sections(id, section, at, item)``; ``at`` is any sortable column.  A section without
    a limit is left out.  Equal entries are kept, in the order of ``at``, then ``item``.  ``limits`` replaces
    single values of ``LIMITS``.
    """
    caps = LIMITS | (limits or {})
    chosen = ordered.top_per_key(records.distinct(), ["group"], [F.col("id")], caps["context"])
    cap = tx.lookup(F.col("section"), {s: n for s, n in caps.items() if s not in ("context", "evidence_index")})
    known = sections.withColumn("__cap", cap).filter("__cap IS NOT NULL")
    most = max(n for s, n in caps.items() if s not in ("context", "evidence_index"))
    kept = known.join(chosen.select("id").distinct(), "id", "left_semi")
    kept = ordered.top_per_key(kept, ["id", "section"], [F.col("at"), F.col("item")], most, rank="rn").filter("rn <= __cap")
    return chosen.join(kept, "id").select("group", "id", "section", F.col("rn").cast("bigint").alias("rn"), "item")


def evidence_index(context: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """``(group, item)``: the first distinct evidence of a group's context, records in order."""
    cap = (LIMITS | (limits or {}))["evidence_index"]
    own = context.filter("section = 'evidence'").groupBy("group", "item").agg(F.min(F.struct("id", "rn")).alias("at"))
    return ordered.top_per_key(own, ["group"], [F.col("at"), F.col("item")], cap).select("group", "item")


def io_summary(values: DataFrame, identifiers: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """``(signal_id, part, rn, value)``: the first inputs and outputs in their order and the least identifiers.

    ``values(signal_id, part, at, value)`` with part ``inputs`` or ``outputs``: repeated values stay, as they are
    examples; ``identifiers(signal_id, identifier)`` count once each.
    """
    caps = IO_LIMITS | (limits or {})
    cap = tx.lookup(F.col("part"), caps)
    shown = values.filter("value IS NOT NULL").filter(F.col("part").isin("inputs", "outputs"))
    rows = ordered.top_per_key(shown, ["signal_id", "part"], [F.col("at"), F.col("value")], max(caps.values()), rank="rn").filter(F.col("rn") <= cap)
    names = identifiers.filter("identifier IS NOT NULL").select("signal_id", F.lit("identifiers").alias("part"), F.col("identifier").alias("value")).distinct()
    names = ordered.top_per_key(names, ["signal_id", "part"], [F.col("value")], caps["identifiers"], rank="rn")
    out = rows.select("signal_id", "part", "rn", "value").unionByName(names.select("signal_id", "part", "rn", "value"))
    return out.withColumn("rn", F.col("rn").cast("bigint"))


def first_names(rows: DataFrame) -> DataFrame:
    """``(component, list, rn, name)``: distinct names of each list of a component, in the order first seen.

    ``rows(component, list, name, at)``; names that are null or empty are no names.  Positions are keyed
    prefix sums, so a component with most names is numbered by many tasks.
    """
    seen = rows.filter("name IS NOT NULL AND name <> ''").groupBy("component", "list", "name").agg(F.min("at").alias("at"))
    return ordered.row_index(seen, ["component", "list"], ["at", "name"], "rn").select("component", "list", "rn", "name")


# ---------------------------------------------------------------- components and families
def component_insights(signals: DataFrame, steps: DataFrame, triggers: DataFrame) -> DataFrame:
    """Flows, steps, connectors and trigger types per component.

    Steps and triggers shrink to counts per (signal, word) before they meet the signals; connectors and
    trigger types are vocabularies, which bounds their lists.
    """
    own = signals.select("signal_id", "component")
    of_steps = steps.groupBy("signal_id", F.col("connector").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    of_triggers = triggers.select("signal_id", F.col("type").alias("word")).distinct()
    counted = lambda df, what, n: df.select("component", F.lit(what).alias("what"), F.nullif(F.col("word"), F.lit("")).alias("word"), n.cast("bigint").alias("n"))
    rows = counted(own.withColumn("word", F.lit("")), "flow", F.lit(1))
    rows = rows.unionByName(counted(of_steps.join(own, "signal_id"), "step", F.col("n"))).unionByName(counted(of_triggers.join(own, "signal_id"), "trigger", F.lit(1)))
    words = rows.groupBy("component", "what", "word").agg(F.sum("n").alias("n"))
    total = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0))
    names = lambda what: F.array_sort(F.collect_set(F.when(F.col("what") == what, F.col("word"))))
    return words.groupBy("component").agg(
        total("flow").alias("flows"), total("step").alias("steps"), F.size(names("step")).cast("bigint").alias("connectors"),
        F.array_join(names("step"), ",").alias("connector_list"), F.array_join(names("trigger"), ",").alias("trigger_types"),
    )


def family_interfaces(processes: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Distinct ``(family, process, kind, method, endpoint)``; a missing part counts as empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    own = interfaces.select("process", text("kind"), text("method"), text("endpoint")).distinct()
    return own.join(processes.select("process", "family").distinct(), "process").select("family", "process", "kind", "method", "endpoint")


def repository_overview(processes: DataFrame, calls: DataFrame, values: DataFrame) -> DataFrame:
    """``(section, fam_a, fam_b, n)``: members of a family, calls from one family to another, values that two share.

    ``values(fam_a, fam_b, kind, value)`` are distinct, pairs of one family among them.
    """
    fam = processes.select("process", "family").filter("family IS NOT NULL").distinct()
    none = F.lit(None).cast("string")
    members = fam.groupBy(F.col("family").alias("fam_a")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("members").alias("section"), "fam_a", none.alias("fam_b"), "n")
    ends = calls.join(fam.select(F.col("process").alias("src"), F.col("family").alias("fam_a")), "src").join(fam.select(F.col("process").alias("dst"), F.col("family").alias("fam_b")), "dst")
    across = ends.filter("fam_a <> fam_b").groupBy("fam_a", "fam_b").agg(F.count(F.lit(1)).alias("n")).select(F.lit("calls").alias("section"), "fam_a", "fam_b", "n")
    shared = values.groupBy(F.concat(F.lit("shared_"), "kind").alias("section"), "fam_a", "fam_b").agg(F.count(F.lit(1)).alias("n"))
    return members.unionByName(across).unionByName(shared)


# ---------------------------------------------------------------- changes, clusters, coverage
def change_entries(changes: DataFrame) -> DataFrame:
    """``(component, list, key)`` of ``changes(component, kind, change, key)``: six lists per component.

    Workflows have lists of their own, every other kind is an integration.
    """
    kind = F.when(F.coalesce(F.col("kind") == "workflows", F.lit(False)), "workflows").otherwise("integrations")
    home = F.coalesce(F.nullif("component", F.lit("")), F.lit(UNGROUPED))
    return changes.select(home.alias("component"), F.concat("change", F.lit("_"), kind).alias("list"), "key")


def change_counts(entries: DataFrame) -> DataFrame:
    """The sizes of the six lists, a column each."""
    lists = [f"{c}_{k}" for k in ("workflows", "integrations") for c in ("added", "removed", "modified")]
    return entries.groupBy("component").agg(*[F.count_if(F.col("list") == name).alias(name) for name in lists])


def cluster_evidence(members: DataFrame, evidence: DataFrame, per_node: int = 2, most: int = 6) -> DataFrame:
    """``(cluster, rn, id, item)``: the first evidence of a cluster, at most ``per_node`` of each member, members by id.

    ``members(cluster, id)``, ``evidence(id, at, item)``.
    """
    few = ordered.top_per_key(evidence, ["id"], [F.col("at"), F.col("item")], per_node)
    of = few.join(members.select("cluster", "id"), "id")
    top = ordered.top_per_key(of, ["cluster"], [F.col("id"), F.col("at"), F.col("item")], most, rank="rn")
    return top.select("cluster", F.col("rn").cast("bigint").alias("rn"), "id", "item")


def step_coverage(steps: DataFrame, transitions: DataFrame) -> DataFrame:
    """Shares of steps with a role, with evidence and of a known type, and whether all transitions end at steps.

    ``transitions(signal_id, src, dst)``; ``transition_integrity`` is 1 where a signal has none, else 0 as soon as
    one end is no step's name.
    """
    low = F.lower(F.coalesce("connector", F.lit("")))
    ok = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 3)
    known = low.rlike("|".join(KNOWN_CONNECTORS))
    s = steps.withColumn("__roles", F.size(tx.prefix_roles(F.col("connector"))))
    shares = s.groupBy("signal_id").agg(
        ok(F.col("__roles") > 0).alias("role_ratio"),
        ok(F.coalesce("sql_text", "destination", "url", "called_process").isNotNull()).alias("evidence_ratio"),
        ok(known).alias("known_ratio"),
    )
    # ends and names are compared as one tagged aggregate per (signal, name); a null end is no name and counts as unknown
    ends = transitions.select("signal_id", F.explode(F.array("src", "dst")).alias("name"), F.lit(1).alias("end"), F.lit(0).alias("own"))
    names = steps.select("signal_id", "name", F.lit(0).alias("end"), F.lit(1).alias("own"))
    per = ends.unionByName(names).groupBy("signal_id", "name").agg(F.max("end").alias("end"), F.max("own").alias("own"))
    stray = per.filter("end = 1 AND (own = 0 OR name IS NULL)").select("signal_id", F.lit(0.0).alias("bad")).distinct()
    return shares.join(stray, "signal_id", "left").withColumn("transition_integrity", F.coalesce("bad", F.lit(1.0))).drop("bad")


def extractor_coverage(routed: DataFrame, emitted: DataFrame, failed: DataFrame) -> DataFrame:
    """``(extractor, root, files, signals, errors)`` with totals per extractor and over all (nulls).

    ``routed(path, extractor)`` counts files, ``emitted(path, extractor)`` a row per signal, ``failed(path,
    extractor)`` a row per error.  A root is a path's first folder.
    """
    rows = None
    for df, what in ((routed, "files"), (emitted, "signals"), (failed, "errors")):
        part = df.select("extractor", F.split_part("path", F.lit("/"), F.lit(1)).alias("root"), F.lit(what).alias("what"))
        rows = part if rows is None else rows.unionByName(part)
    counts = [F.count_if(F.col("what") == w).alias(w) for w in ("files", "signals", "errors")]
    return rows.rollup("extractor", "root").agg(*counts)


# ---------------------------------------------------------------- backfill
def backfill_control_edges(relations: DataFrame, edges: DataFrame) -> DataFrame:
    """``(signal_id, parent, branch, child)`` from transition relationships, for signals without control edges.

    ``relations(signal_id, rel_type, source_name, target_name, operation, branch)``; the operation names the branch,
    else ``branch`` does; a relationship without both ends makes no edge.
    """
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    found = relations.filter(F.col("rel_type") == "transition").filter(full("source_name") & full("target_name"))
    found = found.join(edges.select("signal_id").distinct(), "signal_id", "left_anti")
    branch = F.coalesce(F.nullif("operation", F.lit("")), F.col("branch"))
    return found.select("signal_id", F.col("source_name").alias("parent"), branch.alias("branch"), F.col("target_name").alias("child"))
