"""Step, trigger and relationship enrichment; business scaffold tables.

Inputs are long tables keyed by ``signal_id``: ``steps`` (ordered by ``STEP_ORDER`` columns),
``triggers``, ``relations``.  Results stay long (one row per fact), so no signal's facts are
ever gathered unbounded; lists appear only where the result is capped by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import text as tx
from factloom.functions import vocab
from factloom.operators import ordered
from factloom.operators.hot import by_group

ORDER = ["pos", "k1", "k2"]
INTERFACE_CAP, INVOCATION_CAP, ERROR_CAP, IDENTIFIER_CAP = 12, 20, 10, 12


def _contains_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


# ---------------------------------------------------------------- enrichment
def data_access(steps: DataFrame, relations: DataFrame) -> DataFrame:
    """Database facts: steps on a database connector, and relationships to a database kind."""
    conn = F.lower(F.coalesce("connector", F.lit("")))
    own = steps.filter(_contains_any(conn, ("jdbc", "sql")) & F.col("sql_text").isNotNull()).select(
        "signal_id", F.col("name").alias("activity"), F.substring("sql_text", 1, 400).alias("sql_text"), "datasource",
        tx.sql_table_by_order(F.col("sql_text")).alias("table"),
    )
    kind = F.lower(F.coalesce("target_kind", "rel_type", F.lit("")))
    rel = relations.filter(_contains_any(kind, ("sql", "jdbc", "db", "database"))).select(
        "signal_id", F.col("source_name").alias("activity"), F.substring(F.coalesce("operation", F.lit("")), 1, 400).alias("sql_text"),
        F.col("target_ref").alias("datasource"), F.col("target_ref").alias("table"),
    )
    return own.unionByName(rel)


def messaging(steps: DataFrame, relations: DataFrame) -> DataFrame:
    words = ("jms", "queue", "topic", "servicebus")
    conn = F.lower(F.coalesce("connector", F.lit("")))
    own = steps.filter(_contains_any(conn, words) & F.col("destination").isNotNull()).select(
        "signal_id", F.col("name").alias("activity"), "destination", conn.alias("connector")
    )
    kind = F.lower(F.coalesce("target_kind", F.lit("")))
    rel = relations.filter(_contains_any(kind, words) & F.col("target_ref").isNotNull()).select(
        "signal_id", F.col("source_name").alias("activity"), F.col("target_ref").alias("destination"), kind.alias("connector")
    )
    return own.unionByName(rel)


def timers(steps: DataFrame, fields: tuple[str, ...] = ("cron",)) -> DataFrame:
    """Timer steps with whichever of cron / rate / interval / timezone they set."""
    named = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])
    t = steps.filter(_contains_any(F.lower("connector"), ("timer", "schedule")))
    return t.select("signal_id", F.col("name").alias("activity"), F.map_filter(named, lambda k, v: v.isNotNull()).alias("fields")).filter(F.size("fields") > 0)


def transition_conditions(control_edges: DataFrame) -> DataFrame:
    """``control_edges(signal_id, parent, branch, children)`` as one row per transition."""
    return control_edges.select("signal_id", F.col("parent").alias("src"), F.explode("children").alias("dst"), F.col("branch").alias("condition"))


def mapper_hints(steps: DataFrame) -> DataFrame:
    low = F.lower(F.coalesce("connector", F.lit("")))
    keys = F.split("inputs_keys", ",")
    m = steps.filter((low.contains("mapper") | (low == "map")) & F.col("inputs_keys").isNotNull())
    return m.select(
        "signal_id", F.col("name").alias("activity"), F.slice(keys, 1, 10).alias("paths"), tx.identifier_tokens(F.array_join(keys, " ")).alias("identifiers")
    )


def process_call_hints(steps: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct names a signal calls; only step fields have a length limit."""
    own = steps.select("signal_id", F.col("called_process").alias("process")).filter((F.length("process") > 2) & (F.length("process") < 200))
    rel = relations.filter(F.col("rel_type").isin("calls", "invokes")).select("signal_id", F.col("target_ref").alias("process"))
    return own.unionByName(rel).filter("process IS NOT NULL AND process <> ''").distinct()


def fixture_identifiers(files: DataFrame, items: int = 25) -> DataFrame:
    """Identifier-like keys of JSON fixtures (an object, or the first items of a list)."""
    obj = F.map_keys(F.expr("try_variant_get(v, '$', 'map<string,variant>')"))
    listed = F.flatten(
        F.transform(
            F.slice(F.expr("try_variant_get(v, '$', 'array<variant>')"), 1, items),
            lambda x: F.coalesce(F.map_keys(F.try_variant_get(x, "$", "map<string,variant>")), F.array().cast("array<string>")),
        )
    )
    d = files.withColumn("v", F.try_parse_json("text"))
    return d.select("path", F.explode(tx.identifier_tokens(F.array_join(F.coalesce(obj, listed), " "))).alias("identifier"))


# ---------------------------------------------------------------- backfill
def backfill_steps(signals: DataFrame, steps: DataFrame, relations: DataFrame) -> DataFrame:
    """Steps named after relationships, for signals that have relationships and no steps."""
    bare = relations.join(steps.select("signal_id").distinct(), "signal_id", "left_anti")
    numbered = ordered.row_index(bare, ["signal_id"], ORDER, "idx")
    target = F.coalesce("target_ref", F.concat(F.lit("target_"), F.col("idx").cast("string")))
    return numbered.select(
        "signal_id", "idx", F.concat(F.lit("Step_"), F.col("idx").cast("string"), F.lit("_"), target).alias("name"),
        F.coalesce("target_kind", F.lit("external")).alias("connector"), target.alias("target"), "operation",
    )


def backfill_triggers(signals: DataFrame, relations: DataFrame, triggers: DataFrame) -> DataFrame:
    """Triggers from method / path and trigger relationships, for signals without triggers."""
    none = signals.join(triggers.select("signal_id").distinct(), "signal_id", "left_anti")
    own = none.filter("method IS NOT NULL OR path IS NOT NULL").select(
        "signal_id", F.lit("http").alias("type"), F.upper(F.coalesce("method", F.lit("GET"))).alias("method"), "path"
    )
    rel = relations.filter("source_type = 'trigger'").join(none.select("signal_id"), "signal_id", "left_semi").select(
        "signal_id", F.coalesce("target_kind", F.lit("trigger")).alias("type"), F.col("operation").alias("method"), F.col("target_ref").alias("path")
    )
    return own.unionByName(rel)


def backfill_dependencies(relations: DataFrame) -> DataFrame:
    """Distinct ``(signal_id, bucket, value)`` by kind hints of relationship targets."""
    kind = F.lower(F.coalesce("target_kind", F.lit("")))
    buckets = F.array_compact(
        F.array(
            F.when(_contains_any(kind, vocab.DATASTORE_KIND_HINTS), F.lit("datastores")),
            F.when(_contains_any(kind, vocab.SERVICE_KIND_HINTS), F.lit("services")),
            F.when(F.col("rel_type").isin("calls", "invokes"), F.lit("processes")),
        )
    )
    r = relations.filter("target_ref IS NOT NULL").select("signal_id", F.explode(buckets).alias("bucket"), F.col("target_ref").alias("value"))
    return r.distinct()


def trigger_identifiers(triggers: DataFrame, signals: DataFrame) -> DataFrame:
    """Distinct identifier words of trigger paths, names and types, and of signal routes."""
    text = F.concat_ws(" ", "path", "name", "type")
    own = triggers.select("signal_id", F.explode(tx.identifier_tokens(text)).alias("identifier"))
    route = signals.select("signal_id", F.explode(tx.identifier_tokens(F.col("path"))).alias("identifier"))
    return own.unionByName(route).distinct()


# ---------------------------------------------------------------- scaffold
def _role(role: str) -> Column:
    return tx.has_role(role, F.col("connector"))


def interfaces(steps: DataFrame, triggers: DataFrame) -> DataFrame:
    """Triggers, then interface steps; first per (kind, endpoint, method), at most 12 per signal."""
    trig = triggers.select(
        "signal_id", F.lit(0).alias("src"), F.lit(0).alias("pos"), F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"),
        F.coalesce("type", F.lit("trigger")).alias("kind"), F.col("path").alias("endpoint"), "method", F.col("name").alias("evidence"),
    )
    st = steps.filter(_role("interface.receive") | _role("interface.reply"))
    st = st.select(
        "signal_id", F.lit(1).alias("src"), "pos", "k1", "k2", F.col("connector").alias("kind"), F.col("url").alias("endpoint"), "method", F.col("name").alias("evidence")
    )
    rows = trig.unionByName(st)
    return ordered.first_then_cap(rows, ["signal_id"], ["kind", "endpoint", "method"], ["src"] + ORDER, INTERFACE_CAP)


def _calls() -> Column:
    """Process, database and messaging calls of a step."""
    row = lambda kind, target, op: F.struct(F.lit(kind).alias("kind"), target.alias("target"), op.alias("operation"))
    return F.array_compact(
        F.array(
            F.when(_role("invoke.process"), row("Process", F.coalesce("called_process", "name"), F.lit(None).cast("string"))),
            F.when(_role("data.jdbc"), row("JDBC", F.col("datasource"), F.col("sql_text"))),
            F.when(_role("messaging.jms"), row("JMS", F.col("destination"), F.lit(None).cast("string"))),
        )
    )


def invocations(steps: DataFrame, data: DataFrame | None = None) -> DataFrame:
    """Process, database and messaging calls of steps; first per (kind, target, operation), at most 20."""
    rows = steps.select("signal_id", *ORDER, "connector", F.col("name").alias("evidence"), F.posexplode(_calls()).alias("sub", "c"))
    rows = rows.select("signal_id", *ORDER, "sub", "connector", "evidence", "c.*")
    return ordered.first_then_cap(rows, ["signal_id"], ["kind", "target", "operation"], ORDER + ["sub"], INVOCATION_CAP)


def dependencies(invoked: DataFrame, data: DataFrame, hints: DataFrame) -> DataFrame:
    """Distinct ``(signal_id, bucket, value)`` of datastores, processes and services."""
    bucket = F.when(F.col("kind") == "Process", "processes").when(F.col("kind") == "JMS", "services").otherwise("datastores")
    inv = invoked.select("signal_id", bucket.alias("bucket"), F.col("target").alias("value"))
    db = data.select("signal_id", F.lit("datastores").alias("bucket"), F.explode(F.array("datasource", "table")).alias("value"))
    return inv.unionByName(db).unionByName(hints.select("signal_id", "bucket", "value")).filter("value IS NOT NULL AND value <> ''").distinct()


def identifiers(*sources: DataFrame) -> DataFrame:
    """The first 12 identifiers of a signal in name order."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    return ordered.top_per_key(rows.distinct(), ["signal_id"], [F.col("identifier")], IDENTIFIER_CAP)


def errors(steps: DataFrame, transitions: DataFrame) -> DataFrame:
    """Error steps and transition conditions; signals with neither get connector defaults (first 3)."""
    none = F.lit(None).cast("string")
    own = steps.filter(_role("error.throw") | F.lower("name").contains("error")).select(
        "signal_id", F.lit(0).alias("src"), *ORDER, F.col("name").alias("activity"), none.alias("condition")
    )
    trans = transitions.select(
        "signal_id", F.lit(1).alias("src"), F.lit(0).alias("pos"), F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"),
        F.col("src").alias("activity"), "condition",
    )
    explicit = own.unionByName(trans)
    low = F.lower("connector")
    default = (
        F.when(low.isin("http", "rest", "soap"), "http_error_handling").when(low.isin("jdbc", "sql", "db"), "db_error_handling")
        .when(low.isin("jms", "queue", "topic"), "messaging_error_handling")
    )
    bare = steps.select("signal_id", F.lit(2).alias("src"), *ORDER, F.col("name").alias("activity"), default.alias("condition")).filter("condition IS NOT NULL")
    bare = bare.join(explicit.select("signal_id").distinct(), "signal_id", "left_anti")
    bare = ordered.top_per_key(bare, ["signal_id"], [F.col(c) for c in ORDER], 3)
    return ordered.first_then_cap(explicit.unionByName(bare), ["signal_id"], ["activity", "condition"], ["src"] + ORDER, ERROR_CAP)


def logging(steps: DataFrame) -> DataFrame:
    rows = steps.filter(_role("ops.log") | F.lower("name").contains("log"))
    rows = rows.select("signal_id", *ORDER, F.col("name").alias("activity"))
    return ordered.first_then_cap(rows, ["signal_id"], ["activity"], ORDER, ERROR_CAP)


def start_nodes(steps: DataFrame, triggers: DataFrame, transitions: DataFrame) -> DataFrame:
    """Parents that are no child; else trigger names; else the first step: ``(signal_id, node)``."""
    parents = transitions.select("signal_id", F.col("src").alias("node")).distinct()
    children = transitions.select("signal_id", F.col("dst").alias("node")).distinct()
    roots = parents.join(children, ["signal_id", "node"], "left_anti").withColumn("rule", F.lit(0))
    trig = triggers.select("signal_id", F.coalesce("name", "path", "type").alias("node")).filter("node IS NOT NULL").distinct()
    first = steps.groupBy("signal_id").agg(F.min_by("name", F.struct(*ORDER)).alias("node"))
    rows = roots.unionByName(trig.withColumn("rule", F.lit(1))).unionByName(first.withColumn("rule", F.lit(2)))
    best = rows.groupBy("signal_id").agg(F.min("rule").alias("rule"))
    return rows.join(best, ["signal_id", "rule"]).select("signal_id", "node", "rule")


def traceability(iface: DataFrame, steps: DataFrame, deps: DataFrame) -> DataFrame:
    """Short trace per signal: 1 interface, 5 steps, 3 of each dependency; every part is capped first."""
    first = ordered.top_per_key(iface, ["signal_id"], [F.col("src")] + [F.col(c) for c in ORDER] + [F.col("kind")], 1)
    a = first.select("signal_id", F.lit(0).alias("part"), F.lit(1).cast("bigint").alias("rn"),
                     F.concat(F.lit("interface:"), F.coalesce("method", F.lit("ANY")), F.lit(" "), F.coalesce("endpoint", "kind")).alias("t"))
    s = ordered.top_per_key(steps, ["signal_id"], [F.col(c) for c in ORDER], 5, rank="rn")
    b = s.select("signal_id", F.lit(1).alias("part"), F.col("rn").cast("bigint").alias("rn"), F.concat(F.lit("step:"), "name").alias("t"))
    d = ordered.top_per_key(deps, ["signal_id", "bucket"], [F.col("value")], 3, rank="rn")
    label = tx.lookup(F.col("bucket"), {"processes": "invoke:", "datastores": "datastore:", "services": "service:"})
    part = tx.lookup(F.col("bucket"), {"processes": 2, "datastores": 3, "services": 4})
    c = d.select("signal_id", part.alias("part"), F.col("rn").cast("bigint").alias("rn"), F.concat(label, F.col("value")).alias("t"))
    rows = a.unionByName(b).unionByName(c)
    return rows.groupBy("signal_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "rn", "t"))), lambda x: x["t"]), " > ").alias("trace")
    )


# ---------------------------------------------------------------- activities and transitions
def activities(steps: DataFrame) -> DataFrame:
    """Steps with a per-signal index and unique names (a repeated name gets ``-index``)."""
    return by_group([steps], "signal_id", lambda t, tasks: _activities_near(t[0].repartition(tasks, "signal_id")), lambda t: _activities_far(t[0]))


def _activities_near(steps: DataFrame) -> DataFrame:
    numbered = steps.withColumn("idx", F.row_number().over(Window.partitionBy("signal_id").orderBy(*ORDER)).cast("bigint"))
    first = F.min("idx").over(Window.partitionBy("signal_id", "name"))
    return _named(numbered.withColumn("__f", first))


def _activities_far(steps: DataFrame) -> DataFrame:
    numbered = ordered.row_index(steps, ["signal_id"], ORDER, "idx")
    firsts = numbered.groupBy(F.col("signal_id").alias("__s"), F.col("name").alias("__n")).agg(F.min("idx").alias("__f"))
    hit = numbered.join(firsts, F.col("signal_id").eqNullSafe(F.col("__s")) & F.col("name").eqNullSafe(F.col("__n")))
    return _named(hit.drop("__s", "__n"))


def _named(hit: DataFrame) -> DataFrame:
    again = F.concat("name", F.lit("-"), F.col("idx").cast("string"))
    return hit.withColumn("unique_name", F.when(F.col("idx") == F.col("__f"), F.col("name")).otherwise(again)).drop("__f")


def transitions(steps: DataFrame, start: DataFrame) -> DataFrame:
    """Transitions between activities: the steps a step runs after, else the step before it, else
    the start activity; both ends must be known names, each (pair, branch) once."""
    s = ordered.previous_value(steps, ["signal_id"], ORDER, "name", "prev")
    s = s.join(start.select("signal_id", F.col("node").alias("start")), "signal_id", "left")
    before = F.coalesce(F.split("run_after", "[|]"), F.array(F.coalesce("prev", "start")))
    rows = s.select("signal_id", F.explode(before).alias("src"), F.col("name").alias("dst"), F.col("branch").alias("label"))
    known = steps.select("signal_id", F.col("name").alias("src")).unionByName(start.select("signal_id", F.col("node").alias("src"))).distinct()
    return rows.filter("src IS NOT NULL").join(known, ["signal_id", "src"], "left_semi").distinct()


def external_nodes(relations: DataFrame) -> DataFrame:
    """``External:`` targets of relationships and the transitions to them."""
    return relations.filter("target_ref IS NOT NULL").select(
        "signal_id", F.col("source_name").alias("src"), F.concat(F.lit("External:"), "target_ref").alias("dst"), F.col("operation").alias("label"),
        F.coalesce("target_kind", F.lit("external")).alias("type"),
    ).distinct()


def flow_graph(steps: DataFrame, triggers: DataFrame, trans: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed flow nodes and edges (trigger, sequence, branch, external), each once."""
    n = steps.select("signal_id", F.col("name").alias("node"), F.lit("step").alias("type"))
    n = n.unionByName(triggers.select("signal_id", F.col("name").alias("node"), F.lit("trigger").alias("type")))
    ext = external_nodes(relations)
    n = n.unionByName(ext.select("signal_id", F.col("dst").alias("node"), F.lit("external").alias("type"))).distinct()
    first = steps.groupBy("signal_id").agg(F.min_by("name", F.struct(*ORDER)).alias("dst"))
    e1 = triggers.select("signal_id", F.col("name").alias("src")).join(first, "signal_id").withColumn("kind", F.lit("trigger"))
    e2 = trans.select("signal_id", "src", "dst", F.when(F.col("label").isNotNull(), "branch").otherwise("sequence").alias("kind"))
    e3 = ext.select("signal_id", "src", "dst", F.lit("external").alias("kind"))
    cols = ["signal_id", "src", "dst", "kind"]
    return n, e1.select(cols).unionByName(e2.select(cols)).unionByName(e3.select(cols)).distinct()


def _no_place(steps: DataFrame) -> list[Column]:
    """Empty ``ORDER`` columns for rows that are no steps."""
    return [F.lit(None).cast(steps.schema[c].dataType).alias(c) for c in ORDER]


_LINK = "array<struct<src: string, dst: string, label: string, kind: string>>"


def _met(steps: DataFrame, triggers: DataFrame, control: DataFrame, relations: DataFrame | None) -> DataFrame:
    """Rows of all inputs by signal: steps 0, triggers 1, sources 2 and targets 3 of control edges, relations 4."""
    none = F.lit(None).cast("string")
    place = _no_place(steps)
    rows = steps.select("signal_id", F.lit(0).alias("tag"), *ORDER, F.col("name").alias("node"), F.col("run_after").alias("other"), F.col("branch").alias("label"))
    rows = rows.unionByName(triggers.select(
        "signal_id", F.lit(1).alias("tag"), *place, F.coalesce("name", "path", "type").alias("node"), F.col("name").alias("other"), none.alias("label")
    ))
    ends = F.explode(F.array(F.struct(F.lit(2).alias("tag"), F.col("src").alias("node")), F.struct(F.lit(3).alias("tag"), F.col("dst").alias("node"))))
    rows = rows.unionByName(control.select("signal_id", ends.alias("e")).select("signal_id", "e.tag", *place, "e.node", none.alias("other"), none.alias("label")))
    if relations is not None:
        target = relations.filter("target_ref IS NOT NULL")
        rows = rows.unionByName(target.select(
            "signal_id", F.lit(4).alias("tag"), *place, F.col("source_name").alias("node"), F.concat(F.lit("External:"), "target_ref").alias("other"), none.alias("label")
        ))
    return rows


def _links(rows: DataFrame, whole: bool) -> DataFrame:
    """``(signal_id, src, dst, label, kind)`` from ``_met`` rows dealt by signal, each once and in that partition.

    Kind is ``transition``; with ``whole`` also ``trigger`` and ``external`` edges and ``node:`` rows whose node is ``src``.
    """
    tag, none = F.col("tag"), F.lit(None).cast("string")
    at_node, of_signal = Window.partitionBy("signal_id", "node"), Window.partitionBy("signal_id")
    child = F.col("node").isNotNull() & F.max(tag == 3).over(at_node)
    rows = rows.withColumn("rule", F.when((tag == 2) & ~child, 0).when((tag == 1) & F.col("node").isNotNull(), 1).when(tag == 0, 2))
    first = F.min(F.when(tag == 0, F.struct(*ORDER, "node"))).over(of_signal)
    rows = rows.withColumns({"best": F.min("rule").over(of_signal), "first": first})
    rows = rows.withColumn("root", F.min(F.when((F.col("rule") == F.col("best")) & (F.col("rule") < 2), F.col("node"))).over(of_signal))
    start = F.when(F.col("best") == 2, F.col("first.node")).otherwise(F.col("root"))
    prev = F.lag("node").over(Window.partitionBy("signal_id", "tag").orderBy(*ORDER))
    rows = rows.withColumns({"start": start, "prev": prev})
    link = lambda src, dst, label, kind: F.struct(src.alias("src"), dst.alias("dst"), label.alias("label"), F.lit(kind).alias("kind"))
    node, other, label = F.col("node"), F.col("other"), F.col("label")
    before = F.coalesce(F.split(other, "[|]"), F.array(F.coalesce("prev", "start")))
    of_step = F.concat(F.transform(before, lambda x: link(x, node, label, "transition")), F.array(link(node, none, none, "node:step")))
    links = F.when(tag == 0, of_step)
    if whole:
        begun = F.when(F.col("signal_id").isNotNull() & F.col("first").isNotNull(), link(other, F.col("first.node"), none, "trigger"))
        links = links.when(tag == 1, F.array_compact(F.array(begun, link(other, none, none, "node:trigger"))))
        links = links.when(tag == 4, F.array(link(node, other, none, "external"), link(other, none, none, "node:external")))
    rows = rows.select("signal_id", "start", F.explode(links.cast(_LINK)).alias("l")).select("signal_id", "start", "l.*")
    known = F.max(F.col("kind") == "node:step").over(Window.partitionBy("signal_id", "src")) | F.coalesce(F.col("src") == F.col("start"), F.lit(False))
    holds = F.col("signal_id").isNotNull() & F.col("src").isNotNull() & F.col("known")
    rows = rows.withColumn("known", known).filter((F.col("kind") != "transition") | holds)
    if not whole:
        rows = rows.filter("kind = 'transition'")
    else:  # transitions count once per pair and whether they have a label
        branch = F.when(F.col("label").isNotNull(), "branch").otherwise("sequence")
        rows = rows.withColumns({"kind": F.when(F.col("kind") == "transition", branch).otherwise(F.col("kind")), "label": none})
    return rows.select("signal_id", "src", "dst", "label", "kind").distinct()


def step_transitions(steps: DataFrame, triggers: DataFrame, control: DataFrame) -> DataFrame:
    """``transitions`` with the start nodes of ``start_nodes``, in one exchange for all but hot signals."""
    near = lambda t, tasks: _links(_met(*t, None).repartition(tasks, "signal_id"), False).drop("kind")
    return by_group([steps, triggers, control], "signal_id", near, lambda t: transitions(t[0], _least_start(*t)), [0])


def _least_start(steps: DataFrame, triggers: DataFrame, control: DataFrame) -> DataFrame:
    return start_nodes(steps, triggers, control).groupBy("signal_id").agg(F.min("node").alias("node"))


def flow_links(steps: DataFrame, triggers: DataFrame, control: DataFrame, relations: DataFrame) -> DataFrame:
    """``(signal_id, src, dst, kind)``: the edges of ``flow_graph`` and its nodes (``node:`` and type, in ``src``), in one
    exchange for all but hot signals."""
    def far(t: list[DataFrame]) -> DataFrame:
        steps, triggers, control, relations = t
        nodes, edges = flow_graph(steps, triggers, transitions(steps, _least_start(steps, triggers, control)), relations)
        nodes = nodes.select("signal_id", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.concat(F.lit("node:"), "type").alias("kind"))
        return edges.unionByName(nodes)

    near = lambda t, tasks: _links(_met(*t).repartition(tasks, "signal_id"), True).drop("label")
    return by_group([steps, triggers, control, relations], "signal_id", near, far, [0, 3])


# ---------------------------------------------------------------- traces in one exchange
#: Parts of a trace, with the label and the most entries of each.
TRACE = {0: ("interface:", 1), 1: ("step:", 5), 2: ("invoke:", 3), 3: ("datastore:", 3), 4: ("service:", 3)}
_BUCKET_PART = {"processes": 2, "datastores": 3, "services": 4}
_KIND_PART = {"Process": 2, "JDBC": 3, "JMS": 4}


def traces(steps: DataFrame, triggers: DataFrame, relations: DataFrame) -> DataFrame:
    """``traceability`` of the interfaces, steps and dependencies, in one exchange for all but hot signals."""
    def far(t: list[DataFrame]) -> DataFrame:
        deps = dependencies(invocations(t[0]), data_access(t[0], t[2]), backfill_dependencies(t[2]))
        return traceability(interfaces(t[0], t[1]), t[0], deps)

    # a row becomes several facts, so a task takes fewer rows
    near = lambda t, tasks: _traced(_trace_rows(*t).repartition(4 * tasks, "signal_id"))
    return by_group([steps, triggers, relations], "signal_id", near, far, [0, 2])


def _trace_rows(steps: DataFrame, triggers: DataFrame, relations: DataFrame) -> DataFrame:
    """A row per input row with its interface, its name if it is a step, its calls and other dependencies."""
    none = F.lit(None).cast("string")
    face = lambda kind, endpoint, method: F.struct(kind.alias("kind"), endpoint.alias("endpoint"), method.alias("method"))
    dep = lambda part, value: F.struct(F.lit(part).alias("part"), value.alias("value"))
    kinds = {"iface": "struct<kind: string, endpoint: string, method: string>", "calls": "array<struct<kind: string, target: string, operation: string>>", "deps": "array<struct<part: int, value: string>>"}

    def row(df: DataFrame, src: int, place: list, name: Column, iface: Column, calls: Column, deps: Column) -> DataFrame:
        made = {"iface": iface, "calls": calls, "deps": deps}
        return df.select("signal_id", F.lit(src).alias("src"), *place, name.alias("name"), *[c.cast(kinds[n]).alias(n) for n, c in made.items()])

    low = F.lower(F.coalesce("connector", F.lit("")))
    data = _contains_any(low, ("jdbc", "sql")) & F.col("sql_text").isNotNull()
    stores = F.when(data, F.array(dep(3, F.col("datasource")), dep(3, tx.sql_table_by_order(F.col("sql_text")))))
    seen = F.when(_role("interface.receive") | _role("interface.reply"), face(F.col("connector"), F.col("url"), F.col("method")))
    rows = row(steps, 1, ORDER, F.col("name"), seen, _calls(), stores)
    given = face(F.coalesce("type", F.lit("trigger")), F.col("path"), F.col("method"))
    rows = rows.unionByName(row(triggers, 0, _no_place(steps), none, given, F.lit(None), F.lit(None)))
    kind, hint, target = F.lower(F.coalesce("target_kind", "rel_type", F.lit(""))), F.lower(F.coalesce("target_kind", F.lit(""))), F.col("target_ref")
    of_relation = F.array_compact(F.array(
        F.when(_contains_any(kind, ("sql", "jdbc", "db", "database")) | _contains_any(hint, vocab.DATASTORE_KIND_HINTS), dep(3, target)),
        F.when(_contains_any(hint, vocab.SERVICE_KIND_HINTS), dep(4, target)),
        F.when(F.col("rel_type").isin("calls", "invokes"), dep(2, target)),
    ))
    return rows.unionByName(row(relations, 2, _no_place(steps), none, F.lit(None), F.lit(None), of_relation))


def _traced(rows: DataFrame) -> DataFrame:
    """The traces of ``_trace_rows`` dealt by signal; all that follows stays in that partition."""
    nth = F.row_number().over(Window.partitionBy("signal_id", "src").orderBy(*ORDER))
    rows = rows.withColumn("nth", F.when(F.col("src") == 1, nth).otherwise(0).cast("bigint"))
    none = F.lit(None).cast("string")
    # what: 0 interface, 1 step, 2 call, 3 dependency; equal ones count once, at their first place
    fact = lambda what, a, b, c, sub, part: F.struct(
        F.lit(what).alias("what"), a.alias("a"), b.alias("b"), c.alias("c"), sub.cast("int").alias("sub"), part.cast("int").alias("part")
    )
    facts = F.concat(
        F.array_compact(F.array(
            F.when(F.col("iface").isNotNull(), fact(0, F.col("iface.kind"), F.col("iface.endpoint"), F.col("iface.method"), F.lit(0), F.lit(0))),
            F.when((F.col("src") == 1) & (F.col("nth") <= TRACE[1][1]), fact(1, F.col("name"), F.col("nth").cast("string"), none, F.lit(0), F.lit(1))),
        )),
        F.transform(F.coalesce("calls", F.array()), lambda c, i: fact(2, c["target"], c["kind"], c["operation"], i, tx.lookup(c["kind"], _KIND_PART))),
        F.transform(F.coalesce("deps", F.array()), lambda d: fact(3, d["value"], none, none, F.lit(0), d["part"])),
    )
    rows = rows.select("signal_id", "src", "nth", F.explode(facts).alias("f")).select("signal_id", "src", "nth", "f.*")
    # the place in one number, so that its minimum is taken by hashing
    at = F.shiftleft(F.col("src").cast("bigint"), 50).bitwiseOR(F.shiftleft("nth", 4)).bitwiseOR(F.col("sub").cast("bigint"))
    rows = rows.groupBy("signal_id", "what", "part", "a", "b", "c").agg(F.min(at).alias("at"))
    rank = F.row_number().over(Window.partitionBy("signal_id", "what").orderBy("at", "a", "b", "c"))
    rows = rows.withColumn("rank", rank).filter((F.col("what") == 1) | (F.col("what") == 3) | (F.col("rank") <= F.when(F.col("what") == 0, 1).otherwise(INVOCATION_CAP)))
    is_dep, empty = F.col("what") >= 2, F.col("a").isNull() | (F.col("a") == "")
    endpoint = F.concat(F.coalesce("c", F.lit("ANY")), F.lit(" "), F.coalesce("b", "a"))
    value = F.when(F.col("what") == 0, endpoint).otherwise(F.col("a"))
    place = F.when(F.col("what") == 1, F.col("b").cast("int")).otherwise(F.lit(0))
    rows = rows.filter(~is_dep | ~empty).select("signal_id", "part", value.alias("value"), place.alias("place")).distinct()
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("signal_id", "part").orderBy("place", "value")))
    most = tx.lookup(F.col("part"), {p: n for p, (_, n) in TRACE.items()})
    text = F.concat(tx.lookup(F.col("part"), {p: label for p, (label, _) in TRACE.items()}), F.col("value"))
    rows = rows.filter(F.col("rn") <= most)
    entries = F.array_sort(F.collect_list(F.struct("part", "rn", text.alias("t"))))
    return rows.groupBy("signal_id").agg(F.array_join(F.transform(entries, lambda x: x["t"]), " > ").alias("trace"))


# ---------------------------------------------------------------- derived rows and artifacts
def derived_rows(signals: DataFrame, triggers: DataFrame, data: DataFrame) -> DataFrame:
    """One ``db`` row per SQL found, one ``route`` row per HTTP trigger, and a ``workflow`` row for
    signals without any route."""
    db = data.select("signal_id", F.lit("db").alias("kind"), F.coalesce("table", "datasource").alias("name"))
    route = triggers.filter("type = 'http' AND path IS NOT NULL").select("signal_id", F.lit("route").alias("kind"), F.concat_ws(" ", "method", "path").alias("name"))
    flow = signals.select("signal_id", F.lit("workflow").alias("kind"), "name").join(route.select("signal_id").distinct(), "signal_id", "left_anti")
    return db.unionByName(route).unionByName(flow)


# Signal kind -> artifact type.
ARTIFACT_TYPES = {"workflow": "workflow_dag", "route": "api_route", "db": "datastore", "api": "api_spec", "op": "api_operation", "doc": "document", "integration": "integration_signal", "infra": "infra_resource", "job": "ci_job"}


def artifacts(signals: DataFrame) -> DataFrame:
    """Signals mapped to the common artifact columns by kind."""
    k = F.col("kind")
    return signals.select(
        "signal_id", tx.lookup(k, ARTIFACT_TYPES, k).alias("artifact_type"), "name", F.coalesce("component", F.lit("ungrouped")).alias("component"),
        F.col("file").alias("repo_path"), F.when(k == "route", F.concat_ws(" ", "method", "path")).alias("endpoint"),
        F.when(k == "db", F.col("name")).alias("datastore"),
        tx.artifact_confidence(F.when(k == "db", 0.7).otherwise(1.0), F.lit(0.0)).alias("confidence"),
    )


def experience_pack(steps: DataFrame, cap: int = 20) -> DataFrame:
    """Interface steps shown to users: distinct, first 20 per signal."""
    rows = steps.filter(F.col("url").isNotNull()).select("signal_id", *ORDER, F.col("name").alias("screen"), F.col("url").alias("target"))
    return ordered.first_then_cap(rows, ["signal_id"], ["screen", "target"], ORDER, cap)


def compact_records(steps: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Compact record per signal: capped lists of names and connectors."""
    s = ordered.top_per_key(steps, ["signal_id"], [F.col(c) for c in ORDER], max(caps.values()), rank="rn")
    pick = lambda col, n: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= n, F.struct("rn", F.col(col).alias("v"))))), lambda x: x["v"]), ","
    )
    return s.groupBy("signal_id").agg(*[pick(col, n).alias(col + "_list") for col, n in caps.items()])
