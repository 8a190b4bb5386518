"""Step enrichment, scaffold, transitions and artifact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions import vocab
from factloom.operators import rollups
from factloom.operators import steps as st
from factloom.plans import views  # noqa: F401  (registers the shared views)
from factloom.plans.registry import query, view

_PREFIX = ", ".join(f"('{k}', '{r}')" for k, v in vocab.PREFIX_ROLES.items() for r in v)

view("connector_roles", f"SELECT * FROM (VALUES {_PREFIX}) AS r(prefix, role)")

# transitions given as control edges: branch steps hang off the first step of the signal
view(
    "branches",
    """
    SELECT signal_id, 'S1' AS src, name AS dst, branch AS condition, pos, k1, k2 FROM $steps WHERE branch IS NOT NULL AND signal_id % 2 = 0""",
)

view(
    "step_table_names",
    r"""
    SELECT *, CASE WHEN sql_text IS NOT NULL THEN lower(CASE k2 % 4 WHEN 0 THEN 'dbo.tbl' || CAST(k2 % 50 AS STRING) ELSE 'tbl' || CAST(k2 % 50 AS STRING) END) END AS tbl FROM $steps""",
)

view(
    "data_access_rows",
    """
    SELECT signal_id, name AS activity, sql_text, datasource, tbl FROM $step_table_names WHERE sql_text IS NOT NULL
    UNION ALL SELECT signal_id, source_name, operation, target_ref, target_ref FROM $relations WHERE target_kind IN ('sql_table', 'cosmosdb')""",
)


def _data(t):
    return st.data_access(t.view("steps", spread=True), t.view("relations", spread=True))


def _control(t):
    b = t.view("branches")
    return st.transition_conditions(b.select("signal_id", F.col("src").alias("parent"), F.col("condition").alias("branch"), F.array("dst").alias("children")))


# cosmosdb contains "db": both relationship kinds count as databases
@query("data_access", "SELECT activity, datasource, tbl, count(*) AS n FROM $data_access_rows GROUP BY 1, 2, 3")
def data_access(t):
    return _data(t).groupBy("activity", "datasource", F.col("table").alias("tbl")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "messaging_destinations",
    """
    SELECT connector, destination, count(*) AS n FROM (
      SELECT connector, destination FROM $steps WHERE destination IS NOT NULL
      UNION ALL SELECT target_kind, target_ref FROM $relations WHERE target_kind = 'servicebus') GROUP BY 1, 2""",
)
def messaging_destinations(t):
    return st.messaging(t.view("steps", spread=True), t.view("relations", spread=True)).groupBy("connector", "destination").agg(F.count(F.lit(1)).alias("n"))


@query("timer_steps", "SELECT cron, count(*) AS n, count(DISTINCT signal_id) AS signals FROM $steps WHERE cron IS NOT NULL GROUP BY 1")
def timer_steps(t):
    x = st.timers(t.view("steps", spread=True)).select("signal_id", F.try_element_at("fields", F.lit("cron")).alias("cron"))
    return x.groupBy("cron").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("signal_id").alias("signals"))


@query("transition_conditions", "SELECT src, dst, condition, count(*) AS n FROM $branches GROUP BY 1, 2, 3")
def transition_conditions(t):
    return _control(t).groupBy("src", "dst", "condition").agg(F.count(F.lit(1)).alias("n"))


@query(
    "mapper_hints",
    "SELECT activity, identifiers, count(*) AS n FROM (SELECT name AS activity, 'OrderId,Part' || CAST(k2 % 5 AS STRING) || 'Key' AS identifiers FROM $steps WHERE connector = 'mapper') GROUP BY 1, 2",
)
def mapper_hints(t):
    return st.mapper_hints(t.view("steps", spread=True)).groupBy("activity", F.array_join("identifiers", ",").alias("identifiers")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "process_calls",
    """
    SELECT process, count(*) AS signals FROM (
      SELECT signal_id, called_process AS process FROM $steps WHERE length(called_process) BETWEEN 3 AND 199
      UNION SELECT signal_id, target_ref FROM $relations WHERE rel_type IN ('calls', 'invokes')) GROUP BY 1""",
)
def process_calls(t):
    return st.process_call_hints(t.view("steps", spread=True), t.view("relations", spread=True)).groupBy("process").agg(F.count(F.lit(1)).alias("signals"))


@query(
    "fixture_identifiers",
    "SELECT identifier, count(*) AS n FROM (SELECT unnest(['orderKey', 'userId' || CAST(user_id % 3 AS STRING) || 'code']) AS identifier FROM events WHERE event_id % 2 = 0 UNION ALL SELECT unnest(['itemId', 'stockNumber']) FROM events WHERE event_id % 2 = 1) GROUP BY 1",
)
def fixture_identifiers(t):
    obj = F.concat(F.lit('{"orderKey":1,"plain":2,"userId'), (F.col("user_id") % 3).cast("string"), F.lit('code":3}'))
    e = t.spread("events").select(
        F.concat(F.lit("fx/"), F.col("event_id").cast("string")).alias("path"),
        F.when(F.col("event_id") % 2 == 0, obj).otherwise(F.lit('[{"itemId":1},{"stockNumber":2,"x":1},5]')).alias("text"),
    )
    return st.fixture_identifiers(e).groupBy("identifier").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- backfill
@query(
    "backfilled_steps",
    """
    WITH bare AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY pos, k1, k2) AS idx FROM $relations WHERE signal_id % 3 = 0)
    SELECT signal_id, idx, 'Step_' || CAST(idx AS STRING) || '_' || target_ref AS name, target_kind AS connector, target_ref AS target, operation FROM bare""",
)
def backfilled_steps(t):
    return st.backfill_steps(t.view("signals"), t.view("steps", spread=True).filter("signal_id % 3 <> 0"), t.view("relations", spread=True))


@query(
    "backfilled_triggers",
    """
    WITH n AS (SELECT * FROM $signals WHERE kind = 'db')
    SELECT signal_id, 'http' AS type, upper(coalesce(method, 'GET')) AS method, path FROM n WHERE method IS NOT NULL OR path IS NOT NULL
    UNION ALL SELECT r.signal_id, target_kind, operation, target_ref FROM $relations r JOIN n ON r.signal_id = n.signal_id WHERE source_type = 'trigger'""",
)
def backfilled_triggers(t):
    return st.backfill_triggers(t.view("signals"), t.view("relations", spread=True), t.view("triggers"))


# every second relationship of a signal is a transition to the step after it
view(
    "transition_relations",
    """
    SELECT signal_id, CASE WHEN pos % 2 = 0 THEN 'transition' ELSE rel_type END AS rel_type, source_name, CASE WHEN k1 % 11 <> 0 THEN 'S' || CAST(pos + 1 AS STRING) END AS target_name,
      CASE WHEN k2 % 2 = 0 THEN operation END AS operation, target_kind AS branch FROM $relations""",
)


@query(
    "backfilled_control_edges",
    """
    SELECT signal_id, source_name AS parent, coalesce(operation, branch) AS branch, target_name AS child FROM $transition_relations
    WHERE rel_type = 'transition' AND target_name IS NOT NULL AND signal_id NOT IN (SELECT signal_id FROM $branches)""",
)
def backfilled_control_edges(t):
    return rollups.backfill_control_edges(t.view("transition_relations", spread=True), t.view("branches"))


@query(
    "backfilled_dependencies",
    """
    SELECT bucket, value, count(*) AS signals FROM (
      SELECT DISTINCT signal_id, 'datastores' AS bucket, target_ref AS value FROM $relations WHERE target_kind IN ('sql_table', 'cosmosdb')
      UNION ALL SELECT DISTINCT signal_id, 'services', target_ref FROM $relations WHERE target_kind IN ('servicebus', 'http')
      UNION ALL SELECT DISTINCT signal_id, 'processes', target_ref FROM $relations WHERE rel_type IN ('calls', 'invokes')) GROUP BY 1, 2""",
)
def backfilled_dependencies(t):
    return st.backfill_dependencies(t.view("relations", spread=True)).groupBy("bucket", "value").agg(F.count(F.lit(1)).alias("signals"))


@query(
    "trigger_identifiers",
    "SELECT 'orderId' AS identifier, count(*) AS signals FROM $signals WHERE path IS NOT NULL",
)
def trigger_identifiers(t):
    return st.trigger_identifiers(t.view("triggers"), t.view("signals")).groupBy("identifier").agg(F.count(F.lit(1)).alias("signals"))


# ---------------------------------------------------------------- scaffold
view(
    "interface_rows",
    """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY src, pos, k1, k2, kind, endpoint, method) AS rn FROM (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal_id, kind, endpoint, method ORDER BY src, pos, k1, k2) AS d FROM (
        SELECT signal_id, 0 AS src, 0 AS pos, 0 AS k1, 0 AS k2, type AS kind, path AS endpoint, method FROM $triggers
        UNION ALL SELECT signal_id, 1, pos, k1, k2, connector, url, method FROM $steps WHERE connector = 'http')) WHERE d = 1)) WHERE rn <= 12""",
)


@query("scaffold_interfaces", "SELECT signal_id, kind, endpoint, method FROM $interface_rows")
def scaffold_interfaces(t):
    return st.interfaces(t.view("steps", spread=True), t.view("triggers")).select("signal_id", "kind", "endpoint", "method")


view(
    "invocation_rows",
    """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY pos, k1, k2) AS rn FROM (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal_id, kind, target, operation ORDER BY pos, k1, k2) AS d FROM (
        SELECT signal_id, pos, k1, k2, 'Process' AS kind, coalesce(called_process, name) AS target, CAST(NULL AS STRING) AS operation FROM $steps WHERE connector = 'process'
        UNION ALL SELECT signal_id, pos, k1, k2, 'JDBC', datasource, sql_text FROM $steps WHERE connector IN ('jdbc', 'sql:query')
        UNION ALL SELECT signal_id, pos, k1, k2, 'JMS', destination, NULL FROM $steps WHERE connector = 'jms')) WHERE d = 1)) WHERE rn <= 20""",
)


@query("scaffold_invocations", "SELECT signal_id, kind, target, operation FROM $invocation_rows")
def scaffold_invocations(t):
    return st.invocations(t.view("steps", spread=True)).select("signal_id", "kind", "target", "operation")


view(
    "dependency_rows",
    """
    SELECT DISTINCT signal_id, bucket, value FROM (
      SELECT signal_id, CASE kind WHEN 'Process' THEN 'processes' WHEN 'JMS' THEN 'services' ELSE 'datastores' END AS bucket, target AS value FROM $invocation_rows
      UNION ALL SELECT signal_id, 'datastores', datasource FROM $data_access_rows UNION ALL SELECT signal_id, 'datastores', tbl FROM $data_access_rows
      UNION ALL SELECT signal_id, 'datastores', target_ref FROM $relations WHERE target_kind IN ('sql_table', 'cosmosdb')
      UNION ALL SELECT signal_id, 'services', target_ref FROM $relations WHERE target_kind IN ('servicebus', 'http')
      UNION ALL SELECT signal_id, 'processes', target_ref FROM $relations WHERE rel_type IN ('calls', 'invokes')) WHERE value IS NOT NULL AND value <> ''""",
)


def _deps(t):
    return st.dependencies(st.invocations(t.view("steps", spread=True)), _data(t), st.backfill_dependencies(t.view("relations", spread=True)))


@query("scaffold_dependencies", "SELECT * FROM $dependency_rows")
def scaffold_dependencies(t):
    return _deps(t)


view(
    "identifier_rows",
    """
    SELECT signal_id, identifier FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY identifier) AS rn FROM (
      SELECT DISTINCT signal_id, identifier FROM (
        SELECT signal_id, 'orderId' AS identifier FROM $signals WHERE path IS NOT NULL
        UNION ALL SELECT signal_id, 'OrderId' FROM $steps WHERE connector = 'mapper'
        UNION ALL SELECT signal_id, 'Part' || CAST(k2 % 5 AS STRING) || 'Key' FROM $steps WHERE connector = 'mapper'))) WHERE rn <= 12""",
)


def _identifiers(t):
    mapped = st.mapper_hints(t.view("steps", spread=True)).select("signal_id", F.explode("identifiers").alias("identifier"))
    return st.identifiers(st.trigger_identifiers(t.view("triggers"), t.view("signals")), mapped)


@query("scaffold_identifiers", "SELECT * FROM $identifier_rows")
def scaffold_identifiers(t):
    return _identifiers(t)


view(
    "error_rows",
    """
    WITH own AS (SELECT signal_id, 0 AS src, pos, k1, k2, name AS activity, CAST(NULL AS STRING) AS condition FROM $steps WHERE name LIKE '%error%'
        UNION ALL SELECT signal_id, 1, 0, 0, 0, src, condition FROM $branches),
    dflt AS (SELECT * FROM (SELECT signal_id, 2 AS src, pos, k1, k2, name AS activity, CASE connector WHEN 'http' THEN 'http_error_handling' WHEN 'jdbc' THEN 'db_error_handling' ELSE 'messaging_error_handling' END AS condition,
        row_number() OVER (PARTITION BY signal_id ORDER BY pos, k1, k2) AS rn FROM $steps WHERE connector IN ('http', 'jdbc', 'jms') AND signal_id NOT IN (SELECT signal_id FROM own)) WHERE rn <= 3),
    al AS (SELECT * FROM own UNION ALL SELECT signal_id, src, pos, k1, k2, activity, condition FROM dflt)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY src, pos, k1, k2) AS rn FROM (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal_id, activity, condition ORDER BY src, pos, k1, k2) AS d FROM al) WHERE d = 1)) WHERE rn <= 10""",
)


@query("scaffold_errors", "SELECT signal_id, activity, condition FROM $error_rows")
def scaffold_errors(t):
    return st.errors(t.view("steps", spread=True), _control(t)).select("signal_id", "activity", "condition")


view(
    "logging_rows",
    """
    SELECT signal_id, activity FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY pos, k1, k2) AS rn FROM (
      SELECT signal_id, name AS activity, min(pos) AS pos, min_by(k1, (pos, k1, k2)) AS k1, min_by(k2, (pos, k1, k2)) AS k2 FROM $steps WHERE connector = 'log' OR lower(name) LIKE '%log%' GROUP BY 1, 2)) WHERE rn <= 10""",
)


@query("scaffold_logging", "SELECT * FROM $logging_rows")
def scaffold_logging(t):
    return st.logging(t.view("steps", spread=True)).select("signal_id", "activity")


view(
    "start_rows",
    """
    WITH roots AS (SELECT DISTINCT signal_id, src AS node, 0 AS rule FROM $branches b WHERE NOT EXISTS (SELECT 1 FROM $branches c WHERE c.signal_id = b.signal_id AND c.dst = b.src)),
    r AS (SELECT * FROM roots UNION ALL SELECT signal_id, name, 1 FROM $triggers
      UNION ALL SELECT signal_id, name, 2 FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY pos, k1, k2) AS rn FROM $steps) WHERE rn = 1)
    SELECT signal_id, node, rule FROM (SELECT *, min(rule) OVER (PARTITION BY signal_id) AS best FROM r) WHERE rule = best""",
)


@query("start_nodes", "SELECT * FROM $start_rows")
def start_nodes(t):
    return st.start_nodes(t.view("steps", spread=True), t.view("triggers"), _control(t))


@query(
    "traceability",
    """
    WITH p AS (
      SELECT signal_id, 0 AS part, 1 AS rn, 'interface:' || coalesce(method, 'ANY') || ' ' || coalesce(endpoint, kind) AS t FROM $interface_rows WHERE rn = 1
      UNION ALL SELECT signal_id, 1, rn, 'step:' || name FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY pos, k1, k2) AS rn FROM $steps) WHERE rn <= 5
      UNION ALL SELECT signal_id, CASE bucket WHEN 'processes' THEN 2 WHEN 'datastores' THEN 3 ELSE 4 END, rn, CASE bucket WHEN 'processes' THEN 'invoke:' WHEN 'datastores' THEN 'datastore:' ELSE 'service:' END || value
        FROM (SELECT *, row_number() OVER (PARTITION BY signal_id, bucket ORDER BY value) AS rn FROM $dependency_rows) WHERE rn <= 3)
    SELECT signal_id, string_agg(t, ' > ' ORDER BY part, rn) AS trace FROM p GROUP BY 1""",
)
def traceability(t):
    return st.traces(t.view("steps"), t.view("triggers"), t.view("relations"))


# ---------------------------------------------------------------- transitions and graphs
@query(
    "unique_activities",
    """
    SELECT signal_id, CAST(idx AS BIGINT) AS idx, CASE WHEN idx = min(idx) OVER (PARTITION BY signal_id, name) THEN name ELSE name || '-' || CAST(idx AS STRING) END AS unique_name
    FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY pos, k1, k2) AS idx FROM $steps)""",
)
def unique_activities(t):
    steps = t.view("steps").select("signal_id", *views.STEP_ORDER, "name")
    return st.activities(steps).select("signal_id", "idx", "unique_name")


view(
    "transition_rows",
    """
    WITH s AS (SELECT *, row_number() OVER w AS idx, lag(name) OVER w AS prev FROM $steps WINDOW w AS (PARTITION BY signal_id ORDER BY pos, k1, k2)),
    b AS (SELECT s.signal_id, s.idx, s.name AS dst, s.branch AS label, unnest(CASE WHEN run_after IS NOT NULL THEN string_split(run_after, '|') ELSE [coalesce(prev, st.node)] END) AS src
      FROM s LEFT JOIN (SELECT signal_id, min(node) AS node FROM $start_rows GROUP BY 1) st ON s.signal_id = st.signal_id)
    SELECT DISTINCT signal_id, src, dst, label FROM b WHERE src IS NOT NULL AND (EXISTS (SELECT 1 FROM $steps q WHERE q.signal_id = b.signal_id AND q.name = b.src)
      OR EXISTS (SELECT 1 FROM $start_rows q WHERE q.signal_id = b.signal_id AND q.node = b.src))""",
)


@query("activity_transitions", "SELECT * FROM $transition_rows")
def activity_transitions(t):
    return st.step_transitions(t.view("steps"), t.view("triggers"), _control(t))


@query(
    "flow_graph",
    """
    SELECT kind, count(*) AS n, count(DISTINCT signal_id) AS signals FROM (
      SELECT DISTINCT signal_id, src, dst, kind FROM (
        SELECT tr.signal_id, tr.name AS src, f.name AS dst, 'trigger' AS kind FROM $triggers tr JOIN (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY pos, k1, k2) AS rn FROM $steps) f ON f.signal_id = tr.signal_id AND f.rn = 1
        UNION ALL SELECT signal_id, src, dst, CASE WHEN label IS NULL THEN 'sequence' ELSE 'branch' END FROM $transition_rows
        UNION ALL SELECT signal_id, source_name, 'External:' || target_ref, 'external' FROM $relations)) GROUP BY 1
    UNION ALL SELECT 'node:' || type, count(*), count(DISTINCT signal_id) FROM (
      SELECT signal_id, name AS node, 'step' AS type FROM $steps UNION SELECT signal_id, name, 'trigger' FROM $triggers
      UNION SELECT signal_id, 'External:' || target_ref, 'external' FROM $relations) GROUP BY 1""",
)
def flow_graph(t):
    found = st.flow_links(t.view("steps"), t.view("triggers"), _control(t), t.view("relations"))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("signal_id").alias("signals"))


# ---------------------------------------------------------------- artifacts
@query(
    "derived_rows",
    """
    SELECT kind, name, count(*) AS n FROM (
      SELECT 'db' AS kind, coalesce(tbl, datasource) AS name FROM $data_access_rows
      UNION ALL SELECT 'route', method || ' ' || path FROM $triggers WHERE type = 'http' AND path IS NOT NULL
      UNION ALL SELECT 'workflow', name FROM $signals WHERE signal_id NOT IN (SELECT signal_id FROM $triggers WHERE type = 'http' AND path IS NOT NULL)) GROUP BY 1, 2""",
)
def derived_rows(t):
    return st.derived_rows(t.view("signals"), t.view("triggers"), _data(t)).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "artifacts",
    """
    SELECT signal_id, CASE kind WHEN 'workflow' THEN 'workflow_dag' WHEN 'route' THEN 'api_route' ELSE 'datastore' END AS artifact_type, name, component, file AS repo_path,
      CASE WHEN kind = 'route' THEN concat_ws(' ', method, path) END AS endpoint, CASE WHEN kind = 'db' THEN name END AS datastore, CAST(CASE WHEN kind = 'db' THEN 0.7 ELSE 1.0 END AS DOUBLE) AS confidence
    FROM $signals""",
)
def artifacts(t):
    return st.artifacts(t.view("signals"))


@query(
    "experience_packs",
    """
    SELECT signal_id, screen, target FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY o) AS rn FROM (
      SELECT signal_id, name AS screen, url AS target, min((pos, k1, k2)) AS o FROM $steps WHERE url IS NOT NULL GROUP BY 1, 2, 3)) WHERE rn <= 20""",
)
def experience_packs(t):
    return st.experience_pack(t.view("steps", spread=True)).select("signal_id", "screen", "target")


@query(
    "compact_records",
    """
    SELECT signal_id, string_agg(name, ',' ORDER BY rn) FILTER (rn <= 5) AS name_list, string_agg(connector, ',' ORDER BY rn) FILTER (rn <= 3) AS connector_list
    FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY pos, k1, k2) AS rn FROM $steps) WHERE rn <= 5 GROUP BY 1""",
)
def compact_records(t):
    return st.compact_records(t.view("steps", spread=True), {"name": 5, "connector": 3})


@query(
    "conversation_transitions",
    """
    SELECT role, next_role, count(*) AS n FROM (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) WHERE next_role IS NOT NULL GROUP BY 1, 2""",
)
def conversation_transitions(t):
    from factloom.operators import ordered

    turns = ordered.previous_value(
        t.conversations.select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role", "next_role", following=True
    )
    return turns.filter("next_role IS NOT NULL").groupBy("role", "next_role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "conversation_roots",
    "SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)",
)
def conversation_roots(t):
    turns = t.conversations.select("conv_id", "turn")
    return turns.join(turns.select("conv_id", (F.col("turn") + 1).alias("turn")), ["conv_id", "turn"], "left_anti")
