"""Rollup, coverage, quality, budget and worklist queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import facts, marts, ordered, rollups, rules, signal_pass
from factloom.operators import steps as st
from factloom.plans import views  # noqa: F401  (registers the shared views)
from factloom.plans import fact_queries  # noqa: F401  (its check SQL is part of others)
from factloom.plans.registry import ORACLES, query, view
from factloom.plans.step_queries import _control, _deps, _identifiers
from factloom.session import scratch_dir
from factloom.sources import corpus


# ---------------------------------------------------------------- counts
@query("scan_stats", """
    SELECT CASE WHEN GROUPING(component) = 0 THEN 'component' WHEN GROUPING(kind) = 0 THEN 'kind' ELSE 'total' END AS facet, coalesce(component, kind, '') AS value, count(*) AS n
    FROM $signals GROUP BY GROUPING SETS ((component), (kind), ())""")
def scan_stats(t):
    s = t.view("signals").select("component", "kind")
    # both counts and the total in one pass over the signals
    g = s.groupingSets([["component"], ["kind"], []], "component", "kind").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 1, "component").when(F.col("g") == 2, "kind").otherwise("total")
    return g.select(facet.alias("facet"), F.coalesce("component", "kind", F.lit("")).alias("value"), "n")


@query("top_connectors", "SELECT lower(connector) AS connector, count(*) AS n FROM $steps GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_connectors(t):
    return t.view("steps", spread=True).groupBy(F.lower("connector").alias("connector")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "connector").limit(10)


@query("relationship_matrix", """
    SELECT target_kind, count(*) FILTER (operation = 'reads') AS reads, count(*) FILTER (operation = 'writes') AS writes, count(*) FILTER (operation = 'deletes') AS deletes, count(*) FILTER (operation = 'calls') AS calls FROM $relations GROUP BY 1""")
def relationship_matrix(t):
    p = t.view("relations", spread=True).groupBy("target_kind").pivot("operation", ["reads", "writes", "deletes", "calls"]).agg(F.count(F.lit(1)))
    return p.fillna(0)


@query("relationship_highlights", """
    WITH r AS (SELECT *, source_name || ' ' || operation || ' ' || target_ref || ' [' || target_kind || ']' AS s, row_number() OVER (PARTITION BY signal_id ORDER BY pos, k1, k2) AS rn FROM $relations)
    SELECT signal_id, count(*) FILTER (target_kind = 'http') AS http_calls, count(*) FILTER (target_kind IN ('sql_table', 'cosmosdb')) AS data_touchpoints, count(*) FILTER (target_kind = 'process') AS child_flows,
      string_agg(s, '; ' ORDER BY rn) FILTER (rn <= 3) AS samples FROM r GROUP BY 1""")
def relationship_highlights(t):
    r = t.view("relations", spread=True)
    kinds = r.groupBy("signal_id").agg(
        F.count_if(F.col("target_kind") == "http").alias("http_calls"), F.count_if(F.col("target_kind").isin("sql_table", "cosmosdb")).alias("data_touchpoints"),
        F.count_if(F.col("target_kind") == "process").alias("child_flows"),
    )
    s = F.concat("source_name", F.lit(" "), "operation", F.lit(" "), "target_ref", F.lit(" ["), "target_kind", F.lit("]"))
    top = ordered.top_per_key(r.select("signal_id", "pos", "k1", "k2", s.alias("s")), ["signal_id"], [F.col("pos"), F.col("k1"), F.col("k2")], 3, rank="rn")
    text = top.groupBy("signal_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "s"))), lambda x: x["s"]), "; ").alias("samples"))
    return kinds.join(text, "signal_id")


@query("component_insights", """
    WITH s AS (SELECT * FROM $signals WHERE kind = 'workflow'), p AS (SELECT component, count(*) AS steps, count(DISTINCT connector) AS connectors, string_agg(DISTINCT connector, ',' ORDER BY connector) AS connector_list
        FROM s JOIN $steps p ON p.signal_id = s.signal_id GROUP BY 1),
      g AS (SELECT component, string_agg(DISTINCT type, ',' ORDER BY type) AS trigger_types FROM s JOIN $triggers g ON g.signal_id = s.signal_id GROUP BY 1)
    SELECT c.component, flows, coalesce(steps, 0) AS steps, coalesce(connectors, 0) AS connectors, coalesce(connector_list, '') AS connector_list, coalesce(trigger_types, '') AS trigger_types
    FROM (SELECT component, count(*) AS flows FROM s GROUP BY 1) c LEFT JOIN p ON p.component = c.component LEFT JOIN g ON g.component = c.component""")
def component_insights(t):
    return rollups.component_insights(t.view("signals").filter("kind = 'workflow'"), t.view("steps", spread=True), t.view("triggers"))


@query("component_hints", "SELECT component, bucket, count(DISTINCT value) AS n_values, count(*) AS uses FROM $dependency_rows d JOIN $signals s ON s.signal_id = d.signal_id GROUP BY 1, 2")
def component_hints(t):
    d = _deps(t).join(t.view("signals").select("signal_id", "component"), "signal_id")
    per = d.groupBy("component", "bucket", "value").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("component", "bucket").agg(F.count(F.lit(1)).alias("n_values"), F.sum("k").alias("uses"))


@query("touchpoints", """
    SELECT component, class, count(*) AS n FROM (
      SELECT signal_id, CASE WHEN connector = 'http' THEN 'HTTP' WHEN connector = 'jms' THEN 'JMS' WHEN connector IN ('jdbc', 'sql:query') THEN 'JDBC' ELSE 'Other' END AS class FROM $steps
      UNION ALL SELECT signal_id, 'Trigger' FROM $triggers) x JOIN $signals s ON s.signal_id = x.signal_id GROUP BY 1, 2""")
def touchpoints(t):
    c = F.lower("connector")
    cls = F.when(c.rlike("http|rest|soap"), "HTTP").when(c.rlike("jms|queue|topic"), "JMS").when(c.rlike("jdbc|sql"), "JDBC").when(c.rlike("^file"), "File").otherwise("Other")
    rows = t.view("steps", spread=True).select("signal_id", cls.alias("class")).unionByName(t.view("triggers").select("signal_id", F.lit("Trigger").alias("class")))
    per = rows.groupBy("signal_id", "class").agg(F.count(F.lit(1)).alias("k"))
    return per.join(t.view("signals").select("signal_id", "component"), "signal_id").groupBy("component", "class").agg(F.sum("k").alias("n"))


view("source_paths", "SELECT path FROM $js_files UNION ALL SELECT path FROM $sql_files UNION ALL SELECT path FROM $spec_files")


@query("extractor_coverage", f"""
    WITH p AS (SELECT path, split_part(path, '/', 1) AS root, CASE WHEN path LIKE '%.sql' THEN 'ddl' WHEN path LIKE '%.json' THEN 'spec' ELSE 'routes' END AS extractor FROM $source_paths),
    r AS (SELECT extractor, root, 'files' AS what FROM p
      UNION ALL SELECT 'routes', split_part(path, '/', 1), 'signals' FROM ({ORACLES['source_routes']}) UNION ALL SELECT 'ddl', split_part(path, '/', 1), 'signals' FROM ({ORACLES['ddl_tables']})
      UNION ALL SELECT 'spec', 'specs', 'signals' FROM part CROSS JOIN range(3) WHERE p_partkey % 50 <> 7 UNION ALL SELECT 'spec', split_part(path, '/', 1), 'errors' FROM ({ORACLES['parse_failures']}))
    SELECT extractor, root, count(*) FILTER (what = 'files') AS files, count(*) FILTER (what = 'signals') AS signals, count(*) FILTER (what = 'errors') AS errors FROM r GROUP BY ROLLUP (extractor, root)""")
def extractor_coverage(t):
    routed = corpus.route_files(t.view("source_paths"), [("routes", "(?i)[.](js|ts)$"), ("ddl", "(?i)[.]sql$"), ("spec", "(?i)[.]json$")])
    of = lambda df, name: df.select("path", F.lit(name).alias("extractor"))
    specs = t.view("spec_files", spread=True)
    emitted = of(facts.source_routes(t.view("js_files", spread=True)), "routes").unionByName(of(facts.ddl_blocks(t.view("sql_files", spread=True)), "ddl"))
    emitted = emitted.unionByName(of(facts.spec_operations(specs)[1], "spec"))
    return rollups.extractor_coverage(routed, emitted, of(facts.parse_failures(specs), "spec"))


@query("source_inventory", "SELECT source, lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT sha256(text)) AS texts FROM documents GROUP BY ROLLUP (source, lang)")
def source_inventory(t):
    d = t.spread("documents").select("source", "lang", "n_chars", F.sha2("text", 256).alias("sha"))
    return d.rollup("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.countDistinct("sha").alias("texts"))


@query("document_hierarchy", """
    SELECT family, component, count(*) AS processes, count(*) FILTER (kind IN ('workflow', 'route')) AS docworthy, min(created) AS first_created FROM $signals GROUP BY ROLLUP (family, component)""")
def document_hierarchy(t):
    return t.view("signals").rollup("family", "component").agg(
        F.count(F.lit(1)).alias("processes"), F.count_if(F.lower("kind").isin("workflow", "route")).alias("docworthy"), F.min("created").alias("first_created")
    )


@query("playbooks", "SELECT module, count(*) FILTER (kind = 'workflow') AS deploy, count(*) FILTER (kind = 'route') AS rollback, count(*) FILTER (kind = 'db') AS recovery FROM $signals GROUP BY 1")
def playbooks(t):
    book = tx.lookup(F.col("kind"), {"workflow": "deploy", "route": "rollback", "db": "recovery"})
    return t.view("signals").withColumn("book", book).groupBy("module").pivot("book", ["deploy", "rollback", "recovery"]).agg(F.count(F.lit(1)))


@query("persona_lists", """
    SELECT component, string_agg(name, ',' ORDER BY rn) AS personas, min(total) AS total FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY first_seen, name) AS rn, count(*) OVER (PARTITION BY component) AS total FROM (
      SELECT component, module || '-user' AS name, min(signal_id) AS first_seen FROM $signals GROUP BY 1, 2)) WHERE rn <= 4 GROUP BY 1""")
def persona_lists(t):
    p = t.view("signals").groupBy("component", F.concat("module", F.lit("-user")).alias("name")).agg(F.min("signal_id").alias("first_seen"))
    total = p.groupBy("component").agg(F.count(F.lit(1)).alias("total"))
    top = ordered.top_per_key(p, ["component"], [F.col("first_seen"), F.col("name")], 4, rank="rn")
    text = top.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]), ",").alias("personas"))
    return text.join(total, "component")


# How many rows of each section go into a group's context.
CONTEXT_LIMITS = {"workflow": 6, "route": 4, "db": 3}


@query("group_context", """
    SELECT component, kind, signal_id FROM (SELECT *, row_number() OVER (PARTITION BY component, kind ORDER BY signal_id) AS rn FROM $signals) WHERE rn <= CASE kind WHEN 'workflow' THEN 6 WHEN 'route' THEN 4 ELSE 3 END""")
def group_context(t):
    top = ordered.top_per_key(t.view("signals").select("component", "kind", "signal_id"), ["component", "kind"], [F.col("signal_id")], max(CONTEXT_LIMITS.values()), rank="rn")
    return top.filter(F.col("rn") <= tx.lookup(F.col("kind"), CONTEXT_LIMITS)).select("component", "kind", "signal_id")


def _sections(t):
    """Entries of a record's sections, in the order of steps."""
    at = F.struct(F.lit(0).alias("src"), *[F.col(c).cast("bigint").alias(c) for c in st.ORDER])
    ranked = lambda df, name, item: df.select(F.col("signal_id").alias("id"), F.lit(name).alias("section"), at.alias("at"), item.alias("item"))
    steps, rel = t.view("steps", spread=True), t.view("relations", spread=True)
    iface = st.interfaces(steps, t.view("triggers"))
    own = F.struct(F.col("src"), *[F.col(c).cast("bigint").alias(c) for c in st.ORDER])
    iface = iface.select(F.col("signal_id").alias("id"), F.lit("interfaces").alias("section"), own.alias("at"), F.concat_ws(" ", "kind", "method", "endpoint").alias("item"))
    out = ranked(steps, "steps", F.concat_ws(" ", "name", "connector")).unionByName(ranked(rel, "relationships", F.concat_ws(" ", "operation", "target_ref"))).unionByName(iface)
    out = out.unionByName(ranked(st.invocations(steps), "invocations", F.concat_ws(" ", "kind", "target"))).unionByName(ranked(st.logging(steps), "logging", F.col("activity")))
    return out.unionByName(ranked(steps.filter("sql_text IS NOT NULL"), "evidence", F.concat_ws(":", "datasource", "name")))


# limits small enough to be reached by these tables
_SMALL = {"steps": 4, "relationships": 3, "interfaces": 2, "invocations": 2, "logging": 1, "evidence": 2, "evidence_index": 9}

view("section_rows", """
    SELECT signal_id, 'steps' AS section, 0 AS src, pos, k1, k2, name || ' ' || connector AS item FROM $steps
    UNION ALL SELECT signal_id, 'relationships', 0, pos, k1, k2, operation || ' ' || target_ref FROM $relations
    UNION ALL SELECT signal_id, 'interfaces', src, pos, k1, k2, concat_ws(' ', kind, method, endpoint) FROM $interface_rows
    UNION ALL SELECT signal_id, 'invocations', 0, pos, k1, k2, concat_ws(' ', kind, target) FROM $invocation_rows
    UNION ALL SELECT signal_id, 'logging', 0, min(pos), min_by(k1, (pos, k1, k2)), min_by(k2, (pos, k1, k2)), name FROM $steps WHERE connector = 'log' OR lower(name) LIKE '%log%' GROUP BY signal_id, name
    UNION ALL SELECT signal_id, 'evidence', 0, pos, k1, k2, datasource || ':' || name FROM $steps WHERE sql_text IS NOT NULL""")
_CONTEXT = """
    SELECT component AS "group", signal_id AS id, section, rn, item FROM (SELECT r.*, c.component, row_number() OVER (PARTITION BY r.signal_id, section ORDER BY src, pos, k1, k2, item) AS rn FROM $section_rows r
      JOIN (SELECT component, signal_id, row_number() OVER (PARTITION BY component ORDER BY signal_id) AS no FROM $signals) c ON c.signal_id = r.signal_id WHERE no <= 6)
    WHERE rn <= CASE section WHEN 'steps' THEN 4 WHEN 'relationships' THEN 3 WHEN 'logging' THEN 1 ELSE 2 END"""


def _context(t):
    records = t.view("signals").select(F.col("component").alias("group"), F.col("signal_id").alias("id"))
    return rollups.compact_context(records, _sections(t), _SMALL)


@query("rollup_context", _CONTEXT)
def rollup_context(t):
    return _context(t)


@query("rollup_evidence", f"""
    SELECT "group", item FROM (SELECT "group", item, row_number() OVER (PARTITION BY "group" ORDER BY min((id, rn)), item) AS no FROM ({_CONTEXT}) WHERE section = 'evidence' GROUP BY 1, 2) WHERE no <= 9""")
def rollup_evidence(t):
    return rollups.evidence_index(_context(t), _SMALL)


@query("io_summary", """
    WITH v AS (SELECT signal_id, 'inputs' AS part, pos, k1, k2, unnest(string_split(inputs_keys, ',')) AS value, generate_subscripts(string_split(inputs_keys, ','), 1) AS sub FROM $steps WHERE inputs_keys IS NOT NULL
      UNION ALL SELECT signal_id, 'outputs', pos, k1, k2, coalesce(destination, called_process), 1 FROM $steps WHERE coalesce(destination, called_process) IS NOT NULL)
    SELECT signal_id, part, rn, value FROM (SELECT *, row_number() OVER (PARTITION BY signal_id, part ORDER BY pos, k1, k2, sub, value) AS rn FROM v) WHERE rn <= 10
    UNION ALL SELECT signal_id, 'identifiers', row_number() OVER (PARTITION BY signal_id ORDER BY identifier), identifier FROM $identifier_rows""")
def io_summary(t):
    s = t.view("steps", spread=True)
    at = lambda sub: F.struct(*st.ORDER, sub.alias("sub")).alias("at")
    ins = s.select("signal_id", *st.ORDER, F.posexplode(F.split("inputs_keys", ",")).alias("sub", "value")).select("signal_id", F.lit("inputs").alias("part"), at(F.col("sub")), "value")
    outs = s.select("signal_id", F.lit("outputs").alias("part"), at(F.lit(0)), F.coalesce("destination", "called_process").alias("value"))
    return rollups.io_summary(ins.unionByName(outs), _identifiers(t))


_LISTS = {"personas": "module || '-user'", "entities": "family", "ui_components": "path", "code_entities": "method", "diagrams": "CASE WHEN kind = 'workflow' THEN file END"}


@query("component_lists", "SELECT component, list, row_number() OVER (PARTITION BY component, list ORDER BY seen, name) AS rn, name FROM (SELECT component, list, name, min(seen) AS seen FROM ("
       + " UNION ALL ".join(f"SELECT component, '{k}' AS list, {v} AS name, signal_id AS seen FROM $signals" for k, v in _LISTS.items()) + ") WHERE name IS NOT NULL GROUP BY 1, 2, 3)")
def component_lists(t):
    lists = F.array(*[F.struct(F.lit(k).alias("list"), F.expr(v).alias("name")) for k, v in _LISTS.items()])
    rows = t.view("signals").select("component", F.col("signal_id").alias("at"), F.explode(lists).alias("l")).select("component", "l.list", "l.name", "at")
    return rollups.first_names(rows)


@query("component_profile", """
    SELECT component, count(*) AS signals, count(DISTINCT kind) AS kinds, count(DISTINCT family) AS families, count(method) AS with_method, min(file) AS first_file, max(created) AS last_created FROM $signals GROUP BY 1""")
def component_profile(t):
    s = t.view("signals").groupBy("component", "kind", "family").agg(F.count(F.lit(1)).alias("n"), F.count("method").alias("m"), F.min("file").alias("f"), F.max("created").alias("c"))
    return s.groupBy("component").agg(
        F.sum("n").alias("signals"), F.countDistinct("kind").alias("kinds"), F.countDistinct("family").alias("families"), F.sum("m").alias("with_method"),
        F.min("f").alias("first_file"), F.max("c").alias("last_created"),
    )


@query("narratives_with_fallback", """
    WITH a AS (SELECT component, count(*) AS n, min(name) AS first_line FROM $signals WHERE kind = 'route' GROUP BY 1), r AS (SELECT component, count(*) AS n, min(name) AS first_line FROM $signals WHERE kind = 'db' GROUP BY 1)
    SELECT coalesce(a.component, r.component) AS component, coalesce(a.n, r.n) AS n, coalesce(a.first_line, r.first_line) AS first_line, a.component IS NOT NULL AS from_artifacts FROM a FULL JOIN r ON a.component = r.component""")
def narratives_with_fallback(t):
    s = t.view("signals")
    agg = lambda df, p: df.groupBy("component").agg(F.count(F.lit(1)).alias(p + "n"), F.min("name").alias(p + "first"))
    j = agg(s.filter("kind = 'route'"), "a_").join(agg(s.filter("kind = 'db'"), "r_"), "component", "full_outer")
    return j.select("component", F.coalesce("a_n", "r_n").alias("n"), F.coalesce("a_first", "r_first").alias("first_line"), F.col("a_n").isNotNull().alias("from_artifacts"))


# ---------------------------------------------------------------- coverage and quality
view("presence", """
    SELECT s.signal_id, s.kind, s.component, s.name, coalesce(d.ds, 0) AS datastores, coalesce(d.pr, 0) AS processes, coalesce(d.sv, 0) AS services, coalesce(i.n, 0) AS identifiers, coalesce(l.n, 0) AS logging, coalesce(e.n, 0) AS errors
    FROM $signals s LEFT JOIN (SELECT signal_id, count(*) FILTER (bucket = 'datastores') AS ds, count(*) FILTER (bucket = 'processes') AS pr, count(*) FILTER (bucket = 'services') AS sv FROM $dependency_rows GROUP BY 1) d ON d.signal_id = s.signal_id
    LEFT JOIN (SELECT signal_id, count(*) AS n FROM $identifier_rows GROUP BY 1) i ON i.signal_id = s.signal_id LEFT JOIN (SELECT signal_id, count(*) AS n FROM $logging_rows GROUP BY 1) l ON l.signal_id = s.signal_id
    LEFT JOIN (SELECT signal_id, count(*) AS n FROM $error_rows GROUP BY 1) e ON e.signal_id = s.signal_id""")


def _facts(t):
    return t.kept("facts", lambda: signal_pass.facts(
        t.view("signals"), t.view("steps", spread=True), t.view("relations", spread=True), t.view("triggers"), _control(t)))


def _presence(t):
    return signal_pass.presence(_facts(t))


_GAP = "(identifiers = 0 OR datastores = 0 OR processes = 0 OR services + processes = 0 OR logging = 0 OR errors = 0)"


@query("scaffold_coverage", f"""
    WITH g AS (SELECT kind, signal_id, row_number() OVER (PARTITION BY kind ORDER BY signal_id) AS rn FROM $presence WHERE {_GAP})
    SELECT p.*, g.samples FROM (SELECT kind, count(*) AS tracked, count(*) FILTER (identifiers > 0) AS with_identifiers, count(*) FILTER (datastores > 0) AS with_datastores, count(*) FILTER (processes > 0) AS with_processes,
      count(*) FILTER (services + processes > 0) AS with_calls, count(*) FILTER (logging > 0) AS with_logging, count(*) FILTER (errors > 0) AS with_errors FROM $presence GROUP BY 1) p
    LEFT JOIN (SELECT kind, string_agg(CAST(signal_id AS STRING), ',' ORDER BY signal_id) FILTER (rn <= 5) AS samples FROM g GROUP BY 1) g ON g.kind = p.kind""")
def scaffold_coverage(t):
    return marts.scaffold_coverage(_presence(t), "kind")


@query("coverage_gate", f"""
    SELECT count(*) AS gaps, count(*) FILTER (identifiers = 0 AND datastores = 0 AND processes = 0 AND services = 0 AND logging = 0 AND errors = 0) AS missing_scaffold,
      count(*) FILTER (identifiers > 0 AND datastores > 0 AND processes > 0) AS with_io, count(*) FILTER (services + processes > 0) AS with_calls, count(*) FILTER (logging > 0) AS with_logging, count(*) FILTER (errors > 0) AS with_errors,
      CASE WHEN count(*) FILTER (identifiers = 0 AND datastores = 0 AND processes = 0 AND services = 0 AND logging = 0 AND errors = 0) > 5 THEN 'missing_scaffold>5' ELSE '' END AS failures FROM $presence WHERE {_GAP}""")
def coverage_gate(t):
    return marts.coverage_gate(_presence(t))


@query("gap_counts", f"SELECT component, count(*) AS gaps FROM $presence WHERE {_GAP} GROUP BY 1")
def gap_counts(t):
    return marts.missing_fields(_presence(t)).filter("size(missing) > 0").groupBy("component").agg(F.count(F.lit(1)).alias("gaps")).orderBy(F.desc("gaps"))


view("quality", """
    SELECT *, CASE WHEN score >= 15 THEN 1 WHEN score >= 8 THEN 2 ELSE 4 END AS priority, CASE WHEN score >= 15 THEN 'high' WHEN score >= 8 THEN 'medium' ELSE 'low' END AS band FROM (
      SELECT p.*, steps, relationships, interfaces, invocations, identifiers * 3 + datastores * 2 + processes * 2 + steps + least(interfaces, 3) + least(relationships, 3) + CASE WHEN triggers > 0 THEN 2 ELSE 0 END + least(invocations, 3) + least(services, 3)
        + CASE WHEN errors > 0 THEN 1 ELSE 0 END + CASE WHEN logging > 0 THEN 1 ELSE 0 END AS score FROM (
        SELECT p.*, coalesce(a.n, 0) AS steps, coalesce(b.n, 0) AS relationships, coalesce(c.n, 0) AS interfaces, coalesce(d.n, 0) AS invocations, coalesce(e.n, 0) AS triggers FROM $presence p
        LEFT JOIN (SELECT signal_id, count(*) AS n FROM $steps GROUP BY 1) a ON a.signal_id = p.signal_id LEFT JOIN (SELECT signal_id, count(*) AS n FROM $relations GROUP BY 1) b ON b.signal_id = p.signal_id
        LEFT JOIN (SELECT signal_id, count(*) AS n FROM $interface_rows GROUP BY 1) c ON c.signal_id = p.signal_id LEFT JOIN (SELECT signal_id, count(*) AS n FROM $invocation_rows GROUP BY 1) d ON d.signal_id = p.signal_id
        LEFT JOIN (SELECT signal_id, count(*) AS n FROM $triggers GROUP BY 1) e ON e.signal_id = p.signal_id) p)""")


def _quality(t):
    return marts.process_quality(_presence(t))


@query("process_quality", "SELECT signal_id, CAST(score AS BIGINT) AS score, score >= 5 OR steps > 0 OR relationships > 0 AS has_details, CAST(priority AS INT) AS priority, band FROM $quality")
def process_quality(t):
    return _quality(t).select("signal_id", "score", "has_details", "priority", "band")


_SHARED = """
    SELECT signal_id, count(*) AS n FROM (SELECT d.signal_id FROM $dependency_rows d JOIN (SELECT value FROM $dependency_rows WHERE bucket = 'datastores' GROUP BY 1 HAVING count(*) > 1) v ON v.value = d.value WHERE bucket = 'datastores') GROUP BY 1"""


# a family's groups of one market segment stand for clusters
@query("worklist", f"""
    WITH q AS (SELECT q.*, s.family, s.module, q.score + interfaces + invocations + processes + coalesce(h.n, 0) AS r
               FROM $quality q JOIN $signals s ON s.signal_id = q.signal_id LEFT JOIN ({_SHARED}) h ON h.signal_id = q.signal_id),
    d AS (SELECT component, family FROM q GROUP BY ALL HAVING bool_or(score >= 5 OR steps > 0 OR relationships > 0))
    SELECT title, category, CAST(priority AS INT) AS priority, CAST(score AS BIGINT) AS score, band FROM (
      SELECT name || ' – Process Brief' AS title, 'process' AS category, CASE WHEN r >= 15 THEN 1 WHEN r >= 8 THEN 2 ELSE 4 END AS priority, r AS score,
             CASE WHEN r >= 15 THEN 'high' WHEN r >= 8 THEN 'medium' ELSE 'low' END AS band FROM q
        WHERE identifiers > 0 AND (invocations > 0 OR datastores + processes + services > 0) AND (errors > 0 OR logging > 0)
      UNION ALL SELECT DISTINCT component || ' – Component Brief', 'component', 3, NULL, NULL FROM d
      UNION ALL SELECT DISTINCT family || ' – Family Brief', 'family', 2, NULL, NULL FROM d
      UNION ALL SELECT DISTINCT array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(lower(family) || ' ' || module, ' ')], ' ') || ' – Constellation Brief', 'constellation', 2, NULL, NULL FROM q
      UNION ALL SELECT 'Anti-Pattern Register', 'quality', 3, NULL, NULL UNION ALL SELECT 'Repository Comprehensive Narrative', 'repo_final', 5, NULL, NULL)""")
def worklist(t):
    q = _quality(t)
    clusters = q.select(F.concat_ws("-", F.replace(F.lower("family"), F.lit(" "), F.lit("-")), "module").alias("slug")).distinct()
    return marts.worklist(q, signal_pass.shared_stores(_facts(t)), clusters, rules.enough_evidence())


# transitions of steps whose first key ends in 3 lead to a step that is none
view("checked_transitions", "SELECT signal_id, src, CASE WHEN k1 % 10 = 3 THEN dst || '?' ELSE dst END AS dst FROM $branches")


@query("step_coverage", """
    SELECT s.signal_id, round(avg(CASE WHEN connector = 'shared_sharepoint' THEN 0.0 ELSE 1.0 END), 3) AS role_ratio,
      round(avg(CASE WHEN coalesce(sql_text, destination, url, called_process) IS NULL THEN 0.0 ELSE 1.0 END), 3) AS evidence_ratio,
      round(avg(CASE WHEN connector IN ('log', 'shared_sharepoint') THEN 0.0 ELSE 1.0 END), 3) AS known_ratio, CASE WHEN min(b.signal_id) IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS transition_integrity
    FROM $steps s LEFT JOIN (SELECT DISTINCT signal_id FROM $checked_transitions b WHERE NOT EXISTS (SELECT 1 FROM $steps q WHERE q.signal_id = b.signal_id AND q.name = b.dst)
      OR NOT EXISTS (SELECT 1 FROM $steps q WHERE q.signal_id = b.signal_id AND q.name = b.src)) b ON b.signal_id = s.signal_id GROUP BY 1""")
def step_coverage(t):
    return rollups.step_coverage(t.view("steps", spread=True), t.view("checked_transitions"))


@query("label_coverage", """
    SELECT source, count(*) AS docs, count(l.doc_id) AS labelled, round(count(l.doc_id) / count(*), 3) AS ratio, count(l.doc_id) / count(*) >= 0.4 AS passes, count(*) FILTER (quality = 1) AS good FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def label_coverage(t):
    j = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality").withColumn("hit", F.lit(1)), "doc_id", "left")
    g = j.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count("hit").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))
    ratio = F.col("labelled") / F.col("docs")
    return g.select("source", "docs", "labelled", F.round(ratio, 3).alias("ratio"), (ratio >= 0.4).alias("passes"), "good")


@query("claim_scores", """
    SELECT conv_id, count(*) AS claims, round(avg(CASE WHEN length(text) > 150 THEN 1.0 ELSE 0.0 END), 3) AS score, round(avg(CASE WHEN length(text) > 150 THEN 1.0 ELSE 0.0 END), 3) >= 0.75 AS approved FROM conversations GROUP BY 1""")
def claim_scores(t):
    # a claim counts as backed when it cites evidence; here a long turn does
    c = t.conversations.select("conv_id", F.when(F.length("text") > 150, F.array(F.lit("e"))).otherwise(F.array()).alias("evidence_ids"))
    score = F.round(F.avg(F.when(F.size("evidence_ids") > 0, 1.0).otherwise(0.0)), 3)
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("claims"), score.alias("score")).withColumn("approved", F.col("score") >= 0.75)


# Prices in USD per million tokens.
PRICE_IN, PRICE_OUT = "0.25", "2.00"


@query("usage_cost", """
    SELECT event_type, CAST(sum(tin) AS BIGINT) AS tokens_in, CAST(sum(tout) AS BIGINT) AS tokens_out, CAST(round(CAST(sum(tin) AS DOUBLE) / 1e6 * 0.25 + CAST(sum(tout) AS DOUBLE) / 1e6 * 2.0, 6) AS DOUBLE) AS cost FROM (
      SELECT event_type, CAST(floor(value * 100) AS BIGINT) AS tin, CAST(floor(value * 10) AS BIGINT) AS tout FROM events) GROUP BY 1""")
def usage_cost(t):
    e = t.events.select("event_type", F.floor(F.col("value") * 100).cast("bigint").alias("tin"), F.floor(F.col("value") * 10).cast("bigint").alias("tout"))
    million = F.lit(1_000_000).cast("decimal(12,0)")
    price = lambda c, p: F.col(c).cast("decimal(20,0)") * F.lit(p).cast("decimal(6,2)") / million
    g = e.groupBy("event_type").agg(F.sum("tin").alias("tokens_in"), F.sum("tout").alias("tokens_out"))
    return g.select("event_type", "tokens_in", "tokens_out", F.round(price("tokens_in", PRICE_IN) + price("tokens_out", PRICE_OUT), 6).cast("double").alias("cost"))


# ---------------------------------------------------------------- budgets and lists
@query("budget_pack", """
    WITH c AS (SELECT doc_id, source, length(text) AS len, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS cum FROM documents)
    SELECT doc_id, source, CAST(cum AS BIGINT) AS cum, CAST(CASE WHEN cum <= 20000 THEN len WHEN cum - len < 20000 THEN 20000 - (cum - len) ELSE 0 END AS BIGINT) AS taken, cum > 20000 AND cum - len < 20000 AS truncated FROM c""")
def budget_pack(t):
    d = t.documents.select("doc_id", "source", F.length("text").alias("len"))
    return marts.apply_budget(d, "source", "doc_id", F.col("len"), 20000).select("doc_id", "source", "cum", "taken", "truncated")


@query("item_batches", "SELECT batch, count(*) AS n, min(p_partkey) AS first_part FROM (SELECT p_partkey, p_brand || '-' || CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 16 AS STRING) AS batch FROM part) GROUP BY 1")
def item_batches(t):
    n = ordered.row_index(t.part.select("p_partkey", "p_brand"), ["p_brand"], ["p_partkey"], "n")
    b = n.withColumn("batch", F.concat("p_brand", F.lit("-"), F.expr("(n - 1) div 16").cast("string")))
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_part"))


@query("limited_lists", """
    SELECT nation, string_agg(s_name, ',' ORDER BY s_name) FILTER (rn <= 2) AS shown, CASE WHEN min(total) > 2 THEN '... (+' || CAST(min(total) - 2 AS STRING) || ' more)' END AS more FROM (
      SELECT s_nationkey AS nation, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS rn, count(*) OVER (PARTITION BY s_nationkey) AS total FROM supplier) GROUP BY 1""")
def limited_lists(t):
    return marts.limit_items(t.supplier.select(F.col("s_nationkey").alias("nation"), "s_name"), "nation", "s_name", k=2)


@query("coverage_csv", "SELECT kind, count(*) AS n, count(DISTINCT component) AS components FROM $signals WHERE method IS NULL GROUP BY 1")
def coverage_csv(t):
    """Gap report written as CSV, partitioned records as Parquet, and both read back."""
    base = f"{scratch_dir(t.spark)}/coverage-{uuid.uuid4().hex}"
    gaps = t.view("signals").filter("method IS NULL").select("signal_id", "kind", "component", "name")
    corpus.write_records(gaps, base + "/csv", "csv", by=None)
    corpus.write_records(gaps, base + "/records", "parquet", by="component")
    csv = t.spark.read.option("header", "true").schema("signal_id bigint, kind string, component string, name string").csv(base + "/csv")
    recs = t.spark.read.schema("signal_id bigint, kind string, name string, component string").parquet(base + "/records")
    same = csv.join(recs.select("signal_id"), "signal_id", "left_semi")
    return same.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("component").alias("components"))
