"""Fact extraction queries.  The check SQL states the facts each file must yield."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import facts
from factloom.plans import views  # noqa: F401  (registers the shared views)
from factloom.plans.registry import query, view


def _count(df, *cols):
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- links
@query(
    "page_links_topk",
    """
    SELECT target, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages)
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def page_links_topk(t):
    links = t.spread("pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("target"))
    return links.groupBy("target").agg(F.count(F.lit(1)).alias("pages")).orderBy(F.desc("pages"), "target").limit(10)


# ---------------------------------------------------------------- text rules
@query(
    "source_routes",
    """
    SELECT path, CAST(line AS BIGINT) AS line, method, route, params FROM (
      SELECT path, 5 AS line, 'GET' AS method, '/parts/:partId/' || CAST(p_size AS STRING) AS route, 'partId' AS params FROM $js_files JOIN part USING (p_partkey)
      UNION ALL SELECT path, 6, 'PUT', '/stock/:sku/' || CAST(p_size % 4 AS STRING), 'sku' FROM $js_files JOIN part USING (p_partkey)
      UNION ALL SELECT path, 11, 'POST', '/brands/:brandKey', 'brandKey' FROM $js_files)""",
)
def source_routes(t):
    r = facts.source_routes(t.view("js_files", spread=True))
    return r.withColumn("params", F.array_join("params", ","))


@query(
    "source_dependencies",
    """
    SELECT rule_id, prop, value, count(*) AS n FROM (
      SELECT 'collection' AS rule_id, 'datastore' AS prop, 'parts_' || CAST(p_size % 7 AS STRING) AS value FROM part
      UNION ALL SELECT 'model', 'datastore', 'Brand' || CAST(p_partkey % 25 AS STRING) FROM part
      UNION ALL SELECT 'client_call', 'service', 'https://billing' || CAST(p_partkey % 5 AS STRING) || '.internal/api' FROM part
      UNION ALL SELECT 'client_call', 'service', 'https://prices' || CAST(p_size % 2 AS STRING) || '.internal/list' FROM part
      UNION ALL SELECT 'fetch_call', 'service', 'https://stock.internal/v' || CAST(p_size % 3 AS STRING) || '/items' FROM part) GROUP BY 1, 2, 3""",
)
def source_dependencies(t):
    return _count(facts.rule_facts(t.view("js_files", spread=True).select("path", "text"), facts.TEXT_RULES), "rule_id", "prop", "value")


@query(
    "import_integrations",
    """
    SELECT language, library, integration_kind, count(*) AS n FROM (
      SELECT CASE WHEN p_partkey % 3 = 0 THEN 'ts' ELSE 'js' END AS language, 'axios' AS library, 'http_client' AS integration_kind FROM part
      UNION ALL SELECT CASE WHEN p_partkey % 3 = 0 THEN 'ts' ELSE 'js' END, 'pg' || CAST(p_size % 2 AS STRING), 'postgres' FROM part
      UNION ALL SELECT 'cs', 'System.Net.Http', 'http_client' FROM supplier
      UNION ALL SELECT 'cs', 'Microsoft.PowerPlatform.Dataverse.Client', 'power_platform' FROM supplier) GROUP BY 1, 2, 3""",
)
def import_integrations(t):
    files = t.view("js_files", spread=True).select("path", "text").unionByName(t.view("cs_files", spread=True))
    return _count(facts.import_integrations(files), "language", "library", "integration_kind").orderBy(F.desc("n"))


@query(
    "script_object_facts",
    """
    SELECT rule_id, value, count(*) AS n, CAST(min(line) AS BIGINT) AS first_line FROM (
      SELECT 'event' AS rule_id, 'open' AS value, 2 AS line FROM customer UNION ALL SELECT 'event', 'close', 11 FROM customer
      UNION ALL SELECT 'function', 'of_load' || CAST(c_custkey % 10 AS STRING), 3 FROM customer
      UNION ALL SELECT 'datawindow_op', 'dw_main.retrieve', 4 FROM customer
      UNION ALL SELECT 'datawindow_op', 'dw_detail' || CAST(c_custkey % 3 AS STRING) || '.update', 5 FROM customer
      UNION ALL SELECT 'call', 'dw_main.retrieve', 4 FROM customer UNION ALL SELECT 'call', 'dw_detail' || CAST(c_custkey % 3 AS STRING) || '.update', 5 FROM customer
      UNION ALL SELECT 'call', 'lnv_service.of_call' || CAST(c_custkey % 7 AS STRING), 6 FROM customer UNION ALL SELECT 'call', 'lo_http.sendrequest', 9 FROM customer
      UNION ALL SELECT 'http', 'sendrequest(', 9 FROM customer) GROUP BY 1, 2""",
)
def script_object_facts(t):
    found = facts.first_hits(facts.rule_facts(t.view("script_files", spread=True), facts.SCRIPT_RULES), facts.FIRST_HIT_RULES)
    return found.groupBy("rule_id", "value").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


view(
    "dw_files",
    """
    SELECT 'pb/d_cust' || CAST(c_custkey AS STRING) || '.srd' AS path, c_custkey,
      'datawindow' || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN 'column only' ELSE 'SELECT acct_number FROM ledger' || CAST(c_nationkey AS STRING) || ';' END AS text,
      '<ribbon><button Clicked="ue_save' || CAST(c_custkey % 4 AS STRING) || '"/><combo Selected="ue_pick"/><label name="x"/></ribbon>' AS ribbon
    FROM {customer}""",
)


@query(
    "datawindow_workflows",
    """
    SELECT 'sql' AS fact, 'SELECT ledger' || CAST(c_nationkey AS STRING) AS value, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 2
    UNION ALL SELECT 'ribbon', 'ue_save' || CAST(c_custkey % 4 AS STRING), count(*) FROM customer GROUP BY 2
    UNION ALL SELECT 'ribbon', 'ue_pick', count(*) FROM customer""",
)
def datawindow_workflows(t):
    dw = t.view("dw_files", spread=True)
    sql = facts.sql_statements(dw.select("path", "text")).select(F.lit("sql").alias("fact"), F.concat_ws(" ", "verb", "table").alias("value"))
    ribbon = facts.xml_attributes(dw.select("path", F.col("ribbon").alias("text")), {"ribbon": "//*[@Clicked or @Selected]/@*[name()='Clicked' or name()='Selected']"})
    return _count(sql.unionByName(ribbon.select("fact", "value")), "fact", "value")


@query(
    "ui_components",
    """
    SELECT rule_id, value, count(*) AS n FROM (
      SELECT 'page_route' AS rule_id, '/customers/' || CAST(c_nationkey AS STRING) AS value FROM customer WHERE c_custkey % 3 = 2
      UNION ALL SELECT 'route_path', '/orders/' || CAST(c_nationkey % 5 AS STRING) FROM customer WHERE c_custkey % 3 = 0
      UNION ALL SELECT 'router_link', '/home/' || CAST(c_custkey % 6 AS STRING) FROM customer WHERE c_custkey % 3 = 1
      UNION ALL SELECT 'function_component', 'CustomerManager' || CAST(c_custkey % 4 AS STRING) || 'Page' FROM customer WHERE c_custkey % 3 = 0
      UNION ALL SELECT 'const_component', 'SalesAgentCard' FROM customer WHERE c_custkey % 3 = 0
      UNION ALL SELECT 'selector', 'app-cust-' || CAST(c_custkey % 8 AS STRING) FROM customer WHERE c_custkey % 3 = 1
      UNION ALL SELECT 'template', './cust.html' FROM customer WHERE c_custkey % 3 = 1) GROUP BY 1, 2""",
)
def ui_components(t):
    return _count(facts.rule_facts(t.view("ui_files", spread=True), facts.UI_RULES), "rule_id", "value")


@query(
    "business_entities",
    """
    SELECT source, name, count(*) AS n FROM (
      SELECT 'process_diagram' AS source, 'Sales Desk ' || CAST(s_suppkey % 3 AS STRING) AS name FROM supplier
      UNION ALL SELECT 'authorize_attribute', unnest(['Admin', 'Sales Manager' || CAST(s_suppkey % 6 AS STRING), 'Ops']) FROM supplier
      UNION ALL SELECT 'component_name', unnest(['Customer Manager' || CAST(c_custkey % 4 AS STRING), 'Sales Agent', 'Customer Owner View' || CAST(c_custkey % 3 AS STRING)]) FROM customer) GROUP BY 1, 2""",
)
def business_entities(t):
    files = t.view("xml_files", spread=True).unionByName(t.view("cs_files", spread=True)).unionByName(t.view("ui_files", spread=True))
    return _count(facts.business_entities(files), "source", "name")


@query(
    "code_entities",
    """
    SELECT prop, value, count(*) AS n FROM (
      SELECT 'class' AS prop, 'Supplier' || CAST(s_suppkey AS STRING) || 'Controller' AS value FROM supplier
      UNION ALL SELECT 'method', 'Run' FROM supplier
      UNION ALL SELECT 'class', 'CustomerOwnerView' || CAST(c_custkey % 3 AS STRING) FROM customer WHERE c_custkey % 3 < 2
      UNION ALL SELECT 'function', unnest(['CustomerManager' || CAST(c_custkey % 4 AS STRING) || 'Page', 'helper']) FROM customer WHERE c_custkey % 3 < 2) GROUP BY 1, 2""",
)
def code_entities(t):
    return _count(facts.rule_facts(t.view("cs_files", spread=True).unionByName(t.view("ui_files", spread=True)), facts.CODE_RULES), "prop", "value")


# ---------------------------------------------------------------- SQL
@query(
    "ddl_tables",
    """
    SELECT path, 'dbo.Brand' || CAST(p_partkey % 25 AS STRING) AS tbl, CAST(2 AS BIGINT) AS line, CAST(2 AS BIGINT) AS columns, 'BrandId int NOT NULL,label varchar(' || CAST(p_size AS STRING) || ')' AS definition
    FROM (SELECT *, 'db/migrations/m' || CAST(p_partkey AS STRING) || '.sql' AS path FROM part)
    UNION ALL SELECT 'db/migrations/m' || CAST(p_partkey AS STRING) || '.sql', 'dbo.Part' || CAST(p_partkey AS STRING), 7, 3, 'PartId int NOT NULL,BrandId int,size_code varchar(10)' FROM part""",
)
def ddl_tables(t):
    blocks = facts.ddl_blocks(t.view("sql_files", spread=True))
    cols = facts.ddl_columns(blocks)
    per = cols.groupBy("path", "table").agg(
        F.count(F.lit(1)).alias("columns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" ", "column", "definition").alias("d")))), lambda x: x["d"]), ",").alias("definition"),
    )
    return blocks.join(per, ["path", "table"]).select("path", F.col("table").alias("tbl"), "line", "columns", "definition")


@query(
    "ddl_foreign_keys",
    """
    WITH k AS (SELECT 'dbo.Part' || CAST(p_partkey AS STRING) AS tbl, 'dbo.Brand' || CAST(p_partkey % 25 AS STRING) AS refs, 'BrandId,size_code' AS cols, 'BrandId,code' AS ref_cols FROM part
      UNION ALL SELECT 'dbo.Part' || CAST(p_partkey AS STRING), 'dbo.Stock' || CAST(p_partkey % 11 AS STRING), 'PartId', '' FROM part)
    SELECT tbl, refs, cols, ref_cols, tbl || '_fk_' || substr(sha1(tbl || '-' || refs), 1, 8) AS relation_id, 'depends_on' AS operation FROM k""",
)
def ddl_foreign_keys(t):
    k = facts.ddl_foreign_keys(facts.ddl_blocks(t.view("sql_files", spread=True)))
    return k.select(
        F.col("table").alias("tbl"), F.col("references").alias("refs"), F.array_join("columns", ",").alias("cols"),
        F.array_join("ref_columns", ",").alias("ref_cols"), "relation_id", "operation",
    )


@query(
    "embedded_sql",
    """
    SELECT verb, tbl, crud, ids, count(*) AS n FROM (
      SELECT 'UPDATE' AS verb, 'customers' AS tbl, 'write' AS crud, 'al_id,customerid' AS ids FROM customer
      UNION ALL SELECT 'INSERT', 'audit_' || CAST(c_nationkey AS STRING), 'write', 'customerkey' FROM customer) GROUP BY 1, 2, 3, 4""",
)
def embedded_sql(t):
    # the call of update() above the SQL lines opens a statement that ends with the first ';'
    s = facts.sql_statements(t.view("script_files", spread=True).select("path", "text"))
    return _count(s.select("verb", F.col("table").alias("tbl"), "crud", F.array_join("identifiers", ",").alias("ids")), "verb", "tbl", "crud", "ids")


# ---------------------------------------------------------------- JSON documents
@query(
    "spec_operations",
    """
    WITH ok AS (SELECT * FROM part WHERE p_partkey % 50 <> 7)
    SELECT api, method, route, summary, count(*) AS n FROM (
      SELECT 'Part API ' || CAST(p_partkey % 40 AS STRING) AS api, 'GET' AS method, '/api/v' || CAST(p_size % 8 AS STRING) AS route, 'list' AS summary FROM ok
      UNION ALL SELECT 'Part API ' || CAST(p_partkey % 40 AS STRING), 'POST', '/api/v' || CAST(p_size % 8 AS STRING), 'add' FROM ok
      UNION ALL SELECT 'Part API ' || CAST(p_partkey % 40 AS STRING), 'DELETE', '/parts/' || p_brand, 'drop' FROM ok
      UNION ALL SELECT 'Part API ' || CAST(p_partkey % 40 AS STRING), 'api', '1.' || CAST(p_size % 4 AS STRING), '3.0.1' FROM ok) GROUP BY 1, 2, 3, 4""",
)
def spec_operations(t):
    apis, ops = facts.spec_operations(t.view("spec_files", spread=True))
    rows = ops.select("api", "method", "route", "summary").unionByName(
        apis.select(F.col("name").alias("api"), F.lit("api").alias("method"), F.col("version").alias("route"), F.col("spec_version").alias("summary"))
    )
    return _count(rows, "api", "method", "route", "summary")


@query("parse_failures", "SELECT 'specs/p' || CAST(p_partkey AS STRING) || '.json' AS path, 'doc' AS kind, CAST(0.1 AS DOUBLE) AS parsed FROM part WHERE p_partkey % 50 = 7")
def parse_failures(t):
    return facts.parse_failures(t.view("spec_files", spread=True))


_ACTIONS = """
  SELECT 'flows/f' || CAST(o_orderkey AS STRING) || '.json' AS path, o_custkey, a.* FROM orders, (VALUES
    (NULL, NULL, 0, 'Init', 'Http'), (NULL, NULL, 0, 'Check', 'If'), ('Check', 'If.True', 1, 'Save', 'ApiConnection'), ('Check', 'If.True', 1, 'Loop', 'Foreach'),
    ('Loop', 'Foreach.Body', 2, 'Notify', 'Http'), ('Check', 'If.False', 1, 'Stop', 'Terminate'), (NULL, NULL, 0, 'Pick', 'Switch'),
    ('Pick', 'Switch.a', 1, 'CaseA', 'Compose'), ('Pick', 'Switch.Default', 1, 'Other', 'Compose')) a(parent, branch, depth, name, type)"""


@query(
    "workflow_actions",
    f"""
    SELECT path, parent, branch, CAST(depth AS INT) AS depth, name, type,
      CASE name WHEN 'Init' THEN 'GET' WHEN 'Save' THEN 'POST' WHEN 'Notify' THEN 'POST' END AS method,
      CASE name WHEN 'Init' THEN 'http' WHEN 'Notify' THEN 'http' WHEN 'Save' THEN 'shared_sql' ELSE type END AS connector,
      CASE name WHEN 'Check' THEN 'Init' WHEN 'Pick' THEN 'Check' ELSE '' END AS run_after,
      CASE WHEN name = 'Notify' THEN 'https://hub.internal/workflows/notify' || CAST(o_custkey % 4 AS STRING) || '/triggers/manual/run' END AS child_flow
    FROM ({_ACTIONS})""",
)
def workflow_actions(t):
    a = facts.flatten_actions(facts.workflow_definitions(t.view("flow_files", spread=True)))
    return a.withColumn("run_after", F.coalesce(F.array_join("run_after", ","), F.lit(""))).drop("uri")


@query(
    "workflow_relationships",
    f"""
    WITH a AS ({_ACTIONS}),
    own AS (SELECT o_custkey, 'action' AS source_type, name AS source, CASE name WHEN 'Init' THEN 'http' WHEN 'Notify' THEN 'workflow' WHEN 'Save' THEN 'sql' ELSE lower(type) END AS kind FROM a)
    SELECT source_type, source, kind, operation, count(*) AS n FROM (
      SELECT source_type, source, kind, CASE kind WHEN 'http' THEN 'calls' WHEN 'workflow' THEN 'invokes' WHEN 'sql' THEN 'reads' ELSE 'calls' END AS operation FROM own
      UNION ALL SELECT 'trigger', tr, 'action', 'calls' FROM a, (VALUES ('manual'), ('tick')) v(tr) WHERE name NOT IN ('Check', 'Pick')) GROUP BY 1, 2, 3, 4""",
)
def workflow_relationships(t):
    defs = facts.workflow_definitions(t.view("flow_files", spread=True))
    return _count(facts.workflow_relationships(defs), "source_type", "source", "kind", "operation")


@query(
    "workflow_triggers",
    "SELECT 'manual' AS name, 'Request' AS type, CAST(NULL AS STRING) AS schedule, count(*) AS n FROM orders UNION ALL SELECT 'tick', 'Recurrence', 'Day/' || CAST(o_orderkey % 7 AS STRING), count(*) FROM orders GROUP BY 3",
)
def workflow_triggers(t):
    return _count(facts.workflow_triggers(facts.workflow_definitions(t.view("flow_files", spread=True))), "name", "type", "schedule")


@query(
    "function_bindings",
    """
    SELECT type, kind, ref, operation, count(*) AS n FROM (
      SELECT CASE event_id % 3 WHEN 0 THEN 'httptrigger' WHEN 1 THEN 'queuetrigger' ELSE 'timertrigger' END AS type, CASE event_id % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'queue' ELSE 'timer' END AS kind,
        CASE event_id % 3 WHEN 0 THEN event_type || '/' || chr(123) || 'userId' || chr(125) WHEN 1 THEN 'q' || CAST(user_id % 5 AS STRING) ELSE '0 * * * *' END AS ref,
        CASE event_id % 3 WHEN 2 THEN 'reads' ELSE 'receives' END AS operation FROM events
      UNION ALL SELECT CASE user_id % 3 WHEN 0 THEN 'cosmosdb' WHEN 1 THEN 'servicebus' ELSE 'blob' END, CASE user_id % 3 WHEN 0 THEN 'cosmosdb' WHEN 1 THEN 'servicebus' ELSE 'storage' END,
        CASE user_id % 3 WHEN 0 THEN 'c' || CAST(user_id % 6 AS STRING) WHEN 1 THEN 'out' || CAST(user_id % 4 AS STRING) ELSE 'box/' || CAST(user_id % 3 AS STRING) END,
        CASE user_id % 3 WHEN 1 THEN 'publishes' ELSE 'writes' END FROM events) GROUP BY 1, 2, 3, 4""",
)
def function_bindings(t):
    return _count(facts.function_bindings(t.view("event_files", spread=True)), "type", "kind", "ref", "operation")


@query(
    "attribute_bindings",
    "SELECT 'QueueTrigger' AS attribute, 'queue' AS kind, 'orders-' || CAST(s_suppkey % 9 AS STRING) AS ref, count(*) AS n FROM supplier GROUP BY 3 UNION ALL SELECT 'CosmosDB', 'cosmosdb', 'stock', count(*) FROM supplier",
)
def attribute_bindings(t):
    return _count(facts.attribute_bindings(t.view("cs_files", spread=True)), "attribute", "kind", "ref")


@query(
    "serverless_events",
    """
    SELECT event, kind, ref, method, count(*) AS n FROM (
      SELECT 'http' AS event, 'http' AS kind, '/o/' || chr(123) || 'orderId' || chr(125) AS ref, 'POST' AS method FROM customer
      UNION ALL SELECT 'sqs', 'queue', 'orders' || CAST(c_custkey % 6 AS STRING), NULL FROM customer
      UNION ALL SELECT 'schedule', 'timer', 'rate(' || CAST(c_nationkey + 1 AS STRING) || ' hours)', NULL FROM customer
      UNION ALL SELECT 'stream', 'datastore', 'table' || CAST(c_custkey % 4 AS STRING), NULL FROM customer) GROUP BY 1, 2, 3, 4""",
)
def serverless_events(t):
    return _count(facts.serverless_events(t.view("serverless_files", spread=True)), "event", "kind", "ref", "method")


@query(
    "pipeline_facts",
    """
    SELECT fact, subject, value, count(*) AS n FROM (
      SELECT f.* FROM customer, (VALUES ('trigger', 'push', NULL), ('trigger', 'schedule', NULL), ('step', 'compile', 'run'), ('step', 'actions/upload-artifact', 'actions/upload-artifact'),
        ('step', 'deploy:1', 'bash'), ('depends_on', 'deploy', 'build')) f(fact, subject, value)
      UNION ALL SELECT 'schedule', 'schedule', '0 ' || CAST(c_nationkey AS STRING) || ' * * *' FROM customer
      UNION ALL SELECT 'deploys_to', 'deploy', CASE WHEN c_custkey % 2 = 0 THEN 'prod' ELSE 'staging' END FROM customer
      UNION ALL SELECT 'publishes', 'build', 'app' || CAST(c_custkey % 4 AS STRING) FROM customer) GROUP BY 1, 2, 3""",
)
def pipeline_facts(t):
    return _count(facts.pipeline_facts(t.view("manifest_files", spread=True).select("path", "text")), "fact", "subject", "value")


@query(
    "cluster_resources",
    """
    SELECT kind, role, ref, count(*) AS n FROM (
      SELECT 'Secret' AS kind, 'datastore' AS role, 'cust' || CAST(c_custkey AS STRING) AS ref FROM customer WHERE c_custkey % 3 = 1
      UNION ALL SELECT 'Service', 'service', 'cust' || CAST(c_custkey AS STRING) FROM customer WHERE c_custkey % 3 = 0
      UNION ALL SELECT 'Deployment', 'service', unnest(['reg.internal/web:' || CAST(c_nationkey AS STRING), 'reg.internal/side:1']) FROM customer WHERE c_custkey % 3 = 2
      UNION ALL SELECT 'Deployment', 'datastore', unnest(['sec' || CAST(c_custkey % 4 AS STRING), 'cfg' || CAST(c_custkey % 5 AS STRING), 'vol' || CAST(c_custkey % 7 AS STRING), 'sec9']) FROM customer WHERE c_custkey % 3 = 2) GROUP BY 1, 2, 3""",
)
def cluster_resources(t):
    return _count(facts.cluster_resources(t.view("manifest_files", spread=True).select("path", "text")), "kind", "role", "ref")


@query(
    "package_dependencies",
    """
    SELECT package, version, section, count(*) AS n FROM (
      SELECT 'react' AS package, '18.' || CAST(s_suppkey % 3 AS STRING) AS version, 'dependencies' AS section FROM supplier
      UNION ALL SELECT 'express', '4.1', 'dependencies' FROM supplier
      UNION ALL SELECT 'jest', '29.' || CAST(s_suppkey % 5 AS STRING), 'devDependencies' FROM supplier
      UNION ALL SELECT 'typescript', '5.1', 'devDependencies' FROM supplier WHERE s_suppkey % 4 <> 0) GROUP BY 1, 2, 3""",
)
def package_dependencies(t):
    return _count(facts.package_dependencies(t.view("package_files", spread=True)), "package", "version", "section")


@query(
    "package_facts",
    "SELECT 'pkg' || CAST(s_suppkey AS STRING) AS name, 'react' AS frameworks, 'build' AS scripts, 'es' || CAST(2015 + s_suppkey % 6 AS STRING) AS target FROM supplier WHERE s_suppkey % 4 <> 0",
)
def package_facts(t):
    return facts.package_facts(t.view("package_files", spread=True)).drop("path")


@query(
    "event_props",
    "SELECT 'k' AS prop, CAST(json_extract(props, '$.k') AS BIGINT) // 10 AS bin, event_type, count(*) AS n FROM events GROUP BY 2, 3",
)
def event_props(t):
    e = t.events.select("event_type", F.explode(F.expr("try_variant_get(try_parse_json(props), '$', 'map<string,bigint>')")).alias("prop", "v"))
    return _count(e.withColumn("bin", F.expr("v div 10")), "prop", "bin", "event_type")


# ---------------------------------------------------------------- property files and XML
@query(
    "property_maps",
    """
    SELECT key, value, count(*) AS n FROM (
      SELECT 'db.url' AS key, 'jdbc:sql://db' || CAST(c_nationkey % 5 AS STRING) || '.internal:' || CAST(1000 + c_nationkey AS STRING) || '/main' AS value FROM customer
      UNION ALL SELECT 'http.host', 'svc' || CAST(c_nationkey AS STRING) || '.internal' FROM customer
      UNION ALL SELECT 'http.port', CAST(8000 + c_nationkey AS STRING) FROM customer
      UNION ALL SELECT 'jms.queue', 'orders.' || CAST(c_custkey % 12 AS STRING) FROM customer
      UNION ALL SELECT 'endpoint', 'https://api' || CAST(c_custkey % 6 AS STRING) || '.internal/v1/orders?x=' || CAST(c_nationkey AS STRING) FROM customer) GROUP BY 1, 2""",
)
def property_maps(t):
    return _count(facts.properties(t.view("property_files", spread=True)), "key", "value")


@query(
    "resource_bindings",
    """
    SELECT 'conf/c' || CAST(c_custkey AS STRING) || '.properties' AS path, 'endpoint=https://api' || CAST(c_custkey % 6 AS STRING) || '.internal/v1/orders?x=' || CAST(c_nationkey AS STRING) AS endpoint,
      CAST(NULL AS STRING) AS datastore, 'orders.' || CAST(c_custkey % 12 AS STRING) AS queue FROM customer""",
)
def resource_bindings(t):
    return facts.resource_bindings(t.view("property_files", spread=True))


@query("config_endpoints", "SELECT 'https://api' || CAST(c_custkey % 6 AS STRING) || '.internal/v1/orders?x=' || CAST(c_nationkey AS STRING) AS endpoint, count(*) AS files FROM customer GROUP BY 1")
def config_endpoints(t):
    return facts.config_endpoints(t.view("property_files", spread=True)).groupBy("endpoint").agg(F.count(F.lit(1)).alias("files"))


_XML = {
    "activity": "//activity/@name", "sql": "//activity/@sql", "partner": "//partnerLink/@name", "lane": "//lane/@name",
    "datastore": "//dataStoreReference/@name", "call": "//callActivity/@calledElement", "operation": "//portType/operation/@name",
    "element": "//element/@name", "complex_type": "//complexType/@name", "enum": "//simpleType//enumeration/@value", "doc": "//documentation/text()",
}


@query(
    "xml_documents",
    """
    SELECT fact, value, count(*) AS n FROM (
      SELECT fact, unnest(vals) AS value FROM (
      SELECT 'activity' AS fact, ['Receive' || CAST(s_suppkey % 5 AS STRING), 'Query' || CAST(s_suppkey % 7 AS STRING), 'Reply'] AS vals FROM supplier
      UNION ALL SELECT 'sql', ['SELECT * FROM stock' || CAST(s_suppkey % 6 AS STRING)] FROM supplier
      UNION ALL SELECT 'partner', ['pl' || CAST(s_suppkey % 4 AS STRING)] FROM supplier UNION ALL SELECT 'lane', ['Sales Desk ' || CAST(s_suppkey % 3 AS STRING)] FROM supplier
      UNION ALL SELECT 'datastore', ['Ledger ' || CAST(s_suppkey % 2 AS STRING)] FROM supplier UNION ALL SELECT 'call', ['billing.Invoice' || CAST(s_suppkey % 9 AS STRING)] FROM supplier
      UNION ALL SELECT 'operation', ['getStock' || CAST(s_suppkey % 4 AS STRING), 'putStock'] FROM supplier UNION ALL SELECT 'element', ['stockId', 'qty'] FROM supplier
      UNION ALL SELECT 'complex_type', ['Stock' || CAST(s_suppkey % 4 AS STRING)] FROM supplier UNION ALL SELECT 'enum', ['low', 'high'] FROM supplier
      UNION ALL SELECT 'doc', ['Stock level of supplier ' || CAST(s_suppkey AS STRING)] FROM supplier)) GROUP BY 1, 2""",
)
def xml_documents(t):
    from factloom.functions import text as tx

    rows = facts.xml_attributes(t.view("xml_files", spread=True), _XML)
    clean = tx.strip_markup(F.col("value"))
    return _count(rows.select("fact", F.when(F.col("fact") == "datastore", F.regexp_replace(clean, " $", "")).otherwise(clean).alias("value")), "fact", "value")


@query(
    "process_xml",
    """
    SELECT 'bw/' || CAST(s_nationkey AS STRING) || '/proc' || CAST(s_suppkey AS STRING) || '.bwp' AS path, 'sales.Supplier' || CAST(s_suppkey AS STRING) AS start, CAST(15 AS BIGINT) AS activities, CAST(2 AS BIGINT) AS transitions,
      'http,jdbc' AS connectors FROM supplier""",
)
def process_xml(t):
    acts, moves = facts.process_activities(t.view("xml_files", spread=True))
    a = acts.groupBy("path").agg(F.count(F.lit(1)).alias("activities"), F.array_join(F.array_sort(F.collect_set("connector")), ",").alias("connectors"))
    m = moves.groupBy("path").agg(F.count(F.lit(1)).alias("transitions"))
    return facts.start_activities(acts, moves).join(a, "path").join(m, "path")


@query(
    "flow_xml",
    """
    SELECT fact, value, count(*) AS n FROM (
      SELECT 'listener' AS fact, '/stock/' || CAST(s_suppkey % 5 AS STRING) AS value FROM supplier UNION ALL SELECT 'scheduler', '0 ' || CAST(s_suppkey % 9 AS STRING) || ' * * *' FROM supplier
      UNION ALL SELECT 'request', 'https://svc' || CAST(s_suppkey % 6 AS STRING) || '.internal/items' FROM supplier UNION ALL SELECT 'db_write', 'stock' || CAST(s_suppkey % 3 AS STRING) FROM supplier
      UNION ALL SELECT 'db_read', 'dbo.parts' || CAST(s_suppkey % 4 AS STRING) FROM supplier UNION ALL SELECT 'flow_ref', 'audit' || CAST(s_suppkey % 2 AS STRING) FROM supplier) GROUP BY 1, 2""",
)
def flow_xml(t):
    return _count(facts.flow_xml_facts(t.view("mule_files", spread=True)), "fact", "value")


@query(
    "manifest_headers",
    """
    SELECT prop, value, count(*) AS n FROM (SELECT 'Bundle-SymbolicName' AS prop, 'bundle' || CAST(s_suppkey % 8 AS STRING) AS value FROM supplier UNION ALL SELECT 'Bundle-Activator', 'com.x.Act' FROM supplier) GROUP BY 1, 2""",
)
def manifest_headers(t):
    files = t.supplier.select(
        F.concat(F.lit("jar/"), F.col("s_suppkey").cast("string"), F.lit("/MANIFEST.MF")).alias("path"),
        F.concat(F.lit("Manifest-Version: 1.0\nBundle-SymbolicName: bundle"), (F.col("s_suppkey") % 8).cast("string"), F.lit("\nBundle-Activator:  com.x.Act \n")).alias("text"),
    )
    return _count(facts.rule_facts(files, facts.MANIFEST_RULES), "prop", "value")


# ---------------------------------------------------------------- user extractors and plain files
def mail_lines(path: str, text: str):
    """Example of a user's extractor: mail addresses with their line."""
    import re

    for no, line in enumerate(text.split("\n"), 1):
        for hit in re.findall(r"[a-zA-Z0-9.]+@[a-z0-9.]+[a-z]", line):
            yield no, "contact", "mail", hit


@query("plugin_facts", r"""
    SELECT 'mail' AS extractor, doc_id AS doc, CAST(line_no AS BIGINT) AS line, unnest(regexp_extract_all(line, '[a-zA-Z0-9.]+@[a-z0-9.]+[a-z]')) AS value
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
    UNION ALL SELECT 'ip', doc_id, CAST(line_no AS BIGINT), unnest(regexp_extract_all(line, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'))
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)""")
def plugin_facts(t):
    from pyspark import cloudpickle
    import sys

    from factloom.operators import plugins

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    known = [
        plugins.Extractor("mail", "[.]txt$", fn=mail_lines),
        plugins.Extractor("ip", "[.]txt$", rules=(facts.Rule("ip", "contact", "ip", r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})", 1, (".txt",)),)),
        plugins.Extractor("unused", ".", fn=mail_lines),
    ]
    files = t.spread("documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    rows = plugins.run_extractors(files, plugins.select_extractors(known, exclude=["unused"]))
    return rows.select("extractor", F.split_part("path", F.lit("."), F.lit(1)).cast("bigint").alias("doc"), "line", "value")


@query("tree_scan", "SELECT 'source=' || source AS folder, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size_bytes FROM documents GROUP BY 1")
def tree_scan(t):
    """Texts written out as files by source, then scanned as a tree of files."""
    import uuid

    from factloom.session import scratch_dir
    from factloom.sources import corpus

    root = f"{scratch_dir(t.spark)}/tree-{uuid.uuid4().hex}"
    t.documents.select("source", "text").write.partitionBy("source").text(root)
    tree = corpus.read_tree(t.spark, root, "*.txt")
    return tree.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder")).agg(F.sum("size_bytes").alias("size_bytes"))


@query("document_titles", """
    SELECT kind, count(*) AS n, min(title) AS first_title FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'readme' WHEN 1 THEN 'decision' ELSE 'document' END AS kind,
      CASE doc_id % 5 WHEN 0 THEN 'README' WHEN 1 THEN 'ADR ' || CAST(doc_id AS STRING) ELSE 'note' || CAST(doc_id AS STRING) END AS title FROM documents) GROUP BY 1""")
def document_titles(t):
    from factloom.sources import corpus

    k = F.col("doc_id") % 5
    path = F.concat(F.lit("docs/"), F.when(k == 0, F.lit("README.md")).when(k == 1, F.concat(F.lit("adr/"), F.col("doc_id").cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("note"), F.col("doc_id").cast("string"), F.lit(".md"))))
    d = corpus.document_titles(t.documents.select(path.alias("path")))
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("first_title"))
