"""Scans, scalar functions and chunking over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions import vocab
from factloom.operators import ordered
from factloom.operators.retrieval import chunk_lines
from factloom.plans import views  # noqa: F401  (registers the shared views)
from factloom.plans.registry import query, view
from factloom.sources import corpus

# ---------------------------------------------------------------- secrets and markup
query(
    "doc_redaction",
    r"""
    WITH r AS (SELECT doc_id, source, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
        '(?i)\b(api[_-]?key|secret|token|password|passwd)\s*[:=]\s*([^\s"'']{8,})', '\1: ***REDACTED***', 'g'),
        'AKIA[0-9A-Z]{16}', '***REDACTED***', 'g'),
        '(?i)((?:aws)?_?secret(?:_?access)?_?key)\s*[:=]\s*([A-Za-z0-9/+=]{8,})', '\1: ***REDACTED***', 'g'),
        '([?&]sig=)[^&\s]+', '\1***REDACTED***', 'g'),
        'eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', '***REDACTED***', 'g') AS red
      FROM (SELECT doc_id, source, replace(text, 'token = "', 'token = ') || chr(10) || 'cfg?sig=' || CAST(doc_id AS STRING) || '&a=1' AS text FROM documents))
    SELECT doc_id, md5(red) AS red_md5, CAST((length(red) - length(replace(red, '***REDACTED***', ''))) / 14 AS BIGINT) AS hits FROM r""",
)(
    lambda t: t.spread("documents").select(
        "doc_id",
        # the quote after "token =" is dropped and one signed link added, so that patterns have hits
        tx.redact(
            F.concat(
                F.replace("text", F.lit('token = "'), F.lit("token = ")),
                F.lit("\ncfg?sig="), F.col("doc_id").cast("string"), F.lit("&a=1"),
            )
        ).alias("red"),
    ).select(
        "doc_id",
        F.md5("red").alias("red_md5"),
        ((F.length("red") - F.length(F.replace("red", F.lit(tx.MASK), F.lit("")))) / 14).cast("bigint").alias("hits"),
    )
)


@query(
    "page_title_facts",
    r"""
    SELECT page_id, kind, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'),
      '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '<[^>]*>', ' ', 'g'), '[\s\x0B]+', ' ', 'g')) AS title FROM (
      SELECT page_id, 'title' AS kind, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS raw FROM pages
      UNION ALL SELECT page_id, 'heading', regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's') FROM pages)
    WHERE raw <> ''""",
)
def page_title_facts(t):
    found = F.array(
        F.struct(F.lit("title").alias("kind"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("raw")),
        F.struct(F.lit("heading").alias("kind"), F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1).alias("raw")),
    )
    rows = t.spread("pages").select("page_id", F.explode(found).alias("f")).filter("f.raw <> ''")
    return rows.select("page_id", "f.kind", tx.strip_markup(F.col("f.raw")).alias("title"))


# ---------------------------------------------------------------- names and paths
view(
    "doc_paths",
    """
    SELECT doc_id, source, lang, n_chars, text,
      CASE doc_id % 7 WHEN 0 THEN 'src/' WHEN 1 THEN 'services/' WHEN 2 THEN 'infra/' WHEN 3 THEN 'tests/' WHEN 4 THEN 'node_modules/' WHEN 5 THEN 'config/' ELSE '' END
        || source || '/' || lang || '/' || CASE WHEN doc_id % 31 = 0 THEN '.gitignore' WHEN doc_id % 29 = 0 THEN 'Thumbs.db' ELSE 'd' || CAST(doc_id AS STRING) ||
        CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.TS' WHEN 2 THEN '.json' WHEN 3 THEN '.md' WHEN 4 THEN '.cs' ELSE '.tf' END END AS path
    FROM {documents}""",
)

_GENERIC = ", ".join(f"'{p}'" for p in vocab.GENERIC_PATH_PARTS)


@query(
    "component_names",
    rf"""
    SELECT component, count(*) AS files FROM (
      SELECT coalesce(nullif(regexp_replace(regexp_replace(trim(coalesce(nullif(hint, ''), list_filter(string_split(path, '/'),
        lambda p: lower(p) NOT IN ({_GENERIC}) AND NOT contains(p, '.'))[1], 'corpus')), '[^\p{{L}}\p{{N}}_-]', '_', 'g'), '^[_-]+|[_-]+$', '', 'g'), ''), 'component') AS component
      FROM (SELECT path, CASE doc_id % 10 WHEN 0 THEN ' Billing Service ' WHEN 1 THEN '--' ELSE '' END AS hint FROM $doc_paths)) GROUP BY 1""",
)
def component_names(t):
    hint = F.when(F.col("doc_id") % 10 == 0, " Billing Service ").when(F.col("doc_id") % 10 == 1, "--").otherwise("")
    return (
        t.view("doc_paths", spread=True)
        .select(tx.derive_component(F.col("path"), F.lit("corpus"), hint=hint).alias("component"))
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("files"))
    )


@query(
    "name_slugs",
    r"""
    SELECT p_partkey, trim(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '-') AS dash_slug,
      trim(regexp_replace(trim(label), '[^A-Za-z0-9_.-]+', '_', 'g'), '_') AS file_slug,
      lower(nullif(regexp_extract(dotted, '^([A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*)\.[^.]+$', 1), '')) AS family,
      array_to_string(list_filter(string_split(replace(dotted, '.', '/'), '/'), lambda p: p <> '')[1:2], '/') AS bucket,
      lower(list_filter(string_split(replace(dotted, '.', '/'), '/'), lambda p: p <> '')[-2]) AS path_family
    FROM (SELECT p_partkey, p_name || ' ' || p_brand || '!' AS label, p_type || '.' || CASE WHEN p_size > 25 THEN 'Big.' ELSE '' END || 'P' || CAST(p_partkey AS STRING) AS dotted FROM part)""",
)
def name_slugs(t):
    p = t.part.select(
        "p_partkey",
        F.concat("p_name", F.lit(" "), "p_brand", F.lit("!")).alias("label"),
        F.concat("p_type", F.lit("."), F.when(F.col("p_size") > 25, "Big.").otherwise(""), F.lit("P"), F.col("p_partkey").cast("string")).alias("dotted"),
    )
    path = F.replace("dotted", F.lit("."), F.lit("/"))
    return p.select(
        "p_partkey",
        tx.slug(F.col("label")).alias("dash_slug"),
        tx.file_slug(F.col("label")).alias("file_slug"),
        tx.infer_family(F.col("dotted")).alias("family"),
        tx.repo_bucket(path).alias("bucket"),
        tx.family_from_path(path).alias("path_family"),
    )


@query(
    "file_inventory",
    """
    SELECT path, kind, language, size_bytes, sha, component_hint FROM (
      SELECT path, octet_length(encode(text)) AS size_bytes, sha256(text) AS sha, string_split(path, '/')[1] AS component_hint,
        CASE WHEN path LIKE 'tests/%' THEN 'test' WHEN path LIKE 'infra/%' OR path LIKE '%.tf' THEN 'infra' WHEN path LIKE 'config/%' THEN 'config'
          WHEN path LIKE '%.py' OR path LIKE '%.cs' THEN 'code' WHEN path LIKE '%.json' THEN 'infra' ELSE 'artifact' END AS kind,
        CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.TS' THEN 'typescript' WHEN path LIKE '%.json' THEN 'json' WHEN path LIKE '%.cs' THEN 'csharp' WHEN path LIKE '%.tf' THEN 'terraform' END AS language
      FROM $doc_paths WHERE path NOT LIKE '%/.git%' AND path NOT LIKE '%Thumbs.db' AND path NOT LIKE 'node_modules/%')
    WHERE size_bytes <= 2000000""",
)
def file_inventory(t):
    return corpus.inventory(t.view("doc_paths", spread=True), max_bytes=2_000_000)


@query(
    "extractor_routing",
    """
    SELECT x.extractor, string_split(path, '/')[1] AS module, count(DISTINCT path) AS files
    FROM $doc_paths JOIN (VALUES ('code', '(?i)[.](py|ts|cs)$'), ('config', '[.]json$'), ('config', '(^|/)config/'), ('docs', '[.]md$'), ('all', '.')) x(extractor, pattern)
      ON regexp_matches(path, x.pattern) GROUP BY 1, 2""",
)
def extractor_routing(t):
    rules = [("code", "(?i)[.](py|ts|cs)$"), ("config", "[.]json$"), ("config", "(^|/)config/"), ("docs", "[.]md$"), ("all", ".")]
    routed = corpus.route_files(t.view("doc_paths", spread=True), rules)
    return (
        routed.distinct()  # documents of one path are one file
        .groupBy("extractor", F.split_part("path", F.lit("/"), F.lit(1)).alias("module"))
        .agg(F.count(F.lit(1)).alias("files"))
    )


@query(
    "content_sniff",
    """
    SELECT doc_id, contains(text, 'the ') AS marked, contains(substr(text, 1, 4096), chr(10)) AS head_lines, contains(text, chr(0)) AS is_binary
    FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN text || chr(0) ELSE text END AS text FROM documents)""",
)
def content_sniff(t):
    d = t.spread("documents").withColumn("text", F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit("\x00"))).otherwise(F.col("text")))
    return d.select(
        "doc_id",
        F.contains("text", F.lit("the ")).alias("marked"),
        corpus.sniff(F.col("text"), ["\n"], head=4096).alias("head_lines"),
        tx.looks_binary(F.col("text")).alias("is_binary"),
    )


@query(
    "module_manifest",
    """
    SELECT root, string_split(root, '/')[-1] AS module,
      lower(coalesce(string_split(root, '/')[-2], string_split(root, '/')[-1])) AS family, descriptors FROM (
      SELECT CASE WHEN doc_id % 6 = 2 THEN regexp_replace(path, '/[^/]+/[^/]+$', '') ELSE regexp_replace(path, '/[^/]+$', '') END AS root, count(*) AS descriptors
      FROM $doc_paths WHERE path LIKE '%.json' OR path LIKE '%.tf' GROUP BY 1)""",
)
def module_manifest(t):
    up_two = F.regexp_replace("path", "/[^/]+/[^/]+$", "")
    up_one = F.regexp_replace("path", "/[^/]+$", "")
    found = t.view("doc_paths", spread=True).filter(F.col("path").endswith(".json") | F.col("path").endswith(".tf"))
    return corpus.module_roots(found.select(F.when(F.col("path").endswith(".json"), up_two).otherwise(up_one).alias("root")))


# ---------------------------------------------------------------- identifiers, SQL, HTTP
@query(
    "doc_identifier_tokens",
    """
    SELECT tok, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'),
      lambda w: regexp_matches(w, '(?i)(id|key|code|number|guid|token|tion)$'))) AS tok FROM documents) GROUP BY tok""",
)
def doc_identifier_tokens(t):
    suffixes = vocab.IDENTIFIER_SUFFIXES + ("tion",)
    return (
        t.spread("documents").select(F.explode(tx.identifier_tokens(F.col("text"), suffixes)).alias("tok"))
        .groupBy("tok")
        .agg(F.count(F.lit(1)).alias("docs"))
    )


@query(
    "sql_statement_facts",
    r"""
    SELECT verb, by_verb, by_order, crud, count(*) AS n FROM (
      SELECT upper(regexp_extract(sql_text, '^\s*(\S+)', 1)) AS verb,
        lower(CASE WHEN sql_text LIKE 'SELECT%' OR sql_text LIKE 'DELETE%' THEN regexp_extract(sql_text, 'FROM\s+([A-Za-z0-9_.]+)', 1)
             WHEN sql_text LIKE 'INSERT%' THEN regexp_extract(sql_text, 'INTO\s+([A-Za-z0-9_.]+)', 1) ELSE regexp_extract(sql_text, 'UPDATE\s+([A-Za-z0-9_.]+)', 1) END) AS by_verb,
        coalesce(nullif(regexp_extract(lower(sql_text), '\bfrom\s+([a-z0-9_.]+)', 1), ''), nullif(regexp_extract(lower(sql_text), '\binto\s+([a-z0-9_.]+)', 1), ''),
          nullif(regexp_extract(lower(sql_text), '\bupdate\s+([a-z0-9_.]+)', 1), '')) AS by_order,
        CASE WHEN sql_text LIKE 'SELECT%' THEN 'read' ELSE 'write' END AS crud
      FROM $steps WHERE sql_text IS NOT NULL) GROUP BY 1, 2, 3, 4""",
)
def sql_statement_facts(t):
    s = t.view("steps").filter("sql_text IS NOT NULL")
    c = F.col("sql_text")
    return (
        s.select(
            tx.sql_verb(c).alias("verb"), tx.sql_table_by_verb(c).alias("by_verb"), tx.sql_table_by_order(c).alias("by_order"),
            tx.sql_crud(tx.sql_verb(c)).alias("crud"),
        )
        .groupBy("verb", "by_verb", "by_order", "crud")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "target_inference",
    """
    SELECT connector, method, kind, ref, op, CASE op WHEN 'reads' THEN 'read' WHEN 'writes' THEN 'update' WHEN 'deletes' THEN 'delete' ELSE 'execute' END AS crud,
      CASE WHEN kind = 'http' THEN 'https' ELSE kind END AS protocol,
      CASE WHEN kind IN ('sql', 'sharepoint') THEN CASE op WHEN 'reads' THEN 'data.reads' ELSE 'data.mutates' END WHEN kind = 'http' THEN 'interface.calls' END AS role,
      method_op, count(*) AS n FROM (
      SELECT connector, method, kind, CASE WHEN kind = 'http' THEN url WHEN kind IN ('sql', 'sharepoint') THEN coalesce(datasource, connector) ELSE connector END AS ref,
        CASE WHEN kind = 'http' THEN 'calls' WHEN kind IN ('sql', 'sharepoint') THEN CASE WHEN upd THEN 'writes' WHEN del THEN 'deletes' ELSE 'reads' END
          WHEN method = 'GET' THEN 'reads' WHEN method = 'POST' THEN 'writes' ELSE 'calls' END AS op,
        CASE method WHEN 'GET' THEN 'reads' WHEN 'POST' THEN 'writes' ELSE 'calls' END AS method_op
      FROM (SELECT *, CASE WHEN url IS NOT NULL THEN 'http' WHEN connector LIKE '%sql%' THEN 'sql' WHEN connector LIKE '%sharepoint%' THEN 'sharepoint' ELSE connector END AS kind,
          k2 % 3 = 0 AS upd, k2 % 3 = 1 AS del FROM $steps))
    GROUP BY ALL""",
)
def target_inference(t):
    s = t.view("steps").withColumn(
        "verb_name", F.when(F.col("k2") % 3 == 0, "updateRow").when(F.col("k2") % 3 == 1, "dropRow").otherwise("fetchRow")
    )
    s = s.select(
        "connector", "method", "verb_name",
        tx.target_kind(F.col("connector"), F.col("url")).alias("kind"),
        tx.target_ref(F.col("connector"), F.col("url"), F.col("datasource")).alias("ref"),
        tx.http_operation(F.col("method")).alias("method_op"),
    ).withColumn("op", tx.operation_for(F.col("kind"), F.col("verb_name"), F.col("method")))
    s = s.select(
        "connector", "method", "kind", "ref", "op", tx.crud_for(F.col("op")).alias("crud"), tx.protocol_for(F.col("kind")).alias("protocol"),
        tx.relation_role(F.col("kind"), F.col("op")).alias("role"), "method_op",
    )
    return s.groupBy(*s.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "page_host_inventory",
    r"""
    SELECT host, bucket, count(*) AS pages FROM (
      SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host,
        nullif(array_to_string(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '')[1:2], '/'), '') AS bucket FROM pages)
    GROUP BY GROUPING SETS ((host, bucket), (host), ())""",
)
def page_host_inventory(t):
    u = t.pages.select(tx.url_host(F.col("url")).alias("host"), tx.repo_bucket(tx.url_path(F.col("url"))).alias("bucket"))
    return u.rollup("host", "bucket").agg(F.count(F.lit(1)).alias("pages"))


@query(
    "route_facts",
    r"""
    SELECT o_orderkey, '/api/v1/' || 'orders/' || chr(123) || 'orderId' || chr(125) || '/' || lower(o_orderstatus) || '/:lineKey' AS route, 'lineKey,orderId' AS params,
      CASE WHEN o_orderkey % 2 = 0 THEN 'flow' || CAST(o_custkey AS STRING) END AS workflow, CASE WHEN o_orderkey % 2 = 1 THEN 'T' || CAST(o_custkey % 9 AS STRING) END AS tbl,
      'https://h/' AS base FROM orders""",
)
def route_facts(t):
    o = t.orders.withColumn(
        "url",
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("https://h/workflows/flow"), F.col("o_custkey").cast("string"), F.lit("/triggers/m/run?a=1")))
        .otherwise(F.concat(F.lit("https://h/v2/Tables/T"), (F.col("o_custkey") % 9).cast("string"), F.lit("/items"))),
    )
    route = tx.compose_route(F.lit("/api/v1/"), F.lit("orders/{orderId}"), F.lower("o_orderstatus"), F.lit(":lineKey"))
    return o.select(
        "o_orderkey", route.alias("route"), F.array_join(tx.route_params(route), ",").alias("params"),
        tx.trigger_workflow(F.col("url")).alias("workflow"), tx.table_in_path(F.col("url")).alias("tbl"),
        F.concat(F.lit("https://"), tx.url_host(F.col("url")), F.lit("/")).alias("base"),
    )


# ---------------------------------------------------------------- evidence and lines
@query(
    "evidence_anchors",
    """
    WITH e AS (SELECT doc_id, len(string_split(text, chr(10))) AS total, source || '/d:' || CAST(doc_id AS STRING) || '.txt' AS path,
        CASE doc_id % 3 WHEN 0 THEN 1 ELSE doc_id % 40 END AS s, CASE doc_id % 3 WHEN 2 THEN doc_id % 40 + doc_id % 190 WHEN 1 THEN doc_id % 40 ELSE 1 END AS e FROM documents)
    SELECT doc_id, path, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line, CAST(greatest(1, s) AS INT) AS clamp_start,
      CAST(least(greatest(greatest(1, s), e), greatest(1, s) + 80, total) AS INT) AS clamp_end FROM e""",
)
def evidence_anchors(t):
    entry = F.concat(
        F.col("source"), F.lit("/d:"), F.col("doc_id").cast("string"), F.lit(".txt"),
        F.when(F.col("doc_id") % 3 == 0, "")
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit(":"), (F.col("doc_id") % 40).cast("string")))
        .otherwise(F.concat(F.lit(":"), (F.col("doc_id") % 40).cast("string"), F.lit("-"), (F.col("doc_id") % 40 + F.col("doc_id") % 190).cast("string"))),
    )
    d = t.spread("documents").select("doc_id", F.size(F.split("text", "\n")).alias("total"), tx.parse_evidence(entry).alias("a"))
    c = tx.clamp_lines(F.col("a.start_line"), F.col("a.end_line"), F.col("total"))
    return d.select("doc_id", "a.path", "a.start_line", "a.end_line", c["start_line"].alias("clamp_start"), c["end_line"].alias("clamp_end"))


@query(
    "doc_line_facts",
    r"""
    SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, unnest(regexp_extract_all(line, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|[a-zA-Z0-9.]+@[a-z0-9.]+[a-z]')) AS hit
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)""",
)
def doc_line_facts(t):
    return corpus.line_hits(
        t.spread("documents").select(F.col("doc_id"), "text"), "doc_id", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|[a-zA-Z0-9.]+@[a-z0-9.]+[a-z]"
    )


@query(
    "doc_chunks",
    """
    WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
    s AS (SELECT doc_id, source, ls, unnest(generate_series(0, greatest(0, len(ls) - 1), 8)) AS st FROM l),
    c AS (SELECT doc_id, source, CAST(st + 1 AS BIGINT) AS start_line, CAST(least(len(ls), st + 10) AS BIGINT) AS end_line,
      trim(array_to_string(ls[st + 1: least(len(ls), st + 10)], chr(10)), ' ' || chr(10) || chr(9) || chr(13)) AS body FROM s WHERE st = 0 OR st + 2 < len(ls))
    SELECT doc_id, source AS component, start_line, end_line, CAST(length(body) AS BIGINT) AS body_chars, md5(substr(body, 1, 4000)) AS text_md5 FROM c WHERE body <> ''""",
)
def doc_chunks(t):
    files = t.spread("documents").select("doc_id", F.col("source").alias("component"), "text")
    chunks = chunk_lines(files, chunk_size=10, overlap=2)
    return chunks.select(
        "doc_id", "component", "start_line", "end_line", F.length("body").cast("bigint").alias("body_chars"), F.md5("text").alias("text_md5")
    )


@query(
    "doc_section_words",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS n
      FROM (SELECT doc_id, '## Intro' || chr(10) || replace(text, chr(10) || 'T', chr(10) || '## T') AS md FROM documents)),
    s AS (SELECT *, sum(CASE WHEN line LIKE '## %' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l)
    SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(sum(CASE WHEN line LIKE '## %' THEN 0 ELSE len(regexp_extract_all(line, '[\p{L}\p{N}_]+')) END) AS BIGINT) AS words,
      sum(CASE WHEN line LIKE '## %' THEN 0 ELSE len(regexp_extract_all(line, '[\p{L}\p{N}_]+')) END) < 50 AS below_min FROM s GROUP BY 1, 2""",
)
def doc_section_words(t):
    md = t.spread("documents").select(
        "doc_id", F.concat(F.lit("## Intro\n"), F.replace("text", F.lit("\nT"), F.lit("\n## T"))).alias("text")
    )
    return corpus.section_words(md, "doc_id", min_words=50)


@query("doc_content_dedupe", "SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies, min_by(source, doc_id) AS source FROM documents GROUP BY 1")
def doc_content_dedupe(t):
    d = t.spread("documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return d.groupBy("sha").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.min_by("source", "doc_id").alias("source")
    )


# ---------------------------------------------------------------- words, labels, ids
@query(
    "identifier_words",
    r"""
    SELECT p_partkey, array_to_string(list_filter(['process', 'import', 'audit'], lambda v: v = 'process' OR (v = 'import' AND p_size % 2 = 0) OR (v = 'audit' AND p_size % 3 = 0)), ',') AS verbs,
      'orders_table' || CASE WHEN p_size % 5 = 0 THEN ',jobQueue' ELSE '' END AS stores, 'StockService' AS services
    FROM part""",
)
def identifier_words(t):
    name = F.concat(
        F.lit("processBrand"), F.when(F.col("p_size") % 2 == 0, "Import").otherwise(""), F.col("p_size").cast("string"),
        F.when(F.col("p_size") % 3 == 0, "_audit").otherwise(""),
    )
    doc = F.concat(F.lit("Reads orders_table through StockService"), F.when(F.col("p_size") % 5 == 0, " and jobQueue.").otherwise("."))
    return t.part.select(
        "p_partkey", F.array_join(tx.business_verbs(name), ",").alias("verbs"),
        F.array_join(tx.hint_words(doc, tx.STORE_WORD), ",").alias("stores"),
        F.array_join(tx.hint_words(doc, tx.SERVICE_WORD), ",").alias("services"),
    )


@query(
    "environment_hints",
    """
    SELECT event_type, CASE WHEN m = 0 THEN 'prod' WHEN m = 1 THEN 'staging' WHEN m = 2 THEN 'dev' WHEN m = 3 THEN 'qa' END AS env, count(*) AS n
    FROM (SELECT event_type, user_id % 5 AS m FROM events) GROUP BY 1, 2""",
)
def environment_hints(t):
    word = F.element_at(F.array(*[F.lit(w) for w in ("Production", "stage", "dev", "QA", "plain")]), (F.col("user_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("deploy/"), F.col("event_type"), F.lit("-"), word, F.lit("/app.yml"))
    return t.events.select("event_type", tx.environment(path).alias("env")).groupBy("event_type", "env").agg(F.count(F.lit(1)).alias("n"))


@query(
    "connector_labels",
    """
    SELECT connector, CASE connector WHEN 'shared_sharepoint' THEN 'Sharepoint' WHEN 'sql:query' THEN 'Sql:query' ELSE upper(substr(connector, 1, 1)) || substr(connector, 2) END AS label,
      CASE WHEN k2 % 2 = 0 THEN 'power_automate' ELSE 'logicapps_standard' END AS engine, count(*) AS n FROM $steps GROUP BY 1, 2, 3""",
)
def connector_labels(t):
    path = F.concat(F.lit("repo"), F.when(F.col("k2") % 2 == 0, "/flows/").otherwise("/workflows/"), F.col("name"), F.lit(".json"))
    s = t.view("steps").select("connector", tx.connector_label(F.col("connector")).alias("label"), tx.workflow_engine(path, F.lit("{}")).alias("engine"))
    return s.groupBy("connector", "label", "engine").agg(F.count(F.lit(1)).alias("n"))


@query(
    "wrapper_pruning",
    """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'ExtensionActivity1,bwActivity' WHEN 1 THEN 'Load,Save' ELSE 'Load' END AS kept FROM orders""",
)
def wrapper_pruning(t):
    k = F.col("o_orderkey") % 3
    steps = F.when(k == 0, F.array(F.lit("ExtensionActivity1"), F.lit("bwActivity"))).when(
        k == 1, F.array(F.lit("Load"), F.lit("ActivityConfig"), F.lit("Save"))
    ).otherwise(F.array(F.lit("extensionActivity"), F.lit("Load")))
    return t.orders.select("o_orderkey", F.array_join(tx.prune_wrappers(steps), ",").alias("kept"))


_SUB = ", ".join(f"('{k}', '{r}')" for k, v in vocab.SUBSTRING_ROLES.items() for r in v)
_PRE = ", ".join(f"('{k}', '{r}')" for k, v in vocab.PREFIX_ROLES.items() for r in v)


@query(
    "role_mapping",
    f"""
    WITH c AS (SELECT connector, count(*) AS n FROM $steps GROUP BY 1)
    SELECT 'substring' AS rule, role, CAST(sum(n) AS BIGINT) AS steps FROM (SELECT DISTINCT connector, n, role FROM c JOIN (VALUES {_SUB}) r(p, role) ON contains(connector, p)) GROUP BY 2
    UNION ALL
    SELECT 'prefix', role, CAST(sum(n) AS BIGINT) FROM (SELECT DISTINCT connector, n, role FROM c JOIN (VALUES {_PRE}) r(p, role) ON split_part(connector, ':', 1) = p) GROUP BY 2""",
)
def role_mapping(t):
    s = t.view("steps").select("connector")
    sub = s.select(F.lit("substring").alias("rule"), F.explode(tx.substring_roles(F.col("connector"))).alias("role"))
    pre = s.select(F.lit("prefix").alias("rule"), F.explode(tx.prefix_roles(F.col("connector"))).alias("role"))
    return sub.unionByName(pre).groupBy("rule", "role").agg(F.count(F.lit(1)).alias("steps"))


@query(
    "record_ids",
    """
    SELECT signal_id, substr(sha256(name || '|' || sha256(file) || '|' || kind), 1, 16) AS record_id,
      'order_' || CAST(signal_id AS STRING) || '_' || kind || '_' || substr(sha1('Order ' || CAST(signal_id AS STRING) || '::' || kind || '::' || coalesce(path, '')), 1, 8) AS relation_id
    FROM $signals""",
)
def record_ids(t):
    s = t.view("signals")
    label = F.concat(F.lit("Order "), F.col("signal_id").cast("string"))
    return s.select(
        "signal_id", tx.record_id(F.col("name"), F.sha2("file", 256), F.col("kind")).alias("record_id"),
        tx.relation_id(label, F.col("kind"), F.col("path")).alias("relation_id"),
    )


@query(
    "relationship_inputs",
    """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'related_to' WHEN 1 THEN 'calls' END AS rel_type,
      CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'user' || CAST(user_id AS STRING) END AS display,
      CASE WHEN event_id % 3 = 1 THEN 'writes' END AS operation FROM events""",
)
def relationship_inputs(t):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(
        F.col("event_id") % 3 == 1,
        F.concat(F.lit('{"type":"calls","target":{"display":"user'), F.col("user_id").cast("string"), F.lit('"},"operation":"writes"}')),
    ).otherwise(F.lit('{"type":'))
    v = t.events.select("event_id", F.try_parse_json(raw).alias("v"))
    return corpus.normalize_relationship(v, "v").select("event_id", "rel_type", "display", "operation")


@query(
    "artifact_summaries",
    """
    SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderstatus = 'O' THEN 0.75 ELSE 0.1 END AS DOUBLE) AS confidence,
      CASE WHEN o_orderkey % 2 = 0 THEN 'day/' || CAST(o_custkey % 5 AS STRING) ELSE 'day' END AS schedule,
      'Order ' || CAST(o_orderkey AS STRING) || ' handles ' || lower(o_orderpriority) || CASE WHEN o_orderkey % 2 = 0 THEN ' on day/' || CAST(o_custkey % 5 AS STRING) ELSE ' on day' END || '.' AS summary,
      substr(o_orderpriority, 1, 6) || CASE WHEN length(o_orderpriority) > 6 THEN '...' ELSE '' END AS short FROM orders""",
)
def artifact_summaries(t):
    every = F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_custkey") % 5).cast("string"))
    schedule = F.concat_ws("/", F.lit("day"), every)
    parsed = F.when(F.col("o_orderstatus") == "P", 0.1).otherwise(0.5)
    evid = F.when(F.col("o_orderstatus") == "F", 1.2).when(F.col("o_orderstatus") == "O", 0.5)
    return t.orders.select(
        "o_orderkey", tx.artifact_confidence(parsed, evid).alias("confidence"), schedule.alias("schedule"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" handles "), F.lower("o_orderpriority"), F.lit(" on "), schedule, F.lit(".")).alias("summary"),
        F.concat(F.substring("o_orderpriority", 1, 6), F.when(F.length("o_orderpriority") > 6, "...").otherwise("")).alias("short"),
    )


# ---------------------------------------------------------------- stores and incremental scans
@query("chunk_store_roundtrip", "SELECT source AS component, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def chunk_store_roundtrip(t):
    store = corpus.ChunkStore(t.spark)
    store.append(t.spread("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("component"), "text"))
    return store.load().groupBy("component").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text").cast("bigint")).alias("chars"))


@query(
    "new_content",
    """
    SELECT doc_id, sha256(text) AS sha FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)""",
)
def new_content(t):
    files = t.spread("documents").select("doc_id", F.lit("x1").alias("extractor"), F.lit("1").alias("version"), F.sha2("text", 256).alias("sha"))
    done = files.filter("doc_id % 3 = 0").select("extractor", "version", "sha")
    return corpus.unseen(files, done).select("doc_id", "sha")


@query(
    "artifact_validation",
    """
    SELECT signal_id, 'method' AS field, 'missing' AS problem FROM $signals WHERE method IS NULL
    UNION ALL SELECT signal_id, 'kind', 'not allowed' FROM $signals WHERE kind NOT IN ('workflow', 'route')""",
)
def artifact_validation(t):
    return corpus.validate(t.view("signals"), "signal_id", required=["name", "method"], allowed={"kind": ["workflow", "route"]})


@query(
    "external_findings",
    """
    SELECT 'scan:' || event_type AS rule_id, lower(sev) AS severity, count(*) AS n, min(p) AS first_anchor FROM (
      SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'ERROR' ELSE 'info' END AS sev, 'src/u' || CAST(user_id AS STRING) || '.py:' || CAST(CASE WHEN user_id % 4 = 0 THEN 1 ELSE event_id % 90 + 1 END AS STRING) AS p FROM events)
    GROUP BY 1, 2""",
)
def external_findings(t):
    js = F.concat(
        F.lit('{"results":[{"check_id":"'), "event_type", F.lit('","path":"src/u'), F.col("user_id").cast("string"), F.lit('.py"'),
        F.when(F.col("user_id") % 4 == 0, "").otherwise(F.concat(F.lit(',"start":{"line":'), (F.col("event_id") % 90 + 1).cast("string"), F.lit("}"))),
        F.when(F.col("user_id") % 2 == 0, ',"extra":{"severity":"ERROR","message":"m"}').otherwise(""), F.lit("}]}"),
    )
    found = corpus.scanner_findings(t.events.select(js.alias("value")))
    return found.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("anchor").alias("first_anchor"))
