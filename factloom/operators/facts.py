"""Fact extraction: file rows become typed fact rows.

Text rules run as array expressions per row (a scan with no join and no shuffle), JSON goes
through VARIANT, XML through the XPath functions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions import vocab
from factloom.operators import ordered


@dataclass(frozen=True)
class Rule:
    """One row of the rules table."""

    rule_id: str
    kind: str
    prop: str
    pattern: str
    group: int = 1
    ext: tuple[str, ...] = ()
    confidence: float = 0.8


# Text rules.
SCRIPT_EXT = (".js", ".ts", ".tsx", ".jsx")
TEXT_RULES = (
    Rule("collection", "db", "datastore", r"(?i)db\.collection\(\s*['\"]([^'\"]+)['\"]", 1, SCRIPT_EXT),
    Rule("model", "db", "datastore", r"(?i)mongoose\.model\(\s*['\"]([^'\"]+)['\"]", 1, SCRIPT_EXT),
    Rule("table", "db", "datastore", r"(?i)knex\(\s*['\"]([^'\"]+)['\"]\)", 1, SCRIPT_EXT),
    Rule("client_call", "integration", "service", r"(?i)(?:axios|superagent)\.(?:get|post|put|delete|patch)\(\s*['\"](https?://[^'\"]+)['\"]", 1, SCRIPT_EXT),
    Rule("fetch_call", "integration", "service", r"(?i)fetch\(\s*['\"](https?://[^'\"]+)['\"]", 1, SCRIPT_EXT),
)
PB_EXT = (".srw", ".sru", ".srm", ".srf", ".srd")
SCRIPT_RULES = (
    Rule("event", "step", "event", r"(?i)^[ \t]*event\s+([a-zA-Z0-9_]+)", 1, PB_EXT),
    Rule("function", "step", "function", r"(?i)^[ \t]*(?:public|protected)?\s*(?:function|subroutine)\s+[a-zA-Z0-9_]+\s+([a-zA-Z0-9_.]+)\s*\(", 1, PB_EXT),
    Rule("datawindow_op", "step", "datawindow", r"(?i)\b(dw_[a-zA-Z0-9_]+\.(?:retrieve|update|insertrow|deleterow|settransobject|settrans))", 1, PB_EXT),
    Rule("call", "call", "process", r"(?i)([a-zA-Z_][a-zA-Z0-9_.]+\s*\.\s*[a-zA-Z_][a-zA-Z0-9_]*)\s*\(", 1, PB_EXT),
    Rule("http", "step", "http", r"(?i)(createobject\(\s*\"(?:httpclient|restclient)\"\s*\)|sendrequest\s*\(|setrequestheader)", 1, PB_EXT),
    Rule("soap", "step", "soap", r"(?i)((?:soapconnection|createsoapconnection)\s*|\.soap\w+\()", 1, PB_EXT),
    Rule("external", "step", "external", r"(?i)(\bfunction\b.*\bexternal\b)", 1, PB_EXT),
)
FIRST_HIT_RULES = ("http", "soap", "external")
# Rules of components, entities, code and manifests.
UI_RULES = (
    Rule("page_route", "ui_component", "route", r"@page\s+\"([^\"]+)\"", 1, (".razor", ".cshtml")),
    Rule("route_path", "ui_component", "route", r"<Route[^>]*path=\"([^\"]+)\"", 1, (".tsx", ".jsx")),
    Rule("router_link", "ui_component", "route", r"routerLink=\"([^\"]+)\"", 1, (".ts", ".html")),
    Rule("function_component", "ui_component", "component", r"\bfunction\s+([A-Z][A-Za-z0-9_]*)\s*\(", 1, (".tsx", ".jsx")),
    Rule("const_component", "ui_component", "component", r"\bconst\s+([A-Z][A-Za-z0-9_]*)\s*=\s*\(", 1, (".tsx", ".jsx")),
    Rule("selector", "ui_component", "selector", r"selector\s*:\s*['\"]([^'\"]+)['\"]", 1, (".ts",)),
    Rule("template", "ui_component", "template", r"templateUrl\s*:\s*['\"]([^'\"]+)['\"]", 1, (".ts",)),
)
ENTITY_RULES = (
    Rule("lane", "business_entity", "process_diagram", r"(?i)<[\w:]*lane[^>]*name=\"([^\"]+)\"", 1, (".bpmn", ".bwp", ".drawio")),
    Rule("authorize", "business_entity", "authorize_attribute", r"(?i)\[Authorize[^\]]*Roles\s*=\s*\"([^\"]+)\"", 1, (".cs",)),
    Rule("component_fn", "business_entity", "component_name", r"\bfunction\s+([A-Z][A-Za-z0-9_]*)\s*\(", 1, (".tsx", ".jsx", ".ts", ".razor", ".cshtml")),
    Rule("component_const", "business_entity", "component_name", r"\bconst\s+([A-Z][A-Za-z0-9_]*)\s*=\s*\(", 1, (".tsx", ".jsx", ".ts", ".razor", ".cshtml")),
    Rule("component_class", "business_entity", "component_name", r"class\s+([A-Z][A-Za-z0-9_]*)\s+(?:extends|implements)", 1, (".tsx", ".jsx", ".ts", ".razor", ".cshtml")),
)
CODE_RULES = (
    Rule("class", "code_entity", "class", r"\bclass\s+([A-Za-z_][A-Za-z0-9_]*)", 1, (".cs", ".ts", ".tsx", ".js", ".py")),
    Rule("interface", "code_entity", "interface", r"\binterface\s+([A-Za-z_][A-Za-z0-9_]*)", 1, (".cs",)),
    Rule("method", "code_entity", "method", r"\b(?:public|private|protected|internal)\s+(?:static\s+)?(?:async\s+)?[A-Za-z_][\w<>\[\],]*\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1, (".cs",)),
    Rule("function", "code_entity", "function", r"\bfunction\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1, (".js", ".ts", ".tsx")),
    Rule("def", "code_entity", "function", r"^[ \t]*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1, (".py",)),
)
MANIFEST_RULES = tuple(
    Rule(f.lower(), "adapter", f, rf"(?i)^[ \t]*{f}:[ \t]*(.+?)\s*$", 1, (".mf",))
    for f in ("Bundle-SymbolicName", "Bundle-Activator", "Bundle-ClassPath")
)


_MARK = "\x01"


def unmarked(files: DataFrame) -> DataFrame:
    """Files whose texts hold no mark: values and lines are then read from the same text."""
    return files.withColumn("text", F.replace("text", F.lit(_MARK), F.lit(" ")))


def hit_lines(text: Column, pattern: str) -> Column:
    """Line of the start of every hit of ``pattern`` in a whole ``unmarked`` text: a mark is set before each hit, then
    the marks of each line are counted.  Linear in the text, however many hits there are."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(_MARK + "$0"))
    marks = lambda row: F.length(row) - F.length(F.replace(row, F.lit(_MARK), F.lit("")))
    return F.flatten(F.transform(F.split(marked, "\n"), lambda row, i: F.array_repeat((i + 1).cast("bigint"), marks(row))))


def _rule_hits(r: Rule) -> Column:
    fixed = [F.lit(r.rule_id).alias("rule_id"), F.lit(r.kind).alias("kind"), F.lit(r.prop).alias("prop")]
    pattern = "(?m)" + r.pattern
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(r.group)).alias("value"), hit_lines(F.col("text"), pattern).alias("line"))
    return F.transform(found, lambda h: F.struct(h["line"].alias("line"), *fixed, h["value"].alias("value"), F.lit(r.confidence).alias("confidence")))


def rule_facts(files: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(path, line, rule_id, kind, prop, value, confidence)`` for every hit of every rule.

    Files whose extension no rule wants are dropped first.  Rules read whole texts, so a call may be
    broken over lines; ``^`` is the start of a line, and a hit's line is the one where it starts.
    """
    wanted = sorted({e for r in rules for e in r.ext})
    src = unmarked(files).withColumn("ext", tx.extension(F.col("path")))
    if wanted and all(r.ext for r in rules):
        src = src.filter(F.col("ext").isin(*wanted))
    hits = [F.when(F.col("ext").isin(*r.ext), _rule_hits(r)) if r.ext else _rule_hits(r) for r in rules]
    return src.select("path", F.explode(F.flatten(F.array_compact(F.array(*hits)))).alias("h")).select("path", "h.*")


def first_hits(facts: DataFrame, rule_ids: tuple[str, ...]) -> DataFrame:
    """Keep one fact per (path, rule) for the given rules and every fact of the others."""
    once = facts.filter(F.col("rule_id").isin(*rule_ids))
    rest = [c for c in facts.columns if c not in ("path", "rule_id")]
    kept = once.groupBy("path", "rule_id").agg(F.min(F.struct("line", *[c for c in rest if c != "line"])).alias("b"))
    return facts.filter(~F.col("rule_id").isin(*rule_ids)).unionByName(kept.select("path", "rule_id", "b.*"))


# ---------------------------------------------------------------- routes and imports
# Fixed value: route declarations; the quote that opens the path also closes it.
ROUTE_RE = r"(?i)\b(?:app|router)\.(get|post|put|delete|patch|options|head)\s*\(\s*([`'\"])(.+?)\2"


def source_routes(files: DataFrame) -> DataFrame:
    hit = F.explode(
        F.arrays_zip(
            F.regexp_extract_all("text", F.lit(ROUTE_RE), F.lit(1)).alias("method"),
            F.regexp_extract_all("text", F.lit(ROUTE_RE), F.lit(3)).alias("route"),
            hit_lines(F.col("text"), ROUTE_RE).alias("line"),
        )
    )
    return unmarked(files).filter(F.col("text").rlike(ROUTE_RE)).select("path", hit.alias("h")).select(
        "path", "h.line", F.upper("h.method").alias("method"), F.col("h.route").alias("route"),
        tx.route_params(F.col("h.route")).alias("params"),
    )


JS_IMPORT_RE = r"import\s+(?:.+?\s+from\s+)?[\"']([^\"']+)[\"']"
CS_USING_RE = r"(?m)^\s*using\s+([A-Za-z0-9_.]+);"


def classify_integration(module: Column) -> Column:
    """Kind of the first vocabulary hint contained in the module name."""
    low = F.lower(module)
    return F.coalesce(*[F.when(low.contains(h.lower()), F.lit(tag)) for h, tag in vocab.INTEGRATION_HINTS.items()])


def import_integrations(files: DataFrame) -> DataFrame:
    ext = tx.extension(F.col("path"))
    found = F.when(ext.isin(".ts", ".tsx", ".js"), F.regexp_extract_all("text", F.lit(JS_IMPORT_RE), F.lit(1))).when(
        ext == ".cs", F.regexp_extract_all("text", F.lit(CS_USING_RE), F.lit(1))
    )
    mods = files.select("path", F.substring(ext, 2, 9).alias("language"), F.explode(found).alias("library"))
    return mods.withColumn("integration_kind", classify_integration(F.col("library"))).filter("integration_kind IS NOT NULL")


# ---------------------------------------------------------------- SQL
# Table and key declarations.
CREATE_RE = r"(?is)\bcreate\s+table\s+([a-zA-Z0-9_.\[\]\"]+)"
FK_RE = r"(?is)foreign\s+key\s*\(([^\)]*)\)\s+references\s+([a-zA-Z0-9_.\[\]\"]+)(?:\s*\(([^\)]*)\))?"
_UNQUOTE = r"^[\[\]\"]+|[\[\]\"]+$"


def ddl_blocks(files: DataFrame) -> DataFrame:
    """One row per CREATE TABLE: ``(path, pos, line, table, block)``; a block ends where the next begins.

    Blocks are cut inside the row, so a file never leaves its task.
    """
    parts = F.split("text", r"(?is)(?=\bcreate\s+table\s)")
    newlines = F.transform("parts", lambda b: F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit(""))))
    cut = files.select("path", parts.alias("parts")).select("path", "parts", newlines.alias("nl"))
    rows = cut.select("path", "nl", F.posexplode("parts").alias("pos", "block")).filter(F.col("block").rlike(CREATE_RE))
    before = F.aggregate(F.slice("nl", 1, F.col("pos")), F.lit(0), lambda a, x: a + x)
    return rows.select(
        "path", "pos", (before + 1).cast("bigint").alias("line"),
        F.regexp_replace(F.regexp_extract("block", CREATE_RE, 1), _UNQUOTE, "").alias("table"), "block",
    )


def ddl_columns(blocks: DataFrame) -> DataFrame:
    inside = F.expr("substring(block, instr(block, '(') + 1)")
    rows = blocks.filter(F.instr("block", "(") > 0).select("path", "table", F.posexplode(F.split(inside, "\n")).alias("pos", "raw"))
    rows = rows.withColumn("raw", F.regexp_replace(F.trim("raw"), ",+$", ""))
    rows = rows.filter((F.col("raw") != "") & ~F.col("raw").rlike(r"(?i)^(constraint|primary|foreign)") & ~F.col("raw").rlike(r"^(\)|\];)"))
    words = F.split("raw", r"\s+")
    return rows.select(
        "path", "table", "pos", F.regexp_replace(words[0], _UNQUOTE, "").alias("column"),
        F.array_join(F.slice(words, 2, 1 << 20), " ").alias("definition"),
    )


def _fk_columns(raw: Column) -> Column:
    names = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda c: F.regexp_replace(F.trim(c), _UNQUOTE, ""))
    return F.filter(names, lambda c: c != "")


def ddl_foreign_keys(blocks: DataFrame) -> DataFrame:
    """``depends_on`` relationships between tables."""
    get = lambda g: F.regexp_extract_all("block", F.lit(FK_RE), F.lit(g))
    z = F.explode(F.arrays_zip(get(1).alias("src"), get(2).alias("target"), get(3).alias("dest")))
    rows = blocks.select("path", "table", z.alias("k"))
    target = F.regexp_replace("k.target", _UNQUOTE, "")
    digest = F.substring(F.sha1(F.concat_ws("-", "table", target)), 1, 8)
    return rows.select(
        "path", F.concat(F.col("table"), F.lit("_fk_"), digest).alias("relation_id"), "table", target.alias("references"),
        _fk_columns(F.col("k.src")).alias("columns"), _fk_columns(F.col("k.dest")).alias("ref_columns"), F.lit("depends_on").alias("operation"),
    ).filter("references <> ''")


# Fixed value: a statement in a script; its verb is the word it opens with.
STATEMENT_RE = r"(?is)\b((select|insert|update|delete)\b.+?;)"


def sql_statements(files: DataFrame) -> DataFrame:
    get = lambda g: F.regexp_extract_all("text", F.lit(STATEMENT_RE), F.lit(g))
    rows = files.select("path", F.posexplode(F.arrays_zip(get(1).alias("sql_text"), get(2).alias("verb"))).alias("pos", "s"))
    rows = rows.select("path", "pos", "s.sql_text", F.upper("s.verb").alias("verb"))
    c, verb = F.col("sql_text"), F.col("verb")
    return rows.select(
        "path", "pos", "sql_text", verb.alias("verb"), tx.sql_table_by_order(c).alias("table"), tx.sql_crud(verb).alias("crud"),
        tx.identifier_tokens(c).alias("identifiers"),
    )


# ---------------------------------------------------------------- entities
def business_entities(files: DataFrame) -> DataFrame:
    """Lanes, roles of authorize attributes and role names hidden in component names."""
    raw = rule_facts(files, ENTITY_RULES)
    roles = F.transform(F.split("value", "[,|;]"), lambda r: F.trim(F.replace(F.trim(r), F.lit("_"), F.lit(" "))))
    part = F.col("prop") == "component_name"
    names = (
        F.when(F.col("rule_id") == "lane", F.array(F.trim("value"))).when(F.col("rule_id") == "authorize", roles)
        .otherwise(F.array_compact(F.array(tx.humanize_component(F.col("value")))))
    )
    rows = raw.select("path", F.col("prop").alias("source"), F.when(~part, F.col("line")).alias("line"), F.posexplode(names).alias("pos", "name"))
    # component names count once per file, the other facts once per place
    return rows.filter("name <> ''").distinct().select("path", "source", "name")


# ---------------------------------------------------------------- JSON documents
def _vmap(v: str, path: str = "$") -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', 'map<string,variant>')")


def _vlist(v: str, path: str = "$") -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', 'array<variant>')")


def _vstr(v: str, path: str = "$") -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', 'string')")


def parsed(files: DataFrame) -> DataFrame:
    """Files with their JSON as VARIANT column ``v``; unreadable ones have NULL there."""
    return files.withColumn("v", F.try_parse_json("text"))


def parse_failures(files: DataFrame) -> DataFrame:
    """A file that cannot be read, XML by its extension or else JSON, stays in the result as a low-score ``doc`` row."""
    xml = tx.extension(F.col("path")).isin(*XML_EXT)
    bad = F.when(xml, readable_xml(F.col("text")).isNull()).otherwise(F.try_parse_json("text").isNull())
    return files.filter(bad).select("path", F.lit("doc").alias("kind"), F.lit(0.1).alias("parsed"))


def spec_operations(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """API rows and operation rows of API descriptions."""
    d = parsed(files.filter(F.col("text").contains('"openapi"') | F.col("text").contains('"swagger"')))
    d = d.withColumn("spec_version", F.coalesce(_vstr("v", "$.openapi"), _vstr("v", "$.swagger"))).filter("spec_version IS NOT NULL")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    d = d.withColumn("api", F.coalesce(_vstr("v", "$.info.title"), stem))
    apis = d.select("path", F.col("api").alias("name"), "spec_version", F.coalesce(_vstr("v", "$.info.version"), F.lit("")).alias("version"))
    routes = d.select("path", "api", F.explode(_vmap("v", "$.paths")).alias("route", "node"))
    ops = routes.select("path", "api", "route", F.explode(_vmap("node")).alias("verb", "op"))
    ops = ops.filter(F.lower("verb").isin(*vocab.HTTP_VERBS)).select(
        "path", "api", F.upper("verb").alias("method"), "route",
        F.coalesce(_vstr("op", "$.summary"), F.lit("")).alias("summary"), _vstr("op", "$.operationId").alias("operation_id"),
    )
    return apis, ops


def workflow_definitions(files: DataFrame) -> DataFrame:
    """Workflow JSON in any of its four document shapes: ``(path, shape, triggers, actions)``."""
    d = parsed(files.filter((F.col("text").contains('"triggers"') & F.col("text").contains('"actions"')) | F.col("text").contains("Microsoft.Logic/workflows")))
    whole = lambda p: F.expr(f"try_variant_get(v, '{p}', 'variant')")
    fits = lambda p: whole(f"{p}.triggers").isNotNull() & whole(f"{p}.actions").isNotNull()
    shapes = [("root", "$"), ("definition", "$.definition"), ("properties.definition", "$.properties.definition")]
    single = F.coalesce(*[F.when(fits(p), F.array(F.struct(F.lit(n).alias("shape"), whole(p).alias("d")))) for n, p in shapes])
    listed = F.expr(
        "transform(filter(try_variant_get(v, '$.resources', 'array<variant>'), r -> try_variant_get(r, '$.type', 'string') = 'Microsoft.Logic/workflows'),"
        " r -> struct('resources.definition' AS shape, try_variant_get(r, '$.properties.definition', 'variant') AS d))"
    )
    rows = d.select("path", F.explode(F.coalesce(single, listed)).alias("x")).select("path", "x.*")
    rows = rows.select("path", "shape", _vmap("d", "$.triggers").alias("triggers"), _vmap("d", "$.actions").alias("actions"))
    return rows.filter("triggers IS NOT NULL AND actions IS NOT NULL")


def workflow_triggers(defs: DataFrame) -> DataFrame:
    t = defs.select("path", F.explode("triggers").alias("name", "node"))
    freq, every = _vstr("node", "$.inputs.recurrence.frequency"), _vstr("node", "$.inputs.recurrence.interval")
    return t.select("path", "name", _vstr("node", "$.type").alias("type"), F.when(freq.isNotNull(), F.concat_ws("/", freq, every)).alias("schedule"))


# Action types that hold other actions.
CONTROL_TYPES = ("If", "Switch", "Foreach", "Scope", "Until", "Parallel", "ParallelBranch")
_BODIES = ("actions", "else", "cases", "default")


def _branches(node: dict) -> Iterator[tuple[str, dict]]:
    """Labelled action maps inside a control action."""
    kind = node.get("type")
    inside = lambda n: n.get("actions") if isinstance(n, dict) else None
    if kind == "If":
        found = [("If.True", inside(node)), ("If.False", inside(node.get("else")))]
    elif kind == "Switch":
        cases = node.get("cases")
        found = [(f"Switch.{k}", inside(c)) for k, c in (cases.items() if isinstance(cases, dict) else ())]
        found.append(("Switch.Default", inside(node.get("default"))))
    elif kind == "ParallelBranch":
        branches = (inside(node) or {}).get("branches") if isinstance(inside(node), dict) else None
        found = [(f"Parallel.Branch{i}", inside(b)) for i, b in enumerate(branches if isinstance(branches, list) else (), 1)]
    else:
        found = [(f"{kind}.Body", inside(node))] if kind in CONTROL_TYPES else []
    return ((label, body) for label, body in found if isinstance(body, dict))


def nested_actions(actions: dict) -> Iterator[tuple]:
    """``(parent, branch, depth, name, node without bodies)`` of all actions, to any depth."""
    todo = [(None, None, 0, actions)]
    while todo:
        parent, branch, depth, level = todo.pop()
        for name, node in level.items():
            inner = isinstance(node, dict)
            yield parent, branch, depth, name, {k: v for k, v in node.items() if k not in _BODIES} if inner else node
            if inner:
                todo += [(name, label, depth + 1, body) for label, body in _branches(node)]


# Where an action keeps what is read off it.
_LEAVES = {
    "type": ("type",), "method": ("inputs", "method"), "uri": ("inputs", "uri"), "at": ("inputs", "path"),
    "connection": ("inputs", "host", "connection", "name"), "api": ("inputs", "host", "apiId"),
}


def _action_row(row: tuple) -> tuple:
    """An action's place, its leaves, its ``runAfter`` names and, as JSON, the leaves that are no text."""
    *place, node = row
    found, odd = [], {}
    for leaf, keys in _LEAVES.items():
        value = node
        for k in keys:
            value = value.get(k) if isinstance(value, dict) else None
        if value is not None and not isinstance(value, str):
            odd[leaf], value = value, None
        found.append(value)
    after = node.get("runAfter") if isinstance(node, dict) else None
    return (*place, *found, sorted(after) if isinstance(after, dict) else None, json.dumps(odd) if odd else None)


def _walked(defs: DataFrame) -> DataFrame:
    """A row per action; ``started_by`` names the triggers of its workflow where it waits for nothing."""
    fields = [("path", pa.string()), ("parent", pa.string()), ("branch", pa.string()), ("depth", pa.int32()), ("name", pa.string())]
    fields += [(leaf, pa.string()) for leaf in _LEAVES]
    schema = pa.schema([*fields, ("run_after", pa.list_(pa.string())), ("odd", pa.string()), ("started_by", pa.list_(pa.string()))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, triggers, text in zip(*[b.column(i).to_pylist() for i in range(3)]):
                for action in nested_actions(json.loads(text)):
                    made = _action_row(action)
                    rows.append((path, *made, None if made[-2] else triggers))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)

    ddl = "path string, parent string, branch string, depth int, name string, " + ", ".join(f"{leaf} string" for leaf in _LEAVES)
    ddl += ", run_after array<string>, odd string, started_by array<string>"
    rows = defs.select("path", F.map_keys("triggers").alias("triggers"), F.to_json("actions").alias("actions")).mapInArrow(walk, ddl)
    other = F.when(F.col("odd").isNotNull(), F.parse_json("odd"))
    texts = {leaf: F.coalesce(F.col(leaf), F.try_variant_get(other, f"$.{leaf}", "string")) for leaf in _LEAVES}
    http = F.col("type").isin("Http", "HttpWebhook")
    connector = F.coalesce(F.when(http, F.lit("http")), "connection", F.substring_index("api", "/", -1), "type")
    child = F.when(F.col("uri").contains("/workflows/") & F.col("uri").contains("/triggers/") & F.col("uri").contains("/run"), F.col("uri"))
    return (
        rows.withColumns(texts)
        .withColumns({"method": F.upper("method"), "uri": F.when(http, F.col("uri")).otherwise(F.col("at")), "connector": connector})
        .withColumn("child_flow", child)
        .select("path", "parent", "branch", "depth", "name", "type", "method", "uri", "connector", "run_after", "child_flow", "started_by")
    )


def flatten_actions(defs: DataFrame) -> DataFrame:
    """Every action of a workflow, nested ones with their parent, branch and depth.

    Nesting is local to a file, so the walk is one map-only pass that also reads an action's leaves.
    """
    return _walked(defs).drop("started_by")


def control_edges(actions: DataFrame) -> DataFrame:
    return actions.filter("parent IS NOT NULL").select("path", "parent", "branch", F.col("name").alias("child"))


def workflow_relationships(defs: DataFrame) -> DataFrame:
    """Action -> target relationships, plus each trigger of a workflow -> every action of it that waits for nothing.

    Both are read off an action's row, so files are walked once and meet no join.
    """
    actions = _walked(defs)
    kind = tx.target_kind(F.col("connector"), F.col("uri"))
    a = actions.withColumn("kind", kind).withColumn("kind", F.when(F.col("kind").isNotNull() & F.col("child_flow").isNotNull(), "workflow").otherwise(F.col("kind")))
    op = tx.operation_for(F.col("kind"), F.col("name"), F.col("method"))
    own = F.when(F.col("kind").isNotNull(), F.array(F.struct(
        F.lit("action").alias("source_type"), F.col("name").alias("source"), "kind",
        tx.target_ref(F.col("connector"), F.col("uri"), F.lit(None).cast("string")).alias("ref"), op.alias("operation"),
    )))
    begun = F.transform("started_by", lambda t: F.struct(
        F.lit("trigger").alias("source_type"), t.alias("source"), F.lit("action").alias("kind"), F.col("name").alias("ref"), F.lit("calls").alias("operation")
    ))
    none = F.array().cast("array<struct<source_type: string, source: string, kind: string, ref: string, operation: string>>")
    rels = a.select("path", F.explode(F.concat(F.coalesce(own, none), F.coalesce(begun, none))).alias("r")).select("path", "r.*")
    return rels.withColumn("relation_id", tx.relation_id(F.col("source"), F.col("kind"), F.col("ref")))


# Binding type part -> target kind, tried in this order.
BINDING_KINDS = {"queue": "queue", "servicebus": "servicebus", "blob": "storage", "cosmosdb": "cosmosdb", "timer": "timer", "http": "http"}
_BINDING_REFS = ("queueName", "topicName", "collectionName", "containerName", "tableName", "path", "schedule")


def function_bindings(files: DataFrame) -> DataFrame:
    """Bindings of serverless functions: role (trigger / input / output), kind, ref, operation."""
    b = parsed(files).select("path", F.posexplode(_vlist("v", "$.bindings")).alias("pos", "b"))
    typ = F.lower(_vstr("b", "$.type"))
    kind = F.coalesce(*[F.when(F.col("type").contains(k), F.lit(v)) for k, v in BINDING_KINDS.items()])
    route = F.coalesce(_vstr("b", "$.route"), _vstr("b", "$.path"))
    rows = b.select("path", "pos", "b", typ.alias("type"), F.coalesce(_vstr("b", "$.direction"), F.lit("in")).alias("direction")).withColumn("kind", kind)
    ref = F.when(F.col("kind") == "http", F.regexp_replace(route, "^/+", "")).when(F.col("kind") == "timer", _vstr("b", "$.schedule")).otherwise(
        F.coalesce(*[_vstr("b", f"$.{k}") for k in _BINDING_REFS])
    )
    # queue-like triggers carry the queue, stores their own reference
    ref = F.when(F.col("kind") == "cosmosdb", _vstr("b", "$.collectionName")).when(F.col("kind") == "storage", F.coalesce(_vstr("b", "$.path"), _vstr("b", "$.tableName"))).otherwise(ref)
    out = F.col("direction") == "out"
    op = (
        F.when(out & F.col("kind").isin("queue", "servicebus", "event"), "publishes").when(out, "writes")
        .when(F.col("kind").isin("http", "queue"), "receives").otherwise("reads")
    )
    return rows.select("path", "pos", "type", "direction", "kind", ref.alias("ref"), op.alias("operation"))


ATTRIBUTE_RE = r"\[([A-Za-z]+(?:Trigger|DB))\(([^)]*)\)"


def attribute_bindings(files: DataFrame) -> DataFrame:
    """Bindings written as source attributes; the target is the first literal, or a named collection."""
    get = lambda g: F.regexp_extract_all("text", F.lit(ATTRIBUTE_RE), F.lit(g))
    rows = files.select("path", F.explode(F.arrays_zip(get(1).alias("attribute"), get(2).alias("args"))).alias("h")).select("path", "h.*")
    low = F.lower("attribute")
    kind = F.coalesce(*[F.when(low.contains(k), F.lit(v)) for k, v in BINDING_KINDS.items()])
    named = tx.blank_to_null(F.regexp_extract("args", r"(?i)CollectionName\s*=\s*\"([^\"]+)\"", 1))
    first = tx.blank_to_null(F.regexp_extract("args", r"\"([^\"]+)\"", 1))
    return rows.select("path", "attribute", kind.alias("kind"), F.coalesce(F.when(kind == "cosmosdb", named), first).alias("ref"))


# Serverless event -> kind of thing behind it.
EVENT_KINDS = {"http": "http", "httpapi": "http", "sqs": "queue", "sns": "topic", "schedule": "timer", "stream": "datastore", "s3": "datastore"}


def serverless_events(files: DataFrame) -> DataFrame:
    f = parsed(files).select("path", F.explode(_vmap("v", "$.functions")).alias("function", "node"))
    e = f.select("path", "function", F.posexplode(_vlist("node", "$.events")).alias("pos", "ev"))
    e = e.select("path", "function", "pos", F.explode(_vmap("ev")).alias("event", "cfg"))
    ref = F.coalesce(_vstr("cfg", "$.path"), F.substring_index(_vstr("cfg", "$.arn"), ":", -1), _vstr("cfg", "$.rate"), _vstr("cfg", "$.bucket"))
    return e.select(
        "path", "function", "pos", "event", tx.lookup(F.lower("event"), EVENT_KINDS, F.lit("event")).alias("kind"), ref.alias("ref"),
        F.upper(_vstr("cfg", "$.method")).alias("method"),
    )


def pipeline_facts(files: DataFrame) -> DataFrame:
    """CI facts in long form ``(path, fact, subject, value)``: triggers, schedules, steps,
    environments, needs and published artifacts."""
    jobs = F.map_entries(F.coalesce(_vmap("v", "$.jobs"), F.create_map().cast("map<string,variant>")))
    none = F.lit(None).cast("string")
    on = F.transform(F.map_keys(F.coalesce(_vmap("v", "$.on"), F.create_map().cast("map<string,variant>"))), lambda e: _fact("trigger", e, none))
    crons = F.transform(_list_or_empty(F.col("v"), "$.on.schedule"), lambda c: _fact("schedule", F.lit("schedule"), _get(c, "$.cron")))
    every = F.concat(on, crons, F.flatten(F.transform(jobs, lambda j: _job_facts(j["key"], j["value"]))))
    return parsed(files).select("path", F.explode(every).alias("f")).select("path", "f.*").filter("fact <> 'deploys_to' OR value IS NOT NULL")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _list_or_empty(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _fact(name: str, subject: Column, value: Column) -> Column:
    return F.struct(F.lit(name).alias("fact"), subject.alias("subject"), value.alias("value"))


def _job_facts(job: Column, body: Column) -> Column:
    """All facts of one CI job as an array, so that a file is parsed once."""
    env = tx.environment(F.coalesce(_get(body, "$.environment.name"), _get(body, "$.environment")))
    steps = _list_or_empty(body, "$.steps")
    connector = lambda s: F.coalesce(_get(s, "$.uses"), F.when(_get(s, "$.run").isNotNull(), F.lit("run")), _get(s, "$.shell"), F.lit("step"))
    named = lambda s, i: F.coalesce(_get(s, "$.name"), _get(s, "$.uses"), F.concat(job, F.lit(":"), (i + 1).cast("string")))
    uploads = F.filter(steps, lambda s: F.lower(_get(s, "$.uses")).contains("upload-artifact"))
    return F.concat(
        F.array(_fact("deploys_to", job, env)),
        F.transform(_list_or_empty(body, "$.needs"), lambda x: _fact("depends_on", job, x.cast("string"))),
        F.transform(steps, lambda s, i: _fact("step", named(s, i), connector(s))),
        F.transform(uploads, lambda s: _fact("publishes", job, _get(s, "$.with.name"))),
    )


def cluster_resources(files: DataFrame) -> DataFrame:
    """Images, config, secret and volume references of cluster manifests: ``(path, kind, role, ref)``."""
    d = parsed(files).withColumn("kind", _vstr("v", "$.kind"))
    low, name = F.lower("kind"), _vstr("v", "$.metadata.name")
    ref = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("ref"))
    env = lambda e: F.array(
        ref("datastore", _get(e, "$.valueFrom.secretKeyRef.name")), ref("datastore", _get(e, "$.valueFrom.configMapKeyRef.name"))
    )
    container = lambda c: F.concat(F.array(ref("service", _get(c, "$.image"))), F.flatten(F.transform(_list_or_empty(c, "$.env"), env)))
    volume = lambda x: F.array(
        *[ref("datastore", _get(x, p)) for p in ("$.configMap.name", "$.secret.secretName", "$.persistentVolumeClaim.claimName")]
    )
    v = F.col("v")
    workload = F.concat(
        F.flatten(F.transform(_list_or_empty(v, "$.spec.template.spec.containers"), container)),
        F.flatten(F.transform(_list_or_empty(v, "$.spec.template.spec.volumes"), volume)),
    )
    refs = (
        F.when(low.isin("configmap", "secret", "persistentvolumeclaim", "persistentvolume"), F.array(ref("datastore", name)))
        .when(low == "service", F.array(ref("service", name)))
        .when(low.isin("deployment", "statefulset", "daemonset", "job"), workload)
    )
    return d.select("path", "kind", F.explode(F.array_distinct(refs)).alias("r")).select("path", "kind", "r.*").filter("ref IS NOT NULL")


# Framework -> package that proves it.
FRAMEWORKS = {"nest": "@nestjs/core", "next": "next", "angular": "@angular/core", "react": "react", "aws-cdk": "aws-cdk-lib"}
DEPENDENCY_SECTIONS = ("dependencies", "devDependencies", "peerDependencies")


def _tag_section(deps: Column, section: str) -> Column:
    return F.transform_values(deps, lambda k, x: F.struct(x.alias("version"), F.lit(section).alias("section")))


def package_dependencies(files: DataFrame) -> DataFrame:
    """``(path, package, version, section)``: the first section naming a package wins.

    The three sections of one manifest are merged inside its row.
    """
    d = parsed(files)
    maps = [F.coalesce(F.expr(f"try_variant_get(v, '$.{s}', 'map<string,string>')"), F.create_map().cast("map<string,string>")) for s in DEPENDENCY_SECTIONS]
    tagged = [_tag_section(m, s) for m, s in zip(maps, DEPENDENCY_SECTIONS)]
    merged = tagged[0]
    for nxt in tagged[1:]:
        merged = F.map_zip_with(merged, nxt, lambda k, a, b: F.coalesce(a, b))
    return d.select("path", F.explode(merged).alias("package", "e")).select("path", "package", "e.version", "e.section")


def package_facts(files: DataFrame) -> DataFrame:
    """Frameworks and compiler facts of manifests that use TypeScript."""
    deps = F.map_concat(*[F.coalesce(F.expr(f"try_variant_get(v, '$.{s}', 'map<string,string>')"), F.create_map().cast("map<string,string>")) for s in ("dependencies",)])
    dev = F.coalesce(F.expr("try_variant_get(v, '$.devDependencies', 'map<string,string>')"), F.create_map().cast("map<string,string>"))
    names = F.array_union(F.map_keys(deps), F.map_keys(dev))
    d = parsed(files).withColumn("names", names).filter(F.array_contains("names", "typescript"))
    found = F.array_compact(F.array(*[F.when(F.array_contains("names", p), F.lit(n)) for n, p in FRAMEWORKS.items()]))
    scripts = F.map_filter(F.expr("try_variant_get(v, '$.scripts', 'map<string,string>')"), lambda k, c: c.rlike("ts-node|tsc|next|nest|vite|webpack"))
    return d.select(
        "path", _vstr("v", "$.name").alias("name"), F.array_join(found, ",").alias("frameworks"),
        F.array_join(F.slice(F.array_sort(F.map_keys(scripts)), 1, 10), ",").alias("scripts"), _vstr("v", "$.compilerOptions.target").alias("target"),
    )


# ---------------------------------------------------------------- key = value files and XML
def properties(files: DataFrame) -> DataFrame:
    """``(path, key, value)`` of ``key=value`` lines; comments and other lines are skipped, the last wins."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "l")).withColumn("l", F.trim("l"))
    lines = lines.filter((F.col("l") != "") & ~F.col("l").startswith("#") & F.contains("l", F.lit("=")))
    kv = lines.select("path", "pos", F.trim(F.substring_index("l", "=", 1)).alias("key"), F.trim(F.expr("substring(l, instr(l, '=') + 1)")).alias("value"))
    return kv.groupBy("path", "key").agg(F.max_by("value", "pos").alias("value"))


def resource_bindings(files: DataFrame) -> DataFrame:
    """Endpoint, datastore and queue of resource files given as plain lines."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    after = lambda x: F.trim(F.regexp_extract(x, "=(.*)$", 1))
    pick = lambda rx, pos: F.try_element_at(F.filter(F.col("ls"), lambda x: x.rlike(rx)), F.lit(pos))
    return files.select("path", lines.alias("ls")).select(
        "path", pick("(?i)http.*://|://.*http", 1).alias("endpoint"),
        after(pick("(?i)datasource|database|schema", -1)).alias("datastore"), after(pick("(?i)queue|destination", -1)).alias("queue"),
    )


# Fixed value: endpoint URLs in config files.
ENDPOINT_RE = r"(?i)https?://[^\s\"']{8,160}"


def config_endpoints(files: DataFrame) -> DataFrame:
    """Distinct ``(endpoint, path)`` pairs."""
    return files.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ENDPOINT_RE), F.lit(0)))).alias("endpoint"), "path")


XML_EXT = (".xml", ".bwp", ".bpmn", ".drawio", ".wsdl", ".xsd", ".odx", ".process")


def readable_xml(text: Column) -> Column:
    """The document below one more root element, NULL where it is malformed; prolog and DOCTYPE are left out.

    The extra root lets several top elements pass; paths that start with ``//`` find the same nodes.
    """
    body = F.regexp_replace(text, r"^\ufeff?\s*(?:<\?xml[^>]*\?>)?(?:\s*<!--(?s:.*?)-->)*\s*(?:<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>)?", "")
    wrapped = F.concat(F.lit("<r>"), body, F.lit("</r>"))
    bad = F.from_xml(wrapped, "_corrupt_record string", {"mode": "PERMISSIVE"})["_corrupt_record"]
    return F.when(bad.isNull(), wrapped)


def xml_attributes(files: DataFrame, specs: dict[str, str]) -> DataFrame:
    """``(path, fact, pos, value)`` for each named XPath over the file's text; malformed files give none."""
    files = files.select("path", readable_xml(F.col("text")).alias("text")).filter("text IS NOT NULL")
    each = F.array(*[F.struct(F.lit(name).alias("fact"), F.xpath("text", F.lit(xp)).alias("vals")) for name, xp in specs.items()])
    rows = files.select("path", F.explode(each).alias("s")).select("path", "s.fact", F.posexplode("s.vals").alias("pos", "value"))
    return rows.filter("value IS NOT NULL")


# The connector that a word in an activity's type stands for, first match wins.
PALETTE_HINTS = (
    ("httpreceiver", "http"), ("httpresponse", "http"), ("sendhttp", "http"), ("rest", "rest"), ("soap", "soap"), ("callprocess", "process"), ("invoke", "process"),
    ("mapper", "mapper"), ("jdbc", "jdbc"), ("sql", "jdbc"), ("jms", "jms"), ("timer", "timer"), ("log", "log"), ("error", "error"),
)
_ATTRS = r"((?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)"
_ELEMENT = rf"<([A-Za-z_][\w:.-]*){_ATTRS}\s*/?>"
_TRANSITION = rf"(?s)<((?:[\w.-]+:)?(?:transition|[\w.-]*Transition[\w.-]*)){_ATTRS}\s*(?:/>|>(.*?)</\1\s*>)"


def _attribute(attrs: Column, *names: str) -> Column:
    """The first of the attributes that is there, unescaped."""
    raw = [F.regexp_extract(attrs, rf"\s{n}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", g) for n in names for g in (1, 2)]
    found = F.coalesce(*[F.when(r != "", r) for r in raw])
    for code, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        found = F.replace(found, F.lit(code), F.lit(mark))
    return found


def process_activities(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Activities and transitions of process XML, in document order.

    Every named element is an activity, a name once; its type is an attribute or the tag, and a palette hint
    in the type gives the connector.  Ends of a transition are attributes or child elements, by name
    or by the id of a named element.  Malformed files give none.
    """
    plain = F.regexp_replace(readable_xml(F.col("text")), r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")
    src = files.select("path", plain.alias("x")).filter("x IS NOT NULL")
    every = lambda pattern, *groups: F.arrays_zip(*[F.regexp_extract_all("x", F.lit(pattern), F.lit(g)).alias(n) for n, g in groups])
    named = F.filter(
        F.transform(every(_ELEMENT, ("tag", 1), ("attrs", 2)), lambda e: F.struct(
            F.trim(_attribute(e["attrs"], "name", "displayName")).alias("name"), _attribute(e["attrs"], "xmi:id", "id").alias("ident"),
            F.coalesce(_attribute(e["attrs"], "type", "Type", "xmi:type"), e["tag"]).alias("type"))),
        lambda e: e["name"] != "",
    )
    src = src.select("path", named.alias("named"), every(_TRANSITION, ("attrs", 2), ("inner", 3)).alias("moves"))
    every_one = src.select("path", F.posexplode("named").alias("pos", "e")).select("path", "pos", "e.*")
    acts = ordered.first_per_key(every_one.drop("ident"), ["path", "name"], ["pos"]).select("path", "pos", F.struct("name", "type").alias("a"))
    low = F.lower("a.type")
    hint = F.coalesce(*[F.when(low.contains(word), connector) for word, connector in PALETTE_HINTS], F.when(F.col("a.type").contains("."), F.split_part("a.type", F.lit("."), F.lit(1))))
    acts = acts.select("path", "pos", "a.name", "a.type", hint.alias("connector"))

    def end(m: Column, names: tuple[str, ...], child: str) -> Column:
        inner = rf"<(?:[\w.-]+:)?{child}(?:\s[^>]*?\svalue|\s+value)?(?:\s*=\s*\"([^\"]*)\"[^>]*>|\s*>([^<]*)<)"
        nested = F.coalesce(*[F.when(F.regexp_extract(m["inner"], inner, g) != "", F.trim(F.regexp_extract(m["inner"], inner, g))) for g in (1, 2)])
        return F.coalesce(_attribute(m["attrs"], *names), nested)

    moves = src.select("path", F.explode("moves").alias("m"))
    moves = moves.select(
        "path", end(F.col("m"), ("from", "From", "source", "Source", "fromRef", "sourceRef"), "from").alias("src"),
        end(F.col("m"), ("to", "To", "target", "Target", "toRef", "targetRef"), "to").alias("dst"),
    ).filter("src IS NOT NULL AND dst IS NOT NULL")
    known = ordered.first_per_key(every_one.filter("ident IS NOT NULL").select("path", "ident", "pos", "name"), ["path", "ident"], ["pos"])
    for side in ("src", "dst"):  # an id stands for the name of its element
        moves = moves.join(known.select("path", F.col("ident").alias(side), F.col("name").alias("__name")), ["path", side], "left")
        moves = moves.withColumn(side, F.coalesce("__name", side)).drop("__name")
    return acts, moves.select("path", "src", "dst")


def start_activities(acts: DataFrame, moves: DataFrame) -> DataFrame:
    """First activity that no transition leads to, else the first of the document."""
    targets = moves.select("path", F.col("dst").alias("name")).distinct().withColumn("hit", F.lit(1))
    marked = acts.join(targets, ["path", "name"], "left")
    return marked.groupBy("path").agg(
        F.coalesce(F.min_by("name", F.when(F.col("hit").isNull(), F.col("pos"))), F.min_by("name", "pos")).alias("start")
    )


def flow_xml_facts(files: DataFrame) -> DataFrame:
    """Listeners, schedulers, requests, database operations and flow references of flow XML."""
    specs = {
        "listener": "//*[name()='http:listener']/@path", "scheduler": "//*[name()='scheduler']/@cron-expression",
        "request": "//*[name()='http:request']/@url", "db_write": "//*[name()='db:insert']/@table",
        "db_read": "//*[name()='db:select']/*[name()='db:sql']/text()", "flow_ref": "//flow-ref/@name",
    }
    rows = xml_attributes(files, specs)
    return rows.withColumn("value", F.when(F.col("fact") == "db_read", tx.sql_table_by_order(F.col("value"))).otherwise(F.col("value")))
