"""String, path and id functions as Column expressions (all stay inside the JVM)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import vocab


def _any(conds) -> Column:
    return reduce(lambda a, b: a | b, conds)


def _has(c: Column, words) -> Column:
    return _any([c.contains(w) for w in words])


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def lookup(c: Column, mapping: dict, default: Column | None = None) -> Column:
    """Value of a fixed vocabulary as a literal map."""
    flat = [F.lit(x) for kv in mapping.items() for x in kv]
    hit = F.try_element_at(F.create_map(*flat), c)
    return hit if default is None else F.coalesce(hit, default)


# ------------------------------------------------------------------ names and paths
def normalize_component(c: Column) -> Column:
    safe = F.regexp_replace(F.trim(c), r"[^\p{L}\p{N}_-]", "_")
    return F.coalesce(blank_to_null(F.regexp_replace(safe, r"^[_-]+|[_-]+$", "")), F.lit("component"))


def first_named_part(path: Column) -> Column:
    """First path part that is neither generic nor a file name; folders win over the last part."""
    parts = F.split(path, "/")
    keep = lambda p: ~F.lower(p).isin(*vocab.GENERIC_PATH_PARTS) & ~p.contains(".")
    return F.try_element_at(F.filter(parts, keep), F.lit(1))


def derive_component(path: Column, root: Column, explicit: Column | None = None, hint: Column | None = None) -> Column:
    tries = [blank_to_null(c) for c in (explicit, hint) if c is not None]
    return normalize_component(F.coalesce(*tries, first_named_part(path), root))


def slug(c: Column, sep: str = "-", default: str | None = None) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", sep)
    s = F.regexp_replace(s, f"^{sep}+|{sep}+$", "")
    return F.coalesce(blank_to_null(s), F.lit(default)) if default else s


def file_slug(c: Column, cap: int = 200) -> Column:
    """File-name safe form that keeps case, dots and dashes."""
    s = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "[^A-Za-z0-9_.-]+", "_")
    return F.coalesce(blank_to_null(F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, cap)), F.lit("process"))


def infer_family(name: Column) -> Column:
    """Lower-cased dotted prefix of a process name, NULL when there is none."""
    dotted = F.regexp_extract(name, r"^([A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*)\.[^.]+$", 1)
    return F.lower(blank_to_null(dotted))


def family_from_path(path: Column) -> Column:
    """Second to last path part, lower-cased; the only part when there is one."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "META-INF"))
    return F.lower(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))))


def repo_bucket(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return blank_to_null(F.array_join(F.slice(parts, 1, 2), "/"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    return lookup(extension(path), vocab.LANGUAGE_BY_EXTENSION)


def artifact_type(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    name = F.substring_index(path, "/", -1)
    ext = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    has = lambda *w: F.arrays_overlap(parts, F.array(*[F.lit(x) for x in w]))
    return (
        F.when(has("test", "tests") | name.startswith("test_"), "test")
        .when(has("infra", "infrastructure") | ext.isin(".bicep", ".tf"), "infra")
        .when(has("config") | F.lower(name).isin("config.yaml", "config.json"), "config")
        .when(ext.isin(*vocab.CODE_EXTENSIONS), "code")
        .when(ext.isin(*vocab.INFRA_EXTENSIONS), "infra")
        .otherwise("artifact")
    )


def skip_file(path: Column, max_bytes: int | None = None, size: Column | None = None) -> Column:
    """True for files a scan leaves out."""
    name = F.substring_index(path, "/", -1)
    dirs = F.split(path, "/")
    skip = (
        name.startswith(vocab.SKIP_FILE_PREFIX)
        | name.endswith(vocab.SKIP_FILE_SUFFIX)
        | F.lower(name).isin(*vocab.SKIP_FILE_NAMES)
        | F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in vocab.SKIP_DIRS]))
    )
    return skip | (size > max_bytes) if max_bytes is not None else skip


def looks_binary(text: Column) -> Column:
    return F.instr(text, "\x00") > 0


# ------------------------------------------------------------------ identifiers and SQL
_ID_RE = "(?i)(" + "|".join(vocab.IDENTIFIER_SUFFIXES) + ")$"


def identifier_tokens(c: Column, suffixes=vocab.IDENTIFIER_SUFFIXES, word: str = "[A-Za-z0-9_]+") -> Column:
    """Sorted distinct words that end like an identifier."""
    rx = "(?i)(" + "|".join(suffixes) + ")$"
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(word), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda t: t.rlike(rx))))


def last_identifier(path: Column) -> Column:
    words = F.regexp_extract_all(F.coalesce(path, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.try_element_at(F.filter(words, lambda t: t.rlike(_ID_RE)), F.lit(-1))


_NAME = r"\s+([A-Za-z0-9_.\[\]\"`]+)"


def _after(sql: Column, word: str) -> Column:
    raw = F.regexp_extract(F.lower(sql), rf"\b{word}{_NAME}", 1)
    return blank_to_null(F.regexp_replace(raw, r"^[\[\]\"`]+|[\[\]\"`]+$", ""))


def sql_table_by_order(sql: Column) -> Column:
    """Primary table, first of from / into / update that is present."""
    return F.coalesce(_after(sql, "from"), _after(sql, "into"), _after(sql, "update"))


def sql_verb(sql: Column) -> Column:
    """First word of the statement, upper-cased."""
    return F.upper(F.regexp_extract(sql, r"^\s*(\S+)", 1))


def sql_table_by_verb(sql: Column) -> Column:
    """Primary table chosen by the statement's verb."""
    v = sql_verb(sql)
    return (
        F.when(v == "SELECT", _after(sql, "from"))
        .when(v.isin("INSERT", "DELETE"), F.coalesce(_after(sql, "into"), _after(sql, "from")))
        .when(v == "UPDATE", _after(sql, "update"))
    )


def sql_crud(verb: Column) -> Column:
    return F.when(verb.isin("INSERT", "UPDATE", "DELETE"), "write").otherwise("read")


def http_operation(method: Column) -> Column:
    m = F.upper(method)
    return (
        F.when(m == "GET", "reads")
        .when(m.isin("POST", "PUT", "PATCH"), "writes")
        .when(m == "DELETE", "deletes")
        .otherwise("calls")
    )


def operation_for(kind: Column, name: Column, method: Column) -> Column:
    """Operation of a relationship from its target kind, step name and method."""
    n, m = F.lower(F.coalesce(name, F.lit(""))), F.upper(F.coalesce(method, F.lit("")))
    stored = kind.isin("sql", "dataverse", "sharepoint")
    return (
        F.when(kind == "workflow", "invokes")
        .when(kind == "http", "calls")
        .when(stored & n.rlike("create|insert|add|update|patch|set|write"), "writes")
        .when(stored & n.rlike("delete|remove|drop"), "deletes")
        .when(stored, "reads")
        .when(m == "GET", "reads")
        .when(m.isin("POST", "PUT", "PATCH"), "writes")
        .otherwise("calls")
    )


def protocol_for(kind: Column) -> Column:
    return lookup(kind, vocab.PROTOCOL_BY_KIND, F.coalesce(kind, F.lit("")))


def crud_for(op: Column) -> Column:
    return lookup(op, vocab.CRUD_BY_OPERATION, F.lit(""))


def relation_role(kind: Column, op: Column) -> Column:
    stored = kind.isin("sql", "dataverse", "sharepoint")
    return (
        F.when(stored & (op == "reads"), "data.reads")
        .when(stored & op.isin("writes", "deletes"), "data.mutates")
        .when(kind == "http", "interface.calls")
        .when(kind == "workflow", "workflow.invokes")
        .when(kind == "action", "workflow.triggers")
    )


def target_kind(connector: Column, uri: Column) -> Column:
    """Kind of the thing a step talks to."""
    c, u = F.lower(F.coalesce(connector, F.lit(""))), F.coalesce(uri, F.lit(""))
    return (
        F.when(u.startswith("http"), "http")
        .when(c.isin("http", "shared_http", "apim", "apimmanaged"), "http")
        .when(_has(c, ("commondataservice", "dataverse")), "dataverse")
        .when(c.contains("sharepoint"), "sharepoint")
        .when(c.contains("sql"), "sql")
        .when(c.startswith("shared_"), F.replace(c, F.lit("shared_"), F.lit("")))
        .when(u != "", "http")
        .otherwise(blank_to_null(c))
    )


def target_ref(connector: Column, uri: Column, table: Column) -> Column:
    c, u, k = F.lower(F.coalesce(connector, F.lit(""))), blank_to_null(uri), target_kind(connector, uri)
    stored = k.isin("dataverse", "sharepoint", "sql") & ~F.coalesce(uri, F.lit("")).startswith("http")
    return (
        F.when(stored, F.coalesce(blank_to_null(table), u, c))
        .when(c.startswith("shared_") & ~(k == "http"), c)
        .otherwise(F.coalesce(u, blank_to_null(c)))
    )


# ------------------------------------------------------------------ URLs and routes
def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def trigger_workflow(url: Column) -> Column:
    return blank_to_null(F.regexp_extract(F.coalesce(url, F.lit("")), "/workflows/([^/]+)/triggers/([^/]+)/run", 1))


def table_in_path(url: Column) -> Column:
    return blank_to_null(F.regexp_extract(F.coalesce(url, F.lit("")), "(?i)/(?:tables|entities)/([^/?]+)", 1))


def compose_route(*parts: Column) -> Column:
    joined = F.concat_ws("/", *[blank_to_null(F.regexp_replace(p, "^/+|/+$", "")) for p in parts])
    return F.concat(F.lit("/"), F.regexp_replace(joined, "/{2,}", "/"))


def route_params(route: Column) -> Column:
    """Names written ``:name`` or ``{name}``."""
    found = F.regexp_extract_all(route, F.lit(r":([A-Za-z0-9_]+)|\{([A-Za-z0-9_]+)[^}]*\}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda p: F.regexp_extract(p, "([A-Za-z0-9_]+)", 1))))


# ------------------------------------------------------------------ secrets and markup
# Secret patterns and their masks.
MASK = "***REDACTED***"
SECRET_PATTERNS = (
    (r"(?i)\b(api[_-]?key|secret|token|password|passwd)\s*[:=]\s*([^\s\"']{8,})", r"$1: " + MASK),
    (r"AKIA[0-9A-Z]{16}", MASK),
    (r"(?i)((?:aws)?_?secret(?:_?access)?_?key)\s*[:=]\s*([A-Za-z0-9/+=]{8,})", r"$1: " + MASK),
    (r"([?&]sig=)[^&\s]+", r"$1" + MASK),
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", MASK),
)


def redact(c: Column) -> Column:
    for pattern, mask in SECRET_PATTERNS:
        c = F.regexp_replace(c, pattern, mask)
    return c


def strip_markup(c: Column) -> Column:
    """Unescape, drop tags, squeeze space."""
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(code), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))


# ------------------------------------------------------------------ evidence and ids
def parse_evidence(entry: Column) -> Column:
    """``path:start-end`` as a struct; start defaults to 1, end to start."""
    rx = r"^(.+?)(?::(\d+)(?:-(\d+))?)?$"
    e = F.trim(entry)
    start = F.coalesce(F.regexp_extract(e, rx, 2).try_cast("int"), F.lit(1))
    end = F.coalesce(F.regexp_extract(e, rx, 3).try_cast("int"), start)
    return F.when(
        e != "",
        F.struct(F.regexp_extract(e, rx, 1).alias("path"), start.alias("start_line"), end.alias("end_line")),
    )


MAX_SNIPPET_SPAN = 80


def clamp_lines(start: Column, end: Column, total: Column) -> Column:
    s = F.greatest(F.lit(1), start)
    e = F.least(F.greatest(s, end), s + MAX_SNIPPET_SPAN, total)
    return F.struct(s.alias("start_line"), e.alias("end_line"))


def record_id(name: Column, file_hash: Column, kind: Column) -> Column:
    raw = F.concat_ws("|", name, F.coalesce(file_hash, F.lit("nohash")), kind)
    return F.substring(F.sha2(raw, 256), 1, 16)


def relation_id(source: Column, kind: Column, ref: Column) -> Column:
    base = F.concat_ws("::", F.coalesce(source, F.lit("rel")), F.coalesce(kind, F.lit("unknown")), F.coalesce(ref, F.lit("")))
    return F.concat_ws(
        "_", slug(F.coalesce(source, F.lit("step")), "_", "step"), slug(F.coalesce(kind, F.lit("target")), "_", "target"),
        F.substring(F.sha1(base), 1, 8),
    )


# ------------------------------------------------------------------ words and labels
def split_identifier(c: Column) -> Column:
    """Lower-cased camel / snake words."""
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"), F.lit(0))
    return F.transform(words, lambda w: F.lower(w))


# Business verbs looked for in names and comments.
BUSINESS_VERBS = (
    "process", "calculate", "invoice", "bill", "charge", "refund", "assign", "approve", "authorize", "validate",
    "notify", "email", "dispatch", "schedule", "sync", "synchronize", "import", "export", "reconcile", "audit",
    "archive", "provision", "enrich", "integrate", "register", "escalate", "track", "report",
)


def business_verbs(c: Column, cap: int = 5) -> Column:
    """Bank verbs among the words of a name or comment, in order of first use."""
    bank = F.array(*[F.lit(v) for v in BUSINESS_VERBS])
    return F.slice(F.array_intersect(split_identifier(c), bank), 1, cap)


# Word endings that hint at a datastore or a service.
STORE_WORD = "(?i)^.*(table|collection|dataset|queue|repository|repo|store)$"
SERVICE_WORD = "(?i)^.*(service|client|api)$"


def hint_words(c: Column, rx: str, cap: int = 5) -> Column:
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: w.rlike(rx))), 1, cap)


def humanize_component(c: Column) -> Column:
    """Role name hidden in a component name, NULL when no role word is in it."""
    parts = F.regexp_extract_all(c, F.lit("[A-Z][a-z0-9]+|[A-Z]+(?=[A-Z]|$)"), F.lit(0))
    kept = F.filter(parts, lambda p: ~F.lower(p).isin(*vocab.COMPONENT_STOPWORDS))
    named = F.transform(kept, lambda p: lookup(F.lower(p), vocab.ROLE_KEYWORDS, p))
    return F.when(F.exists(kept, lambda p: F.lower(p).isin(*vocab.ROLE_KEYWORDS)), F.array_join(named, " "))


# Connector display names.
CONNECTOR_ALIASES = {
    "sql": "SQL Server",
    "shared_commondataserviceforapps": "Dataverse",
    "shared_office365": "Office 365 Outlook",
}


def connector_label(c: Column) -> Column:
    plain = F.initcap(F.replace(F.regexp_replace(c, "^shared_", ""), F.lit("_"), F.lit(" ")))
    return lookup(F.lower(c), CONNECTOR_ALIASES, plain)


# Environment words, tried in this order, and those with another short form.
ENVIRONMENT_WORDS = (
    "dev", "develop", "test", "qa", "stage", "staging", "uat", "preprod", "prod", "production", "preview",
)
ENVIRONMENT_ALIASES = {"develop": "dev", "production": "prod", "stage": "staging"}


def environment(c: Column) -> Column:
    """First environment word of the list found in the text, as its short form."""
    low = F.lower(c)
    hits = [F.when(low.rlike(rf"\b{w}\b"), F.lit(ENVIRONMENT_ALIASES.get(w, w))) for w in ENVIRONMENT_WORDS]
    return F.coalesce(*hits)


def workflow_engine(path: Column, text: Column) -> Column:
    p, t = F.lower(path), F.lower(text)
    return F.when(
        _has(p, ("solutions", "/flows/")) | _has(t, ("microsoft.flow", "connectionreferences")), "power_automate"
    ).otherwise("logicapps_standard")


# Names of steps that only wrap another step.
WRAPPER_STEPS = "(?i)^(extensionactivity|bwactivity|activityconfig)"


def prune_wrappers(steps: Column) -> Column:
    """Drop wrapper steps; keep all when nothing would be left."""
    kept = F.filter(steps, lambda s: ~s.rlike(WRAPPER_STEPS))
    return F.when(F.size(kept) == 0, steps).otherwise(kept)


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def substring_roles(connector: Column) -> Column:
    c = F.lower(connector)
    hits = [F.when(c.contains(k), F.array(*[F.lit(r) for r in v])) for k, v in vocab.SUBSTRING_ROLES.items()]
    return F.array_distinct(F.flatten(F.filter(F.array(*hits), lambda a: a.isNotNull())))


def has_role(role: str, connector: Column) -> Column:
    """Whether ``prefix_roles`` of a connector holds a role, as plain membership tests."""
    low = F.lower(connector)
    whole = [k for k, v in vocab.CONNECTOR_ROLES.items() if role in v]
    head = [k for k, v in vocab.PREFIX_ROLES.items() if role in v]
    hit = F.split_part(low, F.lit(":"), F.lit(1)).isin(*head)
    return F.coalesce(hit | low.isin(*whole) if whole else hit, F.lit(False))


def prefix_roles(connector: Column, step_type: Column | None = None) -> Column:
    """Roles of a step: whole connector name, then the part before a colon."""
    none = F.array().cast("array<string>")
    out = none
    for c in (connector, step_type):
        if c is None:
            continue
        low = F.lower(c)
        exact = {k: F.array(*[F.lit(r) for r in v]) for k, v in vocab.CONNECTOR_ROLES.items()}
        pref = {k: F.array(*[F.lit(r) for r in v]) for k, v in vocab.PREFIX_ROLES.items()}
        m1 = F.create_map(*[x for k, v in exact.items() for x in (F.lit(k), v)])
        m2 = F.create_map(*[x for k, v in pref.items() for x in (F.lit(k), v)])
        out = F.array_union(out, F.coalesce(F.try_element_at(m1, low), none))
        out = F.array_union(out, F.coalesce(F.try_element_at(m2, F.split_part(low, F.lit(":"), F.lit(1))), none))
    return out


def artifact_confidence(parsed: Column, schema_evidence: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.coalesce(parsed, F.lit(0.0)) + 0.5 * F.coalesce(schema_evidence, F.lit(0.0))), 3)


def priority(score: Column) -> Column:
    out = F.lit(vocab.LOWEST_BAND[0])
    for floor, p, _ in reversed(vocab.PRIORITY_BANDS):
        out = F.when(score >= floor, p).otherwise(out)
    return out


def band(score: Column) -> Column:
    out = F.lit(vocab.LOWEST_BAND[1])
    for floor, _, b in reversed(vocab.PRIORITY_BANDS):
        out = F.when(score >= floor, b).otherwise(out)
    return out


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(F.lower(a), F.lower(b)) / longest)
