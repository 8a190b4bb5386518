"""Join queries: calls, sharing, slices, diffs, snippets and fuzzy names."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import joins, marts, rollups
from factloom.operators import steps as st
from factloom.plans import step_queries  # noqa: F401  (registers the views of scaffolds)
from factloom.plans import views  # noqa: F401  (registers the shared views)
from factloom.plans.registry import query, view
from factloom.session import Rounds

# customers are processes: nation = component, segment = family, balance class = module
view("processes", """
    SELECT c_name AS process, n_name AS component, lower(c_mktsegment) AS family, CASE WHEN c_acctbal > 5000 THEN 'rich' END AS module, c_custkey AS custkey
    FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""")
view("uses", """
    SELECT DISTINCT c_name AS process, CASE WHEN l_linenumber % 2 = 0 THEN 'datastore' ELSE 'identifier' END AS kind, 'v' || CAST(l_suppkey AS STRING) AS value
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey""")
view("calls", """
    SELECT DISTINCT a.c_name AS src, b.c_name AS dst
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} a ON o_custkey = a.c_custkey JOIN {customer} b ON b.c_custkey = l_partkey""")


@query("http_call_join", r"""
    WITH s AS (SELECT DISTINCT 'page' || CAST(page_id AS STRING) AS workflow, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS path FROM pages),
    o AS (SELECT DISTINCT '/' || regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS path FROM pages)
    SELECT workflow, 'GET ' || s.path AS operation, 'calls' AS type FROM s JOIN o ON s.path = o.path""")
def http_call_join(t):
    p = t.pages
    steps = p.select(
        F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("workflow"), F.lit("get").alias("method"),
        F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)))).alias("h"),
    ).select("workflow", "method", F.concat(F.lit("http://site.local"), "h").alias("url"))
    first = F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]*)", 1)
    ops = p.select(F.concat(F.lit("/"), first).alias("path")).distinct().select("path", F.lit("GET").alias("method"), F.concat(F.lit("GET "), "path").alias("operation"))
    return joins.http_calls(steps, ops)


# ---------------------------------------------------------------- sharing
_HUBS = "SELECT kind, value, count(DISTINCT process) AS members FROM $uses GROUP BY 1, 2 HAVING count(DISTINCT process) > 1"


@query("shared_value_hubs", f"SELECT u.process, u.kind, u.value, h.members FROM $uses u JOIN ({_HUBS}) h ON h.kind = u.kind AND h.value = u.value")
def shared_value_hubs(t):
    return marts.hub_edges(t.view("uses")).select("process", "kind", "value", "members")


# every process whose number is divisible by 100 is asked for
_ASKED = "SELECT DISTINCT process FROM $uses WHERE CAST(regexp_extract(process, '([0-9]+)$', 1) AS BIGINT) % 100 = 0"


def _asked(t, uses=None):
    number = F.regexp_extract("process", "([0-9]+)$", 1).try_cast("bigint")
    return (uses or t.view("uses")).filter(number % 100 == 0).select("process").distinct()


@query("shared_pairs", f"SELECT DISTINCT a.process, b.process AS peer, a.kind, a.value FROM $uses a JOIN ({_ASKED}) q ON q.process = a.process JOIN $uses b ON b.kind = a.kind AND b.value = a.value AND b.process <> a.process")
def shared_pairs(t):
    return marts.shared_with(t.view("uses"), _asked(t))


@query("dependency_slice", f"""
    WITH q AS ({_ASKED})
    SELECT DISTINCT process, relation, peer FROM (
      SELECT src AS process, 'calls' AS relation, dst AS peer FROM $calls WHERE src IN (SELECT process FROM q)
      UNION ALL SELECT dst, 'called_by', src FROM $calls WHERE dst IN (SELECT process FROM q) AND src <> dst
      UNION ALL SELECT a.process, 'shared_' || a.kind || '_with', b.process FROM $uses a JOIN $uses b ON b.kind = a.kind AND b.value = a.value AND b.process <> a.process WHERE a.process IN (SELECT process FROM q)
      UNION ALL SELECT a.process, 'component_peers', b.process FROM $processes a JOIN $processes b ON a.component = b.component AND a.process <> b.process WHERE a.process IN (SELECT process FROM q)
      UNION ALL SELECT a.process, 'family_peers', b.process FROM $processes a JOIN $processes b ON a.family = b.family AND a.process <> b.process WHERE a.process IN (SELECT process FROM q)
      UNION ALL SELECT a.process, 'module_peers', b.process FROM $processes a JOIN $processes b ON a.module = b.module AND a.process <> b.process WHERE a.process IN (SELECT process FROM q))""")
def dependency_slice(t):
    uses = t.kept("uses", lambda: Rounds(t.spark).keep(t.view("uses")))
    return marts.dependency_slice(t.view("processes"), t.view("calls"), uses, _asked(t, uses))


@query("process_memberships", """
    WITH m AS (SELECT process, 'component' AS level, component AS grp FROM $processes UNION ALL SELECT process, 'family', family FROM $processes UNION ALL SELECT process, 'module', module FROM $processes WHERE module IS NOT NULL)
    SELECT m.level, m.grp AS "group", count(*) AS members FROM m GROUP BY 1, 2 HAVING count(*) > 1""")
def process_memberships(t):
    return marts.memberships(t.view("processes")).groupBy("level", "group").agg(F.count(F.lit(1)).alias("members"))


@query("process_graph", f"""
    SELECT 'calls' AS kind, count(*) AS n FROM $calls UNION ALL SELECT 'datastore_dep', count(*) FROM $uses WHERE kind = 'datastore'
    UNION ALL SELECT 'shared_' || kind, CAST(sum(members) AS BIGINT) FROM ({_HUBS}) GROUP BY 1
    UNION ALL SELECT 'component_member', count(*) FROM $processes UNION ALL SELECT 'family_member', count(*) FROM $processes UNION ALL SELECT 'module_member', count(*) FROM $processes WHERE module IS NOT NULL""")
def process_graph(t):
    calls = t.view("calls").select(F.lit("calls").alias("kind"), "src", "dst")
    uses = t.view("uses")
    deps = uses.filter("kind = 'datastore'").select(F.lit("datastore_dep").alias("kind"), F.col("process").alias("src"), F.col("value").alias("dst"))
    hubs = marts.hub_edges(uses).select(F.concat(F.lit("shared_"), "kind").alias("kind"), F.col("process").alias("src"), F.col("value").alias("dst"))
    mem = marts.memberships(t.view("processes")).select(F.concat("level", F.lit("_member")).alias("kind"), F.col("process").alias("src"), F.col("group").alias("dst"))
    return calls.unionByName(deps).unionByName(hubs).unionByName(mem).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# what a process offers: the interfaces of its orders
view("offers", """
    SELECT DISTINCT c_name AS process, kind, coalesce(method, '') AS method, coalesce(endpoint, '') AS endpoint FROM $interface_rows i JOIN {orders} ON o_orderkey = signal_id JOIN {customer} ON c_custkey = o_custkey""")


def _offers(t):
    made = st.interfaces(t.view("steps", spread=True), t.view("triggers"))
    owner = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("signal_id"), F.col("c_name").alias("process"))
    return rollups.family_interfaces(t.view("processes"), made.join(owner, "signal_id"))


@query("family_interfaces", "SELECT family, o.process, kind, method, endpoint FROM $offers o JOIN $processes p ON p.process = o.process")
def family_interfaces(t):
    return _offers(t)


@query("family_insights", """
    SELECT p.family, p.members, coalesce(s.ds, 0) AS shared_datastores, coalesce(s.ids, 0) AS shared_identifiers, coalesce(c.intra, 0) AS intra_calls, coalesce(c.crosses, 0) AS cross_calls, coalesce(i.n, 0) AS interfaces
    FROM (SELECT family, count(*) AS members FROM $processes GROUP BY 1) p
    LEFT JOIN (SELECT family, count(*) FILTER (kind = 'datastore') AS ds, count(*) FILTER (kind = 'identifier') AS ids FROM (SELECT family, kind, value FROM $uses u JOIN $processes p ON p.process = u.process GROUP BY 1, 2, 3 HAVING count(*) > 1) GROUP BY 1) s ON s.family = p.family
    LEFT JOIN (SELECT a.family, count(*) FILTER (a.family = b.family) AS intra, count(*) FILTER (a.family IS DISTINCT FROM b.family) AS crosses FROM $calls c JOIN $processes a ON a.process = c.src LEFT JOIN $processes b ON b.process = c.dst GROUP BY 1) c ON c.family = p.family
    LEFT JOIN (SELECT family, count(*) AS n FROM $offers o JOIN $processes p ON p.process = o.process GROUP BY 1) i ON i.family = p.family""")
def family_insights(t):
    own = marts.family_insights(t.view("processes"), t.view("calls"), t.view("uses"))
    offers = _offers(t).groupBy("family").agg(F.count(F.lit(1)).alias("interfaces"))
    return own.join(offers, "family", "left").fillna(0, ["interfaces"])


@query("cross_family_calls", """
    WITH c AS (SELECT a.family, b.family AS to_family, c.src || ' -> ' || c.dst AS sample, row_number() OVER (PARTITION BY a.family, b.family ORDER BY c.src || ' -> ' || c.dst) AS rn
      FROM $calls c JOIN $processes a ON a.process = c.src JOIN $processes b ON b.process = c.dst WHERE a.family <> b.family)
    SELECT family, to_family, count(*) AS calls, string_agg(sample, '; ' ORDER BY sample) FILTER (rn <= 3) AS samples FROM c GROUP BY 1, 2""")
def cross_family_calls(t):
    return marts.cross_family_calls(t.view("processes"), t.view("calls"))


_HELD = "SELECT family, kind, value, count(*) AS users FROM $uses u JOIN $processes p ON p.process = u.process GROUP BY 1, 2, 3"


@query("cross_family_values", f"""
    WITH h AS ({_HELD}) SELECT DISTINCT least(a.family, b.family) AS fam_a, greatest(a.family, b.family) AS fam_b, a.kind, a.value FROM h a JOIN h b ON a.kind = b.kind AND a.value = b.value AND a.family <> b.family""")
def cross_family_values(t):
    asked = t.view("processes").select("family").distinct()
    return marts.cross_family_values(t.view("processes"), t.view("uses"), asked)


@query("repository_overview", f"""
    WITH h AS ({_HELD}) SELECT 'shared_' || kind AS section, fam_a, fam_b, count(*) AS n FROM (SELECT DISTINCT least(a.family, b.family) AS fam_a, greatest(a.family, b.family) AS fam_b, a.kind, a.value FROM h a JOIN h b ON a.kind = b.kind AND a.value = b.value
      AND (a.family <> b.family OR a.users > 1)) GROUP BY 1, 2, 3
    UNION ALL SELECT 'members', family, NULL, count(*) FROM $processes GROUP BY 2
    UNION ALL SELECT 'calls', a.family, b.family, count(*) FROM $calls c JOIN $processes a ON a.process = c.src JOIN $processes b ON b.process = c.dst WHERE a.family <> b.family GROUP BY 2, 3""")
def repository_overview(t):
    fams = t.view("processes").select("family").distinct()
    v = marts.cross_family_values(t.view("processes"), t.view("uses"), fams, same_family=True)
    return rollups.repository_overview(t.view("processes"), t.view("calls"), v)


@query("nation_cross_calls", """
    SELECT s.n_name AS family, c.n_name AS to_family, count(*) AS calls FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
      JOIN nation s ON s.n_nationkey = s_nationkey JOIN nation c ON c.n_nationkey = c_nationkey WHERE s.n_name <> c.n_name GROUP BY 1, 2""")
def nation_cross_calls(t):
    # the fact join is pre-aggregated to key pairs before names are looked up
    li = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = li.filter("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(F.count(F.lit(1)).alias("calls"))
    a = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("family"))
    b = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("to_family"))
    return n.join(a, "s_nationkey").join(b, "c_nationkey").select("family", "to_family", "calls")


# ---------------------------------------------------------------- prefixes and groups
@query("prefix_modules", """
    WITH r AS (SELECT DISTINCT regexp_replace(path, '/[^/]+$', '') AS root FROM $doc_paths WHERE path LIKE '%.json' UNION SELECT DISTINCT split_part(path, '/', 1) FROM $doc_paths WHERE path LIKE '%.tf'),
    m AS (SELECT d.doc_id, max_by(string_split(r.root, '/')[-1], length(r.root)) AS module FROM $doc_paths d JOIN r ON d.path = r.root OR starts_with(d.path, r.root || '/') GROUP BY 1)
    SELECT d.doc_id, m.module FROM $doc_paths d LEFT JOIN m ON m.doc_id = d.doc_id""")
def prefix_modules(t):
    d = t.view("doc_paths").select("doc_id", "path")
    roots = d.filter(F.col("path").endswith(".json")).select(F.regexp_replace("path", "/[^/]+$", "").alias("root")).union(
        d.filter(F.col("path").endswith(".tf")).select(F.split_part("path", F.lit("/"), F.lit(1)))
    ).distinct()
    return joins.owning_module(d, roots.withColumn("module", F.substring_index("root", "/", -1)), "doc_id").select("doc_id", "module")


@query("group_assignment", """
    WITH rec AS (SELECT doc_id AS record_id, CASE WHEN doc_id % 3 = 0 THEN source END AS component, path AS file FROM $doc_paths),
    art AS (SELECT repo_path AS prefix, min(component) AS component FROM (SELECT 'src/' || source AS repo_path, source AS component FROM documents UNION SELECT 'services/' || source, 'svc-' || source FROM documents) GROUP BY 1)
    SELECT record_id, component AS "group" FROM rec WHERE component IS NOT NULL
    UNION ALL SELECT r.record_id, coalesce(min(a.component), 'ungrouped') FROM rec r LEFT JOIN art a ON starts_with(r.file, a.prefix) WHERE r.component IS NULL GROUP BY 1""")
def group_assignment(t):
    rec = t.view("doc_paths").select(F.col("doc_id").alias("record_id"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("component"), F.col("path").alias("file"))
    src = t.documents.select("source").distinct()
    art = src.select(F.concat(F.lit("src/"), "source").alias("repo_path"), F.col("source").alias("component")).unionByName(
        src.select(F.concat(F.lit("services/"), "source").alias("repo_path"), F.concat(F.lit("svc-"), "source").alias("component"))
    )
    return joins.assign_groups(rec, art)


# ---------------------------------------------------------------- evidence
view("doc_evidence", """
    SELECT doc_id AS record_id, CAST(k AS BIGINT) AS pos, 'doc:' || CAST(doc_id AS STRING) AS path, doc_id % 12 + k * 3 AS s, doc_id % 12 + k * 3 + doc_id % 5 AS e
    FROM {documents}, (SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 6) WHERE doc_id % 4 <> 0""")

_SNIP = """
    WITH f AS (SELECT 'doc:' || CAST(doc_id AS STRING) AS path, string_split(text, chr(10)) AS ls FROM documents),
    j AS (SELECT record_id, pos, f.path, greatest(1, s) AS st, least(greatest(greatest(1, s), e), greatest(1, s) + 80, len(ls)) AS en, ls FROM $doc_evidence v JOIN f ON f.path = v.path),
    x AS (SELECT record_id, pos, path, st, en, array_to_string(ls[st:en], chr(10)) AS text FROM j WHERE en >= st),
    r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pos) AS rn FROM x WHERE trim(text) <> '')"""


def _snippets(t):
    ev = t.view("doc_evidence").select("record_id", "pos", F.concat("path", F.lit(":"), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string")).alias("entry"))
    files = t.documents.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("path"), "text")
    return joins.evidence_snippets(ev, files), files


@query("evidence_snippets", f"""{_SNIP},
    u AS (SELECT record_id, pos, CAST(st AS INT) AS start_line, CAST(en AS INT) AS end_line, md5(text) AS text_md5 FROM r WHERE rn <= 4)
    SELECT * FROM u UNION ALL SELECT doc_id, -1, 1, CAST(least(80, len(string_split(text, chr(10)))) AS INT), md5(array_to_string(string_split(text, chr(10))[1:80], chr(10))) FROM documents WHERE doc_id NOT IN (SELECT record_id FROM u) AND trim(text) <> ''""")
def evidence_snippets(t):
    snips, files = _snippets(t)
    recs = t.documents.select(F.col("doc_id").alias("record_id"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("file"))
    return joins.with_fallback(recs, snips, files).select("record_id", "pos", "start_line", "end_line", F.md5("text").alias("text_md5"))


@query("evidence_packets", f"""{_SNIP},
    p AS (SELECT d.source AS "group", r.record_id, r.pos, row_number() OVER (PARTITION BY d.source ORDER BY r.record_id, r.pos) AS n FROM r JOIN documents d ON d.doc_id = r.record_id WHERE rn <= 4)
    SELECT "group", record_id, pos FROM p WHERE n <= 50""")
def evidence_packets(t):
    snips, _ = _snippets(t)
    member = t.documents.select(F.col("doc_id").alias("record_id"), F.col("source").alias("group"))
    return joins.packet_snippets(snips, member).select("group", "record_id", "pos")


view("conv_evidence", """
    SELECT conv_id AS record_id, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS section, role AS label, turn AS pos, substr(text, 1, 20) AS entry FROM {conversations}""")


@query("evidence_index", """
    SELECT CAST(record_id AS STRING) || CASE section WHEN 0 THEN '#e' WHEN 1 THEN '#role-' || label || '-e' ELSE '#' || label || '-e' END || CAST(row_number() OVER (PARTITION BY record_id ORDER BY section, pos) - 1 AS STRING) AS evidence_id, record_id, entry FROM $conv_evidence""")
def evidence_index(t):
    return joins.evidence_index(t.view("conv_evidence"))


@query("pruned_claims", """
    WITH c AS (SELECT conv_id AS claim_id, CAST(conv_id AS STRING) || '#e' || CAST(turn % 3 AS STRING) AS evidence_id FROM conversations),
    k AS (SELECT CAST(record_id AS STRING) || CASE section WHEN 0 THEN '#e' WHEN 1 THEN '#role-' || label || '-e' ELSE '#' || label || '-e' END || CAST(row_number() OVER (PARTITION BY record_id ORDER BY section, pos) - 1 AS STRING) AS evidence_id FROM $conv_evidence)
    SELECT claim_id, evidence_id, count(*) AS n FROM c WHERE evidence_id IN (SELECT evidence_id FROM k) GROUP BY 1, 2""")
def pruned_claims(t):
    claims = t.conversations.select(F.col("conv_id").alias("claim_id"), F.concat(F.col("conv_id").cast("string"), F.lit("#e"), (F.col("turn") % 3).cast("string")).alias("evidence_id"))
    known = joins.evidence_index(t.view("conv_evidence"))
    return joins.prune_evidence(claims, known).groupBy("claim_id", "evidence_id").agg(F.count(F.lit(1)).alias("n"))


@query("packet_overlap", "SELECT DISTINCT 'packet-' || lang AS packet FROM documents WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def packet_overlap(t):
    hits = t.documents.join(t.labels.filter("toxic = 1"), "doc_id", "left_semi").select(F.col("source").alias("component"))
    packets = t.documents.select(F.concat(F.lit("packet-"), "lang").alias("packet"), F.col("source").alias("component")).distinct()
    return joins.overlapping_packets(hits, packets)


@query("orphan_records", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_records(t):
    return joins.unmatched(t.documents.select("doc_id", "source"), t.labels, ["doc_id"])


# benchmark passages inside documents: word 5-shingles meet by equality


@query("benchmark_passages", """
    WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM benchmark), bs AS (SELECT item_id, unnest(list_transform(generate_series(1, greatest(0, len(w) - 4)), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM b),
    d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents), ds AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(0, len(w) - 4)), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM d)
    SELECT doc_id FROM ds WHERE sh IN (SELECT sh FROM bs) GROUP BY 1""")
def benchmark_passages(t):
    def shingles(df, key):
        words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        w = df.select(key, words.alias("w")).filter("size(w) >= 5")
        return w.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.array_join(F.slice(F.col("w"), i, 5), " ")))).alias("evidence_id"))

    return joins.prune_evidence(shingles(t.spread("documents"), "doc_id"), shingles(t.benchmark, "item_id")).select("doc_id").distinct()


# ---------------------------------------------------------------- snapshots, names
@query("snapshot_diff", """
    WITH b AS (SELECT o_custkey AS key, min(c_mktsegment) AS component, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '1997-06-01' GROUP BY 1),
    a AS (SELECT o_custkey AS key, min(c_mktsegment) AS component, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '1999-01-01' AND o_custkey % 11 <> 0 GROUP BY 1)
    SELECT coalesce(a.component, b.component) AS component, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' ELSE 'modified' END AS change, count(*) AS n, CAST(sum(coalesce(a.orders, 0) - coalesce(b.orders, 0)) AS BIGINT) AS delta
    FROM a FULL JOIN b ON a.key = b.key WHERE a.orders IS DISTINCT FROM b.orders GROUP BY 1, 2""")
def snapshot_diff(t):
    o = t.orders.select("o_custkey", "o_orderdate").join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))

    def state(cond):
        return o.filter(cond).groupBy(F.col("o_custkey").alias("key")).agg(F.min("c_mktsegment").alias("component"), F.count(F.lit(1)).alias("orders"))

    d = joins.snapshot_diff(state("o_orderdate < TIMESTAMP '1997-06-01'"), state("o_orderdate < TIMESTAMP '1999-01-01' AND o_custkey % 11 <> 0"), "key")
    delta = F.coalesce("now.orders", F.lit(0)) - F.coalesce("previous.orders", F.lit(0))
    return d.groupBy(F.coalesce("now.component", "previous.component").alias("component"), "change").agg(F.count(F.lit(1)).alias("n"), F.sum(delta).alias("delta"))


_CHANGES = """
    WITH b AS (SELECT o_orderkey AS key, o_orderpriority AS component, o_orderstatus AS s, o_totalprice AS v FROM orders WHERE o_orderkey % 5 <> 0), a AS (SELECT o_orderkey AS key, o_orderpriority AS component, o_orderstatus AS s, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT coalesce(a.component, b.component) AS component, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' ELSE 'modified' END || CASE WHEN coalesce(a.s, b.s) = 'F' THEN '_workflows' ELSE '_integrations' END AS list,
      coalesce(a.key, b.key) AS key FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.v <> b.v"""


def _change_entries(t):
    kind = F.when(F.col("o_orderstatus") == "F", "workflows").otherwise("routes").alias("kind")
    o = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("component"), kind, F.col("o_totalprice").alias("v"))
    now = o.filter("key % 3 <> 0").withColumn("v", F.when(F.col("key") % 7 == 0, 0.0).otherwise(F.col("v")))
    d = joins.snapshot_diff(o.filter("key % 5 <> 0"), now, "key")
    return rollups.change_entries(d.select("key", "change", *[F.coalesce("now." + c, "previous." + c).alias(c) for c in ("component", "kind")]))


@query("component_change_lists", _CHANGES)
def component_change_lists(t):
    return _change_entries(t)


@query("component_changes", "SELECT component, " + ", ".join(f"count(*) FILTER (list = '{c}_{k}') AS {c}_{k}" for k in ("workflows", "integrations") for c in ("added", "removed", "modified")) + f" FROM ({_CHANGES}) GROUP BY 1")
def component_changes(t):
    return rollups.change_counts(_change_entries(t))


@query("name_matches", "SELECT p_partkey, p_brand AS workflow FROM part WHERE regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') IN ('brand1', 'brand7', 'brand22')")
def name_matches(t):
    flows = t.part.filter(F.col("p_brand").isin("Brand#1", "Brand#7", "Brand#22")).select(F.upper(F.replace("p_brand", F.lit("#"), F.lit(" - "))).alias("name"))
    return joins.name_matches(t.part.select("p_partkey", F.col("p_brand").alias("workflow")), flows, 3)


_SIDES = """
    a AS (SELECT DISTINCT lower(replace(p_name, ' ', '')) AS a FROM part), b AS (SELECT DISTINCT lower(p_type || replace(p_name, ' ', '_')) AS b FROM part UNION SELECT DISTINCT lower(split_part(p_name, ' ', 2) || 's') FROM part UNION SELECT DISTINCT lower(reverse(split_part(p_name, ' ', 1)) || split_part(p_name, ' ', 2)) FROM part)"""


@query("fuzzy_part_names", f"""
    WITH {_SIDES} SELECT a, b, 1.0 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) AS ratio FROM a, b WHERE 1.0 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) >= 0.6""")
def fuzzy_part_names(t):
    p = t.part
    a = p.select(F.lower(F.replace("p_name", F.lit(" "), F.lit(""))).alias("a"))
    w1, w2 = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    b = p.select(F.lower(F.concat("p_type", F.replace("p_name", F.lit(" "), F.lit("_")))).alias("b")).union(p.select(F.lower(F.concat(w2, F.lit("s"))))).union(p.select(F.lower(F.concat(F.reverse(w1), w2))))
    return joins.fuzzy_pairs(a, b, 0.6)


@query("marker_matches", r"""
    WITH n AS (SELECT DISTINCT replace(p_name, ' ', '-') AS node_slug FROM part), m AS (SELECT DISTINCT 'Workflow:' || split_part(p_name, ' ', 2) AS marker FROM part UNION SELECT DISTINCT 'API:' || replace(p_name, ' ', '-') FROM part)
    SELECT 'slug' AS policy, node_slug, marker FROM n, m WHERE contains(replace(node_slug, '-', ''), replace(lower(split_part(marker, ':', 2)), '-', ''))
    UNION ALL SELECT 'exact', node_slug, marker FROM n, m WHERE node_slug = lower(replace(marker, ':', '_')) OR node_slug = lower(marker)
    UNION ALL SELECT 'fuzzy', node_slug, marker FROM n, m WHERE greatest(1.0 - levenshtein(node_slug, lower(marker))::DOUBLE / greatest(length(node_slug), length(marker)),
      1.0 - levenshtein(node_slug, lower(split_part(marker, ':', 2)))::DOUBLE / greatest(length(node_slug), length(split_part(marker, ':', 2))), 1.0 - levenshtein(node_slug, lower(replace(marker, ':', '_')))::DOUBLE / greatest(length(node_slug), length(marker))) >= 0.8 - 1e-12""")
def marker_matches(t):
    p = t.part
    nodes = p.select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("node_slug"))
    markers = p.select(F.concat(F.lit("Workflow:"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("marker")).union(p.select(F.concat(F.lit("API:"), F.replace("p_name", F.lit(" "), F.lit("-")))))
    out = None
    for policy in ("slug", "exact", "fuzzy"):
        part = joins.match_markers(nodes, markers, policy, 0.8).select(F.lit(policy).alias("policy"), "node_slug", "marker")
        out = part if out is None else out.unionByName(part)
    return out
