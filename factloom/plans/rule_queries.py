"""Findings, hypotheses, gates and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import vectors
from factloom.operators import joins, marts, retrieval, rules, signal_pass
from factloom.plans.mart_queries import _SHARED, _facts, _presence, _quality
from factloom.plans import views  # noqa: F401  (registers the shared views)
from factloom.plans.registry import query


@query("insecure_pages", "SELECT page_id, 'insecure_http' AS rule_id, 'high' AS severity, 'Insecure HTTP endpoint detected: ' || url AS message FROM pages WHERE url LIKE 'http://%'")
def insecure_pages(t):
    return rules.run_rules(t.pages.select("page_id", "url"), [rules.insecure_http()], ["page_id"])


_FINDINGS = """
    SELECT s.signal_id, s.file, 'missing_logging' AS rule_id, 'medium' AS severity FROM $signals s JOIN (SELECT signal_id, count(*) AS n FROM $steps GROUP BY 1) p ON p.signal_id = s.signal_id WHERE s.signal_id NOT IN (SELECT signal_id FROM $logging_rows)
    UNION ALL SELECT s.signal_id, s.file, 'insecure_http', 'high' FROM $signals s JOIN $steps p ON p.signal_id = s.signal_id WHERE p.url LIKE 'http://%'"""


def _findings(t):
    from factloom.operators import steps as st

    steps = t.view("steps", spread=True)
    n = steps.groupBy("signal_id").agg(F.count(F.lit(1)).alias("steps"))
    logs = st.logging(steps).groupBy("signal_id").agg(F.count(F.lit(1)).alias("logging"))
    sig = t.view("signals").select("signal_id", "name", "file", "component")
    per = sig.join(n, "signal_id").join(logs, "signal_id", "left")
    a = rules.run_rules(per, [rules.missing_logging()], ["signal_id", "file", "component"])
    urls = sig.join(steps.select("signal_id", "url"), "signal_id")
    return a.unionByName(rules.run_rules(urls, [rules.insecure_http()], ["signal_id", "file", "component"]))


@query("findings", f"SELECT rule_id, severity, count(*) AS n, count(DISTINCT signal_id) AS records FROM ({_FINDINGS}) GROUP BY 1, 2")
def findings(t):
    return _findings(t).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("signal_id").alias("records"))


@query("findings_by_group", f'SELECT s.family AS "group", f.rule_id, count(*) AS n FROM ({_FINDINGS}) f JOIN (SELECT DISTINCT family, file FROM $signals) s ON s.file = f.file GROUP BY 1, 2')
def findings_by_group(t):
    members = t.view("signals").select(F.col("family").alias("group"), "file")
    return joins.findings_by_group(_findings(t), members).groupBy("group", "rule_id").agg(F.count(F.lit(1)).alias("n"))


_SHARED_IDS = """
    SELECT i.signal_id, count(*) AS n FROM $identifier_rows i JOIN (SELECT identifier FROM $identifier_rows GROUP BY 1 HAVING count(DISTINCT signal_id) > 1) v ON v.identifier = i.identifier GROUP BY 1"""
_SENTENCES = " ".join(f"WHEN '{rule}' THEN '{sentence}'" for rule, sentence, *_ in (*rules.HYPOTHESES, rules.FALLBACK))


@query("hypotheses", f"""
    WITH p AS (SELECT component, count(*) FILTER (regexp_matches(lower(name), 'get|sort')) AS n FROM $signals GROUP BY 1),
    r AS (SELECT q.*, coalesce(s.n, 0) AS shared_data, coalesce(i.n, 0) AS shared_ids, p.n AS search_peers FROM $quality q LEFT JOIN ({_SHARED}) s ON s.signal_id = q.signal_id
      LEFT JOIN ({_SHARED_IDS}) i ON i.signal_id = q.signal_id LEFT JOIN p ON p.component = q.component)
    SELECT signal_id, rule, CASE rule {_SENTENCES} END AS hypothesis, CAST(score AS DOUBLE) AS score FROM (
      SELECT signal_id, 'orchestrates' AS rule, 0.45 AS score FROM r WHERE processes >= 2 UNION ALL SELECT signal_id, 'common_data', 0.35 FROM r WHERE shared_data > 0
      UNION ALL SELECT signal_id, 'shared_context', 0.3 FROM r WHERE shared_ids > 0
      UNION ALL SELECT signal_id, 'search_entry', 0.33 FROM r WHERE contains(lower(name), 'search') AND search_peers > 0
      UNION ALL SELECT signal_id, 'boundary', 0.32 FROM r WHERE interfaces > 0 AND services > 0
      UNION ALL SELECT signal_id, 'records', 0.25 FROM r WHERE datastores > 0
        AND NOT (processes >= 2 OR shared_data > 0 OR shared_ids > 0 OR (contains(lower(name), 'search') AND search_peers > 0) OR (interfaces > 0 AND services > 0)))""")
def hypotheses(t):
    found = _facts(t)
    stores = signal_pass.dependencies(found).filter("bucket = 'datastores'").select(F.col("signal_id").alias("process"), F.lit("datastore").alias("kind"), "value")
    ids = signal_pass.identifiers(found).select(F.col("signal_id").alias("process"), F.lit("identifier").alias("kind"), F.col("identifier").alias("value"))
    shared = marts.hub_edges(stores.unionByName(ids)).groupBy(F.col("process").alias("signal_id")).agg(
        F.count_if(F.col("kind") == "datastore").alias("shared_data"), F.count_if(F.col("kind") == "identifier").alias("shared_ids"))
    peers = t.view("signals").groupBy("component").agg(F.count_if(F.lower("name").rlike("get|sort")).alias("search_peers"))
    r = _quality(t).join(shared, "signal_id", "left").join(peers, "component", "left").fillna(0, ["shared_data", "shared_ids", "search_peers"])
    return rules.hypotheses(r.drop("score"), "signal_id").select("signal_id", "rule", "hypothesis", "score")


@query("evidence_gate", "SELECT component, count(*) FILTER (identifiers > 0 AND (invocations > 0 OR datastores + processes + services > 0) AND (errors > 0 OR logging > 0)) AS eligible, count(*) AS records FROM $quality GROUP BY 1")
def evidence_gate(t):
    return _quality(t).groupBy("component").agg(F.count_if(rules.enough_evidence()).alias("eligible"), F.count(F.lit(1)).alias("records"))


@query("coverage_shares", """
    SELECT *, calls_share >= 0.04 AS calls_ok, logging_share >= 0.04 AS logging_ok, errors_share >= 0.04 AS errors_ok FROM (
      SELECT round(avg(CASE WHEN services + processes > 0 THEN 1.0 ELSE 0.0 END), 4) AS calls_share, round(avg(CASE WHEN logging > 0 THEN 1.0 ELSE 0.0 END), 4) AS logging_share, round(avg(CASE WHEN errors > 0 THEN 1.0 ELSE 0.0 END), 4) AS errors_share FROM $presence)""")
def coverage_shares(t):
    return rules.coverage_shares(_presence(t))


# ---------------------------------------------------------------- retrieval
@query("vector_topk", """
    SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rn AS INT) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS rn FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings c) WHERE rn <= 6""")
def vector_topk(t):
    e = t.embeddings
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return retrieval.top_k(asked, chunks, 6).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("embedded_chunks", """
    SELECT doc_id, round(CAST(length(text) AS DOUBLE) / sqrt(CAST(length(text) AS DOUBLE) ** 2 + CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) ** 2), 6) AS score FROM documents WHERE text <> ''""")
def embedded_chunks(t):
    embed = vectors.embedding_udf(vectors.length_embedding)
    d = t.spread("documents").filter("text <> ''").select("doc_id", embed("text").alias("vector"))
    return d.select("doc_id", F.round(vectors.cosine(F.col("vector"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")), 6).alias("score"))


@query("retrieved_context", """
    WITH h AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS rn FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings c),
    x AS (SELECT query_id, rn, source || '#L1-L' || CAST(len(string_split(text, chr(10))) AS STRING) AS cite, least(length(text), 2000) AS n, sum(least(length(text), 2000)) OVER (PARTITION BY query_id ORDER BY rn) AS cum FROM h JOIN documents ON doc_id = chunk_id WHERE rn <= 6),
    y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rn) AS k FROM x)
    SELECT query_id, CAST(rn AS INT) AS rank, cite, CAST(n AS INT) AS chars FROM y WHERE k = 1 OR cum <= 3000""")
def retrieved_context(t):
    e = t.embeddings
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = retrieval.top_k(asked, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), 6)
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), "source", "text")
    cite = retrieval.citation(F.col("source"), F.lit(1), F.size(F.split("text", "\n")))
    rows = hits.join(docs, "chunk_id").select("query_id", "rank", cite.alias("cite"), "text")
    return retrieval.pack_context(rows, "query_id", ["rank"], 2000, 3000).select("query_id", "rank", "cite", F.length("text").alias("chars"))


@query("page_query_texts", """
    SELECT page_id, concat_ws(' ', regexp_extract(html, '<title>(.*?)</title>', 1), array_to_string(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1), ' ')) AS query_text FROM pages""")
def page_query_texts(t):
    sections = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    return t.pages.select("page_id", retrieval.query_text(F.regexp_extract("html", "<title>(.*?)</title>", 1), sections).alias("query_text"))
