"""The registered queries of this subpackage and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, elias_fano, exact_dedup, html_extract, merkle, packing, prefix_trie, quality, secret_scan, simhash, topk, toxicity, url_filter
from factloom.llm.common import fold_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


@query(
    "op5_exact_dedup",
    r"""
    WITH body AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
         best AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM body GROUP BY t)
    SELECT b.doc_id, g.keep_id, g.group_size, b.doc_id = g.keep_id AS kept, sha256(b.t) AS text_sha256
    FROM body b JOIN best g USING (t)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("digest", "text_sha256")


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op1_bpe_duckdb")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query("op4_elias_fano")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = elias_fano.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return elias_fano.read_ids(manifest)


@query(
    "op6_exact_topk",
    """
    WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
         s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
               FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
         r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op8_pack_pow2")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


@query("op2_toxic_segments")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 5)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "passages")


@query("op3_url_markov")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op7_quality_ftrl")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 4)
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), fold != 2)
    found = quality.score(docs, weights)
    return found.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op10_html_crf")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


#: DuckDB has no crc32: the reflected polynomial over the bytes of a decimal number.
CRC32 = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], [ord(x)::BIGINT FOR x IN string_split({}::VARCHAR, '')]),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT FOR i IN range(8)]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""


@query("op11_secret_trigrams", secret_scan.check_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = secret_scan.listed(F.filter("spans", lambda s: s["rule"] < len(secret_scan.BASE)))
    counts = [secret_scan.count_of(F.col("spans"), i).alias(f"n_{r.kind}") for i, r in enumerate(secret_scan.BASE)]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


@query(
    "op12_prefix_rollup",
    f"""
    WITH RECURSIVE
    own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
                   {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
            FROM conversations WHERE conv_id IS NOT NULL),
    conv AS (SELECT conv_id, conv_id - conv_id % 20 AS donor, {CRC32.format("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)),
    lent AS (SELECT c.conv_id, o.pos, o.t FROM conv c JOIN own o ON o.conv_id = c.donor AND o.pos < c.h),
    made AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY mine, pos) AS pos, t
             FROM (SELECT conv_id, 0 AS mine, pos, t FROM lent
                   UNION ALL SELECT o.conv_id, 1, o.pos, o.t FROM own o JOIN conv c USING (conv_id) WHERE o.pos >= c.h)),
    walk AS (SELECT conv_id, pos AS depth, list(t) OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM made
             UNION ALL SELECT conv_id, 0, [] FROM conv),
    size AS (SELECT conv_id, max(depth) AS size FROM walk GROUP BY conv_id),
    node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
             FROM walk JOIN size USING (conv_id) GROUP BY path, depth),
    kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
    part AS (SELECT n.path, n.depth, n_convs, coalesce(n_children, 0) AS n_children,
                    CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.path[-1].text, '[^\x20\x09-\x0D]+')) END AS saved
             FROM node n LEFT JOIN kids k ON k.path = n.path),
    sums AS (SELECT path[1:d] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
             FROM (SELECT *, unnest(range(depth + 1)) AS d FROM part) GROUP BY 1)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, q.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
           CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM node n JOIN part q ON q.path = n.path JOIN sums s ON s.path = n.path
    LEFT JOIN node p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefixes(table(spark, sf_dir, "conversations"))


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR))::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


@query(
    "op13_merkle_manifest",
    f"""
    WITH RECURSIVE
    leaf AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, {_leaf("text")} AS leaf,
                    CASE WHEN doc_id IS NOT NULL AND {CRC32.format("doc_id")} % 5 = 0
                         THEN {_leaf(f"translate(text, '{merkle.UPPER}', '{merkle.UPPER.lower()}')")} ELSE {_leaf("text")} END AS tampered FROM documents),
    low AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaf),
    up AS (SELECT 0 AS level, tree, idx, leaf AS h FROM low
           UNION ALL
           SELECT level + 1, tree, idx // 16, sha256(string_agg(h, '' ORDER BY idx))
           FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM up) WHERE n > 1 GROUP BY level, tree, idx // 16),
    sub AS (SELECT tree, arg_max(h, level) AS subroot, max(level) AS levels, row_number() OVER (ORDER BY tree) - 1 AS idx FROM up GROUP BY tree),
    top AS (SELECT 0 AS level, idx, subroot AS h FROM sub
            UNION ALL
            SELECT level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx))
            FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY level, idx // 16),
    every AS (SELECT level, tree, idx, h FROM up
              UNION ALL SELECT 1000 + level, '', idx, h FROM top),
    size AS (SELECT level, tree, count(*) AS n FROM every GROUP BY level, tree),
    fold AS (SELECT tree AS t, idx AS i, 0 AS level, tree, idx, tampered AS acc, '' AS sib, FALSE AS moved FROM low
             UNION ALL
             SELECT f.t, f.i, CASE WHEN z.n > 1 THEN f.level + 1 ELSE 1000 END, CASE WHEN z.n > 1 THEN f.tree ELSE '' END,
                    CASE WHEN z.n > 1 THEN f.idx // 16 ELSE any_value(s.idx) END,
                    CASE WHEN z.n > 1 THEN sha256(string_agg(CASE WHEN u.idx = f.idx THEN f.acc ELSE u.h END, '' ORDER BY u.idx)) ELSE f.acc END,
                    CASE WHEN z.n > 1 THEN f.sib || coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx <> f.idx), '') ELSE f.sib END, z.n = 1
             FROM fold f JOIN size z ON z.level = f.level AND z.tree = f.tree AND NOT (z.n = 1 AND f.level >= 1000)
             JOIN every u ON u.level = f.level AND u.tree = f.tree AND u.idx // 16 = f.idx // 16
             LEFT JOIN sub s ON s.tree = f.tree
             GROUP BY f.t, f.i, f.level, f.tree, f.idx, f.acc, f.sib, z.n),
    done AS (SELECT t, i, arg_max(acc, level) AS folded_root, arg_max(sib, level) AS sib FROM fold GROUP BY t, i)
    SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(d.sib) AS proof_sha256, d.folded_root, d.folded_root = r.root AS verified
    FROM low l JOIN sub s USING (tree) JOIN done d ON d.t = l.tree AND d.i = l.idx, (SELECT arg_max(h, level) AS root FROM top) r
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.verified(merkle.manifest(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
