"""Block top-k search against brute force."""

import math
import random

from pyspark.sql import functions as F

from factloom.operators import retrieval


def brute(queries, chunks, k):
    def cosine(a, b):
        if not a or not b or len(a) != len(b):
            return 0.0
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / (na * nb) if na > 0 and nb > 0 else 0.0

    out = {}
    for q, a in queries:
        scored = sorted((-cosine(a, b), c) for c, b in chunks)[:k]
        out[q] = [(c, round(-s, 12)) for s, c in scored]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 12)))
    return out


def vectors(n, seed, dims=8):
    rnd = random.Random(seed)
    rows = [(i, [float(rnd.randrange(-3, 4)) for _ in range(dims)]) for i in range(n)]  # many ties
    return rows + [(n, []), (n + 1, None), (n + 2, [0.0] * dims), (n + 3, [1.0, 2.0])]


def test_hits_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 16)
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 100)
    queries, chunks = vectors(60, 1), vectors(900, 2)
    ask = spark.createDataFrame(queries, "query_id long, vector array<float>")
    for ids in ("chunk_id", "concat('c', lpad(chunk_id, 5, '0'))"):
        df = spark.createDataFrame(chunks, "chunk_id long, vector array<float>").selectExpr(f"{ids} AS chunk_id", "vector", "'x' AS floor")
        want = brute(queries, [(f"c{c:05d}" if "concat" in ids else c, v) for c, v in chunks], 6)
        assert found(retrieval.top_k(ask, df, 6)) == want


def test_few_chunks_and_none(spark):
    ask = spark.createDataFrame(vectors(3, 1), "query_id long, vector array<float>")
    few = spark.createDataFrame(vectors(0, 2), "chunk_id long, vector array<float>")
    assert found(retrieval.top_k(ask, few, 99)) == brute(vectors(3, 1), vectors(0, 2), 6)
    assert retrieval.top_k(ask, few.limit(0), 3).count() == 0 and retrieval.top_k(ask.limit(0), few, 3).count() == 0


def test_many_queries_scan_the_chunks_no_more_often(spark):
    chunks = spark.range(200).select(F.col("id").alias("chunk_id"), F.array(F.col("id").cast("float"), F.lit(1).cast("float")).alias("vector"))
    plans = []
    for n in (10, 100_000):
        ask = spark.range(n).select(F.col("id").alias("query_id"), F.array(F.lit(1).cast("float"), F.col("id").cast("float")).alias("vector"))
        plans.append(retrieval.top_k(ask, chunks, 3)._jdf.queryExecution().executedPlan().toString())
    assert plans[0].count("Range (0, 200") == plans[1].count("Range (0, 200") and "LocalTableScan" not in plans[1]
