"""Chunking, similarity search and context packing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import ordered

MAX_CHUNK_CHARS = 4000
MAX_HITS = 6
#: One chunk in so many gives the scores that hits must reach.
PROBE = 64
#: Most queries and chunks that meet in one task.
QUERY_BLOCK, CHUNK_BLOCK = 2048, 16_384


def default_overlap(chunk_size: int) -> int:
    return max(0, min(100, chunk_size // 5))


def chunk_lines(files: DataFrame, chunk_size: int, overlap: int | None = None) -> DataFrame:
    """Overlapping line chunks of each text; blank chunks are dropped.

    A map-only job: lines stay an array and chunks are slices of it.  ``body`` is the whole
    chunk; ``text`` is its display form, shortened to the store's limit.
    """
    overlap = default_overlap(chunk_size) if overlap is None else overlap
    stride = chunk_size - overlap
    if stride <= 0:
        raise ValueError("overlap must be smaller than the chunk size")
    rest = [c for c in files.columns if c != "text"]
    cut = files.filter(~F.contains("text", F.lit("\x00"))).select(*rest, F.split("text", "\n").alias("ls"))
    n = F.size("ls")
    # a start after the first is kept only while the chunk before it has not reached the end
    last = F.greatest(F.lit(0), F.ceil((n - chunk_size) / stride).cast("int") * stride)
    starts = cut.withColumn("st", F.explode(F.sequence(F.lit(0), last, F.lit(stride))))
    body = F.array_join(F.slice("ls", F.col("st") + 1, chunk_size), "\n")
    return (
        starts.select(
            *rest,
            (F.col("st") + 1).cast("bigint").alias("start_line"),
            F.least(n, F.col("st") + chunk_size).cast("bigint").alias("end_line"),
            F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"),
        )
        .filter("body <> ''")
        .withColumn("text", F.substring("body", 1, MAX_CHUNK_CHARS))
    )


def _unit(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows by length of their vectors: (places, vectors, norms); null vectors count as empty."""
    lists = rows.column("vector").combine_chunks().fill_null([])
    sizes, flat = np.diff(np.asarray(lists.offsets)), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts, out = np.cumsum(sizes) - sizes, {}
    for size in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == size)
        out[size] = places, flat[starts[places][:, None] + np.arange(size)]
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products summed dimension by dimension, so that equal vectors get equal scores wherever they stand."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        out += np.multiply.outer(a[:, d], b[:, d])
    return out


def _scores(queries: pa.Table, chunks: pa.Table) -> np.ndarray:
    """Cosine of all pairs; 0 for empty, unequal or zero-length vectors."""
    out, right = np.zeros((queries.num_rows, chunks.num_rows)), _unit(chunks)
    for size, (i, q) in _unit(queries).items():
        if size and size in right:
            j, c = right[size]
            norms = np.multiply.outer(*[np.sqrt(np.array([_dots(v[k : k + 1], v[k : k + 1])[0, 0] for k in range(len(v))])) for v in (q, c)])
            out[np.ix_(i, j)] = np.divide(_dots(q, c), norms, out=np.zeros_like(norms), where=norms > 0)
    return out


def _met(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """``(query_id, chunk_id, score)``: per block of chunks the best ``k`` of each query that reach its ``floor``."""
    q_type, c_type = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (chunks, "chunk_id")))
    few, many = (max(1, -(-df.count() // most)) for df, most in ((queries, QUERY_BLOCK), (chunks, CHUNK_BLOCK)))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(few))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    right = chunks.select("chunk_id", "vector").withColumn("cb", F.pmod(F.xxhash64("chunk_id"), F.lit(many)).cast("int"))
    right = right.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(few - 1).cast("bigint"))))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        rank, hits = np.empty(c.num_rows, np.int64), []
        rank[pc.sort_indices(c.column("chunk_id")).to_numpy()] = np.arange(c.num_rows)
        floors = pc.fill_null(q.column("floor"), -np.inf).to_numpy()
        for at in range(0, q.num_rows, 128):
            some = q.slice(at, 128)
            for i, score in enumerate(_scores(some, c), at):
                can = np.flatnonzero(score >= floors[i])
                if len(can) > k:
                    can = can[score[can] >= np.partition(score[can], -k)[-k]]
                best = can[np.lexsort((rank[can], -score[can]))[:k]]
                hits += [(i, j, score[j]) for j in best.tolist()]
        i, j, s = (np.array([h[n] for h in hits], t) for n, t in enumerate((np.int64, np.int64, np.float64)))
        return pa.table({"query_id": q.column("query_id").take(pa.array(i)), "chunk_id": c.column("chunk_id").take(pa.array(j)), "score": s})

    blocks = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb"))
    return blocks.applyInArrow(meet, f"query_id {q_type}, chunk_id {c_type}, score double")


def top_k(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Best ``k`` chunks per query by cosine: ``(query_id, chunk_id, score, rank)``.

    ``queries(query_id, vector)`` with distinct ids; ``chunks(chunk_id, vector, ...)``; ``k`` is held to ``MAX_HITS``.
    Blocks of queries meet blocks of chunks, each pair in one task, so neither side is collected or scanned again per
    batch.  A slice of the chunks gives each query a score its k-th hit can not fall below; blocks return only rows
    that reach it.  The slice never decides a result.
    """
    k = max(1, min(k, MAX_HITS))
    asked = queries.select("query_id", "vector")
    best = [F.desc("score"), F.col("chunk_id")]
    some = chunks.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(PROBE)) == 0)
    probe = ordered.top_per_key(_met(asked.withColumn("floor", F.lit(None).cast("double")), some, k), ["query_id"], best, k)
    floor = probe.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).drop("n")
    return ordered.top_per_key(_met(asked.join(floor, "query_id", "left"), chunks, k), ["query_id"], best, k, rank="rank")


def citation(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))


def pack_context(hits: DataFrame, key: str, order: list[str], max_text: int = 2000, max_total: int = 120_000) -> DataFrame:
    """Trim each hit's text, then keep hits in order while their total stays in the budget; the
    first is always kept.  A key holds at most ``MAX_HITS`` hits, so its window is bounded."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(*order)
    t = hits.withColumn("text", F.substring("text", 1, max_text))
    t = t.withColumn("cum", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("rn", F.row_number().over(w))
    return t.filter((F.col("rn") == 1) | (F.col("cum") <= max_total)).drop("cum", "rn")


def query_text(title: Column, sections: Column) -> Column:
    return F.concat_ws(" ", title, F.array_join(sections, " "))
