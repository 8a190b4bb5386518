"""Exact top-k by inner product: columnar branch-and-bound.

Queries meet candidates block by block: a task gets one block of each, so both sides are bounded and no
side is broadcast.  In a task the candidates lie in vertical layout, a row per dimension.  A few queries
at a time accumulate their scores over ``DIMS`` dimensions, then every candidate is dropped whose score
so far plus the product of the remaining norms (Cauchy-Schwarz) stays below the k-th score already
certain for every query of the few; survivors are compacted and the next dimensions follow.

Components are ``floor(scale * x)``.  Scores are exact integers: sums below 2^53 are exact in double
precision, larger ones are computed with Python integers and held to the range of a long.

Defined cases: a vector that is null, or holds a null or non-finite component, takes no part, nor does
one without an id; vectors of unequal length count as padded with zeros; a query's candidates are the
rows with another vec_id, repeated rows among them count one by one; a repeated query id is one query (the
least of its vectors); an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIMS, FEW, MOST, LEAST = 16, 16, 16_384, 256


def best_of_block(query_ids, queries, ids, vectors, k, scale_exact=True):
    """(query index, candidate index, score) of every query's k best in the block, ties to smaller ids."""
    if not len(ids) or not len(query_ids):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    dims = max(queries.shape[1], vectors.shape[1])
    queries, vectors = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (queries, vectors))
    rest_q, rest_c = _rest(queries), _rest(vectors)
    if rest_q[:, 0].max() * rest_c[:, 0].max() >= 2.0**53:
        return _large(query_ids, queries, ids, vectors, k)
    order = np.argsort(-rest_c[:, 0], kind="stable")  # long vectors first: they make the bounds sharp
    ids, rest_c, layout = ids[order], rest_c[order], np.ascontiguousarray(vectors[order].T)
    out = []
    for at in range(0, len(query_ids), FEW):
        q, own = queries[at : at + FEW], query_ids[at : at + FEW]
        seen = q @ layout[:, : 8 * k]
        seen[own[:, None] == ids[None, : 8 * k]] = -np.inf
        certain = np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] >= k else np.full(len(q), -np.inf)
        left = np.arange(len(ids))
        score = np.zeros((len(q), len(ids)))
        score[own[:, None] == ids[None, :]] = -np.inf
        for d in range(0, dims, DIMS):
            part = layout[d : d + DIMS] if len(left) == len(ids) else layout[d : d + DIMS, left]
            score += q[:, d : d + DIMS] @ part
            end = min(d + DIMS, dims)
            alive = (score + rest_q[at : at + FEW, None, end] * rest_c[None, left, end] >= certain[:, None]).any(axis=0)
            if alive.mean() < 0.8 or end == dims:
                left, score = left[alive], score[:, alive]
        for i in range(len(q)):
            s = score[i]
            can = np.flatnonzero(np.isfinite(s))
            if len(can) > k:
                can = can[s[can] >= np.partition(s[can], -k)[-k]]
            top = can[np.lexsort((ids[left[can]], -s[can]))[:k]]
            out.append((np.full(len(top), at + i), order[left[top]], s[top].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _rest(m: np.ndarray) -> np.ndarray:
    """Norm of what lies behind each dimension, rounded up a little so that bounds stay bounds."""
    sums = np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([sums, np.zeros((len(m), 1))], axis=1)) * (1 + 1e-9)


def _large(query_ids, queries, ids, vectors, k):
    whole = [list(map(int, v)) for v in vectors]
    out = []
    for i, q in enumerate(queries):
        q = list(map(int, q))
        scored = ((max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in enumerate(whole) if ids[j] != query_ids[i])
        out += [(i, j, s) for s, j in sorted(scored, key=lambda x: (-x[0], ids[x[1]]))[:k]]
    return tuple(np.array([x[c] for x in out], np.int64) for c in range(3))


def _matrix(rows: pa.Table, scale: float) -> np.ndarray:
    lists = rows.column("v").combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), sizes.max() if len(sizes) else 0))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: rows whose id is divisible by ``every``, against all rows of
    ``vectors(vec_id, embedding)``."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = max(-(-size.n // MOST), min(-(-size.n // LEAST), 2 * tasks), 1)  # candidate blocks
    few = max(-(-size.q // MOST), 1)  # query blocks
    left = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(few)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("cb"))
    # repeated ids spread too: the block of a candidate depends on its task, not only on its id
    block = F.pmod(F.xxhash64("vec_id", F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(many)).cast("int")
    right = rows.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(few - 1))).alias("qb"), block.alias("cb"))
    left, right = left.withColumn("qb", F.col("qb").cast("int")), right

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        q_ids, ids = (np.asarray(t.column("vec_id")) for t in (q, c))
        i, j, s = best_of_block(q_ids, _matrix(q, scale), ids, _matrix(c, scale), k)
        return pa.table({"query_id": q_ids[i].astype(np.int64), "vec_id": ids[j].astype(np.int64), "score": s})

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
