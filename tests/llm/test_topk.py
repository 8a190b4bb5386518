import math
import random

import numpy as np
import pytest

from factloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=20, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in ok if i % every == 0}:
        mine = min(v for i, v in ok if i == q)
        scored = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in ok if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def rows_of(n, dims, seed):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(dims)]) for i in range(n)]


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "1 AS score", "2 AS qb")
    return sorted(map(tuple, topk.top_k(df).collect()))


def test_against_brute_force(spark):
    rows = rows_of(900, 40, 1)
    assert run(spark, rows) == brute(rows)


def test_ties_nulls_and_repeated_rows(spark):
    same = [0.5, -0.25]
    rows = [(i, same) for i in range(120)] + [(3, same)] * 5 + [(None, same), (20, None), (41, [None, 1.0]), (42, [float("nan"), 1.0]), (43, [float("inf"), 1.0]), (40, [9.0, 9.0]), (60, [1.0]), (61, [])]
    assert run(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert run(spark, [(0, [1.0, 2.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 64 * 128)]
    assert run(spark, []) == []


def test_blocks_cut_both_sides(spark, monkeypatch):
    monkeypatch.setattr(topk, "MOST", 7)
    rows = rows_of(300, 8, 4)
    assert run(spark, rows) == brute(rows)


def test_large_components_stay_exact():
    rng = random.Random(5)
    vectors = np.array([[float(rng.randrange(-(10**9), 10**9)) for _ in range(6)] for _ in range(50)])
    ids = np.arange(50)
    i, j, s = topk.best_of_block(ids[:3], vectors[:3], ids, vectors, 5)
    want = []
    for q in range(3):
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(vectors[q], v)), c) for c, v in enumerate(vectors) if c != q)[:5]
        want += [(q, c, max(-(1 << 63), min((1 << 63) - 1, -x))) for x, c in scored]
    assert list(zip(i.tolist(), j.tolist(), s.tolist())) == want


@pytest.mark.parametrize("seed", range(5))
def test_pruning_loses_nothing(seed):
    rng = np.random.default_rng(seed)
    center = rng.normal(size=(6, 64)) * 30
    vectors = np.floor(center[rng.integers(0, 6, 700)] + rng.normal(size=(700, 64)) * rng.choice([1, 20]))
    ids = rng.permutation(700)
    i, j, s = topk.best_of_block(ids[:40], vectors[:40], ids, vectors, 20)
    scores = (vectors[:40] @ vectors.T).astype(int)
    for q in range(40):
        order = sorted((c for c in range(700) if c != q), key=lambda c: (-scores[q, c], ids[c]))[:20]
        assert j[i == q].tolist() == order and s[i == q].tolist() == [scores[q, c] for c in order]
