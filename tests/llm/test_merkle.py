import hashlib
import random
import zlib

import pytest

from factloom.llm import merkle, ranked
from factloom.llm.queries import op13

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def climb(hashes):
    """Levels of a tree and, per leaf, its siblings to the left and right level by level."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for leaf, i in enumerate(at):
            low = i - i % 16
            paths[leaf].append((hashes[low:i], hashes[i + 1 : low + 16]))
        at = [i // 16 for i in at]
        hashes = [sha(*hashes[i : i + 16]) for i in range(0, len(hashes), 16)]
    return hashes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1]))) for s in order}
    trees = {s: climb([leaf_of(r, r[1]) for r in leaves[s]]) for s in order}
    root, tops = climb([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for r, path in zip(leaves[s], trees[s][1]):
            path, text = path + top, r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf_of(r, text)
            for left, right in path:
                node = sha(*left, node, *right)
            out.append((r[0], leaf_of(r, r[1]), trees[s][0], root, sha(*[h for left, right in path for h in left + right]), node, node == root))
    return sorted(out, key=repr)


def rows_of(df):
    found = merkle.verified(merkle.manifest(df)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"a": 600, "b": 1, None: 17, "ü": 16, "": 2}, {f"s{i}": 1 + i % 3 for i in range(40)}, {"only": 1}, {None: 40}])
def test_manifest_is_that_of_brute_force(spark, sizes):
    rng, rows = random.Random(2), []
    for source, n in sizes.items():
        rows += [(rng.randrange(10**9), rng.choice(["Text Ä", "lower", "", None]) , rng.choice(["en", None]), source, rng.choice([None, i])) for i in range(n)]
    rng.shuffle(rows)
    got = rows_of(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got == brute(rows) and len(got) == len(rows)


def test_edge_rows(spark):
    rows = [(None, "A", "en", "s", 1), (None, None, None, None, None), (4, "Twice", "en", "s", 5), (4, "Twice", "en", "s", 5), (5, "LONG " * 200_000, "en", "s", 9), (-2, "Neg", "en", "t", 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS tree", "'x' AS hash", "1 AS idx", "2 AS n", "'p' AS path", "'l' AS left")
    assert rows_of(df) == brute(rows)
    assert rows_of(spark.createDataFrame([], SCHEMA)) == []


def test_tampering_shows(spark):
    got = op13(spark, "/root/testdata/sf0.001").collect()
    assert {r.verified for r in got if zlib.crc32(str(r.doc_id).encode()) % 5} == {True}
    assert any(not r.verified for r in got)


def test_ranks_of_large_groups(spark):
    rows = spark.range(5000).selectExpr("id % 7 DIV 5 AS g", "id * 7919 % 5003 AS v")
    got = {(r.g, r.v): (r.idx, r.n) for r in ranked.ranked(rows, ["g"], ["v"]).collect()}
    for g in {g for g, _ in got}:
        values = sorted(v for k, v in got if k == g)
        assert all(got[g, v] == (i, len(values)) for i, v in enumerate(values))
