import hashlib
import random
import re
import zlib

import pytest

from factloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        own.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p in members:
        own_saved = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saved
            leaves[p[:d]] += p not in kids
    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if made[c] == p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def random_rows(seed, convs=70, most=30):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(200), convs):
        for t in range(rng.choice([1, 1, 2, 3, 8, 9, most])):
            rows.append((c, rng.choice([t, t, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a b", " hi  there ", "", None, "ü\tx\x0by"])))
    return rows


@pytest.mark.parametrize("widths", [(8, 32), (3, 2), (1, 1)])
def test_nodes_are_those_of_brute_force(spark, widths):
    rows = random_rows(3, most={1: 6, 3: 12, 8: 45}[widths[0]])
    got = rows_of(prefix_trie.prefixes(spark.createDataFrame(rows, SCHEMA).repartition(3), widths))
    assert got == brute(rows)


def test_edge_rows(spark):
    rows = [(20, None, None, None), (20, 1, "user", "x"), (20, 1, "user", "x"), (21, 5, "user", "x"), (None, 1, "user", "lost"), (43, 2, "user", "w " * 50_000), (44, 1, "a", "b"), (-3, 1, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS n", "'y' AS pos", "'z' AS node", "1 AS depth", "2 AS idx")
    assert rows_of(prefix_trie.prefixes(df)) == brute([r for r in rows])
    assert prefix_trie.prefixes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_equal_conversations_end_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rows = [(c * 20, t, "user", f"same {t}") for c in range(1, 300) for t in range(3)]
    got = rows_of(prefix_trie.prefixes(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and len(got) == 4


def test_conversation_of_many_runs(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 10)
    rows = [(21, t, "user", f"t{t}") for t in range(95)] + [(20, 0, "user", "first")]
    assert rows_of(prefix_trie.prefixes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
