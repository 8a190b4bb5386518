"""Order-dependent operators against plain loops, with one key of over 90 % of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import ordered


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    found = [("hot", i, rnd.randint(0, 9)) for i in range(900)] + [(f"k{i % 17}", i, rnd.choice([None, i])) for i in range(60)] + [(None, i, i) for i in range(9)]
    rnd.shuffle(found)
    return found


@pytest.fixture
def frame(spark, rows):
    # the hot key lies in many partitions
    own = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark.createDataFrame(rows, "k string, i bigint, v bigint").repartition(5)
    for k, v in before.items():
        spark.conf.set(k, v)


def by_key(rows):
    out = {}
    for k, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        out.setdefault(k, []).append((i, v))
    return out


def test_running_total(frame, rows):
    got = {(r.k, r.i): r.s for r in ordered.running_total(frame, ["k"], ["i"], F.coalesce("v", F.lit(0)), "s").collect()}
    assert len(got) == len(rows)
    for k, seen in by_key(rows).items():
        total = 0
        for i, v in seen:
            total += v or 0
            assert got[k, i] == total


def test_row_index(frame, rows):
    got = {(r.k, r.i): r.n for r in ordered.row_index(frame, ["k"], ["i"], "n").collect()}
    assert got == {(k, i): n for k, seen in by_key(rows).items() for n, (i, _) in enumerate(seen, 1)}


@pytest.mark.parametrize("following", [False, True])
def test_neighbours(frame, rows, following):
    got = {(r.k, r.i): r.p for r in ordered.previous_value(frame, ["k"], ["i"], "v", "p", following=following).collect()}
    step = 1 if following else -1
    for k, seen in by_key(rows).items():
        for n, (i, _) in enumerate(seen):
            near = n + step
            assert got[k, i] == (seen[near][1] if 0 <= near < len(seen) else None)


def test_carries_are_few(spark, frame):
    dealt = ordered._dealt(frame, ["k"], ["i"])
    parts = dealt.select("__part").distinct().count()
    assert parts > 8
    parted = dealt.groupBy("k", "__part").count().groupBy("k").count().filter("count > 1").agg(F.sum(F.col("count") - 1)).first()[0]
    assert 0 < parted < parts


def test_empty(spark):
    none = spark.createDataFrame([], "k string, i bigint, v bigint")
    assert ordered.row_index(none, ["k"], ["i"], "n").count() == 0 and ordered.previous_value(none, ["k"], ["i"], "v", "p").columns == ["k", "i", "v", "p"]


def test_first_and_top(spark):
    df = spark.createDataFrame([("hot", i, 0) for i in range(300)] + [("b", i, 1) for i in range(5)] + [("c", 3, 4)], "k string, i bigint, v bigint")
    first = {r.k: r.i for r in ordered.first_per_key(df, ["k"], ["i"]).collect()}
    assert first == {"hot": 0, "b": 0, "c": 3}
    top = ordered.top_per_key(df, ["k"], [F.desc("i")], 2, rank="rn").collect()
    assert sorted((r.k, r.i) for r in top) == [("b", 3), ("b", 4), ("c", 3), ("hot", 298), ("hot", 299)]


def test_first_then_cap(spark):
    rows = [("s", "x", 3), ("s", "x", 1), ("s", "y", 2), ("s", "z", 9), ("t", "x", 5)]
    df = spark.createDataFrame(rows, "g string, d string, o int")
    got = sorted(map(tuple, ordered.first_then_cap(df, ["g"], ["d"], ["o"], 2).collect()))
    assert got == [("s", "x", 1), ("s", "y", 2), ("t", "x", 5)]
