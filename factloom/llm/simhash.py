"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit for each of 64 positions: set if over half of the shingle hashes set it.
Covering hashing (Pagh, 2016): every bit position gets a vector of ``RADIUS + 1`` bits; each of the
``2^(RADIUS+1) - 1`` non-zero vectors v makes a table whose mask drops the positions orthogonal to v.
Up to ``RADIUS`` differing positions span at most ``RADIUS`` dimensions, so some v is orthogonal to all
of them: every pair within the radius agrees on all that its mask keeps, with certainty.

Work is done on distinct fingerprints, so a group of equal texts costs one row.  A bucket with more
than ``BLOCK`` fingerprints is cut in blocks and every two blocks meet in a task of their own; each
meeting gives a spanning forest of its links, never all its pairs.  Nothing is capped.

Defined cases: null text counts as empty; a text without words has fingerprint zero and links like any
other; rows without an id represent a component only if none in it has one, whose component_id is then null; repeated rows get equal results; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import kept, small, whole
from factloom.operators.graph import connected_components
from factloom.operators.hot import hot_keys, split_join

SEED, RADIUS, SHINGLE, BLOCK, SMALL = 42, 3, 3, 2048, 24

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str, size: int = SHINGLE) -> list[str]:
    words = _WORD.findall(text.translate(_UPPER) if not text.isascii() else text.lower())
    if len(words) <= size:
        return [" ".join(words)] if words else []
    return list(map(" ".join, zip(*(words[i:] for i in range(size)))))


def fingerprint(text: str) -> int:
    """Unsigned 64-bit fingerprint; the hashes are counted bit by bit in blocks of bounded size."""
    parts, hashed = shingles(text), xxhash.xxh64_intdigest
    if not parts:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(parts), 1 << 14):
        h = np.array([hashed(s.encode(), SEED) for s in parts[at : at + (1 << 14)]], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(parts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, fp)``: the fingerprint as a signed long and xxhash64 of the text."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), whole(F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            fps = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "row_key", "fp"])

    return rows.mapInArrow(run, "doc_id long, row_key long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Signed 64-bit masks, one per non-zero vector of ``radius + 1`` bits."""
    vectors = [i % (1 << radius + 1) for i in range(64)]  # every vector equally often: masks of 32 bits
    masks = []
    for v in range(1, 1 << radius + 1):
        mask = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def forest(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Links (a, b) that span the components of ``fps`` under distance <= radius."""
    rest, out = np.unique(fps), []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            a = todo.pop()
            near = np.bitwise_count(rest ^ a) <= radius
            if near.any():
                got = rest[near]
                out.append(np.stack([np.full(len(got), a), got], 1))
                todo.extend(got)
                rest = rest[~near]
    return np.concatenate(out) if out else np.empty((0, 2), np.uint64)


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket columns..., fp) sorted by bucket: links of every run of equal buckets.

    A run holds at most two blocks, so what is carried from batch to batch is bounded.
    """
    left: np.ndarray | None = None

    def links(rows: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.r_[True, (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(rows)])
        fps, run = rows[:, -1].astype(np.int64).view(np.uint64), np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat(sizes <= SMALL, sizes)
        out = []
        for step in range(1, SMALL):  # small runs all at once: each row against the step-th next one
            i = np.flatnonzero(small[:-step] & (run[:-step] == run[step:]) & (np.bitwise_count(fps[:-step] ^ fps[step:]) <= RADIUS)) if len(fps) > step else []
            if len(i):
                out.append(np.stack([fps[i], fps[i + step]], 1))
        out += [forest(fps[s : s + n]) for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL])]
        return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.uint64)

    def emit(found: np.ndarray) -> pa.RecordBatch:
        cols = np.ascontiguousarray(found.T).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1])], ["src", "dst"])

    for b in batches:
        rows = np.stack([np.asarray(c) for c in b.columns], 1)
        rows = rows if left is None else np.concatenate([left, rows])
        if len(rows):
            first = np.flatnonzero((rows[:, :-1] == rows[-1, :-1]).all(axis=1))[0]
            done, left = rows[:first], rows[first:]
            if len(done):
                yield emit(links(done))
    if left is not None and len(left):
        yield emit(links(left))


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """``(src, dst)`` links that connect what ``fps(fp)`` holds within the radius; fps are distinct."""
    tables = F.array(*[F.struct(F.lit(i).cast("long").alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(covering_masks())])
    rows = fps.select("fp", F.inline(tables))
    large = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    cut = rows.join(large, ["table", "key"], "left")
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1))
    own = F.pmod(F.xxhash64("fp"), blocks)
    # a row of a cut bucket goes to the meetings of its block with every other block
    others = F.when(blocks == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: j != own))
    met = cut.select("table", "key", own.alias("own"), "fp", F.explode(others).alias("other"))
    keys = ["table", "key", "low", "high"]
    met = met.select("table", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    return met.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(_link_runs, "src long, dst long").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, fp, component_id, first_key)`` for every row of ``docs(doc_id, text)``."""
    rows = kept(fingerprints(docs), "simhash-fps")
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row_key")).alias("first")
    n = F.count(F.lit(1)).alias("n")
    fps = kept(rows.groupBy("fp").agg(first, n), "simhash-distinct")
    links = kept(fingerprint_links(fps.select("fp")), "simhash-links")
    ends = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct()
    label = connected_components(ends, links).select(F.col("id").alias("fp"), "component")
    member = fps.join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    member = kept(member.select("fp", "first", "component"), "simhash-member")
    # a component may hold most fingerprints, and a fingerprint most rows
    least = member.groupBy("component").agg(F.min("first").alias("first"), n)
    hot = hot_keys(least, "component", member.count())
    of_fp = split_join(member.select("fp", "component"), least.select("component", "first"), "component", hot, ["fp"])
    of_fp = of_fp.select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.row_key").alias("first_key"))
    return split_join(rows, of_fp, "fp", hot_keys(fps, "fp", rows.count()), ["doc_id", "row_key"])


def drop_near_copies(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_groups) -> DataFrame:
    """One row of each component of ``groups`` stays: the one with the smallest id (then text hash; without any id, the
    smallest text hash), with all its columns."""
    stay = groups(docs).filter("doc_id <=> component_id AND row_key = first_key")
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    again = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("text")
    found = docs.join(stay, same, "left_semi")
    return found.withColumn("__n", F.row_number().over(again)).filter("__n = 1").select(docs.columns)
