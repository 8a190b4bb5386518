import random
import re

import numpy as np
import xxhash

from factloom.llm import simhash


def brute(pairs):
    fps = []
    for _, text in pairs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(pairs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, fps[i], least.get(find(i))) for i, (doc, _) in enumerate(pairs)]


def near_texts(n, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    out = []
    for i in range(n):
        words = list(base) if i % 3 == 0 else [f"w{rng.randrange(9000)}" for _ in range(rng.randrange(1, 60))]
        if i % 3 == 0:
            for _ in range(rng.randrange(3)):
                words[rng.randrange(400)] = f"x{rng.randrange(50)}"
        out.append((1000 - i, " ".join(words)))
    return out


EDGE = [(1, None), (2, ""), (3, " \t"), (4, "One TWO"), (5, "one two"), (6, "É x y z"), (6, "É x y z"), (None, "one two"), (None, "alone here now ok"), (None, "alone here now ok"), (7, "w " * 200000)]


def test_groups_match_brute_force(docs_of):
    pairs = near_texts(150) + EDGE
    got = simhash.near_groups(docs_of(pairs, ["fp", "row_key", "first", "component"]))
    rows = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got.collect()), key=repr)
    assert rows == sorted(brute(pairs), key=repr)


def test_stage_keeps_one_of_each_group(docs_of):
    pairs = near_texts(60) + EDGE
    docs = docs_of(pairs, ["fp", "component"])
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = {c for d, _, c in brute(pairs) if c is not None}
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None} == want and len(ids) == len(set(ids))
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["alone here now ok"]


def test_empty_table(docs_of):
    assert simhash.near_groups(docs_of([])).count() == 0
    assert simhash.drop_near_copies(docs_of([])).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    masks = [m % (1 << 64) for m in simhash.covering_masks()]
    rng = random.Random(3)
    assert len(masks) == 15
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
        assert any(diff & m == 0 for m in masks)


def test_cut_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = random.Random(5)
    fps = {sum(1 << b for b in rng.sample(range(48), rng.randrange(0, 6))) for _ in range(400)}
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = [(r.src % (1 << 64), r.dst % (1 << 64)) for r in simhash.fingerprint_links(frame).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    assert groups(fps, links) == groups(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])


def test_forest_spans():
    rng = random.Random(7)
    fps = {sum(1 << b for b in rng.sample(range(20), rng.randrange(0, 7))) for _ in range(300)}
    links = [(int(a), int(b)) for a, b in simhash.forest(np.array(list(fps), np.uint64))]
    assert groups(fps, links) == groups(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])


def groups(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    out = {}
    for x in nodes:
        out.setdefault(find(x), set()).add(x)
    return sorted(sorted(g) for g in out.values())
