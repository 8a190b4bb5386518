import hashlib
import re

from pyspark.sql import functions as F

from factloom.llm import exact_dedup

PAIRS = [(5, "a  b"), (3, "a b"), (9, "a\n\tb"), (4, None), (8, ""), (7, "B"), (7, "B"), (None, "B"), (1, " "), (2, "\x0b"), (None, "n"), (6, "a\xa0b"), (11, "long " * 60000)]


def brute(pairs):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in pairs]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out, seen = [], set()
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep and (i, t) not in seen, hashlib.sha256(t.encode()).hexdigest()))
        seen.add((i, t))
    return sorted(out, key=repr)


def test_groups_match_brute_force(docs_of):
    got = exact_dedup.exact_groups(docs_of(PAIRS, ["digest", "body", "salt", "keep_id"])).select("doc_id", "keep_id", "group_size", "kept", "digest")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(PAIRS)


def test_colliding_digests_do_not_merge_texts(docs_of):
    weak = lambda t: F.pmod(F.length(t), F.lit(2)).cast("string")
    got = exact_dedup.exact_groups(docs_of(PAIRS), digest=weak).select("doc_id", "keep_id", "group_size", "kept")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((x[:4] for x in brute(PAIRS)), key=repr)
    kept = exact_dedup.drop_copies(docs_of(PAIRS), digest=weak)
    assert kept.count() == sum(x[3] for x in brute(PAIRS))


def test_stage_keeps_whole_rows_once(docs_of):
    docs = docs_of(PAIRS, ["digest", "body", "salt", "keep_id"])
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(3, "a b"), (4, None), (7, "B"), (1, " "), (None, "n"), (6, "a\xa0b"), (11, "long " * 60000)], key=repr)


def test_empty_table(docs_of):
    assert exact_dedup.exact_groups(docs_of([])).count() == 0
    assert exact_dedup.drop_copies(docs_of([])).count() == 0


def test_hot_group(spark, docs_of):
    docs = spark.range(0, 20000, 1, 16).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id) END AS text")
    got = exact_dedup.exact_groups(docs)
    assert got.filter("kept").count() == 20000 - 6667 + 1
    assert got.filter("keep_id = 0 AND group_size = 6667").count() == 6667
