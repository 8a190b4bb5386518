import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import common, packing, quality, toxicity
from factloom.llm.queries import QUERIES
from tests.llm.test_jaccard import brute as near_brute

ROOT = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def by_stage(spark):
    """What each stage returns, from running them one after the other."""
    docs, out = common.table(spark, ROOT, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.kept(stage(spark, docs, ROOT), f"test-{name}")
        out.append((name, docs))
    return dict(out)


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_follow_brute_force(spark, by_stage):
    docs, labels = common.table(spark, ROOT, "documents"), common.table(spark, ROOT, "labels")
    model = toxicity.fit(docs, labels, common.fold_of(F.col("doc_id"), 5) != 0)

    def toxic(text):
        n, found = toxicity.scan(text, model.scores)
        return model.probability(toxicity.evidence(model, n, [s for *_, s in found])) >= 0.5

    want = [(i, t) for i, t in pairs(docs) if not toxic(t)]
    assert pairs(by_stage["toxicity"]) == want
    weights = quality.fit(by_stage["toxicity"], labels, common.fold_of(F.col("doc_id"), 4) != 2)
    features = quality.Features()
    want = [(i, t) for i, t in want if 1 / (1 + 2.718281828459045 ** -float(weights[(x := features.of(t))[0]] @ x[1])) >= 0.7]
    assert pairs(by_stage["quality"]) == want
    first = {}
    for i, t in want:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    want = sorted(first.values())
    assert pairs(by_stage["exact"]) == want
    want = near_brute(want)
    assert pairs(by_stage["near"]) == want
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {(r.doc_id, r.start): list(r.ids) for r in by_stage["packing"].collect()}
    expected = {}
    for i, t in want:
        ids, start = [*library.encode(t, add_special_tokens=False).ids, 0], 0
        for length in packing.cuts(len(ids)):
            expected[i, start] = ids[start : start + length]
            start += length
    assert pieces == expected


def test_stages_decide_and_keep_the_columns(spark, by_stage):
    sizes = [common.table(spark, ROOT, "documents").count(), *(by_stage[n].count() for n in ("toxicity", "quality", "exact", "near"))]
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[2] < sizes[1] and 0 < sizes[4] < sizes[2]
    assert all(by_stage[n].columns == COLUMNS for n in ("toxicity", "quality", "exact", "near"))


def test_edge_rows_pass_all_stages(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "a b c d"), (3, "x " * 200000), (4, "same words here now"), (4, "same words here now")], ["score", "fp", "digest", "label"])
    for name, stage in corpus_pipeline.STAGES:
        docs = common.kept(stage(spark, docs, ROOT), f"edge-{name}")
        if name == "exact":  # of the two equal rows one is left
            assert docs.groupBy("doc_id", "text").count().filter("count > 1").isEmpty()
    pieces = docs.collect()
    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    assert {r.doc_id for r in pieces} <= {None, 1, 2, 3, 4} and all(len(r.ids) == r.length for r in pieces)
    docs = docs_of([])
    for name, stage in corpus_pipeline.STAGES:
        docs = common.kept(stage(spark, docs, ROOT), f"none-{name}")
    assert docs.count() == 0


@pytest.mark.parametrize("name", [n for n in QUERIES if re.match(r"op(1|2|3|4|7|8|10)_", n)])
def test_queries_return_every_row(spark, name):
    rows = QUERIES[name](spark, ROOT)
    key, of = ("page_id", "pages") if "page_id" in rows.columns else ("doc_id", "documents")
    assert rows.select(key).distinct().count() == common.table(spark, ROOT, of).count()
