import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import common, quality, toxicity

BAD = ["vile", "crud", "dross", "slag"]


def corpus(n, seed=1):
    """Texts with labels: label 1 of toxic has bad words, label 0 of quality is mostly marks."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randrange(20, 120))]
        toxic, good = int(i % 6 == 0), int(i % 5 != 0)
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(BAD, k=rng.randrange(2, 6))
        if not good:
            words = [w + "###" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, good, toxic))
    return docs, labels


@pytest.fixture
def made(spark, docs_of):
    docs, labels = corpus(500)
    return docs_of(docs, ["score", "label", "place"]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(scores, labels, column, folds, skip):
    rows = scores.join(labels, "doc_id").withColumn("fold", common.fold_of(F.col("doc_id"), folds)).filter(F.col("fold") == skip)
    return [(r.score, r[column]) for r in rows.collect()]


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = spark.range(200).select("id", common.fold_of(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


# ---------------------------------------------------------------- toxicity
def brute_segments(scores):
    """Maximal-scoring segments by their definition: take the best segment, then what lies left and right of it."""
    best, span = 0.0, None
    for a in range(len(scores)):
        for b in range(a, len(scores)):
            s = sum(scores[a : b + 1])
            if s > best + 1e-9 or span and abs(s - best) < 1e-9 and (b - a) < span[1] - span[0]:
                best, span = s, (a, b)
    if not span:
        return []
    a, b = span
    right = [(x + b + 1, y + b + 1, s) for x, y, s in brute_segments(scores[b + 1 :])]
    return brute_segments(scores[:a]) + [(a, b, best)] + right


@pytest.mark.parametrize("seed", range(40))
def test_scan_finds_all_maximal_segments(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-1.0, -1.0, -1.0, rng.random() * 6]) for _ in range(25)]
    got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], 1.0)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)]
    assert all(math.isclose(s, sum(scores[a : b + 1])) for a, b, s in got)


def test_toxic_texts_are_told_apart(made):
    docs, labels = made
    model = toxicity.fit(docs, labels, common.fold_of(F.col("doc_id"), 5) != 0)
    found = held(toxicity.score(docs, model), labels, "toxic", 5, 0)
    assert np.mean([(s >= 0.5) == y for s, y in found]) > 0.95
    assert set(BAD) <= set(model.scores)
    kept = toxicity.drop_toxic(docs, model)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in scored.items() if s < 0.5}


def test_parts_of_the_model_follow_their_definitions(made):
    """Log-odds, lambda, K and evidence, each from plain counts over the learned rows."""
    docs, labels = made
    model = toxicity.fit(docs, labels, F.lit(True))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    texts = [(toxicity.TOKEN.findall(r.text.lower()), truth[r.doc_id]) for r in docs.select("doc_id", "text").collect() if r.doc_id in truth]
    count = {y: Counter(w for ws, label in texts if label == y for w in set(ws)) for y in (0, 1)}
    size, scores = {y: sum(count[y].values()) for y in (0, 1)}, {}
    for w in count[0] | count[1]:
        a = toxicity.PRIOR * (count[0][w] + count[1][w])
        rate = {y: (count[y][w] + a) / (size[y] + toxicity.PRIOR * sum(size.values()) - count[y][w] - a) for y in (0, 1)}
        s = math.log(rate[1]) - math.log(rate[0]) - toxicity.MARGIN * math.sqrt(1 / (count[1][w] + a) + 1 / (count[0][w] + a))
        if s > toxicity.DRIFT:
            scores[w] = s
    assert model.scores == pytest.approx(scores)
    clean = [ws for ws, y in texts if not y]
    values = [scores.get(w, -toxicity.DRIFT) for ws in clean for w in ws]
    if any(v > 0 for v in values):
        assert sum(math.exp(model.lam * v) for v in values) / len(values) == pytest.approx(1, abs=1e-6)
    tops = [(len(ws), max([0.0, *(s for *_, s in brute_segments([scores.get(w, -toxicity.DRIFT) for w in ws]))])) for ws in clean[:20]]
    assert [tuple(r) for r in toxicity.best_segments(docs.sparkSession.createDataFrame([(" ".join(ws),) for ws in clean[:20]], "text string"), scores).collect()] == [pytest.approx(x) for x in tops]
    assert model.k == pytest.approx(len(clean) / sum(len(ws) * math.exp(-model.lam * max([0.0, *(s for *_, s in toxicity.scan(" ".join(ws), scores)[1])])) for ws in clean))


def test_lambda_solves_its_equation():
    lam = toxicity._lambda([(2.0, 3), (0.7, 10)], 500)
    assert 3 * math.exp(2 * lam) + 10 * math.exp(0.7 * lam) + 487 * math.exp(-toxicity.DRIFT * lam) == pytest.approx(500)
    assert toxicity._lambda([], 100) > 0 and toxicity._lambda([(5.0, 50)], 60) == 1e-6


def test_passages_are_spans_of_the_text(docs_of):
    model = toxicity.Model({"vile": 3.0, "slag": 3.0}, lam=1.0, k=0.01, slope=1.0, bias=-2.0)
    text = "İ fine text VILE and slag then " + "calm words " * 40 + "vile end"
    row = toxicity.score(docs_of([(1, text)]), model).first()
    assert [text[p.start : p.end] for p in row.passages] == ["VILE and slag", "vile"]
    assert row.score == pytest.approx(model.probability(row.evidence))


def test_edge_rows(spark, docs_of):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (2, 1, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of([(1, "vile thing"), (2, "calm thing"), (3, None), (4, ""), (None, "vile"), (4, "vile " * 50000), (4, "")], ["score"])
    model = toxicity.fit(docs, labels, F.lit(True))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs_of([]), model).count() == 0
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none, F.lit(True))).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.filter("toxic = 1"), F.lit(True))).collect()} == {1.0}


def test_held_out_labels_are_not_learned(made):
    docs, labels = made
    fold = common.fold_of(F.col("doc_id"), 5)
    turned = labels.withColumn("toxic", F.when(fold == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels, fold != 0) == toxicity.fit(docs, turned, fold != 0)


# ---------------------------------------------------------------- quality
def test_good_texts_are_told_apart(made):
    docs, labels = made
    weights = quality.fit(docs, labels, common.fold_of(F.col("doc_id"), 4) != 2)
    found = held(quality.score(docs, weights), labels, "quality", 4, 2)
    assert np.mean([(s >= 0.7) == y for s, y in found]) > 0.95
    kept = quality.keep_good(docs, weights)
    scored = {r.doc_id: r.score for r in quality.score(docs, weights).collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in scored.items() if s >= 0.7}


def test_texts_together_have_the_features_of_each_alone(monkeypatch):
    texts = ["", "One two, two ONE 1999 -- x", "x x x x y x", " ", "Äß ǅ ² _a !a ... ....", "two ONE"] * 3 + ["w " * 5000 + "end"]
    alone = [quality.Features().of(t) for t in texts]
    weights = np.random.default_rng(3).normal(size=1 << quality.BITS).astype(np.float32)
    monkeypatch.setattr(quality, "slices", lambda texts: common.slices(texts, 40))
    for remember in (quality.REMEMBER, 3):  # with and without words forgotten on the way
        monkeypatch.setattr(quality, "REMEMBER", remember)
        features, got = quality.Features(), []
        for starts, index, value in features.of_all(texts):
            got += zip(np.split(index, starts[1:]), np.split(value, starts[1:]))
        assert len(got) == len(texts) and all((a == b).all() for x, y in zip(alone, got) for a, b in zip(x, y))
        want = [1 / (1 + np.exp(-float(weights[i] @ v))) for i, v in alone]
        assert quality.Features().probabilities(texts, weights).tolist() == want
    index, value = alone[2]  # six words, five pairs; of shapes also four triples; the bias is apart
    assert index[0] == 0 and value[0] == 1 and (value[1:] ** 2).sum() == pytest.approx(1) and len(index) == len(set(index.tolist()))


def test_quality_edge_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "a b"), (3, "word " * 100000), (3, "x"), (3, "x")], ["score"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, none, F.lit(True))).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(docs, quality.fit(docs, some, F.lit(True))).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs_of([]), np.zeros(1 << quality.BITS, np.float32)).count() == 0


def test_sample_is_bounded_and_whole(made):
    docs, labels = made
    rows = common.labelled(docs, labels, "quality", F.lit(True), 50).collect()
    assert len(rows) == 50 and {(r.doc_id, r.text) for r in rows} <= {(r.doc_id, r.text) for r in docs.collect()}


def test_training_follows_the_update_rule():
    rng = np.random.default_rng(3)
    rows = [(rng.choice(50, 5, replace=False), rng.random(5), int(rng.integers(2))) for _ in range(40)]
    z, n = {}, {}

    def weight(i):
        s = z.get(i, 0.0)
        return 0.0 if abs(s) <= quality.L1 else -(s - math.copysign(quality.L1, s)) / ((quality.BETA + n.get(i, 0.0) ** 0.5) / quality.ALPHA + quality.L2)

    for index, value, label in rows * 2:
        w = {int(i): weight(int(i)) for i in index}
        p = 1 / (1 + math.exp(-sum(w[int(i)] * v for i, v in zip(index, value))))
        for i, v in zip(map(int, index), value):
            g = (p - label) * v
            sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA
            z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    got = quality.train(rows, epochs=2)
    assert np.allclose(got[:50], [weight(i) for i in range(50)], atol=1e-5)
