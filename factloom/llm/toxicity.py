"""Toxicity by maximum-scoring segments.

A token's score is the log-odds ratio of toxic against other documents under an informative Dirichlet
prior (each class gets pseudo-counts in proportion to the token's overall share), less ``MARGIN``
standard errors, counted by documents so that a repeating text counts once.  Tokens that are not above ``DRIFT``
score ``-DRIFT``.  A linear scan (Ruzzo and Tompa) finds all maximal-scoring segments of a text.

A segment of score S in a text of n tokens is expected ``K n exp(-lambda S)`` times by chance (Karlin
and Altschul): lambda solves ``sum p_i exp(lambda s_i) = 1`` over the scores of the tokens of the clean
documents, from a histogram of them; K is the maximum-likelihood value given their best segments.  Segments expected less than once are the
passages; the sum of their negative log expectations is the evidence, and a logistic curve fitted on
the learning rows turns it into a score.

The classifier is fitted on at most ``MOST`` labelled rows (``common.labelled``) and keeps all tokens above the drift: by the
margin each is in several toxic documents.  All texts are scored, whole, however long.  Defined cases: null text counts as empty and has no evidence; without rows of both labels every
score is ``prior`` (the share of label 1, or 0); ids may be null or repeated; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import filtered, kept, labelled, small, whole

TOKEN = re.compile(r"\w+|[^\w\s]+")
MOST, DRIFT, PRIOR, MARGIN = 16_000, 0.25, 0.05, 2.5


@dataclass
class Model:
    scores: dict[str, float]
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    bias: float = -math.inf

    def probability(self, evidence: float) -> float:
        z = self.bias + self.slope * evidence
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score), in one scan.

    ``hits`` holds the places and scores of the positive tokens; every other token scores ``-drift``.
    A candidate keeps the running total before and behind it; a new one swallows those that it extends.
    """
    stack: list[tuple[int, int, float, float]] = []
    total, behind = 0.0, 0
    for at, score in hits:
        total -= drift * (at - behind)
        first, before, total = at, total, total + score
        after, behind = total, at + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j -= 1
            if j < 0 or stack[j][3] >= after:
                stack.append((first, at, before, after))
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, high - low) for a, b, low, high in stack]


def scan(text: str, scores: dict[str, float]) -> tuple[int, list[tuple[int, int, float]]]:
    """Token count and maximal segments of a whole text."""
    words = TOKEN.findall(text.lower())
    return len(words), segments([(i, scores[w]) for i, w in enumerate(words) if w in scores])


def token_counts(sample: DataFrame) -> DataFrame:
    """``(token, toxic, other)``: documents of each label with the token, combined in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            counts: dict[str, list[int]] = {}
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in set(TOKEN.findall(text.lower())):
                    counts.setdefault(w, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (1, 0))], ["token", "toxic", "other"]
            )

    found = sample.select("text", "label").mapInArrow(run, "token string, toxic long, other long")
    return found.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def log_odds(counts: DataFrame, toxic: int, other: int) -> DataFrame:
    """``(token, score)`` of tokens above the drift; ``toxic`` and ``other`` are the class totals."""
    mass = PRIOR * (toxic + other)
    a = (F.col("toxic") + F.col("other")) * F.lit(PRIOR)
    odds = F.log((F.col("toxic") + a) / (toxic + mass - F.col("toxic") - a)) - F.log((F.col("other") + a) / (other + mass - F.col("other") - a))
    error = F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("other") + a))
    return counts.select("token", (odds - MARGIN * error).alias("score")).filter(F.col("score") > DRIFT)


def fit(docs: DataFrame, labels: DataFrame, learn, most: int = MOST) -> Model:
    sample = kept(labelled(docs, labels, "toxic", learn, most), "toxic-sample")
    size = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        share = 1.0 if size.get(1) else 0.0
        return Model({}, bias=math.inf if share else -math.inf)
    counts = kept(token_counts(sample), "toxic-tokens")
    total = counts.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).first()
    scores = {r.token: r.score for r in log_odds(counts, total.toxic or 0, total.other or 0).collect()}  # bounded by the sample
    hits = {r.token: r.n for r in hit_counts(sample.filter("label = 0"), scores).collect()}

    best = best_segments(sample.filter("label = 0"), scores).collect()  # two numbers a row of the sample
    model = Model(scores)
    model.lam = _lambda([(scores[w], n) for w, n in hits.items()], sum(r.n for r in best))
    model.k = len(best) / sum(max(r.n, 1) * math.exp(-model.lam * r.best) for r in best)
    rows = score(sample.select(F.col("label").alias("doc_id"), "text"), model).select(F.col("doc_id").alias("label"), "evidence").collect()
    model.bias, model.slope = _logistic(np.array([r.evidence for r in rows]), np.array([r.label for r in rows], float))
    return model


def hit_counts(texts: DataFrame, scores: dict[str, float]) -> DataFrame:
    """``(token, n)``: how often each scored token occurs in ``texts(text)``, combined in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in small(batches):
            for text in b.column(0).to_pylist():
                seen.update(m[0] for m in TOKEN.finditer(text.lower()) if m[0] in scores)
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["token", "n"])

    return texts.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def best_segments(texts: DataFrame, scores: dict[str, float]) -> DataFrame:
    """``(n, best)``: tokens and the score of the best segment (or 0) of each of ``texts(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [scan(text, scores) for text in b.column(0).to_pylist()]
            best = [max((s for *_, s in segs), default=0.0) for _, segs in found]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array(best, pa.float64())], ["n", "best"])

    return texts.select("text").mapInArrow(run, "n long, best double")


def _lambda(seen: list[tuple[float, int]], tokens: int) -> float:
    """Positive root of ``sum p exp(lambda s) = 1`` over ``tokens`` tokens, of which ``seen`` tells (score, how often) of
    those above the drift; the others score ``-DRIFT``.  Without any of them one of score 1 is added, so that a root exists."""
    seen = seen or [(1.0, 1)]
    ups, often = np.array([s for s, _ in seen]), np.array([n for _, n in seen], float)
    rest = max(tokens - often.sum(), 1.0)
    low, high = 0.0, 50.0

    def excess(x: float) -> float:
        return float(often @ np.exp(np.minimum(x * ups, 700)) + rest * math.exp(-x * DRIFT) - often.sum() - rest)

    if excess(1e-6) >= 0:
        return 1e-6
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return max(low, 1e-6)


def expected(model: Model, n: int, score: float) -> float:
    """Log of the number of segments at least so good that a clean text of n tokens has by chance."""
    return math.log(model.k * max(n, 1)) - model.lam * score


def evidence(model: Model, n: int, found: list[float]) -> float:
    return sum(max(0.0, -expected(model, n, s)) for s in found)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by damped Newton steps with a small ridge; the slope is not negative."""
    scale = max(float(np.abs(x).mean()), 1e-9)
    design, w = np.stack([np.ones_like(x), np.minimum(x / scale, 50)], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hess, design.T @ (y - p) - 1e-3 * w), -2, 2)
    return float(w[0]), max(0.0, float(w[1])) / scale


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, evidence, passages)`` of every row of ``docs(doc_id, text)``.

    ``passages`` are the significant segments: first and last character (end excluded), score, and the
    number of such passages expected by chance.
    """
    rows = docs.select("doc_id", whole(F.col("text")).alias("text"))
    parts = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out = []
            for text in b.column(1).to_pylist():
                n, found = scan(text, model.scores)
                sure = [(i, j, s) for i, j, s in found if expected(model, n, s) < 0]
                spans = []
                if sure:
                    at = _places(text)
                    spans = [{"start": at[i][0], "end": at[j][1], "score": s, "expected": math.exp(expected(model, n, s))} for i, j, s in sure]
                total = evidence(model, n, [s for *_, s in found])
                out.append((model.probability(total), total, spans))
            p, e, s = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array(e, pa.float64()), pa.array(s, pa.list_(parts))], ["doc_id", "score", "evidence", "passages"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, evidence double, passages array<struct<start:int,end:int,score:double,expected:double>>")


def _places(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens in the text as it is, though lower case may be longer."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in TOKEN.finditer(low)]
    back = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    return [(back[a], back[z - 1] + 1) for a, z in (m.span() for m in TOKEN.finditer(low))]


def drop_toxic(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, with all their columns."""

    def passes(text: str) -> bool:
        n, found = scan(text, model.scores)
        return model.probability(evidence(model, n, [s for *_, s in found])) < cut

    return filtered(docs, lambda: lambda texts: map(passes, texts))
