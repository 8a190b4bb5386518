"""Quality by hashed word n-grams and logistic regression, trained by follow-the-regularised-leader.

A text's words (runs of word characters, and runs of other marks) give word n-grams up to ``ORDER``; the
same is done for their shapes, in which a word is written as its case, or as its distance if it stood among the
last three.  N-grams are hashed to ``2^BITS`` weights; counts are normalised to length one; a score is the sparse
dot product.  Training is FTRL-proximal, one document at a time, over a bounded sample of labelled rows
(``MOST``, see ``common.labelled``) in one task, in the order of the hashed ids, ``EPOCHS`` times.

Defined cases: null text counts as empty and has the bias alone; without labelled rows every score is 0.5;
ids may be null or repeated; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import filtered, labelled, slices, small, whole

TOKEN = re.compile(r"\w+|[^\w\s]+")
BITS, ORDER, MOST, EPOCHS, REMEMBER = 18, 2, 8_000, 3, 100_000
ALPHA, BETA, L1, L2 = 0.5, 0.1, 1e-4, 1e-3
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Hashed n-grams of texts, for many texts at a time; remembers a bounded number of words."""

    def __init__(self):
        self.places: dict[str, int] = {}  # of a word in ``codes``
        self.codes = np.empty((2, 0), np.uint64)

    def _codes(self, words: list[str]) -> np.ndarray:
        """Two rows, the hash and the shape of each word; every new word is looked at once."""
        if len(self.places) > REMEMBER:
            self.__init__()
        new, hashed = list(set(words).difference(self.places)), xxhash.xxh64_intdigest
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
        made = (hashed(w.lower().encode(), 1) for w in new), map(self._shape, new)
        self.codes = np.concatenate([self.codes, [np.fromiter(m, np.uint64, len(new)) for m in made]], axis=1)
        return self.codes[:, np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))]

    @staticmethod
    def _shape(w: str) -> int:
        if not (w[0].isalnum() or w[0] == "_"):
            return xxhash.xxh64_intdigest(w[:3].encode(), 2)
        # no two of lower, digit and the others hold for one word; an upper letter alone is upper and title
        case = 1 if w.islower() else 4 if w.isdigit() else 3 if w.isupper() else 2 if w.istitle() else 0
        return 4 + case * 4 + min(len(w) // 4, 3)

    def of_all(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Where each text begins, indices and values, for one slice of the texts after the other; index 0 is the bias."""
        for run in slices(texts):
            words = [TOKEN.findall(t) for t in run]
            text = np.repeat(np.arange(len(run), dtype=np.uint64), [len(ws) for ws in words])
            yield self._grams(text, *self._codes([w for ws in words for w in ws]), len(run))

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return next(self.of_all([text]))[1:]

    @staticmethod
    def _grams(text: np.ndarray, word: np.ndarray, shape: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``text`` says whose each word is; an n-gram has words of one text only, and the bias comes first."""
        for back in (3, 2, 1):
            shape[back:][(word[back:] == word[:-back]) & (text[back:] == text[:-back])] = back
        bits = np.uint64(BITS + 1)
        keys = [np.arange(n, dtype=np.uint64) << bits]
        for kind, codes in enumerate((word, shape)):
            h = codes * _MIX + np.uint64(kind)
            for order in range(1, ORDER + 1 + kind):
                own = text[: len(h)] == text[order - 1 :]
                mixed = h[own] * _MIX
                keys.append((text[: len(h)][own] << bits) + ((mixed ^ (mixed >> np.uint64(32))) * _MIX >> np.uint64(64 - BITS)) + np.uint64(1))
                h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _MIX + codes[order:] + np.uint64(order)
        keys, count = np.unique(np.concatenate(keys), return_counts=True)
        starts, index = np.searchsorted(keys, np.arange(n, dtype=np.uint64) << bits), (keys & np.uint64((2 << BITS) - 1)).astype(np.int64) - 1
        index[starts], square = 0, count.astype(float) ** 2
        square[starts] = 0.0
        length = np.sqrt(np.add.reduceat(square, starts)) if n else square
        value = count / np.repeat(np.where(length > 0, length, 1.0), np.diff(np.r_[starts, len(keys)]))
        value[starts] = 1.0
        return starts, index, value

    def probabilities(self, texts: Iterable[str], w: np.ndarray) -> np.ndarray:
        """The score of each text under the weights."""
        found = []
        for starts, index, value in self.of_all(texts):
            weights, ends = w[index].astype(float), np.r_[starts[1:], len(index)]
            found += [weights[a:z] @ value[a:z] for a, z in zip(starts, ends)]
        return 1 / (1 + np.exp(-np.array(found, float)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by FTRL-proximal: per weight an adaptive rate, a lazy L1 and L2 proximal step."""
    z, n, root = (np.zeros(1 << BITS) for _ in range(3))  # root: of n
    for _ in range(epochs):
        for index, value, label in rows:
            index, value = index.astype(np.intp), value.astype(float)
            zi, ni, before = z[index], n[index], root[index]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + before) / ALPHA + L2))
            g = (1 / (1 + np.exp(-min(max(wi @ value, -30), 30))) - label) * value
            after = ni + g * g
            root[index] = now = np.sqrt(after)
            z[index] = zi + g - (now - before) / ALPHA * wi
            n[index] = after
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, learn, most: int = MOST) -> np.ndarray:
    sample = labelled(docs, labels, "quality", learn, most).repartition(1).sortWithinPartitions("place", "doc_id", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, rows = Features(), []
        for b in small(batches):
            labels = iter(b.column(1).to_pylist())
            for starts, index, value in features.of_all(b.column(0).to_pylist()):
                parts = zip(np.split(index.astype(np.int32), starts[1:]), np.split(value.astype(np.float32), starts[1:]))
                rows += [(*part, next(labels)) for part in parts]
        yield pa.RecordBatch.from_arrays([pa.array([train(rows).tobytes()], pa.binary())], ["weights"])

    found = sample.select("text", "label").mapInArrow(run, "weights binary").collect()
    return np.frombuffer(found[0].weights, np.float32) if found else np.zeros(1 << BITS, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(doc_id, score)`` of every row of ``docs(doc_id, text)``; the weights are of fixed size."""
    rows = docs.select("doc_id", whole(F.col("text")).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(), model.value
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(features.probabilities(b.column(1).to_pylist(), w))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, cut: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        features, w = Features(), model.value

        return lambda texts: features.probabilities(texts, w) >= cut

    return filtered(docs, make)
