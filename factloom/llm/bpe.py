"""Byte-level BPE encoding and decoding with DuckDB's recursive queries, one database per task.

Encoding: a text is cut by the vocabulary's pattern; what a task has not met yet becomes rows
``(word, pos, id)``, a row per byte, linked to its right neighbour.  A recursive query joins every pair of
neighbours with the merge table and contracts, in every word, the leftmost pair of least rank (rank and position
are packed in one number, whose minimum it takes), until no word has a pair left.  The
merge table holds each way to cut a vocabulary entry in two entries.  Pieces longer than ``LONG`` bytes,
where a step per token would cost the square of the length, are contracted by the same rule with a heap.

Decoding: id rows join the vocabulary and an ordered aggregation puts each document's bytes together, in runs
of at most ``RUN`` ids, so that a very long text takes more queries and not a larger one.

A task cuts its texts in white-space chunks (see ``tokens``) as Arrow columns and asks the queries for the distinct
ones; a document's ids, and the bytes these decode to, are those of its chunks one behind the other.

Defined cases: null text counts as empty, which has no ids; documents are rows, so repeated and null
ids are carried through; an unknown id in ``decode`` raises; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import slices, small, whole
from factloom.llm.tokens import WHITE, WORD, Remembered, chunked, joined, offsets_of, text_slices

LONG, WORDS = 128, 20_000
#: Bytes a worker remembers of pieces and of chunks.
PIECES, CHUNKS = 96 << 20, 96 << 20
#: Bytes of texts worked on at once (one text at least), and most chunks encoded at once.
SLICE, SOME = 2 << 20, 100_000
#: Most ids in one decoding query; longer documents are decoded in runs.
RUN = 300_000
#: Most squared bytes of the words of a recursive query, which holds the rows of every step: at most half as many.
SQUARES = 4_000_000

ENCODE = """
WITH RECURSIVE tok AS (
    SELECT word, pos, id, next_pos, next_id, 0 AS step FROM start
    UNION ALL
    SELECT t.word, t.pos,
      CASE WHEN t.pos = b.at THEN b.id ELSE t.id END,
      CASE WHEN t.pos = b.at THEN b.next_pos ELSE t.next_pos END,
      CASE WHEN t.pos = b.at THEN b.next_id WHEN t.next_pos = b.at THEN b.id ELSE t.next_id END,
      t.step + 1
    FROM tok t
    JOIN (SELECT c.word, CAST(c.best & 4294967295 AS INTEGER) AS at, CAST(c.best >> 32 AS INTEGER) AS id, c.gone, n.next_pos, n.next_id
          FROM (SELECT l.word, min(m.best | l.pos) AS best, arg_min(l.next_pos, m.best | l.pos) AS gone
                FROM tok l JOIN merges m ON m.pair = (CAST(l.id AS BIGINT) << 32 | l.next_id) GROUP BY l.word) c
          JOIN tok n ON n.word = c.word AND n.pos = c.gone) b ON b.word = t.word
    WHERE t.pos <> b.gone
)
SELECT word, id FROM tok JOIN (SELECT word, max(step) AS step FROM tok GROUP BY word) USING (word, step) ORDER BY word, pos
"""

DECODE = "SELECT coalesce(string_agg(v.piece, '' ORDER BY i.pos), '') FROM ids i JOIN vocab v USING (id)"


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


#: Patterns that take letters behind at most one blank as one piece.
LETTERS = re.compile(r"('\w+\|)* \?\\p\{L\}\+(\||$)")


#: Whether a chunk is Latin letters behind at most one blank.
plain = WORD


class DuckBpe:
    def __init__(self, path: str, pattern: str):
        self.ranks = ranks_of(path)
        # the pattern's white space spelled out: engines differ in what \s holds
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.letters = LETTERS.match(pattern)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        cut = [(self.ranks[w[:i]] << 32 | self.ranks[w[i:]], r << 32) for w, r in self.ranks.items() for i in range(1, len(w)) if w[:i] in self.ranks and w[i:] in self.ranks]
        pairs, best = (pa.array(c, pa.int64()) for c in zip(*cut))
        self._table("merges", pa.table({"pair": pairs, "best": best}))
        # a byte per character, so that ordered text aggregation joins bytes
        self._table("vocab", pa.table({"id": pa.array(self.ranks.values(), pa.int64()), "piece": [w.decode("latin-1") for w in self.ranks]}))
        self.largest = max(self.ranks.values())
        self.size = np.zeros(self.largest + 1, np.int64)
        self.size[list(self.ranks.values())] = list(map(len, self.ranks))
        self.entries = {w: r.to_bytes(4, "little") for w, r in self.ranks.items()}
        self.pieces = Remembered(self._encode_pieces, PIECES)
        self.chunks = Remembered(self._encode_chunks, CHUNKS)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word by the recursive query."""
        return [np.frombuffer(ids, "<i4") for ids in self._merged(words)]

    def _merged(self, words: list[bytes]) -> list[bytes]:
        """The same as little-endian bytes, cut from one buffer."""
        sizes = np.array([len(w) for w in words], np.int32)
        flat, lasts = self.byte[np.frombuffer(b"".join(words), np.uint8)], np.cumsum(sizes) - 1
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = np.arange(len(flat), dtype=np.int32) - np.repeat(np.cumsum(sizes, dtype=np.int32) - sizes, sizes)
        last = np.zeros(len(flat), bool)
        last[lasts] = True
        after = {"next_pos": pa.array(pos + 1, mask=last), "next_id": pa.array(np.append(flat[1:], np.int32(0)), mask=last)}
        self.db.register("start", pa.table({"word": word, "pos": pos, "id": flat, **after}))
        got = self.db.execute(ENCODE).fetchnumpy()
        self.db.unregister("start")
        raw = got["id"].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(got["word"], minlength=len(words)))).tolist()
        return [raw[at:end] for at, end in zip([0, *ends], ends)]

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same contraction for one long word: a heap of (rank, position), leftmost first among equals."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        parts = [word[i : i + 1] for i in range(len(word))]
        after, before, rank = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), self.ranks

        def pair(i):
            j = after[i]
            return rank.get(parts[i] + parts[j]) if j < len(ids) else None

        heap = [(r, i) for i in range(len(ids) - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if parts[i] is None or pair(i) != r:
                continue
            j = after[i]
            parts[i], ids[i], parts[j] = parts[i] + parts[j], r, None
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (q := pair(k)) is not None:
                    heapq.heappush(heap, (q, k))
        return np.array([x for x, p in zip(ids, parts) if p is not None], np.int64)

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        found = list(map(self.entries.get, raw))
        todo = [i for i, ids in enumerate(found) if ids is None]
        for i in [i for i in todo if len(raw[i]) > LONG]:
            found[i] = self._merge_long(raw[i]).astype("<i4").tobytes()
        todo = sorted((i for i in todo if found[i] is None), key=lambda i: len(raw[i]))  # alike in number of steps
        squares, at = np.cumsum([len(raw[i]) ** 2 for i in todo]), 0
        while at < len(todo):
            most = SQUARES + (squares[at - 1] if at else 0)
            end = min(at + WORDS, max(at + 1, int(np.searchsorted(squares, most, "right"))))
            few, at = todo[at:end], end
            for i, ids in zip(few, self._merged([raw[i] for i in few]), strict=True):
                found[i] = ids
        return found

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        return list(chain.from_iterable(self._encode_some(chunks[at : at + SOME]) for at in range(0, len(chunks), SOME)))

    def _encode_some(self, chunks: list[str]) -> list[bytes]:
        findall = self.pattern.findall
        parts = [[c] if self.letters and plain(c) else findall(c) for c in chunks]
        ids = iter(self.pieces.of([list(chain.from_iterable(parts))])[0])
        return [next(ids) if len(p) == 1 else b"".join(islice(ids, len(p))) for p in parts]

    def encode_lists(self, texts: pa.Array) -> tuple[pa.ListArray, Callable[[], pa.BinaryArray]]:
        """The ids of each text, and a function that decodes them again."""
        chunks, firsts = chunked(texts.cast(pa.large_string()))
        found = pa.array(self.chunks.distinct(chunks.dictionary.to_pylist()), pa.large_binary())
        at, raw = joined(found, chunks, firsts)

        def back() -> pa.BinaryArray:
            at, raw = joined(self._decoded(np.frombuffer(found.buffers()[2] or b"", "<i4"), offsets_of(found) // 4), chunks, firsts)
            return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at), raw]).cast(pa.binary())

        return pa.ListArray.from_arrays((at // 4).astype(np.int32), np.frombuffer(raw, "<i4")), back

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for few in slices(texts):
            for ids in self.encode_lists(pa.array(few, pa.large_string()))[0]:
                yield ids.values.to_numpy()

    def _decode_run(self, flat: np.ndarray) -> bytes:
        self.db.register("ids", pa.table({"pos": np.arange(len(flat)), "id": flat}))
        ((text,),) = self.db.execute(DECODE).fetchall()
        self.db.unregister("ids")
        return text.encode("latin-1")

    def _decoded(self, flat: np.ndarray, bounds: np.ndarray) -> pa.LargeBinaryArray:
        """The bytes of runs of ids that lie one behind the other between ``bounds``."""
        if len(flat) and (flat.min() < 0 or flat.max() > self.largest or not self.size[flat].all()):
            raise ValueError("an id outside the vocabulary")
        raw = b"".join(self._decode_run(flat[at : at + RUN]) for at in range(0, len(flat), RUN))
        ends = np.r_[0, np.cumsum(self.size[flat])][bounds]
        return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])

    def decode(self, docs: list[np.ndarray]) -> list[bytes]:
        bounds = np.cumsum([0, *map(len, docs)], dtype=np.int64)
        return self._decoded(np.concatenate([*docs, np.empty(0, np.int32)]).astype(np.int64), bounds).to_pylist()


_LOADED: dict[tuple[str, str], DuckBpe] = {}


def duck_bpe(path: str, pattern: str) -> DuckBpe:
    """One per Python worker: its database and what it remembers serve later tasks too."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = DuckBpe(path, pattern)
    return _LOADED[path, pattern]


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of ``(doc_id, text)`` with about ``SLICE`` bytes of texts each."""
    return text_slices(batches, SLICE)


def _mapped(rows: DataFrame, path: str, pattern: str, columns: dict[str, str], cut: Callable, make: Callable) -> DataFrame:
    """``make(coder, values)`` gives Arrow columns for the second column of what ``cut`` makes of the batches of ``rows``; the first is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = duck_bpe(path, pattern)
        for b in cut(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), *make(coder, b.column(1))], ["doc_id", *columns])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{n} {t}" for n, t in columns.items())]))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` of ``docs(doc_id, text)``, map-only."""
    rows = docs.select("doc_id", whole(F.col("text")).alias("text"))
    return _mapped(rows, path, pattern, {"ids": "array<int>"}, texts_of, lambda coder, texts: [coder.encode_lists(texts)[0]])


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, bytes)`` of ``rows(doc_id, ids)``, map-only; null ids count as none."""
    rows = rows.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            at = 0
            for few in slices(b.column(1)):
                yield b.slice(at, len(few))
                at += len(few)

    def make(coder: DuckBpe, lists: pa.ListArray) -> list[pa.Array]:
        return [pa.array(coder.decode([x.values.to_numpy(zero_copy_only=False) for x in lists]), pa.binary())]

    return _mapped(rows, path, pattern, {"bytes": "binary"}, cut, make)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, bytes)``: texts encoded and their ids decoded again, in one pass."""
    rows = docs.select("doc_id", whole(F.col("text")).alias("text"))

    def make(coder: DuckBpe, texts: pa.Array) -> list[pa.Array]:
        ids, back = coder.encode_lists(texts)
        return [ids, back()]

    return _mapped(rows, path, pattern, {"ids": "array<int>", "bytes": "binary"}, texts_of, make)
