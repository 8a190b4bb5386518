"""Packing by power-of-two decomposition.

A document of n tokens (its end id included) is cut in pieces of ``CAPACITY`` and then in the powers of
two of the rest, largest first.  Every piece is a sequence of its own, so no sequence crosses documents
and none is padded; sequences of equal length form a bucket.  The high bits of ``sequence_id`` are the
bucket, so ids are unique, sort by bucket, and need neither a shuffle nor a count of what others hold:
4 bits length exponent, 27 bits task, 32 bits number in the task.

Defined cases: null text counts as empty, an empty text is its end id alone; a null or repeated doc_id
is carried through, its pieces belong to its own row; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import whole
from factloom.llm.tokens import library_ids

CAPACITY, END = 1024, 0

_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n tokens; ``capacity`` is a power of two."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``; ``with_ids`` adds the piece's token ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    if capacity & capacity - 1:
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, task, numbers = library_ids(tokenizer), TaskContext.get().partitionId(), [0] * 64
        for few, at, raw in made.of_batches(batches):
            ends = at // made.width + np.arange(len(at))  # an end id behind each document
            flat, last = np.empty(ends[-1], "<u4"), np.zeros(ends[-1], bool)
            last[ends[1:] - 1] = True
            flat[last], flat[~last] = end, np.frombuffer(raw, f"<u{made.width}", int(at[-1] - at[0]) // made.width, int(at[0]))
            sizes = np.diff(ends)
            pieces = [cuts(n, capacity) for n in sizes.tolist()]
            counts = np.array(list(map(len, pieces)), np.int64)
            length = np.fromiter(chain.from_iterable(pieces), np.int64, int(counts.sum()))
            stop, doc, ids = np.cumsum(length), np.repeat(np.arange(len(counts)), counts), memoryview(flat).cast("B")
            crc = [zlib.crc32(ids[4 * (z - n) : 4 * z]) for z, n in zip(stop.tolist(), length.tolist())]
            bucket = np.frexp(length)[1].astype(np.int64) - 1
            number = np.empty(len(length), np.int64)
            for b in np.unique(bucket).tolist():
                here = np.flatnonzero(bucket == b)
                number[here] = numbers[b] + np.arange(len(here))
                numbers[b] += len(here)
            start = stop - length - (ends[:-1] - ends[0])[doc]
            columns = [start, length, np.array(crc, np.int64), sizes[doc], bucket << 59 | task << 32 | number, np.zeros(len(length), np.int64)]
            arrays = [few.column(0).take(pa.array(doc)), *map(pa.array, columns)]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(np.append(0, stop).astype(np.int32), pa.array(flat.view("<i4"))))
            yield pa.RecordBatch.from_arrays(arrays, _NAMES[: len(arrays)])

    return rows.mapInArrow(run, _COLUMNS + (", ids array<int>" if with_ids else ""))


_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")] + ["ids"]
