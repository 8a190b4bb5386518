"""Token ids in binary files with Elias-Fano encoded document boundaries.

A folder holds shard files; shards follow each other in ascending doc_id, rows of one doc_id by text,
rows without an id first.  A shard file is, little-endian:

    ids      the concatenated ids of its documents, 2 or 4 bytes each
    starts   Elias-Fano sequence: where each document starts in ``ids``, and the total at the end
    doc_ids  Elias-Fano sequence: the non-null doc_ids less the smallest
    footer   JSON: section sizes, parameters, smallest doc_id, number of rows without an id
    8 bytes  length of the footer, and the magic ``EFID``

An Elias-Fano sequence of n values below u keeps the low ``log2(u / n)`` bits of each value packed, the
high parts as a bitmap with a one per value (value i sets bit ``high_i + i``), and the position of every
``EVERY``-th one.  ``select(i)`` starts at the nearest kept position and counts ones from there, so
an offset costs about 2 + log2(u / n) bits and no table of 64-bit offsets exists.

Documents are shuffled once, by range.  A task writes its shard under a name of its own attempt; only
names in the written manifest count, so lost executors and repeated attempts leave nothing wrong.  The
folder must be one that pyarrow's file systems open (file, hdfs, s3, gs, abfs).

Defined cases: null text counts as empty, an empty text has the end id alone; rows without an id and
repeated rows are kept as rows of their own; an empty table gives an empty folder and an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import kept, shared_path, whole
from factloom.llm.tokens import library_ids

END, EVERY, BLOCK, MAGIC = 0, 256, 1 << 20, b"EFID"


def ef_encode(values: np.ndarray, below: int) -> tuple[dict, bytes]:
    """Parameters and bytes of a non-decreasing sequence of values in [0, below)."""
    values, n = np.asarray(values, np.uint64), len(values)
    low_bits = max(0, (max(below, 1) // max(n, 1)).bit_length() - 1)
    low = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    bitmap = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    bitmap[ones] = 1
    parts = [np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(bitmap, bitorder="little").tobytes(), ones[::EVERY].astype("<u4").tobytes()]
    return {"n": n, "low_bits": low_bits, "sizes": [len(p) for p in parts]}, b"".join(parts)


class EliasFano:
    def __init__(self, about: dict, raw: bytes):
        self.n, self.low_bits = about["n"], about["low_bits"]
        a, b, _ = about["sizes"]
        self.low, self.high = np.frombuffer(raw[:a], np.uint8), np.frombuffer(raw[a : a + b], np.uint8)
        self.kept = np.frombuffer(raw[a + b :], "<u4")

    def select(self, i: int) -> int:
        """The i-th value, from a few bytes around it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.kept[i // EVERY]), i % EVERY
        byte = at // 8
        here = int(self.high[byte]) >> at % 8 << at % 8
        while left >= here.bit_count():
            left -= here.bit_count()
            byte += 1
            here = int(self.high[byte])
        for _ in range(left):
            here &= here - 1
        one = byte * 8 + (here & -here).bit_length() - 1
        first = i * self.low_bits
        bits = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little") >> first % 8
        return one - i << self.low_bits | bits & (1 << self.low_bits) - 1

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        low = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits) if self.low_bits else np.zeros((self.n, 0), np.uint8)
        return high | (low.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class Shard:
    """One file, opened for reading; sections are read when asked for."""

    def __init__(self, path: str):
        system, inner = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[8:] != MAGIC:
            raise ValueError(f"not an id file: {path}")
        n = int.from_bytes(tail[:8], "little")
        self.about = json.loads(self.file.read_at(n, size - 12 - n))
        self.width, at = self.about["width"], self.about["ids_bytes"]
        self.starts = EliasFano(self.about["starts"], self.file.read_at(sum(self.about["starts"]["sizes"]), at))
        self._doc_ids_at = at + sum(self.about["starts"]["sizes"])

    def __len__(self) -> int:
        return self.starts.n - 1

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by two selects and one read."""
        a, b = self.starts.select(i), self.starts.select(i + 1)
        return self.span(a, b)

    def span(self, a: int, b: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")

    def doc_ids(self) -> list[int | None]:
        about = self.about["doc_ids"]
        found = EliasFano(about, self.file.read_at(sum(about["sizes"]), self._doc_ids_at)).all()
        return [None] * self.about["without_id"] + [int(v) + self.about["smallest"] for v in found]


def _write_shard(folder: str, rows: Iterator[tuple[int | None, memoryview]], width: int, end: int) -> tuple[str, int, int] | None:
    """Stream (doc_id, raw ids) into a new file; nothing but the boundaries stays in memory."""
    first = next(rows, None)
    if first is None:
        return None
    task = TaskContext.get()
    name = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.efid"
    system, inner = fs.FileSystem.from_uri(name)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    starts, doc_ids, total, stop = [0], [], 0, end.to_bytes(width, "little")

    def each():
        yield first
        yield from rows

    with system.open_output_stream(inner, buffer_size=1 << 20) as out:
        for doc_id, raw in each():
            out.write(raw)
            out.write(stop)
            total += len(raw) // width + 1
            starts.append(total)
            doc_ids.append(doc_id)
        named = np.array([d for d in doc_ids if d is not None], np.int64)
        low = int(named[0]) if len(named) else 0
        about = {"width": width, "ids_bytes": total * width, "smallest": low, "without_id": len(doc_ids) - len(named)}
        about["starts"], body = ef_encode(np.array(starts), total + 1)
        out.write(body)
        shifted = named.view(np.uint64) - np.int64(low).astype(np.uint64)
        about["doc_ids"], body = ef_encode(shifted, int(shifted[-1]) + 1 if len(named) else 1)
        out.write(body)
        footer = json.dumps(about).encode()
        out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
    return name, len(doc_ids), total


def write_ids(docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = END) -> DataFrame:
    """Write the files; returns the manifest ``(shard, file, n_docs, n_ids)``, itself a written table."""
    folder = folder or shared_path(docs.sparkSession, "token-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = library_ids(tokenizer)

        def each() -> Iterator[tuple[int | None, memoryview]]:
            for few, at, raw in made.of_batches(batches):
                ids = memoryview(raw)
                yield from zip(few.column(0).to_pylist(), (ids[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist())))

        wrote = _write_shard(folder, each(), made.width, end)
        if wrote:
            values = [TaskContext.get().partitionId(), *wrote]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["shard", "file", "n_docs", "n_ids"])

    return kept(rows.mapInArrow(run, "shard long, file string, n_docs long, n_ids long"), "token-ids-manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    rows = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    rows = rows.repartition(max(1, manifest.count()), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(*(c.to_pylist() for c in b.columns)):
                shard = Shard(path)
                starts, ids = shard.starts.all().astype(np.int64), shard.doc_ids()
                at = 0
                while at < len(ids):  # one read for documents of about BLOCK ids together
                    to = max(at + 1, min(int(np.searchsorted(starts, starts[at] + BLOCK)), len(ids)))
                    block, a, z = shard.span(int(starts[at]), int(starts[to])).astype("<u4"), starts[at:to], starts[at + 1 : to + 1]
                    crc = [zlib.crc32(block[i:j].tobytes()) for i, j in zip((a - a[0]).tolist(), (z - a[0]).tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at:to], pa.int64()), pa.array(a + base), pa.array(z - a), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    at = to

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def open_shards(spark: SparkSession, manifest: DataFrame) -> Iterator[Shard]:
    """The files in order, for random access from a client."""
    for row in manifest.orderBy("shard").select("file").toLocalIterator():
        yield Shard(row.file)
