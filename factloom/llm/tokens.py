"""Token ids of whole texts, by white-space chunk.

A chunk is a run of white space with the run of other characters behind it.  Byte-level vocabularies
split a text at the start of every such chunk anyway, so a chunk has the same ids wherever it stands:
each task cuts its texts in chunks as Arrow columns, encodes the distinct ones of a slice that it has not met
yet and joins a text's ids from them.  What a task remembers is bounded by ``REMEMBER`` bytes (see
``Remembered``).  Strings of special tokens get their own ids, as the library gives them by default.

Chunks of Latin letters, digits and ASCII marks are cut further, in the pieces of the split pattern of byte-level
vocabularies, which the library's model encodes; all other chunks, and all of a tokenizer that is made
otherwise, go through the whole library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from factloom.llm.common import slices

#: Bytes a task remembers, and characters of the longest key it remembers.
REMEMBER, LONG = 64 << 20, 100
#: Bytes of texts worked on at once (one text at least), and most chunks or pieces encoded at once.
SLICE, SOME = 1 << 20, 100_000
#: Bytes of an entry besides its key and value, and bits (a byte each) for keys met once.
ENTRY, MET = 190, 4 << 20

#: The white space of the vocabularies' split pattern.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Chunks that stay as they are between line feeds.
PLAIN = re.compile(f" ?[^{WHITE}]+")

#: Letters of which every engine holds the same, and ASCII that is neither letter, digit nor apostrophe.
LATIN, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
WORD = re.compile(f" ?[{LATIN}]+").fullmatch
#: What byte-level vocabularies (GPT-2's split pattern) take as one piece, of these characters.
PIECE = re.compile(f" ?(?:[{LATIN}]+|[0-9]+|[{MARKS}]+)").fullmatch
#: Kinds of bytes: 1 letter, 2 digit, 3 mark, 4 line feed or blank; 0 any other, whose chunk is not cut.
KIND = np.zeros(256, np.uint8)
for _kind, _span in ((1, "[A-Za-z]"), (2, "[0-9]"), (3, f"[{MARKS}]"), (4, "[ \n]")):
    KIND[[i for i in range(128) if re.match(_span, chr(i))]] = _kind
KIND[0x80:0xC0] = KIND[0xC3:0xCA] = 1  # of two bytes from À to ɏ; wider characters have another first byte
#: The character that stands for each byte in byte-level vocabularies; 0 stays, between pieces.
OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTER = np.arange(256, dtype="<u4")
LETTER[np.setdiff1d(np.arange(256), OWN)] = 256 + np.arange(256 - len(OWN))
LETTER[0] = 0


#: White space in UTF-8: single bytes, and longer ones by their first byte.
BLANKS = [c.encode() for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c)]
BLANK = np.isin(np.arange(256), [b[0] for b in BLANKS if len(b) == 1])
WIDE = {lead: [b for b in BLANKS if len(b) > 1 and b[0] == lead] for lead in {b[0] for b in BLANKS if len(b) > 1}}


def offsets_of(column: pa.Array) -> np.ndarray:
    """Where the values of a large text or binary column start in its buffer, and where the last ends."""
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


def _cut(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts without nulls, which of them are white space, which start a chunk, and where each text starts; last, their number."""
    bounds = offsets_of(texts)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    white = BLANK[raw]
    for lead, wide in WIDE.items():
        at = np.flatnonzero(raw == lead)
        for blank in wide if len(at) else ():
            here = at
            for i, byte in enumerate(blank[1:], 1):
                here = here[raw[here + i] == byte]
            for i in range(len(blank)):
                white[here + i] = True
    starts = white.copy()
    starts[1:] &= ~white[:-1]
    bounds = bounds - bounds[0]
    starts[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return raw, white, starts, bounds


def _parts(raw: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    ends = np.append(np.flatnonzero(starts), len(raw))
    parts = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw))
    return parts.dictionary_encode(), np.searchsorted(ends, bounds)


def chunked(texts: pa.LargeStringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All chunks (as ``tokens.CHUNK`` finds them) of texts without nulls, and the number of each text's first; last, their number."""
    raw, _, starts, bounds = _cut(texts)
    return _parts(raw, starts, bounds)


def pieced(texts: pa.LargeStringArray, special: Iterable[str] = ()) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The same with chunks of letters, digits and marks cut where byte-level vocabularies cut them.

    A chunk stays whole if it has another character, an apostrophe (``'s`` is a piece, ``'x`` is two), more white
    space than one blank or line feed, or a string of ``special``.
    """
    raw, white, starts, bounds = _cut(texts)
    if not len(raw):
        return _parts(raw, starts, bounds)
    kind = KIND[raw]
    kind[white & ~starts] = 0
    wide = np.flatnonzero((raw == 0xC3) | (raw == 0xC9))
    after = raw[np.minimum(wide + 1, len(raw) - 1)]
    kind[wide[np.where(raw[wide] == 0xC3, (after == 0x97) | (after == 0xB7), after > 0x8F)]] = 0  # × and ÷, and from ɐ on
    every = raw.tobytes() if special else b""
    for content in special:
        kind[[m.start() for m in re.finditer(re.escape(content.encode()), every)]] = 0
    first = np.flatnonzero(starts)
    easy = np.repeat(np.minimum.reduceat(kind, first) > 0, np.diff(np.append(first, len(raw))))
    # a blank belongs to what follows it, a line feed to nothing
    starts[1:] |= easy[1:] & (kind[1:] != kind[:-1]) & (raw[:-1] != 0x20)
    return _parts(raw, starts, bounds)


def strings(values: pa.Array) -> list[str]:
    """The values of a text column without nulls."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(pa.string())) if len(values) else None
    if whole is None:
        return []
    found = pc.binary_join(whole, "\0")[0].as_py().split("\0")
    return found if len(found) == len(values) else values.to_pylist()


def joined(values: pa.Array, chunks: pa.DictionaryArray, firsts: np.ndarray) -> tuple[np.ndarray, pa.Buffer]:
    """The values of all chunks in one buffer, and where each text's start in it."""
    every = values.take(chunks.indices)
    return offsets_of(every)[firsts], every.buffers()[2] or pa.py_buffer(b"")


def text_slices(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``(doc_id, text)`` with about ``most`` bytes of texts each, one text at least."""
    for b in batches:
        ends, at = offsets_of(b.column(1).cast(pa.large_string()))[1:], 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end


class Kept(dict):
    """A dictionary that asks ``rest`` for what it lacks."""

    def __missing__(self, key: str) -> bytes:
        return self.rest[key]


class Remembered:
    """Values of keys, computed once while remembered; ``most`` bounds the bytes of all that is kept.

    A key is kept when it is met a second time (a bit per hashed key says so; a clash only keeps one early),
    as most keys of natural text never come back.  Two generations: when the young one holds half of the
    bytes it becomes the old one, and keys met again move back, so frequent keys stay.  Keys longer than
    ``LONG`` are not kept.
    """

    def __init__(self, make: Callable[[list[str]], list], most: int):
        self.make, self.most, self.young, self.old = make, most, Kept(), {}
        self.bytes, self.met = 0, bytearray(MET)

    def _keep(self, key: str, value: bytes) -> None:
        self.young[key] = value
        self.bytes += ENTRY + len(key) + len(value)

    def of(self, groups: list[list[str]]) -> list[list]:
        """Per group the values of its keys."""
        if self.bytes > self.most // 2:
            self.young, self.old, self.bytes, self.met = Kept(), self.young, 0, bytearray(MET)
        missing = set().union(*groups).difference(self.young)
        found = {k: self.old[k] for k in missing if k in self.old}
        new = [k for k in missing if k not in found]
        for key, value in found.items():
            self._keep(key, value)
        for key, value in zip(new, self.make(new), strict=True):
            found[key] = value
            if len(key) <= LONG:
                at = hash(key) % MET
                if self.met[at]:
                    self._keep(key, value)
                self.met[at] = 1
        self.young.rest = found
        values = [list(map(self.young.__getitem__, g)) for g in groups]
        self.young.rest = {}
        return values

    def distinct(self, keys: list) -> list:
        """The values of keys that all differ; fewer steps a key than ``of``."""
        if self.bytes > self.most // 2:
            self.young, self.old, self.bytes, self.met = Kept(), self.young, 0, bytearray(MET)
        values = list(map(self.young.get, keys))
        missing = [i for i, v in enumerate(values) if v is None]
        if self.old:
            for i in missing:
                if (value := self.old.get(keys[i])) is not None:
                    values[i] = value
                    self._keep(keys[i], value)
            missing = [i for i in missing if values[i] is None]
        new = [keys[i] for i in missing]
        at, met = np.fromiter(map(hash, new), np.int64, len(new)) % MET, np.frombuffer(self.met, np.uint8)
        for i, value, again in zip(missing, self.make(new), met[at].tolist(), strict=True):
            values[i] = value
            if again and len(keys[i]) <= LONG:
                self._keep(keys[i], value)
        met[at] = 1
        return values


def by_letters(tokenizer) -> bool:
    """Whether the tokenizer is a plain byte-level one, whose model gets the pieces that ``PIECE`` tells."""
    cut, model = tokenizer.pre_tokenizer, tokenizer.model
    plain = type(cut).__name__ == "ByteLevel" and cut.use_regex and not cut.add_prefix_space
    return plain and tokenizer.normalizer is None and type(model).__name__ == "BPE" and not model.dropout


class LibraryIds:
    """Ids by the tokenizers library as little-endian bytes of ``width`` bytes each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.by_letters = self.tokenizer.model, by_letters(self.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.line = self._ids(["\n"])[0]
        self.chunks = Remembered(self._encode, REMEMBER)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes(self, ids: list[list[int]]) -> list[bytes]:
        raw, w = np.array(list(chain.from_iterable(ids)), f"<u{self.width}").tobytes(), self.width
        ends = (w * np.cumsum(list(map(len, ids)), dtype=np.int64)).tolist()
        return [raw[at:end] for at, end in zip([0, *ends], ends)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        letters = LETTER[np.frombuffer("\0".join(pieces).encode(), np.uint8)].tobytes().decode("utf-32-le").split("\0")
        tokenize = self.model.tokenize
        return self._bytes([[t.id for t in tokenize(p)] for p in letters])

    def _encode_any(self, chunks: list[str]) -> list[bytes]:
        """By the whole library."""
        found: dict[str, bytes] = {}
        plain = [c for c in chunks if len(c) <= LONG and PLAIN.fullmatch(c)] if len(self.line) == 1 else []
        for at in range(0, len(plain), 20_000):  # one call for many: a line feed between two is a token of its own
            run = plain[at : at + 20_000]
            ids = np.array(self._ids(["\n".join(run)])[0], np.uint32)
            ends = np.flatnonzero(ids == self.line[0]).tolist() + [len(ids)]
            raw, w, start = ids.astype(f"<u{self.width}").tobytes(), self.width, 0
            for c, end in zip(run, ends, strict=True):
                found[c] = raw[start * w : end * w]
                start = end + 1
        rest = [c for c in chunks if c not in found]
        found.update(zip(rest, self._bytes(self._ids(rest)), strict=True))
        return [found[c] for c in chunks]

    def _encode_some(self, chunks: list[str]) -> list[bytes]:
        if not self.by_letters:
            return self._encode_any(chunks)
        one = list(map(PIECE, chunks))
        every = "\0".join(chunks)
        for content in self.special:
            if content in every:
                one = [p and content not in c for p, c in zip(one, chunks)]
        pieces = iter(self._encode_pieces([c for c, p in zip(chunks, one) if p]))
        others = iter(self._encode_any([c for c, p in zip(chunks, one) if not p]))
        return [next(pieces if p else others) for p in one]

    def _encode(self, chunks: list[str]) -> list[bytes]:
        return list(chain.from_iterable(self._encode_some(chunks[at : at + SOME]) for at in range(0, len(chunks), SOME)))

    def of_column(self, texts: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
        """The ids of all texts in one buffer, and where (in bytes) each text's start in it; last, where they end."""
        texts = texts.cast(pa.large_string())
        parts, firsts = pieced(texts, self.special) if self.by_letters else chunked(texts)
        return joined(pa.array(self.chunks.distinct(strings(parts.dictionary)), pa.large_binary()), parts, firsts)

    def of_batches(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Buffer]]:
        """Slices of ``(key, text)`` with what ``of_column`` gives; at the end all is forgotten.

        An executor may keep more idle workers than it has cores, each with its memory.
        """
        try:
            for few in text_slices(batches, SLICE):
                yield few, *self.of_column(few.column(1))
        finally:
            self.chunks = Remembered(self._encode, REMEMBER)
            pa.default_memory_pool().release_unused()

    def of(self, texts: Iterable[str]) -> Iterator[bytes]:
        for few in slices(list(texts)):
            at, raw = self.of_column(pa.array(few, pa.large_string()))
            view = memoryview(raw)
            yield from (bytes(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist()))


_LOADED: dict[str, LibraryIds] = {}


def library_ids(path: str) -> LibraryIds:
    """One per Python worker, as it takes long to load."""
    if path not in _LOADED:
        _LOADED[path] = LibraryIds(path)
    return _LOADED[path]
