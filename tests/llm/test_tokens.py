import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import bpe, elias_fano, packing, tokens

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

TEXTS = [
    "", " ", "  ", "\n", "a", "a  b", "a \n b", "a\t\n b", "a\x0b\xa0 b", "word  x", "tail  ", "\n\nx\n", "it's we'll\x1cx", "a\x85b", "<|endoftext|> x", "end<|endoftext|>start", "a  <|endoftext|>  b <|endoftext|>", "<|endoftext|><|endoftext|>\n y",
    "Straße déjà-vu \U0001f600\U0001f600 12345 $$$%%% !!", "x" * 3000, " " * 900 + "y", "ab" * 500, "日本語のテキスト です", "a​b ﻿ c", "\r\n\r\n q", "".join(map(chr, range(1, 400))),
]
PAIRS = [(i * 3 % 29, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (40, None), (41, "twice"), (41, "twice"), (42, "many words here, " * 9000)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranks():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def duck():
    return bpe.DuckBpe(RANKS, public_tokenizers.PATTERN)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---------------------------------------------------------------- ids by chunk
def test_chunked_ids_are_the_librarys(library):
    made = tokens.LibraryIds(JSON)
    got = [np.frombuffer(raw, "<u2").tolist() for raw in made.of(TEXTS * 2)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in TEXTS * 2]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n\t\r\x0b\xa0 'sab1.$"), max_size=40) | st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "a", "'s", "1", "  ", "?"]), max_size=12).map("".join))
def test_chunked_ids_are_the_librarys_on_any_text(library, text):
    made = tokens.library_ids(JSON)
    assert np.frombuffer(next(made.of([text])), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \n\t'strvmld12é×÷ÿɏɐÀaZ.,!<|>\0\x85\xa0日²½ªµ_\r", "<|endoftext|>", "'s", "'ll", "word", "  "]), max_size=25).map("".join), max_size=6))
def test_ids_by_piece_are_the_librarys(library, texts):
    made = tokens.library_ids(JSON)
    assert [np.frombuffer(raw, "<u2").tolist() for raw in made.of(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_piece_is_encoded_once_a_slice(library, monkeypatch):
    made, asked = tokens.LibraryIds(JSON), []
    make = made.chunks.make
    monkeypatch.setattr(made.chunks, "make", lambda keys: asked.extend(keys) or make(keys))
    texts = [" zzyzx, zzyzx. zzyzx12\n" * 500, "", "don't zzyzx, it<|endoftext|>"]
    at, raw = made.of_column(pa.array(texts))
    assert [np.frombuffer(raw, "<u2")[a:z].tolist() for a, z in zip(at[:-1] // 2, at[1:] // 2)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(asked) == sorted(["\n", "\n zzyzx,", " zzyzx", ",", ".", "12", "don't", " it<|endoftext|>"])


def test_a_worker_forgets_between_tasks(library):
    made, rows = tokens.LibraryIds(JSON), pa.record_batch({"doc_id": [1, 2], "text": ["zzyzx quorvex", " quorvex zzyzx"]})
    for _ in range(2):
        for few, at, raw in made.of_batches([rows, rows]):
            assert np.frombuffer(raw, "<u2").tolist() == [i for t in few.column(1).to_pylist() for i in library.encode(t, add_special_tokens=False).ids]
            assert made.chunks.met.count(1)
        assert not made.chunks.young and not made.chunks.old and not made.chunks.met.count(1)


def test_other_tokenizers_go_through_the_library(library, tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    path, other = str(tmp_path / "other.json"), Tokenizer.from_file(JSON)
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    other.save(path)
    made = tokens.LibraryIds(path)
    assert tokens.by_letters(library) and not made.by_letters
    assert [np.frombuffer(raw, "<u2").tolist() for raw in made.of(["in 1999, 2024x", ""])] == [other.encode(t, add_special_tokens=False).ids for t in ("in 1999, 2024x", "")]


def test_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 3000)
    made, few = tokens.LibraryIds(JSON), [t for t in TEXTS if len(t) < 300]
    for t in few * 3:
        assert np.frombuffer(next(made.of([t])), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids
        of_one_text = 300 * (tokens.ENTRY + 300)
        assert made.chunks.bytes <= 1500 + of_one_text and len(made.chunks.old) * tokens.ENTRY <= 1500 + of_one_text
    for t in TEXTS * 2:
        next(made.of([t]))
    kept = {**made.chunks.young, **made.chunks.old}
    assert kept and all(len(c) <= tokens.LONG for c in kept)


def test_keys_met_once_are_not_kept():
    made = tokens.Remembered(lambda keys: [k.encode() for k in keys], 1 << 20)
    assert made.of([["a", "b"]]) == [[b"a", b"b"]] and not made.young
    assert made.of([["a", "c"], ["a"]]) == [[b"a", b"c"], [b"a"]] and made.young == {"a": b"a"}


# ---------------------------------------------------------------- DuckDB byte-level BPE
@pytest.mark.filterwarnings("ignore")
def test_recursive_merges_are_tiktokens(duck, ranks):
    assert [x.tolist() for x in duck.encode(TEXTS)] == [ranks.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn"]) | st.sampled_from(" \n\t'saeE1.$"), max_size=30), max_size=6))
def test_recursive_merges_are_tiktokens_on_any_text(duck, ranks, texts):
    ids = list(duck.encode(texts))
    assert [x.tolist() for x in ids] == [ranks.encode_ordinary(t) for t in texts]
    assert duck.decode(ids) == [t.encode() for t in texts]


def test_long_words_follow_the_same_rule(duck, ranks):
    rng = random.Random(2)
    for n in (1, 2, 5, 60, 400):
        word = "".join(rng.choice("abcdenrst") for _ in range(n)).encode()
        assert duck._merge_long(word).tolist() == duck._merge([word])[0].tolist() == ranks._encode_single_piece(word)


def test_pieces_of_a_run_are_looked_up_at_once(duck, ranks, monkeypatch):
    asked, of = [], duck.pieces.of
    monkeypatch.setattr(duck.pieces, "of", lambda groups: asked.append(len(groups)) or of(groups))
    text = "quorvex, blint's zzyzx7 ﬁnd élan! plainword"
    assert duck._encode_chunks(tokens.CHUNK.findall(text)) == [np.array(ranks.encode_ordinary(c), "<i4").tobytes() for c in tokens.CHUNK.findall(text)]
    assert asked == [1] and duck.letters and not bpe.DuckBpe(RANKS, r" ?\p{L}|[\s\S]").letters


@settings(max_examples=200, deadline=None)
@given(st.text("abZ \n'1.é", min_size=1, max_size=6))
def test_plain_chunks_are_one_piece(duck, text):
    assert not bpe.plain(text) or duck.pattern.findall(text) == [text]


def test_encode_and_decode_tables(docs_of, ranks):
    docs = docs_of(PAIRS, ["ids", "bytes", "word"])
    both = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    got = sorted(((r.doc_id, tuple(r.ids), bytes(r.bytes)) for r in both), key=repr)
    assert got == sorted(((i, tuple(ranks.encode_ordinary(t or "")), (t or "").encode()) for i, t in PAIRS), key=repr)
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted(((r.doc_id, tuple(r.ids)) for r in ids.collect()), key=repr) == [g[:2] for g in got]
    back = bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(((r.doc_id, bytes(r.bytes)) for r in back), key=repr) == sorted(((g[0], g[2]) for g in got), key=repr)
    assert bpe.round_trip(docs_of([]), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n\t\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b\x1cé.a"), max_size=20), max_size=6), st.integers(0, 2))
def test_chunks_in_columns_are_those_of_the_texts(texts, skip):
    chunks, firsts = bpe.chunked(pa.array(texts, pa.large_string())[skip:])
    got = chunks.to_pylist()
    assert [got[a:b] for a, b in zip(firsts[:-1], firsts[1:])] == [tokens.CHUNK.findall(t) for t in texts[skip:]]
    assert len(set(got)) == len(chunks.dictionary)


def test_a_chunk_is_encoded_and_decoded_once_a_slice(ranks, monkeypatch):
    duck, asked, ids = bpe.DuckBpe(RANKS, public_tokenizers.PATTERN), [], []
    make, run = duck.chunks.make, bpe.DuckBpe._decode_run
    monkeypatch.setattr(duck.chunks, "make", lambda chunks: asked.extend(chunks) or make(chunks))
    monkeypatch.setattr(bpe.DuckBpe, "_decode_run", lambda self, flat: ids.extend(flat) or run(self, flat))
    texts = ["quorvex, zzyzx7 " * 3000, "", " zzyzx7 quorvex," * 3000]
    got, back = duck.encode_lists(pa.array(texts))
    assert got.to_pylist() == [ranks.encode_ordinary(t) for t in texts] and back().to_pylist() == [t.encode() for t in texts]
    assert sorted(asked) == [" ", " quorvex,", " zzyzx7", "quorvex,"] and len(ids) < 30


def test_many_new_chunks_are_encoded_in_portions(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "SOME", 3)
    duck, sizes = bpe.DuckBpe(RANKS, public_tokenizers.PATTERN), []
    some = duck._encode_some
    monkeypatch.setattr(duck, "_encode_some", lambda chunks: sizes.append(len(chunks)) or some(chunks))
    text = "quorvex, blint's zzyzx7 élan! quorvex plainword 12 x,y"
    assert [x.tolist() for x in duck.encode([text])] == [ranks.encode_ordinary(text)] and sizes == [3, 3, 2]


def test_slices_of_texts_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 10)
    rows = pa.record_batch({"doc_id": range(7), "text": ["a" * 4, "b" * 6, "", "c" * 25, "d", "é" * 5, ""]})
    got = [b.column(0).to_pylist() for b in bpe.texts_of([rows.slice(0, 0), rows, rows.slice(2)])]
    assert got == [[0, 1, 2], [3], [4], [5, 6], [2], [3], [4], [5, 6]]


@pytest.mark.parametrize("most", [40_000, 1 << 20])
def test_distinct_keys_have_the_values_of_any_keys(most):
    rng, made = random.Random(4), []
    kept = tokens.Remembered(lambda keys: made.extend(keys) or [k.encode() for k in keys], most)
    for _ in range(200):
        keys = rng.sample([str(i) for i in range(300)], 60) + ["x" * 200]
        assert kept.distinct(keys) == [k.encode() for k in keys]
        assert kept.of([keys[:5] * 2]) == [[k.encode() for k in keys[:5]] * 2]
    assert made.count("x" * 200) == 200 and (made.count("7") > 2 or kept.old == {})
    if most == 1 << 20:  # holds all short keys, each met twice before it is kept
        assert max(made.count(str(i)) for i in range(300)) == 2


def test_unknown_id_is_refused(duck):
    with pytest.raises(ValueError):
        duck.decode([np.array([60_000])])


# ---------------------------------------------------------------- Elias-Fano files
@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700), st.integers(0, 1000))
def test_elias_fano_round_trip(values, more):
    values = sorted(values)
    about, raw = elias_fano.ef_encode(np.array(values, np.uint64), (values[-1] if values else 0) + 1 + more)
    ef = elias_fano.EliasFano(about, raw)
    assert ef.all().tolist() == values
    assert [ef.select(i) for i in range(0, len(values), 7)] == values[::7]


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    _, raw = elias_fano.ef_encode(values, int(values[-1]) + 1)
    assert len(raw) * 8 < 100_000 * 12.5  # about 2 + log2(1000) bits a value


def test_files_hold_all_documents_in_order(spark, docs_of, library):
    manifest = elias_fano.write_ids(docs_of(PAIRS, ["file", "shard", "start"]).repartition(3), JSON)
    want, start = [], 0
    for i, t in sorted(PAIRS, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or "")):
        ids = ids_of(library, t)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, elias_fano.read_ids(manifest).collect()), key=lambda r: r[1]) == want
    shards = list(elias_fano.open_shards(spark, manifest))
    assert [d for s in shards for d in s.doc_ids()] == [w[0] for w in want]
    assert [crc(s.ids(i)) for s in shards for i in range(len(s))] == [w[3] for w in want]


def test_empty_files(docs_of):
    assert elias_fano.read_ids(elias_fano.write_ids(docs_of([]), JSON)).count() == 0


# ---------------------------------------------------------------- packing
def test_pieces_cover_every_document_once(docs_of, library):
    pairs = PAIRS[:-3] + PAIRS[-1:]
    rows = packing.pack(docs_of(pairs, ["ids", "offset", "length"]), JSON).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)  # no sequence holds two pieces
    assert all(r.offset == 0 and r.length & r.length - 1 == 0 and r.length <= 1024 for r in rows)
    by_length = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert by_length == sorted(by_length)
    for doc, text in pairs:
        ids, mine = ids_of(library, text), sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert [i for r in mine for i in r.ids] == ids and {r.doc_tokens for r in mine} == {len(ids)}
        assert [r.ids_crc32 for r in mine] == [crc(r.ids) for r in mine]


def test_repeated_rows_are_packed_each(docs_of):
    rows = packing.pack(docs_of([(1, "a b c")] * 2), JSON, with_ids=False).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and sum(r.length for r in rows) == 8
    assert packing.pack(docs_of([]), JSON).count() == 0


def test_numbers_go_on_from_slice_to_slice(docs_of):
    pairs = [(i, "some words " * 200_000) for i in range(5)]  # more than two slices in one task
    rows = packing.pack(docs_of(pairs).coalesce(1), JSON, with_ids=False).collect()
    whole = sorted(r.sequence_id for r in rows if r.length == 1024)
    assert whole == list(range(whole[0], whole[0] + len(whole))) and len({r.sequence_id for r in rows}) == len(rows)
    for i, _ in pairs:
        mine = sorted((r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == i)
        assert [m[0] for m in mine] == np.cumsum([0, *(m[1] for m in mine)])[:-1].tolist() and mine[-1][0] + mine[-1][1] == mine[0][2]


def test_cuts():
    for n in (1, 2, 3, 1023, 1024, 1025, 5000):
        assert sum(packing.cuts(n)) == n and all(c & c - 1 == 0 for c in packing.cuts(n))
    assert packing.cuts(11, 4) == [4, 4, 2, 1]


def test_many_long_pieces_fit_the_database(duck, ranks):
    rng = random.Random(9)
    letters = [chr(c) for c in range(0x4E00, 0x9FA5)]
    text = " ".join("".join(rng.choices(letters, k=20)) for _ in range(30_000))
    assert [x.tolist() for x in duck.encode([text])] == [ranks.encode_ordinary(text)]


def test_very_long_text_is_decoded_in_runs(duck, ranks):
    text = "some words of a long text, and more. " * 850_000  # 31 MB, 8 million ids
    ids = next(iter(duck.encode([text])))
    assert len(ids) > 20 * bpe.RUN and duck.decode([np.empty(0, np.int32), ids, ids[:3]]) == [b"", text.encode(), ranks.decode_bytes(ids[:3].tolist())]
    assert ids[:2000].tolist() == ranks.encode_ordinary(text[:20_000])[:2000]
