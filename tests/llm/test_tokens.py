import itertools
from collections import Counter, defaultdict
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assayer.llm import packing, token_store, tokens

from .conftest import TEXTS

coder = tokens.ChunkEncoder(tokens.default_path(), memo_limit=10)
whole = Tokenizer.from_file(tokens.default_path())


def ids_of(text):
    return whole.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


#: Letters that the tokenizer's normaliser parts from their marks.
PARTED = [c for k in range(0x10000) if not 0xD800 <= k < 0xE000 and (c := chr(k)).isalpha() and not whole.normalizer.normalize_str(c).isalpha()]


def test_letters_before_punctuation_stay_with_their_marks():
    """Every character before each mark that may end a chunk."""
    assert len(PARTED) >= 60 and "\u0130" in PARTED and "\u095c" in PARTED
    fresh = tokens.ChunkEncoder(tokens.default_path(), memo_limit=0)
    characters = [chr(k) for k in range(0x21, 0x20000) if not 0xD800 <= k < 0xE000 and not chr(k).isspace()]
    letters = [c for c in characters if c.isalpha() and not "\u4e00" <= c <= "\u9fff" and not "\uac00" <= c <= "\ud7a3"]
    for mark in tokens.TRAILING:
        for prefix in ("", "a"):
            chunks = [prefix + c + mark for c in (characters if mark in ".(" and not prefix else letters if mark in ".(" else PARTED)]
            want = [np.array(e.ids, dtype="<u4").tobytes() for e in whole.encode_batch_fast(chunks, add_special_tokens=False)]
            assert fresh._table(chunks) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(PARTED), st.sampled_from("abİ" + tokens.TRAILING), st.sampled_from(" \n")), max_size=30), max_size=5))
def test_parted_letters_give_the_ids_of_whole_texts(texts):
    coder.memo = {}
    for at, ids, offsets in coder.encode(pa.array(texts, pa.string()), 2):
        for i in range(len(offsets) - 1):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == [*ids_of(texts[at + i]), 2]


@pytest.mark.parametrize("text", ["BELEDİYESİ.", "İSTANBUL VALİLİĞİ, ANKARA", "सड़क, बाज़ार। (क़लम)", "বাড়ি, গাঢ়."])
def test_plain_cases_of_parted_letters(text):
    ((_, ids, _),) = coder.encode(pa.array([text]))
    assert ids.tolist() == ids_of(text)


def test_a_text_of_many_megabytes():
    text = " ".join(f"word{i % 977} İstanbul, (x{i % 31})" for i in range(400_000))
    ((_, ids, _),) = coder.encode(pa.array([text]))
    assert len(text) > 9_000_000 and crc(ids) == crc(ids_of(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aZ é'.,!<|>\n\t́क़Σ가 0"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_chunks_give_the_ids_of_whole_texts(texts):
    coder.memo = {}
    for at, ids, offsets in coder.encode(pa.array(texts, pa.string()), 2):
        for i in range(len(offsets) - 1):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == [*ids_of(texts[at + i]), 2]


def test_token_files_round_trip(spark, odd_docs, no_docs):
    folder, manifest = token_store.write_tokens(odd_docs, partitions=3)
    found = token_store.read_digests(folder, manifest).collect()
    expected, at = [], 0
    for doc_id, text, *_ in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*ids_of(text), 2]
        expected.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    folder, manifest = token_store.write_tokens(no_docs, partitions=3)
    assert token_store.read_digests(folder, manifest).count() == 0


def test_sequences_have_equal_lengths_and_masks(tmp_path):
    sink = pa.OSFile(str(tmp_path / "x.arrow"), "wb")
    writer = token_store.SequenceWriter(sink, pa.uint16(), sequence=4, rows=2)
    writer.append(np.arange(13))
    writer.append(np.arange(13, 19))
    writer.close()
    sink.close()
    table = pa.ipc.open_file(str(tmp_path / "x.arrow")).read_all()
    assert sum(table["ids"].to_pylist(), []) == [*range(19), 0]
    assert sum(table["mask"].to_pylist(), []) == [True] * 19 + [False]
    reader = token_store.SequenceReader(f"file://{tmp_path}/x.arrow")
    assert np.concatenate(reader.piece(3, 11)).tolist() == list(range(3, 14))


@pytest.mark.parametrize("capacity", [1, 7, 2048])
def test_segment_tree_packs_like_a_scan(capacity):
    lengths = -np.sort(-np.random.default_rng(capacity).integers(1, capacity + 1, 500))
    number, offset, bins = packing.pack(lengths, capacity)
    room = []
    for n, b, o in zip(lengths.tolist(), number.tolist(), offset.tolist()):
        fits = [r for r in room if r >= n]
        if not fits:
            assert o == 0 and b == len(room)
            room.append(capacity)
        else:
            assert room[b] == min(fits)
        assert o == capacity - room[b]
        room[b] -= n
    assert bins == len(room)


def test_pieces_cover_documents_and_sequences(spark, odd_docs, no_docs):
    rows = packing.best_fit(odd_docs, capacity=64).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in {(r[0], r[1]) for r in TEXTS}:
        ids = [*ids_of(text), 0]
        copies = sum(r[0] == doc_id for r in TEXTS)
        want = sorted((i, 64 * i, len(ids[64 * i : 64 * i + 64]), crc(ids[64 * i : 64 * i + 64])) for i in range(-(-len(ids) // 64)) for _ in range(copies))
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[doc_id]) == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.best_fit(no_docs).count() == 0


def test_few_sequences(spark, sf):
    rows = packing.best_fit(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    least = -(-rows.length.sum() // 2048)
    assert rows.sequence_id.nunique() <= 1.02 * least + 4


def test_packing_depends_on_the_rows_alone(spark, sf):
    """Other partitions give the same packing; more blocks and short runs give valid ones, with one loose sequence at most."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = packing.cut_pieces(docs, tokens.default_path())
    first = sorted(map(tuple, packing.pack_pieces(pieces, blocks=5).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(map(tuple, packing.pack_pieces(pieces.repartition(3), blocks=5).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = Counter((r.id, r.piece, r.length) for r in pieces.collect())
    for blocks, block in ((1, packing.BLOCK), (5, packing.BLOCK), (1, 10), (40, 3)):
        rows, bins = packing.pack_pieces(pieces, blocks=blocks, block=block).collect(), defaultdict(list)
        assert Counter((r.id, r.piece, r.length) for r in rows) == want
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for parts in bins.values():
            ends = [0, *itertools.accumulate(n for _, n in sorted(parts))]
            assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
        if block == packing.BLOCK:
            assert sum(sum(n for _, n in parts) * 2 <= 2048 for parts in bins.values()) <= 1
