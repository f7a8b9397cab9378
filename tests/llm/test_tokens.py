"""Packing, token files, BPE: compared with the tokenizers library and exact round trips."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import TEXTS
from vitalshare.llm import binary_ids, bpe, common, packing, word_tokens

PARTS = ["a", "the", " ", "  ", "\n", "é", "1", "23", "'s", "!", "...", "日本", " in", "ing", ".", ",", "A.", "<|endoftext|>", "\x85", "\x1c", "İ", "̈"]


def library(path):
    made = Tokenizer.from_file(path)
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=8))
def test_chunks_give_the_librarys_ids(word_bpe, texts):
    want = library(word_bpe)
    ids, counts = word_tokens.encoder(word_bpe).encode(pa.array(texts))
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in got] == [want(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=8))
def test_speculative_bpe_gives_the_librarys_ids(byte_bpe, texts):
    want = library(byte_bpe)
    codec = bpe.codec(byte_bpe)
    ids, counts = codec.encode(pa.array(texts))
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in got] == [want(t) for t in texts]
    assert codec.decode(ids, counts).to_pylist() == texts


def test_texts_are_encoded_a_slice_at_a_time(word_bpe):
    """What is held for encoding is bounded by a slice, not by an Arrow batch."""
    texts = ["word " * 60_000, "a", None, "bird " * 150_000, "b c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], ["doc_id", "text"])
    found = list(word_tokens.encoded([batch], word_bpe, 1))
    assert [x.to_pylist() for x, _ in found] == [[0, 1, 2], [3, 4]]
    want = library(word_bpe)
    assert [x.tolist() for _, part in found for x in part] == [want(t) + [1] for t in texts]


def test_other_tasks_empty_the_encoders(word_bpe):
    """A reused worker does not carry the packing's memory into the stages after it."""
    own = word_tokens.encoder(word_bpe)
    common.trim(word_tokens.ENCODERS)
    assert word_tokens.encoder(word_bpe) is own
    common.trim()
    assert not word_tokens.ENCODERS


def test_memories_may_be_small(word_bpe, byte_bpe):
    for maker, path in ((word_tokens.ChunkEncoder, word_bpe), (bpe.Codec, byte_bpe)):
        small = maker(path, 3)
        for text in TEXTS:
            assert small.encode(pa.array([text], pa.string()))[0].tolist() == library(path)(text)


def test_long_words_merge_as_short_ones(byte_bpe, monkeypatch):
    codec = bpe.codec(byte_bpe)
    words = ["hello", "abababab" * 4, "internationalisation" * 2, "\xc3\xa9" * 15, "x"]
    monkeypatch.setattr(bpe, "LONG_WORD", 1000)
    for word in words:
        assert codec._merge_long(word) == codec.merge(word)


def test_invalid_bytes_decode_to_replacements(byte_bpe):
    codec = bpe.codec(byte_bpe)
    lone = codec.vocab["\xe6"]
    assert codec.decode(np.array([lone]), np.array([1])).to_pylist() == ["�"]


def test_encode_and_decode_rows(odd_docs, no_docs, byte_bpe):
    want = library(byte_bpe)
    rows = bpe.decode(bpe.encode(odd_docs, byte_bpe), byte_bpe).collect()
    assert len(rows) == odd_docs.count()
    for x in rows:
        text = "no id" if x.doc_id is None else TEXTS[x.doc_id]
        assert list(x.ids) == want(text) and x.text == (text or "")
    assert bpe.encode(no_docs, byte_bpe).count() == 0


def test_packing_places_every_id_once(odd_docs, no_docs, word_bpe):
    want = library(word_bpe)
    pieces = packing.pack(odd_docs, word_bpe, ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in pieces:
        by_doc[x.doc_id].append(x)
        by_sequence[x.sequence_id].append(x)
    counts = Counter(x.doc_id for x in odd_docs.collect())
    for doc, own in by_doc.items():
        ids = want("no id" if doc is None else TEXTS[doc]) + [1]
        whole = Counter()
        for x in own:
            assert list(x.ids) == ids[x.start : x.start + x.length]
            assert x.ids_crc32 == crc(x.ids) and x.doc_tokens == len(ids)
            whole.update(range(x.start, x.start + x.length))
        assert whole == {i: counts[doc] for i in range(len(ids))}
    assert set(by_doc) == set(counts)
    for own in by_sequence.values():
        at = 0
        for x in sorted(own, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= packing.CAPACITY
    assert packing.pack(no_docs, word_bpe).count() == 0


def test_packing_wastes_little(spark, word_bpe):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sums = packing.pack(docs, word_bpe).groupBy("sequence_id").sum("length").collect()
    used = [x[1] for x in sums]
    padding = sum(0 if n & (n - 1) == 0 else packing.CAPACITY - n for n in used)
    assert padding < 0.02 * sum(used)


@pytest.mark.parametrize("capacity", [1, 7, 64, 2048])
def test_cuts_are_classes(capacity):
    for n in range(capacity):
        assert sum(packing.cut(n, capacity)) == n
        assert all(x in packing.classes(capacity) for x in packing.cut(n, capacity))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=12), st.sampled_from(["bit", "byte"]), st.sampled_from([1, 7, 64]))
def test_files_round_trip(docs, kind, block):
    sink = pa.BufferOutputStream()
    writer = binary_ids.Writer(sink, block=block, kind=kind)
    for i, ids in enumerate(docs):
        writer.add(i if i else None, np.array(ids, np.uint32))
    writer.close()
    reader = binary_ids.Reader(pa.BufferReader(sink.getvalue()))
    flat = [x for ids in docs for x in ids]
    start = 0
    for (doc, at, parts), (i, ids) in zip(reader.documents(), enumerate(docs), strict=True):
        assert (doc, at) == (i if i else None, start)
        assert [x for p in parts for x in p.tolist()] == ids
        start += len(ids)
    for a in range(0, len(flat) + 1, 5):
        assert reader.read(a, len(flat)).tolist() == flat[a:]


def test_token_files(odd_docs, no_docs, spark, word_bpe):
    want = library(word_bpe)
    files = binary_ids.write(odd_docs, word_bpe, binary_ids.new_folder(spark))
    rows = sorted(binary_ids.read_digests(spark, files).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in rows] == sorted([x.doc_id for x in odd_docs.collect()], key=lambda x: -1 if x is None else x)
    start = 0
    for x in rows:
        ids = want("no id" if x.doc_id is None else TEXTS[x.doc_id]) + [2]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    files = binary_ids.write(no_docs, word_bpe, binary_ids.new_folder(spark))
    assert files == [] and binary_ids.read_digests(spark, files).count() == 0


MIXED = ["a", "ba", "É", "ñ", "İ", "ß", "'s", "'", "&&&", "=", "̸", "́", "ŀ", "क़", " ", "7", "½", "<|", "×", "K", "日"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(MIXED), max_size=10).map("".join), min_size=1, max_size=8))
def test_parted_punctuation_and_joined_words_give_the_librarys_ids(word_bpe, texts):
    want = library(word_bpe)
    ids, counts = word_tokens.encoder(word_bpe).encode(pa.array(texts))
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in got] == [want(t) for t in texts]


def test_words_go_to_the_library_many_to_a_text(word_bpe, monkeypatch):
    """A text costs the library more than a word of it does."""
    own, sent = word_tokens.ChunkEncoder(word_bpe), []
    library_ = own._library
    monkeypatch.setattr(own, "_library", lambda texts: sent.extend(texts) or library_(texts))
    words = [f"{a}{b}{c}é" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz"]
    text = "!! ".join(words)
    assert own.encode(pa.array([text]))[0].tolist() == library(word_bpe)(text)
    assert len(sent) <= 1 + -(-len(words) // word_tokens.JOINED)


def test_chunks_used_often_stay_remembered(word_bpe):
    """Words seen once make room; what every slice holds is not learned again."""
    small, want = word_tokens.ChunkEncoder(word_bpe, 4), library(word_bpe)
    for i in range(20):
        text = f"the cat number{'abcdefghijklmnopqrst'[i]} word{'abcdefghijklmnopqrst'[i]}"
        assert small.encode(pa.array([text]))[0].tolist() == want(text)
        assert len(small.chunks) <= 4 + 4
        assert {"the", "cat"} <= set(small.chunks.to_pylist())
    assert small.calls[:2].min() > 1
