import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxmill.llm import packing, tokens
from voxmill.llm import text as T

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ALPHABET = ["a", "B", " ", "  ", "\n", "\u00a0", "\u2003", "\u3000", "é", "\u0301", "'s", "'", "1", "²", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "\t", "!", "한", "\u200b", "😀", "İ", "ß", "Σ", "the", " word"]
texts = st.lists(st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join), min_size=1, max_size=20)
byte_library, word_library = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_counts_equal_the_library(batch):
    data, offsets = T.flat(pa.array(batch))
    codes, distinct, at = T.chunks(data, offsets)
    n = tokens.counter_of(BYTE)(distinct.to_pylist())
    ends = np.concatenate(([0], np.cumsum(n[codes])))
    assert list(ends[at[1:]] - ends[at[:-1]]) == [len(byte_library.encode(t, add_special_tokens=False).ids) for t in batch]


@settings(max_examples=200, deadline=None)
@given(texts)
def test_ids_equal_the_library(batch):
    ids, at = tokens.Encoder(WORD).texts(pa.array(batch))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [word_library.encode(t, add_special_tokens=False).ids for t in batch]


def test_whole_tokens_are_whole():
    some = sorted(tokens.whole_tokens(BYTE))[::997]
    assert len(tokens.whole_tokens(BYTE)) > 40_000
    assert all(len(byte_library.encode(s.decode(), add_special_tokens=False).ids) == 1 for s in some)


def test_count_table(spark, odd_docs):
    rows = tokens.count_tokens(odd_docs, BYTE, 1024).collect()
    assert len(rows) == odd_docs.count()
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(byte_library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)
    assert tokens.count_tokens(odd_docs.limit(0), BYTE, 1024).count() == 0


@given(st.integers(1, 20_000))
def test_pieces(n):
    pieces = packing.binary_pieces(n, 2048)
    assert sum(pieces) == n and pieces == sorted(pieces, reverse=True) and all(p & (p - 1) == 0 and p <= 2048 for p in pieces)
    assert all(pieces.count(p) == 1 for p in pieces if p < 2048)


def test_pack_table(spark, odd_docs, documents):
    for docs in (odd_docs.filter("doc_id IS NOT NULL AND doc_id <> 1"), documents):
        rows = packing.pack(docs, WORD, with_ids=True).collect()
        assert len({r["sequence_id"] for r in rows}) == len(rows)
        by = {}
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["offset"] == 0 and r["length"] == len(r["ids"]) == 1 << r["bucket"] and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            own = by.setdefault(r["doc_id"], [])
            assert r["start"] == len(own)
            own += r["ids"]
        for d in docs.collect():
            assert by[d["doc_id"]] == word_library.encode(d["text"] or "", add_special_tokens=False).ids + [1]
    assert packing.pack(odd_docs, WORD).filter("start = 0").count() == odd_docs.count()
    assert packing.pack(odd_docs.limit(0), WORD).count() == 0


def test_other_files_are_refused(spark, odd_docs):
    """A file that splits or normalises otherwise would give wrong counts."""
    with pytest.raises(ValueError):
        tokens.Counter(WORD)
    with pytest.raises(ValueError):
        tokens.Encoder(BYTE)
    with pytest.raises(ValueError):
        tokens.count_tokens(odd_docs, WORD, 10)
    with pytest.raises(ValueError):
        packing.pack(odd_docs, BYTE)
