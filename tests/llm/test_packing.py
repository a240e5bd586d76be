"""Packing against the library's own token ids and the rules of a packing."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, tokens


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return t


def check(rows, ids_of, capacity):
    """rows: of pack(); ids_of: tokens of each (doc, text)."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for doc, ids in ids_of:
        for piece, (start, length) in enumerate(packing.pieces_of(len(ids), capacity)):
            crc = zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            want[(doc, piece, start, length, crc)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(by_sequence), sum(len(ids) for _, ids in ids_of)


def test_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = [(r.doc_id, library.encode(r.text, add_special_tokens=False).ids + [2]) for r in docs.collect()]
    used, total = check(packing.pack(docs, bucket=7).collect(), ids, 1024)
    assert used <= total / 1024 * 1.03 + 1


def test_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (None, "hello"), (3, "a b c " * 900), (3, "a b c " * 900), (3, "other"), (4, "<|endoftext|>"), (5, "é🙂 " * 40)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, piece int")
    ids = [(d, library.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]
    got = packing.pack(docs, capacity=100, with_ids=True)
    check(got.collect(), ids, 100)
    for s in packing.sequences(got).collect():
        assert sum(s.segments) == len(s.ids) <= 100
    assert packing.pack(docs.limit(0)).collect() == []


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
@settings(max_examples=60, deadline=None)
def test_plan_places_each_piece_once(counts):
    seen = defaultdict(int)
    ranks = defaultdict(set)
    for length, rank, n, each, first, offset in packing.best_fit(counts, 64):
        for k in range(n * each):
            assert rank + k not in ranks[length]
            ranks[length].add(rank + k)
            where = first + k // each
            at = offset + k % each * length
            assert seen[where] == at
            seen[where] += length
            assert seen[where] <= 64
    assert {k: set(range(v)) for k, v in counts.items()} == dict(ranks)


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_same_ids_as_the_library(library, text):
    assert tokens.encode(text, tokens.default_path()) == library.encode(text, add_special_tokens=False).ids


def test_pieces():
    assert packing.pieces_of(5, 4) == [(0, 1), (1, 4)]
    assert packing.pieces_of(8, 4) == [(0, 4), (4, 4)] and packing.pieces_of(4, 4) == [(0, 4)]
