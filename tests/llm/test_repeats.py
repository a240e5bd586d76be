"""Repeated windows against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from tidemark.llm import repeats


def plain(rows, threshold=400):
    seen = Counter(hashlib.md5(t[i : i + threshold]).digest() for _, t in rows for i in range(len(t) - threshold + 1))
    out = []
    for doc, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - threshold + 1):
            if seen[hashlib.md5(t[i : i + threshold]).digest()] > 1:
                gone[i : i + threshold] = b"\1" * threshold
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((doc, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, docs, rows, **kw):
    got = sorted(map(tuple, repeats.repeats(docs, **kw).collect()), key=str)
    assert got == plain([(d, (t or "").encode()) for d, t in rows])


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    check(spark, docs, docs.collect())


@pytest.mark.parametrize("local", [1, 256])
def test_edges(spark, local):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, other = word(700), word(399).replace("é", "e")
    rows = [(i, word(rng.randrange(0, 300)) + shared[rng.randrange(0, 150) : rng.randrange(500, 700)] + word(rng.randrange(0, 300))) for i in range(40)]
    rows += [(100, word(100) + other + word(80)), (101, word(90) + other + word(100)), (102, "x" * 3000), (103, "ab" * 400),
             (104, None), (105, ""), (None, rows[0][1]), (7, word(900)), (7, word(900)), (8, rows[3][1]), (8, rows[3][1]), (110, shared * 3)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, spans int")
    check(spark, docs, rows, local=local)
    kept = repeats.remove_repeats(docs, local=local)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    left = {r.doc_id: r.text for r in kept.collect()}
    assert left[100] == rows[40][1] and left[104] is None and left[102] == ""


def test_long_text_over_chunks(spark, monkeypatch):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    texts = [long, "q" + long[3000:4200] + "z"]
    whole = [repeats.sync_points(t.encode(), 400) for t in texts]
    monkeypatch.setattr(repeats, "_CHUNK", 1000)
    cut = [repeats.sync_points(t.encode(), 400) for t in texts]
    for a, b in zip(whole, cut):
        serve = lambda x: {p: at for at, lo, hi in zip(x[0], x[1], x[2]) for p in range(lo, hi + 1)}
        assert serve(a) == serve(b)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.repeats(docs).collect() == []


def covered(rows, threshold):
    """Of each text the words in windows that also start elsewhere, as (place, flag) by brute force."""
    words = [t.encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + threshold]) for w in words for i in range(len(w) - threshold + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - threshold + 1):
            if seen[tuple(w[i : i + threshold])] > 1:
                gone[i : i + threshold] = [True] * threshold
        out.append((w, gone))
    return out


def word_rows():
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice(["le ", "la\n", "été ", "x\t\t", "qui  "]) for _ in range(n))
    shared = some(90)
    part = shared.split()
    rows = [(i, some(rng.randrange(0, 40)) + " ".join(part[rng.randrange(0, 20) : rng.randrange(60, 90)]) + " " + some(rng.randrange(0, 40))) for i in range(30)]
    rows += [(40, some(9) + " ".join(part[:49])), (41, "a " * 300), (42, None), (43, ""), (None, rows[0][1]), (44, some(200)), (44, some(200)), (45, rows[2][1]), (45, rows[2][1])]
    return rows


@pytest.mark.parametrize("local", [1, 256])
def test_words_match_brute_force(spark, local):
    rows = word_rows()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, passages int")
    want = covered([(d, t or "") for d, t in rows], 50)
    got = repeats.repeats(docs, local=local, passage_words=50).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_passage_words) for r in got) == sorted((str(d), len((t or "").encode()), sum(g)) for (d, t), (_, g) in zip(rows, want))
    kept = repeats.remove_repeats(docs, local=local, threshold=50, unit="words")
    assert kept.columns == docs.columns
    rest = sorted((str(d), [x for x, gone in zip(*w) if not gone]) for (d, _), w in zip(rows, want))
    got = kept.collect()
    assert sorted((str(r.doc_id), (r.text or "").encode().split()) for r in got) == rest
    assert [r.doc_id for r in got if r.text is None] == [42]


def test_passages_of_the_generated_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = {r.doc_id: sum(g) for r, (_, g) in zip(rows, covered([(r.doc_id, r.text or "") for r in rows], 50))}
    assert {r.doc_id: r.n_passage_words for r in repeats.repeats(docs, passage_words=50).collect()} == want


def test_scratch_is_freed(spark, tmp_path, monkeypatch):
    import os

    from tidemark.sources import scratch

    monkeypatch.setattr(scratch, "scratch_root", lambda _: f"file://{tmp_path}")
    docs = spark.createDataFrame(word_rows(), "doc_id long, text string")
    assert repeats.repeats(docs).count() == 39
    assert [n.split("-")[0] for n in os.listdir(tmp_path)] == ["spans"]
