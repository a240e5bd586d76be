"""SimHash near-duplicates against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows):
    """rows: (id, fingerprint); returns the least id reachable for each row."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(rows))]


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    want = sorted((d, f"{f:016x}", c) for (d, f), c in zip(rows, classes(rows)))
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(3, None, 1), (1, "", 2), (None, text, 3), (7, text.upper(), 4), (7, text.upper(), 4), (9, " \t\n", 5),
            (2, "Two  words", 6), (5, "zebra " * 70_000, 7), (None, "alone with no id at all", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id int")
    got = simhash.near_duplicates(docs).collect()
    flat = [(d, plain(t)) for d, t, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(str((d, f"{f:016x}", c)) for (d, f), c in zip(flat, classes(flat)))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.gone_id for r in kept.collect()) == [2, 4, 4, 6, 7, 8]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


@pytest.mark.parametrize("n", [2, 3, 40, 600])
def test_parts_of_a_list(n):
    rng = np.random.default_rng(n)
    rest = rng.choice(1 << 12, n, replace=False).astype(np.int64)
    got = simhash.linked_parts(rest)
    want = classes([(int(x), int(x)) for x in rest])
    assert got.tolist() == want


def test_lists_hold_every_near_pair(spark):
    base = 0x0123456789ABCDEF
    near = [base] + [base ^ (1 << i) ^ (1 << j) for i, j in [(0, 62), (5, 6), (8, 40), (31, 32)]]
    fps = spark.createDataFrame([(x,) for x in near], "fp long")
    assert {r.root for r in simhash.fingerprint_classes(fps).collect()} == {min(near)}
    far = spark.createDataFrame([(base,), (base ^ 0b111,)], "fp long")
    assert simhash.fingerprint_classes(far).count() == 0


def test_any_two_positions_are_free_in_a_list():
    assert all(any({i, j} <= set(free) for free in simhash.LISTS) for i, j in simhash.PAIRS)


@pytest.mark.parametrize("small", [1, 5, 256])
def test_long_and_short_lists(spark, small):
    rng = np.random.default_rng(small)
    fps = {0, -1}
    for base in rng.integers(-(1 << 62), 1 << 62, 6).tolist():  # groups of many distinct fingerprints, near and less near
        for _ in range(40):
            bits = rng.choice(64, rng.integers(0, 5), replace=False).tolist()
            x = (base & (1 << 64) - 1) ^ sum(1 << b for b in bits)
            fps.add(x - (1 << 64) if x >> 63 else x)
    rows = [(f, f & (1 << 64) - 1) for f in sorted(fps)]
    want = dict(zip(sorted(fps), classes(rows)))
    got = {r.node: r.root for r in simhash.fingerprint_classes(spark.createDataFrame([(f,) for f in fps], "fp long"), small).collect()}
    assert got == {f: r for f, r in want.items() if f != r or r in [q for g, q in want.items() if g != f]}


def test_components_of_a_chain(spark):
    from tidemark.llm.components import components

    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(links, "a", "b")
    assert got.count() == 301 and {r.root for r in got.collect()} == {0}
