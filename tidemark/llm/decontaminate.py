"""Benchmark decontamination with suffix arrays of the training text.

Documents are read in shards of a bounded number of words. A shard's words become numbers
in the benchmark's vocabulary (0: not in it), and its suffixes are sorted by
their first words, as far as a window is long. Every suffix of the benchmark is then
binary-searched in every shard's array: the interval of suffixes that start with a window
gives its places, and windows that follow each other at one place make the
longest verbatim match. Suffixes that begin with words that no benchmark text
has in a row are left out of the array; no search could find them.

No shuffle is needed: documents stay where they are read, and the benchmark goes to
them. Its size is measured first and it goes in blocks of ``BLOCK_BYTES`` at most (or one longer item), whose
index is about forty times that. ``CHAIN`` blocks are broadcast at once and searched in one pass; between passes the
rows are written and the broadcasts released, so neither side has to fit in memory, at any size of the benchmark.

Cases. A null or wordless document has no words and is never contaminated; a null or
wordless item has no windows. Equal rows are judged each for itself; rows of
one item_id are one item with the windows of all. Null ids are kept as null;
a null item_id matches but is named by no string. Other columns are ignored by
:func:`contamination`, kept by :func:`remove_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import Written

WINDOW = 13
#: Bytes of benchmark text in a block, and words of documents in a shard, about.
BLOCK_BYTES = 2 << 20
SHARD_WORDS = 2 << 20
#: Blocks that are broadcast at the same time.
CHAIN = 4
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased ASCII; runs of 0-9, a-z and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Block:
    """Benchmark suffixes, sorted, for the search."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    items: list[str | None] = field(default_factory=list)
    #: Distinct windows: words, and (item, place) of each occurrence.
    heads: np.ndarray = None  # type: ignore[assignment]
    depths: np.ndarray = None  # type: ignore[assignment]
    owners: list[list[tuple[int, int]]] = field(default_factory=list)
    least: int = 1
    starts: np.ndarray = None  # type: ignore[assignment]


def _gram_slot(ids: np.ndarray, at: np.ndarray, n: int, bits: int) -> np.ndarray:
    code = np.zeros(len(at), np.uint64)
    for k in range(n):
        code = (code ^ ids[at + k].astype(np.uint64)) * _MIX
        code ^= code >> np.uint64(29)
    return (code * _MIX) >> np.uint64(64 - bits)


def block_of(rows: list[tuple[str | None, str | None]], window: int) -> Block:
    texts = [(item, words_of(text)) for item, text in rows]
    block = Block(window)
    block.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in texts for w in ws}), 1)}
    number: dict[str | None, int] = {}
    found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for item, words in texts:
        if not words:
            continue
        q = number.setdefault(item, len(number))
        ids = [block.vocabulary[w] for w in words]
        for j in range(max(1, len(ids) - window + 1)):
            found.setdefault(tuple(ids[j : j + window]), []).append((q, j))
    block.items = list(number)
    heads = sorted(found)
    block.owners = [found[h] for h in heads]
    block.depths = np.array([len(h) for h in heads], np.int64)
    block.heads = np.zeros((len(heads), window), np.uint32)
    for k, h in enumerate(heads):
        block.heads[k, : len(h)] = h
    block.least = int(min(block.depths.min(initial=window), 4))
    bits = max(16, (64 * len(heads)).bit_length())
    block.starts = np.zeros(1 << bits, bool)
    if heads:
        block.starts[_gram_slot(block.heads.ravel(), np.arange(len(heads)) * window, block.least, bits)] = True
    return block


def _keys(heads: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort alike."""
    return np.ascontiguousarray(heads.astype(">u4")).view(f"S{4 * heads.shape[1]}").ravel()


def suffix_array(ids: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the shard's suffixes in order of their first words."""
    w = block.window
    padded = np.concatenate([ids, np.zeros(w, ids.dtype)])
    at = np.flatnonzero(ids)
    bits = len(block.starts).bit_length() - 1
    at = at[block.starts[_gram_slot(padded, at, block.least, bits)]]
    keys = _keys(padded[at[:, None] + np.arange(w)[None, :]]) if len(at) else np.zeros(0, f"S{4 * w}")
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def search(places: np.ndarray, keys: np.ndarray, block: Block) -> list[tuple[int, np.ndarray]]:
    """(window, places where it starts) of each window that occurs."""
    low = _keys(block.heads)
    high = block.heads.copy()
    high[np.arange(block.window)[None, :] >= block.depths[:, None]] = 0xFFFFFFFF
    first = np.searchsorted(keys, low, "left")
    last = np.searchsorted(keys, _keys(high), "right")
    return [(k, places[first[k] : last[k]]) for k in np.flatnonzero(last > first)]


def matches_in(ids: np.ndarray, block: Block) -> list[tuple[int, int, int, int]]:
    """(place, length, item, place in item) of the maximal verbatim matches."""
    if not len(block.heads):
        return []
    place, item, inside, depth = [], [], [], []
    for k, at in search(*suffix_array(ids, block), block):
        for q, j in block.owners[k]:
            place.append(at)
            item.append(np.full(len(at), q))
            inside.append(np.full(len(at), j))
            depth.append(np.full(len(at), block.depths[k]))
    if not place:
        return []
    p, q, j, d = (np.concatenate(x).astype(np.int64) for x in (place, item, inside, depth))
    order = np.lexsort((p, p - j, q))
    p, q, j, d = p[order], q[order], j[order], d[order]
    same = (q[1:] == q[:-1]) & (p[1:] == p[:-1] + 1) & (j[1:] == j[:-1] + 1)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    last = np.concatenate([first[1:], [len(p)]]) - 1
    return list(zip(p[first].tolist(), (p[last] - p[first] + d[last]).tolist(), q[first].tolist(), j[first].tolist(), strict=True))


MATCH = T.StructType([
    T.StructField("item", T.StringType()), T.StructField("item_at", T.LongType()),
    T.StructField("doc_at", T.LongType()), T.StructField("words", T.LongType()),
])
_ARROW_MATCH = pa.list_(pa.struct([("item", pa.string()), ("item_at", pa.int64()), ("doc_at", pa.int64()), ("words", pa.int64())]))


def _searched(block_handle, last_column: int, shard_words: int):
    """A pass of one block: adds n_words and matches, or adds to them."""

    def judged(batch: pa.RecordBatch, counts: list[int], ids: list[np.ndarray], block: Block) -> pa.RecordBatch:
        gap = np.zeros(1, np.uint32)
        shard = np.concatenate([x for d in ids for x in (d, gap)]) if ids else gap
        start = np.concatenate([[0], np.cumsum([len(d) + 1 for d in ids])]).astype(np.int64)
        found: list[list[dict]] = [[] for _ in ids]
        for p, n, q, j in matches_in(shard, block):
            k = int(np.searchsorted(start, p, "right")) - 1
            found[k].append({"item": block.items[q], "item_at": j, "doc_at": p - int(start[k]), "words": n})
        if batch.num_columns > last_column:  # a block before this one has been searched
            found = [old + new for old, new in zip(batch.column(last_column + 1).to_pylist(), found, strict=True)]
        own = [batch.column(i) for i in range(last_column)]
        return pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array(found, _ARROW_MATCH)], [*batch.schema.names[:last_column], "n_words", "matches"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = block_handle.value
        get = block.vocabulary.get
        for b in batches:
            at, counts, ids, size = 0, [], [], 0
            for k, text in enumerate(b.column(0)):
                words = words_of(text.as_py())
                counts.append(len(words))
                ids.append(np.fromiter(map(get, words, repeat(0)), np.uint32, len(words)))
                size += len(words)
                if size >= shard_words or k == b.num_rows - 1:
                    yield judged(b.slice(at, k + 1 - at), counts, ids, block)
                    at, counts, ids, size = k + 1, [], [], 0

    return run


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in lists of about ``block_bytes`` at most, unless one item is longer."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-2 * total // block_bytes) if total > block_bytes else 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for k in range(n):
        yield [tuple(r) for r in items.where(part == k).collect()]


def _matched(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, window: int, block_bytes: int, keep: list[str]) -> DataFrame:
    """``row`` with the columns ``keep``, n_words and matches."""
    spark = docs.sparkSession
    rows = docs.select(docs[text].alias("text"), F.struct(*[docs[c] for c in keep]).alias("row"))
    base = rows.schema
    full = T.StructType([*base.fields, T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(MATCH))])
    held, written = [], None
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        if len(held) == CHAIN:
            before, written = written, Written(spark)
            rows = written.table(rows, "searched")
            for handle in held:
                handle.destroy()
            if before:
                before.drop()
            held = []
        held.append(spark.sparkContext.broadcast(block_of(block, window)))
        rows = rows.mapInArrow(_searched(held[-1], len(base), SHARD_WORDS), full)
    return rows.drop("text")


def _judged(found: DataFrame) -> DataFrame:
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_at"].alias("a"), (m["doc_at"] + m["words"]).alias("z"))))
    hit = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["z"] - F.greatest(s["end"], x["a"]))).alias("n"), F.greatest(s["end"], x["z"]).alias("end")),
        lambda s: s["n"],
    )
    items = F.array_sort(F.array_distinct(F.array_compact(F.transform("matches", lambda m: m["item"]))))
    return (
        found.withColumn("n_hit", hit).withColumn("items", items)
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Each document's id, words, words hit, the items found and the matches.

    ``matches``: item, word place in the item, word place in the document, and length of each
    maximal verbatim match; ``longest_match``: the longest length.
    """
    found = _judged(_matched(docs, benchmark, text, item_id, item_text, window, block_bytes, [doc_id]))
    return found.select(
        F.col("row")[doc_id].alias(doc_id), "n_words", "n_hit", "items", "contaminated",
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0)).alias("longest_match"), "matches",
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` without the contaminated documents."""
    found = _judged(_matched(docs, benchmark, text, item_id, item_text, window, block_bytes, docs.columns))
    return found.where(~F.col("contaminated")).select("row.*")
