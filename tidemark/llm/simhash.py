"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight bytes at fixed positions. Two fingerprints
that differ in at most two bits share at least six positional bytes, so a pair
is retained if its tally of shared positional bytes reaches six, and verified by its
differing bits.

Lists for single bytes would hold a 256th of all fingerprints each, and a tally
over them would pair all of a list. The index is therefore keyed by five positions: each of
the ``LISTS`` leaves three free, chosen so that any two positions are free together in one of them. A
pair that shares six bytes meets there with a tally of five, and the free bytes are counted on top. Lists of one are
dropped. Members of a list are tallied inside it and returned as a star for each
linked part: never all pairs, and no link between parts is lost. A list with more than ``SMALL``
members is keyed by each of its free bytes in turn: members that meet again have reached the tally of six,
and such a list has at most 65,536 of them at any input size. Nothing is capped.

Copies of a fingerprint are collapsed first and joined back at the end, on a
join that adaptive execution can split.

Cases. Null and wordless texts have fingerprint zero and are linked like any
other. A null id is never a component's id unless the component has no other.
Rows that share an id are one document: they are judged each by its own text.
Other columns are ignored by :func:`near_duplicates`, kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sql import unique
from tidemark.llm.components import components
from tidemark.llm.shared import Written, materialize

SHINGLE = 3
SEED = 42
MAX_BITS = 2
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text, unsigned.

    Lower-cased ASCII, words between ASCII white space, shingles of three words
    with repeats; a bit is 1 if it is set in over half of the hashes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.fromiter(map(len, words), np.int64, n)
    sizes = ends + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: n - SHINGLE + 1].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    n = len(starts)
    hashes = map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts, ends)), repeat(SEED))
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        block = np.fromiter(hashes, np.uint64, min(_BLOCK, n - at))
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in b.column(2)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found.view(np.int64))], ["id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text_hash, fp) of each row, fp as a signed long."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints, f"id {kind}, text_hash long, fp long")


#: Shared positional bytes that two fingerprints have at least if they differ in MAX_BITS bits.
LEAST = 8 - MAX_BITS
#: The positions that each list leaves free: triples of the eight that hold every pair, the fewest that do.
LISTS = [(0, 1, 2), (0, 3, 4), (0, 5, 6), (1, 3, 5), (1, 4, 6), (2, 3, 6), (2, 4, 5), (7, 0, 1), (7, 2, 3), (7, 4, 5), (7, 6, 0)]
PAIRS = list(combinations(range(8), 2))
SMALL = 256


def _without(positions: tuple[int, ...]) -> int:
    """The mask, as a signed long, of all bytes but those at ``positions``."""
    mask = sum(255 << 8 * p for p in range(8) if p not in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def posting_lists(fps: DataFrame) -> DataFrame:
    """(list, shared, fp, members): the members of the lists of two or more distinct fingerprints.

    ``shared`` has the five agreeing bytes and zeros. A list has 2 ** 24 members at
    most, and they are counted on a sort that spills.
    """
    rows = [F.struct(F.lit(k).alias("list"), F.col("fp").bitwiseAND(F.lit(_without(free))).alias("shared")) for k, free in enumerate(LISTS)]
    keyed = fps.select("fp", F.explode_outer(F.array(*rows)).alias("x")).select("x.*", "fp")
    return keyed.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("list", "shared"))).where("members > 1")


_MASKS = [0, *(1 << i for i in range(16)), *((1 << i) | (1 << j) for i, j in combinations(range(16), 2))]


def _spread(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric table of links the least column of its part."""
    own, top = np.arange(len(near)), len(near)
    while True:
        least = np.where(near, own[None, :], top).min(1)
        if (least == own).all():
            return own
        own = least


def tallied_parts(fps: np.ndarray) -> np.ndarray:
    """The place of the first member of each member's linked part, for a list of ``SMALL`` at most."""
    differ = fps[:, None] ^ fps[None, :]
    tally = (differ.view(np.uint8).reshape(len(fps), len(fps), 8) == 0).sum(2, dtype=np.int8)
    return _spread((tally >= LEAST) & (np.bitwise_count(differ) <= MAX_BITS))


def linked_parts(rest: np.ndarray) -> np.ndarray:
    """For each distinct 16-bit value the least one of its part.

    Values are linked at two or fewer differing bits. Short lists compare their
    members; long ones look up the 137 neighbours of each member.
    """
    if len(rest) <= SMALL:
        order = np.argsort(rest)
        near = np.bitwise_count(rest[order, None] ^ rest[None, order]) <= MAX_BITS
        out = np.empty_like(rest)
        out[order] = rest[order][_spread(near)]
        return out
    own = rest.copy()
    label = np.full(1 << 16, 1 << 16, np.int64)
    while True:
        label[rest] = own
        least = np.minimum.reduce([label[rest ^ m] for m in _MASKS])
        if (least == own).all():
            return own
        own = least


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars of the lists that are compared whole."""
    for b in batches:
        a, z = [], []
        for fps in b["fps"]:
            fps = np.sort(np.asarray(fps, np.int64))
            first = tallied_parts(fps.view(np.uint64))
            far = first != np.arange(len(fps))
            a.append(fps[first[far]])
            z.append(fps[far])
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(z)})


def _dense_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars of lists whose members agree in all bytes but those at ``i`` and ``j``."""
    for b in batches:
        a, z = [], []
        for i, j, shared, rest in zip(b["i"], b["j"], b["six"], b["rest"], strict=True):
            rest = np.asarray(rest, np.int64)
            least = linked_parts(rest)
            far = least != rest
            put = lambda v, s=shared, i=i, j=j: np.int64(s) | ((v & 255) << 8 * i) | ((v >> 8) << 8 * j)
            a.append(put(least[far]))
            z.append(put(rest[far]))
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(z)})


def links(fps: DataFrame, small: int, written: Written) -> DataFrame:
    """(a, b): a star of verified links for each linked part of each list."""
    lists = written.table(posting_lists(fps), "lists")
    short = lists.where(F.col("members") <= small).groupBy("list", "shared").agg(F.collect_list("fp").alias("fps"))
    again = [
        F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(_without((i, j)))).alias("six"),
            (F.shiftrightunsigned("fp", 8 * i).bitwiseAND(255) + F.shiftrightunsigned("fp", 8 * j).bitwiseAND(255) * 256).cast("int").alias("rest"),
        )
        for i, j in PAIRS
    ]
    free = [F.array(*(again[k] for k, pair in enumerate(PAIRS) if set(pair) < set(three))) for three in LISTS]
    dense = (
        lists.where(F.col("members") > small).select(F.explode_outer(F.get(F.array(*free), F.col("list"))).alias("x")).select("x.*")
        .groupBy("i", "j", "six").agg(F.collect_set("rest").alias("rest")).where(F.size("rest") > 1)
    )
    return short.mapInPandas(_links, "a long, b long").unionByName(dense.mapInPandas(_dense_links, "a long, b long"))


def fingerprint_classes(fps: DataFrame, small: int = SMALL) -> DataFrame:
    """(fp, root) of each fingerprint that is linked to another."""
    written = Written(fps.sparkSession)
    roots = components(links(fps, small, written), "a", "b")
    written.drop()
    return roots


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's id, fingerprint and ``component_id``, the least id reachable."""
    return _classed(docs, doc_id, text).select(
        F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _classed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = fingerprint_classes(nodes.select("fp"))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = materialize(rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id")), "component-ids")
    named = rooted.join(ids, F.col("root") == F.col("r")).select(F.col("fp").alias("of_fp"), "root", "component_id")
    return rows.join(named, F.col("fp") == F.col("of_fp"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that repeat one with a smaller id."""
    gone = (
        _classed(docs, doc_id, text).where(~F.col("id").eqNullSafe(F.col("component_id")))
        .select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    )
    body = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["gone_id"]) & (body == gone["gone_hash"]), "left_anti")


def keep_single(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of ``docs``: the least id, of its texts one, of equal rows one.

    Components whose ids are all null keep one row as well.
    """
    same = F.col("id").eqNullSafe(F.col("component_id"))
    keys = materialize(_classed(docs, doc_id, text).groupBy("root", "component_id", "id", "text_hash").agg(F.count(F.lit(1)).alias("n")), "keys")
    own = keys.where(same)
    least = own.groupBy(F.col("root").alias("of_root")).agg(F.min("text_hash").alias("least"))
    chosen = own.join(least, (F.col("root") == F.col("of_root")) & (F.col("text_hash") == F.col("least"))).select(
        F.col("id").alias("c_id"), F.col("text_hash").alias("c_hash"), "n"
    )
    chosen = materialize(chosen, "chosen")
    body = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    at = docs[doc_id].eqNullSafe(F.col("c_id")) & (body == F.col("c_hash"))
    # Only rows that repeat an id and text go through the shuffle of the second part.
    once = docs.join(chosen.where("n = 1"), at, "left_semi")
    again = docs.join(chosen.where("n > 1"), at, "left_semi").withColumn(h := unique("hash"), body)
    return once.unionByName(again.dropDuplicates([doc_id, h]).drop(h))
