"""Repeated windows of bytes or words by a depth-limited radix sort of suffixes.

Suffixes are ordered only through the threshold, by passes that start at the most
significant digit and keep only groups of two or more; what is equal after the last pass
are exactly the repeated windows. The order inside a pass is that of the digits'
hashes, since only equality matters. Symbols are bytes (400 by default) or words
(``unit="words"``: runs without ASCII white space, compared by 64-bit hashes).

Sorting every suffix even once would shuffle many times the input. The first
digit is therefore read at a suffix that all copies of a window agree on: of the
grams of half the threshold inside the window, the leftmost with the least hash (its
synchronising suffix). A window can only repeat if its synchronising suffix's
first half does, and one such suffix serves about a quarter of a threshold of neighbouring
windows. No window is left out: each has one such suffix, and equal windows have it at the same place.

1. First digit: synchronising suffixes are counted by their gram; single ones go.
2. Next digit: the whole stretch that a suffix serves (up to one and a half thresholds). Equal
   stretches repeat in full. One of each class goes on if its group has other classes.
3. Last digits: windows of the suffixes that go on, at equal distance from equal
   grams, are compared on all symbols. A group of up to ``LOCAL`` stretches is
   compared inside one task. Larger ones get a digit more, the part that an eighth
   of a stretch's windows have in common, and only what repeats in that is counted window by window,
   combined before the shuffle, so that a passage found in a third of all documents
   is never gathered in one place.

Hashes are 64 bits on top of the 64 of the first digit, 128 bits for windows.
What is written on the way is deleted once the spans are.

Cases. Null is an empty text. Texts under the threshold keep all. Equal rows are
copies like any other; rows that share an id are told apart by their text.
Other columns are ignored by :func:`repeats`, kept by :func:`remove_repeats`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Written, materialize

THRESHOLD = 400
#: Words of a passage: what the pipeline takes for repeated.
PASSAGE_WORDS = 50
LOCAL = 4096
#: Parts of a stretch's windows that large groups are split by.
PARTS = 8
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
_VALUES = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        n = 1 << max(17, (n - 1).bit_length())
        have = _POWERS[0] = (_powers(_BASES[0], n), _powers(pow(_BASES[0], -1, 1 << 64), n))
    return have


def symbols(text: str | None, unit: str) -> np.ndarray:
    """A text's bytes, or the hashes of its words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if unit == "bytes":
        return np.frombuffer(data, np.uint8)
    words = data.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _valued(x: np.ndarray) -> np.ndarray:
    return _VALUES[x] if x.dtype == np.uint8 else x


def sync_points(data: bytes | np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(at, lo, hi, gram): suffix ``at`` serves the windows that start in lo..hi.

    ``gram`` is the hash of the first half-threshold symbols of the suffix. Long texts go in
    overlapping chunks; where a suffix serves depends only on the symbols of the window.
    """
    data = data if isinstance(data, np.ndarray) else np.frombuffer(data, np.uint8)
    gram = threshold // 2
    span = threshold - gram + 1
    parts = []
    for start in range(0, len(data) - threshold + 1, _CHUNK):
        x = data[start : start + _CHUNK + threshold - 1]
        n = len(x)
        power, inverse = _tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_valued(x) * power[:n], out=sums[1:])
        h = _mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
        key = (h & ~_U(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        rows = np.concatenate([key, np.full(-len(key) % span, ~_U(0))]).reshape(-1, span)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - threshold + 1
        at = (np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & _U(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [windows]]) - 1
        parts.append((at[first] + start, first + start, last + start, h[at[first]]))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _runs(at: np.ndarray, before: np.ndarray, after: np.ndarray, gram: np.ndarray, ext: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring suffixes that are all alike, as in periodic text, by the first and the last.

    They are copies of each other, so the first can stand for the windows of all; the
    last keeps it from being single.
    """
    same = np.ones(len(at) - 1, bool)
    for x in (before, after, gram, ext):
        same &= x[1:] == x[:-1]
    first = np.concatenate([[True], ~same])
    last = np.concatenate([~same, [True]])
    heads = np.flatnonzero(first)
    stop = at - after
    after = after.copy()
    after[heads] = at[heads] - stop[np.flatnonzero(last)]
    kept = first | last
    return at[kept], before[kept], after[kept], gram[kept], ext[kept]


def _suffixes(threshold: int, unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            row = []
            for k, text in enumerate(b.column(2)):
                data = symbols(text.as_py(), unit)
                if len(data) < threshold:
                    continue
                at, lo, hi, gram = sync_points(data, threshold)
                raw, size = memoryview(data).cast("B"), data.itemsize
                ext = [
                    xxhash.xxh3_64_intdigest(raw[p * size : (q + threshold) * size], a - p)
                    for a, p, q in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)
                ]
                found = _runs(at, at - lo, at - hi, gram.view(np.int64), np.array(ext, np.uint64).view(np.int64))
                out.append(found)
                row.append(np.full(len(found[0]), k))
            if not out:
                continue
            at, before, after, gram, ext = (np.concatenate(x) for x in zip(*out, strict=True))
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(at), pa.array(before.astype(np.int32)),
                 pa.array(after.astype(np.int32)), pa.array(gram), pa.array(ext)],
                ["id", "text_hash", "at", "before", "after", "gram", "ext"],
            )

    return run


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))


def _stretches(threshold: int, unit: str):
    """Of each document with suffixes that go on: the symbols around each."""
    gram = threshold // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
                kept, rows, data = [], [], []
                for k, (text, todo) in enumerate(zip(part.column(2), part.column(3), strict=True)):
                    whole = symbols(text.as_py(), unit)
                    size = whole.itemsize
                    for x in todo.as_py():
                        at = x["at"]
                        left = whole[max(0, at - gram) : at]
                        right = whole[at : at + threshold]
                        data.append(left.tobytes().rjust(gram * size, b"\0") + right.tobytes().ljust(threshold * size, b"\0"))
                        kept.append((x["gram"], x["classes"], at, len(left), len(right)))
                        rows.append(k)
                if rows:
                    take = pa.array(rows)
                    cols = [pa.array(c, pa.int64()) for c in zip(*kept, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(take), part.column(1).take(take), *cols, pa.array(data, pa.binary())],
                        ["id", "text_hash", "gram", "classes", "at", "left", "right", "bytes"],
                    )

    return run


def _sums(data: list[bytes], threshold: int) -> list[np.ndarray]:
    """Prefix sums of stretches' symbols, for two hashes."""
    wide = threshold // 2 + threshold
    x = np.frombuffer(b"".join(data), np.uint8 if len(data[0]) == wide else np.uint64).reshape(len(data), wide)
    out = []
    for base in _BASES:
        sums = np.zeros((len(x), wide + 1), np.uint64)
        np.cumsum(_valued(x) * _powers(base, wide)[None, :], axis=1, out=sums[:, 1:])
        out.append(sums)
    return out


def window_hashes(data: list[bytes], left: np.ndarray, right: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each stretch's windows by distance before the gram, and which exist."""
    gram = threshold // 2
    # A window's hash only meets others at the same distance, so it needs no scaling by its place.
    found = [_mix(sums[:, threshold:] - sums[:, : gram + 1])[:, ::-1] for sums in _sums(data, threshold)]
    back = np.arange(gram + 1)[None, :]
    return found[0], found[1], (back <= left[:, None]) & (threshold - back <= right[:, None])


def _parts(threshold: int) -> list[tuple[int, int]]:
    """First and last distance of each part of a stretch's windows."""
    cuts = [threshold // 2 * k // PARTS for k in range(PARTS)]
    return [(a, z - 1) for a, z in zip(cuts, [*cuts[1:], threshold // 2 + 1], strict=True) if a < z]


def _spans(at: int, back: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Byte spans of the windows that start ``back`` before ``at``."""
    starts = np.sort(at - back)
    cut = np.flatnonzero(np.diff(starts) > 1)
    first = np.concatenate([[0], cut + 1])
    last = np.concatenate([cut, [len(starts) - 1]])
    return list(zip(starts[first].tolist(), (starts[last] + threshold).tolist(), strict=True))


def _compared(threshold: int):
    """Spans repeated within groups; a partition's rows come ordered by gram."""

    def group(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) < 2:
            return
        ids, hashes, _, at, left, right, data = zip(*rows, strict=True)
        one, two, there = window_hashes(data, np.array(left), np.array(right), threshold)
        one = np.where(there, one, np.arange(len(rows), dtype=np.uint64)[:, None])  # what isn't there equals nothing
        order = np.argsort(one, axis=0, kind="stable")
        a, b = np.take_along_axis(one, order, 0), np.take_along_axis(two, order, 0)
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        twice = np.zeros(a.shape, bool)
        twice[1:] |= same
        twice[:-1] |= same
        back = np.zeros(a.shape, bool)
        np.put_along_axis(back, order, twice, 0)
        back &= there
        for k in np.flatnonzero(back.any(axis=1)):
            for span in _spans(at[k], np.flatnonzero(back[k]), threshold):
                yield ids[k], hashes[k], *span

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kind = None

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            a, h, p, q = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(a, kind), pa.array(h, pa.int64()), pa.array(p, pa.int64()), pa.array(q, pa.int64())],
                ["id", "text_hash", "start", "stop"],
            )

        for b in batches:
            kind = b.schema.field(0).type
            found = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[-1][2] != row[2]:
                    found += group(held)
                    held = []
                held.append(row)
            if found:
                yield packed(found)
        found = list(group(held))
        if found:
            yield packed(found)

    return run


def _digits(threshold: int):
    """A row for each part of the windows of large groups' stretches: a hash of what the part's windows share."""
    gram = threshold // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in (b.slice(i, 1024) for i in range(0, b.num_rows, 1024)):
                ids, hashes, key, at, left, right, data = rows.columns
                before, after = left.to_numpy(), right.to_numpy()
                sums = _sums(data.to_pylist(), threshold)[0]
                for k, (first, last) in enumerate(_parts(threshold)):
                    there = np.maximum(first, threshold - after) <= np.minimum(last, before)
                    digit = _mix(sums[:, gram + threshold - last] - sums[:, gram - first])
                    take = pa.array(np.flatnonzero(there))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(take), hashes.take(take), key.take(take), at.take(take),
                         pa.array(np.full(len(take), k, np.int32)), pa.array(digit.view(np.int64)).take(take)],
                        ["id", "text_hash", "gram", "at", "part", "digit"],
                    )

    return run


def _windows(threshold: int):
    """A row for each window of a part of a stretch."""
    parts = np.array(_parts(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                ids, hashes, gram, at, left, right, data, part = rows.columns
                one, two, there = window_hashes(data.to_pylist(), left.to_numpy(), right.to_numpy(), threshold)
                first, last = parts[part.to_numpy()].T
                back = np.arange(there.shape[1])[None, :]
                row, back = np.nonzero(there & (back >= first[:, None]) & (back <= last[:, None]))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), hashes.take(take), gram.take(take), pa.array(back.astype(np.int32)),
                     pa.array(at.to_numpy()[row] - back), pa.array(one[row, back].view(np.int64)), pa.array(two[row, back].view(np.int64))],
                    ["id", "text_hash", "gram", "back", "start", "w1", "w2"],
                )

    return run


def _again(rows: DataFrame, key: list[str], written: Written, label: str) -> DataFrame:
    """The rows whose key is found twice or more."""
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(c).alias(f"o_{c}") for c in key])
    # Written first: a join of two plain exchanges is one that adaptive execution can split.
    twice = written.table(twice, label)
    return rows.join(twice, [F.col(c) == F.col(f"o_{c}") for c in key]).drop(*twice.columns)


def repeated_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, local: int = LOCAL, unit: str = "bytes"
) -> DataFrame:
    """(id, text_hash, start, stop) of spans covered by repeated windows, in symbols; they may overlap."""
    written = Written(docs.sparkSession)
    keyed = _keyed(docs, doc_id, text)
    kind = keyed.schema["id"].dataType.simpleString()
    suffixes = written.table(
        keyed.mapInArrow(_suffixes(threshold, unit), f"id {kind}, text_hash long, at long, before int, after int, gram long, ext long"), "suffixes"
    )
    # First digit.
    alive = written.table(_again(suffixes, ["gram"], written, "grams").withColumn("tag", F.xxhash64("id", "text_hash", "at")), "suffixes-repeated")
    # Second digit.
    classes = alive.groupBy(F.col("gram").alias("c_gram"), F.col("ext").alias("c_ext")).agg(
        F.count(F.lit(1)).alias("n"), F.min("tag").alias("speaker")
    )
    classes = written.table(classes, "classes")
    sizes = written.table(
        classes.groupBy(F.col("c_gram").alias("s_gram")).agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"), "class-counts"
    )
    judged = (
        alive.join(classes, (F.col("gram") == F.col("c_gram")) & (F.col("ext") == F.col("c_ext")))
        .join(sizes, F.col("gram") == F.col("s_gram"), "left")
        .withColumn("whole", F.col("n") > 1)
        .withColumn("on", F.col("classes").isNotNull() & ((F.col("n") == 1) | (F.col("tag") == F.col("speaker"))))
        .where(F.col("whole") | F.col("on"))
        .select("id", "text_hash", "gram", "classes", "at", "before", "after", "whole", "on")
    )
    judged = written.table(judged, "suffixes-judged")
    spans = judged.where("whole").select(
        "id", "text_hash", (F.col("at") - F.col("before")).alias("start"), (F.col("at") - F.col("after") + threshold).alias("stop")
    )
    # Last digits.
    todo = (
        judged.where(F.col("on")).groupBy(F.col("id").alias("t_id"), F.col("text_hash").alias("t_hash"))
        .agg(F.collect_set(F.struct("gram", "classes", "at")).alias("todo"))
    )
    texts = keyed.join(todo, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("text_hash") == F.col("t_hash")))
    stretches = written.table(
        texts.select("id", "text_hash", "text", "todo").mapInArrow(
            _stretches(threshold, unit), f"id {kind}, text_hash long, gram long, classes long, at long, left long, right long, bytes binary"
        ).dropDuplicates(["id", "text_hash", "at"]), "stretches",
    )
    columns = ["id", "text_hash", "gram", "at", "left", "right", "bytes"]
    found = f"id {kind}, text_hash long, start long, stop long"
    few = stretches.where(F.col("classes") <= local).select(columns).repartition("gram").sortWithinPartitions("gram")
    near = few.mapInArrow(_compared(threshold), found)
    many = stretches.where(F.col("classes") > local).select(columns)
    digits = written.table(many.mapInArrow(_digits(threshold), f"id {kind}, text_hash long, gram long, at long, part int, digit long"), "digits")
    on = _again(digits, ["gram", "part", "digit"], written, "digits-repeated").select(
        F.col("id").alias("d_id"), F.col("text_hash").alias("d_hash"), F.col("at").alias("d_at"), "part"
    )
    parts = many.join(on, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("text_hash") == F.col("d_hash")) & (F.col("at") == F.col("d_at")))
    windows = written.table(
        parts.select(*columns, "part").mapInArrow(_windows(threshold), f"id {kind}, text_hash long, gram long, back int, start long, w1 long, w2 long"), "windows"
    )
    wide = _again(windows, ["gram", "back", "w1", "w2"], written, "windows-repeated").select(
        "id", "text_hash", "start", (F.col("start") + threshold).alias("stop")
    )
    out = materialize(spans.unionByName(near).unionByName(wide), "spans")
    written.drop()
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(stop, out[-1][1])
        else:
            out.append([start, stop])
    return [tuple(x) for x in out]


def _cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, the bytes removed and the number of maximal runs."""
    runs = merged(spans)
    kept, at = [], 0
    for start, stop in runs:
        kept.append(data[at:start])
        at = stop
    kept.append(data[at:])
    return b"".join(kept), sum(q - p for p, q in runs), len(runs)


def _in_bytes(data: bytes, spans: list[tuple[int, int]], unit: str) -> list[tuple[int, int]]:
    """Spans of words as bytes, the white space after each word included."""
    if unit == "bytes" or not spans:
        return spans
    at = [m.span() for m in _WORD.finditer(data)]
    return [(at[p][0], at[q - 1][1]) for p, q in spans]


def _with_spans(docs: DataFrame, doc_id: str, text: str, **spans: DataFrame) -> DataFrame:
    """(row, id, text and an array or null for each table of spans) of each document."""
    tables = [t.withColumn("of", F.lit(name)) for name, t in spans.items()]
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    lists = whole.groupBy(F.col("id").alias("s_id"), F.col("text_hash").alias("s_hash")).agg(
        *(F.collect_set(F.when(F.col("of") == name, F.struct("start", "stop"))).alias(name) for name in spans)
    )
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc_id].alias("id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    return rows.join(lists, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("text_hash") == F.col("s_hash")), "left")


def _pairs(spans) -> list[tuple[int, int]]:
    return [(x["start"], x["stop"]) for x in spans if x] if spans is not None else []


def _report(unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans, passages in zip(*b.columns[1:], strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                left, n, runs = _cut(data, _in_bytes(data, _pairs(spans.as_py()), unit))
                words = sum(q - p for p, q in merged(_pairs(passages.as_py())))
                rows.append((len(data), n, runs, hashlib.sha256(left).hexdigest(), words))
            a, n, r, h, w = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(h, pa.string()), pa.array(w, pa.int64())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"],
            )

    return run


def repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, local: int = LOCAL, unit: str = "bytes",
    passage_words: int | None = None,
) -> DataFrame:
    """Each row's id, its bytes, the bytes and runs removed, and a digest of the rest.

    With ``passage_words`` also ``n_passage_words``, the words of the text inside windows of
    so many words that also start elsewhere; they are reported and not removed.
    """
    only = docs.select(doc_id, text)
    spans = repeated_spans(only, doc_id, text, threshold, local, unit)
    more = repeated_spans(only, doc_id, text, passage_words, local, "words") if passage_words else spans.limit(0)
    rows = _with_spans(only, doc_id, text, spans=spans, passages=more).select("id", "text", "spans", "passages")
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_report(unit), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long")
    return (out if passage_words else out.drop("n_passage_words")).withColumnRenamed("id", doc_id)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, local: int = LOCAL, unit: str = "bytes"
) -> DataFrame:
    """``docs`` with repeated bytes or words taken out of its text, words with the white space after them.

    A character that a removed run splits goes with it; a null text stays null.
    """

    @F.pandas_udf("string")
    def cut(texts, spans):
        def left(t: str, s) -> str:
            data = t.encode("utf-8", "surrogatepass")
            return _cut(data, _in_bytes(data, _pairs(s), unit))[0].decode("utf-8", "ignore")

        return texts.combine(spans, lambda t, s: t if s is None else left(t, s))

    rows = _with_spans(docs, doc_id, text, spans=repeated_spans(docs, doc_id, text, threshold, local, unit))
    left = F.when(F.col("row")[text].isNull(), F.lit(None).cast("string")).otherwise(F.col("left"))
    return rows.withColumn("left", cut("text", "spans")).withColumn("row", F.col("row").withField(text, left)).select("row.*")
