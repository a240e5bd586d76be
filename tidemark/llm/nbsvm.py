"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by
naive Bayes log-count ratios.

1. Texts become sets of hashed n-grams: words and pairs of words; shapes of words
   (letter cases, digits, marks, runs collapsed) alone, in pairs, and with the share of the
   text that they make up; and how often words and lines repeat.
2. Over the texts of ``LABEL_ROWS`` labels at most, the first by hash of their id, the documents with
   each n-gram are counted per class; the log of the ratio of their smoothed shares scales the indicator.
3. Dual coordinate descent fits a hinge-loss model with a weight for each class
   on ``FIT_ROWS`` of these texts at most with ``FIT_FEATURES`` n-grams at most, each once, the first by hash of text
   and id. A sigmoid turns margins into probabilities; it is fitted on the margins that each of these rows gets
   from a model of the other ``FOLDS - 1`` folds.
4. Every text is scored, whole, where it is read.

Scale. The labels in use are bounded and go to the texts, which are never shuffled. Counts are summed
before their shuffle and there are at most 2 ** ``BITS`` of them; with the two bounded
samples they are all that the driver gets. The model is an array of that size. Scoring has no shuffle.

Cases. Null and empty texts have no n-grams and get the score of the bias. Null labels
are left out; rows that share an id have each other's label, and several labels
of one id make one by majority (a tie is 1). With one class only, or no label, every score is
the share of label 1, or 0.5. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize

BITS = 18
LABEL_ROWS = 50_000
FIT_ROWS = 12_000
FIT_FEATURES = 1 << 24
FOLDS = 3
THRESHOLD = 0.3
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Bytes of text in work at once, and rows of a batch.
_CHUNK = 1 << 18
_SLICE = 500

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SHAPE = np.array(
    [65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else 32 if c in (9, 11, 12, 13) else c for c in range(256)], np.uint8
)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_VALUES = _mix(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        n = max(n, 2 * _CHUNK)
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _POWERS[0] = tuple(out)
    return have


def _hashed(x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the runs start..stop of a byte array."""
    power, inverse = _powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_VALUES[x] * power[: len(x)], out=sums[1:])
    return _mix((sums[stop] - sums[start]) * inverse[start])


def _runs(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def ngrams(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct n-grams of each text, in order of row."""
    x = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    gap = _GAP[x]
    start, stop = _runs(gap)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(ends, start, "right")
    word = _hashed(_FOLD[x], start, stop)
    shape = _SHAPE[x]
    keep = np.concatenate([[True], shape[1:] != shape[:-1]])
    place = np.concatenate([[0], np.cumsum(keep)])
    # Runs collapse, and a word's first byte always differs from the gap before it.
    form = _hashed(shape[keep], place[start], place[stop])
    next_to = row[1:] == row[:-1]
    n = np.bincount(row, minlength=len(texts))
    rows, keys = [row, row, row[1:][next_to], row[1:][next_to]], [word, form + _U(1), (_mix(word[:-1]) + word[1:])[next_to], (_mix(form[:-1]) + form[1:] + _U(2))[next_to]]

    def share(of_row: np.ndarray, what: np.ndarray, count: np.ndarray, salt: int) -> None:
        level = np.minimum(7, np.floor(np.log2(n[of_row] / count))).astype(np.uint64)
        rows.append(of_row)
        keys.append(what + (level + _U(salt)) * _U(_BASE))

    pair = np.lexsort((form, row))
    first = np.flatnonzero(np.concatenate([[True], (row[pair][1:] != row[pair][:-1]) | (form[pair][1:] != form[pair][:-1])]))
    share(row[pair][first], form[pair][first], np.diff(np.concatenate([first, [len(pair)]])), 16)
    for back in (1, 2):
        same = np.bincount(row[back:][(word[back:] == word[:-back]) & (row[back:] == row[:-back])], minlength=len(texts)) if len(word) > back else np.zeros(len(texts), int)
        hit = np.flatnonzero(same)
        share(hit, np.full(len(hit), back, np.uint64), same[hit], 32)
    lines, line_ends = _runs(x == 10)
    if len(lines) > 1:
        of, line = np.searchsorted(ends, lines, "right"), _hashed(x, lines, line_ends)
        order = np.lexsort((line, of))
        of, line = of[order], line[order]
        same = np.bincount(of[1:][(of[1:] == of[:-1]) & (line[1:] == line[:-1])], minlength=len(texts))
        hit = np.flatnonzero(same & (n > 0))
        share(hit, np.full(len(hit), 3, np.uint64), np.maximum(same[hit], 1), 48)
    feature = _mix(np.concatenate(keys)) >> _U(64 - bits)
    both = np.unique(np.concatenate(rows).astype(np.uint64) << _U(bits) | feature)
    return (both >> _U(bits)).astype(np.int64), (both & _U((1 << bits) - 1)).astype(np.int64)


def _parts(texts: list[bytes]) -> Iterator[slice]:
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= _CHUNK:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, _SLICE) for i in range(0, batch.num_rows, _SLICE))


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        bits = int(len(self.weights)).bit_length() - 1
        out = [np.zeros(0)]
        for part in _parts(texts):
            row, feature = ngrams(texts[part], bits)
            margin = self.bias + np.bincount(row, self.weights[feature], minlength=part.stop - part.start)
            out.append(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500))))
        return np.concatenate(out)


def _scored(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _sliced(b):
                found = handle.value.scores(_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["id", "score"])

    return run


def _counted(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int64)
        docs = np.zeros(2, np.int64)
        for b in (s for whole in batches for s in _sliced(whole)):
            texts, good = _bytes(b.column(0)), b.column(1).to_numpy(zero_copy_only=False) > 0
            docs += [(~good).sum(), good.sum()]
            for part in _parts(texts):
                row, feature = ngrams(texts[part], bits)
                of = good[part][row]
                for k, mine in enumerate((~of, of)):
                    total[k] += np.bincount(feature[mine], minlength=1 << bits)
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(total[0, at], docs[0])), pa.array(np.append(total[1, at], docs[1]))], ["feature", "bad", "good"]
        )

    return run


def _packed(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in _sliced(whole)):
            texts = _bytes(b.column(0))
            found = []
            for part in _parts(texts):
                row, feature = ngrams(texts[part], bits)
                cuts = np.searchsorted(row, np.arange(1, part.stop - part.start))
                found += [f.astype(np.int32).tobytes() for f in np.split(feature, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column(1), b.column(2)], ["features", "good", "place"])

    return run


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int = 30, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model by dual coordinate descent.

    ``rows``: feature numbers of each row, whose values are ``ratio``; each row is scaled
    to length 1 with its constant feature, so texts of all lengths weigh alike.
    """
    weights, bias = np.zeros(len(ratio)), 0.0
    values = [ratio[r].astype(np.float32) for r in rows]
    scale = 1 / np.sqrt(np.array([float(v @ v) for v in values]) + 1)
    alpha = np.zeros(len(rows))
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        most = 0.0
        for i in order:
            gradient = y[i] * scale[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient, 0.0), cost[i])  # a row's squared length is 1
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i] * scale[i]
                weights[rows[i]] += step * values[i]
                bias += step
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return weights * ratio, bias


def _fitted(features: list[np.ndarray], good: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """The model with both classes' costs summing to the same."""
    cost = np.where(good, len(good) / 2 / max(1, good.sum()), len(good) / 2 / max(1, (~good).sum()))
    return descend(features, np.where(good, 1.0, -1.0), ratio, cost)


def sigmoid(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on the log loss, with smoothed targets."""
    up, down = good.sum(), (~good).sum()
    target = np.where(good, (up + 1) / (up + 2), 1 / (down + 2))
    spread = margin.std() or 1.0
    x = np.stack([margin / spread, np.ones(len(margin))])
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + 1e-6 * np.eye(2), x @ (p - target))
        w = w - np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1])


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    bits: int = BITS, label_rows: int = LABEL_ROWS, fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES,
) -> Model:
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("l_id")).agg(
        (F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("good")
    )
    known = known.where(~held_out(F.col("l_id"))).orderBy(F.xxhash64(F.lit(5), "l_id"), "l_id").limit(label_rows)
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # At most label_rows rows of two numbers: texts stay where they are.
    train = rows.join(F.broadcast(known), F.col("id") == F.col("l_id")).select("id", "text", "good", F.xxhash64(F.lit(7), F.xxhash64("text"), "id").alias("place"))
    train = materialize(train, "labelled")
    found = (
        train.select("text", "good").mapInArrow(_counted(bits), "feature long, bad long, good long")
        .groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()
    )
    count = np.zeros((2, 1 << bits))
    docs_of = np.zeros(2)
    for k, name in enumerate(("bad", "good")):
        real = found["feature"] >= 0
        count[k, found["feature"][real]] = found[name][real]
        docs_of[k] = found[name][~real].sum()
    if not docs_of.all():
        share = (docs_of[1] + 1e-6) / (docs_of.sum() + 2e-6)
        return Model(np.zeros(1 << bits), 0.0, 0.0, float(np.log(share / (1 - share))))
    share = (count + 1) / (docs_of[:, None] + 2)
    ratio = np.log(share[1] / share[0])
    ratio[count.sum(0) < 2] = 0

    # A tenth more than wanted by the hash's share, cut to the bounds by sizes before any features come to the driver.
    share = min(1.0, 1.1 * fit_rows / docs_of.sum())
    picked = train.where(F.col("place") <= min(2**63 - 1, int((share - 0.5) * 2**64)))
    picked = picked.groupBy("place").agg(F.first("text").alias("text"), F.max("good").alias("good")).select("text", "good", "place")
    packed = materialize(picked.mapInArrow(_packed(bits), "features binary, good int, place long"), "features")
    sizes = sorted(map(tuple, packed.select("place", (F.octet_length("features") / 4).cast("long")).collect()))[:fit_rows]
    within = int(np.searchsorted(np.cumsum([n for _, n in sizes]), fit_features, "right"))
    last = sizes[max(0, within - 1)][0]
    sample = sorted(packed.where(F.col("place") <= last).collect(), key=lambda r: r.place)
    features = [np.frombuffer(r.features, np.int32) for r in sample]
    good = np.array([r.good > 0 for r in sample])
    weights, bias = _fitted(features, good, ratio)
    fold, unseen = np.arange(len(good)) % FOLDS, np.zeros(len(good))
    for k in range(FOLDS):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        w, b = _fitted([features[i] for i in rest], good[rest], ratio)
        unseen[own] = [b + w[features[i]].sum() for i in own]
    return Model(weights, bias, *sigmoid(unseen, good))


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, **bounds
) -> DataFrame:
    """Each row's id, whether it was held out, score and prediction."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text, label, **bounds))
    kind = docs.schema[doc_id].dataType.simpleString()
    out = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(_scored(model), f"id {kind}, score double")
    return out.select(
        F.col("id").alias(doc_id), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
