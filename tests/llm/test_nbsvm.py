"""The classifier's parts, and its accuracy on rows it never learned from."""

import zlib

import numpy as np

from tidemark.llm import nbsvm


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet")
    got = nbsvm.classify(docs, labels).join(labels, "doc_id", "left").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    seen = got[got.held_out & got.quality.notna()]
    assert (seen.predicted == seen.quality).mean() > 0.95
    good, bad = seen[seen.quality == 1].score.to_numpy(), seen[seen.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97


def test_scores_use_texts_alone(spark):
    texts = ["fine words here", "BAD!! BAD!! |", "", None, "fine words here"]
    docs = spark.createDataFrame([(i, texts[i % 5], "s" if i % 2 else None, 0.5) for i in range(300)] + [(None, "x", None, 0.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, int(i % 5 != 1)) for i in range(300)] + [(3, None), (3, 1), (10**6, 1)], "doc_id long, quality int")
    got = nbsvm.classify(docs, labels).collect()
    by_text = {}
    for r in got:
        if r.doc_id is not None:
            by_text.setdefault(texts[r.doc_id % 5] or "", set()).add(r.score)
    assert len(got) == 301 and all(len(s) == 1 for s in by_text.values())
    assert max(by_text["BAD!! BAD!! |"]) < 0.3 < min(by_text["fine words here"])


def test_one_class_and_no_rows(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(20)], "doc_id long, text string")
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert {r.predicted for r in nbsvm.classify(docs, one).collect()} == {1}
    assert {r.score for r in nbsvm.classify(docs, one.limit(0)).collect()} == {0.5}
    assert nbsvm.classify(docs.limit(0), one).collect() == []


def test_ngrams_do_not_depend_on_neighbours():
    texts = [b"A b c", b"", b"A b c\nA b c\n", b"x " * 5000, "é È 12 a1".encode()]
    row, feature = nbsvm.ngrams(texts, 18)
    for k, t in enumerate(texts):
        alone = nbsvm.ngrams([t], 18)[1]
        assert feature[row == k].tolist() == alone.tolist() == sorted(set(alone.tolist()))


def test_dual_descent_finds_the_separating_plane():
    rng = np.random.default_rng(0)
    x = rng.random((200, 30)) < 0.3
    y = np.where(x[:, 0] | x[:, 1], 1.0, -1.0)
    w, b = nbsvm.descend([np.flatnonzero(r) for r in x], y, np.ones(30), np.full(200, 100.0), epochs=300)
    assert (np.sign(x @ w + b) == y).mean() > 0.99


def test_sigmoid():
    rng = np.random.default_rng(0)
    m = rng.normal(size=4000) * 30
    good = rng.random(4000) < 1 / (1 + np.exp(-(m / 30 * 2 + 1)))
    slope, offset = nbsvm.sigmoid(m, good)
    assert abs(slope * 30 - 2) < 0.3 and abs(offset - 1) < 0.2


def test_dual_descent_is_the_least_loss():
    """The primal loss against a search over weights and bias."""
    rng = np.random.default_rng(3)
    x = np.array([[1, 0, 1], [1, 1, 0], [0, 1, 0], [0, 0, 1], [1, 0, 0], [0, 1, 1], [1, 1, 1], [0, 0, 0], [1, 0, 1], [0, 1, 0]], float)
    y, ratio, cost = np.array([1, 1, -1, -1, 1, -1, 1, -1, -1, 1.0]), np.array([1.5, -0.7, 0.4]), rng.uniform(0.3, 2, 10)
    w, b = nbsvm.descend([np.flatnonzero(r) for r in x], y, ratio, cost, epochs=2000)
    rows = np.hstack([x * ratio, np.ones((10, 1))])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    loss = lambda v: v @ v / 2 + cost @ np.maximum(0, 1 - y * (rows @ v))
    best = np.zeros(4)
    for step in (1.0, 0.3, 0.1, 0.03, 0.01, 0.003):
        for _ in range(4000):
            new = best + rng.normal(size=4) * step
            best = new if loss(new) < loss(best) else best
    assert loss(np.append(w / ratio, b)) <= loss(best) + 1e-3


def plain_scores(docs, labels, fit_rows, fit_features):
    """The whole method by loops over sets of n-grams; docs: (id, text), labels: (id, label)."""
    votes = {}
    for i, q in labels:
        if q is not None and i is not None and zlib.crc32(str(i).encode()) % 5:
            votes.setdefault(i, []).append(q)
    grams = lambda t: frozenset(nbsvm.ngrams([(t or "").encode()], nbsvm.BITS)[1].tolist())
    train = [(i, t or "", sum(votes[i]) / len(votes[i]) >= 0.5) for i, t in docs if i in votes]
    n = [sum(g == side for _, _, g in train) for side in (False, True)]
    ratio = np.zeros(1 << nbsvm.BITS)
    for f in set().union(*(grams(t) for _, t, _ in train)):
        c = [sum(f in grams(t) for _, t, g in train if g == side) for side in (False, True)]
        ratio[f] = np.log((c[1] + 1) / (n[1] + 2) / ((c[0] + 1) / (n[0] + 2))) if sum(c) > 1 else 0
    return train, ratio


def test_against_a_plain_fit(spark):
    rng = np.random.default_rng(8)
    words = "good fine nice calm BAD!! ugly ###".split()
    texts = [" ".join(rng.choice(words[:5] if i % 2 else words[3:], 6)) for i in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(60, None), (61, ""), (7, texts[7]), (7, "other text")]
    labels = [(i, i % 2) for i in range(62)] + [(4, 1), (5, None)]  # id 4: a tie
    d = spark.createDataFrame([(*r, 0, "x") for r in docs], "doc_id long, text string, good int, place string")
    q = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, text string")
    seen = {}
    fitted = nbsvm._fitted
    try:
        nbsvm._fitted = lambda f, g, r: seen.setdefault(len(f), (f, g, r)) and fitted(f, g, r)
        model = nbsvm.fit(d, q)
    finally:
        nbsvm._fitted = fitted
    train, ratio = plain_scores(docs, labels, nbsvm.FIT_ROWS, nbsvm.FIT_FEATURES)
    distinct = {(i, t): g for i, t, g in train}
    features, good, used = seen[len(distinct)]
    assert np.allclose(used, ratio) and (4, texts[4]) in distinct and (not zlib.crc32(b"4") % 5 or distinct[4, texts[4]])
    want = sorted((tuple(sorted(nbsvm.ngrams([t.encode()], nbsvm.BITS)[1].tolist())), g) for (_, t), g in distinct.items())
    assert sorted((tuple(sorted(f.tolist())), bool(g)) for f, g in zip(features, good)) == want
    weights, bias = fitted(features, good, ratio)
    assert np.allclose(model.weights, weights) and model.bias == bias and model.slope > 0
    got = nbsvm.classify(d, q)
    margin = lambda t: bias + sum(weights[f] for f in nbsvm.ngrams([(t or "").encode()], nbsvm.BITS)[1])
    by = dict(docs[:60])
    for r in got.where("doc_id < 60 and doc_id <> 7").collect():
        assert abs(r.score - 1 / (1 + np.exp(-(model.slope * margin(by[r.doc_id]) + model.offset)))) < 1e-9


def test_features_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i} b{i % 3} c") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    sizes = []
    fitted = nbsvm._fitted
    monkeypatch.setattr(nbsvm, "_fitted", lambda f, g, r: sizes.append(sum(map(len, f))) or fitted(f, g, r))
    nbsvm.fit(docs, labels, fit_features=500)
    assert len(sizes) == nbsvm.FOLDS + 1 and 400 < sizes[0] <= 500
