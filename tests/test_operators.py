"""As-of and range joins against plain loops; applying changes."""

import random

from tidemark import apply_changes
from tidemark.operators.asof import asof_join, range_join


def test_asof(spark):
    rng = random.Random(2)
    left = [(i, rng.choice([1, 2, 3, None]), rng.choice([None, *range(100)])) for i in range(120)]
    times = {k: rng.sample(range(100), 12) for k in (1, 2)}
    right = [(k, t, f"{k}.{t}") for k, ts in times.items() for t in ts] + [(None, 5, "null"), (1, None, "never")]
    got = asof_join(spark.createDataFrame(left, "id long, k long, t long"), spark.createDataFrame(right, "k long, t long, v string"), ["k"], "t", ["v"], "t div 10")
    assert got.columns == ["id", "k", "t", "v"]
    want = []
    for i, k, t in left:
        seen = [(u, v) for q, u, v in right if q == k and k is not None and u is not None and t is not None and u <= t]
        want.append((i, k, t, max(seen)[1] if seen else None))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_range(spark):
    rng = random.Random(3)
    points = [(i, rng.choice([None, rng.uniform(-5, 50)])) for i in range(100)]
    ranges = [(j, a, a + rng.uniform(-1, 9)) for j, a in enumerate(rng.uniform(-5, 50) for _ in range(30))] + [(99, None, 3.0)]
    got = range_join(spark.createDataFrame(points, "i long, p double"), spark.createDataFrame(ranges, "j long, a double, z double"), "p", "a", "z", 2.0)
    want = [(i, j) for i, p in points for j, a, z in ranges if p is not None and a is not None and a <= p < z]
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(want)


def test_apply_changes(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "k string, v long")
    out = apply_changes(make(("a", 1), ("b", 2), ("c", 3)), ["k"], make(("d", 4)), make(("b", 9), ("a", None)), make(("c", 0)))
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("b", 9), ("d", 4)]
    assert apply_changes(make(("a", 1)), ["k"]).count() == 1
