import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusbench.llm import negatives
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int, row int, x int, windows int"
LONG = (1 << 63) - 1


def whole(v):
    return [max(-LONG - 1, min(LONG, int(np.floor(256.0 * float(c))))) for c in v]


def expected(rows, anchor, k=5, low=80, high=100):
    ok = [
        (i, label, whole(v)) for i, v, label in rows
        if i is not None and label is not None and v is not None and None not in v and np.isfinite(v).all()
    ]
    out = []
    for a, label, x in ok:
        if not anchor(a):
            continue
        scores = [
            (-max(-LONG - 1, min(LONG, sum(p * q for p, q in zip(x, y, strict=True)))), b, other)
            for b, other, y in ok if b != a and len(y) == len(x)
        ]
        same = sorted((s, b) for s, b, other in scores if other == label)[:k]
        for s, b in same:
            rest = sorted((t, c) for t, c, other in scores if other != label and low * -s <= 100 * -t <= high * -s)[:k]
            out += [(a, b, n + 1, c, -s, -t) for n, (t, c) in enumerate(rest)]
    return out


def made(seed, n=1500, size=12):
    r = np.random.default_rng(seed)
    x = r.normal(size=(8, size))[r.integers(0, 8, n)] * 0.2 + r.normal(size=(n, size)) * 0.1
    x[200:500] = x[200]  # many equal rows: ties
    label = np.where(r.random(n) < 0.35, 0, r.integers(0, 12, n))
    rows = [(k, v.astype(np.float32).tolist(), int(c)) for k, (v, c) in enumerate(zip(x, label, strict=True))]
    rows += [(10, rows[10][1], 3), (10, rows[10][1], rows[10][2]), (None, rows[3][1], 1), (3000, None, 1),
             (3010, [None] * size, 2), (3020, [float("nan")] * size, 2), (3030, [float("inf")] * size, 2),
             (3040, [0.5, 0.25], 4), (3050, [0.5, 0.5], 4), (3060, [0.5, 0.2], 5), (3070, [], 1), (3080, [], 1), (3090, [], 2),
             (3100, [0.0] * size, 1), (3110, rows[0][1], None)]
    return rows


@pytest.mark.parametrize("values", [1 << 18, 1200])
def test_against_all_pairs(spark, values):
    rows = made(4)
    frame = spark.createDataFrame([(i, v, c, 1, 2, 3) for i, v, c in rows], SCHEMA)
    found = [tuple(r) for r in negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, shard_values=values).collect()]
    want = expected(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    assert sorted(found, key=brute.sort_key) == sorted(want, key=brute.sort_key)


def test_components_beyond_doubles_and_longs(spark):
    r = np.random.default_rng(2)
    rows = [(k, (r.normal(size=6) * 10.0 ** r.integers(0, 15)).tolist(), int(r.integers(0, 2))) for k in range(60)]
    rows += [(100, [1e30] * 6, 0), (101, [1e300] * 6, 1), (102, [-1e300] * 6, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = [tuple(r) for r in negatives.hard_negatives(frame, F.lit(True)).collect()]
    assert sorted(found) == sorted(expected(rows, lambda i: True))


def test_search_stops_before_the_end_of_the_lists():
    r = np.random.default_rng(7)
    x = np.floor(256 * r.normal(size=(20_000, 3))).astype(np.int64)
    labels = np.array(["b"] * len(x), object)
    x[5] = 4 * x.max()
    shard = negatives._Shard(np.arange(len(x)), labels, x)
    looked = []

    class Told(negatives._Window):
        def add(self, scores, ids, k):
            looked.append(len(scores))
            super().add(scores, ids, k)

    window = Told(1, 0, 0, -negatives._LONG, negatives._LONG - 1)
    shard.find(x[7], 7, "a", [window], False, 5)
    scores = x @ x[7]
    best = sorted((-int(s), i) for i, s in enumerate(scores) if i != 7)[:5]
    assert [(-s, i) for s, i in zip(window.scores, window.ids, strict=True)] == best
    assert sum(looked) < len(x) / 4


def test_empty_table_and_repeated_rows(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    rows = [(100, [0.5, 0.5], 1)] * 40 + [(101, [0.5, 0.5], 1), (102, [0.5, 0.4], 2), (102, [0.5, 0.4], 2)]
    frame = spark.createDataFrame([(i, v, c, 1, 2, 3) for i, v, c in rows], SCHEMA)
    found = [tuple(r) for r in negatives.hard_negatives(frame, F.col("vec_id") == 100).collect()]
    assert sorted(found) == sorted(expected(rows, lambda i: i == 100)) and len(found) == 80
