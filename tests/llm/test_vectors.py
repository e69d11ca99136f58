from pathlib import Path

import numpy as np
import pytest

from corpusbench.llm import vectors
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int, m int, id int"


def made(seed, n=900, size=24):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(6, size))
    x = centers[r.integers(0, 6, n)] + r.normal(size=(n, size))
    for k in range(0, n, 30):
        x[k : k + 12] = x[k] + r.normal(size=(12, size)) * r.choice([0.0, 0.1, 0.25])
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)]
    rows += [(n + k, (2 * np.array(rows[k][1])).tolist()) for k in range(5)]
    rows += [(2000, None), (2001, [0.0] * size), (2002, [None] + [1.0] * (size - 1)), (2003, [float("nan")] * size),
             (2004, [float("inf")] * size), (2005, []), (None, rows[0][1]), (3, rows[3][1]), (2006, [1.0, 2.0]),
             (2007, [1.0, 2.0]), (2008, [2.0, 4.1]), (2009, rows[1][1]), (2010, [1e-30] * size), (2011, [3e-30] * size)]
    return rows


def expected(rows, threshold=0.95):
    def clean(i, v):
        return i is not None and v and None not in v and np.isfinite(v).all() and any(v)

    ok = [k for k, (i, v) in enumerate(rows) if clean(i, v)]
    unit = {k: vectors.unit(np.array([rows[k][1]], float))[0] for k in ok}
    label = {i: i for i, _ in rows if i is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    links = dict.fromkeys(range(len(rows)), 0)
    for p, a in enumerate(ok):
        for b in ok[:p]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                low, high = sorted((root(rows[a][0]), root(rows[b][0])))
                label[high] = low
    return [(i, links[k], None if i is None else root(i), i is None or root(i) == i) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [2048, 16])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "CELL", 40)
    rows = made(1)
    frame = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA)
    found = [tuple(r) for r in vectors.near_vectors(frame).collect()]
    assert sorted(found, key=brute.sort_key) == sorted(expected(rows), key=brute.sort_key)


def linked(x, block=4096):
    """Links of each unit vector, by all pairs in blocks."""
    return np.concatenate([(x[k : k + block] @ x.T >= 0.95).sum(axis=1) - 1 for k in range(0, len(x), block)])


@pytest.mark.parametrize(("rank", "size"), [(4, 64), (6, 64), (8, 256), (16, 768)])
def test_vectors_of_low_rank_lose_no_link(spark, monkeypatch, rank, size):
    monkeypatch.setattr(vectors, "CELL", 40)
    r = np.random.default_rng(rank)
    n = 5200
    x = r.normal(size=(n, rank))
    x[::20] = x[1::20] + 0.25 * r.normal(size=x[::20].shape)
    x = (x @ r.normal(size=(rank, size))).astype(np.float32)
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    assert len(vectors.fit(frame.selectExpr("vec_id AS id", "embedding AS v"))[size]) >= 128
    found = {row.vec_id: row.n_links for row in vectors.near_vectors(frame).collect()}
    truth = linked(vectors.unit(x.astype(float)))
    assert truth.sum() > 100
    assert [found[k] for k in range(n)] == truth.tolist()


def given():
    """The largest of the given tables that are there."""
    folders = [Path("/root/testdata") / d / "embeddings.parquet" for d in ("check_h", "sf0.1", "sf0.01")]
    return next((str(d) for d in folders if d.exists()), None)


def test_given_vectors_lose_no_link(spark):
    """The whole table with the query's own cells; made vectors where there is none."""
    if given() is None:
        frame = spark.createDataFrame(made(2, 3000)[:3000], "vec_id long, embedding array<float>")
    else:
        frame = spark.read.parquet(given()).select("vec_id", "embedding")
    rows = frame.collect()
    truth = linked(vectors.unit(np.array([r.embedding for r in rows], float)))
    found = {r.vec_id: r.n_links for r in vectors.near_vectors(frame).collect()}
    assert [found[r.vec_id] for r in rows] == truth.tolist()


def test_many_repeated_rows(spark):
    v = [0.5, 0.25, 1.0]
    rows = [(7, v)] * 1500 + [(k, v) for k in range(100, 1600)] + [(None, v)] * 500
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {(r.n_links, r.component_id) for r in found if r.vec_id is not None} == {(2999, 7)}
    assert sum(r.vec_id is None and r.n_links == 0 for r in found) == 500


def test_empty_table(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
