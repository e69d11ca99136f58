import random

import pytest
from pyspark.sql import functions as F

from corpusbench.functions import alignment
from corpusbench.operators import long_pairs
from tests.test_alignment import made, noisy


def counted(spark, pairs, kind, tile):
    rows = [(str(k), a, b) for k, (a, b) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, f"name string, r {kind}, h {kind}")
    out = long_pairs.align_long(frame, key="name", reference="r", hypothesis="h", tile=tile)
    return {r.name: (r.s, r.d, r.i, r.n) for r in out.collect()}


def test_tiles_against_whole_pairs(spark):
    pairs = [p for p in made(21, 60, [0, 1, 5, 16, 33, 70]) if isinstance(p[0], str)]
    pairs += [("a" * 60 + "b" * 70, "b" * 70 + "a" * 60), ("x" * 100, "y"), ("", "abc"), ("abc", "")]
    want = {str(k): alignment.align(*p) for k, p in enumerate(pairs)}
    assert counted(spark, pairs, "string", 32) == want


def test_tokens_and_nulls(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    a = [r.choice(words) for _ in range(150)]
    pairs = [(a, noisy(r, a, 0.3, words)), (a, a), (None, a), (a, None)]
    found = counted(spark, pairs, "array<string>", 40)
    assert found["0"] == alignment.align(*pairs[0]) and found["1"] == (0, 0, 0, 150)
    assert found["2"] == found["3"] == (None,) * 4


@pytest.mark.parametrize("rate", [0.1, 0.5])
def test_one_long_pair_over_many_tasks(spark, rate):
    r = random.Random(3)
    a = [r.choice("abcdefgh ") for _ in range(24_000)]
    b = "".join(noisy(r, a, rate, "abcdefgh "))
    assert counted(spark, [("".join(a), b)], "string", 4096) == {"0": alignment.align("".join(a), b)}


def test_pairs_of_one_tile_are_aligned_many_at_a_time(spark, monkeypatch):
    counted_as_tiles = []
    tiles = long_pairs._counted
    monkeypatch.setattr(long_pairs, "_counted", lambda todo, *rest: counted_as_tiles.append(todo.count()) or tiles(todo, *rest))
    r = random.Random(5)
    short = [("".join(r.choice("abc ") for _ in range(20)), "".join(r.choice("abc ") for _ in range(r.choice([0, 32])))) for _ in range(200)]
    long = ("abc " * 20, "acb " * 19)
    want = {str(k): alignment.align(*p) for k, p in enumerate([*short, long])}
    assert counted(spark, [*short, long], "string", 32) == want
    assert counted_as_tiles[0] == 1


def test_keys_may_repeat(spark):
    rows = [("k", "abc", "abd"), ("k", "abcd" * 10, "abc" * 11), ("k", "xyz" * 12, "xz" * 12), ("k", None, "a")]
    frame = spark.createDataFrame(rows, "name string, r string, h string")
    out = long_pairs.align_long(frame, key="name", reference="r", hypothesis="h", tile=16).collect()
    want = [(None,) * 4, *(alignment.align(*p[1:]) for p in rows[:3])]
    assert sorted([tuple(x)[1:] for x in out], key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert counted(spark, [], "string", 16) == {}


def test_a_tile_computes_only_the_diagonals_of_the_bound():
    """A pair of 16 tiles a side whose cost is at most 60: about its diagonals, not about its tiles."""
    tile, length, bound = 256, 4096, 60
    cells = sum(
        (stop - start) * (high - low)
        for a in range(16) for b in range(16)
        for start, stop, low, high in long_pairs._blocks(a, b, length, length, bound, tile)
    )
    assert length * (bound + 1) <= cells < 3 * length * bound < 3 * length * tile


def test_tiles_of_equal_texts_are_done_once(spark, monkeypatch):
    rounds = []
    tiles = long_pairs._counted
    monkeypatch.setattr(long_pairs, "_counted", lambda todo, *rest: rounds.append(todo.count()) or tiles(todo, *rest))
    r = random.Random(8)
    a = "".join(r.choice("abc ") for _ in range(70))
    assert counted(spark, [(a, a), (a, a[:30] + "x" + a[30:])], "string", 16) == {"0": (0, 0, 0, 70), "1": (0, 0, 1, 70)}
    assert rounds == [2]


def test_a_bound_that_is_too_small_is_raised(spark, monkeypatch):
    monkeypatch.setattr(long_pairs, "cost_bound", lambda r, h: F.lit(12).cast("long"))
    r = random.Random(9)
    a = [r.choice("abcd") for _ in range(60)]
    pairs = [("".join(a), "".join(noisy(r, a, 0.5, "abcd"))), ("a" * 28 + "b" * 30, "b" * 30 + "a" * 28)]
    assert counted(spark, pairs, "string", 24) == {str(k): alignment.align(*p) for k, p in enumerate(pairs)}


def test_a_pair_with_no_more_cells_than_a_tile_needs_no_tiles(spark, monkeypatch):
    monkeypatch.setattr(long_pairs, "_counted", None)
    pair = ("abcd" * 30, "abdd" * 29)
    assert counted(spark, [pair], "string", 80) == {"0": alignment.align(*pair)}


def test_bounds_are_never_below_the_cost():
    pairs = made(31, 80, [1, 5, 40, 300])
    for bound, counts in zip(alignment.first_bounds(pairs), alignment.align_many(pairs), strict=True):
        assert bound >= sum(counts[:3])
