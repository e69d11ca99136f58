import random

import numpy as np
import pytest

from corpusbench.llm import hyperminhash
from corpusbench.llm.common import Powers, components, local_components
from tests.llm import brute
from tests.llm.fixtures import awkward_rows, documents, swapped_words, text, word


def shingles(text, words=5):
    w = brute.words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))}


def expected(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in rows]
    label = {d: d for d, _ in rows if d is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return [(d, len(s), None if d is None else root(d), d is None or root(d) == d) for d, s in sets]


def families(seed):
    r = random.Random(seed)
    rows = awkward_rows(seed)
    for base in range(1000, 1400, 40):
        words = text(r, r.choice([4, 6, 9, 40, 200])).split()
        for k in range(r.randint(1, 30)):
            changed = list(words)
            for _ in range(r.randint(0, 3)):
                changed[r.randrange(len(changed))] = word(r).upper()
            rows.append((base + k, " ".join(changed)))
    return rows


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(hyperminhash, "BLOCK", block)
    rows = families(4)
    got = [tuple(r) for r in hyperminhash.near_duplicates(documents(spark, rows)).collect()]
    want = expected(rows)
    assert sorted(got, key=brute.sort_key) == sorted(want, key=brute.sort_key)
    assert sum(not r[3] for r in got) > 40


def test_smallest_sets_at_the_threshold(spark):
    """Four shingles inside five are exactly 80 percent."""
    r = random.Random(6)
    rows = []
    for k in range(0, 60, 2):
        body = text(r, 9)
        rows += [(k, " ".join(body.split()[:8])), (k + 1, body)]
    got = [tuple(row) for row in hyperminhash.near_duplicates(documents(spark, rows), percent=80).collect()]
    assert sorted(got) == sorted(expected(rows, 80))
    assert sum(not row[3] for row in got) == 30


def test_empty_table(spark):
    assert hyperminhash.near_duplicates(documents(spark, [])).count() == 0


def test_estimate():
    r = np.random.default_rng(2)
    for share in (0.3, 0.85, 1.0):
        union = r.integers(0, 1 << 63, 5000).astype(np.uint64)
        common = union[: int(share * 5000)]
        half = (5000 - len(common)) // 2
        sets = [np.concatenate([common, union[len(common) :][:half]]), np.concatenate([common, union[len(common) :][half:]])]
        before = np.cumsum([0, len(sets[0]), len(sets[1])])
        registers = hyperminhash.registers_of(np.concatenate(sets), before, 192)
        sizes = np.array([len(s) for s in sets])
        found = hyperminhash.estimate(registers[:1], registers[1:], sizes[:1], sizes[1:])[0][0, 0]
        assert abs(found - share) < 4 * (share * (1 - share) / 192) ** 0.5 + 1e-6


def test_densified_registers_agree_as_often_as_the_sets_do():
    r = np.random.default_rng(3)
    for n in (8, 60, 3000):
        agree = []
        for _ in range(60):
            union = r.integers(0, 1 << 63, n).astype(np.uint64)
            sets = [union[: int(n * 0.9)], union[int(n * 0.1) :]]
            before = np.cumsum([0, len(sets[0]), len(sets[1])])
            a, b = hyperminhash.densified(hyperminhash.registers_of(np.concatenate(sets), before, 640))
            assert (a > 0).all() and (b > 0).all()
            share = len(set(sets[0].tolist()) & set(sets[1].tolist())) / n
            agree.append((a == b).mean() - share)
        assert abs(np.mean(agree)) < 0.06


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1060)]
    label = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    edges = spark.createDataFrame(pairs, "a long, b long")
    found = {r.id: r.component for r in components(edges, "test").collect()}
    assert found == {x: c for x, c in label.items() if x != c}
    left, right = (np.array(x) for x in zip(*pairs, strict=True))
    local = local_components(1100, left, right)
    assert all(local[x] == c for x, c in label.items())
    assert len(Powers().to(3)[0]) == 3


def test_words_made_to_collide(spark):
    one, other = swapped_words()
    rows = [(1, f"a b c {one} {one} d e"), (2, f"a b c {other} {other} d e")]
    found = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(documents(spark, rows)).collect()}
    assert found == {1: 1, 2: 2}
