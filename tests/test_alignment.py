"""Many pairs side by side against one at a time, and that against the table of all cells."""

import random

import pytest

from corpusbench.functions import alignment


def table(ref, hyp):
    """(substitutions, deletions, insertions, length): equal tokens pair, then s, d, i in this order."""
    above = [(j, 0, 0, j) for j in range(len(hyp) + 1)]
    for i, r in enumerate(ref, 1):
        row = [(i, 0, i, 0)]
        for j, h in enumerate(hyp, 1):
            (a, b, c, d), (e, f, g, k), (p, q, u, v) = above[j - 1], above[j], row[j - 1]
            ways = ((a + 1, b + 1, c, d), (e + 1, f, g + 1, k), (p + 1, q, u, v + 1))
            row.append(above[j - 1] if r == h else min(ways, key=lambda x: x[0]))
        above = row
    return (*above[-1][1:], len(ref))


def noisy(r, tokens, rate, alphabet):
    out = []
    for t in tokens:
        x = r.random()
        if x < rate / 3:
            continue
        if x < 2 * rate / 3:
            out.append(r.choice(alphabet))
        out.append(t if x > rate else r.choice(alphabet))
    return out


def made(seed, many, lengths):
    r = random.Random(seed)
    pairs = []
    for k in range(many):
        alphabet = r.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyzéß😀", [f"w{n}" for n in range(400)], [(n, n) for n in range(30)]])
        a = [r.choice(alphabet) for _ in range(r.choice(lengths))]
        b = r.choice([[r.choice(alphabet) for _ in range(r.choice(lengths))], noisy(r, a, r.choice([0, 0.05, 0.2, 0.8]), alphabet)])
        pairs.append(("".join(a), "".join(b)) if isinstance(alphabet, str) else (a, b))
    return pairs


@pytest.mark.parametrize("seed", range(6))
def test_short_pairs_against_the_table(seed):
    pairs = made(seed, 60, [0, 1, 2, 9, 40])
    assert [tuple(x) for x in alignment.align_many(pairs)] == [table(*p) for p in pairs] == [alignment.align(*p) for p in pairs]


def test_bands_that_are_too_narrow_are_widened(monkeypatch):
    monkeypatch.setattr(alignment, "_FEWEST", 1)
    pairs = made(11, 40, [150, 300]) + [("a" * 150 + "b" * 200, "b" * 200 + "a" * 150), ("ab" * 200, "b" * 300), ("x" * 700, "y")]
    assert [tuple(x) for x in alignment.align_many(pairs)] == [table(*p) for p in pairs] == [alignment.align(*p) for p in pairs]


def test_long_pairs_keep_few_columns(monkeypatch):
    pairs = made(12, 12, [300, 500])
    whole = [alignment.align(*p) for p in pairs]
    monkeypatch.setattr(alignment, "_KEPT_BITS", 0)
    assert [alignment.align(*p) for p in pairs] == whole
    monkeypatch.setattr(alignment, "_BATCH_BYTES", 1 << 14)
    assert [tuple(x) for x in alignment.align_many(pairs)] == whole == [table(*p) for p in pairs]


def test_a_batch_holds_few_tokens_at_a_time(monkeypatch):
    sizes = []
    whole = alignment.align_many
    monkeypatch.setattr(alignment, "_HELD", 1 << 12)
    monkeypatch.setattr(alignment, "align_many", lambda pairs: sizes.append(sum(len(x) for p in pairs for x in p)) or whole(pairs))
    pairs = [*made(13, 300, [0, 2, 9]), (None, "ab"), ("ab", None)]
    told = alignment._frame(iter(pairs))
    assert [tuple(x) for x in told[:-2].itertuples(index=False)] == [alignment.align(*p) for p in pairs[:-2]]
    assert told[-2:].isna().all(axis=None)
    assert len(sizes) > 10 and max(sizes) < 1 << 12


@pytest.mark.parametrize("followed, phase, wide", [(0, 8, 64), (20, 40, 4096), (200, 4096, 300)])
def test_phases_and_bands_that_follow(monkeypatch, followed, phase, wide):
    monkeypatch.setattr(alignment, "_FEWEST", 1)
    monkeypatch.setattr(alignment, "_FOLLOWED", followed)
    monkeypatch.setattr(alignment, "_PHASE", phase)
    monkeypatch.setattr(alignment, "_WIDE", wide)
    pairs = made(14, 24, [0, 40, 150, 300])
    pairs += [("ab" * 150, "b" * 200), ("a" * 150 + "b" * 150, "b" * 150 + "a" * 150), ("é😀" * 90 + "q" * 90, "q" * 90 + "é" * 90)]
    assert [tuple(x) for x in alignment.align_many(pairs)] == [table(*p) for p in pairs]


def test_diagonals_out_of_reach_are_dropped(monkeypatch):
    r = random.Random(15)
    pairs = []
    for _ in range(5):
        a = [r.choice("abcdefghijklmnopqrst") for _ in range(6000)]
        pairs.append(("".join(a), "".join(noisy(r, a, 0.2, "abcdefghijklmnopqrst"))))
    cells = []
    whole = alignment._Batch.sweep

    def sweep(self, which, state, begin, end, *options, **named):
        cells.append(int((end - begin).max()) * state.plus.size)
        return whole(self, which, state, begin, end, *options, **named)

    monkeypatch.setattr(alignment._Batch, "sweep", sweep)
    told = alignment.align_many(pairs)
    assert [tuple(x) for x in told] == [alignment.align(*p) for p in pairs]
    band = sum(len(h) * (sum(x[:3]) + 1) for (_, h), x in zip(pairs, told))  # all diagonals that such a path can touch
    assert sum(cells) < 0.9 * band
