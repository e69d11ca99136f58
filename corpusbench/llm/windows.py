"""Runs of consecutive windows that share a minimiser, and the matching of such runs over all texts.

A window is ``window`` consecutive units (words or bytes) of one text.  Its minimiser is the least
hash of the ``gram``-unit strings inside it, the leftmost of equals, so equal windows have equal
minimisers at equal places.  A run is a maximal row of windows whose minimiser stands at one place;
no two windows of one run are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbench.llm.common import Powers, mix, ranges_of, signed, sliding_min, span_hash
from corpusbench.operators.spread import spread_join

POSITIONS = 1 << 20
_PLACE = np.uint64(POSITIONS * 2 - 1)
TO_MATCH, KNOWN, TO_MATCH_KNOWN, TWIN = 0, 1, 2, 3
CROWD = 1000  # runs of one minimiser beyond which its windows go their own ways
_MOST = 0x3FFF  # windows that fit a row's number

RUN_ORDER = ("h", "f", "k1", "t1", "at")
RUN_SCHEMA = "k1 long, t1 long, h long, f long, at long"  # at: start, windows and kind in one number
MATCH_SCHEMA = "k1 long, t1 long, h long, start int, n int, kind int"


@dataclass(frozen=True)
class Shape:
    window: int
    gram: int

    @property
    def grams(self) -> int:
        return self.window - self.gram + 1


def runs(sums: np.ndarray, bounds: np.ndarray, shape: Shape, powers: Powers) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, start in the text, windows, minimiser and content hash of each run.

    ``sums`` are the prefix sums of all units, ``bounds`` the first unit of each text and the total.
    Units are taken in pieces of a million windows; a run cut by a piece's end is two runs.
    """
    units = int(bounds[-1])
    texts = np.arange(len(bounds) - 1)
    lengths = np.diff(bounds)
    last = np.repeat(bounds[1:], lengths) - shape.window  # the last window start of each unit's text
    owner = np.repeat(texts, lengths)
    for low in range(0, max(units - shape.window + 1, 0), POSITIONS):
        high = min(low + POSITIONS, units - shape.window + 1)
        at = np.arange(low, high + shape.grams - 1)
        grams = span_hash(sums, at, at + shape.gram, powers)
        packed = (grams & ~_PLACE) | (at - low).astype(np.uint64)
        least = sliding_min(packed, shape.grams)
        place = at[: high - low]
        valid = place <= last[low:high]
        if not valid.any():
            continue
        begins = valid.copy()
        begins[1:] &= (least[1:] != least[:-1]) | (owner[low + 1 : high] != owner[low : high - 1]) | ~valid[:-1]
        starts = place[begins]
        counts = np.add.reduceat(valid, np.flatnonzero(begins))
        content = span_hash(sums, starts, starts + counts + shape.window - 1, powers)
        text = owner[starts]
        yield text, starts - bounds[text], counts, mix(least[begins] & ~_PLACE), content


def distinct_rows(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """The first row of each (k1, t1) of a batch, and whether there are more of it: equal rows have equal runs."""
    k1, t1 = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("k1", "t1"))
    order = np.lexsort((t1, k1))
    new = np.ones(len(order), bool)
    new[1:] = (k1[order][1:] != k1[order][:-1]) | (t1[order][1:] != t1[order][:-1])
    if new.all():
        return batch, np.zeros(len(order), bool)
    many = np.bincount(np.cumsum(new) - 1) > 1
    first = order[new]  # the sort is stable
    places = np.argsort(first)
    return batch.take(pa.array(first[places])), many[places]


class FirstOfKey:
    """Rows that come sorted by (k1, t1): the first of each key, over all batches of a task."""

    def __init__(self):
        self.last = None

    def of(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        k1, t1 = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("k1", "t1"))
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (t1[1:] != t1[:-1])
        if len(k1):
            new[0] = (k1[0], t1[0]) != self.last
            self.last = k1[-1], t1[-1]
        return batch if new.all() else batch.filter(pa.array(new))


def run_batch(
    columns: list[tuple[np.ndarray, ...]], k1: np.ndarray, t1: np.ndarray, smaller: bool, copied: np.ndarray
) -> pa.RecordBatch | None:
    """The runs of one batch of texts, with repeats inside the batch settled before anything is shuffled.

    Of equal runs one goes on to be matched; the others are known to be repeats, as are those of texts that
    are ``copied`` in the batch, of which only one is here.  With ``smaller`` only runs of larger ids are
    repeats.  Of the equal runs of one text of the smallest id the first
    goes on, the others are its twins, whose f is a ``twin_mark``; neighbours are told as one row.
    """
    if not columns:
        return None
    text, start, n, h, f = (np.concatenate(c) for c in zip(*columns, strict=True))
    ids = k1[text]
    order = np.lexsort((ids, f)) if smaller else np.argsort(f, kind="stable")
    new = np.ones(len(f), bool)
    new[1:] = np.diff(f[order]) != 0
    group = np.cumsum(new) - 1
    if smaller:
        lead = new.copy()  # the first of each text: equal runs of one id are still in the order of their texts
        lead[1:] |= np.diff(text[order]) != 0
        kinds = np.where(ids[order] > ids[order][new][group], KNOWN, np.where(lead, TO_MATCH, TWIN))
    else:
        many = np.bincount(group) > 1
        kinds = np.where(new, np.where(many[group] | copied[text[order]], TO_MATCH_KNOWN, TO_MATCH), KNOWN)
    kind = np.empty(len(f), np.int64)
    kind[order] = kinds
    f, h = signed(f), signed(h)
    if smaller:
        model = np.empty(len(f), np.int64)
        model[order] = start[order][np.maximum.accumulate(np.where(lead, np.arange(len(f)), 0))]
        f = np.where(kind == TWIN, twin_mark(model, n), f)
        text, start, n, h, f, kind = _neighbours(text, start, n, h, f, kind)
    at = (start << 16) | (n << 2) | kind  # rows stay in the order of their texts, which compresses well
    return pa.RecordBatch.from_arrays(
        [pa.array(k1[text]), pa.array(t1[text]), pa.array(h), pa.array(f), pa.array(at)],
        ["k1", "t1", "h", "f", "at"],
    )


def twin_mark(start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Where in the same text a twin's verdict stands: ``period`` windows from ``start``, over and over."""
    return (start << 16) | period


def _neighbours(text, start, n, h, f, kind) -> tuple[np.ndarray, ...]:
    """Repeats, and twins of one model, that stand side by side in a text as one row each."""
    follows = np.zeros(len(text), bool)
    follows[1:] = (text[1:] == text[:-1]) & (start[1:] == start[:-1] + n[:-1]) & (kind[1:] == kind[:-1])
    follows[1:] &= (kind[1:] == KNOWN) | ((kind[1:] == TWIN) & (f[1:] == f[:-1]))
    first = np.flatnonzero(~follows)
    row = np.cumsum(~follows) - 1
    # No row gets more windows than its number holds: a row is cut where it would, between whole runs.
    cap = _MOST // n.max() if len(n) else 1
    heads = ~follows | ((np.arange(len(text)) - first[row]) % cap == 0)
    at = np.flatnonzero(heads)
    return text[at], start[at], np.add.reduceat(n, at), h[at], f[at], kind[at]


def spread_twins(hit: np.ndarray, start: np.ndarray, n: np.ndarray, mark: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Windows that are repeats because the one they equal is; ``hit`` says so of each place, ``base`` is a text's first.

    Twins of runs come from windows that may be twins of single windows themselves: two rounds.
    """
    to = ranges_of(base + start, n)
    step = to - np.repeat(base + start, n)
    source = np.repeat(base + (mark >> 16), n) + step % np.repeat(mark & 0xFFFF, n)
    for _ in range(2):
        hit[to] |= hit[source]
    return to[hit[to]]


def wanted_spans(found: DataFrame) -> DataFrame:
    """Runs to compare, listed by text: (start, n, h, crowded).

    A minimiser with more than CROWD different runs, such as that of a passage which very many texts
    open with words of their own, is crowded: its runs are taken apart into single windows, which
    meet by their own content instead of in one place.
    """
    runs_left = found.where(F.col("kind") == TO_MATCH).select("k1", "t1", "start", "n", "h")
    crowds = runs_left.groupBy("h").agg(F.count(F.lit(1)).alias("_runs")).where(F.col("_runs") > CROWD)
    marked = spread_join(runs_left, crowds, ["h"], "t1", how="left")
    span = F.struct("start", "n", "h", F.col("_runs").isNotNull().alias("crowded"))
    return marked.groupBy("k1", "t1").agg(F.collect_list(span).alias("spans"))


def settle_windows(
    value: np.ndarray, ids: np.ndarray, smaller: bool, text: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows of one batch, by content hash: which must travel, which are known to be repeats, and models.

    With ``smaller`` the windows that neither travel nor are known equal an earlier one of their
    ``text``, their model, which travels.  A model is the index of a window.
    """
    order = np.lexsort((ids, value)) if smaller else np.argsort(value, kind="stable")
    new = np.ones(len(value), bool)
    new[1:] = value[order][1:] != value[order][:-1]
    group = np.cumsum(new) - 1
    travels, known = np.zeros(len(value), bool), np.zeros(len(value), bool)
    model = np.arange(len(value))
    travels[order] = new
    known[order] = ids[order] > ids[order][new][group] if smaller else (np.bincount(group) > 1)[group]
    if smaller:  # texts of the smallest id all wait for what other batches have
        lead = new.copy()
        lead[1:] |= np.diff(text[order]) != 0
        model[order] = order[np.maximum.accumulate(np.where(lead, np.arange(len(value)), 0))]
        travels[order] = lead
        travels &= ~known
    return travels, known, model


def match_runs(batches: Iterator[pa.RecordBatch], smaller: bool) -> Iterator[pa.RecordBatch]:
    """Settle runs sorted by RUN_ORDER: KNOWN rows are repeats, TO_MATCH rows need their windows compared.

    TWIN rows pass with their mark as h.  Equal rows, which rows that repeat id and text give, are one; a
    run that came more than once that way is a repeat unless only ``smaller`` ids count.

    A run equal to another one is a repeat as a whole (with ``smaller``: to one of a smaller id).
    One of each set of equal runs is compared by its windows if its minimiser has other runs too.
    Between batches only three rows are held: the first of the minimiser, the first of the equal
    runs, and the last one.
    """
    names = ["k1", "t1", "h", "f", "at"]
    held: dict[str, np.ndarray] = {}
    told_repeat, told_window = np.zeros(0, bool), np.zeros(0, bool)
    settled_last: list = []

    def again(columns: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
        """Whether a row is the one before it, once more."""
        same = np.zeros(len(at), bool)
        same[1:] = at[1:] == at[:-1]
        for c in ("h", "f", "k1", "t1"):
            same[1:] &= columns[c][1:] == columns[c][:-1]
        return same

    def settle(columns: dict[str, np.ndarray], repeat_done, window_done):
        h, f, ids = columns["h"], columns["f"], columns["k1"]
        size = len(h)
        new_h = np.ones(size, bool)
        new_h[1:] = h[1:] != h[:-1]
        new_f = new_h.copy()
        new_f[1:] |= f[1:] != f[:-1]
        h_of, f_of = np.cumsum(new_h) - 1, np.cumsum(new_f) - 1
        several = (np.bincount(h_of[new_f]) > 1)[h_of]
        if smaller:
            repeat = ids > ids[new_f][f_of]
            window = (several & new_f) | (~new_f & ~repeat)
        else:
            repeat = (np.bincount(f_of) > 1)[f_of] | ((columns["at"] & 3 == TO_MATCH_KNOWN))
            window = several & new_f
        out = [repeat & ~repeat_done, window & ~window_done]
        tail = np.unique([np.flatnonzero(new_h)[-1], np.flatnonzero(new_f)[-1], size - 1])
        return out, tail, repeat | repeat_done, window | window_done

    def rows(columns, kept, kind):
        at = columns["at"][kept]
        arrays = [columns[c][kept] for c in ("k1", "t1", "h")]
        numbers = [at >> 16, (at >> 2) & 0x3FFF, np.full(len(at), kind)]
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (*arrays, *(x.astype(np.int32) for x in numbers))],
            ["k1", "t1", "h", "start", "n", "kind"],
        )

    for batch in batches:
        columns = {c: batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in names}
        kinds = columns["at"] & 3
        alone = (kinds == TWIN) | (kinds == KNOWN)
        if alone.any():
            settled = {c: v[alone] for c, v in columns.items()}
            fresh_rows = ~again(settled, settled["at"])
            ends = [[settled[c][k] for c in names] for k in (0, -1)]
            fresh_rows[0] = ends[0] != settled_last
            settled_last = ends[1]
            for kind, columns_of in ((TWIN, settled | {"h": settled["f"]}), (KNOWN, settled)):
                told = fresh_rows & (settled["at"] & 3 == kind)
                if told.any():
                    yield rows(columns_of, told, kind)
            columns = {c: v[~alone] for c, v in columns.items()}
        if not len(columns["h"]):
            continue
        if held:
            columns = {c: np.concatenate([held[c], v]) for c, v in columns.items()}
        same = again(columns, columns["at"] >> 2)
        if same.any():
            copies = np.bincount(np.cumsum(~same) - 1) > 1
            columns = {c: v[~same] for c, v in columns.items()}
            if not smaller:
                columns["at"] = np.where(copies, columns["at"] | TO_MATCH_KNOWN, columns["at"])
        fresh = len(columns["h"]) - len(told_repeat)
        repeat_done = np.concatenate([told_repeat, np.zeros(fresh, bool)])
        window_done = np.concatenate([told_window, np.zeros(fresh, bool)])
        (repeat, window), tail, repeat_done, window_done = settle(columns, repeat_done, window_done)
        if repeat.any():
            yield rows(columns, repeat, KNOWN)
        if window.any():
            yield rows(columns, window, TO_MATCH)
        held = {c: v[tail] for c, v in columns.items()}
        told_repeat, told_window = repeat_done[tail], window_done[tail]
