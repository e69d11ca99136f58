"""Exact substitution, deletion and insertion counts of a minimum edit alignment.

Several alignments can reach the minimum distance.  Walking back from the ends, equal tokens always
pair; otherwise a substitution is preferred to a deletion and a deletion to an insertion.

``edit_counts`` is the form to use: an Arrow UDF over whole batches.  A column of the distance table is
kept as bits of whole numbers, as far as a band around the diagonal goes; many pairs share one number and
a long pair has its own (``align_many``).  ``align`` takes one pair and walks back in blocks.  Pairs too long for one task are cut into tiles (``operators/long_pairs.py``).  ``native_edit_counts`` is a UDF-free form
for short token lists and for cross-checks.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence
from math import isqrt

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusbench.functions.text import normalize_text

_BANDED_ROWS = 128  # a table of fewer rows is no larger than its band
_KEPT_BITS = 1 << 26
_BATCH_BYTES = 1 << 26  # what a batch of lanes may keep of its columns
_LANES = 1 << 15  # bits of all lanes beyond which more of them save nothing
_WIDE = 1536  # bits of a lane that is worth a number of its own
_FEWEST = 4  # pairs that are worth a batch
_FOLLOWED = 1 << 11  # tokens of a pair beyond which its cost is sought first
_PHASES, _PHASE = 12, 1 << 12  # parts of a table, and columns that one has at most
_TOKEN, _HELD = 64, 1 << 24  # bytes of a token of its own, and of what a batch holds as tokens at a time
COUNTS = T.StructType([T.StructField(name, T.LongType()) for name in ("s", "d", "i", "n")])


def align(reference: Sequence[Hashable], hypothesis: Sequence[Hashable]) -> tuple[int, int, int, int]:
    """(substitutions, deletions, insertions, reference length) of one pair."""
    ref, hyp = _differing(reference, hypothesis)
    if not ref or not hyp:
        return 0, len(ref), len(hyp), len(reference)
    return (*_trace(ref, hyp), len(reference))


def _trace(ref: Sequence[Hashable], hyp: Sequence[Hashable]) -> tuple[int, int, int]:
    """Counts of the differing middle.

    Pairs are aligned in a window around the diagonal.  A path of cost c strays at most
    (c + length difference) / 2 from it, so a window that wide holds every path as good as the one
    found and the counts are exact; else the window is widened to what that path asks for.
    """
    rows, apart = len(ref), abs(len(ref) - len(hyp))
    half = apart + max(rows, len(hyp)) // 10 + 16
    while rows > _BANDED_ROWS and 2 * half + 1 < rows:
        needed, counts = _trace_window(ref, hyp, 2 * half + 1)
        if counts is not None:
            return counts
        half = needed
    return _trace_window(ref, hyp, rows)[1]


def _trace_window(
    ref: Sequence[Hashable], hyp: Sequence[Hashable], width: int
) -> tuple[int, tuple[int, int, int] | None]:
    """(half width needed, counts): a shortest path in a window of ``width`` rows, if wide enough."""
    rows, last = len(ref), len(hyp)
    full, half, lowest = (1 << width) - 1, (width - 1) // 2, rows - width
    where: dict[Hashable, int] = {}
    for index, token in enumerate(ref):
        where[token] = where.get(token, 0) | (1 << index)

    def base(column: int) -> int:
        """Rows above the window at a column."""
        return min(max(0, column - half - 1), lowest)

    def columns(first: int, stop: int, plus: int, minus: int) -> Iterator[tuple[int, int, int, int]]:
        """Per hypothesis token: matches, cells equal to their diagonal neighbour, vertical steps."""
        origin = top = base(first)
        reach, new = (1 << (width + stop - first)) - 1, 1 << (width - 1)
        near: dict[Hashable, int] = {}
        for column in range(first, stop):
            token = hyp[column]
            if token not in near:
                near[token] = (where.get(token, 0) >> origin) & reach
            if top < column - half and top < lowest:
                top += 1
                plus, minus = (plus >> 1) | new, minus >> 1
            match = (near[token] >> (top - origin)) & full
            equal = ((((match & plus) + plus) ^ plus) | match | minus) & full
            right_up = (((minus | (full & ~(equal | plus))) << 1) | 1) & full
            minus = right_up & equal
            plus = (((plus & equal) << 1) & full) | (full & ~(equal | right_up))
            yield match, equal, plus, minus

    # Tables of moderate size keep every column; larger ones keep some, and the rest is computed again block by block.
    whole, every = width == rows, width * last <= _KEPT_BITS
    size = max(64, isqrt(last))
    states, kept = [(full, 0)], []
    above = 0  # distance in the row above the window
    plus, minus = full, 0
    for first in range(0, last, size):
        below = base(first)
        for column, step in enumerate(columns(first, min(first + size, last), plus, minus), first + 1):
            if column - half - 1 > below and below < lowest:
                below += 1
                above += (plus & 1) - (minus & 1)
            above += 1
            plus, minus = step[2], step[3]
            if every:
                kept.append(step)
        states.append((plus, minus))
    states.pop()
    distance = above + plus.bit_count() - minus.bit_count()
    needed = (distance + abs(rows - last)) // 2 + 1
    if not whole and needed > half:
        return needed, None

    row, column = rows, last
    s = d = i = 0
    for block in range(len(states) - 1, -1, -1):
        if row == 0:
            break
        first = block * size
        start = 0 if every else first
        if not every:
            kept = list(columns(first, min(first + size, last), *states[block]))
        while row and column > first:
            match, equal, plus, _ = kept[column - start - 1]
            bit = row - 1 - base(column)
            if match >> bit & 1:
                row, column = row - 1, column - 1
            elif not equal >> bit & 1:
                s, row, column = s + 1, row - 1, column - 1
            elif plus >> bit & 1:
                d, row = d + 1, row - 1
            else:
                i, column = i + 1, column - 1
    return needed, (s, d + row, i + column)


# ---------------------------------------------------------------- many pairs side by side


def align_many(pairs: Sequence[tuple[Sequence[Hashable], Sequence[Hashable]]]) -> list[tuple[int, int, int, int]]:
    """``align`` of every pair.

    What differs of each pair is aligned in the band of diagonals that a path of some cost can reach, many
    bands side by side in one whole number, and a very wide band alone.  That cost comes from the length, or
    for long pairs from a first run in a narrow band that follows the best cells.  A run is cut into phases;
    after each, diagonals are dropped from which the end is no longer in reach at that cost.  If the path found costs
    no more, every path as good lay in the band; else the run is made again at the cost found.
    """
    results: list[tuple[int, int, int, int] | None] = [None] * len(pairs)
    waiting: dict[bool, list[_Lane]] = {}

    def queue(lane: _Lane) -> None:
        waiting.setdefault(lane.bound is None, []).append(lane)

    for k, (reference, hypothesis) in enumerate(pairs):
        ref, hyp = _differing(reference, hypothesis)
        if not ref or not hyp:
            results[k] = 0, len(ref), len(hyp), len(reference)
        else:
            longest = max(len(ref), len(hyp))
            queue(_Lane(k, ref, hyp, None if longest > _FOLLOWED else abs(len(ref) - len(hyp)) + longest // 5 + 16))
    while waiting:
        follows = max(waiting)
        own = sorted(waiting.pop(follows), key=lambda x: (-x.width(), -len(x.hyp)))
        while own:
            part, own = _part(own)
            if len(part) < _FEWEST and not follows and max(len(x.hyp) for x in part) <= _BANDED_ROWS:
                for x in part:
                    results[x.name] = (*_trace(x.ref, x.hyp), len(pairs[x.name][0]))
                continue
            batch = _Batch(part)
            costs = batch.run()
            exact = np.array([x.bound is not None and cost <= x.bound for x, cost in zip(part, costs.tolist(), strict=True)])
            counts = batch.counts(exact, costs)
            for k, x in enumerate(part):
                if exact[k]:
                    results[x.name] = (*counts[k], len(pairs[x.name][0]))
                else:
                    x.bound = int(costs[k])
                    queue(x)
    return results


def first_bounds(pairs: Sequence[tuple[Sequence[Hashable], Sequence[Hashable]]]) -> list[int]:
    """What each pair costs at most: the cost of a path in a narrow band that follows the best cells."""
    bounds = [0] * len(pairs)
    lanes = []
    for k, (reference, hypothesis) in enumerate(pairs):
        ref, hyp = _differing(reference, hypothesis)
        if not ref or not hyp:
            bounds[k] = max(len(ref), len(hyp))
        else:
            lanes.append(_Lane(k, ref, hyp, None))
    lanes.sort(key=lambda x: (-x.width(), -len(x.hyp)))
    while lanes:
        part, lanes = _part(lanes)
        for x, cost in zip(part, _Batch(part).run().tolist(), strict=True):
            bounds[x.name] = cost
    return bounds


class _Lane:
    """A pair that waits: without a ``bound`` of its cost, a narrow band is to find one."""

    def __init__(self, name: int, ref: Sequence[Hashable], hyp: Sequence[Hashable], bound: int | None) -> None:
        self.name, self.ref, self.hyp, self.bound = name, ref, hyp, bound

    def width(self) -> int:
        """Diagonals of the band: those that a path of cost ``bound`` can touch."""
        return (64 + 2 * isqrt(max(len(self.ref), len(self.hyp)))) if self.bound is None else self.bound + 1


def _phases(columns: int) -> int:
    return max(1, min(_PHASES, columns // 96), columns // _PHASE)


def _part(own: list[_Lane]) -> tuple[list[_Lane], list[_Lane]]:
    """The next pairs for one batch, and the others: as many as fit side by side, of like size once there are some."""
    widest, columns = own[0].width() + 9, len(own[0].hyp)
    if widest > _WIDE:
        return own[:1], own[1:]
    many = max(1, min(_LANES // widest, 4 * _BATCH_BYTES * _phases(columns) // (widest * columns)))
    part, others = [own[0]], []
    for k, x in enumerate(own[1:], 1):
        share = 0.75 if len(part) * widest > _LANES // 4 else 0.4
        if len(part) >= many or x.width() < share * widest:
            others.extend(own[k:])
            break
        (part if share * columns <= len(x.hyp) <= 1.3 * columns else others).append(x)
    return part, others


def _differing(ref: Sequence[Hashable], hyp: Sequence[Hashable]) -> tuple[Sequence[Hashable], Sequence[Hashable]]:
    """Both sides without the tokens in which their beginnings, and then their ends, agree."""
    m, n, start = len(ref), len(hyp), 0
    while start < m and start < n and ref[start] == hyp[start]:
        start += 1
    while m > start and n > start and ref[m - 1] == hyp[n - 1]:
        m, n = m - 1, n - 1
    return ref[start:m], hyp[start:n]


def _coded(sides: list[Sequence[Hashable]]) -> tuple[list[np.ndarray], int]:
    """Sides as arrays of small numbers, and a number that no token has."""
    if all(isinstance(side, str) for side in sides):
        arrays = [np.frombuffer(side.encode("utf-32-le", "surrogatepass"), np.uint32) for side in sides]
        seen = np.zeros(1 + max(int(x.max()) for x in arrays), bool)
        for x in arrays:
            seen[x] = True
        used = np.flatnonzero(seen)
        codes = np.zeros(len(seen), np.uint8 if len(used) < 255 else np.int32)
        codes[used] = np.arange(len(used))
        return [codes[x] for x in arrays], len(used)
    known: dict[Hashable, int] = {}
    lists = [[known.setdefault(t, len(known)) for t in side] for side in sides]
    return [np.array(x, np.uint8 if len(known) < 255 else np.int32) for x in lists], len(known)


class _State:
    """A column of the table of every lane, on a band of diagonals (row - column).

    ``top`` is the distance on the first diagonal, ``low``; then ``plus`` and ``minus`` tell, per further
    diagonal, whether the distance is one more or less than on the one before.
    """

    def __init__(self, low: np.ndarray, top: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> None:
        self.low, self.top, self.plus, self.minus = low, top, plus, minus

    def distances(self) -> np.ndarray:
        steps = np.zeros((len(self.top), self.plus.shape[1] + 1), np.int32)
        np.subtract(self.plus, self.minus, out=steps[:, 1:], dtype=np.int32, casting="unsafe")
        steps[:, 0] = self.top
        return np.cumsum(steps, axis=1, dtype=np.int32)

    def banded(self, first: np.ndarray, last: np.ndarray, distances: np.ndarray) -> _State:
        """On the diagonals from ``first`` to ``last`` of each lane; those not held yet cost a step from their neighbour."""
        width = _rounded(int((last - first).max()) + 1)
        begin, held = (first - self.low)[:, None], self.plus.shape[1]
        place = begin + np.arange(width)
        inside, at = (place >= 0) & (place < held), np.clip(place, 0, held - 1)
        plus = np.where(inside, np.take_along_axis(self.plus, at, 1), (place >= held).astype(np.uint8))
        minus = np.where(inside, np.take_along_axis(self.minus, at, 1), (place < 0).astype(np.uint8))
        near = np.clip(begin, 0, held)
        top = np.take_along_axis(distances, near, 1) + abs(begin - near)
        return _State(first, top[:, 0], plus, minus)


def _rounded(width: int) -> int:
    """Bits of a lane but one, with which it has whole bytes; four at least, for they count columns as well."""
    return max(32, (width + 8) // 8 * 8) - 1


class _Pool:
    """Where each token stands in each reference, as bits from any row on: bytes for each of eight shifts.

    A row of bytes has ``margin`` zeros before and after the reference, as many as the widest band has diagonals.
    """

    def __init__(self, refs: list[np.ndarray], tokens: int, margin: int) -> None:
        self.margin, self.tokens = margin // 8 * 8 + 8, tokens
        self.rows = np.array([len(x) for x in refs])
        self.row = (self.rows + 7) // 8 + self.margin // 4 + 2
        starts = np.concatenate([[0], np.cumsum(8 * tokens * self.row)])
        self.start, self.all = starts[:-1], int(starts[-1])
        self.data = np.full(self.all + self.margin, 255, np.uint8)
        for ref, row, start in zip(refs, self.row.tolist(), self.start.tolist(), strict=True):
            own = self.data[start : start + 8 * tokens * row].reshape(8, tokens, row)
            stands = np.zeros((tokens, 8 * row), bool)
            stands[ref, self.margin + np.arange(len(ref))] = True
            own[0] = np.packbits(stands, axis=1, bitorder="little")
            for shift in range(1, 8):
                own[shift] = own[0] << shift
                own[shift, :, 1:] |= own[0, :, :-1] >> (8 - shift)

    def places(self, which: np.ndarray, first: np.ndarray, steps: np.ndarray, told: np.ndarray) -> np.ndarray:
        """Per column and lane, where the bits of the token told begin; bits that are all set after its last column."""
        column = np.arange(len(told))[:, None]
        bit = np.clip(first + column, -self.margin, self.rows[which]) + self.margin
        shift = -bit % 8
        at = self.start[which] + (shift * self.tokens + np.minimum(told, self.tokens - 1)) * self.row[which] + (bit + shift) // 8
        return np.where(column < steps, at, self.all)


class _Batch:
    """Pairs aligned side by side, phase by phase.  All have come through the same share of their columns after a phase."""

    def __init__(self, lanes: list[_Lane]) -> None:
        self.lanes = lanes
        coded, self.none = _coded([side for x in lanes for side in (x.ref, x.hyp)])
        self.refs, self.hyps = coded[::2], coded[1::2]
        self.rows = np.array([len(x) for x in self.refs])
        self.columns = np.array([len(x) for x in self.hyps])
        most = int(self.columns.max())
        # a band that follows is put around the best cells again before they can have left it
        phases = _phases(most) if lanes[0].bound is not None else max(1, most // max(96, lanes[0].width()))
        self.ends = [self.columns * p // phases for p in range(phases + 1)]
        widest = _rounded(max(x.width() for x in lanes)) + 17
        small = self.none * (self.rows + 2 * widest).sum() <= _BATCH_BYTES
        self.pool = _Pool(self.refs, self.none, widest) if small and len(lanes) > 1 else None
        # a number of its own is kept as it is, which costs no time
        spared = len(lanes) == 1 and int(self.columns[0]) * widest <= 4 * _BATCH_BYTES and lanes[0].bound is not None
        self.kept: list[list[tuple[int, int]]] | None = [] if spared else None
        self.states: list[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]] = []

    def run(self) -> np.ndarray:
        """Costs of the paths found."""
        apart = self.rows - self.columns
        follows = self.lanes[0].bound is None
        width = np.array([x.width() for x in self.lanes])
        cost = width - 1
        # a path of this cost strays no further; a band that follows begins around the first diagonal
        first = -(width // 2) if follows else -((cost - apart) // 2)
        last = first + width - 1 if follows else (cost + apart) // 2
        bits = _rounded(int((last - first).max()) + 1)
        above = first[:, None] + 1 + np.arange(bits) <= 0  # rows above the table's first
        state = _State(first, abs(first), (~above).astype(np.uint8), above.astype(np.uint8))
        for begin, end in zip(self.ends[:-1], self.ends[1:], strict=True):
            if not follows:
                self.states.append((state.low, state.top, state.plus.shape[1], *(np.packbits(x, axis=1) for x in (state.plus, state.minus))))
            kept = None
            if self.kept is not None:
                self.kept.append(kept := [])
            state = self.sweep(np.arange(len(self.lanes)), state, begin, end, kept, whole=True)
            distances = state.distances()
            diagonals = state.low[:, None] + np.arange(distances.shape[1])
            if end is self.ends[-1]:
                break
            best = distances.argmin(1)
            if follows:
                first = state.low + best - width // 2
                last = first + width - 1
            else:
                near = distances + abs(apart[:, None] - diagonals) <= cost[:, None]
                some = near.any(1)
                first = state.low + np.where(some, near.argmax(1), best)
                last = state.low + np.where(some, distances.shape[1] - 1 - near[:, ::-1].argmax(1), best)
            state = state.banded(first, last, distances)
        # a band that was lost the end of costs what is left to it
        place = np.clip(apart - state.low, 0, distances.shape[1] - 1)
        left = abs(apart - state.low - place)
        return (distances[np.arange(len(place)), place] + left).astype(np.int64)

    def sweep(
        self, which: np.ndarray, state: _State, begin: np.ndarray, end: np.ndarray, kept: list | None = None, whole: bool = False
    ) -> _State:
        """The state after the columns from ``begin`` to ``end`` of some lanes, and per column what equals its
        diagonal neighbour, and the vertical steps, if ``kept``: as bytes, or ``whole`` numbers.

        A lane is the bits of its diagonals and, on top, one that takes what an addition carries over.  A lane that has
        come to its end is carried on over columns that match everywhere, which leave all but its last bit as it is.
        """
        lanes, width = state.plus.shape
        size, steps = (width + 1) // 8, end - begin
        most, fewest = int(steps.max()), int(steps.min())
        kind = self.refs[0].dtype
        alone = lanes == 1
        pooled = self.pool is not None and not alone
        hyp = np.full((most, lanes, 1), self.none, kind)
        for x, k in enumerate(which.tolist()):
            hyp[: steps[x], x, 0] = self.hyps[k][begin[x] : end[x]]
        told = hyp[:, 0, 0].tolist() if alone else []
        many = max(1, (1 << 18) // (size * lanes))  # columns whose matches are taken at a time
        if pooled:
            place = self.pool.places(which, begin + state.low, steps, hyp[:, :, 0])
            matches = sliding_window_view(self.pool.data, size)
        else:
            ref = np.full((lanes, most + width), self.none, kind)
            for x, (k, a) in enumerate(zip(which.tolist(), (begin + state.low).tolist(), strict=True)):
                seen = self.refs[k][max(0, a) : max(0, a + most + width)]
                ref[x, max(0, -a) : max(0, -a) + len(seen)] = seen
        unit = int.from_bytes(([1] + [0] * (size - 1)) * lanes, "little")  # the lowest bit of every lane
        full = unit * ((1 << width) - 1)
        same = np.zeros((lanes, width + 1), bool)
        shown = same[:, :width]
        if alone:
            where = {t: _number(ref[0] == t) for t in np.unique(hyp[:, 0, 0]).tolist()}

        def packed(bits: np.ndarray) -> int:
            shown[...] = bits
            return _number(same)

        plus, minus, tops = packed(state.plus), packed(state.minus), 0
        for j in range(most):
            if alone:
                match = (where[told[j]] >> j) & full
            elif pooled:
                if j % many == 0:
                    taken, at = matches[place[j : j + many]].tobytes(), 0
                match = int.from_bytes(taken[at : at + size * lanes], "little")
                at += size * lanes
            else:
                np.equal(ref[:, j : j + width], hyp[j], out=shown)
                if j >= fewest:
                    shown[steps <= j] = True
                match = int.from_bytes(np.packbits(same, bitorder="little").tobytes(), "little")
            equal = ((((match & plus) + plus) ^ plus) | match | minus) & full
            right_up = minus | (full ^ (equal | plus))
            below = (equal >> 1) & full
            plus = (plus & equal) | (full ^ (below | right_up))
            minus = below & right_up
            tops += equal & unit
            if whole:
                if kept is not None:
                    kept.append((equal, plus))
            elif kept is not None:
                kept.append((equal.to_bytes(size * lanes, "little"), plus.to_bytes(size * lanes, "little")))

        def rows(number: int) -> np.ndarray:
            return np.frombuffer(number.to_bytes(size * lanes, "little"), np.uint8).reshape(lanes, size)

        def bits(number: int) -> np.ndarray:
            return np.unpackbits(rows(number), axis=1, count=width, bitorder="little")

        unlike = most - rows(tops)[:, :4].copy().view("<u4")[:, 0].astype(np.int64)
        return _State(state.low, state.top + unlike, bits(plus), bits(minus))

    def counts(self, exact: np.ndarray, costs: np.ndarray) -> list[tuple[int, int, int]]:
        """Substitutions, deletions and insertions of lanes whose costs are exact, from their ends back, phase by phase.

        A phase is run again on the diagonals only that the path can take in it, and its columns are kept this time.
        """
        told = np.zeros((len(self.lanes), 3), np.int64)
        row, costs, which = self.rows.copy(), costs.copy(), np.flatnonzero(exact)
        for begin, end, held in zip(self.ends[-2::-1], self.ends[:0:-1], self.states[::-1]):
            which = which[row[which] > 0]
            if not len(which):
                break
            if self.kept is not None:
                *steps, row[0] = _walk_back(self.refs[0], self.hyps[0], self.kept.pop(), None, int(begin[0]), int(end[0]), int(row[0]), int(held[0][0]))
                told[0] += steps
                continue
            low, top, width = held[0][which], held[1][which], held[2]
            state = _State(low, top, *(np.unpackbits(x[which], axis=1, count=width) for x in held[3:]))
            distances = state.distances()
            diagonals = low[:, None] + np.arange(width + 1)
            at = (row - end)[which, None]
            spare = costs[which, None] - distances - abs(diagonals - at)
            can = spare >= 0
            first = np.where(can, np.minimum(diagonals, at) - spare // 2, at).min(1)
            last = np.where(can, np.maximum(diagonals, at) + spare // 2, at).max(1)
            first, last = np.maximum(first, low), np.minimum(last, low + width)
            state = state.banded(first, last, distances)
            kept: list[tuple[bytes, bytes]] = []
            self.sweep(which, state, begin[which], end[which], kept)
            size = (state.plus.shape[1] + 1) // 8
            for x, k in enumerate(which.tolist()):
                *steps, row[k] = _walk_back(
                    self.refs[k], self.hyps[k], kept, x * size, int(begin[k]), int(end[k]), int(row[k]), int(first[x])
                )
                told[k] += steps
                costs[k] -= sum(steps)
        told[:, 1] += row
        return [tuple(x) for x in told.tolist()]


def _walk_back(
    ref: np.ndarray, hyp: np.ndarray, kept: list, lane: int | None, start: int, stop: int, row: int, low: int
) -> tuple[int, int, int, int]:
    """Counts from a row at column ``stop`` back to column ``start``, and the row there; to the very beginning from row 0.

    ``kept`` holds numbers, or bytes of which those of a lane begin at ``lane``.
    """
    place, column, base = row - stop - low, stop, max(0, min(row, start + low) - 1)
    before, heard = ref[base:row].tolist(), hyp[start:stop].tolist()
    s = d = i = 0

    def told(bits: int | bytes, place: int) -> int:
        return bits >> place & 1 if lane is None else bits[lane + (place >> 3)] >> (place & 7) & 1

    while row and column > start:
        if before[row - base - 1] == heard[column - start - 1]:
            row, column = row - 1, column - 1
            continue
        equal, plus = kept[column - start - 1]
        if not told(equal, place):
            s, row, column = s + 1, row - 1, column - 1
        elif place and told(plus, place - 1):
            d, row, place = d + 1, row - 1, place - 1
        else:
            i, column, place = i + 1, column - 1, place + 1
    return (s, d, i, row) if row else (s, d, i + column, 0)


def _number(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _settled(pairs: Iterator[tuple[object, object]], of_part: Callable[[list], list], none: object) -> list:
    """What ``of_part`` tells of a batch of pairs, of which only so many are held as tokens at a time."""
    rows: list = []
    part: list[tuple] = []
    held = 0

    def settle() -> None:
        known = iter(of_part([(a, b) for a, b in part if a is not None and b is not None]))
        rows.extend(none if a is None or b is None else next(known) for a, b in part)

    for pair in pairs:
        part.append(pair)
        held += sum(len(side) * (1 if isinstance(side, str) else _TOKEN) for side in pair if side is not None)
        if held > _HELD:
            settle()
            part, held = [], 0
    settle()
    return rows


def _frame(pairs: Iterator[tuple[object, object]]) -> pd.DataFrame:
    rows = _settled(pairs, align_many, (None,) * 4)
    return pd.DataFrame(rows, columns=["s", "d", "i", "n"]).astype("Int64")


def _tokens(values: object) -> Sequence[str] | None:
    return values if values is None or isinstance(values, str) else list(values)


@F.pandas_udf(COUNTS)
def _word_counts(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    def words(text: str | None) -> list[str] | None:
        return None if text is None else text.split()

    return _frame((words(a), words(b)) for a, b in zip(reference, hypothesis))


@F.pandas_udf(COUNTS)
def _character_counts(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    def characters(text: str | None) -> str | None:
        return None if text is None else text.replace(" ", "")

    return _frame((characters(a), characters(b)) for a, b in zip(reference, hypothesis))


@F.pandas_udf(COUNTS)
def edit_counts(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Counts for two token arrays, or for the characters of two texts, spaces included."""
    return _frame((_tokens(a), _tokens(b)) for a, b in zip(reference, hypothesis))


@F.pandas_udf(T.LongType())
def cost_bound(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """``first_bounds`` of two token arrays, or of the characters of two texts."""
    pairs = ((_tokens(a), _tokens(b)) for a, b in zip(reference, hypothesis))
    return pd.Series(_settled(pairs, first_bounds, None), dtype="Int64")


def word_edit_counts(reference: Column, hypothesis: Column) -> Column:
    """Counts over the words of two normalized texts."""
    return _word_counts(reference, hypothesis)


def character_edit_counts(reference: Column, hypothesis: Column) -> Column:
    """Counts over the characters of two normalized texts, spaces excluded."""
    return _character_counts(reference, hypothesis)


def native_edit_counts(reference: Column, hypothesis: Column) -> Column:
    """The same counts for two short token arrays with built-in higher-order functions only.

    Pass plain columns: an expression here would be evaluated again for every cell.
    """
    cell = "struct<dist:bigint,s:bigint>"

    def make(dist: Column, s: Column) -> Column:
        return F.struct(dist.cast("bigint").alias("dist"), s.cast("bigint").alias("s"))

    width = F.size(hypothesis)
    first = F.transform(F.sequence(F.lit(0), width), lambda j: make(j, F.lit(0)))

    def next_row(above: Column, token: Column) -> Column:
        def extend(row: Column, j: Column) -> Column:
            diagonal, up, left = F.get(above, j - 1), F.get(above, j), F.get(row, j - 1)
            dist = F.least(diagonal["dist"], up["dist"], left["dist"]) + 1
            s = (
                F.when(diagonal["dist"] + 1 == dist, diagonal["s"] + 1)
                .when(up["dist"] + 1 == dist, up["s"])
                .otherwise(left["s"])
            )
            value = F.when(token == F.get(hypothesis, j - 1), diagonal).otherwise(make(dist, s))
            return F.concat(row, F.array(value.cast(cell)))

        head = F.array(make(F.get(above, F.lit(0))["dist"] + 1, F.lit(0)))
        steps = F.when(width > 0, F.sequence(F.lit(1), width)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, head, extend)

    corner = F.element_at(F.aggregate(reference, first, next_row), -1)
    n, m = F.size(reference).cast("bigint"), width.cast("bigint")
    # insertions - deletions is fixed by the lengths, so (distance, substitutions) settles both
    unpaired = corner["dist"] - corner["s"]
    d = ((unpaired + n - m) / 2).cast("bigint")
    i = ((unpaired - n + m) / 2).cast("bigint")
    return F.struct(corner["s"].alias("s"), d.alias("d"), i.alias("i"), n.alias("n"))


def utterance_score(reference: Column, hypothesis: Column) -> Column:
    """Normalized texts with word and character counts of one utterance."""
    ref, hyp = normalize_text(reference), normalize_text(hypothesis)
    return F.struct(
        ref.alias("normalized_reference"),
        hyp.alias("normalized_hypothesis"),
        word_edit_counts(ref, hyp).alias("words"),
        character_edit_counts(ref, hyp).alias("characters"),
    )


def error_rate(counts: Column) -> Column:
    """(substitutions + deletions + insertions) / reference length; NULL for an empty reference."""
    return F.try_divide(
        (counts["s"] + counts["d"] + counts["i"]).cast("double"), counts["n"].cast("double")
    )

