"""Packing token sequences into windows by a non-negative least-squares plan over their lengths."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbench.llm.common import gapless_rank, stage_table, text_blocks, without_nulls
from corpusbench.llm.tokens import FragmentEncoder, pairs_inside, white_space_cuts

WINDOW, END_ID, UNITS = 4096, 2, 256
_BLOCK = 4 << 20
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack_documents(
    documents: DataFrame, definition: str, *, window: int = WINDOW, end_id: int = END_ID,
    with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``window`` tokens.

    A document is its ids and ``end_id``; it is cut into whole windows and a rest.  The histogram of
    lengths, at most ``window`` numbers, goes to the driver, which plans how often each combination
    of lengths is used.  Each piece finds its place from its rank among the pieces of its length.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.
    Null texts count as empty and become one piece of one token; null ids and repeated rows are
    packed like others; an empty table gives no pieces.
    """
    chosen = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    cut = chosen.mapInArrow(lambda it: _pieces(it, definition, window, end_id, with_ids), schema)
    pieces = stage_table(cut, "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(plan(histogram, window))
    ranked = gapless_rank(pieces, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], "rank")
    wide = f"{schema}, rank long, sequence_id long, offset long"
    columns = [*pieces.columns[:5], "sequence_id", "offset", *pieces.columns[5:]]
    ordered = ranked.select(*pieces.columns, "rank")
    return ordered.mapInArrow(lambda it: _place(it, table), wide).select(*columns)


def _pieces(
    batches: Iterator[pa.RecordBatch], definition: str, window: int, end_id: int, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    encoder = FragmentEncoder(definition)
    inside = pairs_inside([t["content"].encode() for t in json.loads(definition)["added_tokens"]])
    for batch in batches:
        names = batch.column(0).to_pylist()
        for first, raw, offsets in text_blocks(without_nulls(batch, "text"), _BLOCK):
            cuts = white_space_cuts(raw, offsets, inside)
            ids, before = encoder.encode(raw, cuts)
            bounds = before[np.searchsorted(cuts, offsets)]
            rows = []
            for k in range(len(offsets) - 1):
                own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                for start in range(0, len(own), window):
                    piece = own[start : start + window]
                    row = (names[first + k], start, len(piece), zlib.crc32(piece.tobytes()), len(own))
                    rows.append((*row, piece.view(np.int32)) if with_ids else row)
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
            fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays.append(pa.array(columns[5], pa.list_(pa.int32())))
                fields.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, fields)


# ---------------------------------------------------------------- plan


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how often each is used; together they use up the histogram.

    The work depends on the window alone, not on the number of pieces: combinations of up to three
    lengths in units of window / 256 that fill the window are fitted to the histogram by
    non-negative least squares, their counts rounded down, and what is left is packed greedily.
    """
    left = Counter({n: c for n, c in histogram.items() if c})
    unit = -(-window // UNITS)
    bins: dict[int, list[int]] = {}
    for length in sorted(left):
        bins.setdefault(-(-length // unit), []).append(length)
    out: list[tuple[tuple[int, ...], int]] = []
    shapes = _shapes(sorted(bins), -(-window // unit))
    if shapes:
        matrix = np.zeros((len(bins), len(shapes)))
        row = {b: k for k, b in enumerate(sorted(bins))}
        for k, shape in enumerate(shapes):
            for b in shape:
                matrix[row[b], k] += 1
        target = np.array([sum(left[n] for n in bins[b]) for b in sorted(bins)], float)
        counts = np.floor(least_squares(matrix, target) + 1e-9).astype(int)
        for k in np.argsort(-counts, kind="stable"):
            if counts[k] <= 0:
                break
            _use(shapes[k], int(counts[k]), bins, left, window, out)
    _greedy(left, window, out)
    return out


def _shapes(units: list[int], full: int) -> list[tuple[int, ...]]:
    """Combinations of up to three of the given sizes that sum to the full window."""
    present = set(units)
    found = [(full,)] if full in present else []
    found += [(a, full - a) for a in units if 2 * a <= full and full - a in present and full - a > 0]
    for i, a in enumerate(units):
        for b in units[i:]:
            c = full - a - b
            if c < b:
                break
            if c in present:
                found.append((a, b, c))
    return found


def least_squares(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Minimise |matrix x - target| over x >= 0 by active sets on the normal equations."""
    gram, aim = matrix.T @ matrix, matrix.T @ target
    size = matrix.shape[1]
    x, active = np.zeros(size), np.zeros(size, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(aim).max(initial=0)))
    for _ in range(4 * len(target) + 10):
        slope = aim - gram @ x
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tolerance:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            trial = np.linalg.lstsq(gram[np.ix_(at, at)], aim[at], rcond=None)[0]
            if (trial > 0).all():
                break
            low = trial <= 0
            gap = x[at][low] - trial[low]
            step = float(np.min(np.where(gap > 0, x[at][low] / np.where(gap > 0, gap, 1), 0)))
            x[at] += step * (trial - x[at])
            gone = at[(x[at] <= 1e-12) & low]
            if not len(gone):
                gone = at[low]
            x[gone] = 0
            active[gone] = False
        x[:] = 0
        x[at] = trial
    return x


def _use(
    shape: tuple[int, ...], count: int, bins: dict[int, list[int]], left: Counter, window: int, out: list
) -> None:
    """Use a combination of bins up to ``count`` times, with the exact lengths the bins still hold."""
    while count > 0:
        chosen: Counter = Counter()
        for b in shape:
            length = next((n for n in reversed(bins[b]) if left[n] > chosen[n]), None)
            if length is None:
                return
            chosen[length] += 1
        if sum(n * c for n, c in chosen.items()) > window:
            return
        times = min(count, *(left[n] // c for n, c in chosen.items()))
        _take(chosen, times, left, out)
        count -= times


def _greedy(left: Counter, window: int, out: list) -> None:
    """Fill each window with the largest lengths that still fit, repeating a filling while it can be."""
    lengths = sorted(n for n, c in left.items() if c > 0)
    while lengths:
        chosen, room, at = Counter(), window, len(lengths)
        while room > 0:
            at = bisect_right(lengths, room, 0, at)
            if not at:
                break
            at -= 1
            times = min(left[lengths[at]], room // lengths[at])
            chosen[lengths[at]] = times
            room -= times * lengths[at]
        if not chosen:
            raise ValueError(f"a piece is longer than the window of {window}")
        _take(chosen, min(left[n] // c for n, c in chosen.items()), left, out)
        lengths = [n for n in lengths if left[n] > 0]


def _take(chosen: Counter, times: int, left: Counter, out: list) -> None:
    for length, n in chosen.items():
        left[length] -= n * times
    out.append((tuple(sorted(chosen.elements(), reverse=True)), times))


def slots(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): piece r of a length goes to the row below r."""
    rows, used, sequence = [], Counter(), 0
    for pattern, times in planned:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _place(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    shift = np.int64(1) << np.int64(44)
    keys = table[:, 0] * shift + table[:, 1]
    for batch in batches:
        length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
        row = np.searchsorted(keys, length * shift + rank, side="right") - 1
        sequence = table[row, 2] + rank - table[row, 1]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(sequence), pa.array(table[row, 3])], [*batch.schema.names, "sequence_id", "offset"]
        )
