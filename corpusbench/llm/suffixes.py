"""Repeated byte strings across documents, by induced sorting of the suffixes of content shards."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbench.llm import windows
from corpusbench.llm.common import (
    NO_ID, Powers, mix, prefix_sums, ranges_of, signed, span_hash, stage_table, text_blocks, text_bytes, text_key,
    without_nulls,
)

WINDOW, GRAM = 50, 24
_BLOCK = 1 << 20
_SHARD_BYTES = 4 << 20
_QUEUE_BYTES = 96 << 20
_NO_TWIN = -1
_END, _GAP, _SHIFT = 0, 1, 2  # symbols: end of the shard, end of a string, byte + 2


def remove_repeated_bytes(
    documents: DataFrame, window: int = WINDOW, gram: int = GRAM, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each document without the bytes that an earlier document has: doc_id, text, n_bytes, n_removed, n_spans, kept, kept_sha256.

    A byte goes if a string of ``window`` UTF-8 bytes covers it that also starts in a document with a
    smaller id.  Strings are judged on the input and never cross documents; ``kept`` is binary, for a
    cut may fall inside a character.

    Texts are sharded by content: all suffixes whose first ``window`` bytes are equal have the same
    minimiser and so meet in one shard.  Runs of suffixes equal to a run of a smaller id are settled
    by their hash; only runs whose minimiser has different contexts go on as strings, and those of a
    minimiser with very many contexts as single windows, sharded by their own content.  Of equal runs or
    windows of one text only the first goes on; the others stay with their text and take over its
    verdict there, so a long run of one byte is a few rows of its shard.  Each shard
    then sorts its suffixes by induction and reads groups of equal strings from the common prefixes.

    Null and empty texts have no bytes; a null id counts as larger than every id; rows that repeat an
    id remove nothing from each other, and of rows equal in id and text one is sorted for all; an empty
    table gives an empty one.  Of other columns none is looked at, whatever its name.
    """
    shape = windows.Shape(window, gram)
    docs = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k1"), text_key(text_col).alias("t1"),
    )
    parts = docs.select("k1", "t1", "text").mapInArrow(lambda it: _runs(it, shape), windows.RUN_SCHEMA)
    # Settled runs and twins need no partner: they are dealt by their text, not by their minimiser.
    alone = F.expr("at & 3").isin(windows.KNOWN, windows.TWIN)
    bucket = F.when(alone, F.xxhash64("t1", "at")).otherwise(F.col("h"))
    dealt = parts.repartition(bucket).sortWithinPartitions(*windows.RUN_ORDER)
    found = stage_table(
        dealt.mapInArrow(lambda it: windows.match_runs(it, True), windows.MATCH_SCHEMA), "byte-runs"
    )
    texts = docs.select("k1", "t1", "doc_id", "text")
    wanted = windows.wanted_spans(found)
    packed = texts.join(wanted, ["k1", "t1"]).sortWithinPartitions("k1", "t1").mapInArrow(
        lambda it: _pack(it, window), "h long, k1 long, t1 long, start int, bytes binary, twin long"
    )
    shards = packed.repartition("h").sortWithinPartitions("h").mapInArrow(
        lambda it: _shards(it, window), "k1 long, t1 long, start int, n int, twin long"
    )
    twin = F.when(F.col("kind") == windows.TWIN, F.col("h")).otherwise(_NO_TWIN)
    known = found.where(F.col("kind") != windows.TO_MATCH).select("k1", "t1", "start", "n", twin.alias("twin"))
    spans = known.union(shards).groupBy("k1", "t1").agg(F.collect_list(F.struct("start", "n", "twin")).alias("spans"))
    return texts.join(spans, ["k1", "t1"], "left").mapInArrow(
        lambda it: _remove(it, window),
        "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string",
    )


def _runs(batches: Iterator[pa.RecordBatch], shape: windows.Shape) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for whole in batches:
        batch, copied = windows.distinct_rows(whole)
        k1, t1 = (batch.column(i).to_numpy() for i in (0, 1))
        found = []
        for first, raw, offsets in text_blocks(without_nulls(batch, "text"), _BLOCK):
            sums = prefix_sums(raw.astype(np.uint64) + np.uint64(1), powers)
            found.extend((first + t, *rest) for t, *rest in windows.runs(sums, offsets, shape, powers))
        out = windows.run_batch(found, k1, t1, True, copied)
        if out is not None:
            yield out


def _pack(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Cut the wanted runs out of their texts; a row without bytes is a window known to be a repeat, or a twin."""
    powers, first_of_key = Powers(), windows.FirstOfKey()
    for batch in map(first_of_key.of, batches):
        spans = batch.column(batch.schema.get_field_index("spans"))
        k1, t1 = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("k1", "t1"))
        for first, raw, offsets in text_blocks(without_nulls(batch, "text"), _BLOCK):
            part = spans.slice(first, len(offsets) - 1)
            text = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
            start, n, h, crowded = (part.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
            untold = len(text)
            twin = np.full(len(text), _NO_TWIN)
            if crowded.any():
                sums = prefix_sums(raw.astype(np.uint64) + np.uint64(1), powers)
                at = ranges_of(offsets[text[crowded]] + start[crowded], n[crowded])
                own = np.repeat(text[crowded], n[crowded])
                value = span_hash(sums, at, at + window, powers)
                travels, repeated, model = windows.settle_windows(value, k1[first + own], True, own)
                place = at - offsets[own]
                order = np.concatenate([np.flatnonzero(travels), np.flatnonzero(~travels)])
                told = order[int(travels.sum()) :]
                mark = np.where(repeated[told], _NO_TWIN, windows.twin_mark(place[model[told]], 1))
                text = np.concatenate([text[~crowded], own[order]])
                start = np.concatenate([start[~crowded], place[order]])
                n = np.concatenate([n[~crowded], np.ones(len(order), n.dtype)])
                anywhere = signed(mix(value[told] + at[told].astype(np.uint64)))  # settled, needs no bucket
                h = np.concatenate([h[~crowded], signed(value[travels]), anywhere])
                untold = len(text) - len(told)
                twin = np.concatenate([np.full(untold, _NO_TWIN), mark])
            sizes = n.astype(np.int64) + window - 1
            sizes[untold:] = 0
            data = raw[ranges_of(offsets[text] + start, sizes)]
            places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            strings = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(places), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(k1[first + text]), pa.array(t1[first + text]), pa.array(start.astype(np.int32)), strings, pa.array(twin)],
                ["h", "k1", "t1", "start", "bytes", "twin"],
            )


def _shards(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Sort the suffixes of strings that come in the order of their minimiser, whole minimisers together."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size < _SHARD_BYTES:
            continue
        table = pa.Table.from_batches(waiting)
        h = table.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1]))  # the last minimiser may go on
        if cut:
            yield _earlier(table.slice(0, cut).combine_chunks().to_batches()[0], window)
        rest = table.slice(cut)
        waiting, size = rest.to_batches(), rest.nbytes if cut else -_SHARD_BYTES
    if waiting:
        yield _earlier(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], window)


def _earlier(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """Places of the suffixes whose first ``window`` bytes also start in a document of a smaller id."""
    _, k1, t1, start = (batch.column(i).to_numpy() for i in range(4))
    raw, offsets = text_bytes(batch.column(4).cast(pa.large_binary()).view(pa.large_string()))
    rows = len(offsets) - 1
    owner = np.repeat(np.arange(rows), np.diff(offsets) + 1)
    inner = np.ones(len(owner), bool)
    ends = offsets[1:] + np.arange(rows)
    inner[ends] = False
    symbols = np.full(len(owner) + 1, _GAP, np.int16)
    symbols[:-1][inner] = raw.astype(np.int16) + _SHIFT
    symbols[-1] = _END
    suffixes, common = sort_suffixes(symbols, window)
    left = ends[owner[np.minimum(suffixes, len(owner) - 1)]] - suffixes  # bytes up to the string's end
    valid = (left >= window) & (suffixes < len(owner))
    new = np.ones(len(suffixes), bool)
    new[1:] = common[1:] < window
    ids = k1[owner[np.minimum(suffixes, len(owner) - 1)]]
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(ids, np.flatnonzero(new))
    hits = np.sort(suffixes[valid & (ids > least[group])])
    text = owner[hits]
    first = np.ones(len(hits), bool)
    first[1:] = (np.diff(hits) > 1) | (text[1:] != text[:-1])
    heads, at = hits[first], text[first]
    n = np.diff(np.concatenate([np.flatnonzero(first), [len(hits)]]))
    place = start[at] + heads - (offsets[at] + at)
    told = np.flatnonzero(np.diff(offsets) == 0)  # rows without bytes
    at, place = np.concatenate([at, told]), np.concatenate([place, start[told]])
    n = np.concatenate([n, np.ones(len(told), n.dtype)])
    twin = batch.column(5).to_numpy()[at]
    return pa.RecordBatch.from_arrays(
        [pa.array(k1[at]), pa.array(t1[at]), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twin)],
        ["k1", "t1", "start", "n", "twin"],
    )


# ---------------------------------------------------------------- induced sorting


class _Queue:
    """Suffixes by first symbol, first in first out, with their common prefix with the one before.

    Since induction only ever appends at a symbol's end, popping symbols in order is popping the least
    suffix.  What exceeds the memory allowed is kept in a temporary file of the task.
    """

    def __init__(self, symbols: int, memory: int):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.open = np.full(symbols, np.iinfo(np.int32).max, np.int32)  # least prefix since the last push
        self.begun = np.zeros(symbols, bool)
        self.held, self.memory, self.file = 0, memory, None

    def push(self, symbol: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        pair = np.stack([suffixes, common.astype(np.int64)])
        if self.held + pair.nbytes > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile(prefix="suffix-queue-")  # noqa: SIM115  closed with the queue
            self.file.seek(0, 2)
            self.parts[symbol].append((self.file.tell(), pair.shape[1]))
            pair.tofile(self.file)
        else:
            self.held += pair.nbytes
            self.parts[symbol].append(pair)

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts[symbol] = self.parts[symbol], []
        pairs = []
        for part in parts:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                pairs.append(np.fromfile(self.file, np.int64, 2 * part[1]).reshape(2, -1))
            else:
                self.held -= part.nbytes
                pairs.append(part)
        both = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        return both[0], both[1].astype(np.int32)

    def induce(self, source: np.ndarray, common: np.ndarray, symbols: np.ndarray, wanted: np.ndarray) -> None:
        """Push the left neighbours of scanned suffixes; ``common`` is of each with the one scanned before."""
        if not len(source):
            return
        before = source - 1
        chosen = np.flatnonzero((before >= 0) & wanted[before])
        heads = symbols[before[chosen]]
        order = np.argsort(heads, kind="stable")
        chosen, heads = chosen[order], heads[order]
        cuts = np.append(np.flatnonzero(np.diff(heads, prepend=-1)), len(heads))
        seen = np.zeros(len(self.open), bool)
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            symbol, at = int(heads[low]), chosen[low:high]
            least = np.minimum.reduceat(common[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
            least[0] = min(least[0], self.open[symbol])
            prefix = least + 1
            if not self.begun[symbol]:
                prefix[0] = 0
            self.begun[symbol], seen[symbol] = True, True
            rest = common[at[-1] + 1 :]
            self.open[symbol] = rest.min() if len(rest) else np.iinfo(np.int32).max
            self.push(symbol, before[at], prefix)
        self.open[~seen] = np.minimum(self.open[~seen], common.min())

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def sort_suffixes(symbols: np.ndarray, depth: int, memory: int = _QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` symbols, and each one's common prefix with the one before.

    Suffixes that begin a rise after a fall are sorted by refinement; all falling ones are induced
    from them in rising order, then all rising ones from the falling ones in falling order.  Each
    queue entry carries the common prefix with the entry before it, as the least over what was
    scanned between their sources, plus one.  Common prefixes of ``depth`` or more are exact as far
    as ``depth``.  The last symbol must be the only smallest one.
    """
    n, kinds = len(symbols), int(symbols.max()) + 1
    rises, run = _types(symbols)
    falls = ~rises
    peaks = np.flatnonzero(rises & np.concatenate([[False], falls[:-1]]))
    seeds, seed_common = _refine(symbols, peaks, depth)
    seed_heads = symbols[seeds]
    bounds = np.searchsorted(seed_heads, np.arange(kinds + 1))
    falling = _Queue(kinds, memory)
    fallen: list[tuple[np.ndarray, np.ndarray]] = []
    for symbol in range(kinds):
        own, last = [], None
        while falling.parts[symbol]:
            at, common = falling.pop(symbol)
            own.append((at, common))
            last = at[-1]
            falling.induce(at, common, symbols, falls)
        low, high = bounds[symbol], bounds[symbol + 1]
        at, common = seeds[low:high], seed_common[low:high].copy()
        if len(at):
            common[0] = 0 if last is None else min(run[last], run[at[0]])
            falling.induce(at, common, symbols, falls)
        fallen.append(_joined(own))
    falling.close()
    rising = _Queue(kinds, memory)
    result: list[tuple[np.ndarray, np.ndarray]] = []
    for symbol in range(kinds - 1, -1, -1):
        own, last = [], None
        while rising.parts[symbol]:
            at, common = rising.pop(symbol)
            own.append((at, common))
            last = at[-1]
            rising.induce(at, common, symbols, rises)
        at, common = fallen[symbol]
        down = at[::-1]
        if len(at):
            shifted = np.concatenate([[0 if last is None else min(run[last], run[down[0]])], common[1:][::-1]])
            rising.induce(down, shifted.astype(np.int32), symbols, rises)
        up, up_common = _joined(own)
        up, up_common = up[::-1], up_common[::-1]
        if len(up):  # entries carry the prefix with the larger one: move it to the larger one
            first = 0 if not len(at) else min(run[at[-1]], run[up[0]])
            up_common = np.concatenate([[first], up_common[:-1]]).astype(np.int32)
        result.append((np.concatenate([at, up]), np.concatenate([common, up_common])))
    rising.close()
    suffixes, common = _joined(result[::-1])
    if len(suffixes) < n:  # the end symbol alone is neither induced nor a peak of a longer text
        suffixes, common = np.concatenate([[n - 1], suffixes]), np.concatenate([[0], common])
    return suffixes, common


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _types(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than its right neighbour, and how often its first symbol repeats."""
    n = len(symbols)
    change = np.flatnonzero(np.concatenate([symbols[1:] != symbols[:-1], [True]]))  # last of each equal run
    lengths = np.diff(np.concatenate([[-1], change]))
    up = np.zeros(len(change), bool)
    up[:-1] = symbols[change[:-1]] < symbols[change[:-1] + 1]
    up[-1] = True  # the end counts as rising
    run = np.repeat(change, lengths) - np.arange(n) + 1
    return np.repeat(up, lengths), run.astype(np.int32)


def _refine(symbols: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes by their first ``depth`` symbols: by seven symbols, then ties by seven more, and so on.

    Ties of one group stand side by side, so a stable sort by key and then by group settles them.  The
    common prefixes are read off the same keys: whole steps while a tie lasts, then the symbols of
    the step that broke it.
    """
    step = 7
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(depth + 2 * step, np.uint64)])
    keys = padded[: len(symbols) + depth + step].copy()  # seven symbols of nine bits from each place on
    for j in range(1, step):
        keys = (keys << np.uint64(9)) | padded[j : len(keys) + j]
    order = np.array(places)
    common = np.zeros(len(order), np.int32)
    group = np.zeros(len(order), np.int32)
    tied = np.arange(len(order))
    for done in range(0, depth, step):
        key = keys[order[tied] + done]
        by = np.argsort(key, kind="stable")
        if done:
            by = by[np.argsort(group[by], kind="stable")]
            group = group[by]
        order[tied], key = order[tied[by]], key[by]
        inside = np.zeros(len(tied), bool)
        inside[1:] = (group[1:] == group[:-1]) if done else True
        change = np.ones(len(tied), np.uint64)
        change[1:] = key[1:] ^ key[:-1]
        same = inside & (change == 0)
        # The highest differing bit tells how many whole symbols of this step agree.
        broke = np.flatnonzero(inside & ~same)
        _, bits = np.frexp((change[broke] >> np.uint64(10)).astype(np.float64))
        bits = np.where(change[broke] >> np.uint64(10), bits + 10, np.frexp((change[broke] & np.uint64(1023)).astype(float))[1])
        common[tied[broke]] = done + step - (bits + 8) // 9
        stay = same.copy()
        stay[:-1] |= same[1:]
        group = (np.cumsum(~same, dtype=np.int32))[stay]
        common[tied[same]] = done + step
        tied = tied[stay]
        if not len(tied):
            break
    return order, common


# ---------------------------------------------------------------- removal


def _remove(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        original = batch.column(batch.schema.get_field_index("text"))
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        spans = batch.column(batch.schema.get_field_index("spans"))
        for first, raw, offsets in text_blocks(without_nulls(batch, "text"), _BLOCK):
            rows = len(offsets) - 1
            part = spans.slice(first, rows)
            text = np.repeat(np.arange(rows), part.value_lengths().fill_null(0).to_numpy())
            start, n, twin = (part.flatten().field(i).to_numpy() for i in range(3))
            low, own = offsets[text] + start, twin == _NO_TWIN
            if not own.all():
                size = len(raw) + 1
                hit = np.cumsum(np.bincount(low[own], minlength=size) - np.bincount((low + n)[own], minlength=size)) > 0
                more = windows.spread_twins(hit, start[~own], n[~own], twin[~own], offsets[text][~own])
                low, n = np.concatenate([low[own], more]), np.concatenate([n[own], np.ones(len(more), n.dtype)])
            change = np.bincount(low, minlength=len(raw) + 1) - np.bincount(
                low + n + window - 1, minlength=len(raw) + 1
            )
            gone = np.cumsum(change[:-1]) > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            opens[offsets[:-1][offsets[:-1] < offsets[1:]]] = gone[offsets[:-1][offsets[:-1] < offsets[1:]]]
            removed, spans_before = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (gone, opens))
            total, removed, runs = np.diff(offsets), np.diff(removed), np.diff(spans_before)
            data = raw[~gone].tobytes()
            places = np.concatenate([[0], np.cumsum(total - removed)])
            kept = [data[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, rows), original.slice(first, rows), pa.array(total), pa.array(removed),
                    pa.array(runs), pa.array(kept, pa.binary()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                ],
                ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )
