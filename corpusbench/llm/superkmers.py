"""Repeated word windows, found by sending runs of windows to the bucket of their minimiser."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbench.llm import windows
from corpusbench.llm.common import (
    NO_ID, Powers, mix, prefix_sums, ranges_of, signed, span_hash, stage_table, text_blocks, text_bytes, text_key,
    without_nulls, word_bounds, word_hashes,
)

WINDOW, GRAM = 35, 8
_BUCKET_BYTES = 8 << 20
_CLEANED = {
    "doc_id": "long", "text": "string", "n_words": "long", "n_removed": "long", "kept_text": "string",
    "kept_sha256": "string",
}


def repeated_words(
    documents: DataFrame, window: int = WINDOW, gram: int = GRAM, *, keep: Sequence[str] = (),
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Each document with the words no repeated window covers: doc_id, text, n_words, n_removed, kept_text, kept_sha256.

    A window is ``window`` consecutive words of one document; it is repeated if its words also start
    anywhere else, the same document included.  Windows are judged on the input.  Columns named in
    ``keep`` come along, but for those whose names the result uses itself.

    1. Runs of windows that share a minimiser are reduced to (minimiser, content hash, place); runs
       equal inside a task are settled there, the rest meet sorted by minimiser.
    2. Runs equal to another one are repeated as a whole.  Where a minimiser has different runs, one
       of each is cut from its text and travels as one packed string to the minimiser's bucket.  A
       minimiser with very many different runs has its windows travel one by one to buckets of their
       own, after those that repeat inside a task are settled there.
    3. The bucket counts the windows of its strings by sorting them, and equal hashes are compared
       word by word.
    4. The covered words of each document come together and are removed.

    Null and empty texts have no words and keep nothing; null ids stay null; repeated rows repeat each
    other's windows, and only one row of each (id, text) is cut into runs and strings; an empty table
    gives an empty one.  Texts of any length are cut into pieces.
    """
    shape = windows.Shape(window, gram)
    docs = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k1"), text_key(text_col).alias("t1"),
        F.struct(*(F.col(c) for c in keep), F.lit(0).alias("_none")).alias("payload"),
    )
    found = stage_table(_matches(docs, shape), "word-runs")
    texts = docs.select("k1", "t1", "doc_id", "text", "payload")
    wanted = windows.wanted_spans(found)
    packed = texts.join(wanted, ["k1", "t1"]).sortWithinPartitions("k1", "t1").mapInArrow(
        lambda it: _pack(it, window), "h long, k1 long, t1 long, start int, words binary"
    )
    counted = packed.repartition("h").sortWithinPartitions("h").mapInArrow(
        lambda it: _count(it, window), "k1 long, t1 long, start int, n int"
    )
    known = found.where(F.col("kind") == windows.KNOWN).select("k1", "t1", "start", "n")
    spans = known.union(counted).groupBy("k1", "t1").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    payload = docs.schema["payload"].dataType.simpleString()
    cleaned = texts.join(spans, ["k1", "t1"], "left").mapInArrow(
        lambda it: _remove(it, window),
        f"{', '.join(f'{c} {kind}' for c, kind in _CLEANED.items())}, payload {payload}",
    )
    return cleaned.select(*_CLEANED, *(f"payload.{c}" for c in keep if c not in _CLEANED))


def _matches(docs: DataFrame, shape: windows.Shape) -> DataFrame:
    parts = docs.select("k1", "t1", "text").mapInArrow(lambda it: _runs(it, shape), windows.RUN_SCHEMA)
    # Settled runs need no partner: they are dealt by their text, not by their minimiser.
    bucket = F.when(F.expr("at & 3") == windows.KNOWN, F.xxhash64("t1", "at")).otherwise(F.col("h"))
    dealt = parts.repartition(bucket).sortWithinPartitions(*windows.RUN_ORDER)
    return dealt.mapInArrow(lambda it: windows.match_runs(it, False), windows.MATCH_SCHEMA)


def _runs(batches: Iterator[pa.RecordBatch], shape: windows.Shape) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for whole in batches:
        batch, copied = windows.distinct_rows(whole)
        k1, t1 = (batch.column(i).to_numpy() for i in (0, 1))
        found = []
        for first, raw, offsets in text_blocks(without_nulls(batch, "text")):
            starts, ends, bounds = word_bounds(raw, offsets)
            sums = prefix_sums(word_hashes(raw, starts, ends), powers)
            found.extend((first + t, *rest) for t, *rest in windows.runs(sums, bounds, shape, powers))
        out = windows.run_batch(found, k1, t1, False, copied)
        if out is not None:
            yield out


def _pack(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Cut the wanted runs out of their texts, as the words' bytes from the first to the last word.

    A row without words is a window already known to be repeated.
    """
    powers, first_of_key = Powers(), windows.FirstOfKey()
    for batch in map(first_of_key.of, batches):
        spans = batch.column(batch.schema.get_field_index("spans"))
        k1, t1 = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("k1", "t1"))
        for first, raw, offsets in text_blocks(without_nulls(batch, "text")):
            starts, ends, bounds = word_bounds(raw, offsets)
            part = spans.slice(first, len(offsets) - 1)
            text = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
            start, n, h, crowded = (part.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
            known = np.zeros(0, np.int64)
            if crowded.any():
                sums = prefix_sums(word_hashes(raw, starts, ends), powers)
                at = ranges_of(bounds[text[crowded]] + start[crowded], n[crowded])
                own = np.repeat(text[crowded], n[crowded])
                value = span_hash(sums, at, at + window, powers)
                travels, repeated, _ = windows.settle_windows(value, k1[first + own], False)
                text = np.concatenate([text[~crowded], own[travels], own[repeated]])
                start = np.concatenate([start[~crowded], (at - bounds[own])[travels], (at - bounds[own])[repeated]])
                n = np.concatenate([n[~crowded], np.ones(len(text) - int((~crowded).sum()), n.dtype)])
                anywhere = signed(mix(value[repeated] + at[repeated].astype(np.uint64)))  # settled, needs no bucket
                h = np.concatenate([h[~crowded], signed(value[travels]), anywhere])
                known = np.arange(len(text) - int(repeated.sum()), len(text))
            word = bounds[text] + start
            low, high = starts[word], ends[word + n + window - 2]
            high[known] = low[known]
            data = raw[ranges_of(low, high - low)]
            places = np.concatenate([[0], np.cumsum(high - low)]).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(places), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(k1[first + text]), pa.array(t1[first + text]), pa.array(start.astype(np.int32)), words],
                ["h", "k1", "t1", "start", "words"],
            )


def _count(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Count the windows of strings that come sorted by minimiser; whole minimisers are counted together."""
    powers, waiting, size = Powers(), [], 0

    def flush(table: pa.Table) -> pa.RecordBatch | None:
        return _repeats(table.combine_chunks().to_batches()[0], window, powers) if len(table) else None

    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size < _BUCKET_BYTES:
            continue
        table = pa.Table.from_batches(waiting)
        h = table.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1]))  # the last minimiser may go on
        out = flush(table.slice(0, cut))
        if out is not None:
            yield out
        rest = table.slice(cut)
        waiting, size = rest.to_batches(), rest.nbytes if cut else -_BUCKET_BYTES
    if waiting:
        out = flush(pa.Table.from_batches(waiting))
        if out is not None:
            yield out


def _repeats(batch: pa.RecordBatch, window: int, powers: Powers) -> pa.RecordBatch:
    """Places of the windows that start more than once, as runs of consecutive ones."""
    h, k1, t1, start = (batch.column(i).to_numpy() for i in range(4))
    raw, offsets = text_bytes(batch.column(4).cast(pa.large_binary()).view(pa.large_string()))
    starts, ends, bounds = word_bounds(raw, offsets)
    hashes = word_hashes(raw, starts, ends)
    words = _word_ids(raw, starts, ends)
    sums = prefix_sums(hashes, powers)
    counts = np.maximum(np.diff(bounds) - window + 1, 0)
    at = ranges_of(bounds[:-1], counts)
    text = np.repeat(np.arange(len(counts)), counts)
    value = span_hash(sums, at, at + window, powers)
    order = np.argsort(value, kind="stable")
    same = np.zeros(len(at), bool)
    same[1:] = value[order][1:] == value[order][:-1]
    twins = np.flatnonzero(same)
    equal = np.ones(len(twins), bool)
    for j in range(window):
        equal &= words[at[order[twins]] + j] == words[at[order[twins - 1]] + j]
    repeated = np.zeros(len(at), bool)
    repeated[order[twins[equal]]] = True
    repeated[order[twins[equal] - 1]] = True
    hits = np.flatnonzero(repeated)
    first = np.ones(len(hits), bool)
    first[1:] = (np.diff(hits) > 1) | (text[hits][1:] != text[hits][:-1])
    heads = hits[first]
    n = np.diff(np.concatenate([np.flatnonzero(first), [len(hits)]]))
    owner = text[heads]
    place = start[owner] + at[heads] - bounds[owner]
    told = np.flatnonzero(np.diff(bounds) == 0)  # rows without words
    owner, place = np.concatenate([owner, told]), np.concatenate([place, start[told]])
    n = np.concatenate([n, np.ones(len(told), n.dtype)])
    return pa.RecordBatch.from_arrays(
        [pa.array(k1[owner]), pa.array(t1[owner]), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32))],
        ["k1", "t1", "start", "n"],
    )


def _word_ids(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    data = raw[ranges_of(starts, ends - starts)]
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy()


def _remove(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = without_nulls(batch, "text")
        original = batch.column(batch.schema.get_field_index("text"))
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        spans, payload = (batch.column(batch.schema.get_field_index(c)) for c in ("spans", "payload"))
        for first, raw, offsets in text_blocks(texts):
            rows = len(offsets) - 1
            starts, ends, bounds = word_bounds(raw, offsets)
            part = spans.slice(first, rows)
            lengths = part.value_lengths().fill_null(0).to_numpy()
            text = np.repeat(np.arange(rows), lengths)
            start, n = (part.flatten().field(i).to_numpy() for i in range(2))
            low = bounds[text] + start
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, low, 1)
            np.add.at(change, low + n + window - 1, -1)
            kept = np.cumsum(change)[:-1] == 0
            owner = np.repeat(np.arange(rows), np.diff(bounds))
            # Kept words, each with a space behind it; the last space of a text is cut off again.
            s, e = starts[kept], ends[kept]
            at = ranges_of(s, e - s + 1)
            data = raw[np.minimum(at, max(len(raw) - 1, 0))]
            tail = np.cumsum(e - s + 1) - 1
            data[tail] = 32
            sizes = np.bincount(owner[kept], weights=(e - s + 1), minlength=rows).astype(np.int64)
            places = np.concatenate([[0], np.cumsum(sizes)])
            packed = data.tobytes()
            pieces = [packed[a : b - 1] if b > a else b"" for a, b in zip(places[:-1], places[1:], strict=True)]
            total = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, rows), original.slice(first, rows), pa.array(total),
                    pa.array(total - np.bincount(owner[kept], minlength=rows)),
                    pa.array([p.decode() for p in pieces]),
                    pa.array([hashlib.sha256(p).hexdigest() for p in pieces]), payload.slice(first, rows),
                ],
                [*_CLEANED, "payload"],
            )
