import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusbench.llm import suffixes, windows
from tests.llm import brute
from tests.llm.fixtures import awkward_rows, documents, text


@pytest.mark.parametrize("window, gram, crowd", [(50, 24, 1000), (7, 4, 1000), (50, 24, 1), (7, 4, 3)])
def test_repeated_bytes(spark, monkeypatch, window, gram, crowd):
    monkeypatch.setattr(windows, "CROWD", crowd)
    rows = awkward_rows()
    got = suffixes.remove_repeated_bytes(documents(spark, rows).repartition(5), window, gram)
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()]
    assert sorted(found, key=brute.sort_key) == sorted(brute.repeated_bytes(rows, window), key=brute.sort_key)
    assert any(row[2] for row in found) and any(row[1] and not row[2] for row in found)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(windows, "POSITIONS", 64)
    monkeypatch.setattr(suffixes, "_BLOCK", 500)
    monkeypatch.setattr(suffixes, "_SHARD_BYTES", 500)
    rows = awkward_rows(9)
    got = suffixes.remove_repeated_bytes(documents(spark, rows), 30, 12)
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()]
    assert sorted(found, key=brute.sort_key) == sorted(brute.repeated_bytes(rows, 30), key=brute.sort_key)


def short_periods():
    r = random.Random(8)
    label = text(r, 12)
    log = "\n".join(f"{label} {r.random()}" for _ in range(150))
    rows = [(k + 20, f"{text(r, 20)} {unit * (700 // len(unit))} {text(r, 20)}") for k, unit in enumerate(["-", "-", "=-", " ", "abc", "0", "-"])]
    rows += [(50, "-" * 17_000), (10, "=" + "=-" * 40), (51, f"{text(r, 30)} {log}"), (52, log + text(r, 5)), (9, f"x {label} 0.5")]
    return [*rows, (None, "0" * 900), (None, "-" * 300), (24, "abc" * 60), (9, "abc" * 40 + label)]


@pytest.mark.parametrize("window, gram, crowd", [(50, 24, 1000), (50, 24, 1), (7, 4, 3)])
def test_short_periods(spark, monkeypatch, window, gram, crowd):
    monkeypatch.setattr(windows, "CROWD", crowd)
    rows = short_periods()
    for parts in (1, 5):
        got = suffixes.remove_repeated_bytes(documents(spark, rows).repartition(parts), window, gram)
        found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()]
        assert sorted(found, key=brute.sort_key) == sorted(brute.repeated_bytes(rows, window), key=brute.sort_key)


def test_rows_of_a_long_run_of_one_byte():
    """Rows that leave the text for a shard do not grow with the run, alone or among many contexts."""
    shape = windows.Shape(50, 24)
    body = "start of it " * 3 + "-" * 40_000 + " and the end of it" * 3
    log = "".join(f"{'label of the line ' * 4}{k * 7919 % 100_003}" for k in range(2_000))
    for whole, most in ((body, 300), ("-" * 40_000, 0)):
        batch = pa.RecordBatch.from_pydict({"k1": [1], "t1": [7], "text": [whole]})
        sent = pa.Table.from_batches(suffixes._runs(iter([batch]), shape))
        assert len(sent) < 500
        found = pa.Table.from_batches(windows.match_runs(iter(sent.sort_by([("h", "ascending"), ("f", "ascending")]).to_batches()), True))
        assert sum(k == windows.TO_MATCH for k in found["kind"].to_pylist()) <= most
    starts = len(log) - 49
    spans = [[{"start": 0, "n": starts, "h": 5, "crowded": True}]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1]), pa.array([7]), pa.array([log]), pa.array(spans, pa.list_(pa.struct({"start": pa.int32(), "n": pa.int32(), "h": pa.int64(), "crowded": pa.bool_()})))],
        ["k1", "t1", "text", "spans"],
    )
    (packed,) = suffixes._pack(iter([batch]), 50)
    shards = [h for h, raw in zip(packed["h"].to_pylist(), packed["bytes"].to_pylist(), strict=True) if raw]
    assert packed.num_rows == starts and len(set(shards)) == len(shards) < starts


def test_empty_table(spark):
    assert suffixes.remove_repeated_bytes(documents(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab c", max_size=40), max_size=8), st.sampled_from([3, 5, 50]), st.sampled_from([0, 1 << 20]))
def test_order_and_common_prefixes(texts, depth, memory):
    symbols = []
    for text in texts:
        symbols += [b + 2 for b in text.encode()] + [1]
    symbols = np.array([*symbols, 0], np.int16)
    order, common = suffixes.sort_suffixes(symbols, depth, memory)
    assert sorted(order.tolist()) == list(range(len(symbols)))
    whole = [tuple(symbols[i:].tolist()) for i in order]
    heads = [w[:depth] for w in whole]
    assert heads == sorted(heads)
    for i in range(1, len(whole)):
        shared = 0
        for a, b in zip(whole[i - 1], whole[i]):
            if a != b:
                break
            shared += 1
        assert min(shared, depth) == min(int(common[i]), depth)


def test_many_repeated_rows(spark):
    r = random.Random(6)
    whole, part = text(r, 700), text(r, 40)
    rows = [(None, whole)] * 2000 + [(400, whole)] * 300 + [(5, f"{text(r, 50)} {whole[500:900]} {part}"), (500, part), (None, text(r, 60))]
    got = suffixes.remove_repeated_bytes(documents(spark, rows).repartition(6)).collect()
    found = {(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got}
    assert len(got) == len(rows) and found == set(brute.repeated_bytes(list(set(rows)), 50))
