import hashlib
import json
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusbench.llm import packing, tokens
from tests.llm import brute
from tests.llm.fixtures import awkward_rows, documents

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    "\n\nA  b  c　 d", "don't  'll <|endoftext|> x<|endoftext|>\n", "á ́b  ", "  ", "é\u0085 y \tz",
    "\x1c \x1fq", "日本語 テキスト。 次", "😀 😀\n", "ΑΣ Σ ΟΔΟΣ", "İ İ", "x" * 300, "1234 5,6 <|startoftext|>",
]


@pytest.fixture(scope="module")
def definition():
    return tokens.tokenizer_json(BYTES)


def test_encode_and_decode(spark, definition):
    rows = awkward_rows() + [(900 + k, t) for k, t in enumerate(ODD)]
    encoded = tokens.encode(documents(spark, rows), definition)
    found = [tuple(r) for r in tokens.decode(encoded, definition).collect()]
    library = Tokenizer.from_file(BYTES)
    expected = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append((doc_id, len(ids), digest, library.decode(ids, skip_special_tokens=False)))
    assert sorted(found, key=brute.sort_key) == sorted(expected, key=brute.sort_key)


_KEPT = {}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab ' \n\té 　.1s<|"), max_size=30), min_size=1, max_size=4))
def test_fragments_encode_as_whole_texts(texts):
    definition = tokens.tokenizer_json(BYTES)
    library = Tokenizer.from_str(definition)
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    cuts = tokens.forced_cuts(raw, offsets, _inside(definition))
    encoder = _KEPT.setdefault("encoder", tokens.FragmentEncoder(definition))
    ids, before = encoder.encode(raw, cuts)
    bounds = before[np.searchsorted(cuts, offsets)]
    for text, low, high in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[low:high].tolist() == library.encode(text, add_special_tokens=False).ids


def _inside(definition):
    if "inside" not in _KEPT:
        _KEPT["inside"] = tokens.pairs_inside(tokens.token_bytes(json.loads(definition)))
    return _KEPT["inside"]


def test_ids_that_are_no_text(spark, definition):
    rows = [(1, [0xC3 + 5, 100, 70000, 50256]), (2, None), (3, [])]
    found = {r.doc_id: r.decoded for r in tokens.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), definition).collect()}
    assert found == {1: Tokenizer.from_file(BYTES).decode(rows[0][1], skip_special_tokens=False), 2: "", 3: ""}


def test_packing(spark):
    rows = awkward_rows() + [(900 + k, t) for k, t in enumerate(ODD)] + [(2000, "the of and " * 4000)]
    definition = tokens.tokenizer_json(WORDS)
    library = Tokenizer.from_file(WORDS)
    pieces = packing.pack_documents(documents(spark, rows), definition, window=256, with_ids=True).collect()
    by_doc = Counter()
    for r in pieces:
        assert r.length == len(r.ids) <= 256
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[(r.doc_id, r.doc_tokens)] += r.length
    expected, whole = Counter(), {}
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected[(doc_id, len(ids))] += len(ids)
        whole.setdefault((doc_id, len(ids)), []).append(ids)
    assert by_doc == expected
    for r in pieces:
        assert any(list(r.ids) == ids[r.start : r.start + r.length] for ids in whole[(r.doc_id, r.doc_tokens)])
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert sum(r.length for r in pieces) > 0.95 * 256 * (len(sequences) - 1)


def test_empty_tables(spark, definition):
    empty = documents(spark, [])
    assert tokens.decode(tokens.encode(empty, definition), definition).count() == 0
    assert packing.pack_documents(empty, tokens.tokenizer_json(WORDS)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 128), st.integers(1, 500), max_size=60))
def test_plan_uses_every_piece(histogram):
    planned = packing.plan(histogram, 128)
    used = Counter()
    for pattern, times in planned:
        assert sum(pattern) <= 128 and times > 0
        for length in pattern:
            used[length] += times
    assert used == Counter(histogram)


def test_least_squares():
    r = np.random.default_rng(1)
    for _ in range(20):
        a, b = r.integers(0, 3, (8, 12)).astype(float), r.normal(size=8)
        x = packing.least_squares(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and abs(slope @ x) < 1e-6
