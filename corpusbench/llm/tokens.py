"""Byte-pair encoding and decoding with a public tokenizer, by fragments between certain cuts."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbench.llm.common import GAPS, ranges_of, text_blocks, without_nulls

_BLOCK = 4 << 20
_SLICE, _KNOWN = 2_000, 1_000_000
_WORD = "[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+"  # letters that lower-casing and composing keep single
_CODES = np.arange(256)
_LETTERS = ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122))
_PUNCTUATION = (_CODES > 32) & (_CODES < 127) & ~_LETTERS & ~((_CODES >= 48) & (_CODES <= 57)) & (_CODES != 39)


def tokenizer_json(path: str | Path) -> str:
    """The tokenizer's file as text; it travels with the tasks, so executors need no copy of it."""
    return Path(path).read_text(encoding="utf-8")


def byte_table() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def token_bytes(definition: dict) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; added tokens stand for their own text."""
    table = byte_table()
    vocabulary = definition["model"]["vocab"]
    added = {t["id"]: t["content"].encode() for t in definition["added_tokens"]}
    out = [b""] * (max([*vocabulary.values(), *added]) + 1)
    for token, number in vocabulary.items():
        out[number] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    for number, content in added.items():
        out[number] = content
    return out


def pairs_inside(tokens: list[bytes]) -> np.ndarray:
    """For each two bytes (first * 256 + second) whether they stand side by side inside any token."""
    inside = np.zeros(1 << 16, bool)
    for token in tokens:
        codes = np.frombuffer(token, np.uint8).astype(np.int64)
        inside[codes[:-1] * 256 + codes[1:]] = True
    return inside


def forced_cuts(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Places where no token can reach across and the pre-tokenizer cuts too, with the texts' own bounds.

    Bytes that never stand side by side inside a token can't be merged across.  The pre-tokenizer
    looks at characters, so only two kinds of those places are taken: between a character that is no
    white space and ASCII white space, and between an ASCII letter and ASCII punctuation other than
    the apostrophe.  None of its patterns crosses them, and those behind the cut look only forward.
    Characters of three or more bytes, and those of lead byte C2, may be white space and are left alone.
    """
    if len(raw) < 2:
        return np.unique(offsets)
    left, right = raw[:-1], raw[1:]
    space = (right == 32) | ((right >= 9) & (right <= 13))
    solid = ((left > 32) & (left < 127)) | ((left >= 0x80) & (left < 0xC0))
    at = np.flatnonzero(space & solid)
    lead = raw[np.maximum(at - 1, 0)]
    certain = (raw[at] < 0x80) | ((lead >= 0xC3) & (lead <= 0xDF))
    at = np.concatenate([at[certain], np.flatnonzero(_LETTERS[left] & _PUNCTUATION[right])])
    at = at[~inside[raw[at].astype(np.int64) * 256 + raw[at + 1]]] + 1
    return _places(len(raw), at, offsets)


def white_space_cuts(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The same for vocabularies that drop white space and never join letters to punctuation.

    ``inside`` has the byte pairs of the added tokens, which are found before anything is cut.
    """
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    at = np.flatnonzero((gap[1:] & ~gap[:-1]) | (_LETTERS[raw[:-1]] & _PUNCTUATION[raw[1:]]))
    at = at[~inside[raw[at].astype(np.int64) * 256 + raw[at + 1]]] + 1
    return _places(len(raw), at, offsets)


def _places(size: int, *places: np.ndarray) -> np.ndarray:
    marked = np.zeros(size + 1, bool)
    for at in places:
        marked[at] = True
    return np.flatnonzero(marked)


class FragmentEncoder:
    """Encodes each distinct fragment once, keeps up to ``_KNOWN`` of them, and puts the ids together again.

    Fragments that are one plain word are encoded many at a time, as one text.  Each is a pre-token of
    its own there, so its ids end where its bytes do or, in a vocabulary that marks word ends, at the
    next mark.  Where the marks don't add up, and for all other fragments, each is encoded alone.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.loads(definition)["model"]
        mark = model.get("end_of_word_suffix")
        self.plain = re.compile(f"{'' if mark else ' '}{_WORD}").fullmatch
        size = self.tokenizer.get_vocab_size()
        self.marks, self.sizes = np.zeros(size, bool), np.zeros(size, np.int64)
        for token, number in model["vocab"].items():
            self.marks[number] = bool(mark) and token.endswith(mark)
            self.sizes[number] = len(token)  # one symbol stands for one byte
        self.marked = bool(mark)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.flat = array("q", [0]), array("I")

    def _numbers(self, fragments: list[str]) -> np.ndarray:
        """The number under which each fragment's ids are kept."""
        if len(self.known) > _KNOWN:
            self._forget()
        known = self.known
        new = [f for f in fragments if f not in known]
        words, others = [], []
        for f in new:
            (words if self.plain(f.lstrip(GAPS) if self.marked else f) else others).append(f)
        for low in range(0, len(words), _SLICE):
            part = words[low : low + _SLICE]
            (encoded,) = self.tokenizer.encode_batch_fast([self._text(part)], add_special_tokens=False)
            ids = np.array(encoded.ids, np.int64)
            ends = self._ends(part, ids)
            if ends is None:
                others += part
                continue
            known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
            self.starts.extend((len(self.flat) + ends).tolist())
            self.flat.extend(ids.tolist())
        for low in range(0, len(others), _SLICE):
            part = others[low : low + _SLICE]
            for fragment, encoded in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[fragment] = len(known)
                self.flat.extend(encoded.ids)
                self.starts.append(len(self.flat))
        return np.array([*map(known.__getitem__, fragments)], np.int64)

    def _text(self, words: list[str]) -> str:
        return " ".join([w.lstrip(GAPS) for w in words]) if self.marked else "".join(words)

    def _ends(self, words: list[str], ids: np.ndarray) -> np.ndarray | None:
        """The number of ids up to the end of each word, or nothing if the ids don't add up."""
        if self.marked:
            ends = np.flatnonzero(self.marks[ids]) + 1
            return ends if len(ends) == len(words) and ends[-1] == len(ids) else None
        wanted = np.cumsum([len(w.encode()) for w in words])
        reached = np.cumsum(self.sizes[ids])
        at = np.minimum(np.searchsorted(reached, wanted), len(ids) - 1)
        return at + 1 if (reached[at] == wanted).all() and at[-1] == len(ids) - 1 else None

    def encode(self, raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the fragments between the cuts, and the number of ids before each cut."""
        if len(cuts) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(cuts), np.int64)
        texts = pa.Array.from_buffers(
            pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)]
        ).dictionary_encode()
        which = self._numbers(texts.dictionary.to_pylist())[texts.indices.to_numpy()]
        starts = np.array(self.starts, np.int64)
        counts = starts[which + 1] - starts[which]
        ids = np.array(self.flat, np.uint32)[ranges_of(starts[which], counts)]
        return ids, np.concatenate([[0], np.cumsum(counts)])


def encode(
    documents: DataFrame, definition: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token ids of every whole text under a byte-level vocabulary: doc_id, ids array<int>.

    The ids are those of the tokenizers library without added special tokens, truncation or padding.
    A null text counts as empty and has no ids; null ids and repeated rows are kept as they are.
    """
    chosen = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(lambda it: _encode(it, definition), f"doc_id {kind}, ids array<int>")


def _encode(batches: Iterator[pa.RecordBatch], definition: str) -> Iterator[pa.RecordBatch]:
    encoder = FragmentEncoder(definition)
    inside = pairs_inside(token_bytes(json.loads(definition)))
    for batch in batches:
        names = batch.column(0)
        for first, raw, offsets in text_blocks(without_nulls(batch, "text"), _BLOCK):
            cuts = forced_cuts(raw, offsets, inside)
            ids, before = encoder.encode(raw, cuts)
            places = before[np.searchsorted(cuts, offsets)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(places), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([names.slice(first, len(lists)), lists], ["doc_id", "ids"])


def decode(encoded: DataFrame, definition: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of token ids: doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded.

    Bytes that form no character become the replacement character, and unknown ids nothing, as in
    the library's own decoding; null ids count as none.
    """
    chosen = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(
        lambda it: _decode(it, definition), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded string"
    )


def _decode(batches: Iterator[pa.RecordBatch], definition: str) -> Iterator[pa.RecordBatch]:
    tokens = [*token_bytes(json.loads(definition)), b""]
    blob = np.frombuffer(b"".join(tokens), np.uint8)
    sizes = np.array([len(t) for t in tokens], np.int64)
    starts = np.cumsum(sizes) - sizes
    for batch in batches:
        for low in range(0, batch.num_rows, 1000):
            part = batch.slice(low, 1000)
            lists = part.column(1)
            counts = lists.value_lengths().fill_null(0).to_numpy()
            ids = lists.flatten().to_numpy().astype(np.uint32)
            known = np.minimum(ids, np.uint32(len(tokens) - 1))
            data = blob[ranges_of(starts[known], sizes[known])].tobytes()
            ends = np.concatenate([[0], np.cumsum(sizes[known])])[np.cumsum(counts)]
            begins = np.concatenate([[0], ends[:-1]])
            packed, bounds = ids.astype("<u4").tobytes(), np.concatenate([[0], 4 * np.cumsum(counts)])
            hashes = [hashlib.sha256(packed[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(begins, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts.astype(np.int64)), pa.array(hashes, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded"],
            )
