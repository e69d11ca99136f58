"""Plain definitions of the operators' results, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def repeated_words(rows, window):
    lists = [words_of(text) for _, text in rows]
    counts = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), words in zip(rows, lists, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if counts[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repeated_bytes(rows, window):
    first = {}
    data = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    for doc_id, raw in data:
        order = float("inf") if doc_id is None else doc_id
        for i in range(len(raw) - window + 1):
            first[raw[i : i + window]] = min(first.get(raw[i : i + window], float("inf")), order)
    out = []
    for doc_id, raw in data:
        order = float("inf") if doc_id is None else doc_id
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if first[raw[i : i + window]] < order:
                gone[i : i + window] = b"\1" * window
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def sort_key(row):
    return tuple((v is None, str(v)) for v in row)
