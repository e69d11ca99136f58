import random

import pytest

from corpusbench.llm import superkmers, windows
from tests.llm import brute
from tests.llm.fixtures import awkward_rows, documents, swapped_words, text


@pytest.mark.parametrize("window, gram, crowd", [(35, 8, 1000), (6, 3, 1000), (35, 8, 1), (6, 3, 3)])
def test_repeated_words(spark, monkeypatch, window, gram, crowd):
    monkeypatch.setattr(windows, "CROWD", crowd)
    rows = awkward_rows()
    got = superkmers.repeated_words(documents(spark, rows).repartition(5), window, gram)
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()]
    assert sorted(found, key=brute.sort_key) == sorted(brute.repeated_words(rows, window), key=brute.sort_key)
    assert any(row[2] for row in found) and any(row[1] and not row[2] for row in found)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(windows, "POSITIONS", 64)
    rows = awkward_rows(5)
    got = superkmers.repeated_words(documents(spark, rows), 6, 3)
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()]
    assert sorted(found, key=brute.sort_key) == sorted(brute.repeated_words(rows, 6), key=brute.sort_key)


def test_empty_table(spark):
    assert superkmers.repeated_words(documents(spark, [])).count() == 0


def test_many_repeated_rows(spark):
    r = random.Random(6)
    whole, part = text(r, 700), text(r, 90)
    rows = [(None, whole)] * 2000 + [(4, whole)] * 300 + [(5, f"{text(r, 50)} {' '.join(whole.split()[100:160])} {part}")]
    rows += [(6, f"{part} {text(r, 20)}"), (None, text(r, 60)), (None, text(r, 60)), (7, "few words")] + [(8, "few words")] * 40
    got = superkmers.repeated_words(documents(spark, rows).repartition(6)).collect()
    found = [(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got]
    assert sorted(found, key=brute.sort_key) == sorted(brute.repeated_words(rows, 35), key=brute.sort_key)


def test_words_made_to_collide(spark):
    one, other = swapped_words()
    tail = text(random.Random(3), 34)
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"{one} {tail} x")]
    found = {x.doc_id: x.n_removed for x in superkmers.repeated_words(documents(spark, rows)).collect()}
    assert found == {1: 35, 2: 0, 3: 35}
