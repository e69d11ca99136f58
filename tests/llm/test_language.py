import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusbench.llm import language, queries
from tests.llm import brute
from tests.llm.fixtures import awkward_rows, documents


def grams_of(text):
    if text is None:
        return Counter()
    spaced = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(spaced.split()) + " " if spaced.split() else ""
    return Counter(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")


def number(gram):
    codes = [0 if c == " " else ord(c) for c in gram]
    value = 0
    for code in codes:
        value = value << 21 | code
    return value | (1 << 62 if codes[0] == 0 else 0)


def ranked(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))[:size]]


def test_profiles_and_predictions(spark):
    rows = [(d, t, "en" if (d or 0) % 2 else "fr", t) for d, t in awkward_rows()]
    rows.append((500, "DÉJÀ vu 1234 İstanbul", None, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    profiles = language.learn_profiles(docs, size=60)
    by_lang = {}
    for _, text, lang, _ in rows:
        if lang is not None:
            by_lang.setdefault(lang, Counter()).update(grams_of(text))
    expected = {lang: ranked(c, 60) for lang, c in by_lang.items()}
    found = {}
    for r in profiles.orderBy("lang", "place").collect():
        found.setdefault(r.lang, []).append(r.gram)
    assert found == {lang: [number(g) for g in grams] for lang, grams in expected.items()}

    answers = []
    for doc_id, text, _, _ in rows:
        own = ranked(grams_of(text), 60)
        if not own:
            answers.append((doc_id, "und", 0.0))
            continue
        away = {
            lang: sum(abs(p.index(g) - k) if g in p else 60 for k, g in enumerate(own)) / (60 * len(own))
            for lang, p in expected.items()
        }
        best = min(sorted(away), key=away.get)
        answers.append((doc_id, best, round(1 - away[best], 9)))
    got = [(r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.predict(docs, profiles, size=60).collect()]
    assert sorted(got, key=brute.sort_key) == sorted(answers, key=brute.sort_key)


def test_empty_tables(spark):
    empty = documents(spark, [])
    profiles = language.learn_profiles(empty)
    assert profiles.count() == 0
    assert language.predict(empty, profiles).count() == 0
    one = language.predict(documents(spark, [(1, "abc")]), profiles).first()
    assert (one.lang_pred, one.score) == ("und", 0.0)


def test_held_out(spark):
    rows = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("h", language.held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


GIVEN = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(GIVEN).exists(), reason="needs the given tables")
def test_held_out_accuracy(spark):
    said = queries.QUERIES["op5_language_id"](spark, GIVEN)
    truth = spark.read.parquet(f"{GIVEN}/documents.parquet").select("doc_id", "lang")
    right = said.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")))
    assert right.first()[0] > 0.97
