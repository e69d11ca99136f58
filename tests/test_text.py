import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusbench.functions import classify, text, urls

C = F.col


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_scoring_form_keeps_accents(spark):
    raw = "ÁRBOL, NIÑA... ¿QUÉ tal? pingüino 42"
    assert one(spark, text.normalize_text(C("t")), t=raw) == "árbol niña qué tal pingüino 42"
    assert one(spark, F.array_join(text.character_tokens(C("t")), ""), t="¡Qué, sí!") == "quésí"
    assert one(spark, text.word_tokens(C("t")), t=" ... ") == []


def test_book_ids(spark):
    book = text.stable_book_id(C("t"), C("a"))
    assert one(spark, book, t="Over", a="Ramón Marrero Aristy") == "book_3d87604d9d498d6b95859426"
    composed = unicodedata.normalize("NFC", "José")
    decomposed = unicodedata.normalize("NFD", "José")
    assert one(spark, book, t="  ÁRBOL   de fuego ", a=composed) == one(
        spark, book, t="árbol de fuego", a=decomposed
    )


def test_source_ids(spark):
    source = text.derive_source_id(C("t"), C("a"))
    assert one(spark, source, t="Hay un país en el mundo", a="Pedro Mir") == "poem-820d543f0af96fbae4a9"
    assert one(spark, source, t="  AMÉN de mariposas", a="x") == one(spark, source, t="amen   DE mariposas", a="x")


def test_normalizers_equal_the_unicode_rules(spark):
    """Every code point up to the supplementary planes, alone among letters."""
    rows = [(f"{chr(c)}a{chr(c)}B",) for c in range(1, 0x20000, 3) if not 0xD800 <= c <= 0xDFFF]
    rows += [("ﬁn Straße ½ … ØRE ⅷ x́y",), ("¨a\xa0b c",)]
    frame = spark.createDataFrame(rows, "t string").repartition(8)
    found = frame.select(
        "t",
        text.normalized_identity(C("t")).alias("catalog"),
        text.ascii_words(C("t")).alias("matching"),
        text.book_identity(C("t")).alias("book"),
    ).collect()
    for row in found:
        parts = unicodedata.normalize("NFKD", row.t)
        bare = "".join(c for c in parts if not unicodedata.combining(c)).casefold()
        assert row.catalog == " ".join(re.findall("[a-z0-9]+", bare))
        assert row.matching == re.findall("[a-z0-9]+", parts.encode("ascii", "ignore").decode().casefold())
        assert row.book == " ".join(unicodedata.normalize("NFKC", row.t).casefold().split())


def test_poem_tokens(spark):
    assert sorted(one(spark, text.poem_tokens(C("t")), t="El río y la Ñ de un País país")) == ["pais", "rio"]


def test_paths(spark):
    assert one(spark, text.sample_id_from_path(C("t")), t="album/song.take.wav") == "album__song.take"
    assert one(spark, text.sample_id_from_path(C("t")), t="a/.wav") == "a__.wav"


@pytest.mark.parametrize(
    "url, book, poem",
    [
        ("https://youtu.be/abc?t=1", "abc", "abc"),
        ("https://www.youtube.com/watch?v=abc&x=1", "abc", "abc"),
        ("https://youtube.com/shorts/abc/x", "abc", None),
        ("https://m.youtube.com/embed?v=abc", None, "abc"),
        ("http://www.youtube.com/watch?v=abc", "abc", None),
        ("https://www.youtube.com/watch?v=", None, None),
        ("https://example.com/watch?v=abc", None, None),
    ],
)
def test_video_ids(spark, url, book, poem):
    assert one(spark, urls.book_video_id(C("u")), u=url) == book
    assert one(spark, urls.poem_video_id(C("u")), u=url) == poem


@pytest.mark.parametrize(
    "url, good",
    [
        ("https://genius.com/x", True),
        ("https://www.genius.com:443/x", True),
        ("http://genius.com/x", False),
        ("https://localhost/x", False),
        ("https://169.254.169.254/x", False),
        ("https://genius.com.evil.test/x", False),
        ("https://user@genius.com/x", False),
        ("https://genius.com:8443/x", False),
    ],
)
def test_lyrics_urls(spark, url, good):
    assert one(spark, urls.is_canonical_lyrics_url(C("u")), u=url) is good


@pytest.mark.parametrize(
    "shown, seconds", [("03:05", 185.0), ("2:03:04", 7384.0), ("PT3M5S", None), ("2:61:00", None), ("0:00", None), ("75:10", 4510.0)]
)
def test_display_durations(spark, shown, seconds):
    assert one(spark, classify.display_duration(C("d")), d=shown) == seconds


@pytest.mark.parametrize(
    "title, kind",
    [
        ("Recitación - fragmento del poema", "fragment"),
        ("Declamación", "recitation"),
        ("Obra de TEATRO", "dramatization"),
        ("Audio Poesía", "audio_poetry"),
        ("Canción", "other"),
    ],
)
def test_content_kinds(spark, title, kind):
    assert one(spark, classify.content_kind(C("t")), t=title) == kind


@pytest.mark.parametrize(
    "status, expected", [(401, ("authentication", False)), (429, ("rate_limit", True)), (503, ("http_error", True)), (404, ("http_error", False)), (204, None)]
)
def test_http_failures(spark, status, expected):
    found = spark.range(1).select(classify.http_failure(F.lit(status)).alias("f")).first().f
    assert (tuple(found) if found else None) == expected


def test_fingerprint_is_canonical_json(spark):
    import hashlib
    import json

    plan = {"device": "cuda", "name": "ñandú 𝔸 \\u00E9 \"x\"", "timeout": 1800.0, "verify": True}
    payload = json.dumps(plan, ensure_ascii=True, sort_keys=True, separators=(",", ":"))
    from corpusbench.operators.suite import plan_fingerprint

    column = plan_fingerprint(**{k: F.lit(v) for k, v in plan.items()})
    assert spark.range(1).select(column).first()[0] == hashlib.sha256(payload.encode()).hexdigest()
