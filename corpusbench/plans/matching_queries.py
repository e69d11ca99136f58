"""Similarity joins between catalogs and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbench.functions.text import ascii_tokens
from corpusbench.operators import matching as m
from corpusbench.plans import views as v
from corpusbench.plans.registry import VIEWS, query, spread_table, table

C = F.col

VIEWS["poem_scores"] = f"""
SELECT *, round(least(1.0, 0.70 * title_overlap + 0.25 * author_overlap + 0.05 * CASE WHEN content_kind = 'other' THEN 0.0 ELSE 1.0 END), 6) AS score
FROM (SELECT d.*, coalesce({v.sql_coverage('et', 'ct')}, 0.0) AS title_overlap, coalesce({v.sql_coverage('ea', 'ct')}, 0.0) AS author_overlap
      FROM (SELECT *, {v.sql_poem_tokens('title')} AS ct,
              CASE WHEN title LIKE '%fragmento%' THEN 'fragment' WHEN title LIKE '%Recitaci%' THEN 'recitation' ELSE 'other' END AS content_kind
            FROM candidates) d
      JOIN (SELECT source_key, {v.sql_poem_tokens('title')} AS et, {v.sql_poem_tokens('author')} AS ea FROM catalog) c USING (source_key))
"""
VIEWS["poem_best"] = """
SELECT * FROM poem_scores WHERE score >= 0.5
QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY score DESC, video_id, position) = 1
"""


@query(
    "f9_poem_score",
    "SELECT position, title_overlap, author_overlap, content_kind, score, "
    "'title_overlap=' || format('{:.3f}', title_overlap) AS first_reason FROM poem_scores",
    ("candidates", "catalog", "poem_scores"),
)
def poem_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = m.score_poem_candidates(v.catalog(spark, sf), v.candidates(spark, sf), counted=v.candidate_keys(spark, sf))
    return scored.select(
        "position", "title_overlap", "author_overlap", "content_kind", "score",
        F.get("match_reasons", F.lit(0)).alias("first_reason"),
    )


def _distinct_videos(spark: SparkSession, sf: str) -> DataFrame:
    return m.first_seen(v.candidates(spark, sf))


VIEWS["first_seen"] = """
SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY source_key, video_id ORDER BY query_ord, position) = 1
"""
VIEWS["poem_scores_seen"] = VIEWS["poem_scores"].replace("FROM candidates)", "FROM first_seen)")
VIEWS["poem_best"] = VIEWS["poem_best"].replace("poem_scores", "poem_scores_seen")
_POEM_VIEWS = ("candidates", "catalog", "first_seen", "poem_scores_seen", "poem_best")


@query(
    "j7_match_poems",
    "SELECT source_key, video_id, title, content_kind, score FROM poem_best",
    _POEM_VIEWS,
)
def match_poems(spark: SparkSession, sf: str) -> DataFrame:
    best = m.match_poems(v.catalog(spark, sf), _distinct_videos(spark, sf), counted=v.candidate_keys(spark, sf))
    return best.select("source_key", "video_id", "title", "content_kind", "score")


VIEWS["book_scores"] = f"""
SELECT *, 0.8 * title_coverage + 0.2 * author_coverage AS score
FROM (SELECT d.*, an, coalesce({v.sql_coverage('et', 'ct')}, 0.0) AS title_coverage,
             coalesce({v.sql_coverage('ea', 'ct')}, 0.0) AS author_coverage,
             CASE WHEN len(list_intersect(ct, ['fragmento', 'fragmentos', 'extracto', 'parcial'])) > 0 THEN 'partial' ELSE 'complete' END AS kind
      FROM (SELECT *, {v.sql_ascii_tokens('title')} AS ct FROM first_seen WHERE duration_seconds BETWEEN 30 AND 43200) d
      JOIN (SELECT source_key, {v.sql_ascii_tokens('title')} AS et, {v.sql_ascii_tokens('author')} AS ea,
                   {v.sql_words(v.sql_ascii('author'))}[-1] AS an FROM catalog) c USING (source_key))
WHERE title_coverage >= 0.5 AND (an IS NULL OR list_contains(ct, an) OR author_coverage >= 0.75)
"""
VIEWS["book_best"] = """
SELECT * FROM book_scores QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY score DESC, video_id) = 1
"""
_BOOK_VIEWS = ("candidates", "catalog", "first_seen", "book_scores", "book_best")


@query(
    "f10_book_score",
    "SELECT position, title_coverage, author_coverage, score, kind FROM book_scores",
    _BOOK_VIEWS[:4],
)
def book_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = m.score_book_candidates(v.catalog(spark, sf), v.candidates(spark, sf), counted=v.candidate_keys(spark, sf))
    return scored.select("position", "title_coverage", "author_coverage", "score", "kind")


@query(
    "j8_match_books",
    "SELECT source_key, video_id, query, kind, duration_seconds, score FROM book_best",
    _BOOK_VIEWS,
)
def match_books(spark: SparkSession, sf: str) -> DataFrame:
    best = m.match_books(v.catalog(spark, sf), v.candidates(spark, sf), counted=v.candidate_keys(spark, sf))
    return best.select("source_key", "video_id", "query", "kind", "duration_seconds", "score")


VIEWS["song_scores"] = f"""
SELECT *, CASE WHEN t IS NULL THEN a WHEN a IS NULL THEN t ELSE least(t, a) END AS low,
       CASE WHEN t IS NULL THEN a WHEN a IS NULL THEN t ELSE (t + a) / 2 END AS mean
FROM (SELECT d.*, {v.sql_coverage('et', 'dt')} AS t, {v.sql_coverage('ea', 'da')} AS a
      FROM (SELECT *, {v.sql_ascii_tokens('song_title')} AS dt, {v.sql_ascii_tokens('song_artist')} AS da FROM candidates) d
      JOIN (SELECT source_key, CASE WHEN expected_title IS NULL AND expected_artist IS NULL THEN {v.sql_ascii_tokens('query')}
                     ELSE {v.sql_ascii_tokens("coalesce(expected_title, '')")} END AS et,
                   {v.sql_ascii_tokens("coalesce(expected_artist, '')")} AS ea FROM requests) r USING (source_key))
"""
VIEWS["song_best"] = """
SELECT * FROM song_scores WHERE low >= 0.5
QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY low DESC, mean DESC, position, song_id) = 1
"""
_SONG_VIEWS = ("candidates", "requests", "song_scores", "song_best")


@query("f11_two_dimension_coverage", "SELECT position, low, mean FROM song_scores", _SONG_VIEWS[:3])
def song_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = m.score_song_candidates(v.requests(spark, sf), v.song_results(spark, sf), counted=v.candidate_keys(spark, sf))
    return scored.select("position", "low", "mean")


@query("j9_match_songs", "SELECT source_key, song_id, position, low, mean FROM song_best", _SONG_VIEWS)
def match_songs(spark: SparkSession, sf: str) -> DataFrame:
    best = m.match_songs(v.requests(spark, sf), v.song_results(spark, sf), counted=v.candidate_keys(spark, sf))
    return best.select("source_key", "song_id", "position", "low", "mean")


VIEWS["video_best"] = f"""
SELECT source_key, video_id, title, CAST(round_even(duration_seconds, 0) AS BIGINT) AS duration_seconds, (t + a) / 2 AS confidence
FROM (SELECT d.*, {v.sql_coverage('et', 'ct')} AS t, {v.sql_coverage('ea', 'ct')} AS a
      FROM (SELECT *, {v.sql_ascii_tokens('title')} AS ct FROM first_seen) d
      JOIN (SELECT source_key, {v.sql_ascii_tokens('title')} AS et, {v.sql_ascii_tokens('author')} AS ea FROM catalog) c USING (source_key))
WHERE least(t, a) >= 0.5
QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY least(t, a) DESC, (t + a) / 2 DESC, video_id) = 1
"""


@query(
    "j10_match_music_videos",
    "SELECT * FROM video_best",
    ("candidates", "catalog", "first_seen", "video_best"),
)
def match_videos(spark: SparkSession, sf: str) -> DataFrame:
    songs = v.catalog(spark, sf).withColumnRenamed("author", "artist")
    best = m.match_music_videos(songs, _distinct_videos(spark, sf), counted=v.candidate_keys(spark, sf))
    return best.select("source_key", "video_id", "title", "duration_seconds", "confidence")


@query(
    "j11_open_catalog",
    f"""
WITH titles AS (SELECT item_id AS source_key, {v.sql_ascii_tokens('text')} AS e FROM benchmark),
     bags AS (SELECT doc_id AS candidate_key, {v.sql_ascii_tokens('text')} AS a FROM documents),
     shared AS (SELECT source_key, candidate_key, count(*) AS shared
                FROM (SELECT source_key, unnest(e) AS token FROM titles) JOIN (SELECT candidate_key, unnest(a) AS token FROM bags) USING (token)
                GROUP BY ALL)
SELECT source_key, candidate_key, shared, len(e) AS expected_tokens, shared::DOUBLE / len(e) AS title_coverage
FROM shared JOIN titles USING (source_key) WHERE shared::DOUBLE / len(e) >= 0.5
""",
)
def open_catalog(spark: SparkSession, sf: str) -> DataFrame:
    titles = table(spark, sf, "benchmark").select(C("item_id").alias("source_key"), C("text").alias("title"))
    bodies = spread_table(spark, sf, "documents", "doc_id", "text").select(C("doc_id").alias("candidate_key"), C("text").alias("title"))
    return m.open_catalog_pairs(titles, bodies)


# --- outcomes -------------------------------------------------------------------------------------


def _failures(spark: SparkSession, sf: str) -> DataFrame:
    """Searches that failed: parts whose type is LARGE and size above 40."""
    return (
        table(spark, sf, "part")
        .where("p_type = 'LARGE' AND p_size > 40")
        .select(
            C("p_partkey").alias("source_key"),
            F.lit("SearchError").alias("error_type"),
            F.concat(F.lit("search failed for "), "p_name").alias("error_message"),
            (C("p_size") > 45).alias("retryable"),
        )
    )


VIEWS["failures"] = """
SELECT p_partkey AS source_key, 'SearchError' AS error_type, 'search failed for ' || p_name AS error_message, p_size > 45 AS retryable
FROM part WHERE p_type = 'LARGE' AND p_size > 40
"""


@query(
    "f21_poem_outcomes",
    """
SELECT c.source_key, CASE WHEN error_type IS NOT NULL THEN 'error' WHEN video_id IS NULL THEN 'not_found' WHEN content_kind = 'fragment' THEN 'partial' ELSE 'found' END AS status,
       CASE WHEN error_type IS NULL THEN video_id END AS video_id, CASE WHEN error_type IS NULL THEN score END AS match_score, error_message, retryable AS error_retryable
FROM catalog c LEFT JOIN poem_best USING (source_key) LEFT JOIN failures USING (source_key)
""",
    (*_POEM_VIEWS, "failures"),
)
def poem_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    sources = v.catalog(spark, sf)
    failures = _failures(spark, sf).withColumnRenamed("retryable", "error_retryable")
    outcomes = m.poem_outcomes(sources, m.match_poems(sources, _distinct_videos(spark, sf), counted=v.candidate_keys(spark, sf)), failures)
    return outcomes.select("source_key", "status", "video_id", "match_score", "error_message", "error_retryable")


@query(
    "f21_book_outcomes",
    """
SELECT c.source_key, CASE WHEN error_type IS NOT NULL THEN 'error' WHEN video_id IS NULL THEN 'not_found' WHEN kind = 'partial' THEN 'partial' ELSE 'found' END AS status,
       CASE WHEN error_type IS NULL THEN video_id END AS video_id, CASE WHEN error_type IS NULL THEN query END AS query, error_message, retryable
FROM catalog c LEFT JOIN book_best USING (source_key) LEFT JOIN failures USING (source_key)
""",
    (*_BOOK_VIEWS, "failures"),
)
def book_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    seeds = v.catalog(spark, sf)
    outcomes = m.book_outcomes(seeds, m.match_books(seeds, v.candidates(spark, sf), counted=v.candidate_keys(spark, sf)), _failures(spark, sf))
    return outcomes.select("source_key", "status", "video_id", "query", "error_message", "retryable")


@query(
    "f21_lyrics_outcomes",
    """
SELECT r.source_key,
  CASE WHEN error_type IS NOT NULL THEN 'error' WHEN song_id IS NULL THEN 'not_found' WHEN has_text AND video_id IS NOT NULL THEN 'complete' ELSE 'partial' END AS status,
  CASE WHEN error_type IS NULL THEN song_id END AS song_id,
  CASE WHEN error_type IS NULL AND song_id IS NOT NULL THEN video_id END AS video_id,
  CASE WHEN error_type IS NOT NULL THEN 'search:blocked' WHEN song_id IS NULL THEN ''
       ELSE concat_ws(',', CASE WHEN NOT has_text THEN 'lyrics:not_found' END, CASE WHEN video_id IS NULL THEN 'video:not_found' END) END AS issue_codes
FROM requests r LEFT JOIN (SELECT source_key, song_id FROM song_best) USING (source_key)
  LEFT JOIN failures USING (source_key)
  LEFT JOIN (SELECT source_key, video_id FROM video_best) USING (source_key)
  LEFT JOIN (SELECT p_partkey AS source_key, p_size > 10 AS has_text FROM part) USING (source_key)
""",
    ("candidates", "catalog", "first_seen", "requests", "song_scores", "song_best", "video_best", "failures"),
)
def lyrics_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    wanted = v.requests(spark, sf)
    songs = m.match_songs(wanted, v.song_results(spark, sf), counted=v.candidate_keys(spark, sf))
    catalog = v.catalog(spark, sf).withColumnRenamed("author", "artist")
    nothing = F.lit(None).cast("string")
    videos = m.match_music_videos(catalog, _distinct_videos(spark, sf), counted=v.candidate_keys(spark, sf)).select(
        "source_key", "video_id", nothing.alias("video_code"), nothing.alias("video_message"),
        F.lit(None).cast("boolean").alias("video_retryable"),
    )
    lyrics = table(spark, sf, "part").select(
        C("p_partkey").alias("source_key"),
        F.when(C("p_size") > 10, C("p_name")).otherwise(" ").alias("lyrics"),
        nothing.alias("lyrics_code"), nothing.alias("lyrics_message"),
        F.lit(None).cast("boolean").alias("lyrics_retryable"),
    )
    failures = _failures(spark, sf).select(
        "source_key", F.lit("search").alias("stage"), F.lit("blocked").alias("code"),
        C("error_message").alias("message"), "retryable",
    )
    outcomes = m.lyrics_outcomes(wanted, songs, failures, lyrics, videos)
    codes = F.transform("issues", lambda e: F.concat_ws(":", e["stage"], e["code"]))
    return outcomes.select("source_key", "status", "song_id", "video_id", F.array_join(codes, ",").alias("issue_codes"))


@query(
    "j15_checked_details",
    """
SELECT source_key, song_id, CASE WHEN p_size > 45 THEN 'invalid_response' WHEN p_size > 40 THEN 'identity_mismatch' END AS error_code,
       CASE WHEN p_size > 40 THEN false END AS error_retryable
FROM song_best JOIN part ON p_partkey = source_key
""",
    _SONG_VIEWS,
)
def checked_details(spark: SparkSession, sf: str) -> DataFrame:
    """Details come back without an id for parts above size 45 and with another id above 40."""
    matches = m.match_songs(v.requests(spark, sf), v.song_results(spark, sf), counted=v.candidate_keys(spark, sf))
    sizes = table(spark, sf, "part").select(C("p_partkey").alias("source_key"), "p_size")
    details = matches.select("source_key", C("song_id").alias("_id")).join(sizes, "source_key").select(
        "source_key",
        F.when(C("p_size") > 45, None).when(C("p_size") > 40, F.concat(F.lit("9"), "_id")).otherwise(C("_id")).alias("returned_id"),
    )
    return m.checked_details(matches, details).select("source_key", "song_id", "error_code", "error_retryable")


@query("f11_unscorable_requests", "SELECT p_partkey AS source_key, 'tokens' AS rule FROM part WHERE p_size > 45")
def unscorable(spark: SparkSession, sf: str) -> DataFrame:
    """Parts above size 45 ask with punctuation only."""
    nothing = F.lit(None).cast("string")
    asked = table(spark, sf, "part").select(
        C("p_partkey").alias("source_key"),
        F.when(C("p_size") > 45, "¿...?").otherwise(C("p_name")).alias("query"),
        nothing.alias("expected_title"),
        nothing.alias("expected_artist"),
    )
    return m.unscorable_requests(asked).select("source_key", "rule")


# --- windows, limits and token sets ---------------------------------------------------------------


@query(
    "w1_best_per_source",
    "SELECT source_key, video_id, score FROM book_best",
    _BOOK_VIEWS,
)
def best_per_source(spark: SparkSession, sf: str) -> DataFrame:
    scored = m.score_book_candidates(v.catalog(spark, sf), v.candidates(spark, sf), counted=v.candidate_keys(spark, sf))
    best = m.top_one(scored, ["source_key"], [C("score").desc(), C("video_id")])
    return best.select("source_key", "video_id", "score")


@query(
    "w3_first_seen",
    "SELECT source_key, video_id, query, position FROM first_seen",
    ("candidates", "first_seen"),
)
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return _distinct_videos(spark, sf).select("source_key", "video_id", "query", "position")


@query(
    "p15_duration_window",
    "SELECT position, duration_seconds FROM candidates WHERE duration_seconds BETWEEN 30 AND 43200",
    ("candidates",),
)
def duration_window(spark: SparkSession, sf: str) -> DataFrame:
    return m.within_duration(v.candidates(spark, sf)).select("position", "duration_seconds")


@query(
    "o2_top_one_per_key",
    """
SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1
""",
)
def top_one(spark: SparkSession, sf: str) -> DataFrame:
    order = [C("l_extendedprice").desc(), C("l_orderkey"), C("l_linenumber")]
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return m.top_one(lines, ["l_partkey"], order)


@query(
    "o4_results_per_query",
    """
SELECT source_key, query_ord, position, video_id FROM candidates
QUALIFY row_number() OVER (PARTITION BY source_key, query_ord ORDER BY position, video_id) <= 5
""",
    ("candidates",),
)
def results_per_query(spark: SparkSession, sf: str) -> DataFrame:
    capped = m.cap_results(v.candidates(spark, sf), 5)
    return capped.select("source_key", "query_ord", "position", "video_id")


_SETS_SQL = f"""
SELECT source_key, position, len(list_intersect(e, a)) AS shared,
       len(list_intersect(a, ['fragmento', 'fragmentos', 'extracto', 'parcial'])) > 0 AS partial
FROM (SELECT position, source_key, {v.sql_ascii_tokens('title')} AS a FROM candidates)
JOIN (SELECT source_key, {v.sql_ascii_tokens('title')} AS e FROM catalog) USING (source_key)
"""


@query("u1_u2_token_sets", _SETS_SQL, ("candidates", "catalog"))
def token_sets(spark: SparkSession, sf: str) -> DataFrame:
    expected = v.catalog(spark, sf).select("source_key", ascii_tokens(C("title")).alias("e"))
    actual = v.candidates(spark, sf).select("source_key", "position", "video_id", ascii_tokens(C("title")).alias("a"))
    pairs = m.spread_join(actual, expected, ["source_key"], "position", salts=None, counted=v.candidate_keys(spark, sf))
    markers = F.array(*[F.lit(w) for w in m.PARTIAL_MARKERS])
    return pairs.select(
        "source_key", "position", m.overlap(C("e"), C("a")).alias("shared"),
        F.arrays_overlap("a", markers).alias("partial"),
    )
