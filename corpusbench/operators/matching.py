"""Catalog entries x search candidates: token-coverage scores and the deterministic best match.

Tokens are computed once per catalog entry and once per candidate, before they meet.  Joins on the
catalog key spread hot keys (see ``operators.spread``); ``counted`` may name rows with a source_key that
are cheaper to count than the candidates, such as the rows they were made from.  Every top-1 is a
``row_number() <= 1`` window, which Spark turns into a per-task limit before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusbench.functions.classify import PARTIAL_MARKERS, kind_of_form
from corpusbench.functions.text import ascii_tokens, ascii_words, normalized_identity, poem_tokens, poem_words
from corpusbench.operators.spread import (
    DEFAULT_SALTS, compute_partitions, spread_join,
)
from corpusbench.session import written_once

C = F.col

# Limits of a search and of an audiobook's duration in seconds.
RESULTS_PER_QUERY = range(1, 51)
MINIMUM_DURATION, MAXIMUM_DURATION = 30.0, 43_200.0
# Bytes of all titles' tokens up to which an open catalog is sent to every task, and what each takes besides its letters.
_SMALL_CATALOG, _TOKEN_BYTES = 1 << 24, 16


def overlap(expected: Column, actual: Column) -> Column:
    """How many tokens two token sets share."""
    return F.size(F.array_intersect(expected, actual))


def coverage(expected: Column, actual: Column) -> Column:
    """Share of the expected tokens found; NULL when nothing is expected."""
    return F.try_divide(overlap(expected, actual).cast("double"), F.size(expected).cast("double"))


def top_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key under a total order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key, with their 1-based rank."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(C("rank") <= k)


def cap_results(candidates: DataFrame, results_per_query: int) -> DataFrame:
    """The page size of a search: the first results of each query by position."""
    if results_per_query not in RESULTS_PER_QUERY:
        raise ValueError("a page of results holds 1 to 50 of them")
    order = [C("position"), C("video_id")]
    return top_k(candidates, ["source_key", "query_ord"], order, results_per_query).drop("rank")


def first_seen(candidates: DataFrame) -> DataFrame:
    """One row per video of a source: the first by query, then by position."""
    return top_one(candidates, ["source_key", "video_id"], [C("query_ord"), C("position")])


def within_duration(
    candidates: DataFrame,
    minimum: float = MINIMUM_DURATION,
    maximum: float = MAXIMUM_DURATION,
    column: str = "duration_seconds",
) -> DataFrame:
    """Candidates of a plausible length, bounds included."""
    if minimum <= 0 or maximum <= minimum:
        raise ValueError("duration bounds are invalid")
    return candidates.where(C(column).between(minimum, maximum))


def _unit(value: float, name: str, *, zero: bool = True) -> None:
    if not (0 <= value <= 1 if zero else 0 < value <= 1):
        raise ValueError(f"{name} must be between zero and one")


# --- poems ----------------------------------------------------------------------------------------


def score_poem_candidates(
    sources: DataFrame,
    candidates: DataFrame,
    *,
    salts: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Every candidate of every source with its kind, score and reasons.

    ``sources``: source_key, title, author.  ``candidates``: source_key, video_id, title.
    """
    keyed = sources.select(
        "source_key",
        poem_tokens(C("title")).alias("_title"),
        poem_tokens(C("author")).alias("_author"),
    )
    formed = candidates.withColumn("_form", normalized_identity(C("title")))
    tokenized = formed.withColumns(
        {"_tokens": poem_words(C("_form")), "content_kind": kind_of_form(C("_form"))}
    ).drop("_form")
    pairs = spread_join(tokenized, keyed, ["source_key"], "video_id", salts=salts, counted=counted)
    zero = F.lit(0.0)
    pairs = pairs.withColumns(
        {
            "title_overlap": F.coalesce(coverage(C("_title"), C("_tokens")), zero),
            "author_overlap": F.coalesce(coverage(C("_author"), C("_tokens")), zero),
        }
    )
    kind_signal = F.when(C("content_kind") == "other", 0.0).otherwise(1.0)
    total = 0.70 * C("title_overlap") + 0.25 * C("author_overlap") + 0.05 * kind_signal
    reasons = F.array(
        F.format_string("title_overlap=%.3f", F.bround("title_overlap", 3)),
        F.format_string("author_overlap=%.3f", F.bround("author_overlap", 3)),
        F.concat(F.lit("content_kind="), C("content_kind")),
    )
    return pairs.withColumns(
        {"score": F.round(F.least(F.lit(1.0), total), 6), "match_reasons": reasons}
    ).drop("_title", "_author", "_tokens")


def match_poems(
    sources: DataFrame,
    candidates: DataFrame,
    *,
    minimum_score: float = 0.5,
    salts: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Best candidate per source at or above the threshold: (score desc, video_id)."""
    _unit(minimum_score, "minimum_score")
    scored = score_poem_candidates(sources, candidates, salts=salts, counted=counted)
    eligible = scored.where(C("score") >= minimum_score)
    return top_one(eligible, ["source_key"], [C("score").desc(), C("video_id")])


def poem_outcomes(sources: DataFrame, matches: DataFrame, failures: DataFrame) -> DataFrame:
    """Status per source from matches and provider failures (source_key, error_type, error_message,
    error_retryable); a failure wins over a match."""
    matched = matches.select(
        "source_key", "video_id", "content_kind", C("score").alias("match_score"), "match_reasons"
    )
    joined = sources.join(matched, "source_key", "left").join(failures, "source_key", "left")
    failed = C("error_type").isNotNull()
    status = (
        F.when(failed, "error")
        .when(C("video_id").isNull(), "not_found")
        .when(C("content_kind") == "fragment", "partial")
        .otherwise("found")
    )
    result = joined.withColumn("status", status)
    payload = ("video_id", "content_kind", "match_score", "match_reasons")
    return result.withColumns({c: F.when(~failed, C(c)) for c in payload})


# --- books ----------------------------------------------------------------------------------------


def score_book_candidates(
    seeds: DataFrame,
    candidates: DataFrame,
    *,
    minimum_duration: float = MINIMUM_DURATION,
    maximum_duration: float = MAXIMUM_DURATION,
    minimum_title_coverage: float = 0.5,
    salts: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Candidates that pass the duration, title and author rules, with their score and kind.

    The first sighting of a video keeps its query; that choice is made before any filter.
    """
    _unit(minimum_title_coverage, "minimum_title_coverage")
    author = ascii_words(C("author"))
    keyed = seeds.select(
        "source_key",
        ascii_tokens(C("title")).alias("_title"),
        F.array_distinct(author).alias("_author"),
        F.try_element_at(author, F.lit(-1)).alias("_anchor"),
    )
    seen = within_duration(first_seen(candidates), minimum_duration, maximum_duration)
    tokenized = seen.withColumn("_tokens", ascii_tokens(C("title")))
    pairs = spread_join(tokenized, keyed, ["source_key"], "video_id", salts=salts, counted=counted)
    zero = F.lit(0.0)
    pairs = pairs.withColumns(
        {
            "title_coverage": F.coalesce(coverage(C("_title"), C("_tokens")), zero),
            "author_coverage": F.coalesce(coverage(C("_author"), C("_tokens")), zero),
        }
    )
    anchored = (
        C("_anchor").isNull()
        | F.array_contains(C("_tokens"), C("_anchor"))
        | (C("author_coverage") >= 0.75)
    )
    kept = pairs.where((C("title_coverage") >= minimum_title_coverage) & anchored)
    markers = F.array(*[F.lit(m) for m in PARTIAL_MARKERS])
    return kept.withColumns(
        {
            "score": 0.8 * C("title_coverage") + 0.2 * C("author_coverage"),
            "kind": F.when(F.arrays_overlap(C("_tokens"), markers), "partial").otherwise("complete"),
        }
    ).drop("_title", "_author", "_anchor", "_tokens")


def match_books(
    seeds: DataFrame, candidates: DataFrame, *, counted: DataFrame | None = None, **limits: float
) -> DataFrame:
    """Best candidate per book: (score desc, video_id)."""
    scored = score_book_candidates(seeds, candidates, counted=counted, **limits)
    return top_one(scored, ["source_key"], [C("score").desc(), C("video_id")])


def book_outcomes(seeds: DataFrame, matches: DataFrame, failures: DataFrame) -> DataFrame:
    """Status per book from matches and provider failures (source_key, error_type, error_message,
    retryable)."""
    matched = matches.select("source_key", "video_id", "kind", "query", "score")
    joined = seeds.join(matched, "source_key", "left").join(failures, "source_key", "left")
    failed = C("error_type").isNotNull()
    status = (
        F.when(failed, "error")
        .when(C("video_id").isNull(), "not_found")
        .when(C("kind") == "partial", "partial")
        .otherwise("found")
    )
    result = joined.withColumn("status", status)
    return result.withColumns(
        {c: F.when(~failed, C(c)) for c in ("video_id", "kind", "query", "score")}
    )


# --- songs and music videos -----------------------------------------------------------------------


def two_dimensions(
    title: Column, artist: Column, actual_title: Column, actual_artist: Column
) -> Column:
    """(low, mean) coverage over the dimensions that expect anything; NULL when none does."""
    dims = F.array_compact(
        F.array(coverage(title, actual_title), coverage(artist, actual_artist))
    )
    total = F.aggregate(dims, F.lit(0.0), lambda a, b: a + b)
    return F.struct(
        F.array_min(dims).alias("low"),
        F.try_divide(total, F.size(dims).cast("double")).alias("mean"),
    )


def score_song_candidates(
    requests: DataFrame,
    candidates: DataFrame,
    *,
    salts: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Requests (source_key, query, expected_title, expected_artist) x song candidates
    (source_key, position, song_id, title, artist)."""
    blank = F.lit("")
    title = ascii_tokens(F.coalesce("expected_title", blank))
    artist = ascii_tokens(F.coalesce("expected_artist", blank))
    open_query = (F.size(title) == 0) & (F.size(artist) == 0)
    keyed = requests.select(
        "source_key",
        F.when(open_query, ascii_tokens(C("query"))).otherwise(title).alias("_title"),
        artist.alias("_artist"),
    )
    tokenized = candidates.withColumns(
        {"_actual": ascii_tokens(C("title")), "_by": ascii_tokens(C("artist"))}
    )
    pairs = spread_join(tokenized, keyed, ["source_key"], "song_id", salts=salts, counted=counted)
    dims = two_dimensions(C("_title"), C("_artist"), C("_actual"), C("_by"))
    return (
        pairs.withColumn("_dims", dims)
        .withColumns({"low": C("_dims.low"), "mean": C("_dims.mean")})
        .drop("_title", "_artist", "_actual", "_by", "_dims")
    )


def match_songs(
    requests: DataFrame,
    candidates: DataFrame,
    *,
    minimum_score: float = 0.5,
    salts: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Best song per request: (low desc, mean desc, first position)."""
    _unit(minimum_score, "minimum_score", zero=False)
    scored = score_song_candidates(requests, candidates, salts=salts, counted=counted)
    eligible = scored.where(C("low") >= minimum_score)
    order = [C("low").desc(), C("mean").desc(), C("position"), C("song_id")]
    return top_one(eligible, ["source_key"], order)


def unscorable_requests(requests: DataFrame) -> DataFrame:
    """Requests whose expected fields and query hold no token at all, as violation rows."""
    text = F.concat_ws(" ", "expected_title", "expected_artist", "query")
    return requests.where(F.size(ascii_tokens(text)) == 0).select(
        "source_key",
        F.lit("tokens").alias("rule"),
        F.lit("request has no token to match on").alias("message"),
    )


def match_music_videos(
    songs: DataFrame,
    videos: DataFrame,
    *,
    minimum_confidence: float = 0.5,
    salts: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Best video per song: both dimensions against the one title; (low desc, mean desc, id)."""
    _unit(minimum_confidence, "minimum_confidence", zero=False)
    keyed = songs.select(
        "source_key",
        ascii_tokens(C("title")).alias("_title"),
        ascii_tokens(C("artist")).alias("_artist"),
    )
    tokenized = videos.withColumn("_actual", ascii_tokens(C("title")))
    pairs = spread_join(tokenized, keyed, ["source_key"], "video_id", salts=salts, counted=counted)
    both = (F.size("_title") > 0) & (F.size("_artist") > 0)
    dims = F.when(both, two_dimensions(C("_title"), C("_artist"), C("_actual"), C("_actual")))
    scored = pairs.withColumn("_dims", dims).where(C("_dims.low") >= minimum_confidence)
    best = top_one(
        scored, ["source_key"], [C("_dims.low").desc(), C("_dims.mean").desc(), C("video_id")]
    )
    return best.withColumns(
        {
            "confidence": C("_dims.mean"),
            "duration_seconds": F.bround("duration_seconds").cast("bigint"),
        }
    ).drop("_title", "_artist", "_actual", "_dims")


def checked_details(matches: DataFrame, details: DataFrame) -> DataFrame:
    """Selected songs with their details; NULL details and other ids are permanent failures.

    ``details``: source_key, returned_id and any payload columns.
    """
    joined = matches.join(details, "source_key", "left")
    code = (
        F.when(C("returned_id").isNull(), "invalid_response")
        .when(C("returned_id") != C("song_id"), "identity_mismatch")
    )
    retryable = F.when(code.isNotNull(), False)
    return joined.withColumns({"error_code": code, "error_retryable": retryable})


def lyrics_outcomes(
    requests: DataFrame,
    matches: DataFrame,
    failures: DataFrame,
    lyrics: DataFrame,
    videos: DataFrame,
) -> DataFrame:
    """Status and issues per request.

    ``failures``: source_key, stage (search or details), code, message, retryable.
    ``lyrics``: source_key, lyrics and a nullable failure (lyrics_code, lyrics_message,
    lyrics_retryable).  ``videos``: source_key, video_id and a nullable failure likewise.
    """
    failure = F.struct("stage", "code", "message", "retryable")
    joined = (
        requests.join(matches.select("source_key", "song_id"), "source_key", "left")
        .join(failures.select("source_key", failure.alias("_failure")), "source_key", "left")
        .join(lyrics, "source_key", "left")
        .join(videos, "source_key", "left")
    )

    def issue(stage: str, found: Column, what: str) -> Column:
        code, message, retryable = (C(f"{stage}_{n}") for n in ("code", "message", "retryable"))
        return F.when(
            ~found,
            F.struct(
                F.lit(stage).alias("stage"),
                F.coalesce(code, F.lit("not_found")).alias("code"),
                F.coalesce(message, F.lit(f"{what} not found")).alias("message"),
                F.coalesce(retryable, F.lit(False)).alias("retryable"),
            ),
        )

    text = F.nullif(F.trim(C("lyrics")), F.lit(""))
    has_text = text.isNotNull() & C("lyrics_code").isNull()
    has_video = C("video_id").isNotNull() & C("video_code").isNull()
    optional = F.array_compact(
        F.array(issue("lyrics", has_text, "lyrics were"), issue("video", has_video, "music video was"))
    )
    failed, missing = C("_failure").isNotNull(), C("song_id").isNull()
    issues = (
        F.when(failed, F.array(C("_failure")))
        .when(missing, F.filter(optional, lambda _: F.lit(False)))
        .otherwise(optional)
    )
    status = (
        F.when(failed, "error")
        .when(missing, "not_found")
        .when(F.size("issues") == 0, "complete")
        .otherwise("partial")
    )
    song = ~failed & ~missing
    return joined.withColumn("issues", issues).select(
        *requests.columns,
        status.alias("status"),
        F.when(song, C("song_id")).alias("song_id"),
        F.when(song & has_text, text).alias("lyrics"),
        F.when(song & has_video, C("video_id")).alias("video_id"),
        "issues",
    )


# --- open catalog ---------------------------------------------------------------------------------


def open_catalog_pairs(
    catalog: DataFrame,
    candidates: DataFrame,
    *,
    minimum_coverage: float = 0.5,
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """All (source_key, candidate_key) whose title coverage reaches the threshold, with no search.

    A candidate that covers k of a title's n tokens has at least one of the title's n - k + 1 rarest
    ones, so only those are used to find pairs: exact, and a title's frequent tokens are joined on
    only where it has no others.  Each pair is then verified on the full token sets.

    Titles are numbered, token by token, when this is called, and of a candidate only the numbers of tokens
    that some title has are kept, in a staged table: no other token can be shared.  Where the titles' tokens
    fit in ``_SMALL_CATALOG`` bytes, they are broadcast, and nothing but those numbers is exchanged.

    ``catalog``: source_key, title.  ``candidates``: candidate_key, title.
    """
    _unit(minimum_coverage, "minimum_coverage", zero=False)
    named = catalog.select("source_key", ascii_tokens(C("title")).alias("tokens")).withColumn("_title", F.monotonically_increasing_id())
    entries = written_once(named, "open-titles")
    spelled = entries.select("source_key", "_title", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    numbers = written_once(spelled.select("token").distinct().withColumn("id", F.monotonically_increasing_id()), "open-tokens")
    held_bytes = spelled.agg(F.sum(F.octet_length("token") + F.lit(_TOKEN_BYTES))).first()[0] or 0
    small = held_bytes <= _SMALL_CATALOG
    salts, sent = (1, F.broadcast) if small else (salts, lambda side: side)

    words = spelled.join(numbers, "token")
    titles = words.groupBy("source_key", "_title").agg(F.collect_list("id").alias("expected")).drop("_title")
    keyed = candidates.where("candidate_key IS NOT NULL")
    bodies = keyed.select("candidate_key", ascii_tokens(C("title")).alias("tokens")).withColumn("_body", F.monotonically_increasing_id())
    spoken = bodies.select("candidate_key", "_body", F.explode("tokens").alias("token"))
    known = spread_join(spoken, sent(numbers), ["token"], "candidate_key", salts=salts)
    sets = known.groupBy("candidate_key", "_body").agg(F.collect_list("id").alias("actual")).drop("_body")
    # what meets below is found, made distinct and verified where this has put it
    bags = written_once(sets, "open-bags").repartition(compute_partitions(candidates.sparkSession), "candidate_key")
    held = bags.select("candidate_key", F.explode("actual").alias("id"))
    # partial counts per task, then one row per token
    frequency = held.groupBy("id").agg(F.count("candidate_key").alias("frequency"))
    rarity = W.partitionBy("source_key").orderBy(F.coalesce("frequency", F.lit(0)), "token")
    needed = F.ceil(F.lit(minimum_coverage) * C("n") - F.lit(1e-9))
    probes = (
        words.join(frequency, "id", "left")
        .withColumn("place", F.row_number().over(rarity))
        .where(C("place") <= C("n") - needed + 1)
        .select("source_key", C("id").alias("token"))
    )
    likely = _meet(held.withColumnRenamed("id", "token"), sent(probes), salts).distinct()
    verified = (
        spread_join(likely, sent(titles), ["source_key"], "candidate_key", salts=salts)
        .join(bags, "candidate_key")
        .withColumn("shared", overlap(C("actual"), C("expected")))  # hashes the short set, not the text's
        .withColumn("expected_tokens", F.size("expected"))
        .withColumn("title_coverage", F.try_divide(C("shared").cast("double"), C("expected_tokens").cast("double")))
    )
    return verified.where(C("title_coverage") >= minimum_coverage).drop("expected", "actual")


def _meet(held: DataFrame, probes: DataFrame, salts: int) -> DataFrame:
    """Keys of candidates and titles that meet on a token, each frequent token split over the salts, if they are several.

    Whether the probes are broadcast instead is left to Spark, which knows their size at run time.
    """
    if salts <= 1:
        return held.join(probes, "token").select("source_key", "candidate_key")
    salt = F.pmod(F.xxhash64("candidate_key"), F.lit(salts)).cast("int")
    copies = probes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = held.withColumn("_salt", salt).join(copies, ["token", "_salt"])
    return met.select("source_key", "candidate_key")
