"""Rule sets of the contracts, as lists of column rules.

Each function takes the column names it needs from the row, so the sets fit any table layout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusbench.contracts.rules import (
    Rule, finite, non_blank, optional, positive_finite, whole_text,
)
from corpusbench.functions import urls
from corpusbench.functions.text import has_text, stable_book_id

C = F.col

# Statuses and other closed word lists of the contracts.
BOOK_STATUSES = ("pending", "found", "partial", "not_found", "error")
POEM_STATUSES = ("found", "partial", "not_found", "error")
LYRICS_STATUSES = ("complete", "partial", "not_found", "error")
LYRICS_STAGES = ("search", "details", "lyrics", "video")
MATCH_KINDS = ("complete", "partial")
DEVICES = ("auto", "cpu", "cuda")
PRECISIONS = ("auto", "fp16", "fp32", "bf16")
SHORT_AUDIO_POLICIES = ("reject", "allow")
FAILURE_STAGES = ("preflight", "load", "warmup", "transcribe", "score", "close", "persist")
# Identifier patterns.
BOOK_ID = r"book_[0-9a-f]{24}"
SOURCE_ID = r"[a-z0-9][a-z0-9._-]{2,127}"
REQUEST_ID = r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}"
PLAN_ID = r"[A-Za-z0-9][A-Za-z0-9._-]*"
VIDEO_ID = r"[A-Za-z0-9_-]{11}"
SHA256_HEX = r"[0-9a-f]{64}"


def audio_sample() -> list[Rule]:
    path = C("audio_path")
    bad_part = F.exists(F.split(path, "/"), lambda p: p == "..") | whole_text(path, r"\.?")
    return [
        Rule("sample_id", non_blank(C("sample_id")), "sample_id must not be empty"),
        Rule("audio_path", non_blank(path), "audio_path must not be empty"),
        Rule("separator", ~path.contains("\\"), "parts of audio_path are separated by '/'"),
        Rule("relative", ~path.startswith("/"), "audio_path must be relative"),
        Rule("below_root", ~bad_part, "audio_path must stay below the dataset root"),
        Rule("reference_text", C("reference_text").isNotNull(), "reference_text must be a string"),
        Rule("identity", C("sample_id") != path, "sample_id must be independent of audio_path"),
        Rule(
            "sha256",
            optional(C("sha256"), whole_text(F.lower(C("sha256")), SHA256_HEX)),
            "sha256 must be 64 hexadecimal characters",
        ),
        *[
            Rule(name, optional(C(name), non_blank(C(name))), f"{name} must not be empty")
            for name in ("group_id", "split", "source")
        ],
    ]


def book_seed() -> list[Rule]:
    year = C("publication_year")
    derived = stable_book_id(F.trim(C("title")), F.trim(C("author")))
    return [
        Rule("book_id", whole_text(C("book_id"), BOOK_ID), "book_id has the wrong form"),
        Rule("title", non_blank(C("title")), "title must not be empty"),
        Rule("author", non_blank(C("author")), "author must not be empty"),
        Rule("derived_id", C("book_id") == derived, "book_id does not match title and author"),
        Rule("year", optional(year, year.between(1000, 2100)), "year must be 1000 to 2100"),
        Rule("source", optional(C("source"), non_blank(C("source"))), "source must not be empty"),
    ]


def audiobook_hit() -> list[Rule]:
    url = C("url")
    hosts = (*urls.BOOK_VIDEO_HOSTS, urls.SHORT_VIDEO_HOST)
    return [
        *[
            Rule(name, non_blank(C(name)), f"{name} must not be empty")
            for name in ("video_id", "provider_title", "query")
        ],
        Rule(
            "url", (urls.scheme(url) == "https") & urls.host(url).isin(*hosts),
            "url must be an HTTPS video URL",
        ),
        Rule(
            "authority", ~urls.has_credentials(url) & (urls.port(url) == ""),
            "a url has neither user nor port",
        ),
        Rule("url_id", urls.book_video_id(url) == C("video_id"), "url id must match video_id"),
        Rule("duration", positive_finite(C("duration_seconds")), "duration must be positive"),
        Rule("kind", C("kind").isin(*MATCH_KINDS), "kind must be complete or partial"),
    ]


def poem_source() -> list[Rule]:
    year = C("publication_year")
    return [
        Rule("source_id", whole_text(C("source_id"), SOURCE_ID), "source_id has the wrong form"),
        Rule("title", non_blank(C("title")), "title must not be empty"),
        Rule("author", non_blank(C("author")), "author must not be empty"),
        Rule("year", optional(year, year.between(1, 9999)), "year must be 1 to 9999"),
        *[
            Rule(name, optional(C(name), non_blank(C(name))), f"{name} must not be empty")
            for name in ("genre", "reference_text", "provenance")
        ],
    ]


def poem_video() -> list[Rule]:
    duration = C("duration_seconds")
    return [
        Rule("video_id", whole_text(C("video_id"), VIDEO_ID), "video_id must be 11 characters"),
        Rule(
            "url_id", urls.poem_video_id(C("url")) == C("video_id"),
            "url must be an HTTPS URL of video_id",
        ),
        *[
            Rule(name, non_blank(C(name)), f"{name} must not be empty")
            for name in ("title", "provider", "query")
        ],
        Rule("duration", optional(duration, positive_finite(duration)), "duration must be positive"),
    ]


def lyrics_request() -> list[Rule]:
    return [
        Rule("request_id", whole_text(C("request_id"), REQUEST_ID), "request_id has the wrong form"),
        Rule("query", non_blank(C("query")), "a query needs some text"),
        *[
            Rule(name, optional(C(name), non_blank(C(name))), f"{name} must not be empty")
            for name in ("expected_title", "expected_artist")
        ],
    ]


def lyrics_url(column: str = "url", lyrics_host: str = urls.LYRICS_HOST) -> list[Rule]:
    url = F.trim(C(column))
    return [
        Rule("http", urls.is_http_url(url), "url must be an HTTP(S) URL"),
        Rule(
            "canonical", urls.is_canonical_lyrics_url(url, lyrics_host),
            "url must be a canonical HTTPS lyrics URL",
        ),
    ]


def video_match(video: Column) -> list[Rule]:
    """Rules of a nullable video struct inside a song record."""
    confidence, duration = video["confidence"], video["duration_seconds"]
    return [
        Rule(
            "video_text",
            optional(video, non_blank(video["video_id"]) & non_blank(video["title"])),
            "video texts must not be empty",
        ),
        Rule("video_url", optional(video, urls.is_http_url(video["url"])), "video url must be HTTP(S)"),
        Rule("video_duration", optional(duration, duration >= 0), "video duration must be >= 0"),
        Rule(
            "video_confidence",
            optional(confidence, finite(confidence) & confidence.between(0, 1)),
            "confidence is a share from 0 to 1",
        ),
    ]


def song_record(song: Column, lyrics_host: str = urls.LYRICS_HOST) -> list[Rule]:
    """Rules of a nullable song struct."""
    genres_ok = F.forall(song["genres"], lambda g: F.coalesce(has_text(g), F.lit(False)))
    return [
        *[
            Rule(f"song_{name}", optional(song, non_blank(song[name])), f"{name} must not be empty")
            for name in ("source", "source_song_id", "title", "artist")
        ],
        Rule(
            "song_url",
            optional(song, urls.is_canonical_lyrics_url(song["url"], lyrics_host)),
            "song url must be a canonical lyrics URL",
        ),
        Rule("song_genres", optional(song, genres_ok), "genres must be non-empty strings"),
        *[
            Rule(
                f"song_{name}", optional(song[name], non_blank(song[name])),
                f"{name} must not be empty",
            )
            for name in ("label", "album", "release_date", "lyrics")
        ],
        *video_match(song["video"]),
    ]


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def book_outcome() -> list[Rule]:
    status = C("status")
    return [
        Rule("status", status.isin(*BOOK_STATUSES), "unknown status"),
        Rule(
            "hit", _same(status.isin("found", "partial"), C("hit").isNotNull()),
            "found and partial require a hit and others forbid it",
        ),
        Rule("issue", _same(status == "error", C("issue").isNotNull()), "only errors have an issue"),
        Rule(
            "kind",
            optional(C("hit"), _same(status == "partial", C("hit")["kind"] == "partial")),
            "status must agree with the hit kind",
        ),
    ]


def poem_outcome() -> list[Rule]:
    status = C("status")
    matched = status.isin("found", "partial")
    match = [C("candidate"), C("content_kind"), C("match_score")]
    error = [C("error_type"), C("error_message"), C("error_retryable")]
    no_match = match[0].isNull() & match[1].isNull() & match[2].isNull()
    no_error = error[0].isNull() & error[1].isNull() & error[2].isNull()
    has_match = match[0].isNotNull() & match[1].isNotNull() & match[2].isNotNull()
    has_error = non_blank(error[0]) & non_blank(error[1]) & error[2].isNotNull()
    return [
        Rule("status", status.isin(*POEM_STATUSES), "unknown status"),
        Rule("attempted_at", non_blank(C("attempted_at")), "attempted_at must not be empty"),
        Rule("match", F.when(matched, has_match).otherwise(no_match), "match does not fit status"),
        Rule(
            "error", F.when(status == "error", has_error).otherwise(no_error),
            "error does not fit status",
        ),
        Rule(
            "score",
            ~matched | optional(C("match_score"), finite(C("match_score")) & C("match_score").between(0, 1)),
            "match_score is a share from 0 to 1",
        ),
        Rule(
            "fragment",
            ~matched | optional(C("content_kind"), _same(status == "partial", C("content_kind") == "fragment")),
            "partial must mean a fragment",
        ),
    ]


def lyrics_outcome() -> list[Rule]:
    status, song, issues = C("status"), C("song"), C("issues")
    none = F.size(issues) == 0
    return [
        Rule("status", status.isin(*LYRICS_STATUSES), "unknown status"),
        Rule("attempt", C("attempt") >= 1, "attempt must be positive"),
        Rule("completed_at", non_blank(C("completed_at")), "completed_at must not be empty"),
        Rule(
            "complete",
            (status != "complete")
            | (song["lyrics"].isNotNull() & song["video"].isNotNull() & none),
            "complete requires lyrics and video without issues",
        ),
        Rule(
            "not_found", (status != "not_found") | (song.isNull() & none),
            "not_found cannot contain a song or issues",
        ),
        Rule(
            "error", (status != "error") | (song.isNull() & ~none),
            "error requires issues and no song",
        ),
        Rule(
            "partial", (status != "partial") | (song.isNotNull() & ~none),
            "partial requires a song and issues",
        ),
        Rule(
            "stage", F.forall(issues, lambda e: e["stage"].isin(*LYRICS_STAGES)),
            "unknown issue stage",
        ),
    ]


def reference_row() -> list[Rule]:
    return [
        Rule("sample_id", non_blank(C("sample_id")), "sample_id must not be empty"),
        Rule("group_id", non_blank(C("group_id")), "group_id must not be empty"),
    ]


def recognition_row() -> list[Rule]:
    status, text = C("status"), C("text")
    return [
        Rule("sample_id", non_blank(C("sample_id")), "sample_id must not be empty"),
        Rule("status", status.isin("ok", "failed"), "status must be ok or failed"),
        Rule("ok_text", (status != "ok") | text.isNotNull(), "ok requires text"),
        Rule("failed_text", (status != "failed") | text.isNull(), "failed requires no text"),
    ]


def sample_result() -> list[Rule]:
    status, transcript, failure = C("status"), C("transcript"), C("failure")
    duration = transcript["audio_duration_seconds"]
    peaks = [
        (name, transcript[name]) for name in ("gpu_peak_allocated_bytes", "gpu_peak_reserved_bytes")
    ] + [
        (name, C("measurement")[name])
        for name in ("process_rss_peak_bytes", "process_tree_rss_peak_bytes")
    ]
    return [
        Rule("sample_id", non_blank(C("sample_id")), "sample_id must not be empty"),
        Rule("status", status.isin("ok", "failed"), "status must be ok or failed"),
        Rule(
            "payload",
            F.when(status == "ok", transcript.isNotNull() & failure.isNull()).otherwise(
                transcript.isNull() & failure.isNotNull()
            ),
            "status does not match its payload",
        ),
        Rule("duration", optional(duration, positive_finite(duration)), "duration must be positive"),
        *[Rule(name, optional(peak, peak >= 0), f"{name} must be >= 0") for name, peak in peaks],
        Rule(
            "failure_stage", optional(failure, failure["stage"].isin(*FAILURE_STAGES)),
            "unknown failure stage",
        ),
    ]


def evaluation_plan() -> list[Rule]:
    """Rules of a one-row plan: identifiers, policies and limits."""

    def identifiers(column: Column) -> Column:
        return F.forall(column, lambda v: F.coalesce(whole_text(v, PLAN_ID), F.lit(False)))

    def unique(column: Column) -> Column:
        return F.size(F.array_distinct(column)) == F.size(column)

    datasets, presets = C("dataset_ids"), C("preset_ids")
    return [
        Rule("datasets", F.size(datasets) > 0, "datasets must not be empty"),
        Rule("presets", F.size(presets) > 0, "presets must not be empty"),
        Rule("dataset_unique", unique(datasets), "dataset ids must be unique"),
        Rule("preset_unique", unique(presets), "preset ids must be unique"),
        Rule("dataset_form", identifiers(datasets), "dataset id has the wrong form"),
        Rule("preset_form", identifiers(presets), "preset id has the wrong form"),
        Rule("device", C("device").isin(*DEVICES), "unsupported device"),
        Rule("precision", C("precision").isin(*PRECISIONS), "unsupported precision"),
        Rule("warmup", C("warmup_runs") >= 0, "warmup_runs must be >= 0"),
        Rule("timeout", C("request_timeout_seconds") > 0, "timeout must be positive"),
        Rule("minimum", C("minimum_audio_seconds") > 0, "minimum duration must be positive"),
        Rule(
            "policy", C("short_audio_policy").isin(*SHORT_AUDIO_POLICIES), "unsupported short-audio policy"
        ),
    ]
