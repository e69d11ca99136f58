"""Search and detail payloads, page dumps and event logs as tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusbench.functions.classify import display_duration
from corpusbench.functions.text import has_text, strip_text

C = F.col

_TEXT = "struct<simpleText:string, runs:array<struct<text:string>>>"
SEARCH_ROW = f"videoId string, title {_TEXT}, lengthText {_TEXT}"
SONG_SEARCH = (
    "response struct<hits:array<struct<result:struct<id:string, title:string, url:string, "
    "primary_artist:struct<name:string>>>>>"
)
SONG_DETAILS = (
    "response struct<song:struct<id:string, title:string, url:string, "
    "primary_artist:struct<name:string>, primary_tag:struct<name:string>, album:struct<name:string>, "
    "label:string, release_date_for_display:string>>"
)
EVENT = (
    "event string, kind string, seq bigint, ts double, dataset_id string, dataset string, "
    "preset_id string, preset string, model string, phase string, status string, "
    "task_status string, run_status string, suite_status string, sample_id string, "
    "audio_path string, `index` bigint, total bigint, completed bigint, succeeded bigint, "
    "failed bigint, attempt bigint, elapsed_seconds double, error_code string, "
    "error_type string, message string"
)
# Fixed value: what precedes an event in a log line.
EVENT_MARKER = "stt_event="
SONG_ID = r"\A[1-9][0-9]*\z"


def renderer_text(value: Column) -> Column:
    """``simpleText`` unless blank, else the joined runs; NULL when both are blank."""
    runs = F.array_join(F.transform(value["runs"], lambda r: F.coalesce(r["text"], F.lit(""))), "")
    return F.coalesce(strip_text(value["simpleText"]), strip_text(runs))


def search_candidates(rows: DataFrame, video_id_pattern: str = r"[A-Za-z0-9_-]{11}") -> DataFrame:
    """Usable candidates of search rows; live rows and rows with a bad id or duration are dropped."""
    kept = [c for c in rows.columns if c not in ("videoId", "title", "lengthText")]
    duration = display_duration(renderer_text(C("lengthText")))
    typed = rows.select(
        *kept,
        C("videoId").alias("video_id"),
        renderer_text(C("title")).alias("title"),
        duration.alias("duration_seconds"),
    )
    good = (
        C("video_id").rlike(rf"\A(?:{video_id_pattern})\z")
        & C("title").isNotNull()
        & C("duration_seconds").isNotNull()
    )
    return typed.where(good).withColumn(
        "url", F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id")
    )


def song_candidates(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, failures) of search payloads (source_key, response).

    One malformed hit fails its whole response.
    """
    hits = C("response.hits")

    def bad(hit: Column) -> Column:
        result = hit["result"]
        good = (
            F.trim(result["id"]).rlike(SONG_ID)
            & has_text(result["title"])
            & has_text(result["url"])
            & has_text(result["primary_artist"]["name"])
        )
        return ~F.coalesce(good, F.lit(False))

    invalid = hits.isNull() | F.exists(hits, bad)
    judged = payloads.withColumn("_invalid", F.coalesce(invalid, F.lit(True)))
    exploded = judged.where("NOT _invalid").select("source_key", F.posexplode(hits).alias("position", "hit"))
    result = C("hit.result")
    candidates = exploded.select(
        "source_key",
        "position",
        F.trim(result["id"]).alias("song_id"),
        strip_text(result["title"]).alias("title"),
        strip_text(result["primary_artist"]["name"]).alias("artist"),
        strip_text(result["url"]).alias("url"),
    )
    failures = judged.where("_invalid").select(
        "source_key",
        F.lit("search").alias("stage"),
        F.lit("invalid_response").alias("code"),
        F.lit("invalid search result").alias("message"),
        F.lit(False).alias("retryable"),
    )
    return candidates, failures


def song_details(payloads: DataFrame) -> DataFrame:
    """Details of requested songs (source_key, requested_id, response) with a nullable error_code."""
    song = C("response.song")
    returned = F.trim(song["id"])
    usable = (
        returned.rlike(SONG_ID)
        & has_text(song["title"])
        & has_text(song["url"])
        & has_text(song["primary_artist"]["name"])
    )
    code = (
        F.when(song.isNull(), "invalid_response")
        .when(returned.rlike(SONG_ID) & (returned != C("requested_id")), "identity_mismatch")
        .when(~F.coalesce(usable, F.lit(False)), "invalid_response")
    )
    tag = strip_text(song["primary_tag"]["name"])
    none = F.array().cast("array<string>")
    return payloads.select(
        "source_key",
        "requested_id",
        returned.alias("returned_id"),
        strip_text(song["title"]).alias("title"),
        strip_text(song["primary_artist"]["name"]).alias("artist"),
        strip_text(song["url"]).alias("url"),
        F.when(tag.isNotNull(), F.array(tag)).otherwise(none).alias("genres"),
        strip_text(song["label"]).alias("label"),
        strip_text(song["album"]["name"]).alias("album"),
        strip_text(song["release_date_for_display"]).alias("release_date"),
        code.alias("error_code"),
    )


# --- pages ----------------------------------------------------------------------------------------

# Elements that HTML closes by itself.
_VOID = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)
_BLOCKS = ("div", "p", "li")
_SKIPPED = ("script", "style")


class _Events(HTMLParser):
    """A page as a list of (kind, tag or text, attributes)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, list]] = []

    def handle_data(self, data: str) -> None:
        self.found.append(("text", data, []))

    def handle_endtag(self, tag: str) -> None:
        self.found.append(("end", tag, []))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.found.append(("start", tag, attrs))


def _nested(events: list, marker: tuple[str, str], compat: bool) -> Iterator[tuple[str, str]]:
    """Events inside marked elements: visible text as it is, and a break wherever a line ends."""
    open_tags: list[str] = []  # from the marked element inwards
    for kind, name, attributes in events:
        if kind == "text":
            if open_tags and not set(open_tags) & set(_SKIPPED):
                yield "text", name
        elif kind == "start" and not open_tags:
            open_tags += [name] if marker in attributes else []
        elif kind == "start":
            if name in ("br", *_BLOCKS):
                yield "break", name
            if compat or name not in _VOID:
                open_tags.append(name)
        else:
            if name in _BLOCKS:
                yield "break", name
            innermost = len(open_tags) - 1
            # in compat mode whatever is open innermost ends, even an unclosed void element
            while not compat and innermost >= 0 and open_tags[innermost] != name:
                innermost -= 1
            if innermost >= 0:
                del open_tags[innermost:]
            if not open_tags:
                yield "break", name


def _lines(pieces: Iterator[tuple[str, str]]) -> Iterator[str]:
    """Lines of text with single spaces; empty ones are left out."""
    line = ""
    for kind, text in pieces:
        # the mark keeps a line break at the text's end from being swallowed
        first, *others = ["", "|"] if kind == "break" else (text + "|").splitlines()
        parts = [first, *others]
        parts[-1] = parts[-1][:-1]
        line += parts[0]
        for part in parts[1:]:
            yield " ".join(line.split())
            line = part
    yield " ".join(line.split())


def container_text(
    html: Column, *, attribute: str = "data-lyrics-container", value: str = "true",
    void_elements: str = "strict",
) -> Column:
    """Text inside marked containers, one line per block or break; NULL when there is none.

    ``void_elements='compat'`` lets an unclosed ``<br>`` keep its container open, as older
    extractions did; ``'strict'`` ends the container where it ends.
    """
    if void_elements not in ("strict", "compat"):
        raise ValueError(f"unknown void_elements: {void_elements}")
    compat = void_elements == "compat"

    def extract(page: str) -> str | None:
        parser = _Events()
        parser.feed(page)
        parser.close()
        return "\n".join(filter(None, _lines(_nested(parser.found, (attribute, value), compat)))) or None

    @F.pandas_udf(T.StringType())
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(extract, na_action="ignore")

    # Pages without the attribute never reach Python.  Its name stands in the page as it is, in any
    # case; the value may be written in other ways and is left to the parser.
    return texts(F.when(F.lower(html).contains(attribute.lower()), html))


# --- events ---------------------------------------------------------------------------------------


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events in log lines; a line without one is ignored.  Works on batches and streams."""
    payload = F.regexp_extract(column, rf"(?s){EVENT_MARKER}(.*)\z", 1)
    kept = [c for c in lines.columns if c != column]
    parsed = lines.where(C(column).contains(EVENT_MARKER)).select(
        *kept, F.from_json(payload, EVENT).alias("e")
    )
    name = F.coalesce(F.nullif(C("e.event"), F.lit("")), F.nullif(C("e.kind"), F.lit("")))
    return (
        parsed.withColumn("_event", name)
        .where("_event IS NOT NULL")
        .select(*kept, "e.*", "_event")
        .drop("event", "kind")
        .withColumnRenamed("_event", "event")
    )
