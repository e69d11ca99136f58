"""Rule sets as violation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbench.contracts import rulesets
from corpusbench.contracts.rules import duplicates, validate, violations
from corpusbench.functions.text import stable_book_id
from corpusbench.operators import ledger
from corpusbench.plans.registry import VIEWS, query, table
from corpusbench.plans.text_queries import _VIDEO_URL, _video_links

C = F.col


def _sql_rules(source: str, key: str, *rules: tuple[str, str]) -> str:
    """(key, rule) of every row of a source for which a condition is not true."""
    return "\nUNION ALL\n".join(
        f"SELECT {key}, '{name}' AS rule FROM {source} WHERE ({condition}) IS NOT TRUE" for name, condition in rules
    )


def _broken(df: DataFrame, rules: list, *key: str) -> DataFrame:
    return violations(df, rules, list(key)).drop("message")


VIEWS["page_samples"] = r"""
SELECT page_id, CASE WHEN url LIKE 'http:%' THEN p ELSE CAST(page_id AS VARCHAR) END AS sample_id,
       CASE WHEN url LIKE '%ref=%' THEN '/' || p WHEN url LIKE '%#%' THEN p || '/../x' WHEN url LIKE '%?%' THEN replace(p, '/', '\') ELSE p END AS audio_path,
       CASE WHEN html LIKE '%lang="en"%' THEN '' WHEN html LIKE '%lang="fr"%' THEN html END AS reference_text,
       CASE WHEN url LIKE '%.org%' THEN upper(sha256(html)) WHEN url LIKE '%.com%' THEN md5(html) END AS sha256
FROM (SELECT *, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS p FROM pages)
"""


@query(
    "p1_audio_sample",
    _sql_rules(
        "page_samples", "page_id",
        ("separator", r"NOT contains(audio_path, '\')"),
        ("relative", "NOT starts_with(audio_path, '/')"),
        ("below_root", "NOT list_contains(string_split(audio_path, '/'), '..')"),
        ("reference_text", "reference_text IS NOT NULL"),
        ("identity", "sample_id <> audio_path"),
        ("sha256", "sha256 IS NULL OR regexp_full_match(lower(sha256), '[0-9a-f]{64}')"),
    ),
    ("page_samples",),
)
def audio_sample(spark: SparkSession, sf: str) -> DataFrame:
    url, path = C("url"), F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    audio = (
        F.when(url.contains("ref="), F.concat(F.lit("/"), path))
        .when(url.contains("#"), F.concat(path, F.lit("/../x")))
        .when(url.contains("?"), F.replace(path, F.lit("/"), F.lit("\\")))
        .otherwise(path)
    )
    html = C("html")
    samples = table(spark, sf, "pages").select(
        "page_id",
        F.when(url.startswith("http:"), path).otherwise(C("page_id").cast("string")).alias("sample_id"),
        audio.alias("audio_path"),
        F.when(html.contains('lang="en"'), "").when(html.contains('lang="fr"'), html).alias("reference_text"),
        F.when(url.contains(".org"), F.upper(F.sha2(html.cast("binary"), 256)))
        .when(url.contains(".com"), F.md5(html.cast("binary")))
        .alias("sha256"),
        *[F.lit(None).cast("string").alias(n) for n in ("group_id", "split", "source")],
    )
    return _broken(samples, rulesets.audio_sample(), "page_id")


VIEWS["seeds"] = """
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'book_' || upper(h) WHEN p_size > 30 THEN 'book_' || substr(md5(p_name), 1, 24) ELSE 'book_' || h END AS book_id,
       p_name AS title, CASE WHEN p_type = 'LARGE' THEN '  ' ELSE p_brand END AS author,
       CASE WHEN p_type <> 'SMALL' THEN 970 + p_size END AS publication_year, 'book_' || h AS derived
FROM (SELECT *, substr(sha256(lower(p_name) || chr(0) || CASE WHEN p_type = 'LARGE' THEN '' ELSE lower(p_brand) END), 1, 24) AS h FROM part)
"""


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    author = F.when(C("p_type") == "LARGE", "  ").otherwise(C("p_brand"))
    derived = stable_book_id(C("p_name"), F.trim(author))
    wrong = F.concat(F.lit("book_"), F.substring(F.md5(C("p_name").cast("binary")), 1, 24))
    upper = F.concat(F.lit("book_"), F.upper(F.substring(derived, 6, 24)))
    return table(spark, sf, "part").select(
        "p_partkey",
        F.when(C("p_size") > 40, upper).when(C("p_size") > 30, wrong).otherwise(derived).alias("book_id"),
        C("p_name").alias("title"),
        author.alias("author"),
        F.when(C("p_type") != "SMALL", 970 + C("p_size")).alias("publication_year"),
        C("p_brand").alias("source"),
    )


@query(
    "p2_book_seed",
    _sql_rules(
        "seeds", "p_partkey",
        ("book_id", "regexp_full_match(book_id, 'book_[0-9a-f]{24}')"),
        ("author", "trim(author) <> ''"),
        ("derived_id", "book_id = derived"),
        ("year", "publication_year IS NULL OR publication_year BETWEEN 1000 AND 2100"),
    ),
    ("seeds",),
)
def book_seed(spark: SparkSession, sf: str) -> DataFrame:
    return _broken(_seeds(spark, sf), rulesets.book_seed(), "p_partkey")


VIEWS["links"] = f"""
SELECT *, {_VIDEO_URL} AS url FROM (SELECT *, substr(md5(CAST(event_id AS VARCHAR)), 1, 11) AS vid FROM events)
"""


@query(
    "p3_audiobook_hit",
    _sql_rules(
        "links", "event_id",
        ("url", "event_type IN ('click', 'view', 'signup')"),
        ("url_id", "event_type IN ('click', 'view', 'signup') AND value <= 30"),
        ("duration", "value > 1"),
        ("kind", "event_type <> 'signup'"),
    ),
    ("links",),
)
def audiobook_hit(spark: SparkSession, sf: str) -> DataFrame:
    """Links of another video above value 30, durations below one below value 1, one unknown kind."""
    links = _video_links(spark, sf)
    hits = links.select(
        "event_id",
        F.when(C("value") > 30, F.reverse("video_id")).otherwise(C("video_id")).alias("video_id"),
        "url",
        C("event_type").alias("provider_title"),
        C("event_type").alias("query"),
        F.when(C("value") > 1, C("value")).otherwise(F.lit(float("nan"))).alias("duration_seconds"),
        F.when(C("event_type") == "signup", "other").otherwise("partial").alias("kind"),
    )
    return _broken(hits, rulesets.audiobook_hit(), "event_id")


@query(
    "p4_poem_source",
    _sql_rules(
        "(SELECT *, replace(lower(p_name), ' ', CASE WHEN p_size > 25 THEN '-' ELSE ' ' END) AS sid FROM part)", "p_partkey",
        ("source_id", "regexp_full_match(sid, '[a-z0-9][a-z0-9._-]{2,127}')"),
        ("author", "p_type <> 'LARGE'"),
        ("year", "p_size > 10"),
    ),
)
def poem_source(spark: SparkSession, sf: str) -> DataFrame:
    joiner = F.when(C("p_size") > 25, "-").otherwise(" ")
    nothing = F.lit(None).cast("string")
    sources = table(spark, sf, "part").select(
        "p_partkey",
        F.replace(F.lower("p_name"), F.lit(" "), joiner).alias("source_id"),
        C("p_name").alias("title"),
        F.when(C("p_type") != "LARGE", C("p_brand")).alias("author"),
        (C("p_size") - 10).alias("publication_year"),
        nothing.alias("genre"), nothing.alias("reference_text"), nothing.alias("provenance"),
    )
    return _broken(sources, rulesets.poem_source(), "p_partkey")


@query(
    "p5_poem_video",
    _sql_rules(
        "links", "event_id",
        ("video_id", "value <= 60"),
        ("url_id", "event_type IN ('click', 'view', 'purchase') AND value <= 60"),
        ("duration", "event_type = 'click' OR value > 2"),
    ),
    ("links",),
)
def poem_video(spark: SparkSession, sf: str) -> DataFrame:
    """Too short an id above value 60; unknown durations of clicks, others zero below 2."""
    links = _video_links(spark, sf)
    videos = links.select(
        "event_id",
        F.when(C("value") > 60, F.substring("video_id", 1, 3)).otherwise(C("video_id")).alias("video_id"),
        "url",
        C("event_type").alias("title"), C("event_type").alias("provider"), C("event_type").alias("query"),
        F.when(C("event_type") != "click", F.when(C("value") > 2, C("value")).otherwise(0.0)).alias("duration_seconds"),
    )
    return _broken(videos, rulesets.poem_video(), "event_id")


@query(
    "p6_lyrics_request",
    _sql_rules(
        "part", "p_partkey",
        ("request_id", "p_brand NOT LIKE '%#1%'"),
        ("query", "p_size > 5"),
        ("expected_title", "p_type = 'SMALL' OR p_size < 45"),
    ),
)
def lyrics_request(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "part").select(
        "p_partkey",
        F.when(C("p_brand").contains("#1"), C("p_brand")).otherwise(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("request_id"),
        F.when(C("p_size") > 5, C("p_name")).alias("query"),
        F.when(C("p_type") != "SMALL", F.when(C("p_size") < 45, C("p_name")).otherwise("\t")).alias("expected_title"),
        C("p_brand").alias("expected_artist"),
    )
    return _broken(asked, rulesets.lyrics_request(), "p_partkey")


@query(
    "p7_lyrics_url",
    r"""
SELECT page_id, 'canonical' AS rule FROM pages
WHERE NOT regexp_matches(url, '^https://([^/?#@:]*\.)?example\.com(:443)?([/?#]|$)')
""",
)
def lyrics_url(spark: SparkSession, sf: str) -> DataFrame:
    """Pages held against one lyrics host: HTTPS and that host or a subdomain."""
    rules = rulesets.lyrics_url(lyrics_host="example.com")
    return _broken(table(spark, sf, "pages"), rules, "page_id")


def _songs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as collection results with a nested song; each size band breaks another rule."""
    size, none = C("p_size"), F.lit(None)
    text = none.cast("string")
    video = F.when(
        size <= 30,
        F.struct(
            F.lit("abcdefghijk").alias("video_id"),
            F.when(size == 3, "ftp://x/y").otherwise("https://youtu.be/abcdefghijk").alias("url"),
            C("p_name").alias("title"),
            (size - 5).alias("duration_seconds"),
            (size / 28).alias("confidence"),
        ),
    )
    song = F.when(
        size <= 40,
        F.struct(
            F.lit("catalog").alias("source"), C("p_partkey").cast("string").alias("source_song_id"), C("p_name").alias("title"),
            F.when(size == 7, " ").otherwise(C("p_brand")).alias("artist"),
            F.when(size == 8, "https://example.org/x").otherwise("https://www.genius.com/x").alias("url"),
            F.when(size == 9, F.array(F.lit("rock"), F.lit(""))).otherwise(F.array(F.lit("rock"))).alias("genres"),
            text.alias("label"), text.alias("album"), text.alias("release_date"),
            F.when(size <= 20, C("p_type")).alias("lyrics"), video.alias("video"),
        ),
    )
    issue = F.struct(
        F.when(size == 21, "upload").otherwise("lyrics").alias("stage"), F.lit("not_found").alias("code"),
        F.lit("lyrics were not found").alias("message"), F.lit(False).alias("retryable"),
    )
    status = (
        F.when(C("p_type") == "SMALL", "complete").when(C("p_type") == "LARGE", "partial")
        .when(C("p_type") == "ECONOMY", "not_found").otherwise("error")
    )
    return table(spark, sf, "part").select(
        "p_partkey", status.alias("status"), (size - 1).alias("attempt"),
        F.when(size != 11, "2024-01-01T00:00:00+00:00").otherwise("").alias("completed_at"),
        song.alias("song"),
        F.when((size > 15) & (size <= 45), F.array(issue)).otherwise(F.filter(F.array(issue), lambda _: F.lit(False))).alias("issues"),
    )


@query(
    "p8_song_record",
    _sql_rules(
        "part", "p_partkey",
        ("song_artist", "p_size <> 7"), ("song_url", "p_size <> 8"), ("song_genres", "p_size <> 9"),
        ("video_url", "p_size <> 3"), ("video_duration", "p_size >= 5 OR p_size > 30"),
        ("video_confidence", "p_size <= 28 OR p_size > 30"),
    ),
)
def song_record(spark: SparkSession, sf: str) -> DataFrame:
    return _broken(_songs(spark, sf), rulesets.song_record(C("song")), "p_partkey")


@query(
    "p9_lyrics_outcome",
    _sql_rules(
        "(SELECT *, CASE p_type WHEN 'SMALL' THEN 'complete' WHEN 'LARGE' THEN 'partial' WHEN 'ECONOMY' THEN 'not_found' ELSE 'error' END AS status, "
        "p_size > 15 AND p_size <= 45 AS has_issue FROM part)", "p_partkey",
        ("attempt", "p_size >= 2"), ("completed_at", "p_size <> 11"),
        ("complete", "status <> 'complete' OR (p_size <= 20 AND NOT has_issue)"),
        ("not_found", "status <> 'not_found' OR (p_size > 40 AND NOT has_issue)"),
        ("error", "status <> 'error' OR (p_size > 40 AND has_issue)"),
        ("partial", "status <> 'partial' OR (p_size <= 40 AND has_issue)"),
        ("stage", "p_size <> 21"),
    ),
)
def lyrics_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return _broken(_songs(spark, sf), rulesets.lyrics_outcome(), "p_partkey")


@query(
    "p9_book_outcome",
    _sql_rules(
        "(SELECT *, CASE WHEN p_size > 40 THEN 'error' WHEN p_size > 30 THEN 'not_found' WHEN p_size > 15 THEN 'partial' ELSE 'found' END AS status, "
        "p_type IN ('SMALL', 'LARGE') AS hit, p_type = 'ECONOMY' AS issue FROM part)", "p_partkey",
        ("hit", "(status IN ('found', 'partial')) = hit"),
        ("issue", "(status = 'error') = issue"),
        ("kind", "NOT hit OR (status = 'partial') = (p_type = 'SMALL')"),
    ),
)
def book_outcome(spark: SparkSession, sf: str) -> DataFrame:
    size, kind = C("p_size"), C("p_type")
    status = F.when(size > 40, "error").when(size > 30, "not_found").when(size > 15, "partial").otherwise("found")
    hit = F.struct(F.when(kind == "SMALL", "partial").otherwise("complete").alias("kind"))
    records = table(spark, sf, "part").select(
        "p_partkey", status.alias("status"), F.when(kind.isin("SMALL", "LARGE"), hit).alias("hit"),
        F.when(kind == "ECONOMY", F.struct(F.lit("search").alias("stage"))).alias("issue"),
    )
    return _broken(records, rulesets.book_outcome(), "p_partkey")


@query(
    "p9_poem_outcome",
    _sql_rules(
        "(SELECT *, CASE WHEN p_size > 40 THEN 'error' WHEN p_size > 30 THEN 'not_found' WHEN p_size > 15 THEN 'partial' ELSE 'found' END AS status, "
        "p_type IN ('SMALL', 'LARGE') AS matched, p_type = 'ECONOMY' AS failed FROM part)", "p_partkey",
        ("match", "CASE WHEN status IN ('found', 'partial') THEN matched ELSE NOT matched END"),
        ("error", "CASE WHEN status = 'error' THEN failed ELSE NOT failed END"),
        ("score", "status NOT IN ('found', 'partial') OR NOT matched OR p_size / 28.0 <= 1"),
        ("fragment", "status NOT IN ('found', 'partial') OR NOT matched OR (status = 'partial') = (p_type = 'SMALL')"),
    ),
)
def poem_outcome(spark: SparkSession, sf: str) -> DataFrame:
    size, kind = C("p_size"), C("p_type")
    status = F.when(size > 40, "error").when(size > 30, "not_found").when(size > 15, "partial").otherwise("found")
    matched, failed = kind.isin("SMALL", "LARGE"), kind == "ECONOMY"
    outcomes = table(spark, sf, "part").select(
        "p_partkey", status.alias("status"), F.lit("2024-01-01").alias("attempted_at"),
        F.when(matched, C("p_name")).alias("candidate"),
        F.when(matched, F.when(kind == "SMALL", "fragment").otherwise("other")).alias("content_kind"),
        F.when(matched, size / 28).alias("match_score"),
        F.when(failed, "E").alias("error_type"), F.when(failed, "m").alias("error_message"),
        F.when(failed, F.lit(True)).alias("error_retryable"),
    )
    return _broken(outcomes, rulesets.poem_outcome(), "p_partkey")


@query(
    "p10_ledger_invariants",
    """
SELECT user_id AS source_id, 'duplicate_outcome' AS rule FROM events GROUP BY user_id HAVING count(*) > 1
UNION ALL SELECT user_id, 'unknown_source' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT c_custkey, 'missing_outcome' FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT user_id FROM events)
UNION ALL SELECT user_id, 'pending_outcome' FROM events WHERE event_type = 'signup'
""",
)
def ledger_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in credit as sources, their events as outcomes of a finished ledger."""
    sources = table(spark, sf, "customer").where("c_acctbal > 0").select(C("c_custkey").alias("source_id"))
    outcomes = table(spark, sf, "events").select(
        C("user_id").alias("source_id"), F.when(C("event_type") == "signup", "pending").otherwise("found").alias("status")
    )
    return ledger.ledger_problems(sources, outcomes, "source_id", "finished")


@query(
    "p11_recognition_rows",
    """
SELECT event_id, 'ok_text' AS rule FROM events WHERE event_type = 'click' AND value < 10
UNION ALL SELECT event_id, 'failed_text' FROM events WHERE event_type = 'error' AND value >= 10
UNION ALL SELECT event_id, 'status' FROM events WHERE event_type IN ('view', 'signup')
""",
)
def recognition_rows(spark: SparkSession, sf: str) -> DataFrame:
    kind = C("event_type")
    rows = table(spark, sf, "events").select(
        "event_id", C("event_id").cast("string").alias("sample_id"),
        F.when(C("value") >= 10, F.when(kind == "purchase", "").otherwise(C("props"))).alias("text"),
        F.when(kind.isin("click"), "ok").when(kind.isin("error"), "failed").when(kind == "purchase", F.when(C("value") >= 10, "ok").otherwise("failed")).otherwise(kind).alias("status"),
    )
    return _broken(rows, rulesets.recognition_row(), "event_id")


@query(
    "p12_sample_results",
    """
SELECT event_id, 'payload' AS rule FROM events WHERE event_type IN ('click', 'view') AND value >= 40 OR event_type NOT IN ('click', 'view') AND value < 40
UNION ALL SELECT event_id, 'duration' FROM events WHERE value < 5
UNION ALL SELECT event_id, 'gpu_peak_allocated_bytes' FROM events WHERE value < 3
""",
)
def sample_results(spark: SparkSession, sf: str) -> DataFrame:
    """Values below 40 carry a transcript; below 5 its duration is zero and below 3 a peak negative."""
    value = C("value")
    transcript = F.struct(
        C("props").alias("text"), F.when(value < 5, 0.0).otherwise(value).alias("audio_duration_seconds"),
        F.when(value < 3, -1).otherwise(1).cast("bigint").alias("gpu_peak_allocated_bytes"),
        F.lit(None).cast("bigint").alias("gpu_peak_reserved_bytes"),
    )
    measured = F.struct(
        F.lit(1.0).alias("elapsed_seconds"), F.lit(1).alias("process_rss_peak_bytes"), F.lit(None).cast("bigint").alias("process_tree_rss_peak_bytes"),
    )
    rows = table(spark, sf, "events").select(
        "event_id", C("event_id").cast("string").alias("sample_id"),
        F.when(C("event_type").isin("click", "view"), "ok").otherwise("failed").alias("status"),
        F.when(value < 40, transcript).alias("transcript"), measured.alias("measurement"),
        F.when(value >= 40, F.struct(F.lit("transcribe").alias("stage"))).alias("failure"),
    )
    return _broken(rows, rulesets.sample_result(), "event_id")


@query(
    "p13_evaluation_plan",
    """
SELECT source, 'dataset_unique' AS rule FROM documents GROUP BY source HAVING min(lang) = max(lang)
UNION ALL SELECT source, 'device' FROM documents GROUP BY source HAVING max(length(text)) > 10000
UNION ALL SELECT source, 'preset_form' FROM documents GROUP BY source HAVING min(n_chars) < 20
""",
)
def evaluation_plan(spark: SparkSession, sf: str) -> DataFrame:
    """One plan per source: its first and last language as datasets, a device by its longest text."""
    plans = table(spark, sf, "documents").groupBy("source").agg(
        F.array(F.min("lang"), F.max("lang")).alias("dataset_ids"), F.max(F.length("text")).alias("longest"), F.min("n_chars").alias("shortest"),
    )
    plans = plans.select(
        "source", "dataset_ids",
        F.array(F.when(C("shortest") < 20, "bad id").otherwise("model-a")).alias("preset_ids"),
        F.when(C("longest") > 10000, "tpu").otherwise("cpu").alias("device"),
        F.lit("fp16").alias("precision"), F.lit(1).alias("warmup_runs"), F.lit(1800.0).alias("request_timeout_seconds"),
        F.lit(0.1).alias("minimum_audio_seconds"), F.lit("reject").alias("short_audio_policy"),
    )
    return _broken(plans, rulesets.evaluation_plan(), "source")


@query(
    "p14_duplicate_keys",
    "SELECT text_hash, count(*) AS occurrences FROM (SELECT sha256(text) AS text_hash FROM documents) GROUP BY text_hash HAVING count(*) > 1",
)
def duplicate_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.sha2(C("text").cast("binary"), 256).alias("text_hash"))
    return duplicates(docs, "text_hash")


@query(
    "p16_short_audio",
    """
SELECT event_id, CASE WHEN event_type = 'signup' THEN 'audio duration is required' WHEN value < 0.5 THEN 'audio is below the minimum duration' END AS failure
FROM events
""",
)
def short_audio(spark: SparkSession, sf: str) -> DataFrame:
    samples = table(spark, sf, "events").select(
        "event_id", F.when(C("event_type") != "signup", C("value")).alias("duration_seconds")
    )
    return ledger.short_audio_failures(samples, minimum_seconds=0.5).select("event_id", "failure")


@query(
    "p18_media_tasks",
    "SELECT p_partkey AS request_id, 'abcdefghijk' AS video_id, p_type AS lyrics FROM part WHERE p_size <= 20",
)
def eligible_tasks(spark: SparkSession, sf: str) -> DataFrame:
    results = _songs(spark, sf).withColumnRenamed("p_partkey", "request_id")
    return ledger.media_tasks(results).select("request_id", "video_id", "lyrics")


@query(
    "p19_path_scope",
    """
SELECT lang, bool_and(starts_with(p, 'https://m.')) AS in_scope, count(*) FILTER (NOT starts_with(p, 'https://m.')) AS outside
FROM (SELECT regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, url AS p FROM pages) GROUP BY lang
""",
)
def path_scope(spark: SparkSession, sf: str) -> DataFrame:
    samples = table(spark, sf, "pages").select(
        F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), C("url").alias("audio_path")
    )
    return ledger.paths_in_scope(samples, "https://m.", ["lang"])


VIEWS["files"] = "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256, strlen(text) AS bytes FROM documents"
VIEWS["file_samples"] = """
SELECT CAST(conv_id * 8 + turn AS VARCHAR) AS sample_id, CAST(conv_id * 8 + turn AS VARCHAR) AS audio_path,
       CASE WHEN quality = 1 THEN sha256(d.text) WHEN quality = 0 THEN md5(d.text) END AS sha256
FROM conversations LEFT JOIN labels ON doc_id = conv_id * 8 + turn LEFT JOIN documents d ON d.doc_id = conv_id * 8 + turn
"""


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: path, hash and size of their bytes."""
    content = C("text").cast("binary")
    return table(spark, sf, "documents").select(
        C("doc_id").cast("string").alias("path"), F.sha2(content, 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes")
    )


@query(
    "p20_file_preflight",
    """
SELECT s.sample_id, CASE WHEN f.path IS NULL THEN 'there is no such audio file' WHEN s.sha256 IS NULL THEN 'a sha256 is needed to verify the file' ELSE 'the file has another sha256' END AS error
FROM file_samples s LEFT JOIN files f ON f.path = s.audio_path WHERE f.path IS NULL OR s.sha256 IS NULL OR s.sha256 <> f.sha256
""",
    ("files", "file_samples"),
)
def file_preflight(spark: SparkSession, sf: str) -> DataFrame:
    number = C("conv_id") * 8 + C("turn")
    labels = table(spark, sf, "labels").select(C("doc_id").alias("n"), "quality")
    content = table(spark, sf, "documents").select(C("doc_id").alias("n"), C("text").cast("binary").alias("content"))
    declared = F.when(C("quality") == 1, F.upper(F.sha2("content", 256))).when(C("quality") == 0, F.md5("content"))
    samples = (
        table(spark, sf, "conversations").select(number.alias("n")).join(labels, "n", "left").join(content, "n", "left")
        .select(C("n").cast("string").alias("sample_id"), C("n").cast("string").alias("audio_path"), declared.alias("sha256"))
    )
    return ledger.preflight_errors(samples, document_files(spark, sf)).select("sample_id", "error")


@query(
    "p0_valid_rows",
    "SELECT p_partkey, book_id, publication_year FROM seeds WHERE regexp_full_match(book_id, 'book_[0-9a-f]{24}') AND trim(author) <> '' AND book_id = derived "
    "AND (publication_year IS NULL OR publication_year BETWEEN 1000 AND 2100)",
    ("seeds",),
)
def valid_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The other half of validation: rows that break no rule."""
    valid = validate(_seeds(spark, sf), rulesets.book_seed(), "p_partkey").valid
    return valid.select("p_partkey", "book_id", "publication_year")


