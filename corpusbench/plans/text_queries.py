"""Scalar functions as table jobs over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbench.functions import text, urls
from corpusbench.functions.alignment import character_edit_counts, edit_counts, native_edit_counts
from corpusbench.functions.classify import (
    content_kind, display_duration, failure_code, http_failure, provenance,
)
from corpusbench.operators.long_pairs import align_long
from corpusbench.operators.scoring import classify_coverage, score_utterances
from corpusbench.operators.spread import compute_partitions
from corpusbench.operators.suite import plan_fingerprint
from corpusbench.plans import views as v
from corpusbench.plans.registry import query, spread_table, table

C = F.col


@query("f1_normalize_text", f"SELECT doc_id, {v.sql_normalize('text')} AS normalized FROM documents")
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    return spread_table(spark, sf, "documents", "doc_id", "text").select("doc_id", text.normalize_text(C("text")).alias("normalized"))


@query(
    "f2_tokens",
    f"""
SELECT doc_id, len({v.sql_words('t')}) AS words, length(replace(t, ' ', '')) AS characters,
       md5(array_to_string({v.sql_words('t')}, '|')) AS word_digest
FROM (SELECT doc_id, {v.sql_normalize('text')} AS t FROM documents)
""",
)
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_table(spark, sf, "documents", "doc_id", "text").select("doc_id", text.normalize_text(C("text")).alias("t"))
    words = docs.select("doc_id", text.split_words(C("t")).alias("w"), text.split_characters(C("t")).alias("c"))
    return words.select(
        "doc_id",
        F.size("w").cast("bigint").alias("words"),
        F.size("c").cast("bigint").alias("characters"),
        F.md5(F.array_join("w", "|").cast("binary")).alias("word_digest"),
    )


_IDENTITY_SQL = r"trim(regexp_replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '\s+', ' ', 'g'))"


@query(
    "f3a_stable_book_id",
    f"""
SELECT conv_id, turn,
       'book_' || substr(sha256({_IDENTITY_SQL.format('text')} || chr(0) || {_IDENTITY_SQL.format('role')}), 1, 24) AS book_id
FROM conversations
""",
)
def book_ids(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", text.stable_book_id(C("text"), C("role")).alias("book_id"))


@query(
    "f3b_derive_source_id",
    f"""
SELECT conv_id, turn,
       'poem-' || substr(sha256({v.sql_identity('text')} || chr(0) || {v.sql_identity('role')}), 1, 20) AS source_id
FROM conversations
""",
)
def source_ids(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", text.derive_source_id(C("text"), C("role")).alias("source_id"))


@query("f4_normalized_identity", f"SELECT doc_id, {v.sql_identity('text')} AS identity FROM documents")
def identity(spark: SparkSession, sf: str) -> DataFrame:
    return spread_table(spark, sf, "documents", "doc_id", "text").select("doc_id", text.normalized_identity(C("text")).alias("identity"))


@query(
    "f5_ascii_tokens",
    f"""
SELECT doc_id, len(t) AS distinct_tokens, md5(array_to_string(list_sort(t), '|')) AS token_digest
FROM (SELECT doc_id, {v.sql_ascii_tokens('text')} AS t FROM documents)
""",
)
def ascii_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_table(spark, sf, "documents", "doc_id", "text").select("doc_id", text.ascii_tokens(C("text")).alias("t"))
    return docs.select(
        "doc_id",
        F.size("t").cast("bigint").alias("distinct_tokens"),
        F.md5(F.array_join(F.array_sort("t"), "|").cast("binary")).alias("token_digest"),
    )


_VIDEO_URL = """
CASE event_type WHEN 'click' THEN 'https://youtu.be/' || vid || '?t=1'
  WHEN 'view' THEN 'https://www.youtube.com/watch?a=b&v=' || vid
  WHEN 'signup' THEN 'https://youtube.com/shorts/' || vid || '/x'
  WHEN 'error' THEN 'http://m.youtube.com/watch?v=' || vid
  ELSE 'https://m.youtube.com/embed?v=' || vid || '#top' END
"""


def _video_links(spark: SparkSession, sf: str) -> DataFrame:
    vid = F.substring(F.md5(C("event_id").cast("string").cast("binary")), 1, 11)
    kind = C("event_type")
    url = (
        F.when(kind == "click", F.concat(F.lit("https://youtu.be/"), vid, F.lit("?t=1")))
        .when(kind == "view", F.concat(F.lit("https://www.youtube.com/watch?a=b&v="), vid))
        .when(kind == "signup", F.concat(F.lit("https://youtube.com/shorts/"), vid, F.lit("/x")))
        .when(kind == "error", F.concat(F.lit("http://m.youtube.com/watch?v="), vid))
        .otherwise(F.concat(F.lit("https://m.youtube.com/embed?v="), vid, F.lit("#top")))
    )
    return table(spark, sf, "events").select("event_id", "event_type", "value", vid.alias("video_id"), url.alias("url"))


@query(
    "f6_video_id",
    f"""
SELECT event_id,
  CASE WHEN event_type IN ('click', 'view', 'signup') THEN vid END AS book_id,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN vid END AS poem_id,
  regexp_extract(url, '^https?://([^/]+)', 1) AS host
FROM (SELECT *, {_VIDEO_URL} AS url FROM (SELECT *, substr(md5(CAST(event_id AS VARCHAR)), 1, 11) AS vid FROM events))
""",
)
def video_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _video_links(spark, sf).select(
        "event_id",
        urls.book_video_id(C("url")).alias("book_id"),
        urls.poem_video_id(C("url")).alias("poem_id"),
        urls.host(C("url")).alias("host"),
    )


@query(
    "f7_content_kind",
    """
SELECT position, CASE WHEN title LIKE '%fragmento%' THEN 'fragment' WHEN title LIKE '%Recitaci%' THEN 'recitation' ELSE 'other' END AS content_kind
FROM candidates
""",
    ("candidates",),
)
def kinds(spark: SparkSession, sf: str) -> DataFrame:
    return v.candidates(spark, sf).select("position", content_kind(C("title")).alias("content_kind"))


@query(
    "f8_poem_tokens",
    f"""
SELECT doc_id, len(t) AS distinct_tokens, md5(array_to_string(list_sort(t), '|')) AS token_digest
FROM (SELECT doc_id, {v.sql_poem_tokens('text')} AS t FROM documents)
""",
)
def poem_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_table(spark, sf, "documents", "doc_id", "text").select("doc_id", text.poem_tokens(C("text")).alias("t"))
    return docs.select(
        "doc_id",
        F.size("t").cast("bigint").alias("distinct_tokens"),
        F.md5(F.array_join(F.array_sort("t"), "|").cast("binary")).alias("token_digest"),
    )


@query(
    "f12_display_duration",
    """
SELECT l_orderkey, l_linenumber, shown,
  CASE WHEN l_returnflag = 'A' AND s < 60 THEN CAST(m * 60 + s AS DOUBLE)
       WHEN l_returnflag = 'N' AND s < 60 AND m < 60 THEN CAST(l_linenumber * 3600 + m * 60 + s AS DOUBLE) END AS seconds
FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN m || ':' || lpad(CAST(s AS VARCHAR), 2, '0')
         WHEN 'N' THEN l_linenumber || ':' || lpad(CAST(m AS VARCHAR), 2, '0') || ':' || lpad(CAST(s AS VARCHAR), 2, '0')
         ELSE 'PT' || m || 'M' || s || 'S' END AS shown
      FROM (SELECT *, CAST(l_quantity AS INTEGER) + day(l_shipdate) AS m, CAST(l_quantity AS INTEGER) + month(l_shipdate) AS s FROM lineitem))
""",
)
def durations(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    q = C("l_quantity").cast("int")
    m, s = (q + F.dayofmonth("l_shipdate")).cast("string"), (q + F.month("l_shipdate")).cast("string")
    flag = C("l_returnflag")
    shown = (
        F.when(flag == "A", F.concat_ws(":", m, F.lpad(s, 2, "0")))
        .when(flag == "N", F.concat_ws(":", C("l_linenumber"), F.lpad(m, 2, "0"), F.lpad(s, 2, "0")))
        .otherwise(F.concat(F.lit("PT"), m, F.lit("M"), s, F.lit("S")))
    )
    return lines.select("l_orderkey", "l_linenumber", shown.alias("shown")).withColumn(
        "seconds", display_duration(C("shown"))
    )


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return classify_coverage(v.references(spark, sf), v.recognitions(spark, sf))


@query("f13_alignment_counts", "SELECT sample_id, w_s AS s, w_d AS d, w_i AS i, w_n AS n FROM scored", v.SCORED)
def alignment(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _classified(spark, sf).where("coverage = 'scored'")
    spread = pairs.repartition(compute_partitions(spark), "sample_id")
    counts = edit_counts(text.word_tokens(C("reference")), text.word_tokens(C("hypothesis")))
    return spread.select("sample_id", counts.alias("e")).select("sample_id", "e.*")


@query(
    "f13_alignment_counts_native",
    """
SELECT sample_id AS title, w_s AS s, w_d AS d, w_i AS i, w_n AS n FROM title_scored
""",
    ("candidates", "catalog", "title_pairs", "title_steps", "title_scored"),
)
def native_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """The UDF-free form on short titles: distinct candidate titles against their part's name."""
    titles = v.catalog(spark, sf).select("source_key", C("title").alias("expected"))
    found = v.candidates(spark, sf).select("source_key", "title")
    pairs = found.join(titles, "source_key").select("expected", "title").distinct()
    key = F.concat_ws("|", "expected", "title").alias("title")
    words = pairs.select(key, text.ascii_words(C("expected")).alias("r"), text.ascii_words(C("title")).alias("h"))
    return words.select("title", native_edit_counts(C("r"), C("h")).alias("e")).select("title", "e.*")


def _characters(s: Column, d: Column, i: Column, n: Column) -> list[Column]:
    """What SQL can tell of a character alignment; its share of substitutions is held against brute force."""
    return [(s + d + i).alias("c_distance"), (d - i).alias("c_balance"), n.alias("c_n")]


@query(
    "f14_utterance_score",
    f"""
SELECT sample_id, normalized_reference, normalized_hypothesis, w_s, w_d, w_i, w_n, is_silence,
       {v.sql_character_distance("normalized_reference", "normalized_hypothesis")}::BIGINT AS c_distance,
       (length(replace(normalized_reference, ' ', '')) - length(replace(normalized_hypothesis, ' ', '')))::BIGINT AS c_balance,
       length(replace(normalized_reference, ' ', ''))::BIGINT AS c_n
FROM scored JOIN (SELECT sample_id, {v.sql_normalize("reference")} AS normalized_reference,
                         {v.sql_normalize("hypothesis")} AS normalized_hypothesis FROM classified) USING (sample_id)
""",
    v.SCORED,
)
def utterances(spark: SparkSession, sf: str) -> DataFrame:
    scored = score_utterances(_classified(spark, sf), keep_texts=True)
    return scored.select(
        "sample_id", "normalized_reference", "normalized_hypothesis", "w_s", "w_d", "w_i", "w_n", "is_silence",
        *_characters(*(C(f"c_{k}") for k in "sdin")),
    )


_DOCUMENT_CHARACTERS = f"""
SELECT doc_id, {v.sql_character_distance("r", "h")}::BIGINT AS c_distance,
       (length(replace(r, ' ', '')) - length(replace(h, ' ', '')))::BIGINT AS c_balance, length(replace(r, ' ', ''))::BIGINT AS c_n
FROM (SELECT doc_id, {v.sql_normalize("text")} AS r, {v.sql_normalize(v.sql_heard_text("first", "text"))} AS h FROM documents)
"""


def _document_pairs(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_table(spark, sf, "documents", "doc_id", "text")
    heard = docs.select("doc_id", "text", v.heard_by_first(C("text")).alias("heard"))  # normalizing reads it several times
    return heard.select(
        "doc_id",
        text.normalize_text(C("text")).alias("reference"),
        text.normalize_text(C("heard")).alias("hypothesis"),
    )


@query("f14_document_characters", _DOCUMENT_CHARACTERS)
def document_characters(spark: SparkSession, sf: str) -> DataFrame:
    """Character alignment of whole documents, up to the longest one."""
    counts = character_edit_counts(C("reference"), C("hypothesis"))
    told = _document_pairs(spark, sf).select("doc_id", counts.alias("e"))
    return told.select("doc_id", *_characters(*(C(f"e.{k}") for k in "sdin")))


@query("f14_tiled_characters", _DOCUMENT_CHARACTERS)
def tiled_characters(spark: SparkSession, sf: str) -> DataFrame:
    """The same from tiles of the distance tables, so that the longest document is spread over tasks."""
    pairs = _document_pairs(spark, sf).select(
        C("doc_id").cast("string").alias("name"), *(F.replace(c, F.lit(" ")).alias(c) for c in ("reference", "hypothesis"))
    )
    told = align_long(pairs, key="name", reference="reference", hypothesis="hypothesis", tile=8192)
    return told.select(C("name").cast("long").alias("doc_id"), *_characters(*(C(k) for k in "sdin")))


@query(
    "f15_plan_fingerprint",
    """
SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || ',"type":"' || p_type || '"}') AS fingerprint
FROM part
""",
)
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    digest = plan_fingerprint(name=C("p_name"), brand=C("p_brand"), type=C("p_type"), size=C("p_size"))
    return table(spark, sf, "part").select("p_partkey", digest.alias("fingerprint"))


_STATUS = "CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 429 WHEN 'error' THEN 503 WHEN 'signup' THEN 401 ELSE 404 END"


@query(
    "f16_http_failure",
    f"""
SELECT event_id, CASE WHEN s IN (401, 403) THEN 'authentication' WHEN s = 429 THEN 'rate_limit' WHEN s <> 200 THEN 'http_error' END AS code,
       CASE WHEN s <> 200 THEN s = 429 OR s >= 500 END AS retryable
FROM (SELECT event_id, {_STATUS} AS s FROM events)
""",
)
def http_failures(spark: SparkSession, sf: str) -> DataFrame:
    status = F.expr(_STATUS)
    failure = http_failure(status)
    return table(spark, sf, "events").select(
        "event_id", failure["code"].alias("code"), failure["retryable"].alias("retryable")
    )


_ERROR = "CASE event_type WHEN 'click' THEN 'ImportError' WHEN 'view' THEN 'KeyError' WHEN 'purchase' THEN 'OSError' ELSE 'RuntimeError' END"


@query(
    "f17_failure_code",
    f"""
SELECT event_id, CASE {_ERROR} WHEN 'ImportError' THEN 'dependency_missing' WHEN 'KeyError' THEN 'invalid_argument' WHEN 'OSError' THEN 'backend_error'
  ELSE CASE WHEN event_type = 'error' THEN 'cuda_oom' ELSE 'invalid_state' END END AS code
FROM events
""",
)
def failure_codes(spark: SparkSession, sf: str) -> DataFrame:
    message = F.when(C("event_type") == "error", "CUDA Out of Memory").otherwise("bad state")
    named = F.expr(_ERROR)
    bases = F.when(named == "RuntimeError", F.array(F.lit("OutOfMemoryError"), named)).otherwise(F.array(named))
    return table(spark, sf, "events").select("event_id", failure_code(bases, message).alias("code"))


@query(
    "f18_sample_id_from_path",
    r"""
SELECT page_id, replace(regexp_replace(p, '([^/])\.[^./]*$', '\1'), '/', '__') AS sample_id
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) || CASE WHEN url LIKE 'https%' THEN '.wav' ELSE '' END AS p FROM pages)
""",
)
def path_ids(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(
        F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1),
        F.when(C("url").startswith("https"), ".wav").otherwise(""),
    )
    return table(spark, sf, "pages").select("page_id", text.sample_id_from_path(path).alias("sample_id"))


@query(
    "s17_provenance",
    """
SELECT p_partkey, CASE WHEN p_size > 25 THEN 2 ELSE 3 END AS kept, p_name AS title, p_type AS ext,
       CASE WHEN p_size <= 25 THEN CAST(p_size AS VARCHAR) END AS duration
FROM part
""",
)
def provenance_fields(spark: SparkSession, sf: str) -> DataFrame:
    big = C("p_size") > 25
    metadata = F.create_map(
        F.lit("title"), C("p_name"), F.lit("ext"), C("p_type"), F.lit("brand"), C("p_brand"),
        F.when(big, "size").otherwise("duration"), C("p_size").cast("string"),
    )
    kept = provenance(metadata)
    return table(spark, sf, "part").select(
        "p_partkey",
        F.size(kept).alias("kept"),
        *[F.try_element_at(kept, F.lit(n)).alias(n) for n in ("title", "ext", "duration")],
    )
