"""Operator inputs derived from the given tables, in Spark and in SQL.

The tables hold no speech corpus, so references, recognitions, catalogs, candidates, ledgers and
events are derived from them by joins and expressions over whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbench.plans.registry import VIEWS, spread_table, table

C = F.col

# --- SQL spellings of the normalizers, for composed Latin text ------------------------------------


def sql_normalize(text: str) -> str:
    return rf"trim(regexp_replace(lower(nfc_normalize({text})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def sql_character_distance(reference: str, hypothesis: str) -> str:
    """Distance of two normalized texts without their spaces.

    DuckDB counts bytes, so the letters beyond ASCII that the tables have become capitals, which a
    normalized text has none of.
    """
    plain = [f"translate(replace({t}, ' ', ''), 'éèêçñóíüöäß', 'ABCDEFGHIJK')" for t in (reference, hypothesis)]
    return f"levenshtein({plain[0]}, {plain[1]})"


def sql_identity(text: str) -> str:
    return rf"trim(regexp_replace(lower(replace(strip_accents({text}), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"


def sql_ascii(text: str) -> str:
    plain = rf"regexp_replace(strip_accents({text}), '[^\x00-\x7F]+', '', 'g')"
    return rf"trim(regexp_replace(lower({plain}), '[^a-z0-9]+', ' ', 'g'))"


def sql_words(normalized: str) -> str:
    return f"list_filter(string_split({normalized}, ' '), lambda w: w <> '')"


def sql_ascii_tokens(text: str) -> str:
    return f"list_distinct({sql_words(sql_ascii(text))})"


STOP = "('a','al','de','del','el','en','la','las','los','un','una','y')"


def sql_poem_tokens(text: str) -> str:
    return f"list_filter(list_distinct({sql_words(sql_identity(text))}), lambda w: length(w) > 1 AND w NOT IN {STOP})"


def sql_coverage(expected: str, actual: str) -> str:
    return f"(len(list_intersect({expected}, {actual}))::DOUBLE / nullif(len({expected}), 0))"


# --- references and recognitions ------------------------------------------------------------------


def _rewritten(text: Column, choose: object) -> Column:
    return F.array_join(F.flatten(F.transform(F.split(text, " "), choose)), " ")


def heard_by_first(text: Column) -> Column:
    """A noisy channel: two-letter words are lost, three-letter words double, words in -e flip."""

    def choose(w: Column) -> Column:
        none = F.array().cast("array<string>")
        return (
            F.when(F.length(w) == 2, none)
            .when(F.length(w) == 3, F.array(w, w))
            .when(w.endswith("e"), F.array(F.reverse(w)))
            .otherwise(F.array(w))
        )

    return _rewritten(text, choose)


def heard_by_second(text: Column) -> Column:
    """Another noisy channel: words in a- are lost, four-letter words double."""

    def choose(w: Column) -> Column:
        none = F.array().cast("array<string>")
        return (
            F.when(w.startswith("a"), none).when(F.length(w) == 4, F.array(w, w)).otherwise(F.array(w))
        )

    return _rewritten(text, choose)


_SQL_CHANNELS = {
    "first": "WHEN length(w) = 2 THEN []::VARCHAR[] WHEN length(w) = 3 THEN [w, w] "
    "WHEN ends_with(w, 'e') THEN [reverse(w)]",
    "second": "WHEN starts_with(w, 'a') THEN []::VARCHAR[] WHEN length(w) = 4 THEN [w, w]",
}


def sql_heard_text(channel: str, text: str) -> str:
    cases = _SQL_CHANNELS[channel]
    return (
        f"array_to_string(flatten(list_transform(string_split({text}, ' '), "
        f"lambda w: CASE {cases} ELSE [w] END)), ' ')"
    )


def _sql_heard(channel: str) -> str:
    return sql_heard_text(channel, "c.text")


def references(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as references, grouped by conversation; system turns are silence controls."""
    return table(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("sample_id"),
        C("conv_id").cast("string").alias("group_id"),
        F.when(C("role") == "system", "").otherwise(C("text")).alias("text"),
    )


VIEWS["refs"] = """
SELECT conv_id || ':' || turn AS sample_id, CAST(conv_id AS VARCHAR) AS group_id,
       CASE WHEN role = 'system' THEN '' ELSE text END AS text
FROM conversations
"""


def recognitions(spark: SparkSession, sf: str, channel: str = "first") -> DataFrame:
    """What a model heard: the label of a turn says if it failed (quality 0) or never answered
    (toxic 1); benchmark items come back unasked."""
    heard = heard_by_first if channel == "first" else heard_by_second
    labels = table(spark, sf, "labels").select(C("doc_id").alias("_label"), "quality", "toxic")
    turns = table(spark, sf, "conversations")
    joined = turns.join(labels, C("conv_id") * 8 + C("turn") == C("_label"), "left")
    failed = F.coalesce(C("quality") == 0, F.lit(False))
    asked = joined.where(F.coalesce("toxic", F.lit(0)) == 0).select(
        F.concat_ws(":", "conv_id", "turn").alias("sample_id"),
        F.when(~failed, heard(C("text"))).alias("text"),
        F.when(failed, "failed").otherwise("ok").alias("status"),
        F.when(failed, "decoder error").alias("error"),
    )
    unasked = table(spark, sf, "benchmark").select(
        F.concat(F.lit("bench:"), "item_id").alias("sample_id"),
        "text",
        F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("error"),
    )
    return asked.unionByName(unasked)


for _name, _channel in (("recs", "first"), ("recs_b", "second")):
    VIEWS[_name] = f"""
SELECT c.conv_id || ':' || c.turn AS sample_id,
       CASE WHEN l.quality = 0 THEN NULL ELSE {_sql_heard(_channel)} END AS text,
       CASE WHEN l.quality = 0 THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN l.quality = 0 THEN 'decoder error' END AS error
FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id * 8 + c.turn
WHERE coalesce(l.toxic, 0) = 0
UNION ALL
SELECT 'bench:' || item_id, text, 'ok', NULL FROM benchmark
"""

VIEWS["classified"] = """
SELECT f.sample_id, f.group_id, f.text AS reference, r.text AS hypothesis,
       CASE WHEN r.status IS NULL THEN 'missing' WHEN r.status = 'failed' THEN 'failed' ELSE 'scored' END AS coverage
FROM refs f LEFT JOIN recs r USING (sample_id)
"""


def _sql_alignment(source: str) -> str:
    """Word alignment by anti-diagonals: a cell packs distance x 1000000 + substitutions."""
    return f"""
SELECT sample_id, group_id, r, h, len(r) AS m, len(h) AS n, 0 AS k,
       [0::BIGINT] AS d1, 0 AS lo1, []::BIGINT[] AS d2, 0 AS lo2
FROM (SELECT sample_id, group_id, {sql_words(sql_normalize("reference"))} AS r,
             {sql_words(sql_normalize("hypothesis"))} AS h
      FROM {source} WHERE coverage = 'scored')
UNION ALL
SELECT sample_id, group_id, r, h, m, n, k + 1,
  list_transform(range(greatest(0, k + 1 - n), least(m, k + 1) + 1), lambda i:
    CASE WHEN i = 0 OR i = k + 1 THEN (k + 1) * 1000000
         WHEN r[i] = h[k + 1 - i] THEN d2[i - lo2]
         WHEN d2[i - lo2] // 1000000 <= least(d1[i - lo1] // 1000000, d1[i - lo1 + 1] // 1000000)
           THEN d2[i - lo2] + 1000001
         WHEN d1[i - lo1] // 1000000 <= d1[i - lo1 + 1] // 1000000 THEN d1[i - lo1] + 1000000
         ELSE d1[i - lo1 + 1] + 1000000 END),
  greatest(0, k + 1 - n), d1, lo1
FROM %s WHERE k < m + n
"""


_COUNTED = """
SELECT sample_id, group_id, d1[1] %% 1000000 AS w_s,
       (d1[1] // 1000000 - d1[1] %% 1000000 + m - n) // 2 AS w_d,
       (d1[1] // 1000000 - d1[1] %% 1000000 - m + n) // 2 AS w_i,
       m::BIGINT AS w_n, m = 0 AS is_silence
FROM %s WHERE k = m + n
"""
VIEWS["steps"] = _sql_alignment("classified") % "steps"
VIEWS["scored"] = _COUNTED % "steps"
VIEWS["classified_b"] = VIEWS["classified"].replace("FROM refs f LEFT JOIN recs r", "FROM refs f LEFT JOIN recs_b r")
VIEWS["steps_b"] = _sql_alignment("classified_b") % "steps_b"
VIEWS["scored_b"] = _COUNTED % "steps_b"
VIEWS["title_pairs"] = """
SELECT DISTINCT c.title || '|' || d.title AS sample_id, '' AS group_id, c.title AS reference,
       d.title AS hypothesis, 'scored' AS coverage
FROM candidates d JOIN catalog c USING (source_key)
"""
VIEWS["title_steps"] = _sql_alignment("title_pairs") % "title_steps"
VIEWS["title_scored"] = _COUNTED % "title_steps"
SCORED = ("refs", "recs", "classified", "steps", "scored")
SCORED_B = ("recs_b", "classified_b", "steps_b", "scored_b")


def line_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Edit counts of a large run: one row per order line, grouped by supplier."""
    q, day = C("l_quantity").cast("bigint"), F.dayofmonth("l_shipdate").cast("bigint")
    line = C("l_linenumber").cast("bigint")
    silent = C("l_tax") == 0
    return table(spark, sf, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("sample_id"),
        C("l_suppkey").cast("string").alias("group_id"),
        C("l_returnflag").alias("dataset_id"),
        line.alias("w_s"),
        F.when(silent, 0).otherwise(F.floor(q / 10)).cast("bigint").alias("w_d"),
        F.floor(day / 8).cast("bigint").alias("w_i"),
        F.when(silent, 0).otherwise(q).cast("bigint").alias("w_n"),
        (line + day).alias("c_s"),
        F.when(silent, 0).otherwise(F.floor(q / 3)).cast("bigint").alias("c_d"),
        F.floor(day / 2).cast("bigint").alias("c_i"),
        F.when(silent, 0).otherwise(q * 5).cast("bigint").alias("c_n"),
        silent.alias("is_silence"),
    )


VIEWS["line_scores"] = """
SELECT l_orderkey || ':' || l_linenumber AS sample_id, CAST(l_suppkey AS VARCHAR) AS group_id,
       l_returnflag AS dataset_id, CAST(l_linenumber AS BIGINT) AS w_s,
       CASE WHEN l_tax = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) // 10 END AS w_d,
       CAST(day(l_shipdate) AS BIGINT) // 8 AS w_i,
       CASE WHEN l_tax = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS w_n,
       CAST(l_linenumber AS BIGINT) + day(l_shipdate) AS c_s,
       CASE WHEN l_tax = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) // 3 END AS c_d,
       CAST(day(l_shipdate) AS BIGINT) // 2 AS c_i,
       CASE WHEN l_tax = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 5 END AS c_n,
       l_tax = 0 AS is_silence
FROM lineitem
"""


def run_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Run results at scale: quantity as audio seconds (unknown when untaxed), price as time."""
    return table(spark, sf, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("sample_id"),
        C("l_orderkey").alias("run_id"),
        C("l_linenumber").alias("ord"),
        C("l_returnflag").alias("model"),
        (C("l_linestatus") == "F").alias("has_transcript"),
        F.when(C("l_linestatus") == "F", "ok").otherwise("failed").alias("status"),
        F.when(C("l_discount") > 0, C("l_extendedprice")).alias("elapsed_seconds"),
        F.when(C("l_tax") > 0, C("l_quantity")).alias("audio_seconds"),
        C("l_partkey").alias("process_rss_peak_bytes"),
        F.when(C("l_tax") > 0, C("l_suppkey")).alias("gpu_peak_allocated_bytes"),
    )


VIEWS["run_rows"] = """
SELECT l_orderkey || ':' || l_linenumber AS sample_id, l_orderkey AS run_id, l_linenumber AS ord,
       l_returnflag AS model, l_linestatus = 'F' AS has_transcript,
       CASE WHEN l_linestatus = 'F' THEN 'ok' ELSE 'failed' END AS status,
       CASE WHEN l_discount > 0 THEN l_extendedprice END AS elapsed_seconds,
       CASE WHEN l_tax > 0 THEN l_quantity END AS audio_seconds,
       l_partkey AS process_rss_peak_bytes,
       CASE WHEN l_tax > 0 THEN l_suppkey END AS gpu_peak_allocated_bytes
FROM lineitem
"""


# --- catalogs and candidates ----------------------------------------------------------------------


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as catalog entries: name as title, brand as author."""
    return table(spark, sf, "part").select(
        C("p_partkey").alias("source_key"), C("p_name").alias("title"), C("p_brand").alias("author")
    )


VIEWS["catalog"] = "SELECT p_partkey AS source_key, p_name AS title, p_brand AS author FROM part"


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as search results: a video per supplier, titled after another part."""
    lines = spread_table(
        spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus",
    )
    parts = table(spark, sf, "part")
    own = parts.select(C("p_partkey").alias("l_partkey"), C("p_brand").alias("_brand"))
    other = parts.select(
        C("p_partkey").alias("l_suppkey"), C("p_name").alias("_name"), C("p_brand").alias("_other"),
    )
    line, order = C("l_linenumber"), C("l_orderkey")
    marker = (
        F.when(C("l_returnflag") == "A", "audiolibro completo")
        .when(C("l_returnflag") == "N", "- fragmento")
        .otherwise("Recitación")
    )
    by = F.when(C("l_linestatus") == "O", C("_brand")).otherwise(C("_other"))
    return lines.join(own, "l_partkey").join(other, "l_suppkey").select(
        C("l_partkey").alias("source_key"),
        F.when(line <= 2, 0).when(line <= 4, 1).otherwise(2).alias("query_ord"),
        (order * 8 + line).alias("position"),
        F.concat(F.lit("q"), F.when(line <= 2, 0).when(line <= 4, 1).otherwise(2)).alias("query"),
        F.substring(F.md5(C("l_suppkey").cast("string").cast("binary")), 1, 11).alias("video_id"),
        F.concat_ws(" ", "_name", by, marker).alias("title"),
        (C("l_extendedprice") * C("l_discount") * 8).alias("duration_seconds"),
        (C("l_suppkey") + 1).cast("string").alias("song_id"),
        C("_name").alias("song_title"),
        by.alias("song_artist"),
    )


def candidate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The source of each order line: what to count in place of candidates, which joins make."""
    return table(spark, sf, "lineitem").select(C("l_partkey").alias("source_key"))


VIEWS["candidates"] = """
SELECT l.l_partkey AS source_key,
       CASE WHEN l_linenumber <= 2 THEN 0 WHEN l_linenumber <= 4 THEN 1 ELSE 2 END AS query_ord,
       l_orderkey * 8 + l_linenumber AS position,
       'q' || CASE WHEN l_linenumber <= 2 THEN 0 WHEN l_linenumber <= 4 THEN 1 ELSE 2 END AS query,
       substr(md5(CAST(l_suppkey AS VARCHAR)), 1, 11) AS video_id,
       t.p_name || ' ' || CASE WHEN l_linestatus = 'O' THEN o.p_brand ELSE t.p_brand END || ' ' ||
         CASE l_returnflag WHEN 'A' THEN 'audiolibro completo' WHEN 'N' THEN '- fragmento' ELSE 'Recitación' END AS title,
       l_extendedprice * l_discount * 8 AS duration_seconds,
       CAST(l_suppkey + 1 AS VARCHAR) AS song_id, t.p_name AS song_title,
       CASE WHEN l_linestatus = 'O' THEN o.p_brand ELSE t.p_brand END AS song_artist
FROM lineitem l JOIN part o ON o.p_partkey = l.l_partkey JOIN part t ON t.p_partkey = l.l_suppkey
"""


def song_results(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select(
        "source_key", "position", "song_id", C("song_title").alias("title"), C("song_artist").alias("artist")
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as song requests; some state only a title and some only a query."""
    kind = C("p_type")
    return table(spark, sf, "part").select(
        C("p_partkey").alias("source_key"),
        F.concat_ws(" ", "p_name", "p_brand").alias("query"),
        F.when(kind != "SMALL", C("p_name")).alias("expected_title"),
        F.when(~kind.isin("SMALL", "ECONOMY"), C("p_brand")).alias("expected_artist"),
    )


VIEWS["requests"] = """
SELECT p_partkey AS source_key, p_name || ' ' || p_brand AS query,
       CASE WHEN p_type <> 'SMALL' THEN p_name END AS expected_title,
       CASE WHEN p_type NOT IN ('SMALL', 'ECONOMY') THEN p_brand END AS expected_artist
FROM part
"""


# --- ledgers --------------------------------------------------------------------------------------


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as the current catalog of a collection."""
    return table(spark, sf, "documents").select(
        C("doc_id").alias("source_id"), C("doc_id").alias("ord"), "lang", "source"
    )


def prior(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as an earlier ledger of some documents: the outcome is (quality, toxic)."""
    found = (C("quality") == 1) & (C("toxic") == 0)
    status = (
        F.when(found, "found")
        .when(C("quality") == 1, "partial")
        .when(C("toxic") == 0, "not_found")
        .otherwise("error")
    )
    return table(spark, sf, "labels").select(
        C("doc_id").alias("source_id"),
        status.alias("status"),
        (1 + C("toxic")).alias("attempt"),
        F.when(status == "error", C("doc_id") > 500).alias("retryable"),
    )


VIEWS["manifest"] = "SELECT doc_id AS source_id, doc_id AS ord, lang, source FROM documents"
VIEWS["prior"] = """
SELECT doc_id AS source_id,
       CASE WHEN quality = 1 AND toxic = 0 THEN 'found' WHEN quality = 1 THEN 'partial'
            WHEN toxic = 0 THEN 'not_found' ELSE 'error' END AS status,
       1 + toxic AS attempt,
       CASE WHEN quality = 0 AND toxic = 1 THEN doc_id > 500 END AS retryable
FROM labels
"""


def run_events(spark: SparkSession, sf: str) -> DataFrame:
    """User events as run events of a model per user."""
    kind = C("event_type")
    event = (
        F.when(kind == "signup", "task_started")
        .when(kind == "view", "sample_started")
        .when(kind.isin("click", "error"), "sample_completed")
        .otherwise("task_completed")
    )
    number = F.get_json_object("props", "$.k").cast("bigint")
    nothing = F.lit(None).cast("string")
    return table(spark, sf, "events").select(
        event.alias("event"),
        C("event_id").alias("seq"),
        (F.unix_micros(C("ts").cast("timestamp")) / 1e6).alias("ts"),
        F.lit("d").alias("dataset_id"),
        nothing.alias("dataset"),
        C("user_id").cast("string").alias("preset_id"),
        nothing.alias("preset"),
        F.concat(F.lit("model "), "user_id").alias("model"),
        F.when(number > 90, "transcribing").alias("phase"),
        F.when(kind == "error", "failed").when(kind == "click", "ok").alias("status"),
        F.when(kind == "purchase", F.when(number > 50, "complete").otherwise("partial")).alias("task_status"),
        nothing.alias("run_status"),
        nothing.alias("suite_status"),
        F.when(kind.isin("view", "click", "error"), F.concat(F.lit("s"), number)).alias("sample_id"),
        nothing.alias("audio_path"),
        number.alias("index"),
        F.when(number > 20, number).alias("total"),
        F.when(kind == "click", number).alias("completed"),
        F.when(kind == "purchase", number).alias("succeeded"),
        F.when(kind == "purchase", F.lit(100) - number).alias("failed"),
        F.when(kind == "signup", number).alias("attempt"),
        C("value").alias("elapsed_seconds"),
        F.when((kind == "error") & (number > 60), "cuda_oom").alias("error_code"),
        F.when(kind == "error", "RuntimeError").alias("error_type"),
        F.when((kind == "error") & (number > 30), F.concat(F.lit("out of memory at "), "value")).alias("message"),
    )


VIEWS["run_events"] = """
SELECT CASE event_type WHEN 'signup' THEN 'task_started' WHEN 'view' THEN 'sample_started'
         WHEN 'click' THEN 'sample_completed' WHEN 'error' THEN 'sample_completed' ELSE 'task_completed' END AS event,
       event_id AS seq, epoch_us(ts) / 1e6 AS ts, 'd::' || user_id AS model_key, 'd' AS dataset_id,
       CAST(user_id AS VARCHAR) AS preset_id, 'model ' || user_id AS model,
       CASE WHEN num > 90 THEN 'transcribing' END AS phase,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'ok' END AS status,
       CASE WHEN event_type = 'purchase' THEN CASE WHEN num > 50 THEN 'complete' ELSE 'partial' END END AS task_status,
       CASE WHEN event_type IN ('view', 'click', 'error') THEN 's' || num END AS sample_id,
       num AS idx, CASE WHEN num > 20 THEN num END AS total, CASE WHEN event_type = 'click' THEN num END AS completed,
       CASE WHEN event_type = 'purchase' THEN num END AS succeeded,
       CASE WHEN event_type = 'purchase' THEN 100 - num END AS failed,
       CASE WHEN event_type = 'signup' THEN num END AS attempt, value AS elapsed_seconds,
       CASE WHEN event_type = 'error' AND num > 60 THEN 'cuda_oom' END AS error_code,
       CASE WHEN event_type = 'error' THEN 'RuntimeError' END AS error_type,
       CASE WHEN event_type = 'error' AND num > 30 THEN 'out of memory at ' || value END AS message
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS num FROM events)
"""
