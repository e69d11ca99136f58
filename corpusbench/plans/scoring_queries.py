"""Coverage, scores, intervals and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbench.operators import bootstrap as b
from corpusbench.operators import reports, scoring, suite
from corpusbench.plans import views as v
from corpusbench.plans.registry import VIEWS, query, rounded, sql_rounded, table

C = F.col
_PAIR = ("refs", "recs", "classified")
_RATES = "(w_s + w_d + w_i)::DOUBLE / nullif(w_n, 0) AS wer"
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in scoring.COUNT_COLUMNS)
_WORD_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in scoring.COUNT_COLUMNS[:4])
_BOTH_RATES = f"{_RATES}, (c_s + c_d + c_i)::DOUBLE / nullif(c_n, 0) AS cer"


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.classify_coverage(v.references(spark, sf), v.recognitions(spark, sf))


def _unexpected(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.unexpected_recognitions(v.references(spark, sf), v.recognitions(spark, sf))


def _scored(spark: SparkSession, sf: str, channel: str = "first") -> DataFrame:
    classified = scoring.classify_coverage(v.references(spark, sf), v.recognitions(spark, sf, channel))
    return scoring.score_utterances(classified)


@query("j1_coverage_classes", "SELECT sample_id, group_id, coverage, hypothesis FROM classified", _PAIR)
def coverage_classes(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).select("sample_id", "group_id", "coverage", "hypothesis")


_HEARD_TWICE = "status = 'failed' OR contains(text, 'que')"
_REPEATED = {
    "heard_twice": f"SELECT * FROM recs UNION ALL SELECT * FROM recs WHERE {_HEARD_TWICE}",
    "asked_twice": "SELECT * FROM refs UNION ALL SELECT * FROM refs WHERE text = ''",
    "told": """
SELECT sample_id, CASE WHEN asked > 1 OR heard > 1 THEN 'duplicate' WHEN heard IS NULL THEN 'missing' ELSE 'scored' END AS coverage
FROM (SELECT sample_id, count(*) AS asked FROM asked_twice GROUP BY 1)
LEFT JOIN (SELECT sample_id, count(*) AS heard FROM heard_twice GROUP BY 1) USING (sample_id)
""",
}
VIEWS.update(_REPEATED)


def _repeated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """References whose silence controls come twice, and recognitions of which some came twice."""
    asked, heard = v.references(spark, sf), v.recognitions(spark, sf)
    return asked.union(asked.where("text = ''")), heard.union(heard.where(_HEARD_TWICE))


@query("j1_duplicate_ids", "SELECT sample_id, coverage FROM told", ("refs", "recs", *_REPEATED))
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.classify_coverage(*_repeated(spark, sf)).select("sample_id", "coverage")


@query(
    "a3_coverage_with_duplicates",
    """
SELECT *, missing + failed + duplicate AS unscored, scored::DOUBLE / nullif(expected, 0) AS rate, expected > 0 AND missing + failed + duplicate = 0 AS complete
FROM (SELECT count(*) AS expected, count(*) FILTER (coverage = 'scored') AS scored, count(*) FILTER (coverage = 'missing') AS missing,
             0 AS failed, count(*) FILTER (coverage = 'duplicate') AS duplicate,
             (SELECT count(*) FROM heard_twice WHERE sample_id NOT IN (SELECT sample_id FROM refs)) AS unexpected FROM told)
""",
    ("refs", "recs", *_REPEATED),
)
def coverage_with_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """All failed recognitions came twice, so none is left that only failed."""
    asked, heard = _repeated(spark, sf)
    return scoring.coverage_summary(scoring.classify_coverage(asked, heard), scoring.unexpected_recognitions(asked, heard))


@query(
    "j2_unexpected_recognitions",
    "SELECT sample_id, text FROM recs WHERE sample_id NOT IN (SELECT sample_id FROM refs)",
    ("refs", "recs"),
)
def unexpected(spark: SparkSession, sf: str) -> DataFrame:
    return _unexpected(spark, sf).select("sample_id", "text")


@query(
    "a1_corpus_score",
    f"SELECT *, {_BOTH_RATES} FROM (SELECT dataset_id, {_SUMS} FROM line_scores WHERE NOT is_silence GROUP BY dataset_id)",
    ("line_scores",),
)
def corpus_score(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.corpus_score(v.line_scores(spark, sf), ["dataset_id"])


@query(
    "a1_corpus_score_texts",
    f"SELECT *, {_RATES} FROM (SELECT {_WORD_SUMS} FROM scored WHERE NOT is_silence)",
    v.SCORED,
)
def corpus_score_texts(spark: SparkSession, sf: str) -> DataFrame:
    """From raw texts to the corpus word error rate."""
    return scoring.corpus_score(_scored(spark, sf)).select(*scoring.COUNT_COLUMNS[:4], "wer")


@query(
    "a1_corpus_score_characters",
    f"""
SELECT *, (w_s + w_d + w_i)::DOUBLE / nullif(w_n, 0) AS wer, c_distance::DOUBLE / nullif(c_n, 0) AS cer
FROM (SELECT {_WORD_SUMS}, CAST(sum(c_distance) AS BIGINT) AS c_distance, CAST(sum(c_n) AS BIGINT) AS c_n
      FROM scored JOIN (
        SELECT sample_id, {v.sql_character_distance("r", "h")} AS c_distance, length(replace(r, ' ', '')) AS c_n
        FROM (SELECT sample_id, {v.sql_normalize("reference")} AS r, {v.sql_normalize("hypothesis")} AS h FROM classified)
      ) USING (sample_id) WHERE NOT is_silence)
""",
    v.SCORED,
)
def corpus_score_characters(spark: SparkSession, sf: str) -> DataFrame:
    """From raw texts to word and character error rates; SQL tells the characters' edits only in all."""
    score = scoring.corpus_score(_scored(spark, sf))
    return score.select("w_s", "w_d", "w_i", "w_n", (C("c_s") + C("c_d") + C("c_i")).alias("c_distance"), "c_n", "wer", "cer")


@query(
    "a2_group_score",
    f"SELECT *, {_BOTH_RATES} FROM (SELECT group_id, {_SUMS} FROM line_scores WHERE NOT is_silence GROUP BY group_id)",
    ("line_scores",),
)
def group_score(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.group_score(v.line_scores(spark, sf))


@query(
    "a2_group_score_texts",
    f"SELECT *, {_RATES} FROM (SELECT group_id, {_WORD_SUMS} FROM scored WHERE NOT is_silence GROUP BY group_id)",
    v.SCORED,
)
def group_score_texts(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.group_score(_scored(spark, sf)).select("group_id", *scoring.COUNT_COLUMNS[:4], "wer")


@query(
    "a3_coverage_summary",
    """
SELECT *, missing + failed AS unscored, scored::DOUBLE / nullif(expected, 0) AS rate, expected > 0 AND missing + failed = 0 AS complete
FROM (SELECT count(*) AS expected, count(*) FILTER (coverage = 'scored') AS scored, count(*) FILTER (coverage = 'missing') AS missing,
             count(*) FILTER (coverage = 'failed') AS failed, 0 AS duplicate,
             (SELECT count(*) FROM recs WHERE sample_id NOT IN (SELECT sample_id FROM refs)) AS unexpected FROM classified)
""",
    _PAIR,
)
def coverage_summary(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.coverage_summary(_classified(spark, sf), _unexpected(spark, sf))


@query(
    "a3_coverage_details",
    """
SELECT coverage, sample_id FROM classified WHERE coverage <> 'scored'
UNION ALL SELECT 'unexpected', sample_id FROM recs WHERE sample_id NOT IN (SELECT sample_id FROM refs)
""",
    _PAIR,
)
def coverage_details(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.coverage_details(_classified(spark, sf), _unexpected(spark, sf))


@query("a4_silence_controls", "SELECT sample_id, w_i, w_n FROM scored WHERE is_silence", v.SCORED)
def silence(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.silence_controls(_scored(spark, sf)).select("sample_id", "w_i", "w_n")


_BOUNDS = ("wer_lower", "wer_upper", "cer_lower", "cer_upper")


def _sql_mixed(source: str, name: str, value: str) -> str:
    """32 well-mixed bits of a whole number, as a column of a subquery."""
    first = f"SELECT *, ({value}) & 4294967295 AS m0 FROM ({source})"
    second = f"SELECT * EXCLUDE (m0), (xor(m0, m0 >> 16) * {0x21F0AAAD}) & 4294967295 AS m1 FROM ({first})"
    third = f"SELECT * EXCLUDE (m1), (xor(m1, m1 >> 15) * {0x735A2D97}) & 4294967295 AS m2 FROM ({second})"
    return f"SELECT * EXCLUDE (m2), xor(m2, m2 >> 15) AS {name} FROM ({third})"


def _sql_streams(source: str, seed: int, *parts: str) -> str:
    source = f"SELECT *, {seed}::BIGINT AS u FROM ({source})"
    for part in parts:
        source = _sql_mixed(source, "v", f"u * 3 + {part} + 1")
        source = f"SELECT * EXCLUDE (u, v), v AS u FROM ({source})"
    return _sql_mixed(source, "w", f"u + {0x9E3779B9}")


def _sql_drawn(source: str, number: str, many: str) -> str:
    mixed = _sql_mixed(_sql_mixed(source, "x", f"u + {number}"), "y", f"w + {number}")
    return f"SELECT *, ((xor(x, y) << 30) + (z >> 2)) % {many} AS drawn FROM ({_sql_mixed(mixed, 'z', 'x + y')})"


def _sql_draws(groups: str, replicates: int, seed: int = 42) -> str:
    """Each replicate's draws counted by bucket, and as many made inside the bucket."""
    slots = f"SELECT replicate, slot, gc FROM {groups}, range({replicates}) r(replicate)"
    fallen = _sql_drawn(_sql_streams(slots, seed, "replicate"), "slot", "gc")
    counts = f"SELECT replicate, gc, drawn // {b.BUCKET_GROUPS} AS bucket, count(*) AS draws FROM ({fallen}) GROUP BY ALL"
    each = f"SELECT * EXCLUDE (draws), unnest(range(draws)) AS draw FROM ({_sql_streams(counts, seed, 'replicate', 'bucket')})"
    inside = _sql_drawn(each, "draw", f"least({b.BUCKET_GROUPS}, gc - bucket * {b.BUCKET_GROUPS})")
    return f"SELECT replicate, gc, bucket * {b.BUCKET_GROUPS} + drawn AS drawn FROM ({inside})"


VIEWS["line_groups"] = f"""
SELECT *, row_number() OVER (ORDER BY substr(md5(group_id), 1, 3), group_id) - 1 AS slot, count(*) OVER () AS gc
FROM (SELECT group_id, {_SUMS} FROM line_scores WHERE NOT is_silence GROUP BY group_id)
"""
VIEWS["line_draws"] = _sql_draws("line_groups", 2000)
VIEWS["line_rates"] = """
SELECT replicate, max(gc) AS gc, sum(w_s + w_d + w_i)::DOUBLE / nullif(sum(w_n), 0) AS wer, sum(c_s + c_d + c_i)::DOUBLE / nullif(sum(c_n), 0) AS cer
FROM (SELECT replicate, gc, drawn FROM line_draws) JOIN (SELECT slot AS drawn, w_s, w_d, w_i, w_n, c_s, c_d, c_i, c_n FROM line_groups) USING (drawn) GROUP BY replicate
"""


@query(
    "a5_bootstrap_intervals",
    sql_rounded("""
SELECT max(gc) AS group_count, 2000 AS requested_replicates, count(wer) AS valid_wer_replicates, count(cer) AS valid_cer_replicates,
       42 AS seed, 0.95::DOUBLE AS confidence,
       quantile_cont(wer, (1 - 0.95::DOUBLE) / 2) AS wer_lower, quantile_cont(wer, 1 - (1 - 0.95::DOUBLE) / 2) AS wer_upper,
       quantile_cont(cer, (1 - 0.95::DOUBLE) / 2) AS cer_lower, quantile_cont(cer, 1 - (1 - 0.95::DOUBLE) / 2) AS cer_upper,
       NULL AS reason
FROM line_rates
""", 9, *_BOUNDS),
    ("line_scores", "line_groups", "line_draws", "line_rates"),
)
def bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(b.bootstrap_intervals(v.line_scores(spark, sf)), 9, *_BOUNDS)


VIEWS["text_groups"] = f"""
SELECT *, row_number() OVER (ORDER BY substr(md5(group_id), 1, 3), group_id) - 1 AS slot, count(*) OVER () AS gc
FROM (SELECT group_id, {_WORD_SUMS} FROM scored WHERE NOT is_silence GROUP BY group_id)
"""
VIEWS["text_draws"] = _sql_draws("text_groups", 500)


@query(
    "a5_bootstrap_texts",
    sql_rounded("""
SELECT max(gc) AS group_count, quantile_cont(wer, (1 - 0.9::DOUBLE) / 2) AS wer_lower, quantile_cont(wer, 1 - (1 - 0.9::DOUBLE) / 2) AS wer_upper
FROM (SELECT replicate, max(d.gc) AS gc, sum(w_s + w_d + w_i)::DOUBLE / nullif(sum(w_n), 0) AS wer
      FROM text_draws d JOIN text_groups g ON g.slot = d.drawn GROUP BY replicate)
""", 9, "wer_lower", "wer_upper"),
    (*v.SCORED, "text_groups", "text_draws"),
)
def bootstrap_texts(spark: SparkSession, sf: str) -> DataFrame:
    intervals = b.bootstrap_intervals(_scored(spark, sf), replicates=500, confidence=0.9)
    return rounded(intervals.select("group_count", "wer_lower", "wer_upper"), 9, "wer_lower", "wer_upper")


@query(
    "a6_percentile",
    sql_rounded("""
SELECT l_returnflag, quantile_cont(l_extendedprice, 0.025) AS lower, quantile_cont(l_extendedprice, 0.975) AS upper
FROM lineitem GROUP BY l_returnflag
""", 6, "lower", "upper"),
)
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    bounds = b.grouped_percentiles(lines, ["l_returnflag"], "l_extendedprice", {"lower": 0.025, "upper": 0.975})
    return rounded(bounds, 6, "lower", "upper")


_TIMES = ("total_inference_seconds", "total_audio_seconds", "real_time_factor")
_PERFORMANCE = """
SELECT model, count(*) AS measured_samples, sum(elapsed_seconds) AS total_inference_seconds, coalesce(sum(audio_seconds), 0) AS total_audio_seconds,
       {numerator} / nullif(sum(audio_seconds), 0) AS real_time_factor,
       max(process_rss_peak_bytes) AS process_rss_peak_bytes, max(gpu_peak_allocated_bytes) AS gpu_peak_allocated_bytes
FROM run_rows WHERE has_transcript AND elapsed_seconds IS NOT NULL GROUP BY model
"""


@query("a7_performance_summary", sql_rounded(_PERFORMANCE.format(numerator="sum(elapsed_seconds)"), 3, *_TIMES), ("run_rows",))
def performance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.performance_summary(v.run_rows(spark, sf), ["model"]), 3, *_TIMES)


@query(
    "a7_performance_summary_paired",
    sql_rounded(_PERFORMANCE.format(numerator="sum(elapsed_seconds) FILTER (audio_seconds IS NOT NULL)"), 3, *_TIMES),
    ("run_rows",),
)
def performance_paired(spark: SparkSession, sf: str) -> DataFrame:
    summary = scoring.performance_summary(v.run_rows(spark, sf), ["model"], rtf_policy="paired")
    return rounded(summary, 3, *_TIMES)


@query("a8_status_histogram", "SELECT status, count(*) AS rows FROM run_rows GROUP BY status", ("run_rows",))
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return reports.status_histogram(v.run_rows(spark, sf))


@query(
    "a9_error_preview",
    """
SELECT model, sample_id, rank, greatest(0, total - 5) AS additional
FROM (SELECT model, sample_id, row_number() OVER (PARTITION BY model ORDER BY sample_id) AS rank, count(*) OVER (PARTITION BY model) AS total
      FROM run_rows WHERE status = 'failed') WHERE rank <= 5
""",
    ("run_rows",),
)
def error_preview(spark: SparkSession, sf: str) -> DataFrame:
    errors = v.run_rows(spark, sf).where("status = 'failed'").select("model", "sample_id")
    return reports.error_preview(errors, ["model"], ["sample_id"])


_RUNS = """
SELECT l_orderkey AS run_id, CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_linestatus = 'F' THEN 'ok' ELSE 'failed' END AS status,
       CASE WHEN o_orderstatus = 'P' THEN 'skipped' ELSE 'ok' END AS scoring_status,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS run_failures
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
"""
VIEWS["runs"] = _RUNS


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    status = F.when(C("l_returnflag") != "A", F.when(C("l_linestatus") == "F", "ok").otherwise("failed"))
    return lines.join(orders, C("l_orderkey") == C("o_orderkey")).select(
        C("l_orderkey").alias("run_id"),
        status.alias("status"),
        F.when(C("o_orderstatus") == "P", "skipped").otherwise("ok").alias("scoring_status"),
        F.when(C("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("run_failures"),
    )


@query(
    "a10_run_status",
    """
SELECT run_id, n AS expected_samples, ok AS succeeded_samples, n - ok AS failed_samples, ok::DOUBLE / n AS coverage,
       CASE WHEN ok = n AND scored AND clean THEN 'complete' WHEN ok > 0 THEN 'partial' ELSE 'failed' END AS status
FROM (SELECT run_id, count(*) AS n, count(*) FILTER (status = 'ok') AS ok, bool_and(scoring_status = 'ok') AS scored, max(run_failures) = 0 AS clean
      FROM runs GROUP BY run_id)
""",
    ("runs",),
)
def run_status(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.run_status(_runs(spark, sf), ["run_id"])


@query(
    "a11_suite_status",
    """
SELECT o_orderpriority, count(*) AS tasks,
       CASE WHEN bool_and(s = 'complete') THEN 'complete' WHEN bool_or(s IN ('complete', 'partial')) THEN 'partial' ELSE 'failed' END AS status
FROM (SELECT o_orderpriority || '/' || o_custkey AS o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'partial' ELSE 'failed' END AS s FROM orders)
GROUP BY o_orderpriority
""",
)
def suite_status(spark: SparkSession, sf: str) -> DataFrame:
    status = C("o_orderstatus")
    tasks = table(spark, sf, "orders").select(
        F.concat_ws("/", "o_orderpriority", "o_custkey").alias("o_orderpriority"),
        F.when(status == "F", "complete").when(status == "P", "partial").otherwise("failed").alias("status"),
    )
    return suite.suite_status(tasks, ["o_orderpriority"])


@query(
    "a12_running_counts",
    """
SELECT run_id, count(status) AS completed, count(*) FILTER (status = 'ok') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) AS total
FROM runs GROUP BY run_id
""",
    ("runs",),
)
def running_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.run_counts(_runs(spark, sf), ["run_id"])


@query(
    "a13_readiness",
    """
SELECT user_id, NOT bool_or(bad) AS ready, count(*) AS checks, count(*) FILTER (bad) AS failed_checks,
       bool_and(value > 0.5) AS stated_ready, bool_and(value > 0.5) = (NOT bool_or(bad)) AS consistent
FROM (SELECT user_id, value, event_type = 'error' AND value > 40 AS bad FROM events) GROUP BY user_id
""",
)
def readiness(spark: SparkSession, sf: str) -> DataFrame:
    checks = table(spark, sf, "events").select(
        "user_id",
        F.when(C("event_type") == "error", "failed").otherwise("passed").alias("status"),
        F.when(C("value") > 40, "error").otherwise("warning").alias("severity"),
        (C("value") > 0.5).alias("stated_ready"),
    )
    return suite.readiness(checks, ["user_id"])


@query(
    "a15_manifest_statistics",
    "SELECT role, count(*) AS samples, count(*) FILTER (text <> '') AS with_reference, count(*) FILTER (text = '') AS missing_reference "
    "FROM (SELECT role, CASE WHEN role = 'system' THEN '' ELSE text END AS text FROM conversations) GROUP BY role",
)
def manifest_statistics(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    text = F.when(C("role") == "system", "").otherwise(C("text"))
    return reports.manifest_statistics(turns.select("role", text.alias("reference_text")), ["role"])


@query(
    "a16_mean_file_rates",
    sql_rounded("""
SELECT dataset_id, count(*) AS files, avg((w_s + w_d + w_i)::DOUBLE / w_n) AS mean_file_wer, avg((c_s + c_d + c_i)::DOUBLE / c_n) AS mean_file_cer
FROM line_scores WHERE NOT is_silence GROUP BY dataset_id
""", 9, "mean_file_wer", "mean_file_cer"),
    ("line_scores",),
)
def mean_file_rates(spark: SparkSession, sf: str) -> DataFrame:
    means = scoring.mean_file_rates(v.line_scores(spark, sf), ["dataset_id"])
    return rounded(means, 9, "mean_file_wer", "mean_file_cer")


VIEWS["paired_groups"] = """
SELECT *, row_number() OVER (ORDER BY substr(md5(group_id), 1, 3), group_id) - 1 AS slot, count(*) OVER () AS gc
FROM (SELECT a.group_id, sum(a.w_s + a.w_d + a.w_i) AS ae, sum(a.w_n) AS an, sum(b.w_s + b.w_d + b.w_i) AS be, sum(b.w_n) AS bn
      FROM scored a JOIN scored_b b USING (sample_id) WHERE NOT a.is_silence AND NOT b.is_silence GROUP BY a.group_id)
"""
VIEWS["paired_draws"] = _sql_draws("paired_groups", 500)


@query(
    "a17_paired_difference",
    sql_rounded("""
SELECT max(gc) AS group_count, quantile_cont(d, (1 - 0.95::DOUBLE) / 2) AS wer_difference_lower, quantile_cont(d, 1 - (1 - 0.95::DOUBLE) / 2) AS wer_difference_upper
FROM (SELECT replicate, max(x.gc) AS gc, sum(ae)::DOUBLE / sum(an) - sum(be)::DOUBLE / sum(bn) AS d
      FROM paired_draws x JOIN paired_groups g ON g.slot = x.drawn GROUP BY replicate)
""", 9, "wer_difference_lower", "wer_difference_upper"),
    (*v.SCORED, *v.SCORED_B, "paired_groups", "paired_draws"),
)
def paired_difference(spark: SparkSession, sf: str) -> DataFrame:
    first, second = _scored(spark, sf), _scored(spark, sf, "second")
    difference = b.paired_difference(first, second, replicates=500)
    bounds = ("wer_difference_lower", "wer_difference_upper")
    return rounded(difference.select("group_count", *bounds), 9, *bounds)


@query(
    "x2_pluggable_scorer",
    f"SELECT *, {_RATES} FROM (SELECT {_WORD_SUMS} FROM scored WHERE NOT is_silence)",
    v.SCORED,
)
def pluggable_scorer(spark: SparkSession, sf: str) -> DataFrame:
    """Run results adapted to references and recognitions, then given to any scorer."""
    refs, recs = v.references(spark, sf), v.recognitions(spark, sf)
    samples = refs.select("sample_id", "group_id", C("text").alias("reference_text"))
    results = recs.select(
        "sample_id", "status",
        F.when(C("text").isNotNull(), F.struct("text")).alias("transcript"),
        F.when(C("error").isNotNull(), F.struct(C("error").alias("message"))).alias("failure"),
    )
    report = scoring.score_run(samples, results, scoring.evaluate)
    return report.speech.select(*scoring.COUNT_COLUMNS[:4], "wer")
