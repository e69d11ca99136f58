"""Progress folded from events; the streaming form is the same fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbench.plans import views as v
from corpusbench.plans.registry import query, rounded, sql_rounded, table
from corpusbench.sources.payloads import EVENT_MARKER, parse_events
from corpusbench.streaming import progress

C = F.col


@query(
    "s14_t1_event_log",
    "SELECT seq, event, preset_id, status, sample_id, total FROM run_events",
    ("run_events",),
)
def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as log lines among other lines, then read back."""
    events = v.run_events(spark, sf)
    line = F.concat(F.lit("INFO worker "), F.lit(EVENT_MARKER), F.to_json(F.struct(*events.columns)))
    noise = table(spark, sf, "events").select(F.concat(F.lit("loading "), "props").alias("value"))
    lines = events.select(line.alias("value")).unionByName(noise)
    return parse_events(lines).select("seq", "event", "preset_id", "status", "sample_id", "total")


_MODEL = """
SELECT model_key, arg_max(model, seq) AS model,
  CASE WHEN max(seq) FILTER (phase IS NOT NULL) IS NULL THEN CASE WHEN bool_or(event = 'task_started') THEN 'preflight' ELSE 'queued' END ELSE 'transcribing' END AS phase,
  arg_max(CASE event WHEN 'sample_completed' THEN CASE WHEN status = 'failed' THEN 'warning' ELSE 'running' END
                     WHEN 'task_completed' THEN task_status ELSE 'running' END, seq) AS status,
  coalesce(arg_max(attempt, seq) FILTER (coalesce(attempt, 0) <> 0), 0) AS attempt,
  coalesce(arg_max(CASE WHEN event = 'task_completed' THEN succeeded + failed WHEN event = 'sample_completed' AND coalesce(completed, 0) = 0 THEN idx ELSE coalesce(completed, 0) END, seq) FILTER (event <> 'task_started'), 0) AS completed,
  coalesce(arg_max(coalesce(succeeded, 0) + CASE WHEN event = 'sample_completed' AND status <> 'failed' THEN 1 ELSE 0 END, seq) FILTER (event <> 'task_started'), 0) AS succeeded,
  coalesce(arg_max(coalesce(failed, 0) + CASE WHEN event = 'sample_completed' AND status = 'failed' THEN 1 ELSE 0 END, seq) FILTER (event <> 'task_started'), 0) AS failed,
  coalesce(arg_max(total, seq) FILTER (total IS NOT NULL AND event <> 'task_started'), arg_min(coalesce(total, 0), seq)) AS total,
  coalesce(arg_max(CASE WHEN event = 'sample_started' THEN sample_id ELSE '' END, seq) FILTER (event <> 'task_started'), '') AS active_sample,
  coalesce(arg_max(CASE WHEN event = 'task_started' THEN '' ELSE error_code END, seq) FILTER (event = 'task_started' OR error_code IS NOT NULL), '') AS failure_code,
  coalesce(arg_max(CASE WHEN event = 'task_started' THEN '' ELSE message END, seq) FILTER (event = 'task_started' OR message IS NOT NULL), '') AS failure_message,
  CASE WHEN bool_or(event = 'task_started') THEN greatest(0, arg_max(ts, seq) - arg_min(ts, seq) FILTER (event = 'task_started')) END AS elapsed_seconds
FROM run_events GROUP BY model_key
"""


@query("t2_model_progress", sql_rounded(_MODEL, 3, "elapsed_seconds"), ("run_events",))
def model_progress(spark: SparkSession, sf: str) -> DataFrame:
    folded = progress.model_progress(v.run_events(spark, sf))
    shown = folded.select(
        "model_key", "model", "phase", "status", "attempt", "completed", "succeeded", "failed", "total", "active_sample", "failure_code", "failure_message", "elapsed_seconds"
    )
    return rounded(shown, 3, "elapsed_seconds")


@query(
    "t3_sample_progress",
    """
SELECT model_key, sample_id, arg_max(CASE WHEN event = 'sample_started' THEN 'running' ELSE coalesce(status, 'ok') END, seq) AS status,
       arg_max(coalesce(error_code, ''), seq) AS error_code, arg_max(coalesce(message, error_type, ''), seq) AS message, max(seq) AS last_seq
FROM run_events WHERE sample_id IS NOT NULL GROUP BY ALL
""",
    ("run_events",),
)
def sample_progress(spark: SparkSession, sf: str) -> DataFrame:
    folded = progress.sample_progress(v.run_events(spark, sf))
    return folded.select("model_key", "sample_id", "status", "error_code", "message", "last_seq")


@query(
    "t4_suite_status",
    """
SELECT user_id AS suite_id, coalesce(arg_max(CASE event_type WHEN 'signup' THEN 'running' WHEN 'error' THEN 'interrupted' WHEN 'purchase' THEN CASE WHEN value > 20 THEN 'partial' ELSE 'complete' END END, event_id)
  FILTER (event_type IN ('signup', 'error', 'purchase')), 'waiting') AS status FROM events GROUP BY user_id
""",
)
def suite_status(spark: SparkSession, sf: str) -> DataFrame:
    kind, none = C("event_type"), F.lit(None).cast("string")
    event = (
        F.when(kind == "signup", "suite_started").when(kind == "error", "suite_interrupted").when(kind == "purchase", "suite_finished").otherwise("phase_started")
    )
    events = table(spark, sf, "events").select(
        "user_id", C("event_id").alias("seq"), event.alias("event"), F.when(C("value") > 20, "partial").alias("suite_status"), none.alias("status"), none.alias("run_status")
    )
    return progress.suite_progress(events, C("user_id"))


@query(
    "t5_model_elapsed",
    sql_rounded(
        "SELECT model_key, CASE WHEN bool_or(event = 'task_started') THEN greatest(0, arg_max(ts, seq) - arg_min(ts, seq) FILTER (event = 'task_started')) END AS elapsed_seconds FROM run_events GROUP BY model_key",
        3, "elapsed_seconds",
    ),
    ("run_events",),
)
def model_elapsed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(progress.model_elapsed(v.run_events(spark, sf)), 3, "elapsed_seconds")
