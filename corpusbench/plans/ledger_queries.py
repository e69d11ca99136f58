"""Ledgers, work selection, matrices, segments and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbench.operators import ledger, reports, segments, suite
from corpusbench.plans import views as v
from corpusbench.plans.contract_queries import document_files
from corpusbench.plans.registry import VIEWS, query, table

C = F.col


# --- joins with a prior ledger --------------------------------------------------------------------


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    carried = ["status", "attempt", "retryable"]
    current = v.manifest(spark, sf).withColumns({c: F.lit(None) for c in carried})
    return ledger.merge_with_ledger(current, v.prior(spark, sf), "source_id", carried)


VIEWS["merged"] = """
SELECT m.source_id, ord, lang, source, coalesce(status, 'pending') AS status, attempt, retryable, status IS NOT NULL AS has_prior
FROM manifest m LEFT JOIN prior p USING (source_id)
"""
_MERGED = ("manifest", "prior", "merged")


@query("j5_merge_with_ledger", "SELECT source_id, lang, status, attempt, has_prior FROM merged", _MERGED)
def merge(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).select("source_id", "lang", "status", "attempt", "has_prior")


@query(
    "j3_pending_and_orphans",
    """
SELECT conv_id AS source_id, 'pending' AS side FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'orphan' FROM labels WHERE doc_id NOT IN (SELECT conv_id FROM conversations)
""",
)
def pending_and_orphans(spark: SparkSession, sf: str) -> DataFrame:
    sources = table(spark, sf, "conversations").select(C("conv_id").alias("source_id")).distinct()
    outcomes = table(spark, sf, "labels").select(C("doc_id").alias("source_id"))
    waiting = ledger.pending(sources, outcomes, "source_id").select("source_id", F.lit("pending").alias("side"))
    lost = ledger.orphans(outcomes, sources, "source_id").select("source_id", F.lit("orphan").alias("side"))
    return waiting.unionByName(lost)


@query(
    "u4_id_set_difference",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def id_difference(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query(
    "j6_changed_meaning",
    "SELECT doc_id AS source_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 OR lang = 'fr'",
)
def changed(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents whose stored language differs: toxic ones lost it, French was another."""
    current = v.manifest(spark, sf)
    stored = table(spark, sf, "labels").join(
        table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id"
    ).select(
        C("doc_id").alias("source_id"),
        F.when(C("toxic") == 0, F.when(C("lang") == "fr", "pt").otherwise(C("lang"))).alias("lang"),
        "source",
    )
    return ledger.changed_meaning(current, stored, "source_id", ["lang", "source"])


@query(
    "j4_audio_sidecars",
    """
SELECT replace(lang || '/' || doc_id, '/', '__') AS sample_id, lang || '/' || doc_id || '.wav' AS audio_path, coalesce(trim(t.text), '') AS reference_text, t.text IS NULL AS reference_missing
FROM documents d LEFT JOIN (SELECT item_id, text FROM benchmark) t ON t.item_id = d.doc_id
""",
)
def sidecars(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as audio files; those with a benchmark item of their number have a text beside."""
    from corpusbench.sources.manifests import join_references

    docs = table(spark, sf, "documents")
    stem = F.concat_ws("/", "lang", "doc_id")
    audio = docs.select(F.concat(stem, F.lit(".wav")).alias("relative_path"), F.lit(None).cast("string").alias("sha256"))
    texts = docs.select(C("doc_id").alias("item_id"), "lang").join(table(spark, sf, "benchmark"), "item_id")
    texts = texts.select(F.concat(F.concat_ws("/", "lang", "item_id"), F.lit(".txt")).alias("relative_path"), "text")
    return join_references(audio, texts).select("sample_id", "audio_path", "reference_text", "reference_missing")


@query(
    "w2_latest_per_key",
    "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def latest(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return ledger.latest_per_key(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query(
    "u5_upsert",
    """
SELECT doc_id AS source_id, lang AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT source_id, status FROM prior
""",
    ("prior",),
)
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    previous = v.manifest(spark, sf).select("source_id", C("lang").alias("status"))
    return ledger.upsert(previous, v.prior(spark, sf).select("source_id", "status"), ["source_id"])


@query("o5_manifest_order", "SELECT ord, source_id, status FROM merged", _MERGED)
def manifest_order(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.in_manifest_order(_merged(spark, sf)).select("ord", "source_id", "status")


@query("o1_sorted_paths", "SELECT url FROM pages")
def sorted_paths(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.in_manifest_order(table(spark, sf, "pages").select("url"), "url")


# --- work selection -------------------------------------------------------------------------------


@query(
    "r1_book_work",
    "SELECT source_id, status, needs_run, NOT needs_run AS reused_existing FROM (SELECT *, NOT (status IN ('found', 'partial') OR (status = 'error' AND NOT retryable)) AS needs_run FROM merged)",
    _MERGED,
)
def book_work(spark: SparkSession, sf: str) -> DataFrame:
    merged = _merged(spark, sf).withColumnRenamed("retryable", "issue_retryable")
    return ledger.select_book_work(merged).select("source_id", "status", "needs_run", "reused_existing")


@query(
    "r2_poem_work",
    "SELECT source_id, NOT (status IN ('found', 'partial') OR (status = 'error' AND NOT retryable)) AS needs_run FROM merged",
    _MERGED,
)
def poem_work(spark: SparkSession, sf: str) -> DataFrame:
    merged = _merged(spark, sf).withColumnRenamed("retryable", "error_retryable")
    return ledger.select_poem_work(merged).select("source_id", "needs_run")


def _issues(code: object, message: object, retryable: object, present: object) -> object:
    issue = F.struct(code.alias("code"), message.alias("message"), retryable.alias("retryable"))
    return F.when(present, F.array(issue)).otherwise(F.filter(F.array(issue), lambda _: F.lit(False)))


@query(
    "r3_lyrics_work",
    """
SELECT event_id, CASE event_type WHEN 'signup' THEN true WHEN 'view' THEN true WHEN 'click' THEN false WHEN 'purchase' THEN true
  ELSE value > 20 OR value < 5 END AS needs_run FROM events
""",
)
def lyrics_work(spark: SparkSession, sf: str) -> DataFrame:
    """Errors are retried when retryable (above 20) or rejected tokens (below 5, in old wording)."""
    kind, value = C("event_type"), C("value")
    status = (
        F.when(kind == "signup", "pending").when(kind == "view", "not_found").when(kind == "click", "complete")
        .when(kind == "purchase", "partial").otherwise("error")
    )
    message = F.when(value < 5, "returned HTTP 403").otherwise("returned HTTP 500")
    issues = _issues(F.lit("http_error"), message, value > 20, kind == "error")
    merged = table(spark, sf, "events").select("event_id", status.alias("status"), issues.alias("issues"))
    return ledger.select_lyrics_work(merged).select("event_id", "needs_run")


_MEDIA_VIEWS = ("files", "media")
VIEWS["media"] = """
SELECT conv_id * 8 + turn AS n, quality, toxic, d.text FROM conversations LEFT JOIN labels ON doc_id = conv_id * 8 + turn LEFT JOIN documents d ON d.doc_id = conv_id * 8 + turn
"""


def _media(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns as tasks, labels as earlier records of their files (documents of the same number)."""
    labels = table(spark, sf, "labels").select(C("doc_id").alias("n"), "quality", "toxic")
    texts = table(spark, sf, "documents").select(C("doc_id").alias("n"), "text")
    tasks = table(spark, sf, "conversations").select((C("conv_id") * 8 + C("turn")).alias("n"))
    name = C("n").cast("string")
    known = labels.join(texts, "n")
    digest = F.when(C("toxic") == 1, F.md5(C("text").cast("binary"))).otherwise(F.sha2(C("text").cast("binary"), 256))
    good = C("quality") == 1
    records = known.select(
        name.alias("request_id"), F.when(good, "complete").otherwise("failed").alias("status"), (C("toxic") + 1).alias("attempt"),
        F.when(good, name).alias("audio_path"), F.when(good, name).alias("reference_path"), F.when(good, digest).alias("sha256"),
        F.when(~good, C("toxic") == 1).alias("retryable"),
    )
    return tasks.select(name.alias("request_id")), records, document_files(spark, sf)


@query(
    "r4_media_work",
    """
SELECT CAST(n AS VARCHAR) AS request_id, NOT coalesce(toxic = 0, false) AS needs_run, coalesce(toxic + 1, 0) + 1 AS next_attempt FROM media
""",
    _MEDIA_VIEWS,
)
def media_work(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.select_media_work(*_media(spark, sf)).select("request_id", "needs_run", "next_attempt")


@query(
    "r8_media_records",
    """
SELECT CAST(n AS VARCHAR) AS request_id, CASE WHEN text IS NOT NULL AND n >= 100 THEN 'complete' ELSE 'failed' END AS status, coalesce(toxic + 1, 0) + 1 AS attempt,
       CASE WHEN text IS NOT NULL AND n >= 100 THEN n || '.wav' END AS audio_path, CASE WHEN text IS NOT NULL AND n >= 100 THEN strlen(text) END AS bytes,
       CASE WHEN n < 100 THEN 'network' WHEN text IS NULL THEN 'missing_output' END AS error_code,
       CASE WHEN n < 100 THEN false WHEN text IS NULL THEN true END AS retryable
FROM media WHERE NOT coalesce(toxic = 0, false)
""",
    _MEDIA_VIEWS,
)
def media_records(spark: SparkSession, sf: str) -> DataFrame:
    """Fetches of the first hundred requests fail; a fetch without a file is a retryable failure."""
    tasks, records, files = _media(spark, sf)
    selected = ledger.select_media_work(tasks, records, files)
    selected = selected.withColumns({"video_id": F.lit("abcdefghijk"), "source_url": F.lit("https://youtu.be/abcdefghijk")})
    failed = C("request_id").cast("bigint") < 100
    fetched = tasks.select(
        "request_id", F.lit(1.5).alias("duration_seconds"), F.when(failed, "network").alias("error_code"),
        F.when(failed, "fetch failed").alias("error_message"), F.when(failed, F.lit(False)).alias("error_retryable"),
    )
    waves = files.withColumn("path", F.concat("path", F.lit(".wav")))
    made = ledger.media_records(selected, fetched, waves)
    return made.select("request_id", "status", "attempt", "audio_path", "bytes", "error_code", "retryable")


@query(
    "w4_attempt_numbers",
    """
SELECT c_custkey, coalesce(n, 0) + 1 AS attempt, 1 AS restarted FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON user_id = c_custkey
""",
)
def attempts(spark: SparkSession, sf: str) -> DataFrame:
    tried = table(spark, sf, "events").groupBy(C("user_id").alias("c_custkey")).agg(F.count("*").alias("n"))
    joined = table(spark, sf, "customer").select("c_custkey").join(tried, "c_custkey", "left")
    return joined.select(
        "c_custkey", ledger.next_attempt(C("n")).alias("attempt"), ledger.next_attempt(C("n"), restart=True).alias("restarted")
    )


@query(
    "w5_circuit_breaker",
    """
SELECT o_custkey, o_orderkey, coalesce(o_orderkey <= min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END) OVER (PARTITION BY o_custkey), true) AS saved FROM orders
""",
)
def circuit_breaker(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer in order; an urgent one is rejected for its rate and stops the batch."""
    urgent = C("o_orderpriority") == "1-URGENT"
    issues = _issues(F.lit("rate_limit"), F.lit("slow down"), F.lit(True), urgent)
    results = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", ledger.is_blocking(issues).alias("blocking")
    )
    stopped = ledger.stop_at_first_blocking(results, ["o_custkey"], "o_orderkey")
    return stopped.select("o_custkey", "o_orderkey", "saved")


@query(
    "r7_interrupted_state",
    """
SELECT o_custkey, count(*) FILTER (done) AS completed, count(*) FILTER (NOT done) AS pending, min(o_orderkey) FILTER (NOT done) AS next_key,
       CASE WHEN bool_and(done) THEN 'finished' ELSE 'interrupted' END AS state
FROM (SELECT o_custkey, o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AS done FROM orders) GROUP BY o_custkey
""",
)
def interrupted(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "orders").select("o_custkey", "o_orderkey", C("o_orderkey").alias("ord"))
    done = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(C("l_orderkey").alias("o_orderkey")).distinct()
    results = asked.join(done, "o_orderkey", "left_semi").select("o_custkey", "o_orderkey")
    return ledger.interrupted_state(asked, results, ["o_custkey"], "o_orderkey")


# --- matrix ---------------------------------------------------------------------------------------

PRESETS = ("small", "base", "large")


def _datasets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(C("source").alias("dataset_id")).agg(F.count("*").alias("samples"))


VIEWS["datasets"] = "SELECT source AS dataset_id, count(*) AS samples FROM documents GROUP BY source"
VIEWS["matrix"] = "SELECT dataset_id, samples, preset_id, preset_ord FROM datasets, (VALUES ('small', 0), ('base', 1), ('large', 2)) p(preset_id, preset_ord)"


@query("j12_task_matrix", "SELECT dataset_id, preset_id, preset_ord, 'pending' AS status, 0 AS attempt FROM matrix", ("datasets", "matrix"))
def matrix(spark: SparkSession, sf: str) -> DataFrame:
    tasks = suite.task_matrix(_datasets(spark, sf), PRESETS)
    return tasks.select("dataset_id", "preset_id", "preset_ord", "status", "attempt")


@query(
    "j12_seeded_progress",
    "SELECT dataset_id || '::' || preset_id AS model_key, samples AS total, CASE WHEN preset_id = 'large' THEN 'setup' ELSE 'queued' END AS phase, "
    "CASE WHEN preset_id = 'large' THEN 'missing-worker' ELSE 'queued' END AS status, 0 AS completed FROM matrix",
    ("datasets", "matrix"),
)
def seeded(spark: SparkSession, sf: str) -> DataFrame:
    tasks = suite.task_matrix(_datasets(spark, sf), PRESETS)
    return suite.seeded_progress(tasks, C("preset_id") == "large").select("model_key", "total", "phase", "status", "completed")


@query(
    "j13_task_dataset",
    "SELECT doc_id, dataset_id, samples FROM documents JOIN datasets ON dataset_id = source",
    ("datasets",),
)
def task_dataset(spark: SparkSession, sf: str) -> DataFrame:
    tasks = table(spark, sf, "documents").select("doc_id", C("source").alias("dataset_id"))
    return suite.with_dataset(tasks, _datasets(spark, sf)).select("doc_id", "dataset_id", "samples")


@query(
    "r5_suite_work",
    """
SELECT c_custkey, CASE WHEN status = 'complete' AND result THEN 'skip' WHEN status IN ('running', 'interrupted') AND n > 0 AND checkpoint AND NOT result THEN 'resume' ELSE 'run' END AS action,
       CASE WHEN status = 'complete' AND result THEN n WHEN status IN ('running', 'interrupted') AND n > 0 AND checkpoint AND NOT result THEN n ELSE n + 1 END AS attempt
FROM (SELECT c_custkey, coalesce(n, 0) AS n, CASE c_mktsegment WHEN 'BUILDING' THEN 'complete' WHEN 'MACHINERY' THEN 'running' WHEN 'FURNITURE' THEN 'interrupted' ELSE 'failed' END AS status,
        coalesce(c_acctbal > 3000 AND n IS NOT NULL, false) AS result, coalesce(c_acctbal > 0 AND n IS NOT NULL, false) AS checkpoint
      FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON user_id = c_custkey)
""",
)
def suite_work(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as tasks: segment as stored status, balance as the artifacts found."""
    tried = table(spark, sf, "events").groupBy(C("user_id").alias("c_custkey")).agg(F.count("*").alias("n"))
    base = table(spark, sf, "customer").join(tried, "c_custkey", "left").select(
        C("c_custkey").alias("dataset_id"), F.lit("small").alias("preset_id"), "c_mktsegment", "c_acctbal", F.coalesce("n", F.lit(0)).alias("attempt"), "n",
    )
    segment = C("c_mktsegment")
    status = F.when(segment == "BUILDING", "complete").when(segment == "MACHINERY", "running").when(segment == "FURNITURE", "interrupted").otherwise("failed")
    stored = base.select("dataset_id", "preset_id", status.alias("status"), "attempt")
    artifacts = base.where("n IS NOT NULL").select(
        "dataset_id", "preset_id", "attempt", (C("c_acctbal") > 0).alias("has_checkpoint"), (C("c_acctbal") > 3000).alias("has_result")
    )
    tasks = base.select("dataset_id", "preset_id", F.lit("pending").alias("status"), F.lit(0).alias("attempt"))
    work = suite.select_suite_work(tasks, stored, artifacts)
    return work.select(C("dataset_id").alias("c_custkey"), "action", "attempt")


@query(
    "r6_plan_conflicts",
    """
SELECT c_custkey AS run_id, CASE WHEN n IS NOT NULL THEN 'existing run uses a different plan' ELSE 'output is not empty and has no ledger' END AS conflict
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderstatus) AS s FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
WHERE (n IS NOT NULL AND s <> 'F') OR (n IS NULL AND c_acctbal > 0)
""",
)
def plan_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    plans = table(spark, sf, "customer").select(
        C("c_custkey").alias("run_id"), F.sha2(F.lit("F").cast("binary"), 256).alias("fingerprint"), (C("c_acctbal") <= 0).alias("target_is_empty")
    )
    stored = table(spark, sf, "orders").groupBy(C("o_custkey").alias("run_id")).agg(F.min("o_orderstatus").alias("s"))
    ledgers = stored.select("run_id", F.sha2(C("s").cast("binary"), 256).alias("fingerprint"))
    return suite.plan_conflicts(plans, ledgers)


VIEWS["numbered"] = "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord FROM orders"


@query(
    "j16_resume_problems",
    """
SELECT o_custkey, o_orderkey AS sample_id, 'not_a_prefix' AS problem FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000 AND o_orderpriority <> '5-LOW'
UNION ALL SELECT o_custkey, o_orderkey, 'failure_not_listed' FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'
UNION ALL SELECT o_custkey, last_key, 'gap' FROM (SELECT o_custkey, max(k) AS last_key, count(*) AS n, max(ord) + 1 AS m FROM (
    SELECT o_custkey, ord, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN -o_orderkey ELSE o_orderkey END AS k, o_orderpriority FROM numbered)
    WHERE o_orderpriority <> '5-LOW' GROUP BY o_custkey) WHERE n <> m
UNION ALL SELECT o_custkey, max(o_orderkey), 'wrong_active_sample' FROM numbered GROUP BY o_custkey
  HAVING coalesce(max(ord) FILTER (o_orderpriority <> '5-LOW') + 1, 0) <> count(*) - 1
""",
    ("numbered",),
)
def resume_problems(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as a manifest; results miss low-priority rows and misname expensive ones; the
    last order is said to be the active one."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    placed = reports.positions(orders, ["o_custkey"], "o_orderkey").withColumn("ord", C("position") - 1)
    key = C("o_orderkey")
    planned = placed.select("o_custkey", "ord", key.alias("sample_id"))
    kept = placed.where("o_orderpriority <> '5-LOW'")
    wrong = (C("o_orderstatus") == "F") & (C("o_totalprice") > 400000)
    results = kept.select(
        "o_custkey", "ord", F.when(wrong, -key).otherwise(key).alias("sample_id"),
        F.when(C("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"), "o_orderpriority",
    )
    failures = results.where("status = 'failed' AND o_orderpriority <> '1-URGENT'").select("o_custkey", "sample_id")
    active = planned.groupBy("o_custkey").agg(F.max("sample_id").alias("sample_id"))
    found = suite.resume_problems(planned, results.drop("o_orderpriority"), failures, active, ["o_custkey"])
    return found.select("o_custkey", F.when(C("problem") == "not_a_prefix", -C("sample_id")).otherwise(C("sample_id")).alias("sample_id"), "problem")



@query(
    "j17_identity_differences",
    """
SELECT c_custkey, concat_ws(',', CASE WHEN c_mktsegment <> 'BUILDING' THEN 'model' END, CASE WHEN c_acctbal > 0 THEN 'requested_device' END, CASE WHEN c_nationkey > 5 AND c_acctbal > 100 THEN 'quantization' END) AS mismatched
FROM customer
""",
)
def identity_differences(spark: SparkSession, sf: str) -> DataFrame:
    customers, same, none = table(spark, sf, "customer"), F.lit("x"), F.lit(None).cast("string")

    def run(model: object, device: object, quantization: object) -> DataFrame:
        return customers.select(
            "c_custkey", same.alias("backend_id"), model.alias("model"), none.alias("language"), device.alias("requested_device"), same.alias("requested_precision"),
            none.alias("preset_id"), none.alias("runtime_id"), none.alias("model_revision_requested"), quantization.alias("quantization"),
        )

    now = run(C("c_mktsegment"), F.when(C("c_acctbal") <= 0, "cpu"), F.when(C("c_nationkey") > 5, "int8"))
    then = run(F.lit("BUILDING"), F.lit("cpu"), F.when(C("c_acctbal") <= 100, "int8"))
    found = suite.identity_differences(now, then, "c_custkey")
    return found.select("c_custkey", F.array_join("mismatched", ",").alias("mismatched"))


# --- reports --------------------------------------------------------------------------------------

VIEWS["failed_events"] = """
SELECT user_id AS model_key, event_id AS seq, CASE WHEN value > 40 THEN 'cuda_oom' WHEN value > 10 THEN 'RuntimeError' ELSE 'unknown_failure' END AS kind,
       CASE WHEN value > 40 THEN 'cuda_oom: out of memory' WHEN value > 10 THEN 'RuntimeError: ' || props ELSE 'unknown_failure' END AS detail
FROM events WHERE event_type = 'error'
"""
VIEWS["failure_kinds"] = "SELECT model_key, kind, count(*) AS failures, arg_min(detail, seq) AS detail FROM failed_events GROUP BY ALL"


def _event_samples(spark: SparkSession, sf: str) -> DataFrame:
    value = C("value")
    return table(spark, sf, "events").select(
        C("user_id").alias("model_key"), C("user_id").alias("dataset_id"), F.lit("m").alias("preset_id"), C("event_id").alias("seq"),
        F.when(C("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.when(value > 40, "cuda_oom").otherwise("").alias("error_code"),
        F.when(value > 10, "RuntimeError").alias("error_type"),
        F.when(value > 40, "out of memory").when(value > 10, C("props")).otherwise("").alias("message"),
    )


@query(
    "a14_dominant_failures",
    """
SELECT model_key, failures, detail FROM failure_kinds WHERE model_key IN (SELECT c_custkey FROM customer)
QUALIFY row_number() OVER (PARTITION BY model_key ORDER BY failures DESC, detail) = 1
UNION ALL SELECT c_custkey, greatest(1, c_nationkey), 'ModelError: ' || c_name FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT model_key FROM failed_events)
""",
    ("failed_events", "failure_kinds"),
)
def dominant(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as models; those in credit failed as a whole where no event did."""
    bad = C("c_acctbal") > 0
    models = table(spark, sf, "customer").select(
        C("c_custkey").alias("model_key"), C("c_nationkey").alias("failed"), F.lit("").alias("failure_code"),
        F.when(bad, "ModelError").alias("failure_type"), F.when(bad, C("c_name")).alias("failure_message"),
    )
    return reports.dominant_failures(_event_samples(spark, sf), models)


@query(
    "w7_collapsed_details",
    """
SELECT event_id AS seq, CASE WHEN message = '' THEN NULL WHEN event_type <> 'error' OR event_id = max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id, kind) THEN message END AS shown_message
FROM (SELECT *, CASE WHEN value > 40 THEN 'out of memory' WHEN value > 10 THEN props ELSE '' END AS message, CASE WHEN value > 40 THEN 'a' WHEN value > 10 THEN 'b' ELSE 'c' END AS kind FROM events)
""",
)
def collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return reports.collapse_repeated_details(_event_samples(spark, sf)).select("seq", "shown_message")


@query(
    "w6_positions",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position, count(*) OVER (PARTITION BY user_id) AS total FROM events",
)
def positions(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id")
    return reports.positions(events, ["user_id"], "event_id", bucket_rows=1000)


@query(
    "w8_sample_recency",
    "SELECT user_id, event_type, max(event_id) AS last_seen, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type",
)
def recency(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    newest = reports.sample_recency(events, ["user_id", "event_type"], ["event_id"])
    return newest.select("user_id", "event_type", "last_seen", "value")


@query(
    "o3_preview_with_remainder",
    """
SELECT lang, doc_id, rank, greatest(0, n - 5) AS additional
FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE rank <= 5
""",
)
def preview(spark: SparkSession, sf: str) -> DataFrame:
    return reports.error_preview(table(spark, sf, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"])


@query(
    "s15_batch_summary",
    """
SELECT CAST(p_partkey AS VARCHAR) AS preset, p_name AS output,
       CASE WHEN p_size > 40 THEN 'skipped-missing-worker' WHEN p_size > 30 THEN 'preflight-failed' WHEN p_type = 'SMALL' THEN 'complete' ELSE 'failed' END AS status FROM part
""",
)
def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    tasks = table(spark, sf, "part").select(
        C("p_partkey").cast("string").alias("preset_id"), C("p_name").alias("output_dir"), (C("p_size") <= 40).alias("worker_found"),
        (C("p_size") <= 30).alias("preflight_ok"), F.when(C("p_type") == "SMALL", "complete").otherwise("partial").alias("status"),
    )
    return reports.batch_summary(tasks)


# --- segments -------------------------------------------------------------------------------------


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        C("o_orderkey").alias("sample_id"), F.floor("o_totalprice").cast("bigint").alias("n_samples"), F.lit(1600).alias("sample_rate")
    )


@query(
    "t7_fixed_windows",
    """
SELECT o_orderkey AS sample_id, w AS window, w * 48000 AS start, least((w + 1) * 48000, n) AS stop
FROM (SELECT o_orderkey, n, unnest(range(greatest(1, (n + 47999) // 48000))) AS w FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders))
""",
)
def windows(spark: SparkSession, sf: str) -> DataFrame:
    return segments.fixed_windows(_spans(spark, sf), 30).select("sample_id", "window", "start", "stop")


@query(
    "t7_balanced_windows",
    """
SELECT o_orderkey AS sample_id, w AS window, CASE WHEN moved AND w = k - 1 THEN n - want ELSE w * 48000 END AS start,
       CASE WHEN moved AND w = k - 2 THEN n - want ELSE least((w + 1) * 48000, n) END AS stop
FROM (SELECT *, k >= 2 AND n - (k - 1) * 48000 < want AS moved, unnest(range(k)) AS w
      FROM (SELECT *, least(16000, (n - (k - 2) * 48000) // 2) AS want
            FROM (SELECT *, (n + 47999) // 48000 AS k FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders) WHERE n > 0)))
""",
)
def balanced(spark: SparkSession, sf: str) -> DataFrame:
    found = segments.balanced_windows(_spans(spark, sf), 30, minimum_final_seconds=10)
    return found.select("sample_id", "window", "start", "stop")


@query(
    "t8_merge_segments",
    """
SELECT conv_id AS sample_id, coalesce(string_agg(t, chr(10) ORDER BY turn) FILTER (t <> ''), '') AS text, arg_min(role, turn) AS language, count(*) AS segments
FROM (SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN '' ELSE text END AS t FROM conversations) GROUP BY conv_id
""",
)
def merged_text(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(
        C("conv_id").alias("sample_id"), C("turn").alias("ord"), F.when(C("role") == "system", "").otherwise(C("text")).alias("text"), C("role").alias("language")
    )
    return segments.merge_segments(turns, "\n")


@query(
    "u3_field_differences",
    """
SELECT source_key, len(list_filter(e, lambda w: NOT list_contains(a, w))) AS missing, len(list_filter(a, lambda w: NOT list_contains(e, w))) AS unknown
FROM (SELECT p_partkey AS source_key, string_split(p_name, ' ') AS e, string_split(lower(p_brand) || ' ' || p_name || ' ' || lower(p_type), ' ') AS a FROM part)
""",
)
def field_differences(spark: SparkSession, sf: str) -> DataFrame:
    expected = F.split("p_name", " ")
    actual = F.split(F.concat_ws(" ", F.lower("p_brand"), "p_name", F.lower("p_type")), " ")
    return table(spark, sf, "part").select(
        C("p_partkey").alias("source_key"),
        F.size(F.array_except(expected, actual)).alias("missing"),
        F.size(F.array_except(actual, expected)).alias("unknown"),
    )


