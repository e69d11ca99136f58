import pytest
from pyspark.sql import functions as F

from corpusbench.contracts import rulesets
from corpusbench.contracts.rules import validate
from corpusbench.operators import ledger, reports, segments, suite

C = F.col
LYRICS = "request_id string, status string, issues array<struct<stage:string,code:string,message:string,retryable:boolean>>"


def issue(code, message="m", retryable=False):
    return [("search", code, message, retryable)]


def test_audio_sample_rules(spark):
    rows = [
        ("a", "x/a.wav", "", None), ("b", "../a.wav", "", None), ("c", "/a.wav", "", None), ("d.wav", "d.wav", "", None), ("e", "a\\b.wav", "", None),
        (" ", "f.wav", "", None), ("g", "g.wav", None, None), ("h", "h.wav", "", "A" * 64), ("i", "i.wav", "", "zz"), ("j", ".", "", None),
    ]
    frame = spark.createDataFrame(rows, "sample_id string, audio_path string, reference_text string, sha256 string")
    frame = frame.withColumns({n: F.lit(None).cast("string") for n in ("group_id", "split", "source")})
    valid, broken = validate(frame, rulesets.audio_sample(), "sample_id")
    assert sorted(r.sample_id for r in valid.collect()) == ["a", "h"]
    assert {(r.sample_id, r.rule) for r in broken.collect()} == {
        ("b", "below_root"), ("c", "relative"), ("d.wav", "identity"), ("e", "separator"), (" ", "sample_id"), ("g", "reference_text"),
        ("i", "sha256"), ("j", "below_root"),
    }


def test_latest_and_upsert(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "key string, attempt int, status string")
    latest = ledger.latest_per_key(rows, ["key"], ["attempt"])
    assert sorted(tuple(r) for r in latest.collect()) == [("a", 3, "y"), ("b", 2, "z")]
    new = spark.createDataFrame([("b", 3, "n"), ("c", 1, "n")], rows.schema)
    assert sorted(tuple(r) for r in ledger.upsert(latest, new, ["key"]).collect()) == [("a", 3, "y"), ("b", 3, "n"), ("c", 1, "n")]


def test_merge_refreshes_sources_and_drops_departed_keys(spark):
    current = spark.createDataFrame([("a", "new title", None), ("c", "c", None)], "key string, title string, status string")
    previous = spark.createDataFrame([("a", "old title", "found"), ("b", "b", "found")], "key string, title string, status string")
    merged = ledger.merge_with_ledger(current, previous, "key", ["status"])
    assert {(r.key, r.title, r.status, r.has_prior) for r in merged.collect()} == {("a", "new title", "found", True), ("c", "c", "pending", False)}
    assert [r.key for r in ledger.changed_meaning(current, previous, "key", ["title"]).collect()] == ["a"]


def test_book_and_poem_work(spark):
    rows = [("found", None), ("partial", None), ("not_found", None), ("error", True), ("error", False), ("pending", None)]
    merged = spark.createDataFrame(rows, "status string, issue_retryable boolean")

    def run(**policy):
        return [r.needs_run for r in ledger.select_book_work(merged, **policy).collect()]

    assert run() == [False, False, True, True, False, True]
    assert run(retry_not_found=False) == [False, False, False, True, False, True]
    assert run(retry_nonretryable_errors=True) == [False, False, True, True, True, True]
    assert run(force=True) == [True] * 6
    poems = ledger.select_poem_work(merged.withColumnRenamed("issue_retryable", "error_retryable"))
    assert [r.needs_run for r in poems.collect()] == [False, False, True, True, False, True]


def test_lyrics_work(spark):
    rows = [
        ("a", "complete", []), ("b", "not_found", []), ("c", "partial", issue("not_found")), ("d", "error", issue("authentication")),
        ("e", "error", issue("http_error", "HTTP 403")), ("f", "error", issue("http_error", "HTTP 500", True)), ("g", "error", issue("invalid_json")), ("h", "pending", None),
    ]
    merged = spark.createDataFrame(rows, LYRICS)

    def run(**policy):
        return "".join(r.request_id for r in ledger.select_lyrics_work(merged, **policy).collect() if r.needs_run)

    assert run() == "bcdefh"
    assert run(retry_not_found=False, retry_partial=False) == "defh"
    assert run(retry_nonretryable_errors=True) == "bcdefgh"


def test_circuit_breaker(spark):
    rows = [("r", 0, "a", []), ("r", 1, "b", issue("rate_limit")), ("r", 2, "c", []), ("s", 0, "d", issue("http_error", "HTTP 429")), ("s", 1, "e", []), ("t", 0, "f", issue("http_error", "HTTP 500"))]
    frame = spark.createDataFrame(rows, "run string, ord int, key string, issues array<struct<stage:string,code:string,message:string,retryable:boolean>>")
    marked = frame.withColumn("blocking", ledger.is_blocking(C("issues")))
    saved = ledger.stop_at_first_blocking(marked, ["run"])
    assert "".join(sorted(r.key for r in saved.where("saved").collect())) == "abdf"


def test_attempts(spark):
    frame = spark.createDataFrame([(None,), (2,)], "n int")
    assert [r[0] for r in frame.select(ledger.next_attempt(C("n"))).collect()] == [1, 3]
    assert [r[0] for r in frame.select(ledger.next_attempt(C("n"), restart=True)).collect()] == [1, 1]


def test_media_retry(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "request_id string")
    records = spark.createDataFrame(
        [("a", "complete", 1, "a.wav", "a.txt", "h1", None), ("b", "complete", 1, "b.wav", "b.txt", "h2", None), ("c", "failed", 1, None, None, None, True), ("d", "failed", 4, None, None, None, False)],
        "request_id string, status string, attempt int, audio_path string, reference_path string, sha256 string, retryable boolean",
    )
    files = spark.createDataFrame([("a.wav", "h1"), ("a.txt", "t"), ("b.wav", "changed"), ("b.txt", "t")], "path string, sha256 string")
    found = {r.request_id: (r.needs_run, r.next_attempt) for r in ledger.select_media_work(tasks, records, files).collect()}
    assert found == {"a": (False, 2), "b": (True, 2), "c": (True, 2), "d": (False, 5), "e": (True, 1)}


def test_ledger_problems_and_interruptions(spark):
    sources = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    outcomes = spark.createDataFrame([("a", "pending"), ("x", "found")], "key string, status string")
    found = {(r.key, r.rule) for r in ledger.ledger_problems(sources, outcomes, "key", "finished").collect()}
    assert found == {("b", "duplicate_source"), ("x", "unknown_source"), ("b", "missing_outcome"), ("a", "pending_outcome")}
    header = spark.createDataFrame([("running", "E", None), ("interrupted", None, None), ("interrupted", "E", "m"), ("finished", None, "m")], "s string, t string, m string")
    problem = ledger.interruption_problem(C("s"), C("t"), C("m"))
    assert [r[0] is None for r in header.select(problem).collect()] == [False, False, True, False]


def test_suite_resume(spark):
    datasets = spark.createDataFrame([("d", 3)], "dataset_id string, samples bigint")
    tasks = suite.task_matrix(datasets, ["a", "b", "c", "e"])
    stored = spark.createDataFrame([("d", "a", "complete", 1), ("d", "b", "failed", 1), ("d", "c", "running", 2)], "dataset_id string, preset_id string, status string, attempt int")
    artifacts = spark.createDataFrame([("d", "a", 1, True, True), ("d", "b", 1, True, True), ("d", "c", 2, True, False)], "dataset_id string, preset_id string, attempt int, has_checkpoint boolean, has_result boolean")
    found = {r.preset_id: (r.action, r.attempt) for r in suite.select_suite_work(tasks, stored, artifacts).collect()}
    assert found == {"a": ("skip", 1), "b": ("run", 2), "c": ("resume", 2), "e": ("run", 1)}
    with pytest.raises(ValueError):
        suite.task_matrix(datasets, [])


@pytest.mark.parametrize("statuses, expected", [(["complete"] * 2, "complete"), (["complete", "failed"], "partial"), (["partial"], "partial"), (["failed"], "failed"), ([], "failed")])
def test_suite_status(spark, statuses, expected):
    tasks = spark.createDataFrame([(s,) for s in statuses], "status string")
    assert suite.suite_status(tasks).first().status == expected


def test_plan_conflicts(spark):
    plans = spark.createDataFrame([("a", "f", True), ("b", "f", True), ("c", "f", False)], "run_id string, fingerprint string, target_is_empty boolean")
    ledgers = spark.createDataFrame([("a", "f"), ("b", "other")], "run_id string, fingerprint string")
    assert sorted(r.run_id for r in suite.plan_conflicts(plans, ledgers).collect()) == ["b", "c"]
    assert sorted(r.run_id for r in suite.plan_conflicts(plans, ledgers, resume=False).collect()) == ["a", "b", "c"]


def test_host_may_only_differ_in_its_runtime(spark):
    rows = [((1, 2), (1, 3)), ((1, 2), (2, 2))]
    frame = spark.createDataFrame(rows, "a struct<cpus:int,cuda_runtime_version:int>, b struct<cpus:int,cuda_runtime_version:int>")
    differs = suite.host_differs(C("a"), C("b"), ["cpus", "cuda_runtime_version"])
    assert [r[0] for r in frame.select(differs).collect()] == [False, True]


def test_resume_needs_an_ordered_prefix(spark):
    manifest = spark.createDataFrame([("r", i, s) for i, s in enumerate("abcd")], "run string, ord int, sample_id string")
    schema = "run string, ord int, sample_id string, status string"
    none = spark.createDataFrame([], "run string, sample_id string")

    def problems(results, failures=none, active=none):
        frame = spark.createDataFrame(results, schema)
        return {r.problem for r in suite.resume_problems(manifest, frame, failures, active, ["run"]).collect()}

    assert problems([("r", 0, "a", "ok"), ("r", 1, "b", "ok")]) == set()
    assert problems([("r", 0, "b", "ok")]) == {"not_a_prefix"}
    assert problems([("r", 1, "b", "ok")]) == {"gap"}
    assert problems([("r", 0, "a", "failed")]) == {"failure_not_listed"}
    active = spark.createDataFrame([("r", "c")], "run string, sample_id string")
    assert problems([("r", 0, "a", "ok")], active=active) == {"wrong_active_sample"}
    assert problems([("r", 0, "a", "ok"), ("r", 1, "b", "ok")], active=active) == set()


def test_dominant_failure(spark):
    samples = spark.createDataFrame(
        [("m", "failed", "cuda_oom", "E", f"out of memory {i}", i) for i in range(3)] + [("m", "failed", "", "E", "x", 9), ("n", "ok", "", "", "", 1)],
        "model_key string, status string, error_code string, error_type string, message string, seq bigint",
    )
    models = spark.createDataFrame([("m", 4, "", "", ""), ("n", 0, "", "LoadError", "no file"), ("o", 0, "", "", "")], "model_key string, failed bigint, failure_code string, failure_type string, failure_message string")
    found = {r.model_key: (r.failures, r.detail) for r in reports.dominant_failures(samples, models).collect()}
    assert found == {"m": (3, "cuda_oom: out of memory 0"), "n": (1, "LoadError: no file")}


def test_preview_and_positions(spark):
    errors = spark.range(8).select(F.lit("g").alias("group"), "id")
    shown = reports.error_preview(errors, ["group"], ["id"]).collect()
    assert [(r.id, r.additional) for r in shown] == [(i, 3) for i in range(5)]
    placed = reports.positions(errors, ["group"], "id", bucket_rows=3).orderBy("id").collect()
    assert [(r.position, r.total) for r in placed] == [(i + 1, 8) for i in range(8)]


def spans(spark, n, rate=16000):
    return spark.createDataFrame([("s", n, rate)], "sample_id string, n_samples bigint, sample_rate int")


def lengths(frame):
    return [r.stop - r.start for r in frame.orderBy("window").collect()]


def test_windows(spark):
    assert lengths(segments.fixed_windows(spans(spark, 65 * 16000), 30)) == [480000, 480000, 80000]
    assert lengths(segments.fixed_windows(spans(spark, 40000), 1)) == [16000, 16000, 8000]
    assert lengths(segments.fixed_windows(spans(spark, 0), 30)) == [0]
    assert lengths(segments.balanced_windows(spans(spark, 0), 30)) == []
    for tail in (18, 26, 212):
        found = lengths(segments.balanced_windows(spans(spark, 60 * 16000 + tail), 30))
        assert found == [480000, 464000 + tail, 16000]


def test_merged_segments(spark):
    rows = spark.createDataFrame([("s", 2, "tres", "es"), ("s", 0, "uno", "pt"), ("s", 1, "", "es")], "sample_id string, ord int, text string, language string")
    merged = segments.merge_segments(rows, "\n").first()
    assert (merged.text, merged.language, merged.segments) == ("uno\ntres", "pt", 3)


def test_short_audio_policy(spark):
    rows = spark.createDataFrame([("a", None), ("b", 0.05), ("c", 0.1)], "sample_id string, duration_seconds double")
    rejected = ledger.short_audio_failures(rows).where("failure IS NOT NULL")
    assert sorted(r.sample_id for r in rejected.collect()) == ["a", "b"]
    assert ledger.short_audio_failures(rows, policy="allow").where("failure IS NOT NULL").count() == 0


def test_positions_of_sparse_values_use_few_buckets(spark):
    rows = [("big", k * 10**12 + k % 7) for k in range(900)] + [("small", -5), ("small", 10**15), ("one", 3)]
    frame = spark.createDataFrame(rows, "run string, ord long")
    found = {(r.run, r.ord): (r.position, r.total) for r in reports.positions(frame, ["run"], bucket_rows=100).collect()}
    for run in ("big", "small", "one"):
        own = sorted(o for r, o in rows if r == run)
        assert [found[(run, o)] for o in own] == [(k + 1, len(own)) for k in range(len(own))]


def test_one_run_with_most_rows(spark, no_broadcast):
    rows = [("big", k, k == 900) for k in range(2000)] + [(f"r{k}", 0, False) for k in range(200)]
    frame = spark.createDataFrame(rows, "run string, ord long, blocking boolean")
    saved = ledger.stop_at_first_blocking(frame, ["run"]).where("saved")
    assert saved.count() == 901 + 200
    placed = reports.positions(frame, ["run"], bucket_rows=100)
    assert placed.agg(F.max("position"), F.max("total")).first()[:] == (2000, 2000)


def test_buckets_of_exponential_orders_are_even(spark):
    n = 30_000
    rows = spark.range(n).select(F.lit("big").alias("run"), F.floor(F.exp(C("id") / 1000.0) * 1e4).cast("long").alias("ord"))
    rows = rows.union(spark.createDataFrame([("big", 10**18), ("big", -(10**17)), ("small", 5)], "run string, ord long"))
    sizes = reports.order_buckets(rows, ["run"], "ord", 100).groupBy("run", "_bucket").count().collect()
    assert max(r["count"] for r in sizes) < 2 * n / 1024 and sum(r["count"] for r in sizes) == n + 3
    placed = reports.positions(rows, ["run"], bucket_rows=100).where("run = 'big'").orderBy("position").collect()
    assert [r.position for r in placed] == list(range(1, n + 3))
    assert [r.ord for r in placed] == sorted(r.ord for r in placed)
