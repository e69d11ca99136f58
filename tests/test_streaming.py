import json

from pyspark.sql import functions as F

from corpusbench.sources.payloads import parse_events
from corpusbench.streaming import progress

C = F.col


def lines(spark, *events):
    rows = [(f"12:00 INFO stt_event={json.dumps({'seq': i, 'ts': float(i), **e})}",) for i, e in enumerate(events)]
    rows += [("plain line",), ("stt_event=not json",), ('stt_event={"total": 3}',)]
    return spark.createDataFrame(rows, "value string")


def model(spark, *events):
    return progress.model_progress(parse_events(lines(spark, *events))).first()


def test_other_lines_are_ignored(spark):
    found = parse_events(lines(spark, {"kind": "run_started"}, {"event": "", "kind": "run_finished"}))
    assert [r.event for r in found.orderBy("seq").collect()] == ["run_started", "run_finished"]


def test_skipped_task_is_resumed_and_complete(spark):
    row = model(spark, {"event": "task_skipped", "dataset_id": "d", "preset_id": "p", "attempt": 3, "succeeded": 557, "failed": 0, "total": 557})
    assert (row.model_key, row.completed, row.succeeded, row.failed, row.total) == ("d::p", 557, 557, 0, 557)
    assert (row.phase, row.status, row.attempt, row.elapsed_seconds) == ("resumed", "complete", 3, None)


def test_clock_runs_from_the_first_start(spark):
    row = model(
        spark, {"event": "task_started", "ts": 1.0}, {"event": "run_started", "ts": 5.0}, {"event": "sample_completed", "status": "ok", "elapsed_seconds": 2.0, "ts": 60.0},
        {"event": "run_finished", "run_status": "partial", "ts": 66.0},
    )
    assert (row.model_key, row.elapsed_seconds, row.status) == ("dataset::model", 65.0, "partial")


def test_start_clears_failures_and_leaves_the_queue(spark):
    row = model(spark, {"event": "run_finished", "error_code": "e", "error_type": "t", "message": "m"}, {"event": "task_started", "message": "ignored"})
    assert (row.failure_code, row.failure_type, row.failure_message) == ("", "", "")
    assert (row.phase, row.status) == ("preflight", "running")


def test_counts_follow_the_last_event(spark):
    row = model(
        spark, {"event": "sample_started", "sample_id": "a", "total": 9}, {"event": "sample_completed", "sample_id": "a", "status": "failed", "index": 4},
    )
    assert (row.completed, row.succeeded, row.failed, row.total, row.status, row.active_sample) == (4, 0, 1, 9, "warning", "")
    row = model(spark, {"event": "sample_started", "sample_id": "a", "completed": 2, "phase": "transcribing"})
    assert (row.completed, row.active_sample, row.phase) == (2, "a", "transcribing")


def test_samples_and_suite(spark):
    events = parse_events(
        lines(
            spark, {"event": "suite_started"}, {"event": "sample_started", "sample_id": "a"}, {"event": "sample_started", "sample_id": "b"},
            {"event": "sample_completed", "sample_id": "a", "status": "failed", "error_type": "E"}, {"event": "suite_finished", "suite_status": "partial"},
        )
    )
    samples = progress.sample_progress(events).orderBy("last_seq").collect()
    assert [(r.sample_id, r.status, r.message) for r in samples] == [("b", "running", ""), ("a", "failed", "E")]
    assert progress.suite_progress(events).first().status == "partial"
    assert progress.suite_progress(events.where("event = 'suite_started'")).first().status == "running"
    assert [r.model_key for r in progress.model_progress(events).collect()] == ["dataset::model"]


def test_stream_equals_batch(spark, tmp_path):
    kinds = ["task_started", "sample_started", "sample_completed", "task_completed", "run_finished"]
    events = [
        {"event": kinds[(i * 7 + i // 5) % 5], "preset_id": f"p{i % 3}", "sample_id": f"s{i % 4}", "status": "failed" if i % 6 == 0 else "ok", "index": i, "succeeded": i if i % 2 else None}
        for i in range(90)
    ]
    source, out = tmp_path / "logs", str(tmp_path / "out")
    source.mkdir()
    for part in range(3):
        rows = [f"stt_event={json.dumps({'seq': i, 'ts': float(i), **events[i]})}" for i in range(part * 30, part * 30 + 30)]
        (source / f"{part}.log").write_text("\n".join(rows))
    expected = sorted(progress.model_progress(parse_events(spark.read.text(str(source)))).collect())
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    for _ in range(2):  # the second run has nothing left to do
        progress.follow(progress.model_progress(parse_events(stream)), write, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    from corpusbench.operators.ledger import latest_per_key

    final = latest_per_key(spark.read.parquet(out), ["model_key"], ["batch"]).drop("batch")
    columns = progress.model_progress(parse_events(spark.read.text(str(source)))).columns
    assert sorted(final.select(columns).collect()) == expected
    assert spark.read.parquet(out).select("batch").distinct().count() == 3


def run_of(name, start, first_seq, samples=3, end=True):
    """Events of one model's run, ten seconds apart."""
    about = {"dataset_id": "d", "preset_id": name}
    events = [{"event": "task_started", "total": samples}, {"event": "phase_changed", "phase": "transcribing"}]
    for k in range(samples):
        events += [{"event": "sample_started", "sample_id": f"{name}{k}"}, {"event": "sample_completed", "sample_id": f"{name}{k}", "status": "failed" if k == 1 else "ok", "error_code": "E" if k == 1 else None, "elapsed_seconds": 1.5}]
    if end:
        events.append({"event": "task_completed", "task_status": "partial", "succeeded": samples - 1, "failed": 1})
    return [{"seq": first_seq + k, "ts": start + 10.0 * k, **about, **e} for k, e in enumerate(events)]


def test_state_of_ended_models_goes(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    steps = [
        run_of("a", 1000, 0) + run_of("b", 1000, 100, end=False),
        run_of("c", 9000, 200, end=False),  # moves the watermark past the end of a
        run_of("d", 9500, 300),
        [{"seq": 90, "ts": 9600.0, "dataset_id": "d", "preset_id": "a", "event": "phase_changed", "phase": "late"}],
        [{"seq": 400, "ts": 9700.0, "dataset_id": "d", "preset_id": "a", "event": "task_started", "attempt": 2}],
    ]
    kept, samples, late, sizes = {}, {}, [], []

    def keep(rows, _):
        rows.persist()
        told = progress.ended(rows)
        late.extend(r.event for r in told.late.collect())
        kept.update({r.model_key: r for r in told.progress.orderBy("last_seq", "final").collect()})
        rows.unpersist()

    def keep_samples(rows, _):
        for r in progress.ended(rows, samples=True).progress.orderBy("last_seq", "final").collect():
            samples[r.model_key, r.sample_id] = r

    for number, events in enumerate(steps):
        (folder / f"{number}.log").write_text("".join(f"INFO stt_event={json.dumps(e)}\n" for e in events))
        stream = parse_events(spark.readStream.text(str(folder)))
        query = progress.follow(progress.ending_model_progress(stream, grace=600, delay="1 minute"), keep, str(tmp_path / "models"), available_now=True)
        query.awaitTermination(120)
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        query = progress.follow(progress.ending_sample_progress(stream, grace=600, delay="1 minute"), keep_samples, str(tmp_path / "samples"), available_now=True)
        query.awaitTermination(120)
    assert sizes == [2, 2, 3, 3, 4]  # a and b, then b and c, then d as well, nothing for the late event, then a again
    assert [json.loads(x)["phase"] for x in late] == ["late"]
    everything = [e for step in steps for e in step if e.get("phase") != "late"]
    log = spark.createDataFrame([(f"stt_event={json.dumps(e)}",) for e in everything], "value string")
    batch = {r.model_key: r.asDict() for r in progress.model_progress(parse_events(log)).collect()}
    for name in ("d::b", "d::c", "d::d"):
        own = kept[name].asDict()
        assert not own.pop("final") and own == batch[name]
    again = kept["d::a"]  # a run that begins after its state has gone begins anew
    assert (again.status, again.attempt, again.completed, again.final) == ("running", 2, 0, False)
    of_samples = {(r.model_key, r.sample_id): r.asDict() for r in progress.sample_progress(parse_events(log)).collect()}
    assert of_samples == {k: {c: v for c, v in r.asDict().items() if c != "final"} for k, r in samples.items()}
    assert samples["d::a", "a0"].final and not samples["d::d", "d0"].final
