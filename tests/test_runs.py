import pytest
from pyspark.sql import functions as F

from corpusbench.streaming import runs

C = F.col


class Limited(RuntimeError):
    retryable = True


class Backend:
    """Answers in upper case; each call leaves a line in its log."""

    def __init__(self, log, limited=(), close_fails=False):
        self.log, self.limited, self.close_fails = log, limited, close_fails

    def load(self):
        pass

    def transcribe(self, row):
        with open(self.log, "a") as stream:
            stream.write(row["sample_id"] + "\n")
        if row["text"] == "bad":
            raise ValueError("bad sample")
        if row["text"] in self.limited:
            raise Limited("rate limit")
        return {"text": row["text"].upper()}

    def close(self):
        if self.close_fails:
            raise OSError("busy")


def files(spark, path, *texts, first=0):
    """One file a sample; the stream takes them in the order of their times."""
    for i, text in enumerate(texts, first):
        rows = spark.createDataFrame([(f"s{i}", text)], "sample_id string, text string")
        rows.coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "samples"), str(tmp_path / "run"), str(tmp_path / "log")


def calls(log):
    return open(log).read().split()


def test_a_stopped_run_goes_on(spark, place):
    samples, folder, log = place
    files(spark, samples, "a", "limit", "c", "bad")
    blocking = C("failure.error_type") == "Limited"
    first = runs.run_transcription(
        spark, samples, folder, lambda: Backend(log, ("limit",)), batch_bytes=1, blocking=blocking, partitions=1
    )
    assert first.status == "interrupted" and sorted(calls(log)) == ["s0", "s1"]
    assert {r.sample_id: r.status for r in first.results.collect()} == {"s0": "ok", "s1": "failed"}

    second = runs.run_transcription(spark, samples, folder, lambda: Backend(log), batch_bytes=1, blocking=blocking, partitions=1)
    found = {r.sample_id: (r.status, r.attempt) for r in second.results.collect()}
    assert found == {"s0": ("ok", 1), "s1": ("ok", 2), "s2": ("ok", 1), "s3": ("failed", 1)}
    assert second.status == "partial" and [r.stage for r in second.failures.collect()] == ["transcribe"]
    assert sorted(calls(log)) == ["s0", "s1", "s1", "s2", "s3"]

    files(spark, samples, "late", first=9)  # a file that came later, and nothing else
    third = runs.run_transcription(spark, samples, folder, lambda: Backend(log), batch_bytes=1, partitions=1)
    assert calls(log)[5:] == ["s9"] and third.results.count() == 5


def test_a_lost_driver_repeats_no_stored_sample(spark, place):
    """The batch was stored, but the driver died before the checkpoint could tell."""
    samples, folder, log = place
    files(spark, samples, "a", "b", "c")
    assert runs.run_transcription(spark, samples, folder, lambda: Backend(log), batch_bytes=1, partitions=1).status == "complete"
    lost = spark.read.parquet(f"{folder}/results").where("sample_id <> 's1'")
    again = folder + "-again"  # results of two samples, and no checkpoint
    lost.write.partitionBy("stream", "batch").parquet(f"{again}/results")
    done = runs.run_transcription(spark, samples, again, lambda: Backend(log), batch_bytes=1, partitions=1)
    assert calls(log)[3:] == ["s1"] and done.status == "complete" and done.results.count() == 3


def test_blocking_rows_that_have_had_their_attempts_do_not_stop_a_run_for_ever(spark, place):
    samples, folder, log = place
    files(spark, samples, "limit", "a")
    told = []
    for _ in range(3):
        done = runs.run_transcription(
            spark, samples, folder, lambda: Backend(log, ("limit",)), batch_bytes=1, blocking=C("failure.error_type") == "Limited", max_attempts=2
        )
        told.append(done.status)
    assert told == ["interrupted", "interrupted", "partial"] and calls(log) == ["s0", "s0", "s1"]


def test_retries_end(spark, place):
    samples, folder, log = place
    files(spark, samples, "limit", "a")
    for _ in range(4):
        done = runs.run_transcription(spark, samples, folder, lambda: Backend(log, ("limit",)), max_attempts=2, partitions=1)
    assert sorted(calls(log)) == ["s0", "s0", "s1"] and done.status == "partial"


def test_stages_of_the_run_are_rows(spark, place):
    samples, folder, log = place
    files(spark, samples, "a", "b")

    def scorer(given, results):
        raise ArithmeticError("no such metric")

    done = runs.run_transcription(spark, samples, folder, lambda: Backend(log, close_fails=True), scorer=scorer, partitions=1)
    assert done.status == "partial" and done.results.count() == 2
    assert sorted(r.stage for r in done.failures.collect()) == ["close", "score"]
    (scored,) = [r for r in done.failures.collect() if r.stage == "score"]
    assert (scored.error_type, scored.message, scored.sample_id) == ("ArithmeticError", "no such metric", None)

    done = runs.run_transcription(spark, samples, folder, lambda: Backend(log), scorer=lambda given, results: given.join(results, "sample_id").select("sample_id", "status"))
    assert spark.read.parquet(f"{folder}/scores").count() == 2 and len(calls(log)) == 2


def test_samples_without_an_id_fail_the_run(spark, place):
    samples, folder, log = place
    spark.createDataFrame([(None, "x")], "sample_id string, text string").write.parquet(samples)
    done = runs.run_transcription(spark, samples, folder, lambda: Backend(log))
    assert done.status == "failed" and [r.stage for r in done.failures.collect()] == ["persist"]


def test_no_samples(spark, place):
    samples, folder, log = place
    spark.createDataFrame([], "sample_id string, text string").write.parquet(samples)
    done = runs.run_transcription(spark, samples, folder, lambda: Backend(log))
    assert done.status == "complete" and done.results.isEmpty()
