"""Transcription runs that go on where they were stopped: a stream over sample files into a result table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbench.operators.inference import RESULT_SCHEMA, Backend, transcribe
from corpusbench.operators.ledger import latest_per_key

C = F.col

STORED_SCHEMA = f"{RESULT_SCHEMA}, attempt int, call string"
_FAILURE_SCHEMA = "stage string, error_type string, message string, sample_id string"
_AGAIN = ("again", -1)  # stream and batch of rows that a later call has tried again
Scorer = Callable[[DataFrame, DataFrame], DataFrame]


class RunOutcome(NamedTuple):
    """``status``: complete, partial, interrupted or failed.  ``results``: the last row of each sample.

    ``failures``: stage, error_type, message, sample_id of failed samples, of backends that could not be
    closed, and of the run's own stages ``persist`` and ``score``.
    """

    status: str
    results: DataFrame
    failures: DataFrame


class _Blocked(RuntimeError):
    """Raised between batches, so that the batch is not taken for done."""


def stored_results(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that a run has stored, attempts of one sample beside each other; none before its first batch."""
    schema = f"{STORED_SCHEMA}, stream string, batch bigint"
    try:
        return spark.read.schema(schema).parquet(f"{folder}/results")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _still_open(samples: DataFrame, stored: DataFrame, max_attempts: int) -> DataFrame:
    """Samples without a stored row, and those whose last failure may be tried again; with their next attempt."""
    last = latest_per_key(stored.select("sample_id", "attempt", "failure.retryable"), ["sample_id"], ["attempt"])
    known = last.select("sample_id", C("attempt").alias("_prior"), F.coalesce("retryable", F.lit(False)).alias("_again"))
    again = C("_prior").isNull() | (C("_again") & (C("_prior") < max_attempts))
    opened = samples.join(known, "sample_id", "left").where(again)
    return opened.withColumn("_attempt", F.coalesce("_prior", F.lit(0)) + 1).drop("_prior", "_again")


def run_transcription(
    spark: SparkSession,
    samples_path: str,
    folder: str,
    backend_factory: Callable[[], Backend],
    *,
    batch_bytes: int = 8 << 30,
    blocking: Column | None = None,
    max_attempts: int = 3,
    scorer: Scorer | None = None,
    warmup_runs: int = 0,
    partitions: int | None = None,
) -> RunOutcome:
    """Transcribe all samples below ``samples_path``, or what an earlier call left open; call it again to go on.

    ``samples_path`` is a folder of Parquet files with ``sample_id`` and what the backend reads, to which files
    may be added between calls.  ``folder`` holds the run: results, checkpoint and scores.

    * Samples are read by a stream of micro-batches of about ``batch_bytes``; a batch's results are appended in one
      commit.  A driver that dies repeats at most one batch, and of it only samples without a stored row; so does a
      call that finds results but has lost its checkpoint.
    * Before the stream, failures that are retryable are tried again, up to ``max_attempts`` attempts in all.
    * ``blocking`` is a condition on result rows.  A batch with such a row is stored, then the run stops and is
      ``interrupted``; nothing after it is given to a backend.
    * ``scorer`` gets all samples and the results, and its table is written to ``folder/scores``.  It only runs when
      no batch is open.  If it fails, its exception is a row of stage ``score`` and the run is ``partial``; if
      results cannot be stored, a row of stage ``persist`` and the run is ``failed``.

    A sample without an id cannot be resumed: the run fails at ``persist``.  Of samples that repeat an id one result
    counts, and a sample whose copies lie in different batches is transcribed for each.  A folder without samples gives no results and is complete.  Further columns go to the backend as they
    are, but names that start with an underscore are taken.
    """
    if max_attempts < 1:
        raise ValueError("max_attempts is 1 or more")
    sample_schema = spark.read.parquet(samples_path).schema
    call = uuid.uuid4().hex
    blocked = False

    def store(samples: DataFrame, seen: DataFrame, stream: str, number: int) -> None:
        nonlocal blocked
        key = F.coalesce("sample_id", F.raise_error(F.lit("sample without an id")).cast("string"))
        opened = _still_open(samples.withColumn("sample_id", key), seen, max_attempts)
        attempts = opened.select("sample_id", C("_attempt").alias("attempt"))
        results = transcribe(opened.drop("_attempt"), backend_factory, warmup_runs=warmup_runs, partitions=partitions)
        numbered = results.join(attempts.distinct(), "sample_id", "left").withColumns(
            {"call": F.lit(call), "stream": F.lit(stream), "batch": F.lit(number).cast("bigint")}
        )
        numbered.write.mode("append").partitionBy("stream", "batch").parquet(f"{folder}/results")
        if blocking is not None:
            now = stored_results(spark, folder).where((C("stream") == stream) & (C("batch") == number) & (C("call") == call))
            blocked = not now.where(blocking).isEmpty()

    def batch(samples: DataFrame, number: int) -> None:
        stream = spark.read.text(f"{folder}/checkpoint/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        # Earlier batches of this checkpoint were of other files: they are not read again for each batch.
        others = (C("stream") != stream) | (C("batch") >= number)
        store(samples, stored_results(spark, folder).where(others), stream, number)
        if blocked:
            raise _Blocked(f"batch {number} has a blocking row")

    told: list[tuple[str, str, str, str | None]] = []
    try:
        before = stored_results(spark, folder)
        retryable = _last(before).where(C("failure.retryable") & (C("attempt") < max_attempts))
        if not retryable.isEmpty():
            again = spark.read.schema(sample_schema).parquet(samples_path).join(retryable.select("sample_id"), "sample_id", "left_semi")
            store(again, before, *_AGAIN)
        if not blocked:
            stream = spark.readStream.schema(sample_schema).option("maxBytesPerTrigger", batch_bytes).parquet(samples_path)
            writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
            writer.foreachBatch(batch).start().awaitTermination()
    except StreamingQueryException as error:
        if not blocked:
            told.append(("persist", type(error).__name__, str(error), None))
    except Exception as error:  # told as a stage of the run, like a failed sample
        told.append(("persist", type(error).__name__, str(error), None))

    stored = stored_results(spark, folder)
    results = _last(stored)
    if scorer is not None and not blocked and not told:
        try:
            everything = spark.read.schema(sample_schema).parquet(samples_path)
            scorer(everything, results).write.mode("overwrite").parquet(f"{folder}/scores")
        except Exception as error:  # a run without scores keeps its results
            told.append(("score", type(error).__name__, str(error), None))
    failures = (
        results.where(C("failure").isNotNull())
        .unionByName(stored.where(C("sample_id").isNull()).drop("call", "stream", "batch"))
        .select("failure.stage", "failure.error_type", "failure.message", "sample_id")
        .unionByName(spark.createDataFrame(told, _FAILURE_SCHEMA))
    )
    if any(stage == "persist" for stage, *_ in told):
        status = "failed"
    elif blocked:
        status = "interrupted"
    else:
        status = "complete" if failures.isEmpty() else "partial"
    return RunOutcome(status, results, failures)


def _last(stored: DataFrame) -> DataFrame:
    return latest_per_key(stored.where(C("sample_id").isNotNull()).drop("call", "stream", "batch"), ["sample_id"], ["attempt"])
