"""Ledger tables: declared schemas, validated reads, an append sink for batches and streams, and compaction.

A ledger's folder holds its batches (``batch=N``) and, once compacted, a base: per bucket of keys one file
with the last row of every key, in the folder of the compaction that wrote it.  A pointer says which
compaction holds which bucket and up to which batch the base reaches.  Its versions are single files, so
a reader sees a compaction wholly or not at all.  Reading merges the base with the batches after it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbench.contracts import rulesets
from corpusbench.contracts.rules import Rule, Validated, validate
from corpusbench.operators.ledger import latest_per_key

_BOOK = "book_id:string,title:string,author:string,publication_year:int,source:string"
_POEM = (
    "source_id:string,title:string,author:string,publication_year:int,genre:string,"
    "reference_text:string,provenance:string"
)
_VIDEO = "video_id:string,url:string,title:string,duration_seconds:bigint,confidence:double"
_SONG = (
    "source:string,source_song_id:string,title:string,artist:string,url:string,genres:array<string>,"
    f"label:string,album:string,release_date:string,lyrics:string,video:struct<{_VIDEO}>"
)


class LedgerSpec(NamedTuple):
    """Columns, key and rules of one kind of ledger; ``written`` orders the versions of a key."""

    schema: str
    keys: tuple[str, ...]
    rules: list[Rule]


def book_ledger() -> LedgerSpec:
    schema = (
        f"book_id string, seed struct<{_BOOK}>, status string, "
        "hit struct<video_id:string,url:string,provider_title:string,duration_seconds:double,kind:string,query:string>, "
        "issue struct<stage:string,error_type:string,message:string,retryable:boolean>, "
        "reused_existing boolean, written bigint"
    )
    return LedgerSpec(schema, ("book_id",), rulesets.book_outcome())


def poem_ledger() -> LedgerSpec:
    schema = (
        f"source_id string, source struct<{_POEM}>, status string, attempted_at string, "
        "candidate struct<video_id:string,url:string,title:string,duration_seconds:double,provider:string,query:string>, "
        "content_kind string, match_score double, match_reasons array<string>, error_type string, "
        "error_message string, error_retryable boolean, written bigint"
    )
    return LedgerSpec(schema, ("source_id",), rulesets.poem_outcome())


def lyrics_ledger() -> LedgerSpec:
    schema = (
        "request_id string, status string, attempt int, completed_at string, "
        f"song struct<{_SONG}>, issues array<struct<stage:string,code:string,message:string,retryable:boolean>>, "
        "written bigint"
    )
    rules = [*rulesets.lyrics_outcome(), *rulesets.song_record(F.col("song"))]
    return LedgerSpec(schema, ("request_id",), rules)


def media_ledger() -> LedgerSpec:
    status, complete = F.col("status"), F.col("status") == "complete"
    schema = (
        "request_id string, video_id string, source_url string, status string, attempt int, audio_path string, "
        "reference_path string, sha256 string, bytes bigint, duration_seconds double, error_code string, "
        "error_message string, retryable boolean, metadata map<string,string>, written bigint"
    )
    rules = [
        Rule("status", status.isin("complete", "failed"), "unknown status"),
        Rule("attempt", F.col("attempt") >= 1, "attempt must be positive"),
        Rule("files", ~complete | (F.col("audio_path").isNotNull() & F.col("sha256").isNotNull()), "complete requires a hashed file"),
        Rule("error", complete | F.col("error_code").isNotNull(), "failed requires an error code"),
    ]
    return LedgerSpec(schema, ("request_id",), rules)


def suite_ledger() -> LedgerSpec:
    status = F.col("status").isin("pending", "running", "complete", "partial", "failed", "interrupted")
    counts = ("attempt", "expected_samples", "succeeded_samples", "failed_samples")
    schema = (
        "dataset_id string, preset_id string, status string, attempt int, output_dir string, expected_samples bigint, "
        "succeeded_samples bigint, failed_samples bigint, error_type string, error_message string, written bigint"
    )
    rules = [Rule("status", status, "unknown status")]
    rules += [Rule(c, F.col(c) >= 0, f"{c} must be a nonnegative integer") for c in counts]
    return LedgerSpec(schema, ("dataset_id", "preset_id"), rules)


def current_rows(rows: DataFrame, spec: LedgerSpec) -> Validated:
    """The last written row per key, split into valid rows and violations."""
    latest = latest_per_key(rows, spec.keys, ["written"])
    return validate(latest, spec.rules, spec.keys)


def read_ledger(spark: SparkSession, path: str, spec: LedgerSpec) -> Validated:
    """Current rows from the compacted base and the batches that came after it."""
    pointer = _pointer(spark, path)
    later = _batches(spark, path, spec, pointer.upto).drop("batch")
    return current_rows(_base(spark, path, spec, pointer.held).unionByName(later), spec)


class _Pointer(NamedTuple):
    """``held``: the compaction that holds each bucket; ``upto``: the last batch that the base has."""

    version: int
    buckets: int | None
    upto: int
    held: dict[int, str]


def _pointer(spark: SparkSession, path: str) -> _Pointer:
    """One row per bucket, a number that the ledger's owner has set."""
    schema = "version bigint, buckets int, upto bigint, bucket int, compaction string"
    try:
        rows = spark.read.schema(schema).parquet(f"{path}/_pointer")
        newest = rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = []
    if not newest:
        return _Pointer(0, None, -1, {})
    first = newest[0]
    return _Pointer(first.version, first.buckets, first.upto, {r.bucket: r.compaction for r in newest if r.compaction})


def _batches(spark: SparkSession, path: str, spec: LedgerSpec, after: int) -> DataFrame:
    return spark.read.schema(f"{spec.schema}, batch bigint").parquet(path).where(F.col("batch") > after)


def _base(spark: SparkSession, path: str, spec: LedgerSpec, held: dict[int, str]) -> DataFrame:
    if not held:
        return spark.createDataFrame([], spec.schema)
    return spark.read.schema(spec.schema).parquet(*(f"{path}/_base/{c}/bucket={b}" for b, c in sorted(held.items())))


def compact_ledger(spark: SparkSession, path: str, spec: LedgerSpec, *, buckets: int = 64) -> list[int]:
    """Fold the batches since the last compaction into the base; the buckets that were written anew.

    Only buckets that a new batch has a key of are read and written.  What is written counts from the
    moment its pointer is there: a compaction that is lost before leaves files that nobody reads, and is
    simply started again.  Batches may go on being written meanwhile; folders that no pointer names any
    more are left for the owner to remove.  The number of buckets is that of the first compaction.
    """
    pointer = _pointer(spark, path)
    buckets = pointer.buckets or buckets
    newer = _batches(spark, path, spec, pointer.upto)
    upto = newer.agg(F.max("batch")).first()[0]
    if upto is None:
        return []
    bucket = F.pmod(F.xxhash64(*spec.keys), F.lit(buckets)).cast("int")
    newer = newer.where(F.col("batch") <= upto).drop("batch")
    touched = sorted(r.bucket for r in newer.select(bucket.alias("bucket")).distinct().collect())  # at most ``buckets``
    old = _base(spark, path, spec, {b: c for b, c in pointer.held.items() if b in touched})
    rows = latest_per_key(old.unionByName(newer), spec.keys, ["written"]).withColumn("bucket", bucket)
    compaction = f"to-{upto}-{uuid.uuid4().hex}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/_base/{compaction}")
    held = pointer.held | dict.fromkeys(touched, compaction)
    told = [(pointer.version + 1, buckets, upto, b, held.get(b)) for b in range(buckets)]
    schema = "version bigint, buckets int, upto bigint, bucket int, compaction string"
    spark.createDataFrame(told, schema).coalesce(1).write.mode("append").parquet(f"{path}/_pointer")
    return touched


def base_files(spark: SparkSession, path: str, spec: LedgerSpec) -> DataFrame:
    """Keys of the base with ``files``, the number of files that their bucket lies in."""
    held = _base(spark, path, spec, _pointer(spark, path).held)
    placed = held.select(*spec.keys, F.col("_metadata.file_path").alias("file")).withColumn("folder", F.regexp_replace("file", r"/[^/]*$", ""))
    files = placed.groupBy("folder").agg(F.count_distinct("file").alias("files"))
    return placed.join(files, "folder").select(*spec.keys, "files")


def ledger_writer(path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: each batch is one partition of the ledger.

    A batch that is tried again replaces its own partition and nothing else, so a run that loses an
    executor or the driver resumes from its checkpoint without double rows.  Rows without a key are
    refused.
    """

    def write(batch: DataFrame, number: int) -> None:
        keyed = F.lit(True)
        for key in keys:
            keyed = keyed & F.col(key).isNotNull()
        checked = batch.withColumn(
            "written", F.when(keyed, F.lit(number).cast("bigint")).otherwise(F.raise_error(F.lit("ledger row without a key")))
        )
        (
            checked.withColumn("batch", F.col("written"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(path)
        )

    return write
