"""Restartable ledgers: latest row per key, upsert, merge with a current catalog, work selection.

A ledger is an append-only table with at most one current row per key.  Nothing here walks a ledger
in order: what a run must stop at or resume from is found with aggregates that combine per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbench.operators.spread import spread_join

C = F.col

# Failures after which a batch must not go on, now and in old ledgers.
BLOCKING_CODES = ("authentication", "rate_limit")
LEGACY_BLOCKING_STATUSES = ("HTTP 401", "HTTP 403", "HTTP 429")
LEGACY_AUTHENTICATION_STATUSES = ("HTTP 401", "HTTP 403")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last written row per key, under the order given; combines per task before its shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, *[C(f"_row.{c}").alias(c) for c in rest])


def upsert(previous: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Previous rows whose key is not rewritten, plus the new rows."""
    kept = previous.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new)


def in_manifest_order(df: DataFrame, ord_column: str = "ord") -> DataFrame:
    return df.orderBy(ord_column)


def merge_with_ledger(
    current: DataFrame, previous: DataFrame, key: str, carried: Sequence[str]
) -> DataFrame:
    """Current catalog rows with the prior outcome of the same key.

    Source columns come from the current catalog, ``carried`` columns from the ledger; keys that
    left the catalog are dropped and new keys are pending.
    """
    known = F.lit(True).alias("has_prior")
    prior = previous.select(key, *carried, known)
    joined = current.drop(*carried).join(prior, key, "left")
    return joined.withColumns(
        {
            "status": F.coalesce("status", F.lit("pending")),
            "has_prior": F.coalesce("has_prior", F.lit(False)),
        }
    )


def changed_meaning(
    current: DataFrame, previous: DataFrame, key: str, content: Sequence[str]
) -> DataFrame:
    """Keys present on both sides with different content."""
    now = current.select(key, F.struct(*content).alias("_now"))
    then = previous.select(key, F.struct(*content).alias("_then"))
    differs = ~C("_now").eqNullSafe(C("_then"))
    return now.join(then, key).where(differs).select(key)


def orphans(outcomes: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Outcomes whose source is unknown."""
    return outcomes.join(sources.select(key), key, "left_anti")


def pending(sources: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Sources without an outcome."""
    return sources.join(outcomes.select(key), key, "left_anti")


def ledger_problems(sources: DataFrame, outcomes: DataFrame, key: str, state: str) -> DataFrame:
    """(key, rule) of every broken whole-ledger invariant."""
    def named(df: DataFrame, rule: str) -> DataFrame:
        return df.select(C(key), F.lit(rule).alias("rule"))

    def repeated(df: DataFrame) -> DataFrame:
        return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")

    found = named(repeated(sources), "duplicate_source").unionByName(
        named(repeated(outcomes), "duplicate_outcome")
    )
    found = found.unionByName(named(orphans(outcomes, sources, key), "unknown_source"))
    if state in ("finished", "complete"):
        found = found.unionByName(named(pending(sources, outcomes, key), "missing_outcome"))
        if "status" in outcomes.columns:
            found = found.unionByName(named(outcomes.where("status = 'pending'"), "pending_outcome"))
    return found


def interruption_problem(
    state: Column, interruption_type: Column, interruption_message: Column
) -> Column:
    """NULL, or what is wrong with a checkpoint header's interruption details."""
    interrupted = state == "interrupted"
    return F.when(
        interrupted != interruption_type.isNotNull(),
        "an interrupted checkpoint must say what interrupted it",
    ).when(
        ~interrupted & interruption_message.isNotNull(),
        "only an interrupted checkpoint may have an interruption message",
    )


# --- work selection -------------------------------------------------------------------------------


def select_book_work(
    merged: DataFrame,
    *,
    force: bool = False,
    retry_not_found: bool = True,
    retry_nonretryable_errors: bool = False,
) -> DataFrame:
    """Add ``needs_run`` and ``reused_existing`` to merged books (status, issue_retryable)."""
    status = C("status")
    reuse = status.isin("found", "partial")
    if not retry_not_found:
        reuse = reuse | (status == "not_found")
    if not retry_nonretryable_errors:
        reuse = reuse | ((status == "error") & F.coalesce(~C("issue_retryable"), F.lit(False)))
    run = F.lit(True) if force else ~reuse
    return merged.withColumns({"needs_run": run, "reused_existing": ~run})


def select_poem_work(merged: DataFrame, *, force: bool = False) -> DataFrame:
    """Add ``needs_run`` to merged poems (status, error_retryable)."""
    final = (C("status") == "error") & F.coalesce(~C("error_retryable"), F.lit(False))
    reuse = C("status").isin("found", "partial") | final
    return merged.withColumn("needs_run", F.lit(True) if force else ~reuse)


def _any_issue(issues: Column, codes: Sequence[str], legacy: Sequence[str]) -> Column:
    def hit(issue: Column) -> Column:
        old = F.lit(False)
        for text in legacy:
            old = old | issue["message"].contains(text)
        return issue["code"].isin(*codes) | ((issue["code"] == "http_error") & old)

    return F.coalesce(F.exists(issues, hit), F.lit(False))


def is_blocking(issues: Column) -> Column:
    """Whether a result's issues must stop its batch."""
    return _any_issue(issues, BLOCKING_CODES, LEGACY_BLOCKING_STATUSES)


def is_authentication_failure(issues: Column) -> Column:
    return _any_issue(issues, ("authentication",), LEGACY_AUTHENTICATION_STATUSES)


def select_lyrics_work(
    merged: DataFrame,
    *,
    force: bool = False,
    retry_not_found: bool = True,
    retry_partial: bool = True,
    retry_nonretryable_errors: bool = False,
) -> DataFrame:
    """Add ``needs_run`` to merged requests (status, issues)."""
    status, issues = C("status"), C("issues")
    retryable = F.coalesce(F.exists(issues, lambda e: e["retryable"]), F.lit(False))
    retry_error = is_authentication_failure(issues) | retryable | F.lit(retry_nonretryable_errors)
    run = (
        F.when(status == "pending", True)
        .when(status == "not_found", retry_not_found)
        .when(status == "partial", retry_partial)
        .when(status == "error", retry_error)
        .otherwise(False)
    )
    return merged.withColumn("needs_run", F.lit(True) if force else run)


def select_media_work(tasks: DataFrame, records: DataFrame, files: DataFrame, *, force: bool = False) -> DataFrame:
    """Tasks with ``needs_run`` and the next attempt.

    A complete record counts only when both of its files exist and the audio hash still matches.
    ``records``: request_id, status, attempt, audio_path, reference_path, sha256, retryable.
    ``files``: path, sha256.
    """
    audio = files.select(C("path").alias("audio_path"), C("sha256").alias("_found_sha"))
    text = files.select(C("path").alias("reference_path"), F.lit(True).alias("_has_text"))
    prior = (
        records.join(audio, "audio_path", "left")
        .join(text, "reference_path", "left")
        .select(
            "request_id",
            C("status").alias("prior_status"),
            C("attempt").alias("prior_attempt"),
            "retryable",
            (C("_has_text").isNotNull() & F.lower("_found_sha").eqNullSafe(F.lower("sha256")) & C("sha256").isNotNull()).alias("_intact"),
        )
    )
    keep = ((C("prior_status") == "complete") & C("_intact")) | (
        (C("prior_status") == "failed") & ~C("retryable")
    )
    run = F.lit(True) if force else ~F.coalesce(keep, F.lit(False))
    return (
        tasks.join(prior, "request_id", "left")
        .withColumns(
            {
                "needs_run": run,
                "next_attempt": next_attempt(C("prior_attempt")),
            }
        )
        .drop("_intact", "retryable")
    )


def next_attempt(prior_attempt: Column, *, restart: bool = False) -> Column:
    """1 without a prior attempt, else one more; ``restart`` begins again at 1."""
    return F.lit(1) if restart else F.coalesce(prior_attempt, F.lit(0)) + 1


def stop_at_first_blocking(results: DataFrame, run_keys: Sequence[str], ord_column: str = "ord") -> DataFrame:
    """Add ``saved``: rows up to and including each run's first blocking row are kept, later ones
    stay pending.

    The first blocking position is a minimum per run, so a run of any size is never put in order.
    """
    first = (
        results.where("blocking")
        .groupBy(*run_keys)
        .agg(F.min(ord_column).alias("_stop"))
    )
    joined = spread_join(results, first, run_keys, ord_column, salts=None, how="left")
    saved = C("_stop").isNull() | (C(ord_column) <= C("_stop"))
    return joined.withColumn("saved", saved).drop("_stop")


def interrupted_state(requests: DataFrame, results: DataFrame, run_keys: Sequence[str], key: str) -> DataFrame:
    """State of each run after an interruption: rows done, rows pending and the next key by order."""
    done = results.select(*run_keys, key, F.lit(True).alias("_done"))
    joined = requests.join(done, [*run_keys, key], "left")
    open_row = C("_done").isNull()
    return joined.groupBy(*run_keys).agg(
        F.count("_done").alias("completed"),
        F.count_if(open_row).alias("pending"),
        F.min_by(C(key), F.when(open_row, C("ord"))).alias("next_key"),
        F.when(F.count_if(open_row) == 0, "finished").otherwise("interrupted").alias("state"),
    )


def media_tasks(results: DataFrame) -> DataFrame:
    """Collected songs that have a video and lyrics, as acquisition tasks."""
    song = C("song")
    return results.where(song.isNotNull() & song["video"].isNotNull() & song["lyrics"].isNotNull()).select(
        "request_id",
        song["video"]["video_id"].alias("video_id"),
        song["video"]["url"].alias("source_url"),
        song["lyrics"].alias("lyrics"),
    )


def media_records(selected: DataFrame, fetched: DataFrame, files: DataFrame) -> DataFrame:
    """Record per task that ran, from the fetch log and the files it left.

    ``fetched``: request_id, duration_seconds, error_code, error_message, error_retryable.
    ``files``: path, sha256, bytes.  A fetch without error that left no file is a retryable failure.
    """
    audio_path = F.concat("request_id", F.lit(".wav"))
    audio = files.select(C("path").alias("audio_path"), C("sha256").alias("_sha"), C("bytes").alias("_bytes"))
    joined = (
        selected.where("needs_run")
        .withColumn("audio_path", audio_path)
        .join(fetched, "request_id", "left")
        .join(audio, "audio_path", "left")
    )
    absent = C("error_code").isNull() & C("_sha").isNull()
    ok = C("error_code").isNull() & C("_sha").isNotNull()
    return joined.select(
        "request_id",
        "video_id",
        "source_url",
        F.when(ok, "complete").otherwise("failed").alias("status"),
        C("next_attempt").alias("attempt"),
        F.when(ok, C("audio_path")).alias("audio_path"),
        F.when(ok, F.concat("request_id", F.lit(".txt"))).alias("reference_path"),
        F.when(ok, C("_sha")).alias("sha256"),
        F.when(ok, C("_bytes")).alias("bytes"),
        F.when(ok, C("duration_seconds")).alias("duration_seconds"),
        F.when(absent, "missing_output").otherwise(C("error_code")).alias("error_code"),
        F.when(absent, "the download left no normalized audio")
        .otherwise(C("error_message"))
        .alias("error_message"),
        F.when(absent, True).otherwise(C("error_retryable")).alias("retryable"),
    )


def preflight_errors(samples: DataFrame, files: DataFrame, *, verify_hashes: bool = True) -> DataFrame:
    """(sample_id, error) of every sample whose file is absent or does not match its hash.

    ``samples``: sample_id, audio_path, sha256.  ``files``: path, sha256.
    """
    found = files.select(C("path").alias("audio_path"), C("sha256").alias("_found"), F.lit(True).alias("_there"))
    error = F.when(C("_there").isNull(), "there is no such audio file")
    if verify_hashes:
        error = error.when(C("sha256").isNull(), "a sha256 is needed to verify the file").when(
            F.lower("sha256") != F.lower("_found"), "the file has another sha256"
        )
    return (
        samples.join(found, "audio_path", "left")
        .select("sample_id", "audio_path", error.alias("error"))
        .where("error IS NOT NULL")
    )


def short_audio_failures(
    samples: DataFrame, *, policy: str = "reject", minimum_seconds: float = 0.1
) -> DataFrame:
    """Add a nullable ``failure`` under the short-audio policy; rows are never dropped."""
    if policy not in ("reject", "allow"):
        raise ValueError(f"unknown short-audio policy: {policy}")
    duration = C("duration_seconds")
    failure = (
        F.when(duration.isNull(), "audio duration is required")
        .when(duration < minimum_seconds, "audio is below the minimum duration")
    )
    return samples.withColumn("failure", failure if policy == "reject" else F.lit(None).cast("string"))


def paths_in_scope(samples: DataFrame, prefix: str, by: Sequence[str] = ()) -> DataFrame:
    """Whether every audio path lies under the prefix."""
    inside = C("audio_path").startswith(prefix)
    return samples.groupBy(*by).agg(
        F.coalesce(F.bool_and(inside), F.lit(True)).alias("in_scope"),
        F.count_if(~inside).alias("outside"),
    )
