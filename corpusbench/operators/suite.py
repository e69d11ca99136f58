"""Dataset x preset matrix: tasks, resumption, conflicts, run identity and suite status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbench.functions.classify import canonical_fingerprint

C = F.col

# Identity fields of a run, always compared or compared only when configured.
ALWAYS_COMPARED = ("backend_id", "model", "language", "requested_device", "requested_precision")
COMPARED_WHEN_SET = ("preset_id", "runtime_id", "model_revision_requested", "quantization")
# Fixed value: the host field two runs may differ in.
IGNORED_HOST_FIELD = "cuda_runtime_version"


def task_matrix(datasets: DataFrame, presets: Sequence[str]) -> DataFrame:
    """One pending task per dataset and preset, dataset-major.

    ``presets`` is the plan's own short list, so it becomes an array on each dataset row.
    """
    if not presets:
        raise ValueError("suite presets must not be empty")
    listed = F.array(*[F.lit(p) for p in presets])
    tasks = datasets.select("*", F.posexplode(listed).alias("preset_ord", "preset_id"))
    return tasks.withColumns({"status": F.lit("pending"), "attempt": F.lit(0)})


def seeded_progress(tasks: DataFrame, unavailable: Column | None = None) -> DataFrame:
    """Initial progress row per task; presets that cannot run start in setup."""
    blocked = F.lit(False) if unavailable is None else unavailable
    zero = F.lit(0).cast("bigint")
    return tasks.select(
        F.concat_ws("::", "dataset_id", "preset_id").alias("model_key"),
        "dataset_id",
        "preset_id",
        F.when(blocked, "setup").otherwise("queued").alias("phase"),
        F.when(blocked, "missing-worker").otherwise("queued").alias("status"),
        zero.alias("completed"),
        zero.alias("succeeded"),
        zero.alias("failed"),
        F.coalesce("samples", zero).alias("total"),
    )


def with_dataset(tasks: DataFrame, datasets: DataFrame) -> DataFrame:
    """Tasks with the columns of their dataset."""
    return tasks.join(datasets, "dataset_id")


def select_suite_work(tasks: DataFrame, ledger: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Task actions: skip, resume (same attempt) or run (next attempt).

    ``ledger``: dataset_id, preset_id, status, attempt.  ``artifacts``: dataset_id, preset_id,
    attempt, has_checkpoint, has_result.
    """
    keys = ["dataset_id", "preset_id"]
    prior = ledger.select(*keys, C("status").alias("prior_status"), C("attempt").alias("prior_attempt"))
    found = artifacts.select(*keys, C("attempt").alias("prior_attempt"), "has_checkpoint", "has_result")
    joined = (
        tasks.drop("status", "attempt").join(prior, keys, "left").join(found, [*keys, "prior_attempt"], "left")
    )
    no = F.lit(False)
    result, checkpoint = F.coalesce("has_result", no), F.coalesce("has_checkpoint", no)
    attempt = F.coalesce("prior_attempt", F.lit(0))
    resumable = C("prior_status").isin("running", "interrupted") & (attempt > 0) & checkpoint & ~result
    action = (
        F.when((C("prior_status") == "complete") & result, "skip")
        .when(resumable, "resume")
        .otherwise("run")
    )
    return joined.withColumn("action", action).withColumn(
        "attempt", F.when(C("action") == "run", attempt + 1).otherwise(attempt)
    ).drop("prior_attempt", "has_checkpoint", "has_result")


def plan_fingerprint(**fields: Column) -> Column:
    """SHA-256 of the plan's canonical JSON; fields are put in alphabetical order."""
    return canonical_fingerprint(*[fields[name].alias(name) for name in sorted(fields)])


def plan_conflicts(plans: DataFrame, ledgers: DataFrame, *, resume: bool = True) -> DataFrame:
    """Runs that must not start, with the reason.

    ``plans``: run_id, fingerprint, target_is_empty.  ``ledgers``: run_id, fingerprint.
    """
    stored = ledgers.select("run_id", C("fingerprint").alias("_stored"))
    known = C("_stored").isNotNull()
    reason = F.when(known, "output already exists") if not resume else F.when(
        known & (C("_stored") != C("fingerprint")), "existing run uses a different plan"
    )
    reason = reason.when(~known & ~C("target_is_empty"), "output is not empty and has no ledger")
    return (
        plans.join(stored, "run_id", "left")
        .select("run_id", reason.alias("conflict"))
        .where("conflict IS NOT NULL")
    )


def identity_differences(
    current: DataFrame,
    stored: DataFrame,
    key: str,
    *,
    always: Sequence[str] = ALWAYS_COMPARED,
    when_set: Sequence[str] = COMPARED_WHEN_SET,
) -> DataFrame:
    """(key, mismatched): names of the identity fields in which a run and its checkpoint differ."""
    names = [*always, *when_set]
    old = stored.select(key, *[C(n).alias(f"_{n}") for n in names])
    checks = [F.when(~C(n).eqNullSafe(C(f"_{n}")), F.lit(n)) for n in always]
    checks += [F.when(C(n).isNotNull() & ~C(n).eqNullSafe(C(f"_{n}")), F.lit(n)) for n in when_set]
    return current.join(old, key).select(key, F.array_compact(F.array(*checks)).alias("mismatched"))


def host_differs(current: Column, stored: Column, fields: Sequence[str]) -> Column:
    """Whether two host structs differ in any field but the ignored one."""
    compared = [f for f in fields if f != IGNORED_HOST_FIELD]
    return ~F.struct(*[current[f] for f in compared]).eqNullSafe(F.struct(*[stored[f] for f in compared]))


def suite_status(tasks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """complete when every task is, partial when any is complete or partial, else failed."""
    every = F.coalesce(F.bool_and(C("status") == "complete"), F.lit(False))
    some = F.coalesce(F.bool_or(C("status").isin("complete", "partial")), F.lit(False))
    return tasks.groupBy(*by).agg(
        F.count("*").alias("tasks"),
        F.when(every, "complete").when(some, "partial").otherwise("failed").alias("status"),
    )


def readiness(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ready unless an error-severity check failed; a stated readiness must agree."""
    broken = (C("status") == "failed") & (C("severity") == "error")
    summary = checks.groupBy(*by).agg(
        (~F.coalesce(F.bool_or(broken), F.lit(False))).alias("ready"),
        F.count("*").alias("checks"),
        F.count_if(broken).alias("failed_checks"),
        *([F.bool_and("stated_ready").alias("stated_ready")] if "stated_ready" in checks.columns else []),
    )
    if "stated_ready" in checks.columns:
        return summary.withColumn("consistent", C("stated_ready").eqNullSafe(C("ready")))
    return summary


def resume_problems(manifest: DataFrame, results: DataFrame, failures: DataFrame, active: DataFrame, run_keys: Sequence[str]) -> DataFrame:
    """Why a checkpoint cannot continue, one row per problem.

    Stored results must be an ordered prefix of the manifest, an active sample must be the next
    one, and every failed result must be among the failures.
    ``manifest`` and ``results``: run keys, ord (0-based, dense), sample_id; ``results`` also
    status; ``failures`` and ``active``: run keys, sample_id.
    """
    keys = list(run_keys)
    at = [*keys, "ord"]
    ends = results.groupBy(*keys).agg(
        F.count("*").alias("_stored"), (F.max("ord") + 1).alias("_next"), F.max("sample_id").alias("_last")
    )
    upcoming = active.join(ends.select(*keys, "_next"), keys, "left").select(
        *keys, F.coalesce("_next", F.lit(0)).alias("ord"), C("sample_id").alias("_active")
    )
    listed = failures.select(*keys, "sample_id").distinct().withColumn("_listed", F.lit(True))
    stored = results.select(*at, "sample_id", "status", F.lit(True).alias("_there")).join(listed, [*keys, "sample_id"], "left")
    planned = manifest.select(*at, C("sample_id").alias("_planned"))
    # one row for each position that is stored or comes next, with everything that is said of it
    met = stored.join(upcoming, at, "full").join(planned, at, "left")

    def problem(broken: Column, sample: str, name: str) -> Column:
        return F.when(broken, F.struct(C(sample).alias("sample_id"), F.lit(name).alias("problem")))

    found = F.array_compact(
        F.array(
            problem(C("_there") & ~C("sample_id").eqNullSafe(C("_planned")), "sample_id", "not_a_prefix"),
            problem(C("_active").isNotNull() & ~C("_active").eqNullSafe(C("_planned")), "_active", "wrong_active_sample"),
            problem((C("status") == "failed") & C("_listed").isNull(), "sample_id", "failure_not_listed"),
        )
    )
    told = met.select(*keys, F.inline(found))
    # dense from zero: as many rows as the last position says
    gaps = ends.where("_stored <> _next").select(*keys, C("_last").alias("sample_id"), F.lit("gap").alias("problem"))
    return told.unionByName(gaps)
