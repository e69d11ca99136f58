"""Report tables: histograms, previews, dominant failures, positions, run artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusbench.operators.matching import top_k, top_one
from corpusbench.operators.spread import spread_join

C = F.col

PREVIEW_ROWS = 5
_CUTS, _STEP = 1024, 32
_ACCURACY = 20_000


def status_histogram(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per status, sorted by status."""
    return df.groupBy(*by, "status").agg(F.count("*").alias("rows")).orderBy(*by, "status")


def error_preview(errors: DataFrame, by: Sequence[str], order: Sequence[str], rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of each group and how many more there are."""
    totals = errors.groupBy(*by).agg(F.count("*").alias("_total"))
    shown = top_k(errors, list(by), [C(c) for c in order], rows)
    additional = F.greatest(F.lit(0).cast("bigint"), C("_total") - rows)
    return shown.join(totals, list(by)).withColumn("additional", additional).drop("_total")


def manifest_statistics(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Samples with and without a reference text."""
    present = C("reference_text") != ""
    return samples.groupBy(*by).agg(
        F.count("*").alias("samples"),
        F.count_if(present).alias("with_reference"),
        F.count_if(~present).alias("missing_reference"),
    )


def _filled(text: Column) -> Column:
    return F.nullif(F.coalesce(text, F.lit("")), F.lit(""))


def _detail(kind: Column, message: Column) -> Column:
    return F.concat_ws(": ", F.array_distinct(F.array_compact(F.array(_filled(kind), _filled(message)))))


def failure_counts(samples: DataFrame) -> DataFrame:
    """Failed samples per model and kind, with the detail seen first.

    ``samples``: model_key, status, error_code, error_type, message, seq.
    """
    kind = F.coalesce(_filled(C("error_code")), _filled(C("error_type")), F.lit("unknown_failure"))
    failed = samples.where("status = 'failed'").withColumn("kind", kind)
    return (
        failed.withColumn("_detail", _detail(C("kind"), C("message")))
        .groupBy("model_key", "kind")
        .agg(F.count("*").alias("failures"), F.min_by("_detail", "seq").alias("detail"))
    )


def dominant_failures(samples: DataFrame, models: DataFrame) -> DataFrame:
    """The most frequent failure per model; a failure of the model itself where no sample failed.

    ``models``: model_key, failed, failure_code, failure_type, failure_message.
    """
    order = [C("failures").desc(), C("detail")]
    dominant = top_one(failure_counts(samples), ["model_key"], order).drop("kind")
    own_kind = F.coalesce(_filled(C("failure_code")), _filled(C("failure_type")))
    has_own = _filled(C("failure_message")).isNotNull() | _filled(C("failure_type")).isNotNull()
    own = models.where(has_own).select(
        "model_key",
        F.greatest(F.lit(1).cast("bigint"), C("failed").cast("bigint")).alias("failures"),
        _detail(own_kind, C("failure_message")).alias("detail"),
    )
    known = dominant.join(models.select("model_key"), "model_key", "left_semi")
    return known.unionByName(own.join(known.select("model_key"), "model_key", "left_anti"))


def collapse_repeated_details(samples: DataFrame) -> DataFrame:
    """Newest failure of each kind keeps its message; older ones show none.

    ``samples``: dataset_id, preset_id, status, error_code, error_type, message, seq.  Only the
    newest position per kind is aggregated, so a frequent kind is never sorted in one task.
    """
    kind = F.coalesce(_filled(C("error_code")), _filled(C("error_type")), _filled(C("message")), F.lit(""))
    keyed = samples.withColumn("_kind", kind)
    keys = ["dataset_id", "preset_id", "_kind"]
    newest = keyed.where("status = 'failed'").groupBy(*keys).agg(F.max("seq").alias("_newest"))
    shown = (C("status") != "failed") | (C("seq") == C("_newest"))
    message = F.when(shown, _filled(C("message")))
    return spread_join(keyed, newest, keys, "seq", salts=None, how="left").withColumn("shown_message", message).drop("_kind", "_newest")


def order_buckets(df: DataFrame, keys: Sequence[str], ord_column: str, bucket_rows: int) -> DataFrame:
    """Add ``_bucket``, which rises with the order column inside a run; runs of up to ``bucket_rows`` rows have one."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    long = counts.where(C("_rows") > bucket_rows).select(*keys)
    shares = [k / _CUTS for k in range(1, _CUTS)]
    cuts = df.join(long, keys, "left_semi").groupBy(*keys).agg(F.approx_percentile(ord_column, shares, _ACCURACY).alias("_cuts"))
    every = F.sequence(F.lit(_STEP), F.lit(_CUTS - _STEP), F.lit(_STEP))
    sketched = cuts.withColumn("_coarse", F.transform(every, lambda k: F.element_at("_cuts", k)))
    passed = F.size(F.filter("_coarse", lambda x: x <= C(ord_column)))
    finer = F.size(F.filter(F.slice("_cuts", C("_passed") * _STEP + 1, _STEP - 1), lambda x: x <= C(ord_column)))
    return (
        spread_join(df, sketched, keys, ord_column, how="left")
        .withColumn("_passed", F.when(C("_cuts").isNotNull(), passed))
        .withColumn("_bucket", F.when(C("_cuts").isNotNull(), C("_passed") * _STEP + finer).otherwise(0))
        .drop("_cuts", "_coarse", "_passed")
    )


def positions(
    df: DataFrame, run_keys: Sequence[str], ord_column: str = "ord", *, bucket_rows: int = 100_000
) -> DataFrame:
    """1-based ``position`` and ``total`` of every row of a run.

    Rows are ranked inside buckets of the order column and shifted by the sizes of the buckets before,
    so a long run is ranked by many tasks.  A run of more than ``bucket_rows`` rows is cut at 1023 values
    that a quantile sketch of it gives, so that its buckets hold about equally many rows however its
    values are spread; only rows of equal values cannot be parted.
    """
    keys = list(run_keys)
    bucketed = order_buckets(df, keys, ord_column, bucket_rows)
    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    run = W.partitionBy(*keys)
    before = run.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"),
        F.sum("_size").over(run).alias("total"),
    )
    inside = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(ord_column))
    return (
        bucketed.withColumn("_inside", inside)
        .join(shifts, [*keys, "_bucket"])
        .withColumn("position", C("_shift") + C("_inside"))
        .drop("_bucket", "_inside", "_shift")
    )


def sample_recency(samples: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per sample with ``last_seen``; order by it to list samples by recency."""
    rest = [c for c in samples.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    last = F.max(F.struct(*order)).alias("_last")
    grouped = samples.groupBy(*keys).agg(newest, last)
    return grouped.select(*keys, *[C(f"_row.{c}").alias(c) for c in rest], C(f"_last.{order[0]}").alias("last_seen"))


# --- sinks ----------------------------------------------------------------------------------------


def write_run_artifact(summary: DataFrame, details: dict[str, DataFrame], target: str) -> None:
    """Write the one-row summary as a JSON object and each detail table as Parquet.

    An existing target is never overwritten.
    """
    summary.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(
        "errorifexists"
    ).text(f"{target}/result")
    for name, table in details.items():
        table.write.mode("errorifexists").parquet(f"{target}/{name}")


def write_batch_summary(tasks: DataFrame, target: str) -> None:
    """Tab-separated preset, status and output of every task."""
    batch_summary(tasks).write.mode("errorifexists").option("sep", "\t").option("header", True).csv(target)


def batch_summary(tasks: DataFrame) -> DataFrame:
    """``tasks``: preset_id, output_dir, worker_found, preflight_ok, status."""
    status = (
        F.when(~C("worker_found"), "skipped-missing-worker")
        .when(~C("preflight_ok"), "preflight-failed")
        .when(C("status") == "complete", "complete")
        .otherwise("failed")
    )
    return tasks.select(C("preset_id").alias("preset"), status.alias("status"), C("output_dir").alias("output"))
