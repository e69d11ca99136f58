"""Scoring of recognitions against references: coverage, edit counts, rates, run summaries.

Rates are always computed from summed counts.  Every expected sample ends in exactly one coverage
class, and samples with an empty reference (silence controls) never enter a rate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbench.functions.alignment import character_edit_counts, word_edit_counts
from corpusbench.functions.text import has_word, normalize_text
from corpusbench.operators.spread import compute_partitions

COUNT_COLUMNS = tuple(f"{unit}_{kind}" for unit in ("w", "c") for kind in ("s", "d", "i", "n"))


def rate(unit: str) -> Column:
    """Error rate from the summed counts of words (``w``) or characters (``c``)."""
    edits = F.col(f"{unit}_s") + F.col(f"{unit}_d") + F.col(f"{unit}_i")
    return F.try_divide(edits.cast("double"), F.col(f"{unit}_n").cast("double"))


def with_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({"wer": rate("w"), "cer": rate("c")})


def count_sums(prefix: str = "") -> list[Column]:
    return [
        F.coalesce(F.sum(prefix + c), F.lit(0)).cast("bigint").alias(prefix + c)
        for c in COUNT_COLUMNS
    ]


def classify_coverage(references: DataFrame, recognitions: DataFrame) -> DataFrame:
    """Every reference id once, with its recognition and a class: scored, failed, missing or duplicate.

    An id that comes more than once on either side is a duplicate and is not scored, however alike
    its rows are: nothing tells which of them is meant.
    """
    fields = [c for c in references.columns if c != "sample_id"]
    asked = references.groupBy("sample_id").agg(
        F.min(F.struct(*fields)).alias("asked"), F.count("*").alias("_asked")
    )
    heard = recognitions.groupBy("sample_id").agg(
        F.min(F.struct("text", "status")).alias("heard"), F.count("*").alias("_heard")
    )
    coverage = (
        F.when((F.col("_asked") > 1) | (F.col("_heard") > 1), "duplicate")
        .when(F.col("heard.status").isNull(), "missing")
        .when(F.col("heard.status") == "failed", "failed")
        .otherwise("scored")
    )
    renamed = [F.col(f"asked.{c}").alias("reference" if c == "text" else c) for c in fields]
    return asked.join(heard, "sample_id", "left").select(
        "sample_id", *renamed, F.col("heard.text").alias("hypothesis"), coverage.alias("coverage")
    )


def unexpected_recognitions(references: DataFrame, recognitions: DataFrame) -> DataFrame:
    """Recognitions nobody asked for, each as often as it came."""
    return recognitions.join(references.select("sample_id"), "sample_id", "left_anti")


def score_utterances(classified: DataFrame, *, keep_texts: bool = False) -> DataFrame:
    """Edit counts of the scored rows.

    Only the key, the group and the texts reach the alignment stage, spread by sample over enough
    tasks for work that grows with the square of a text's length.  Texts are normalized before that
    shuffle: composing them takes a Python worker of its own, which would stand beside each aligning one.
    Silence is told from the reference itself, not from the counts: Spark moves a filter by it before the
    shuffle, and one by the counts would align all words there, a second time, in workers of its own.
    """
    extra = [c for c in classified.columns if c not in ("reference", "hypothesis", "coverage")]
    reference, hypothesis = F.col("reference"), F.col("hypothesis")
    silent = F.when(reference.isNotNull() & hypothesis.isNotNull(), ~has_word(reference))
    normalized = classified.where("coverage = 'scored'").select(
        *extra,
        silent.alias("is_silence"),
        normalize_text(reference).alias("normalized_reference"),
        normalize_text(hypothesis).alias("normalized_hypothesis"),
    )
    spread = normalized.repartition(compute_partitions(classified.sparkSession), "sample_id")
    pair = F.col("normalized_reference"), F.col("normalized_hypothesis")
    counted = spread.withColumns(
        {"w": word_edit_counts(*pair), "c": character_edit_counts(*pair)}
    )
    flat = [F.col(name.replace("_", ".")).alias(name) for name in COUNT_COLUMNS]
    texts = ["normalized_reference", "normalized_hypothesis"] if keep_texts else []
    return counted.select(*extra, *texts, *flat, "is_silence")


def corpus_score(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Corpus rates from counts summed over speech rows."""
    return with_rates(scored.where("NOT is_silence").groupBy(*by).agg(*count_sums()))


def group_counts(scored: DataFrame) -> DataFrame:
    """Counts summed per group; a sample without a group is a group of its own."""
    group = F.coalesce("group_id", "sample_id").alias("group_id")
    return scored.where("NOT is_silence").groupBy(group).agg(*count_sums())


def group_score(scored: DataFrame) -> DataFrame:
    return with_rates(group_counts(scored))


def silence_controls(scored: DataFrame) -> DataFrame:
    """Scored rows with an empty reference: their insertions are kept apart from every rate."""
    return scored.where("is_silence")


def mean_file_rates(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of per-file rates: a different statistic from the corpus rate, named as such."""
    speech = with_rates(scored.where("NOT is_silence"))
    return speech.groupBy(*by).agg(
        F.count("*").alias("files"),
        F.avg("wer").alias("mean_file_wer"),
        F.avg("cer").alias("mean_file_cer"),
    )


def coverage_details(classified: DataFrame, unexpected: DataFrame) -> DataFrame:
    """(coverage, sample_id) of every sample that is missing, failed, a duplicate or unexpected.

    A table instead of id lists, so a class may be as large as the corpus.
    """
    unscored = classified.where("coverage <> 'scored'").select("coverage", "sample_id")
    return unscored.unionByName(
        unexpected.select(F.lit("unexpected").alias("coverage"), "sample_id")
    )


def coverage_summary(classified: DataFrame, unexpected: DataFrame) -> DataFrame:
    """One row: class counts, coverage rate and whether the run is complete."""
    classes = classified.select("coverage").unionByName(
        unexpected.select(F.lit("unexpected").alias("coverage"))
    )
    summary = classes.agg(
        F.count_if(F.col("coverage") != "unexpected").alias("expected"),
        *[
            F.count_if(F.col("coverage") == c).alias(c)
            for c in ("scored", "missing", "failed", "duplicate", "unexpected")
        ],
    )
    unscored = F.col("missing") + F.col("failed") + F.col("duplicate")
    return summary.withColumns(
        {
            "unscored": unscored,
            "rate": F.try_divide(F.col("scored").cast("double"), F.col("expected").cast("double")),
            "complete": (F.col("expected") > 0) & (unscored == 0),
        }
    )


class Evaluation(NamedTuple):
    utterances: DataFrame
    speech: DataFrame
    groups: DataFrame
    silence: DataFrame
    coverage: DataFrame
    coverage_details: DataFrame


def evaluate(references: DataFrame, recognitions: DataFrame, *, scored_path: str | None = None) -> Evaluation:
    """The whole report as tables over one scored table.

    The tables are lazy, so each action aligns anew; with ``scored_path``, a folder all executors
    share, the scored rows are written there once and every table is derived from them.
    """
    classified = classify_coverage(references, recognitions)
    unexpected = unexpected_recognitions(references, recognitions)
    scored = score_utterances(classified, keep_texts=True)
    if scored_path is not None:
        scored.write.mode("errorifexists").parquet(scored_path)
        scored = scored.sparkSession.read.schema(scored.schema).parquet(scored_path)
    return Evaluation(
        utterances=scored,
        speech=corpus_score(scored),
        groups=group_score(scored),
        silence=silence_controls(scored),
        coverage=coverage_summary(classified, unexpected),
        coverage_details=coverage_details(classified, unexpected),
    )


Scorer = Callable[[DataFrame, DataFrame], Evaluation]


def references_from_samples(samples: DataFrame) -> DataFrame:
    """Manifest samples as scoring references."""
    return samples.select(
        "sample_id",
        F.coalesce("group_id", "sample_id").alias("group_id"),
        F.col("reference_text").alias("text"),
    )


def recognitions_from_results(results: DataFrame) -> DataFrame:
    """Run results as scoring recognitions."""
    return results.select(
        "sample_id",
        F.col("transcript.text").alias("text"),
        F.when(F.col("status") == "ok", "ok").otherwise("failed").alias("status"),
        F.col("failure.message").alias("error"),
    )


def score_run(samples: DataFrame, results: DataFrame, scorer: Scorer = evaluate) -> Evaluation:
    """Score run results with any callable that takes references and recognitions."""
    return scorer(references_from_samples(samples), recognitions_from_results(results))


PEAKS = (
    "process_rss_peak_bytes", "process_tree_rss_peak_bytes",
    "gpu_peak_allocated_bytes", "gpu_peak_reserved_bytes",
)


def performance_summary(
    results: DataFrame, by: Sequence[str] = (), *, rtf_policy: str = "all_elapsed"
) -> DataFrame:
    """Summed times, real-time factor and peaks of rows with a transcript and a measurement.

    With ``all_elapsed`` the factor's numerator also holds rows of unknown audio duration;
    ``paired`` counts only rows that have both.
    """
    if rtf_policy not in ("all_elapsed", "paired"):
        raise ValueError(f"unknown rtf_policy: {rtf_policy}")
    measured = results.where("has_transcript AND elapsed_seconds IS NOT NULL")
    elapsed, audio = F.col("elapsed_seconds"), F.col("audio_seconds")
    paired = F.when(audio.isNotNull(), elapsed) if rtf_policy == "paired" else elapsed
    peaks = [F.max(p).alias(p) for p in PEAKS if p in results.columns]
    zero = F.lit(0.0)
    return (
        measured.groupBy(*by)
        .agg(
            F.count("*").alias("measured_samples"),
            F.coalesce(F.sum(elapsed), zero).alias("total_inference_seconds"),
            F.coalesce(F.sum(audio), zero).alias("total_audio_seconds"),
            F.try_divide(F.sum(paired), F.sum(audio)).alias("real_time_factor"),
            *peaks,
        )
    )


def run_counts(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Running counts: rows seen, succeeded and failed of all expected samples."""
    status = F.col("status")
    return samples.groupBy(*by).agg(
        F.count("status").alias("completed"),
        F.count_if(status == "ok").alias("succeeded"),
        F.count_if(status == "failed").alias("failed"),
        F.count("*").alias("total"),
    )


def run_status(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Status per run of expected samples with a nullable result status.

    ``samples`` also carries ``scoring_status`` and ``run_failures`` (failures outside samples).
    """
    ok = F.count_if(F.col("status") == "ok")
    every = F.bool_and(F.coalesce(F.col("status") == "ok", F.lit(False)))
    scored = F.bool_and(F.col("scoring_status") == "ok")
    clean = F.max("run_failures") == 0
    return samples.groupBy(*by).agg(
        F.count("*").alias("expected_samples"),
        ok.alias("succeeded_samples"),
        (F.count("*") - ok).alias("failed_samples"),
        F.coalesce(F.try_divide(ok.cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("coverage"),
        F.when(every & scored & clean, "complete").when(ok > 0, "partial").otherwise("failed").alias("status"),
    )
