"""Fixed-length audio windows and the merge of their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


def fixed_windows(samples: DataFrame, chunk_seconds: float) -> DataFrame:
    """Contiguous windows of ``chunk_seconds``; the last may be short and empty audio keeps one.

    ``samples``: sample_id, n_samples, sample_rate.  Adds window, start, stop.
    """
    chunk = F.greatest(F.lit(1), F.floor(C("sample_rate") * F.lit(float(chunk_seconds))))
    counted = samples.withColumns(
        {"_chunk": chunk, "_windows": F.greatest(F.lit(1), F.ceil(C("n_samples") / chunk))}
    )
    placed = counted.withColumn("window", F.explode(F.sequence(F.lit(0).cast("bigint"), C("_windows") - 1)))
    return placed.withColumns(
        {
            "start": C("window") * C("_chunk"),
            "stop": F.least((C("window") + 1) * C("_chunk"), C("n_samples")),
        }
    ).drop("_chunk", "_windows")


def balanced_windows(
    samples: DataFrame, chunk_seconds: float, *, minimum_final_seconds: float = 1.0
) -> DataFrame:
    """Fixed windows whose last boundary moves left when the tail would be too short.

    The tail grows to the minimum, or to half of the last two windows if that is less.
    Empty audio has no window.
    """
    windows = fixed_windows(samples.where("n_samples > 0"), chunk_seconds)
    chunk = F.greatest(F.lit(1), F.floor(C("sample_rate") * F.lit(float(chunk_seconds))))
    last = F.ceil(C("n_samples") / chunk) - 1
    pair = C("n_samples") - (last - 1) * chunk
    wanted = F.least(F.floor(C("sample_rate") * F.lit(float(minimum_final_seconds))), F.floor(pair / 2))
    moved = (last >= 1) & (C("n_samples") - last * chunk < wanted)
    boundary = C("n_samples") - wanted
    return windows.withColumns(
        {
            "start": F.when(moved & (C("window") == last), boundary).otherwise(C("start")),
            "stop": F.when(moved & (C("window") == last - 1), boundary).otherwise(C("stop")),
        }
    )


def merge_segments(segments: DataFrame, separator: str = " ") -> DataFrame:
    """One transcript per sample: non-empty texts in order, first language, segment count.

    ``segments``: sample_id, ord, text, language.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    texts = F.transform(
        F.filter(ordered, lambda s: s["text"] != ""), lambda s: s["text"]
    )
    return segments.groupBy("sample_id").agg(
        F.array_join(texts, separator).alias("text"),
        F.min_by("language", "ord").alias("language"),
        F.count("*").alias("segments"),
    )
