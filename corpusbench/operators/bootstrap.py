"""Grouped bootstrap: resample whole groups, recompute corpus rates from summed counts.

Rows are summed to one row per group first, so the cost is replicates x groups whatever the corpus size.
Groups are numbered and held by buckets of consecutive numbers.  A replicate's draws are made twice:
once to count how many fall into each bucket, and then, beside the bucket's groups, which of them.  Every
draw is a hash of the seed, the replicate and its own number, so any task can make it; between the tasks
only counts by (replicate, bucket) and sums by replicate are exchanged, never the draws.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusbench.operators.scoring import COUNT_COLUMNS, count_sums, group_counts
from corpusbench.operators.spread import spread_join
from corpusbench.session import written_once

BUCKET_GROUPS = 4096
_REPLICATES = 256  # that meet a bucket in one task
_CHUNK = 1 << 16  # draws of a replicate that one row stands for, at least
_AT_ONCE = 1 << 18
_TASK_DRAWS = 1 << 24
_BITS = (1 << 32) - 1
_TOO_FEW = "fewer than two groups with speech"
_DISABLED = "no replicates were asked for"


def _check(replicates: int, confidence: float) -> None:
    if replicates < 0:
        raise ValueError("the number of replicates is 0 or more")
    if not 0 < confidence < 1:
        raise ValueError("confidence lies between 0 and 1")


def number_groups(groups: DataFrame) -> DataFrame:
    """Add ``slot`` (0-based, dense) and ``group_count`` without sorting all groups in one task.

    Groups are numbered inside 4096 hash buckets; only the bucket sizes are summed in one place.
    """
    bucketed = groups.withColumn("bucket", F.substring(F.md5(F.col("group_id").cast("binary")), 1, 3))
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("size"))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "bucket",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first_slot"),
        F.sum("size").over(W.partitionBy()).alias("group_count"),
    )
    inside = F.row_number().over(W.partitionBy("bucket").orderBy("group_id")) - 1
    return (
        bucketed.withColumn("inside", inside)
        .join(F.broadcast(offsets), "bucket")
        .withColumn("slot", (F.col("first_slot") + F.col("inside")).cast("bigint"))
        .drop("bucket", "inside", "first_slot")
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    """32 well-mixed bits of whole numbers."""
    x = x & np.uint64(_BITS)
    for shift, factor in ((16, 0x21F0AAAD), (15, 0x735A2D97)):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(_BITS)
    return x ^ (x >> np.uint64(15))


def _streams(seed: int, *parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two starting points for the draws of a replicate, or of one bucket of it."""
    u = np.uint64(seed & _BITS)
    for part in parts:
        u = _mixed(u * np.uint64(3) + part.astype(np.uint64) + np.uint64(1))
    return u, _mixed(u + np.uint64(0x9E3779B9))


def _drawn(u: np.ndarray, w: np.ndarray, number: np.ndarray, many: int) -> np.ndarray:
    """A number below ``many`` for each draw: from two mixes of the draw's number, for one alone would never repeat a value."""
    x, y = _mixed(u + number), _mixed(w + number)
    return (((x ^ y) << np.uint64(30)) + (_mixed(x + y) >> np.uint64(2))) % np.uint64(many)


def _fallen(batches: Iterator[pa.RecordBatch], many: int, chunk: int, seed: int) -> Iterator[pa.RecordBatch]:
    """How many of a replicate's draws, a chunk of them at a time, fall into each bucket."""
    buckets = -(-many // BUCKET_GROUPS)
    for batch in batches:
        for replicate, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            u, w = _streams(seed, np.array([replicate]))
            counts, end = np.zeros(buckets, np.int64), min(first + chunk, many)
            for low in range(first, end, _AT_ONCE):
                slots = np.arange(low, min(low + _AT_ONCE, end), dtype=np.uint64)
                counts += np.bincount((_drawn(u, w, slots, many) // np.uint64(BUCKET_GROUPS)).astype(np.int64), minlength=buckets)
            hit = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(hit), replicate)), pa.array(hit), pa.array(counts[hit])], ["replicate", "bucket", "draws"]
            )


def _summed(batches: Iterator[pa.RecordBatch], seed: int, sums: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Sums of the groups that are drawn inside a bucket; a bucket's groups come before its replicates."""
    now, parts, held = None, [], None
    for batch in batches:
        block, bucket, draws, replicate = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "bucket", "draws", "replicate"))
        values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in sums], axis=1)
        edges = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0) | (np.diff(draws >= 0, prepend=False)))
        for low, high in zip([0, *edges[edges > 0]], [*edges[edges > 0], len(block)], strict=True):
            if (block[low], bucket[low]) != now:
                now, parts, held = (block[low], bucket[low]), [], None
            if draws[low] < 0:
                parts.append(values[low:high])
                continue
            if held is None:
                held, parts = np.concatenate(parts), []
            while low < high:  # some replicates at a time
                stop = max(low + 1, int(np.searchsorted(np.cumsum(draws[low:high]), _AT_ONCE, side="right")) + low)
                n = draws[low:stop]
                u, w = (np.repeat(x, n) for x in _streams(seed, replicate[low:stop], bucket[low:stop]))
                begin = np.cumsum(n) - n
                number = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(begin, n)
                chosen = held[_drawn(u, w, number.astype(np.uint64), len(held)).astype(np.int64)]
                total = np.add.reduceat(chosen, begin, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(replicate[low:stop]), *(pa.array(c) for c in total.T)], ["replicate", *sums])
                low = stop


def resample(
    groups: DataFrame, sums: Sequence[str], *, replicates: int, seed: int
) -> DataFrame:
    """Summed counts per replicate, with the number of groups: as many draws as there are groups, with replacement.

    Groups are numbered and written to the shared folder, so that the alignment behind them runs once.
    """
    spark = groups.sparkSession
    bucket = F.floor(F.col("slot") / BUCKET_GROUPS).alias("bucket")
    numbered = number_groups(written_once(groups, "bootstrap-groups")).select(
        bucket, "slot", *(F.col(c).cast("bigint").alias(c) for c in sums)
    )
    held = written_once(numbered, "bootstrap-numbered")
    many = held.count()
    chunk = max(_CHUNK, 64 * -(-many // BUCKET_GROUPS))  # enough draws for several in each bucket
    chunks = -(-many // chunk)
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-replicates * many // _TASK_DRAWS))
    rows = spark.range(0, replicates * chunks, 1, tasks).select(
        F.floor(F.col("id") / max(chunks, 1)).alias("replicate"), (F.col("id") % max(chunks, 1) * chunk).alias("first")
    )
    fallen = rows.mapInArrow(lambda batches: _fallen(batches, many, chunk, seed), "replicate bigint, bucket bigint, draws bigint")
    counts = fallen.groupBy("replicate", "bucket").agg(F.sum("draws").alias("draws"))
    none = F.lit(None).cast("bigint")
    order = ["block", "bucket", "draws", "replicate", "slot", *sums]
    drawing = counts.select(
        F.floor(F.col("replicate") / _REPLICATES).alias("block"), "bucket", "draws", "replicate", none.alias("slot"),
        *(F.lit(0).cast("bigint").alias(c) for c in sums),
    )
    blocks = F.sequence(F.lit(0).cast("bigint"), F.lit((replicates - 1) // _REPLICATES).cast("bigint"))
    offered = held.select(
        F.explode(blocks).alias("block"), "bucket", F.lit(-1).cast("bigint").alias("draws"), F.lit(-1).cast("bigint").alias("replicate"), "slot", *sums
    )
    beside = offered.select(order).union(drawing.select(order)).repartition(tasks, "block", "bucket")
    kinds = ", ".join(f"{c} bigint" for c in ("replicate", *sums))
    # Groups have -1 draws, so they stand first, in the order of their numbers.
    chosen = beside.sortWithinPartitions("block", "bucket", F.col("draws") >= 0, "slot", "replicate").mapInArrow(
        lambda batches: _summed(batches, seed, sums), kinds
    )
    return chosen.groupBy("replicate").agg(
        F.lit(many).cast("bigint").alias("group_count"), *[F.sum(c).alias(c) for c in sums]
    )


def percentile(values: Column, probability: float) -> Column:
    """Linear interpolation between the neighbours of position (n - 1) x probability."""
    return F.percentile(values, F.lit(probability))


_MARGIN, _ACCURACY = 0.0005, 20_000  # ten times the error that the sketch may have
_WHOLE = 8192


def grouped_percentiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """One row per key with the exact percentile under each name, for groups of any size.

    A quantile sketch of each group, merged over tasks, gives two values that enclose the wanted ranks
    whatever the values' distribution.  A second pass counts what lies below them and gathers only what
    lies between, about a thousandth of a large group, as distinct values with their counts.  Should the
    ranks not lie between, the query fails rather than be wrong.  NULL values do not count.
    """
    keys, places = list(keys), list(probabilities.values())
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    shares = [min(1.0, max(0.0, p + side)) for p in places for side in (-_MARGIN, _MARGIN)]
    sketched = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
        F.approx_percentile("_v", shares, _ACCURACY).alias("_cuts"),
    )
    whole = F.col("_n") <= _WHOLE  # too few for a rank or two not to matter
    edge = [
        F.when(whole | F.lit(x in (0.0, 1.0)), F.col("_most" if k % 2 else "_least")).otherwise(F.get("_cuts", F.lit(k)))
        for k, x in enumerate(shares)
    ]
    wanted = F.array(*(
        F.struct(F.lit(k).alias("place"), F.lit(p).alias("p"), edge[2 * k].alias("low"), edge[2 * k + 1].alias("high"))
        for k, p in enumerate(places)
    ))
    bounds = sketched.select(*keys, "_n", wanted.alias("_wanted"))
    beside = spread_join(rows, bounds, keys, "_v")
    below = beside.groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.max("_wanted").alias("_wanted"),
        F.array(*(F.count(F.when(F.col("_v") < F.get("_wanted", F.lit(k))["low"], 1)) for k in range(len(places)))).alias("_below"),
    )
    values = _near(beside, keys).groupBy(*keys, "_place", "_v").agg(F.count("*").alias("_times"))
    up_to = W.partitionBy(*keys, "_place").orderBy("_v")
    ranked = values.withColumn("_end", F.sum("_times").over(up_to))
    position = (F.col("_n") - 1) * F.col("_p")
    asked = below.select(*keys, "_n", "_below", F.posexplode("_wanted").alias("_place", "_w")).select(
        *keys, "_place", "_n", F.col("_w.p").alias("_p"), F.get("_below", F.col("_place")).alias("_first")
    ).withColumn("_rank", F.explode(F.array(F.floor(position), F.ceil(position))))
    place = F.col("_rank") - F.col("_first")
    hit = (place < F.col("_end")) & (place >= F.col("_end") - F.col("_times"))
    weight = position - F.floor(position)
    ends = asked.join(ranked, [*keys, "_place"], "left").groupBy(*keys, "_place", "_p").agg(
        F.min(F.when(hit, F.col("_v"))).alias("_below"), F.max(F.when(hit, F.col("_v"))).alias("_above"),
        F.max(weight).alias("_weight"), F.count(F.when(hit, 1)).alias("_found"),
    )
    between = F.when(
        F.col("_found") == 2, F.col("_below") + (F.col("_above") - F.col("_below")) * F.col("_weight")
    ).otherwise(F.raise_error(F.lit("a percentile lies outside of its sketched bounds")).cast("double"))
    named = [F.max(F.when(F.col("_place") == k, between)).alias(name) for k, name in enumerate(probabilities)]
    return ends.groupBy(*keys).agg(*named)


def _near(beside: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values that lie between the bounds of a wanted place."""
    inside = F.filter("_wanted", lambda w: (w["low"] <= F.col("_v")) & (F.col("_v") <= w["high"]))
    return beside.select(*keys, "_v", F.explode(F.transform(inside, lambda w: w["place"])).alias("_place"))


def _rate(unit: str, prefix: str = "") -> Column:
    s, d, i, n = (F.col(f"{prefix}{unit}_{k}") for k in ("s", "d", "i", "n"))
    return F.try_divide((s + d + i).cast("double"), n.cast("double"))


def _disabled(scored: DataFrame, seed: int, confidence: float) -> DataFrame:
    return group_counts(scored).agg(F.count("*").alias("group_count")).select(
        "group_count",
        F.lit(0).alias("requested_replicates"),
        F.lit(0).cast("bigint").alias("valid_wer_replicates"),
        F.lit(0).cast("bigint").alias("valid_cer_replicates"),
        F.lit(seed).alias("seed"),
        F.lit(confidence).alias("confidence"),
        *[
            F.lit(None).cast("double").alias(f"{r}_{b}")
            for r in ("wer", "cer")
            for b in ("lower", "upper")
        ],
        F.when(F.col("group_count") < 2, _TOO_FEW).otherwise(_DISABLED).alias("reason"),
    )


def bootstrap_intervals(
    scored: DataFrame,
    *,
    replicates: int = 2000,
    seed: int = 42,
    confidence: float = 0.95,
) -> DataFrame:
    """One row: percentile intervals of the corpus rates, or a reason why there are none."""
    _check(replicates, confidence)
    if replicates == 0:
        return _disabled(scored, seed, confidence)
    tail = (1 - confidence) / 2
    sums = resample(
        group_counts(scored), COUNT_COLUMNS, replicates=replicates, seed=seed
    )
    rates = sums.select("group_count", _rate("w").alias("wer"), _rate("c").alias("cer"))
    enough = F.col("group_count") >= 2
    summary = rates.agg(
        F.coalesce(F.max("group_count"), F.lit(0)).cast("bigint").alias("group_count"),
        F.count("wer").alias("wer_draws"),
        F.count("cer").alias("cer_draws"),
        *[
            percentile(F.col(r), p).alias(f"_{r}_{bound}")
            for r in ("wer", "cer")
            for bound, p in (("lower", tail), ("upper", 1 - tail))
        ],
    )
    return summary.select(
        "group_count",
        F.lit(replicates).alias("requested_replicates"),
        *[
            F.when(enough, F.col(f"{r}_draws")).otherwise(0).alias(f"valid_{r}_replicates")
            for r in ("wer", "cer")
        ],
        F.lit(seed).alias("seed"),
        F.lit(confidence).alias("confidence"),
        *[
            F.when(enough, F.col(f"_{r}_{b}")).alias(f"{r}_{b}")
            for r in ("wer", "cer")
            for b in ("lower", "upper")
        ],
        F.when(~enough, _TOO_FEW).alias("reason"),
    )


def paired_difference(
    scored_a: DataFrame,
    scored_b: DataFrame,
    *,
    replicates: int = 2000,
    seed: int = 42,
    confidence: float = 0.95,
) -> DataFrame:
    """Interval of rate(a) - rate(b) over the samples both models scored, same draws for both."""
    _check(replicates, confidence)
    if replicates == 0:
        raise ValueError("a paired difference needs replicates")

    def side(scored: DataFrame, prefix: str) -> list[Column]:
        return [F.col(c).alias(prefix + c) for c in COUNT_COLUMNS]

    a = scored_a.where("NOT is_silence").select(
        "sample_id", F.coalesce("group_id", "sample_id").alias("group_id"), *side(scored_a, "a_")
    )
    b = scored_b.where("NOT is_silence").select("sample_id", *side(scored_b, "b_"))
    groups = (
        a.join(b, "sample_id")
        .groupBy("group_id")
        .agg(F.count("*").alias("samples"), *count_sums("a_"), *count_sums("b_"))
    )
    names = [p + c for p in ("a_", "b_") for c in COUNT_COLUMNS]
    sums = resample(groups, names, replicates=replicates, seed=seed)
    tail = (1 - confidence) / 2
    differences = sums.select(
        "group_count",
        *[(_rate(u, "a_") - _rate(u, "b_")).alias(r) for u, r in (("w", "wer"), ("c", "cer"))],
    )
    enough = F.max("group_count") >= 2
    return differences.agg(
        F.coalesce(F.max("group_count"), F.lit(0)).cast("bigint").alias("group_count"),
        *[
            F.when(enough, percentile(F.col(r), p)).alias(f"{r}_difference_{bound}")
            for r in ("wer", "cer")
            for bound, p in (("lower", tail), ("upper", 1 - tail))
        ],
    )
