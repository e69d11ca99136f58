"""Helpers the training-data operators share: staged tables, text blocks, hashes, ranks, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusbench.operators.spread import spread_join
from corpusbench.session import fresh_folder

BLOCK_BYTES = 1 << 20
GAPS = " \t\n\u000b\u000c\r"  # white space between words
NO_ID = (1 << 63) - 1  # stands for a null doc_id: larger than any id
_BASE = 0x9E3779B97F4A7C15


# ---------------------------------------------------------------- staged tables


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: lost executors recompute only from there."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few numbers as a table, planned as a local relation: no task runs Python for it."""
    fields = [field.split() for field in schema.split(",")]
    cells = ", ".join(
        "(" + ", ".join(f"CAST({'NULL' if v is None else repr(str(v))} AS {t})" for v, (_, t) in zip(row, fields, strict=True)) + ")"
        for row in rows
    )
    return spark.sql(f"SELECT * FROM VALUES {cells} AS t({', '.join(name for name, _ in fields)})")


def without_nulls(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column.fill_null("") if column.null_count else column


# ---------------------------------------------------------------- text blocks


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow column and the offset of each text in them."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, dtype=kind, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[places[0] : places[-1]], places - places[0]


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive rows of at most ``limit`` bytes (a longer text alone): first row, bytes, offsets."""
    if not len(column):
        return
    raw, offsets = text_bytes(column)
    first, rows = 0, len(column)
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of each text, and the number of words before each text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = ~gap
    first[1:] &= gap[:-1]
    last = ~gap
    last[:-1] &= gap[1:]
    opens = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[opens] = ~gap[opens]
    closes = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[closes] = ~gap[closes]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# ---------------------------------------------------------------- hashes


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as texts need them."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Sums of value times power, from which ``span_hash`` gets the hash of any span."""
    up, _ = powers.to(len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of the values in [start, end): equal spans have equal hashes wherever they stand."""
    _, down = powers.to(len(sums))
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, as the sum of a mix of every byte with its place in the word.

    Sums of powers would not do here: for any odd base there are two words of a thousand letters, two
    letters in the order of Thue and Morse and the same with the letters swapped, whose sums are equal.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)  # place in the word
    letters = raw[at + np.repeat(starts, lengths)].astype(np.uint64)
    sums = np.add.reduceat(mix((at.astype(np.uint64) << np.uint64(8)) + letters + np.uint64(_BASE)), first)
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    least, span = values, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:n], least[width - span : width - span + n])


def ranges_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges [start, start + length), one range after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, lengths)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_key(text: Column | str = "text") -> Column:
    """64 bits of a text; together with doc_id the key of a row (rows equal in both share their result)."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


# ---------------------------------------------------------------- ranks


def gapless_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, rows: int = 20_000) -> DataFrame:
    """Number the rows of each key from 0 without gaps; no key meets in one task.

    Rows are dealt to hash buckets inside their key and ranked there; the buckets' offsets come from
    their counts, a table ``rows`` times smaller.  ``df`` should be a staged table, it is read twice.
    """
    bucket, offset, place = f"{name}_bucket", f"{name}_offset", f"{name}_place"
    hashed = F.pmod(F.xxhash64(*order), F.greatest(F.lit(1), F.ceil(F.col("_n") / rows)))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # Without this a plan may leave all rows of a key where the join has put them.
    sized = spread_join(df, sizes, keys, order[0]).withColumn(bucket, hashed).drop("_n")
    dealt = sized.repartition(*keys, bucket)
    counts = dealt.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(offset))
    inside = W.partitionBy(*keys, bucket).orderBy(*order)
    ranked = dealt.withColumn(place, F.row_number().over(inside) - 1)
    joined = ranked.join(offsets, [*keys, bucket])
    return joined.withColumn(name, F.col(offset) + F.col(place)).drop(bucket, offset, place)


# ---------------------------------------------------------------- components


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each id that has an edge; ``edges`` has long columns a and b.

    Alternates hanging every neighbour, and every smaller neighbour, on the smallest one until the
    edges are stars.  Rounds are written to the shared folder; only their counts reach the driver.
    """
    now = stage_table(_directed(edges), f"{name}-edges")
    known = None
    for k in range(rounds):
        now = stage_table(_small_star(_large_star(now)), f"{name}-round{k}")
        total = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")
        ).first()
        if known == (total.n, total.h):
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        known = (total.n, total.h)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _directed(edges: DataFrame) -> DataFrame:
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    return edges.where("a <> b").select(high, low).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """For each id: hang its larger neighbours on its smallest neighbour or itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    hung = edges.select(F.col("b").alias("a"), F.col("a").alias("c")).join(least, "a")
    return hung.where("c <> m").select(F.col("c").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """For each id: hang it and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).distinct()


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n indices over the given links, by pointer jumping."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
        if not len(left) and (before == label).all():
            break
    return label
