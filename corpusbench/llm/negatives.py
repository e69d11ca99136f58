"""Hard negatives by the threshold algorithm: sorted lists per dimension, exact integer scores, early stop."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusbench.llm.common import stage_table
from corpusbench.operators.spread import spread_join

SHARD_VALUES = 1 << 18  # components of the rows that one task holds at a time
_FIRST_DEPTH = 16
_LONG = 1 << 63
_FOUND = (
    "anchor_row long, anchor_id long, place int, positive_id long, positive_score long, found_id long, found_score long"
)


def hard_negatives(
    embeddings: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 5, low_percent: int = 80,
    high_percent: int = 100, scale: int = 256, shard_values: int = SHARD_VALUES,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """Per anchor and positive the best rows of other labels whose score lies in the positive's window.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.  ``anchors`` is
    a condition on the columns of ``embeddings``.  A component x counts as floor(``scale`` * x), a score
    is the inner product with the anchor; higher scores come first, equal ones by smaller id.  Positives
    are an anchor's first ``positives`` other rows of its label, negatives the first ``negatives`` rows of
    other labels with low_percent * positive <= 100 * negative <= high_percent * positive.

    1. Rows are dealt to shards of ``shard_values`` components, for positives inside their label, for
       negatives over all labels; anchors stream past every shard in question.
    2. A shard sorts each dimension once.  An anchor reads a list downwards where its component is
       positive and upwards where it is negative; rows met are scored whole.  The sum of the products at
       the depth reached bounds every row not met: the search ends when that threshold is strictly below
       the last score wanted in each window, or below the window.
    3. The shards' firsts are merged by rank.

    Rows with a null id, label or vector, or with a null or non-finite component take no part; vectors
    of unlike length do not meet; vectors without components all score 0.  Rows that repeat an id are
    rows of their own, but not "other" rows to each other; repeated anchors repeat their results.
    Components and scores beyond a long count as the nearest long.  Ties are settled by id.  An empty
    table gives an empty one; other columns, whatever their names, are not looked at.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    named = embeddings.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
    )
    able = named.where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(
        F.coalesce(F.forall("x", finite), F.lit(False))
    )
    whole = F.transform("x", lambda x: F.floor(x * float(scale)))
    # The row number only deals rows to shards and tells repeated anchors apart.
    rows = stage_table(
        able.select(
            F.monotonically_increasing_id().alias("row"), "id", "label", F.size("x").alias("length"), whole.alias("x"),
            "is_anchor",
        ),
        "negative-rows",
    )
    asking = rows.where("is_anchor").select("row", "id", "label", "length", "x")
    everything = F.array(F.struct(
        F.lit(0).alias("place"), F.lit(None).cast("long").alias("positive_id"), F.lit(None).cast("long").alias("score"),
        F.lit(-_LONG).alias("low"), F.lit(_LONG - 1).alias("high"),
    ))
    same = _search(rows, asking.withColumn("windows", everything), ["length", "label"], True, positives, shard_values)
    nearest = _first(same, ["anchor_row"], positives)
    told = nearest.select(
        F.col("anchor_row").alias("row"), F.col("rank").alias("place"), F.col("found_id").alias("positive_id"),
        F.col("found_score").alias("score"),
    )
    low, high = (F.col("score").cast("decimal(20,0)") * p / 100 for p in (low_percent, high_percent))
    bounded = told.withColumns({"low": F.ceil(low), "high": F.floor(high)}).where("low <= high").select(
        "row", F.struct("place", "positive_id", "score", *(F.col(c).try_cast("long").alias(c) for c in ("low", "high"))).alias("w")
    )
    windows = stage_table(bounded.groupBy("row").agg(F.sort_array(F.collect_list("w")).alias("windows")), "negative-windows")
    other = _search(rows, asking.join(windows, "row"), ["length"], False, negatives, shard_values)
    return _first(other, ["anchor_row", "place"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score",
        F.col("found_score").alias("negative_score"),
    )


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = W.partitionBy(*keys).orderBy(F.desc("found_score"), "found_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _search(rows: DataFrame, asking: DataFrame, keys: list[str], same: bool, k: int, shard_values: int) -> DataFrame:
    """The firsts of each window in each shard of the rows that share ``keys`` with the anchor."""
    per_shard = F.greatest(F.lit(1), F.floor(F.lit(shard_values) / F.greatest(F.lit(1), F.col("length"))))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    counts = sizes.select(*keys, F.ceil(F.col("n") / per_shard).alias("shards"))
    no_windows = F.lit(None).cast(asking.schema["windows"].dataType)
    held = spread_join(rows.drop("is_anchor"), counts, keys, "row").select(
        *keys, F.pmod("row", "shards").alias("shard"), F.lit(0).alias("side"), "row", "id", "label", "x",
        no_windows.alias("windows"),
    )
    # Every anchor meets every shard of its keys: the stated set of questions against all rows, in blocks.
    passing = spread_join(asking, counts, keys, "row").select(
        *keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("side"),
        "row", "id", "label", "x", "windows",
    )
    columns = [*keys, "shard", "side", *(c for c in ("row", "id", "label", "x", "windows") if c not in keys)]
    met = held.select(*columns).union(passing.select(*columns))
    dealt = met.repartition(*keys, "shard").sortWithinPartitions(*keys, "shard", "side", "row")
    return dealt.mapInArrow(lambda batches: _answer(batches, keys, same, k), _FOUND)


# ---------------------------------------------------------------- inside a shard


@dataclass
class _Window:
    """Scores wanted between two bounds, and the best k met so far."""

    place: int
    positive_id: int | None
    score: int | None
    low: int
    high: int
    scores: list[int] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)

    def add(self, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
        inside = (scores >= self.low) & (scores <= self.high)
        if not inside.any():
            return
        pairs = [(-int(s), int(i)) for s, i in zip(*_largest(scores[inside], ids[inside], k), strict=True)]
        pairs = sorted(pairs + [(-s, i) for s, i in zip(self.scores, self.ids, strict=True)])[:k]
        self.scores, self.ids = [-s for s, _ in pairs], [i for _, i in pairs]

    def settled(self, threshold: int, k: int) -> bool:
        """No row that has not been met can be among the first k."""
        return threshold < self.low or len(self.scores) == k and threshold < self.scores[-1]


def _largest(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At least all rows that can be among the first k."""
    if len(scores) <= k:
        return scores, ids
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    high = scores > least
    level = np.flatnonzero(scores == least)
    level = level[np.argsort(ids[level], kind="stable")[: k]]
    take = np.concatenate([np.flatnonzero(high), level])
    return scores[take], ids[take]


class _Shard:
    """Rows of one shard with a sorted list for every dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.exact = ids, labels, x
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.take_along_axis(x.T, self.order.astype(np.int64), axis=1)
        self.reach = max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0
        self.float = x.astype(float), self.sorted.astype(float)

    def find(self, anchor: np.ndarray, anchor_id: int, label: str, windows: list[_Window], same: bool, k: int) -> None:
        """Read the lists from the anchor's side, deeper and deeper, until every window is settled."""
        n = len(self.ids)
        most = max((abs(int(v)) for v in (anchor.min(), anchor.max())), default=0) if anchor.size else 0
        if self.reach * most * len(anchor) < 1 << 53:  # whole numbers that doubles hold exactly
            (x, lists), a = self.float, anchor.astype(float)
        else:
            x, lists, a = self.exact.astype(object), self.sorted.astype(object), anchor.astype(object)
        able = ((self.labels == label) == same) & (self.ids != anchor_id)
        down, up = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met, depth, step, waiting = np.zeros(n, bool), 0, _FIRST_DEPTH, windows
        while waiting and depth < n:
            deeper = min(n, depth + step)
            reached = met.copy()
            if len(down) + len(up):
                reached[self.order[down, n - deeper : n - depth].ravel()] = True
                reached[self.order[up, depth:deeper].ravel()] = True
            else:  # every score is 0, in whatever order
                reached[depth:deeper] = True
            fresh = np.flatnonzero(reached & ~met & able)
            met, depth, step = reached, deeper, 2 * step
            if len(fresh):
                scores = x[fresh] @ a
                scores = np.array([max(-_LONG, min(_LONG - 1, s)) for s in scores], object) if x.dtype == object else scores.astype(np.int64)
                for window in waiting:
                    window.add(scores, self.ids[fresh], k)
            if met.all():
                break
            # A row not met stands deeper in every list.
            threshold = int((lists[down, n - deeper] * a[down]).sum() + (lists[up, deeper - 1] * a[up]).sum())
            threshold = max(-_LONG, min(_LONG - 1, threshold))
            waiting = [w for w in waiting if not w.settled(threshold, k)]


def _answer(batches: Iterator[pa.RecordBatch], keys: list[str], same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, those to be searched first, then the anchors."""
    now, parts, shard = None, [], None
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        cells = list(zip(*(columns[c].to_pylist() for c in (*keys, "shard")), strict=True))
        side, row, ids = (columns[c].to_numpy() for c in ("side", "row", "id"))
        labels = columns["label"].to_numpy(zero_copy_only=False)
        found: list[tuple] = []
        edges = [i for i in range(len(cells)) if i == 0 or cells[i] != cells[i - 1] or side[i] != side[i - 1]]
        for low, high in zip(edges, [*edges[1:], len(cells)], strict=True):
            if cells[low] != now:
                now, parts, shard = cells[low], [], None
            x = columns["x"].slice(low, high - low).flatten().to_numpy(zero_copy_only=False).reshape(high - low, -1)
            if side[low] == 0:
                parts.append((ids[low:high], labels[low:high], x))
                continue
            if shard is None:
                if not parts:
                    continue
                shard, parts = _Shard(*(np.concatenate(p) for p in zip(*parts, strict=True))), []
            asked = columns["windows"].slice(low, high - low).to_pylist()
            for i, wanted in enumerate(asked):
                windows = [_Window(w["place"], w["positive_id"], w["score"], w["low"], w["high"]) for w in wanted]
                shard.find(x[i], int(ids[low + i]), labels[low + i], windows, same, k)
                for w in windows:
                    head = (int(row[low + i]), int(ids[low + i]), w.place, w.positive_id, w.score)
                    found.extend((*head, other, score) for other, score in zip(w.ids, w.scores, strict=True))
        if found:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = [f.split()[0] for f in _FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(zip(*found, strict=True), kinds, strict=True)], names
            )
