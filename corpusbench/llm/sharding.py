"""Sharding by a k-d tree over metadata: weighted medians along the widest dimension, level by level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusbench.llm.common import gapless_rank, small_table, stage_table

BUCKETS = 1024
_SPAN = 1 << 20  # places along a dimension


@dataclass
class _Node:
    """A box of the tree: its shards, bytes, and the dimension and place of its cut."""

    number: int
    first: int
    shards: int
    size: int = 0
    rows: int = 0
    axis: int = 0
    cut: tuple | None = None  # the last (place, tie, id) of the left side


def kd_shards(
    documents: DataFrame, *, shards: int | None = None, target_bytes: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Documents dealt to shards of nearly equal bytes, near ones in metadata together.

    Columns: doc_id, size, text_crc32, shard, slot.  A document's size is its UTF-8 bytes plus 1.
    Give ``shards``, or ``target_bytes`` for as many as keep a shard near that size.  Dimensions are
    source, lang (by checksum), length and id, each scaled to its whole range; a box is cut along the
    widest one at the place where its left shards' share of bytes lies, ties being ordered by a hash
    of the row and then by id, so that a value that a third of all rows share is cut as well.

    Texts are read once, to a narrow staged table.  A cut is found by sums over ever narrower buckets;
    only a few numbers for each box reach the driver.  Null texts have size 1 and checksum 0, null
    metadata counts as the empty string or 0, repeated rows are interchangeable, and an empty table
    gives no shards.
    """
    narrow = stage_table(_narrow(documents, id_col, text_col), "shard-metadata")
    totals = narrow.agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"),
        *(F.min(c).alias(f"low_{c}") for c in _AXES), *(F.max(c).alias(f"high_{c}") for c in _AXES),
    ).first()
    if not totals.n:
        return narrow.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    if shards is None:
        if target_bytes is None:
            raise ValueError("give the number of shards or their target bytes")
        shards = max(1, -(-totals.size // target_bytes))
    placed = narrow.select(
        "doc_id", "size", "text_crc32", "tie",
        F.array(*(_scaled(c, totals[f"low_{c}"], totals[f"high_{c}"]) for c in _AXES)).alias("point"),
    )
    placed = stage_table(placed.withColumn("node", F.lit(0)), "shard-points")
    nodes = [_Node(0, 0, shards, totals.size, totals.n)]
    while any(node.shards > 1 for node in nodes):
        nodes, placed = _split(nodes, placed)
        placed = stage_table(placed, "shard-level")
    first = {node.number: node.first for node in nodes}
    sharded = stage_table(
        placed.select("doc_id", "size", "text_crc32", _lookup(placed, first, "node").alias("shard")), "shards"
    )
    return gapless_rank(sharded, ["shard"], ["doc_id", "size", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", "shard", "slot"
    )


_AXES = ("source", "lang", "length", "id")


def _narrow(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    have = set(documents.columns)
    code = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) if c in have else F.lit(0)
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    number = F.col(id_col).cast("long")
    return documents.select(
        number.alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(number, text).alias("tie"), code("source").cast("double").alias("source"),
        code("lang").cast("double").alias("lang"), F.log(size.cast("double")).alias("length"),
        F.coalesce(number, F.lit(0)).cast("double").alias("id"),
    )


def _scaled(axis: str, low: float, high: float) -> Column:
    if high <= low:
        return F.lit(0).cast("long")
    return F.floor((F.col(axis) - F.lit(low)) / F.lit(high - low) * (_SPAN - 1)).cast("long")


def _lookup(df: DataFrame, values: dict[int, int], key: str) -> Column:
    """A small map from box to number; there are at most as many boxes as shards."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.element_at(F.create_map(*pairs), F.col(key))


def _split(nodes: list[_Node], placed: DataFrame) -> tuple[list[_Node], DataFrame]:
    """Cut every box that still holds several shards."""
    spark = placed.sparkSession
    open_nodes = {node.number: node for node in nodes if node.shards > 1}
    widths = placed.where(F.col("node").isin(list(open_nodes))).groupBy("node").agg(
        *(F.min(F.col("point")[k]).alias(f"low{k}") for k in range(len(_AXES))),
        *(F.max(F.col("point")[k]).alias(f"high{k}") for k in range(len(_AXES))),
    )
    # Search state of each box: the interval of keys that holds the cut, and the bytes before it.
    state = {}
    for r in widths.collect():
        node = open_nodes[r.node]
        node.axis = max(range(len(_AXES)), key=lambda k: (r[f"high{k}"] - r[f"low{k}"], -k))
        aim = node.size * (node.shards // 2) / node.shards
        state[r.node] = (node.axis, "place", r[f"low{node.axis}"], r[f"high{node.axis}"], None, aim)
    while state:
        state = _narrower(spark, placed, state, open_nodes)
    cuts = small_table(
        spark, [(n.number, n.axis, *n.cut) for n in open_nodes.values()],
        "node int, axis int, cut_place long, cut_tie long, cut_id long",
    )
    key = F.struct(F.element_at("point", F.col("axis") + 1), F.col("tie"), F.coalesce("doc_id", F.lit(_LAST)))
    cut = F.struct("cut_place", "cut_tie", "cut_id")
    moved = placed.join(F.broadcast(cuts), "node", "left").select(  # one row for each box
        "doc_id", "size", "text_crc32", "tie", "point",
        F.when(F.col("axis").isNull(), F.col("node") * 2).otherwise(F.col("node") * 2 + (key > cut).cast("int")).alias("node"),
    )
    sums = {r.node: r for r in moved.groupBy("node").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for node in nodes:
        left = node.shards // 2
        parts = [(0, node.first, node.shards)] if node.shards == 1 else [
            (0, node.first, left), (1, node.first + left, node.shards - left)
        ]
        for side, first, count in parts:
            r = sums.get(node.number * 2 + side)
            out.append(_Node(node.number * 2 + side, first, count, r.size if r else 0, r.n if r else 0))
    return [n for n in out if n.shards == 1 or n.rows], moved


_FIRST, _LAST = -(1 << 63), (1 << 63) - 1


def _narrower(spark, placed: DataFrame, state: dict, open_nodes: dict) -> dict:
    """One pass: sum bytes by bucket of the interval of each box and keep the bucket that holds the cut.

    The key of a row is (place, tie, id): first the place is narrowed to one value, then the tie.
    """
    rows = [(n, axis, stage == "tie", int(low), int(high), place) for n, (axis, stage, low, high, place, _) in state.items()]
    steps = small_table(spark, rows, "node int, axis int, by_tie boolean, low long, high long, place long")
    at = F.element_at("point", F.col("axis") + 1)
    inside = placed.join(F.broadcast(steps), "node")  # one row for each box
    value = F.when(F.col("by_tie"), F.col("tie")).otherwise(at)
    chosen = inside.where((~F.col("by_tie")) | (at == F.col("place"))).withColumn("value", value)
    # Halves keep the difference of two 64-bit numbers inside 64 bits.
    width = F.greatest(F.lit(1), F.floor((F.col("high") / 2 - F.col("low") / 2) / (BUCKETS / 2)).cast("long") + 1)
    offset = F.floor(F.col("value").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)"))
    bucket = F.floor(offset / width).cast("long")
    sums = (
        chosen.where("value BETWEEN low AND high")
        .groupBy("node", bucket.alias("bucket"))
        .agg(
            F.sum("size").alias("size"), F.min("value").alias("low"), F.max("value").alias("high"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    order = W.partitionBy("node").orderBy("bucket")
    aims = small_table(spark, [(n, float(s[5])) for n, s in state.items()], "node int, aim double")
    running = sums.withColumn("after", F.sum("size").over(order)).join(F.broadcast(aims), "node")
    # The first bucket that reaches the aim, or the last one.
    misses = (F.col("after") < F.col("aim")).cast("int")
    nearest = F.when(misses == 0, F.col("bucket")).otherwise(-F.col("bucket"))
    first = F.row_number().over(W.partitionBy("node").orderBy(misses, nearest))
    out = {}
    for r in running.withColumn("k", first).where("k = 1").collect():
        axis, stage, _, _, place, aim = state[r.node]
        aim -= r.after - r.size
        if r.low < r.high:
            out[r.node] = (axis, stage, r.low, r.high, place, aim)
        elif stage == "place" and r.n > 1:
            out[r.node] = (axis, "tie", _FIRST, _LAST, r.low, aim)
        else:
            # One key is left: it goes to the side that it leaves nearer to its share.
            key = (r.low, _FIRST) if stage == "place" else (place, r.low)
            open_nodes[r.node].cut = (*key, _FIRST) if r.size > 2 * aim else (*_last_of(key, stage), _LAST)
    return out


def _last_of(key: tuple[int, int], stage: str) -> tuple[int, int]:
    return (key[0], _LAST) if stage == "place" else key
