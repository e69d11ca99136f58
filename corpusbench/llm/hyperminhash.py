"""Near-duplicates by banded HyperMinHash registers, verified on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbench.llm.common import (
    Powers, components, local_components, mix, prefix_sums, ranges_of, signed, span_hash, stage_table, text_blocks,
    without_nulls, word_bounds, word_hashes,
)
from corpusbench.operators.spread import spread_join

WORDS, PERCENT = 5, 85
REGISTERS = 640
COMPARED = 192  # registers an estimate is made from
MANTISSA = 20
BLOCK = 512
_MARGIN = 6.0  # standard deviations below the threshold at which an estimate still goes to verification
_COLUMNS = 4096


def near_duplicates(
    documents: DataFrame, *, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut into words; a document's set are its distinct shingles of
    ``words`` words, or all its words as one if it has fewer.  Documents are linked if 100 times the
    intersection is at least ``percent`` times the union; component_id is the smallest id reachable.

    1. Equal sets are linked to the smallest id that has them; only that one goes on.
    2. A shingle's hash picks a register; the register keeps the least remaining hash as its count of
       leading zeros and 20 bits behind them.  Empty registers borrow from others, so that two
       registers are equal as often as their sets are similar whatever the sets' sizes.  Bands of
       registers collide for similar sets: at a similarity of 0.85 all 64 bands of ten miss once in a
       million, at 0.8 all 80 bands of eight.
    3. Documents of one band value are tied to the smallest of them (a star, not all pairs); what is
       tied together is compared inside its group, in pairs of blocks of at most 512 documents where
       the group is larger.  An estimate from the registers, corrected for chance collisions, comes
       first; sets within six standard deviations are intersected in full.
    4. Each block reports its links as stars; stars are joined to components.

    Documents without words, or a null text, have no shingles and no links.  A null id links with
    nothing, has a null component and is kept.  Rows that share an id count as one document.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed_docs = docs.mapInArrow(
        lambda it: _sign(it, words, percent), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"
    )
    signs = stage_table(signed_docs, "shingle-signs")
    able = signs.where("doc_id IS NOT NULL AND n_shingles > 0")
    same = able.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = able.select("doc_id", "f1", "f2", "n_shingles").join(same, ["f1", "f2", "n_shingles"])
    equal = classes.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    reps = able.join(
        same.select("f1", "f2", "n_shingles", F.col("rep").alias("doc_id")), ["f1", "f2", "n_shingles", "doc_id"]
    ).select("doc_id", "bands")
    banded = reps.select("doc_id", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    tied = banded.join(leaders, "band").where("doc_id <> leader").select(
        F.col("doc_id").alias("a"), F.col("leader").alias("b")
    )
    groups = components(tied, "band-groups")
    members = stage_table(
        groups.union(groups.select(F.col("component").alias("id"), "component").distinct()), "band-members"
    )
    links = verified_links(docs, members, words, percent)
    linked = components(equal.union(links), "near-duplicates").withColumnRenamed("id", "doc_id")
    told = signs.select("doc_id", "n_shingles").join(linked, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return told.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def verified_links(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between the members (id, component) of each group, as stars: columns a and b."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    blocked = (
        spread_join(members, sizes, ["component"], "id")
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .select(
            F.col("id").alias("doc_id"), "component", "blocks",
            F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"),
        )
    )
    # Members grow with the documents: they are never broadcast, whatever their size here.
    sets = docs.join(blocked.hint("merge"), "doc_id").mapInArrow(
        lambda it: _sets(it, words),
        "doc_id long, component long, blocks int, block int, shingles binary, registers binary",
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = sets.withColumn("other", other).withColumns(
        {"i": F.least("block", "other"), "j": F.greatest("block", "other")}
    )
    keyed = paired.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    chosen = keyed.select("component", "i", "j", "block", "doc_id", "shingles", "registers")
    return chosen.mapInArrow(lambda it: _verify(it, percent), "a long, b long")


# ---------------------------------------------------------------- sets and registers


def band_rows(percent: int) -> int:
    """Registers in a band: fewer for lower thresholds, so that no threshold loses what is just above it."""
    return 10 if percent >= 85 else 8 if percent >= 78 else 5


def shingle_sets(
    raw: np.ndarray, offsets: np.ndarray, words: int, powers: Powers
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the number of them before each text."""
    lowered = raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))
    starts, ends, bounds = word_bounds(lowered, offsets)
    sums = prefix_sums(word_hashes(lowered, starts, ends), powers)
    counts = np.diff(bounds)
    shingles = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    at = ranges_of(bounds[:-1], shingles)
    owner = np.repeat(np.arange(len(counts)), shingles)
    value = span_hash(sums, at, at + np.minimum(counts[owner], words), powers)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))


def registers_of(value: np.ndarray, before: np.ndarray, registers: int) -> np.ndarray:
    """A row of registers for each set: 0 if empty, else leading zeros + 1 and the bits behind the first one."""
    rows = len(before) - 1
    owner = np.repeat(np.arange(rows), np.diff(before))
    picked = (mix(value ^ np.uint64(0x5BF0_3635_16A1_D2C9)) % np.uint64(registers)).astype(np.int64)
    rest = mix(value + np.uint64(0x9E37_79B9_7F4A_7C15))
    least = np.full(rows * registers, np.iinfo(np.uint64).max, np.uint64)
    filled = np.zeros(rows * registers, bool)
    at = owner * registers + picked
    np.minimum.at(least, at, rest)
    filled[at] = True
    least = least[filled]
    _, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))
    zeros = (53 - exponent).astype(np.uint64)
    behind = (least << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    code = np.zeros(rows * registers, np.uint32)
    code[filled] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | behind
    return code.reshape(rows, registers)


def densified(registers: np.ndarray) -> np.ndarray:
    """Registers of sets that are not empty, with every empty one filled from another one.

    An empty register looks at others in an order of its own, the same for all sets, and takes the
    first that is filled; after 256 looks, the next filled one to its right.
    """
    rows, count = registers.shape
    out = registers.copy()
    row, place = np.nonzero(registers == 0)
    for look in range(256):
        if not len(row):
            return out
        order = mix(np.arange(count, dtype=np.uint64) + np.uint64((look + 1) * 1_000_003))
        donor = (order % np.uint64(count)).astype(np.int64)[place]
        found = registers[row, donor]
        out[row, place] = found
        row, place = row[found == 0], place[found == 0]
    for r in np.unique(row):
        own = np.flatnonzero(registers[r])
        gaps = place[row == r]
        out[r, gaps] = registers[r, own[np.searchsorted(own, gaps) % len(own)]]
    return out


def estimate(
    left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Similarities from equal registers, less the matches that chance alone would give, and how many registers tell."""
    equal = np.zeros((len(left), len(right)), np.int32)
    either = np.zeros_like(equal)
    for k in range(left.shape[1]):
        a, b = left[:, k, None], right[None, :, k]
        either += (a | b) != 0
        equal += (a == b) & (a != 0)
    n, m = n_left[:, None].astype(float), n_right[None, :].astype(float)
    by_chance = 0.68 * 2.0**-MANTISSA * n * m / (n + m) ** 2
    told = np.maximum(either, 1)
    return (equal - either * by_chance) / told, told


def _sign(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    powers, in_band = Powers(), band_rows(percent)
    in_all = REGISTERS // in_band
    for batch in batches:
        ids = batch.column(0)
        for first, raw, offsets in text_blocks(without_nulls(batch, "text")):
            rows = len(offsets) - 1
            value, before = shingle_sets(raw, offsets, words, powers)
            n = np.diff(before)
            marks = []
            for salt in (0x1234_5678_9ABC_DEF1, 0x0FED_CBA9_8765_4321):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ np.uint64(salt)))])
                marks.append(sums[before[1:]] - sums[before[:-1]])
            # A set of fewer than percent / (100 - percent) shingles can only equal another: it needs no band.
            able = np.flatnonzero(n * (100 - percent) >= np.maximum(percent, 1))
            part = ranges_of(before[able], n[able])
            bounds = np.concatenate([[0], np.cumsum(n[able])])
            bands = densified(registers_of(value[part], bounds, REGISTERS)).reshape(len(able), in_all, in_band)
            bands = bands.astype(np.uint64)
            key = np.zeros((len(able), in_all), np.uint64)
            for k in range(in_band):
                key = mix(key * np.uint64(31) + bands[:, :, k] + np.uint64(1))
            key = mix(key + np.arange(in_all, dtype=np.uint64))
            sizes = np.zeros(rows, np.int32)
            sizes[able] = in_all
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(signed(key.ravel()))
            )
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, rows), pa.array(n.astype(np.int64)), *(pa.array(signed(m)) for m in marks), lists],
                ["doc_id", "n_shingles", "f1", "f2", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        names = ["doc_id", "component", "blocks", "block"]
        kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
        for first, raw, offsets in text_blocks(without_nulls(batch, "text")):
            rows = len(offsets) - 1
            value, before = shingle_sets(raw, offsets, words, powers)
            registers = registers_of(value, before, COMPARED)
            data = value.tobytes()
            sets = [data[8 * a : 8 * b] for a, b in zip(before[:-1], before[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.slice(first, rows) for c in kept), pa.array(sets, pa.binary()),
                    pa.array([r.tobytes() for r in registers], pa.binary()),
                ],
                [*names, "shingles", "registers"],
            )


# ---------------------------------------------------------------- verification


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links inside each (component, i, j), which come one after the other."""
    held: list[tuple] = []
    now = None
    out: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def flush() -> pa.RecordBatch:
        nonlocal out, waiting
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        out, waiting = [], 0
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def settle() -> None:
        nonlocal waiting
        if len(held) > 1:
            a, b = links_of(held, now[1] != now[2], percent)
            if len(a):
                out.append((a, b))
                waiting += len(a)

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(7)]
        for component, i, j, *row in zip(*columns, strict=True):
            if (component, i, j) != now:
                settle()
                held, now = [], (component, i, j)
            held.append(row)
        if waiting:
            yield flush()
    settle()
    if waiting:
        yield flush()


def links_of(rows: list[tuple], across: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links among rows (block, id, shingles, registers), only between blocks if ``across``."""
    blocks = np.array([r[0] for r in rows])
    ids = np.array([r[1] for r in rows], np.int64)
    registers = np.stack([np.frombuffer(r[3], np.uint32) for r in rows])
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    share = percent / 100
    similar, told = estimate(registers, registers, sizes, sizes)
    likely = similar >= share - _MARGIN * (share * (1 - share) / told) ** 0.5
    likely &= (blocks[:, None] != blocks[None, :]) if across else True
    likely &= 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
    np.fill_diagonal(likely, False)
    at = np.flatnonzero(likely.any(axis=0))
    if not len(at):
        return ids[:0], ids[:0]
    shared = intersections([sets[k] for k in at])
    union = sizes[at][:, None] + sizes[at][None, :] - shared
    linked = likely[np.ix_(at, at)] & (100 * shared >= percent * union)
    left, right = np.nonzero(np.triu(linked, 1))
    order = np.argsort(ids[at], kind="stable")  # the least index of a component is then its least id
    rank = np.empty(len(at), np.int64)
    rank[order] = np.arange(len(at))
    label = local_components(len(at), rank[left], rank[right])
    sorted_ids = ids[at][order]
    moved = np.flatnonzero(label != np.arange(len(at)))
    return sorted_ids[moved], sorted_ids[label[moved]]


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of membership matrices over the shingles that several sets hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = counts > 1
    place = np.cumsum(several) - 1
    kept = several[column]
    owner, column = owner[kept], place[column[kept]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(several.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        member = np.zeros((len(sets), min(_COLUMNS, int(several.sum()) - low)), np.float32)
        member[owner[a:b], column[a:b] - low] = 1
        total += member @ member.T
    return np.rint(total).astype(np.int64)
