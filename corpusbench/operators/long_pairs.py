"""Alignment of pairs too long for one task: the distance table in tiles, one anti-diagonal of tiles after the other.

A tile is ``tile`` rows by ``tile`` columns of the table, of which only the diagonals that a good alignment can
touch are computed.  What it needs of the rest are the steps along
its upper and left border, a few bits a cell; what it gives are the steps along its lower and right
one.  All tiles of one anti-diagonal, of all pairs, are computed at once; the borders are written to the
shared folder, so a lost executor costs its tiles only.  Then each pair is walked back from its end,
through the few tiles that its best alignment crosses.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusbench.functions.alignment import cost_bound, edit_counts
from corpusbench.operators.spread import compute_partitions, spread_small
from corpusbench.session import written_once

TILE = 1 << 14
_COUNTS = "key string, s long, d long, i long, cost long"
_BORDERS = ("left", "top", "right", "bottom")


def align_long(pairs: DataFrame, *, key: str, reference: str, hypothesis: str, tile: int = TILE) -> DataFrame:
    """``key``, s, d, i, n of every pair: the counts that ``alignment.align`` gives, from many tasks a pair.

    ``reference`` and ``hypothesis`` are texts, aligned by character, or arrays of tokens; ``key`` is a
    string that tells pairs apart.  A pair of which a side or the key is null gives null counts.

    Only diagonals near the first are computed, in tiles and within them: those that an alignment of a bounded
    cost can touch (``alignment.first_bounds``).  If the one found costs no more, all that could be better was
    looked at; a pair of which it costs more would be done again at the cost found.

    One task holds the two texts of a pair and the columns of one tile (tile^2 / 2 bytes) at a time.
    A pair of one tile, or of which the diagonals have no more cells than one by a first guess from the
    lengths, has no borders to hand on: such pairs are aligned many at a time in one task.
    Rows are told apart by a number of their own, so keys may repeat.
    """
    named = pairs.select(
        F.monotonically_increasing_id().cast("string").alias("key"),
        F.col(key).alias("name"), F.col(reference).alias("r"), F.col(hypothesis).alias("h"),
    )
    sides = written_once(named, "long-pairs")
    length = F.size if isinstance(sides.schema["r"].dataType, T.ArrayType) else F.length
    n, m = (length(c).cast("long") for c in "rh")
    known = F.col("name").isNotNull() & F.col("r").isNotNull() & F.col("h").isNotNull()
    guess = F.abs(n - m) + F.floor(F.greatest(n, m) / 5) + 16
    one_tile = (F.greatest(n, m) <= tile) | (guess * m <= tile * tile)
    short = spread_small(sides.where(known & one_tile))
    counted = short.select("name", edit_counts(F.col("r"), F.col("h")).alias("e")).select("name", "e.*")
    unknown = sides.where(~known).select("name", *(F.lit(None).cast("long").alias(c) for c in "sdin"))
    found = counted.union(unknown).withColumnRenamed("name", key)
    long = sides.where(known & ~one_tile).repartition(compute_partitions(pairs.sparkSession))
    # one diagonal more on either side, through which tiles of equal texts hand on to the next
    bound = F.greatest(cost_bound("r", "h"), F.abs(n - m) + 2)
    sized = long.select("key", "name", "r", "h", n.alias("n"), m.alias("m"), bound.alias("bound"))
    many = written_once(sized, "long-many")
    todo = many.select("key", "n", "m", "bound")
    if todo.isEmpty():
        return found
    pieces = {c: written_once(_pieces(many, c, tile), f"long-{c}") for c in "rh"}
    names = many.select("key", F.col("name").alias(key))
    while not todo.isEmpty():
        tried = written_once(_counted(todo, pieces, tile), "long-counts").join(todo, "key")
        fits = F.col("cost") <= F.col("bound")
        found = found.union(_named(tried.where(fits).select("key", "s", "d", "i", "n"), names, key))
        todo = written_once(tried.where(~fits).select("key", "n", "m", F.col("cost").alias("bound")), "long-again")
    return found


def _named(told: DataFrame, names: DataFrame, key: str) -> DataFrame:
    own = names.select(F.col("key").alias("_row"), F.col(key).alias("_name"))
    return told.join(own, F.col("key") == F.col("_row")).select(F.col("_name").alias(key), "s", "d", "i", "n")


def _pieces(sides: DataFrame, side: str, tile: int) -> DataFrame:
    """Tokens of one tile's rows or columns each."""
    whole, at = F.col(side), F.col("piece")
    if isinstance(sides.schema[side].dataType, T.ArrayType):
        size, part = F.size(whole), F.slice(whole, (at * tile + 1).cast("int"), tile)
    else:
        size, part = F.length(whole), F.substring(whole, (at * tile + 1).cast("int"), F.lit(tile))
    last = F.greatest(F.lit(1), F.ceil(size / tile)) - 1
    return sides.select("key", side, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select("key", "piece", part.alias(side))


def _counted(todo: DataFrame, pieces: dict[str, DataFrame], tile: int) -> DataFrame:
    """Counts of a best way through the diagonals of each pair's bound, and its cost."""
    size = ["n", "m", "bound"]
    parts = compute_partitions(todo.sparkSession)
    at, tokens = ["key", *size, "a", "b"], pieces["r"].schema["r"].dataType
    nothing = {**{c: "binary" for c in _BORDERS}, "r": tokens, "h": tokens, **{c: "long" for c in size}}
    schema = T.StructType([T.StructField("key", T.StringType()), *(T.StructField(c, T.LongType()) for c in (*size, "a", "b"))])
    for border in _BORDERS:
        schema = schema.add(border, T.BinaryType())
    met = (*at, "left", "top", "r", "h")

    def rows(df: DataFrame, **columns: Column | str) -> DataFrame:
        """What a tile is made of, each row a part of it."""
        own = {c: F.col(x) if isinstance(x, str) else x for c, x in columns.items()}
        return df.select(*(own.get(c, F.lit(None).cast(nothing.get(c, "string"))).alias(c) for c in met))

    ends = (F.ceil(F.greatest(F.lit(1), F.col(c)) / tile) for c in "nm")
    apart = F.col("n") - F.col("m")
    above, below = F.floor((F.col("bound") + apart) / 2), F.floor((F.col("bound") - apart) / 2)
    pairs, last, down, across = todo.agg(
        F.count("*"), F.max(sum(ends)), F.ceil(F.max(above) / tile) + 1, F.ceil(F.max(below) / tile) + 1
    ).first()
    same = {c: c for c in ("key", *size)}
    waves = []
    for number in range((last or 0) - 1):
        if number:
            done = waves[-1]
            sent = [rows(done, **same, a="a", b=F.col("b") + 1, left="right"), rows(done, **same, a=F.col("a") + 1, b="b", top="bottom")]
        else:
            sent = [rows(todo, **same, a=F.lit(0).cast("long"), b=F.lit(0).cast("long"))]
        # rows of the tiles that the band of their pair reaches
        a, b = F.col("a"), F.col("b")
        inside = (a * tile < F.col("n")) & (b * tile < F.col("m")) & (a * tile < (b + 1) * tile + above) & ((a + 1) * tile > b * tile - below)
        whole = reduce(DataFrame.union, (x.where(inside) for x in sent))
        # a piece of either text meets one tile of a wave
        own = {
            "r": (F.col("piece"), F.lit(number) - F.col("piece"), down, across),
            "h": (F.lit(number) - F.col("piece"), F.col("piece"), across, down),
        }
        for side, (a, b, most, least) in own.items():
            near = F.col("piece").between(max(0, (number - least) // 2), (number + most) // 2 + 1) & (F.col("piece") <= number)
            whole = whole.union(rows(pieces[side].where(near), key="key", a=a, b=b, **{side: side}))
        tiles = pairs * min(number + 1, down + across)  # at most
        dealt = whole.repartition(min(parts, tiles), "key", "a", "b").sortWithinPartitions("key", "a", "b")
        done = dealt.mapInArrow(lambda batches: _crossed(batches, tile, schema.names), schema)
        waves.append(written_once(done, f"long-wave{number}"))
    read = [_row(f"{k}", pieces[k].join(todo.select("key"), "key", "left_semi"), k) for k in "rh"]
    for done in waves:
        of_wave = done.select(
            "key", F.lit("tile").alias("kind"), (-F.col("a") - F.col("b")).alias("turn"), "a", "b", "bound", "left", "top",
            F.lit(None).cast(tokens).alias("tokens"),
        )
        read.append(of_wave)
    # Texts come before tiles, tiles from the end of the pair: the walk meets them in its order.
    dealt = reduce(DataFrame.union, read).repartition(min(parts, pairs), "key").sortWithinPartitions("key", "kind", "turn", "a")
    return dealt.mapInArrow(lambda batches: _walked(batches, tile), _COUNTS)


def _row(kind: str, pieces: DataFrame, side: str) -> DataFrame:
    order: Column = F.col("piece")
    none = F.lit(None).cast("binary")
    return pieces.select(
        "key", F.lit(f"a {kind}").alias("kind"), order.alias("turn"), order.alias("a"), F.lit(0).cast("long").alias("b"),
        F.lit(None).cast("long").alias("bound"), none.alias("left"), none.alias("top"), F.col(side).alias("tokens"),
    )


# ---------------------------------------------------------------- tiles


def _steps(border: bytes | None, size: int) -> tuple[int, int]:
    """Steps up and steps down along a border, as bits; beyond the band every step is up."""
    if border is None:
        return (1 << size) - 1, 0
    half = len(border) // 2
    return int.from_bytes(border[:half], "little"), int.from_bytes(border[half:], "little")


def _border(up: int, down: int, size: int) -> bytes:
    length = -(-size // 8)
    return up.to_bytes(length, "little") + down.to_bytes(length, "little")


def _blocks(a: int, b: int, n: int, m: int, bound: int, tile: int) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of a tile's columns, and the rows of it that hold the diagonals of ``bound`` there; the same in all tiles of a column."""
    above, below = (bound + n - m) // 2, (bound - n + m) // 2
    top, first, end = a * tile, b * tile, min(m, (b + 1) * tile)
    size = max(64, (above + below) // 8)
    for start in range(first, end, size):
        stop = min(start + size, end)
        low, high = max(0, start - below - top), min(n - top, tile, stop + above - top)
        if low < high:
            yield start - first, stop - first, low, high


def _places(ref: Sequence, hyp: Sequence) -> dict:
    """Rows of each token of ``hyp``, as bits."""
    where = {token: bytearray(-(-len(ref) // 8)) for token in set(hyp)}
    for index, token in enumerate(ref):
        if (bits := where.get(token)) is not None:
            bits[index >> 3] |= 1 << (index & 7)
    return {token: int.from_bytes(bits, "little") for token, bits in where.items()}


def _columns(
    ref: Sequence, hyp: Sequence, left: bytes | None, top: bytes | None, blocks: Iterator[tuple[int, int, int, int]]
) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """Per column: cells equal to their diagonal neighbour, vertical steps up and down, the step along the last row, and which rows these are.

    Rows that a stretch has no longer are taken to go up from its first column on, rows that come with it
    from the last one it had: never less than the distance, and the distance wherever an alignment within
    the bound goes.
    """
    rows = len(ref)
    where = _places(ref, hyp)
    plus, minus = _steps(left, rows)
    above_up, above_down = _steps(top, len(hyp))
    held = 0, rows
    for start, stop, low, high in blocks:
        high = min(high, rows)
        if low >= high or start >= len(hyp):
            return
        full, last = (1 << high - low) - 1, high - low - 1
        known = min(held[1], high)
        plus = (plus >> low - held[0] | -1 << known - low) & full
        minus = (minus >> low - held[0]) & full
        held = low, high
        near = {token: (where[token] >> low) & full for token in set(hyp[start:stop])}
        for column in range(start, min(stop, len(hyp))):
            up, down = (above_up >> column & 1, above_down >> column & 1) if not low else (1, 0)
            match = near[hyp[column]] | 1 if down else near[hyp[column]]
            equal = ((((match & plus) + plus) ^ plus) | match | minus) & full
            right_up = minus | (full ^ (equal | plus))
            right_down = plus & equal
            step = (right_up >> last) - (right_down >> last)
            right_up = right_up << 1 | up
            right_down = right_down << 1 | down
            minus = right_up & equal
            plus = (right_down | ~(equal | right_up)) & full
            yield equal, plus, minus, step, column, low, high


def _crossed(batches: Iterator[pa.RecordBatch], tile: int, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Tiles, made of the rows that tell of them, with the steps along their right and lower border."""
    schema = pa.schema([(c, _kind(c)) for c in names])
    one: dict = {}
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if any(one.get(c) != row[c] for c in ("key", "a", "b")):
                done += _with_borders(one, tile)
                one = row
            else:
                one |= {c: x for c, x in row.items() if x is not None}
        if done:
            yield pa.RecordBatch.from_pylist([{c: x[c] for c in names} for x in done], schema=schema)
    if done := _with_borders(one, tile):
        yield pa.RecordBatch.from_pylist([{c: x[c] for c in names} for x in done], schema=schema)


def _with_borders(one: dict, tile: int) -> list[dict]:
    """Nothing of a piece whose tile no band reaches."""
    if one.get("bound") is None:
        return []
    ref, hyp = one["r"], one["h"]
    plus, minus = _steps(None, len(ref))
    up, down = ((1 << len(hyp)) - 1).to_bytes(-(-len(hyp) // 8), "little"), bytes(-(-len(hyp) // 8))
    up, down = bytearray(up), bytearray(down)
    now = None
    for now in _columns(ref, hyp, one["left"], one["top"], _blocks(*(one[c] for c in ("a", "b", "n", "m", "bound")), tile)):
        _, _, _, step, column, _, high = now
        if high == len(ref) and step <= 0:
            up[column >> 3] &= ~(1 << (column & 7))
            if step < 0:
                down[column >> 3] |= 1 << (column & 7)
    if now is not None:
        _, own, fewer, _, _, low, high = now
        plus = (plus >> high << high) | (own << low) | (1 << low) - 1
        minus = fewer << low
    return [one | {"right": _border(plus, minus, len(ref)), "bottom": bytes(up + down)}]


def _kind(name: str) -> pa.DataType:
    return pa.string() if name == "key" else pa.binary() if name in _BORDERS else pa.int64()


def _walked(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """Each pair from its end to its beginning; tiles that the way does not cross go by."""
    now: _Walk | None = None
    for batch in batches:
        done = []
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for key, kind, _, a, b, bound, left, top, tokens in zip(*columns, strict=True):
            if now is None or key.as_py() != now.key:
                if now is not None:
                    done.append(now.told())
                now = _Walk(key.as_py(), tile)
            if kind.as_py() != "tile":
                now.texts[kind.as_py()[-1]].append(tokens.as_py())
            elif now.at() == (a.as_py(), b.as_py()):
                now.cross(bound.as_py(), left.as_py(), top.as_py())
        if done:
            yield _batch(done)
    if now is not None:
        yield _batch([now.told()])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] + [pa.int64()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "s", "d", "i", "cost"]
    )


class _Walk:
    """Where the way back through one pair has come."""

    def __init__(self, key: str, tile: int):
        self.key, self.tile = key, tile
        self.texts: dict[str, list] = {"r": [], "h": []}
        self.size: tuple[int, int] | None = None
        self.place: tuple[int, int] | None = None
        self.counts = [0, 0, 0]
        self.bound = 0
        self.lost = False

    def at(self) -> tuple[int, int]:
        """The tile of the cell that comes next; none is asked for after the way has left its diagonals."""
        if self.place is None:
            self.size = self.place = tuple(sum(map(len, self.texts[k])) for k in "rh")
        return (-1, -1) if self.lost else tuple(max(x - 1, 0) // self.tile for x in self.place)

    def cross(self, bound: int, left: bytes | None, top: bytes | None) -> None:
        self.bound = bound
        a, b = self.at()
        row, column = self.place[0] - a * self.tile, self.place[1] - b * self.tile
        if not row or not column:
            return
        ref, hyp = self.texts["r"][a][:row], self.texts["h"][b][:column]
        kept = {
            column: (equal.to_bytes(-(-(high - low) // 8), "little"), plus.to_bytes(-(-(high - low) // 8), "little"), low, high)
            for equal, plus, _, _, column, low, high in _columns(ref, hyp, left, top, _blocks(a, b, *self.size, bound, self.tile))
        }
        s = d = i = 0
        while row and column:
            if ref[row - 1] == hyp[column - 1]:
                row, column = row - 1, column - 1
                continue
            equal, plus, low, high = kept.get(column - 1, (b"", b"", 0, 0))
            if not low < row <= high:
                self.lost = True
                break
            at, bit = row - 1 - low >> 3, row - 1 - low & 7
            if not equal[at] >> bit & 1:
                s, row, column = s + 1, row - 1, column - 1
            elif plus[at] >> bit & 1:
                d, row = d + 1, row - 1
            else:
                i, column = i + 1, column - 1
        self.counts = [x + y for x, y in zip(self.counts, (s, d, i), strict=True)]
        self.place = row + a * self.tile, column + b * self.tile

    def told(self) -> tuple:
        """A way that has left its diagonals asks for twice as many."""
        self.at()
        row, column = self.place
        s, d, i = self.counts
        if row and column:
            return self.key, s, d, i, 2 * self.bound + 1
        return self.key, s, d + row, i + column, s + d + row + i + column
