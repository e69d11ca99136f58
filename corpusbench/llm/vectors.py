"""Near-duplicate embeddings: spherical k-means cells, blocked cosines inside cells, components of the links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbench.llm.common import components, local_components, mix, stage_table

THRESHOLD = 0.95
SAMPLE, CELL, MAX_CELLS, BLOCK = 20_000, 400, 1024, 2048
_SENT = "cell int, block int, side int, length int, ids binary, m binary, v binary"


def near_vectors(
    embeddings: DataFrame, threshold: float = THRESHOLD, *, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors whose cosine is at least ``threshold`` in double precision are linked; none is missed.

    1. Equal vectors are one, with their number.
    2. Centroids are fitted to a sample of at most SAMPLE vectors by hash of the id; every vector gets
       the cell of its nearest centroid.
    3. A vector is compared with its own cell and with every cell that can hold a partner.  A partner
       lies within the threshold's angle of it and is nearer to the other centroid: both can be only if
       the vector's distance from the border between the cells is at most that angle.  Of two cells one
       is sent to the other, so each pair meets once and counts for both.
    4. A cell's vectors are dealt to blocks of about BLOCK; others stream past each block, packed by the
       task that sends them.  A block reports numbers of links and a forest of them, never all pairs.

    A vector that is null, zero, or holds null or non-finite components links with nothing, as does one
    with a null id (its component is null).  Rows that repeat an id are vectors of their own in one
    component; an empty table gives an empty one.  Vectors of different lengths are never linked.  Other
    columns are not looked at, whatever their names.
    """
    vectors = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = (
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(F.forall("v", finite), F.lit(False))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    able = stage_table(vectors.where(usable), "usable-vectors")
    distinct = stage_table(
        able.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("m")), "distinct-vectors"
    )
    cells = _Cells(fit(distinct), threshold)
    placed = stage_table(distinct.mapInArrow(cells.place, f"{_schema(distinct)}, home int"), "placed-vectors")
    sizes = placed.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()  # at most a few thousand cells
    cells.blocks = {r.home: -(-r.n // BLOCK) for r in sizes}
    sent = placed.mapInArrow(cells.send, _SENT)
    keyed = sent.repartition("cell", "block").sortWithinPartitions("cell", "block", "side")
    found = stage_table(keyed.mapInArrow(lambda it: _compare(it, threshold), "a long, b long, n long"), "vector-links")

    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    members = able.join(distinct.select("v", "id", "m"), "v").select("vec_id", "id", "m")
    equal = members.where("vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    linked = components(found.where("b IS NOT NULL").select("a", "b").union(equal), "near-vectors")
    told = members.join(counts, "id", "left").select(
        "vec_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links")
    )
    rest = vectors.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    joined = told.union(rest).join(linked.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id", "n_links", component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


# ---------------------------------------------------------------- cells


def fit(distinct: DataFrame) -> dict[int, np.ndarray]:
    """Unit centroids by vector length, from a sample of at most SAMPLE vectors chosen by hash of the id."""
    total = distinct.count()
    rows = distinct.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    cells = min(MAX_CELLS, max(1, total // CELL))
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r.v), []).append(r.v)
    return {
        length: spherical_means(unit(np.array(v, float)), max(1, cells * len(v) // len(rows)))
        for length, v in by_length.items()
    }


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; each is first scaled by its largest part, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_means(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    cells = min(cells, len(x))
    means = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(rounds):
        nearest = (x @ means.T).argmax(axis=1)
        order = np.argsort(nearest, kind="stable")
        used, first = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        lengths = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        means = means.copy()
        means[used] = np.where(lengths > 1e-12, sums / np.maximum(lengths, 1e-12), means[used])
    return means


def _takes(own: np.ndarray | int, other: np.ndarray | int) -> np.ndarray | bool:
    """Whether ``own`` is sent to ``other``: so for exactly one of two, and about equally often for each."""
    return np.where((own + other) % 2 == 0, own < other, own > other)


class _Cells:
    """Centroids of each vector length, their numbers, and which cells can hold a partner of a vector."""

    def __init__(self, centroids: dict[int, np.ndarray], threshold: float):
        self.centroids, self.blocks = centroids, {}
        self.first = dict(zip(sorted(centroids), np.cumsum([0, *(len(centroids[n]) for n in sorted(centroids))]), strict=False))
        self.apart = {n: np.linalg.norm(c[:, None] - c[None], axis=2) for n, c in centroids.items()}
        self.reach = (1 - threshold * threshold) ** 0.5  # the sine of the widest angle of a link

    def place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Add each vector's cell; a length that the sample lacks is a cell of its own."""
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("v"))
            home = np.zeros(len(batch), np.int32)
            for rows, length in _by_length(vectors):
                if length not in self.centroids:
                    home[rows] = -1 - length
                    continue
                near = unit(_matrix(vectors.take(pa.array(rows)), length)) @ self.centroids[length].T
                home[rows] = self.first[length] + near.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], [*batch.schema.names, "home"])

    def send(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors packed for every block that they belong to or must be compared with."""
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                columns = {name: part.column(i) for i, name in enumerate(part.schema.names)}
                ids, m, home = (columns[c].to_numpy() for c in ("id", "m", "home"))
                kind = np.float32 if pa.types.is_float32(columns["v"].type.value_type) else np.float64
                out: list[tuple] = []
                for rows, length in _by_length(columns["v"]):
                    x = _matrix(columns["v"].take(pa.array(rows)), length)
                    packed = x.astype(kind)

                    def pack(cell: int, block: int, side: int, own: np.ndarray) -> None:
                        if len(own):
                            data = (a.tobytes() for a in (ids[rows[own]], m[rows[own]], packed[own]))  # noqa: B023
                            out.append((cell, block, side, length * (1 if kind is np.float32 else -1), *data))  # noqa: B023

                    number = (mix(ids[rows].astype(np.uint64)) % np.array([self.blocks[h] for h in home[rows]], np.uint64)).astype(int)
                    for cell in np.unique(home[rows]).tolist():
                        own = np.flatnonzero(home[rows] == cell)
                        for block in range(self.blocks[cell]):
                            pack(cell, block, 0, own[number[own] == block])
                            pack(cell, block, 1, own[_takes(number[own], block)])
                    if length in self.centroids:
                        inside = self.across(unit(x), home[rows], length)
                        for k in np.flatnonzero(inside.any(axis=0)).tolist():
                            cell = int(self.first[length] + k)
                            for block in range(self.blocks.get(cell, 0)):
                                pack(cell, block, 1, np.flatnonzero(inside[:, k]))
                if out:
                    kinds = [pa.int32()] * 4 + [pa.binary()] * 3
                    names = [field.split()[0] for field in _SENT.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def across(self, x: np.ndarray, home: np.ndarray, length: int) -> np.ndarray:
        """By vector and cell: whether the cell, not the vector's own, takes it and can hold a partner."""
        best = home - self.first[length]
        near = x @ self.centroids[length].T
        away = near[np.arange(len(x)), best][:, None] - near
        inside = away <= self.reach * self.apart[length][best] + 1e-9
        return inside & _takes(best[:, None], np.arange(near.shape[1])[None])


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
    lengths = vectors.value_lengths().to_numpy()
    for length in np.unique(lengths).tolist():
        yield np.flatnonzero(lengths == length), length


def _matrix(vectors: pa.Array, length: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, length)


# ---------------------------------------------------------------- blocks


class _Links:
    """What a block found: links counted for each vector, and links enough to connect what is linked."""

    def __init__(self):
        self.rows: list[tuple[np.ndarray, np.ndarray | None, np.ndarray]] = []

    def add(self, left, right, threshold: float, same: bool) -> None:
        ids, own_m, x = left
        other_ids, other_m, y = right
        close = x @ y.T >= threshold
        if same:
            np.fill_diagonal(close, False)
        if not close.any():
            return
        for names, counts in [(ids, close @ other_m)] + ([] if same else [(other_ids, own_m @ close)]):
            hit = counts > 0
            self.rows.append((names[hit], None, counts[hit]))
        a, b = np.nonzero(close)
        b = b if same else b + len(ids)
        nodes = ids if same else np.concatenate([ids, other_ids])
        label = local_components(len(nodes), a, b)
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        self.rows.append((nodes[moved], nodes[label[moved]], np.zeros(len(moved), np.int64)))

    def take(self) -> pa.RecordBatch | None:
        rows, self.rows = self.rows, []
        if not rows:
            return None
        b = [pa.nulls(len(a), pa.int64()) if b is None else pa.array(b) for a, b, _ in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([r[0] for r in rows])), pa.concat_arrays(b), pa.array(np.concatenate([r[2] for r in rows]))],
            ["a", "b", "n"],
        )


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Packed vectors come by (cell, block), those of the block first; the others stream past it."""
    links, now, block, waiting = _Links(), None, None, []

    def gathered():
        whole = tuple(np.concatenate(x) for x in zip(*waiting, strict=True))
        links.add(whole, whole, threshold, True)
        return whole

    for batch in batches:
        cell, number, side, length = (batch.column(i).to_pylist() for i in range(4))
        for k in range(len(batch)):
            ids, m, v = (batch.column(i)[k].as_buffer() for i in (4, 5, 6))
            x = np.frombuffer(v, np.float32 if length[k] > 0 else np.float64).astype(float).reshape(-1, abs(length[k]))
            part = np.frombuffer(ids, np.int64), np.frombuffer(m, np.int64), unit(x)
            if (cell[k], number[k]) != now:
                if waiting:
                    gathered()
                now, block, waiting = (cell[k], number[k]), None, []
            if side[k] == 0:
                waiting.append(part)
                continue
            if waiting:
                block, waiting = gathered(), []
            if block is not None:
                links.add(part, block, threshold, False)
        out = links.take()
        if out is not None:
            yield out
    if waiting:
        gathered()
    out = links.take()
    if out is not None:
        yield out
