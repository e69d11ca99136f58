"""Repair of conversation structure: cheapest edits found by Dijkstra searches from both ends of the edit lattice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from corpusbench.llm.common import GAPS, stage_table

CHUNK = 1024  # turns that one search covers
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
CLEAN, BLANK, DUPLICATE, CUT = range(4)  # faults
_INITIALS = "sua"  # a fourth kind stands for every other initial
_STATES = 4  # nothing yet, after system, after user, after assistant
_GOOD = (0, 3)  # states a conversation may end in
_ROLE = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Repair:
    """``turns``: one row per edit, in the order (chunk, place), with the role and text that it leaves;
    ``conversations``: one row per conversation with its faults, cost and audit; ``key`` names it in both."""

    turns: DataFrame
    conversations: DataFrame


def conversation_key(conv: Column) -> Column:
    """A string that is never null and differs for different ids."""
    return F.when(conv.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv.cast("string")))


def repair(
    conversations: DataFrame, *, chunk: int = CHUNK, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> Repair:
    """The cheapest edits after which role initials read ``(s?(ua)+)?``, and the turns they leave.

    A turn's first fault counts: blank (no ``[^\\x20\\x09-\\x0D]``), duplicate (role and text seen
    earlier in the conversation), truncated (its last such character is not ``[.!?]``).  Keep costs 0,
    Rerole to user or assistant 1, Delete 2, Insert an empty user or assistant turn 5; a truncated turn
    that stays adds 5; blank and duplicate turns must go.  The audit lists the edits' initials in order;
    of equally cheap ones the least by ASCII is taken.

    1. Turns are put in order by ranges of (conversation, turn, checksum), so that a conversation of any
       length lies over many tasks; equal rows are told apart by a number that was written down.
    2. A turn becomes one letter (initial and fault); letters of at most ``chunk`` consecutive turns of a
       conversation become one string, whose edit lattice is (turns taken, state of the role pattern).
    3. Two searches, from the start forward and from the ends in reverse, meet in the middle.  They go on
       until no unsettled pair can be as cheap as the best crossing; of all crossings of that cost the
       least concatenated audit is taken.
    4. A conversation of several chunks has each chunk solved between all states; the costs (16 numbers a
       chunk) are joined from the end, and ties by rank of the audits from the start.

    Turns are taken by number, nulls first; equal numbers in the order of a checksum of role and text.
    A null role or text counts as one space, turns with a null conversation id form a conversation, very
    long texts are never held more than a few at a time, repeated rows are duplicates, and an empty table
    gives empty ones.  Other columns are not looked at, whatever their names.
    """
    conv, text = F.col(conv_col), F.coalesce(F.col(text_col), F.lit(" "))
    role = F.coalesce(F.col(role_col), F.lit(" "))
    arrived = stage_table(
        conversations.select(
            conversation_key(conv).alias("key"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"),
            text.alias("text"), F.md5(F.concat_ws(":", F.length(role), role, text)).alias("sum"),
            F.monotonically_increasing_id().alias("copy"),
        ),
        "turns-arrived",
    )
    order = ["key", "turn", "sum", "copy"]
    placed = arrived.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stage_table(
        placed.select(F.monotonically_increasing_id().alias("seq"), "key", "turn", "role", "text", "sum"), "turns-in-order"
    )
    first = rows.groupBy("key", "sum").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    marked = stage_table(rows.join(first, "seq", "left").select("seq", "key", "turn", _letter().alias("letter")), "turns-marked")
    letters = F.sort_array(F.collect_list(F.struct("seq", "letter")))
    by_chunk = marked.groupBy("key", F.floor(F.col("seq") / chunk).alias("chunk")).agg(
        F.min("seq").alias("first"), F.array_join(F.transform(letters, lambda x: x["letter"]), "").alias("letters")
    )
    ordered = W.partitionBy("key").orderBy("chunk")
    chunks = stage_table(
        by_chunk.select(
            "*", F.lag(F.right("letters", F.lit(1))).over(ordered).alias("before"),
            F.lead("chunk").over(ordered).isNull().alias("last"),
        ),
        "turn-chunks",
    )
    paths = stage_table(_paths(chunks), "turn-paths")
    return Repair(_turns(paths, rows), _told(chunks, paths, marked))


def _letter() -> Column:
    """'A' + 4 * fault + initial."""
    bare = F.rtrim(F.col("text"), F.lit(GAPS))
    fault = (
        F.when(F.length(bare) == 0, BLANK).when(F.col("first").isNull(), DUPLICATE)
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(CLEAN)
    )
    initial = F.instr(F.lit(_INITIALS), F.substring("role", 1, 1))  # an empty role has place 1
    kind = F.when((initial == 0) | (F.col("role") == ""), len(_INITIALS)).otherwise(initial - 1)
    return F.char(F.lit(65) + 4 * fault + kind)


def _paths(chunks: DataFrame) -> DataFrame:
    """Each chunk's cheapest edits between the states that its conversation passes it in."""
    start = F.lit(0)
    whole = chunks.where("before IS NULL AND last").select("key", "chunk", "first", "letters", start.alias("start"), F.lit(-1).alias("end"))
    parts = chunks.where("before IS NOT NULL OR NOT last")
    costs = parts.select("key", F.struct("chunk", _between("letters", "last").alias("costs")).alias("part"))
    passed = costs.groupBy("key").agg(_passage(F.sort_array(F.collect_list("part"))).alias("steps"))
    known = passed.select("key", F.explode("steps").alias("step")).select("key", "step.*")
    met = parts.join(known, ["key", "chunk"]).select("key", "chunk", "first", "letters", "start", "end")
    return whole.union(met).select("key", "chunk", "first", "letters", "start", F.inline(F.array(_cheapest("letters", "start", "end"))))


def _told(chunks: DataFrame, paths: DataFrame, marked: DataFrame) -> DataFrame:
    fault = F.floor((F.ascii("letter") - 65) / 4)
    high, low = (f("turn").cast("decimal(20,0)") for f in (F.max, F.min))
    faults = marked.groupBy("key").agg(
        F.coalesce((high - low + 1 - F.count_distinct("turn")).try_cast("long"), F.lit(0)).alias("gaps"),
        *(F.count(F.when(fault == kind, 1)).alias(name) for kind, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))),
    )
    letters = "".join(chr(65 + k) for k in range(16))
    initials = F.translate(F.concat(F.coalesce("before", F.lit("")), F.col("letters")), letters, (_INITIALS + "-") * 4)
    illegal = F.length(initials) - 1 - F.regexp_count(initials, F.lit("(?=su|ua|au)"))
    wrong = chunks.groupBy("key").agg(F.sum(illegal).alias("illegal"))
    audits = F.sort_array(F.collect_list(F.struct("chunk", "audit")))
    repaired = paths.groupBy("key").agg(
        F.sum("cost").alias("cost"), F.array_join(F.transform(audits, lambda x: x["audit"]), "").alias("audit")
    )
    return faults.join(wrong, "key").join(repaired, "key")


def _turns(paths: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns: key, chunk, place, edit, role, text."""
    steps = paths.select("key", "chunk", "first", F.posexplode(_steps("letters", "start", "audit")).alias("place", "step"))
    taken = steps.select("key", "chunk", "place", (F.col("first") + F.col("step.row")).alias("seq"), "step.edit", "step.role")
    inserted = taken.where("edit = 'I'").select("key", "chunk", "place", "edit", "role", F.lit("").alias("text"))
    own = rows.select("seq", F.col("role").alias("own"), "text")
    edited = taken.where("edit <> 'I'").join(own, "seq").select(
        "key", "chunk", "place", "edit", F.coalesce("role", "own").alias("role"), "text"
    )
    return edited.union(inserted)


def digests(turns: DataFrame) -> DataFrame:
    """key, repaired_sha256 of the kept turns as ``role:text`` lines; texts pass through one by one in order."""
    kept = turns.where("edit <> 'D'").select("key", "chunk", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = kept.repartition("key").sortWithinPartitions("key", "chunk", "place")
    return dealt.mapInArrow(_hashed, "key string, repaired_sha256 string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple[str, str]] = []
        for key, line in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
            if key != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(line.as_buffer())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["key", "repaired_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["key", "repaired_sha256"])


# ---------------------------------------------------------------- the edit lattice


def _turn_of(state: int) -> int:
    """The state after a user or assistant turn that fits."""
    return 3 if state == 2 else 2


def _after(state: int, kind: int) -> int | None:
    """The state after a turn with that initial, if it fits."""
    if kind == 0:
        return 1 if state == 0 else None
    if kind in (1, 2) and _turn_of(state) == kind + 1:
        return kind + 1
    return None


def _edges(letter: str | None, tail: bool) -> list[tuple[int, int, bool, str, int]]:
    """(state, next state, whether a turn is taken, edit, cost) where ``letter`` is the next turn, or none is left."""
    edges = []
    for state in range(_STATES):
        if letter is not None or tail:
            edges.append((state, _turn_of(state), False, "I", INSERT))
        if letter is None:
            continue
        fault, kind = divmod(ord(letter) - 65, 4)
        edges.append((state, state, True, "D", DELETE))
        if fault in (BLANK, DUPLICATE):
            continue
        extra = TRUNCATED if fault == CUT else 0
        if (kept := _after(state, kind)) is not None:
            edges.append((state, kept, True, "K", extra))
        edges.append((state, _turn_of(state), True, "R", REROLE + extra))
    return edges


_EDGES = {(letter, tail): _edges(letter, tail) for letter in [*(chr(65 + k) for k in range(16)), None] for tail in (False, True)}


class _Side:
    """One of the two searches: labels are (cost, audit from its own end), settled in order of cost, then of turns."""

    def __init__(self, nodes: list[tuple[int, int]]):
        self.labels = {node: (0, "") for node in nodes}
        self.heap: list[tuple[int, int, tuple[int, int]]] = [(0, 0, node) for node in sorted(nodes)]
        self.settled: dict[tuple[int, int], tuple[int, str]] = {}

    def top(self) -> float:
        while self.heap and (self.heap[0][2] in self.settled or self.labels[self.heap[0][2]][0] < self.heap[0][0]):
            heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self) -> tuple[tuple[int, int], int, str]:
        node = heappop(self.heap)[2]
        self.settled[node] = self.labels[node]
        return node, *self.labels[node]

    def offer(self, node: tuple[int, int], cost: int, audit: str, turns: int) -> None:
        known = self.labels.get(node)
        if known is None or (cost, audit) < known:
            self.labels[node] = (cost, audit)
            if known is None or cost < known[0]:
                heappush(self.heap, (cost, turns, node))


@lru_cache(1 << 16)
def cheapest(letters: str, start: int = 0, ends: tuple[int, ...] = _GOOD, tail: bool = True) -> tuple[int, str] | None:
    """(cost, audit) of the best path from (0, start) to (all turns, one of ends); None if there is none.

    Equally cheap audits between the same two nodes are never prefixes of each other, for what the longer
    one has left would cost more than nothing; so the least whole audit consists of least parts.
    """
    n = len(letters)
    ahead, back = _Side([(0, start)]), _Side([(n, end) for end in ends])
    best = float("inf")
    steps = [_EDGES[letters[i] if i < n else None, tail] for i in range(n + 1)]

    def settle(own: _Side, other: _Side) -> None:
        nonlocal best
        (i, state), cost, audit = own.settle()
        if (met := other.labels.get((i, state))) is not None:
            best = min(best, cost + met[0])
        for place in (i,) if own is ahead else (i - 1, i):
            for source, target, taken, edit, price in steps[place] if place >= 0 else ():
                if own is ahead and source == state:
                    own.offer((i + taken, target), cost + price, audit + edit, i + taken)
                elif own is back and target == state and place + taken == i:
                    own.offer((place, source), cost + price, edit + audit, n - place)

    settle(ahead, back)
    for _ in ends:
        settle(back, ahead)
    # A side that has run out has settled all it can reach: the best way is known, or there is none.
    sides = [(ahead, back), (back, ahead)]
    while (least := ahead.top() + back.top()) <= best and least < float("inf"):
        settle(*sides[0])
        sides.reverse()
    if best == float("inf"):
        return None
    crossings = [a[1] + back.settled[node][1] for node, a in ahead.settled.items() if node in back.settled and a[0] + back.settled[node][0] == best]
    for (i, state), (cost, audit) in ahead.settled.items():
        for source, target, taken, edit, price in steps[i]:
            if source == state and (rest := back.settled.get((i + taken, target))) is not None and cost + price + rest[0] == best:
                crossings.append(audit + edit + rest[1])
    return int(best), min(crossings)


def between(letters: str, last: bool) -> list[int]:
    """For each start: four costs (-1: no way) and four ranks of the audits, by end; the last chunk has one end, any good one."""
    out = []
    for start in range(_STATES):
        if last:
            found = [cheapest(letters, start, _GOOD, True)] + [None] * (_STATES - 1)
        else:
            found = [cheapest(letters, start, (end,), False) for end in range(_STATES)]
        ranks = sorted(x[1] for x in found if x is not None)
        out += [-1 if x is None else x[0] for x in found] + [-1 if x is None else ranks.index(x[1]) for x in found]
    return out


def passage(costs: list[list[int]]) -> list[tuple[int, int]]:
    """(start, end) of each chunk on the cheapest way through all of them, the least audit among equals; end -1 in the last one.

    No chunk but the last ends with an insertion, so audits of one chunk from one start are never
    prefixes of each other, and the first chunk in which two ways differ tells which is less.
    """
    far = float("inf")
    rest = [[0.0] * _STATES]
    for own in reversed(costs):
        after = rest[-1]
        rest.append([
            min((own[8 * s + e] + after[e] for e in range(_STATES) if own[8 * s + e] >= 0), default=far) for s in range(_STATES)
        ])
    rest.reverse()
    state, steps = 0, []
    for k, own in enumerate(costs):
        ways = [e for e in range(_STATES) if own[8 * state + e] >= 0 and own[8 * state + e] + rest[k + 1][e] == rest[k][state]]
        end = min(ways, key=lambda e: own[8 * state + 4 + e])
        steps.append((state, -1 if k == len(costs) - 1 else end))
        state = end
    return steps


def walk(letters: str, start: int, audit: str) -> list[tuple[int, str, str | None]]:
    """(turn, edit, role given) for each edit of an audit."""
    state, row, out = start, 0, []
    for edit in audit:
        role = None
        if edit in "IR":
            state = _turn_of(state)
            role = _ROLE["a" if state == 3 else "u"]
        elif edit == "K":
            state = _after(state, (ord(letters[row]) - 65) % 4)
        out.append((row, edit, role))
        row += edit != "I"
    return out


def _record(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


@F.pandas_udf(_record(cost=T.LongType(), audit=T.StringType()))
def _cheapest(letters: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    found = [cheapest(x, int(s), _GOOD if e < 0 else (int(e),), bool(e < 0)) for x, s, e in zip(letters, start, end, strict=True)]
    return pd.DataFrame(found, columns=["cost", "audit"])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _between(letters: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([between(x, bool(y)) for x, y in zip(letters, last, strict=True)])


@F.pandas_udf(T.ArrayType(_record(chunk=T.LongType(), start=T.IntegerType(), end=T.IntegerType())))
def _passage(parts: pd.Series) -> pd.Series:
    out = []
    for rows in parts:
        steps = passage([list(r["costs"]) for r in rows])
        out.append([{"chunk": r["chunk"], "start": s, "end": e} for r, (s, e) in zip(rows, steps, strict=True)])
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(_record(row=T.IntegerType(), edit=T.StringType(), role=T.StringType())))
def _steps(letters: pd.Series, start: pd.Series, audit: pd.Series) -> pd.Series:
    return pd.Series([
        [{"row": r, "edit": e, "role": role} for r, e, role in walk(x, int(s), a)]
        for x, s, a in zip(letters, start, audit, strict=True)
    ])
