import hashlib
import itertools
import random
import re
import zlib

import pytest

from corpusbench.llm import conversations, queries
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string, seq long, key string, chunk int"
LETTERS = [chr(65 + k) for k in range(16)]
GOOD = re.compile("(s?(ua)+)?")


def every_way(letters, most_inserts=3):
    """The least (cost, audit) among all audits, by trying them."""
    best = None
    for edits in itertools.product("DKR", repeat=len(letters)):
        for gaps in itertools.product(range(most_inserts), repeat=len(letters) + 1):
            audit = "".join("I" * g + e for g, e in zip(gaps, [*edits, ""], strict=True))
            cost = 5 * sum(gaps)
            for e, letter in zip(edits, letters, strict=True):
                fault = (ord(letter) - 65) // 4
                if e != "D" and fault in (1, 2):
                    cost = None
                    break
                cost += {"D": 2, "K": 0, "R": 1}[e] + (5 if e != "D" and fault == 3 else 0)
            if cost is None or best is not None and (cost, audit) >= best:
                continue
            free = sum(gaps) + edits.count("R")
            for given in itertools.product("ua", repeat=free):
                new, row, out = iter(given), iter(letters), ""
                for e in audit:
                    letter = next(row) if e != "I" else None
                    out += "" if e == "D" else "sua-"[(ord(letter) - 65) % 4] if e == "K" else next(new)
                if GOOD.fullmatch(out):
                    best = (cost, audit)
                    break
    return best


def by_turns(letters, start=0, ends=(0, 3), tail=True):
    """The same by going through the turns once."""
    now = {start: (0, "")}

    def inserted(now):
        for _ in range(2):
            for state, (cost, audit) in list(now.items()):
                to = 3 if state == 2 else 2
                now[to] = min(now.get(to, (cost + 5, audit + "I")), (cost + 5, audit + "I"))
        return now

    for letter in letters:
        fault, kind = divmod(ord(letter) - 65, 4)
        after = {}
        for state, (cost, audit) in inserted(now).items():
            turn = 3 if state == 2 else 2
            ways = [(state, 2, "D")]
            if fault in (0, 3):
                more = 5 if fault == 3 else 0
                ways.append((turn, 1 + more, "R"))
                if kind == 0 and state == 0:
                    ways.append((1, more, "K"))
                if kind in (1, 2) and turn == kind + 1:
                    ways.append((turn, more, "K"))
            for to, price, edit in ways:
                after[to] = min(after.get(to, (cost + price, audit + edit)), (cost + price, audit + edit))
        now = after
    return min((v for k, v in (inserted(now) if tail else now).items() if k in ends), default=None)


def test_search_against_every_audit():
    r = random.Random(5)
    cases = ["", *LETTERS, *("".join(r.choice(LETTERS) for _ in range(n)) for n in (2, 2, 2, 3, 3, 3) for _ in range(8))]
    for letters in cases:
        assert conversations.cheapest(letters) == by_turns(letters) == every_way(letters), letters


def test_search_between_all_states():
    r = random.Random(6)
    for _ in range(1500):
        letters = "".join(r.choice("ABCD" * 4 + "".join(LETTERS)) for _ in range(r.randint(1, 40)))
        for start in range(4):
            assert conversations.cheapest(letters, start) == by_turns(letters, start)
            for end in range(4):
                assert conversations.cheapest(letters, start, (end,), False) == by_turns(letters, start, (end,), False)


def test_chunks_join_to_the_same_audit():
    r = random.Random(7)
    for _ in range(400):
        letters = "".join(r.choice("BCBCA" + "".join(LETTERS)) for _ in range(r.randint(2, 40)))
        size = r.randint(1, 9)
        parts = [letters[i : i + size] for i in range(0, len(letters), size)]
        steps = conversations.passage([conversations.between(p, k == len(parts) - 1) for k, p in enumerate(parts)])
        found = [conversations.cheapest(p, s, (e,) if e >= 0 else (0, 3), e < 0) for p, (s, e) in zip(parts, steps, strict=True)]
        assert (sum(c for c, _ in found), "".join(a for _, a in found)) == by_turns(letters)


# ---------------------------------------------------------------- the query


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_ = (" " if x is None else x for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows):
    out = []
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        own = [r for r in after if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).hexdigest()))
        seen, letters, faults = set(), "", []
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            faults.append(fault)
            letters += chr(65 + 4 * fault + ("sua".index(role[0]) if role[:1] in ("s", "u", "a") else 3))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [(a[2][:1] + b[2][:1]) for a, b in itertools.pairwise(own)]
        cost, audit = by_turns(letters)
        lines, state, row = [], 0, 0
        for e in audit:
            if e in "IR":
                state = 3 if state == 2 else 2
                lines.append(("assistant" if state == 3 else "user") + ":" + (own[row][3] if e == "R" else ""))
            elif e == "K":
                state = 1 if own[row][2][0] == "s" else 2 if own[row][2][0] == "u" else 3
                lines.append(own[row][2] + ":" + own[row][3])
            row += e != "I"
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(k) for k in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return out


def made(seed, many=120):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "unknown"]
    texts = ["Yes.", "No!", "Why? ", "cut off", "  \n", "", None, "é.\t\n", "a.b"]
    rows = []
    for conv in [None, *range(many)]:
        turn = 0
        for _ in range(r.randint(1, 9)):
            role = r.choice(roles) if r.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn if r.random() < 0.95 else None, role, r.choice(texts) if r.random() < 0.4 else f"{turn} {conv}."))
            turn += r.choice([1, 1, 1, 2, 0])
    long = [(5000, t, ("user", "assistant")[t % 2] if t % 7 else "system", f"{t % 400}" + ("." if t % 11 else "")) for t in range(3000)]
    rows += long + [(6000, 3, "user", "Same.")] * 800 + [(7000, None, None, None)] * 50 + [(None, None, None, None)]
    rows += [(8000, 1, "user", "word " * 400_000 + "end."), (8000, 2, "assistant", "Fine."), (8001, 2**62, "user", "a."), (8001, -(2**62), "user", "b.")]
    r.shuffle(rows)
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(*row, 1, "k", 2) for row in rows], SCHEMA)


@pytest.mark.parametrize("chunk", [1024, 7])
def test_query_against_plain_code(spark, monkeypatch, chunk):
    rows = made(chunk)
    repair = conversations.repair
    monkeypatch.setattr(queries, "table", lambda *_: frame_of(spark, rows))
    monkeypatch.setattr(conversations, "repair", lambda df: repair(df, chunk=chunk))
    found = queries.op13_conversation_repair(spark, "")
    assert sorted((tuple(r) for r in found.collect()), key=brute.sort_key) == sorted(expected(rows), key=brute.sort_key)


def test_empty_table(spark, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: frame_of(spark, []))
    assert queries.op13_conversation_repair(spark, "").count() == 0
