import random
import re
from heapq import heapify, heapreplace

import pytest

from corpusbench.llm import mixing, queries
from tests.check_oracle import rows_of
from tests.llm import brute
from tests.llm.fixtures import awkward_rows, text

SCHEMA = "doc_id long, text string, source string, size long, rank int, words string, spans int"


def made(seed):
    r = random.Random(seed)
    rows = [(i, text(r, r.choice([0, 3, 40, 300])), "hot" if i % 3 else f"s{i % 11}") for i in range(1500)]
    rows += [(d, t, None) for d, t in awkward_rows()]
    rows += [(7, "the same words again", "copies")] * 700 + [(None, None, "nothing")] * 40 + [(8000, "word " * 30_000, "long")]
    r.shuffle(rows)
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(*row, 1, 2, "w", 3) for row in rows], SCHEMA)


def mixed(spark, rows, **settings):
    return mixing.mix_sources(frame_of(spark, rows), shard_words=20_000, **settings)


def test_sources_come_near_their_targets(spark):
    rows = made(1)
    found = mixed(spark, rows).collect()
    assert sorted(((r.doc_id, r.size) for r in found), key=brute.sort_key) == sorted(
        ((d, len(brute.words_of(t))) for d, t, _ in rows), key=brute.sort_key
    )
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    size = {s: sum(len(brute.words_of(t)) for _, t, x in rows if x == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:  # share anew what is above twice a source
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        target = {s: 2 * size[s] if s in full else weight[s] * rest / sum(weight[x] for x in names if x not in full) for s in names}
        above = {s for s in names if s not in full and target[s] > 2 * size[s]}
        if not above:
            break
        full |= above
    taken = dict.fromkeys(names, 0)
    for r in found:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == r.passes * r.size + sum(x["words"] for x in r.spans)
    for s in names:
        shards = -(-size[s] // 20_000) + 1
        assert abs(taken[s] - target[s]) <= shards * mixing.BLOCK
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 2 * mixing.BLOCK * len(names)


def test_reruns_agree_however_the_rows_come(spark):
    rows = made(2)
    one = sorted((tuple(r) for r in mixed(spark, rows).select("doc_id", "source", "taken", "text_sum", "copy").collect()), key=brute.sort_key)
    frame = frame_of(spark, rows[::-1]).repartition(7)
    again = mixing.mix_sources(frame, shard_words=20_000).select("doc_id", "source", "taken", "text_sum", "copy").collect()
    assert sorted((tuple(r) for r in again), key=brute.sort_key) == one
    other = mixed(spark, rows, seed=1).select("doc_id", "source", "taken", "text_sum", "copy").collect()
    assert sorted((tuple(r) for r in other), key=brute.sort_key) != one


def test_texts_of_the_mix(spark):
    rows = made(3)
    mix = mixed(spark, rows)
    texts = mixing.mixed_texts(frame_of(spark, rows), mix).collect()
    assert sum(len(brute.words_of(r.text)) for r in texts) == sum(r.taken for r in mix.collect())
    own = {}
    for d, t, s in rows:
        own.setdefault((d, s), set()).add(" ".join(brute.words_of(t)))
    for r in texts:
        piece = " ".join(brute.words_of(r.text))
        assert any(piece in t for t in own[r.doc_id, r.source])


def by_heap(claims, seats):
    heap = [(-c, k, 1) for k, c in enumerate(claims)]
    heapify(heap)
    quota = [0] * len(claims)
    for _ in range(seats):
        bid, k, d = heap[0]
        quota[k] += 1
        heapreplace(heap, (-claims[k] / (d + 2), k, d + 2))
    return quota


@pytest.mark.parametrize("seats", [1, 7, 300, 40_000])
def test_highest_quotients(spark, seats):
    r = random.Random(seats)
    claims = [r.choice([0.0, 5.0, 5.0, 40.0, r.random() * 10 ** r.randint(0, 6)]) for _ in range(60)]
    cells = spark.createDataFrame([(k // 4, k % 4, c) for k, c in enumerate(claims)], "rank long, shard long, claim double")
    found = mixing.apportion(cells, seats).orderBy("rank", "shard").collect()
    assert [r.quota for r in found] == by_heap(claims, seats)


def test_against_sql(spark, monkeypatch):
    import duckdb

    rows = made(4)
    monkeypatch.setattr(queries, "table", lambda *_: frame_of(spark, rows))
    database = duckdb.connect()
    documents = frame_of(spark, rows).toArrow()  # noqa: F841
    database.sql("CREATE TABLE documents AS SELECT * FROM documents")
    relation = database.sql(queries.ORACLES["op11_mixing"])
    found = queries.op11_mixing(spark, "")
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(relation.columns, relation.fetchall())


def test_empty_tables_and_no_python(spark):
    assert mixing.mix_sources(frame_of(spark, [])).count() == 0
    nothing = mixing.mix_sources(frame_of(spark, [(1, None, "a"), (None, "", None)]))
    assert [r.taken for r in nothing.collect()] == [0, 0]
    plan = mixed(spark, made(5))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
