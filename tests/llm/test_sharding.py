import random
import re
import zlib

import pytest

from corpusbench.llm import sharding
from tests.llm import brute
from tests.llm.fixtures import awkward_rows, documents, text


def lopsided(seed):
    r = random.Random(seed)
    rows = [(i, text(r, r.choice([1, 5, 30, 200])), r.choice(["en", None]), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    return rows + [(d, t, None, None) for d, t in awkward_rows()] + [(7, "same", "en", "hot")] * 20


@pytest.mark.parametrize("shards", [8, 5, 1])
def test_bytes_are_near_equal(spark, shards):
    rows = lopsided(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = sharding.kd_shards(docs, shards=shards).collect()
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in rows), key=brute.sort_key)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=brute.sort_key) == want
    total, largest = sum(r.size for r in found), max(r.size for r in found)
    by_shard = {}
    for r in found:
        by_shard.setdefault(r.shard, []).append(r)
    assert sorted(by_shard) == list(range(shards))
    for own in by_shard.values():
        assert abs(sum(r.size for r in own) - total / shards) <= 2 * largest
        assert sorted(r.slot for r in own) == list(range(len(own)))


def test_target_bytes_and_place_in_space(spark):
    rows = [(i, "x" * 99, "en", "a" if i < 500 else "b") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = sharding.kd_shards(docs, target_bytes=25_000).collect()
    assert {r.shard for r in found} == {0, 1, 2, 3}
    for source in (True, False):
        assert len({r.shard for r in found if (r.doc_id < 500) == source}) == 2


def test_empty_and_small_tables(spark):
    assert sharding.kd_shards(documents(spark, []), shards=8).count() == 0
    few = sharding.kd_shards(documents(spark, [(1, "a"), (2, None)]), shards=8).collect()
    assert sorted((r.doc_id, r.size) for r in few) == [(1, 2), (2, 1)]
    with pytest.raises(ValueError):
        sharding.kd_shards(documents(spark, [(1, "a")]))


def test_no_python(spark):
    plan = sharding.kd_shards(documents(spark, awkward_rows()), shards=4)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
