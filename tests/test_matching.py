import pytest
from pyspark.sql import functions as F

from corpusbench.operators import matching, spread
from corpusbench.operators.spread import spread_join

C = F.col


def sources(spark, *rows):
    return spark.createDataFrame(list(rows), "source_key string, title string, author string")


def candidates(spark, *rows):
    full = [(k, q, p, f"q{q}", vid, t, d) for k, q, p, vid, t, d in rows]
    return spark.createDataFrame(
        full, "source_key string, query_ord int, position int, query string, video_id string, title string, duration_seconds double"
    )


OVER = ("k", "Over", "Ramón Marrero Aristy")


def test_book_prefers_the_named_author(spark):
    found = matching.match_books(
        sources(spark, OVER),
        candidates(
            spark, ("k", 0, 0, "v1", "otra cosa", 100.0), ("k", 0, 1, "v2", "Over Ramón Marrero Aristy audiolibro fragmento", 900.0),
            ("k", 1, 0, "v3", "Over audiolibro", 900.0),
        ),
    ).collect()
    assert [(r.video_id, r.kind) for r in found] == [("v2", "partial")]


def test_book_rejects_short_clips_and_other_authors(spark):
    found = matching.match_books(
        sources(spark, OVER),
        candidates(
            spark, ("k", 0, 0, "v1", "Over Ramón Marrero Aristy", 5.0), ("k", 0, 1, "v2", "Over otro autor", 900.0),
            ("k", 0, 2, "v3", "Over audiolibro por Ramón García", 900.0),
        ),
    )
    assert found.count() == 0


def test_first_sighting_keeps_its_query(spark):
    rows = candidates(spark, ("k", 1, 0, "v", "Over Aristy", 50.0), ("k", 0, 3, "v", "Over Aristy", 50.0))
    assert [r.query for r in matching.first_seen(rows).collect()] == ["q0"]


def test_equal_scores_take_the_smaller_id(spark):
    rows = candidates(spark, ("k", 0, 0, "vb", "Over Aristy", 50.0), ("k", 0, 1, "va", "Over Aristy", 50.0))
    assert matching.match_books(sources(spark, OVER), rows).first().video_id == "va"


def test_poem_score_and_reasons(spark):
    poem = sources(spark, ("k", "Hay un país en el mundo", "Pedro Mir"))
    rows = candidates(spark, ("k", 0, 0, "v1", "Hay un país en el mundo - Pedro Mir - recitación", 9.0), ("k", 0, 1, "v2", "mundo", None))
    scored = {r.video_id: r for r in matching.score_poem_candidates(poem, rows).collect()}
    assert (scored["v1"].score, scored["v1"].content_kind) == (1.0, "recitation")
    assert scored["v2"].match_reasons == ["title_overlap=0.333", "author_overlap=0.000", "content_kind=other"]
    assert [r.video_id for r in matching.match_poems(poem, rows).collect()] == ["v1"]
    assert matching.match_poems(poem, rows.where("video_id = 'v2'")).count() == 0


def test_poem_outcomes(spark):
    poems = sources(spark, ("a", "Canto alto", "Ana Paz"), ("b", "Otro verso", "X Y"), ("c", "Luz mar", "Q R"), ("d", "Sol", "T U"))
    rows = candidates(
        spark, ("a", 0, 0, "v1", "Canto alto Ana Paz fragmento", None), ("c", 0, 0, "v2", "Luz mar Q R", None), ("d", 0, 0, "v3", "Sol", None)
    )
    failures = spark.createDataFrame([("d", "E", "m", True)], "source_key string, error_type string, error_message string, error_retryable boolean")
    found = matching.poem_outcomes(poems, matching.match_poems(poems, rows), failures)
    assert {r.source_key: (r.status, r.video_id) for r in found.collect()} == {
        "a": ("partial", "v1"), "b": ("not_found", None), "c": ("found", "v2"), "d": ("error", None),
    }


def songs(spark, *rows):
    return spark.createDataFrame(list(rows), "source_key string, position int, song_id string, title string, artist string")


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), "source_key string, query string, expected_title string, expected_artist string")


def test_song_choice(spark):
    wanted = requests(spark, ("k", "q", "Ojalá que llueva café", "Juan Luis Guerra"))
    rows = songs(spark, ("k", 0, "1", "Otra", "Nadie"), ("k", 1, "2", "Ojala que llueva cafe", "Juan Luis Guerra"))
    assert [r.song_id for r in matching.match_songs(wanted, rows).collect()] == ["2"]
    assert matching.match_songs(wanted, rows.where("song_id = '1'")).count() == 0


def test_song_query_stands_in_for_missing_expectations(spark):
    wanted = requests(spark, ("k", "llueva café", None, None), ("e", "¿?", None, ""))
    rows = songs(spark, ("k", 0, "1", "Que llueva café", "X"), ("k", 1, "2", "Que llueva café", "Y"))
    best = matching.match_songs(wanted, rows).first()
    assert (best.song_id, best.low, best.mean) == ("1", 1.0, 1.0)
    assert [r.source_key for r in matching.unscorable_requests(wanted).collect()] == ["e"]


def test_music_video(spark):
    song = spark.createDataFrame([("k", "Ojalá que llueva café", "Juan Luis Guerra")], "source_key string, title string, artist string")
    rows = candidates(spark, ("k", 0, 0, "v1", "Juan Luis Guerra Ojalá que llueva café oficial", 250.5), ("k", 0, 1, "v2", "Ojalá que llueva café - Otro", 9.0))
    best = matching.match_music_videos(song, rows).collect()
    assert [(r.video_id, r.confidence, r.duration_seconds) for r in best] == [("v1", 1.0, 250)]
    assert matching.match_music_videos(song, rows.where("video_id = 'v2'")).count() == 0


def test_details_of_another_song_are_a_permanent_failure(spark):
    matches = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source_key string, song_id string")
    details = spark.createDataFrame([("a", "1"), ("b", "9")], "source_key string, returned_id string")
    found = {r.source_key: (r.error_code, r.error_retryable) for r in matching.checked_details(matches, details).collect()}
    assert found == {"a": (None, None), "b": ("identity_mismatch", False), "c": ("invalid_response", False)}


def test_parameters_are_checked(spark):
    rows = candidates(spark)
    for call in (
        lambda: matching.match_poems(sources(spark), rows, minimum_score=2),
        lambda: matching.cap_results(rows, 51),
        lambda: matching.within_duration(rows, 5, 5),
        lambda: matching.match_songs(requests(spark), songs(spark), minimum_score=0),
    ):
        with pytest.raises(ValueError):
            call()


def test_open_catalog_equals_all_pairs(spark, no_broadcast):
    import random

    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["hot"] * 40
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(120)]
    catalog = spark.createDataFrame(texts[:40], "source_key int, title string")
    bodies = spark.createDataFrame(texts[40:], "candidate_key int, title string")
    for threshold in (0.3, 0.5, 2 / 3, 1.0):
        expected = set()
        for s, title in texts[:40]:
            wanted = set(title.split())
            for c, body in texts[40:]:
                if len(wanted & set(body.split())) / len(wanted) >= threshold:
                    expected.add((s, c))
        found = matching.open_catalog_pairs(catalog, bodies, minimum_coverage=threshold)
        assert {(r.source_key, r.candidate_key) for r in found.collect()} == expected


def test_open_catalog_with_a_broadcast_side(spark):
    catalog = spark.createDataFrame([(1, "uno dos tres"), (2, "")], "source_key int, title string")
    bodies = spark.createDataFrame([(5, "dos uno"), (6, "tres"), (7, "")], "candidate_key int, title string")
    found = matching.open_catalog_pairs(catalog, bodies).collect()
    assert [(r.source_key, r.candidate_key, r.shared, r.expected_tokens) for r in found] == [(1, 5, 2, 3)]


def test_spread_join_keeps_every_row_of_a_hot_key(spark, no_broadcast):
    facts = spark.range(2000).select(F.when(C("id") < 1500, 1).otherwise(C("id")).alias("key"), "id")
    keyed = spark.createDataFrame([(1, "hot"), (1600, "cold")], "key bigint, name string")
    plain = facts.join(keyed, "key").collect()
    assert sorted(spread_join(facts, keyed, ["key"], "id").collect()) == sorted(plain)
    assert spread_join(facts, keyed, ["key"], "id", how="left").count() == 2000
    with pytest.raises(ValueError):
        spread_join(facts, keyed, ["key"], "id", how="right")


def test_matches_do_not_depend_on_salts_or_partitions(spark, no_broadcast):
    poem = sources(spark, *[(f"k{i}", f"verso {i} mar", "Ana Paz") for i in range(20)])
    rows = candidates(spark, *[(f"k{i % 20}", 0, i, f"v{i}", f"verso {i % 7} mar Ana", None) for i in range(400)])
    columns = ["source_key", "video_id", "score"]
    first = matching.match_poems(poem, rows.coalesce(1), salts=1).select(columns).collect()
    second = matching.match_poems(poem.repartition(3), rows.repartition(9), salts=7).select(columns).collect()
    assert sorted(first) == sorted(second)


def test_open_catalog_joins_on_rare_tokens_only(spark):
    """Short titles full of stop words: joined rows stay far below all pairs, and no pair is lost."""
    titles = [(f"t{k}", f"la casa de el rio{k} azul{k}") for k in range(60)]
    offers = [(f"c{k}", f"la casa de el monte{k}") for k in range(60)] + [(f"d{k}", f"rio{k} azul{k} la") for k in range(60)]
    catalog = spark.createDataFrame(titles, "source_key string, title string")
    candidates = spark.createDataFrame(offers, "candidate_key string, title string")
    found = {(r.source_key, r.candidate_key) for r in matching.open_catalog_pairs(catalog, candidates, minimum_coverage=0.5).collect()}
    bags = {k: set(t.split()) for k, t in titles + offers}
    truth = {(a, b) for a, _ in titles for b, _ in offers if len(bags[a] & bags[b]) >= 0.5 * len(bags[a])}
    assert found == truth
    strict = matching.open_catalog_pairs(catalog, candidates, minimum_coverage=0.8)
    assert strict.count() == 0


def test_probes_are_the_rarest_tokens(spark):
    held = spark.createDataFrame([(f"c{k}", "de") for k in range(500)] + [("c0", "rio")], "candidate_key string, token string")
    probes = spark.createDataFrame([("t", "rio")], "source_key string, token string")
    assert matching._meet(held, probes, 4).count() == 1


def test_measured_joins_part_hot_keys_and_copy_nothing_else(spark, no_broadcast):
    facts = spark.range(20_000).select(F.when(C("id") % 10 > 0, 7).when(C("id") % 20 == 0, C("id")).alias("key"), "id")
    keyed = spark.range(0, 20_000).select(C("id").alias("key"), (C("id") * 2).alias("value"))
    hot = spread.hot_keys(facts, ["key"])
    assert {(r.key, r._pieces) for r in hot.collect()} == {(7, 8)}  # nulls have a twentieth, less than an eighth
    joined = spread_join(facts, keyed, ["key"], "id", salts=None)
    assert sorted(joined.collect()) == sorted(facts.join(keyed, "key").collect())
    left = spread_join(facts, keyed, ["key"], "id", salts=None, how="left")
    assert sorted(left.collect(), key=lambda r: r.id) == sorted(facts.join(keyed, "key", "left").collect(), key=lambda r: r.id)
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    again = spread_join(facts, keyed, ["key"], "id", salts=None)  # planned anew
    largest = max(again.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
    spark.conf.unset(merging)
    assert largest < 12_000  # of 19,000: its pieces are dealt by hash over eight partitions


def test_measured_joins_without_a_hot_key_are_plain(spark, no_broadcast):
    facts = spark.range(2000).select((C("id") % 500).alias("key"), "id")
    keyed = spark.range(500).select(C("id").alias("key"), C("id").alias("value"))
    joined = spread_join(facts, keyed, ["key"], "id", salts=None)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and "Generate" not in plan and joined.count() == 2000


def test_measured_joins_on_hot_null_keys_and_none(spark, no_broadcast):
    facts = spark.range(1000).select(F.when(C("id") < 100, C("id")).alias("key"), F.lit("x").alias("kind"), "id")
    keyed = spark.createDataFrame([(5, "x", "five")], "key bigint, kind string, name string")
    left = spread_join(facts, keyed, ["key", "kind"], "id", salts=None, how="left")
    assert left.count() == 1000 and [r.id for r in left.where("name = 'five'").collect()] == [5]
    assert spread_join(facts.where("false"), keyed, ["key", "kind"], "id", salts=None).count() == 0


def test_hot_keys_are_counted_in_cheaper_rows(spark, no_broadcast, monkeypatch):
    asked, count = [], spread.hot_keys
    monkeypatch.setattr(spread, "hot_keys", lambda facts, on: asked.append(facts) or count(facts, on))
    poem = sources(spark, *[(f"k{i}", f"verso {i} mar", "Ana Paz") for i in range(20)])
    rows = candidates(spark, *[(f"k{i % 20}", 0, i, f"v{i}", f"verso {i % 7} mar Ana", None) for i in range(200)])
    counted = rows.select(F.when(C("position") % 4 > 0, "k3").otherwise(C("source_key")).alias("source_key"))
    videos, columns = matching.first_seen(rows), ["source_key", "video_id", "score"]
    parted = matching.match_poems(poem, videos, counted=counted)
    assert [df.sameSemantics(counted) for df in asked] == [True]  # the window behind the videos is not run for it
    assert "_salt" in parted._jdf.queryExecution().optimizedPlan().toString()
    plain = matching.match_poems(poem, videos, salts=1)
    assert sorted(parted.select(columns).collect()) == sorted(plain.select(columns).collect())


def test_poem_titles_are_normalized_once(spark):
    poem, rows = sources(spark, ("k", "mar", "Ana")), candidates(spark, ("k", 0, 0, "v", "El mar, fragmento", None))
    scored = matching.score_poem_candidates(poem, rows, salts=1)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 3  # title and author of the poem, title of the candidate
    assert [(r.content_kind, r.title_overlap) for r in scored.collect()] == [("fragment", 1.0)]


def test_open_catalog_hashes_the_title_of_a_pair(spark):
    titles = spark.createDataFrame([("t", "rio azul")], "source_key string, title string")
    bodies = spark.createDataFrame([("c", "el río, río azul"), ("d", "la mar")], "candidate_key string, title string")
    found = matching.open_catalog_pairs(titles, bodies)
    assert "array_intersect(actual" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.candidate_key, r.shared, r.expected_tokens, r.title_coverage) for r in found.collect()] == [("c", 2, 2, 1.0)]


@pytest.mark.parametrize("bytes_held", [1 << 24, 0])
def test_open_catalog_of_any_size_keeps_rows_apart(spark, no_broadcast, monkeypatch, bytes_held):
    """Candidates of one key are judged one by one; nulls match nothing."""
    monkeypatch.setattr(matching, "_SMALL_CATALOG", bytes_held)
    titles = [("a", "rio azul mar"), ("b", "mar de fondo"), ("c", None), ("d", "")]
    bodies = [(1, "rio azul"), (1, "el mar de rio"), (1, "mar"), (2, None), (None, "rio azul mar"), (3, "fondo de otro"), (4, "nada")]
    found = matching.open_catalog_pairs(
        spark.createDataFrame(titles, "source_key string, title string"),
        spark.createDataFrame(bodies, "candidate_key int, title string"),
    )
    assert found.columns == ["candidate_key", "source_key", "shared", "expected_tokens", "title_coverage"]
    assert sorted(map(tuple, found.collect())) == [(1, "a", 2, 3, 2 / 3)] * 2 + [(1, "b", 2, 3, 2 / 3), (3, "b", 2, 3, 2 / 3)]


def test_open_catalog_exchanges_no_pairs(spark, no_broadcast):
    """A title met by every candidate is not sent along with each pair, and tokens that no title has stay where they are."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        titles = spark.createDataFrame([(f"t{k}", f"rio azul w{k}") for k in range(20)], "source_key string, title string")
        bodies = spark.createDataFrame([(k, f"rio azul x{k}") for k in range(50)], "candidate_key int, title string")
        found = matching.open_catalog_pairs(titles, bodies)
        plan = found._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "candidate_key" in line]
        assert dealt and all("REPARTITION_BY_NUM" in line for line in dealt)
        assert {len(r.actual) for r in _staged_bags(spark, plan).collect()} == {2}
        assert found.count() == 20 * 50
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def _staged_bags(spark, plan):
    import re

    return spark.read.parquet(re.search(r"file:[^\]\s,]*open-bags-[0-9a-f]+", plan)[0])
