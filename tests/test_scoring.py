import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusbench.contracts.rules import duplicates
from corpusbench.functions import alignment
from corpusbench.operators import bootstrap, scoring

C = F.col


def table_alignment(ref, hyp):
    """The plain distance table with the tie rule, as a check."""
    above = [(j, 0, 0, j) for j in range(len(hyp) + 1)]
    for a, token in enumerate(ref, 1):
        row = [(a, 0, a, 0)]
        for j, other in enumerate(hyp, 1):
            if token == other:
                row.append(above[j - 1])
                continue
            choices = [above[j - 1], above[j], row[j - 1]]
            pick = min(range(3), key=lambda k: (choices[k][0], k))
            cell = list(choices[pick])
            cell[0] += 1
            cell[pick + 1] += 1
            row.append(tuple(cell))
        above = row
    return (*above[-1][1:], len(ref))


@pytest.mark.parametrize(
    "ref, hyp, counts",
    [
        ("abc", "abc", (0, 0, 0, 3)), ("abc", "axc", (1, 0, 0, 3)), ("abc", "ac", (0, 1, 0, 3)),
        ("ac", "abc", (0, 0, 1, 2)), ("", "x", (0, 0, 1, 0)), ("x", "", (0, 1, 0, 1)),
    ],
)
def test_alignment_goldens(ref, hyp, counts):
    assert alignment.align(ref, hyp) == counts


def test_alignment_of_all_short_sequences():
    words = ["".join(p) for n in range(5) for p in itertools.product("ab", repeat=n)]
    for ref, hyp in itertools.product(words, words):
        assert alignment.align(ref, hyp) == table_alignment(ref, hyp)


def test_alignment_of_random_sequences():
    rng = random.Random(7)
    for _ in range(3000):
        letters = rng.choice(["ab", "abcd", "abcdefghij"])
        ref, hyp = ("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2))
        assert alignment.align(ref, hyp) == table_alignment(ref, hyp)


@pytest.mark.parametrize("kept_bits", [0, 1 << 26])
def test_windowed_alignment_is_exact(monkeypatch, kept_bits):
    """Windows and block-wise recomputation, forced onto short sequences."""
    monkeypatch.setattr(alignment, "_BANDED_ROWS", 0)
    monkeypatch.setattr(alignment, "_KEPT_BITS", kept_bits)
    rng = random.Random(19)
    for k in range(2000):
        letters = rng.choice(["ab", "abcd", "abcdefgh"])
        ref = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        if k % 3:
            hyp = "".join(c if rng.random() > 0.2 else rng.choice(["", "z", c + c, "a"]) for c in ref)
        else:
            hyp = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert alignment.align(ref, hyp) == table_alignment(ref, hyp)


def test_three_forms_agree(spark):
    rng = random.Random(3)
    rows = [tuple([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "r array<string>, h array<string>").repartition(4)
    found = frame.select(
        "r", "h", alignment.edit_counts(C("r"), C("h")).alias("udf"), alignment.native_edit_counts(C("r"), C("h")).alias("native")
    ).collect()
    for row in found:
        assert tuple(row.udf) == tuple(row.native) == table_alignment(row.r, row.h)


def test_null_texts_have_no_counts(spark):
    frame = spark.createDataFrame([(None, "a")], "r string, h string")
    counts = frame.select(alignment.word_edit_counts(C("r"), C("h")).alias("e")).first().e
    assert counts is None or counts.s is None


def scored(spark, rows):
    frame = spark.createDataFrame(
        [(f"s{i}", g, r, h) for i, (g, r, h) in enumerate(rows)],
        "sample_id string, group_id string, reference string, hypothesis string",
    )
    return scoring.score_utterances(frame.withColumn("coverage", F.lit("scored")), keep_texts=True)


@pytest.mark.parametrize(
    "ref, hyp, wer, cer",
    [("casa", "caso", 1.0, 0.25), ("", "hola mundo", None, None), ("hola mi gente", "", 1.0, 1.0), ("hola", "hola uno dos", 2.0, 1.5)],
)
def test_utterance_rates(spark, ref, hyp, wer, cer):
    row = scoring.with_rates(scored(spark, [("g", ref, hyp)])).first()
    assert (row.wer, row.cer) == (wer, cer)


def test_words_are_aligned_once_and_beside_no_other_worker(spark):
    references = spark.createDataFrame([("a", "g", "uno dos")], "sample_id string, group_id string, text string")
    recognitions = spark.createDataFrame([("a", "uno", "ok")], "sample_id string, text string, status string")
    told = scoring.score_utterances(scoring.classify_coverage(references, recognitions))
    for table in (scoring.corpus_score(told), scoring.silence_controls(told)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.count("_word_counts(") == 1  # a filter by silence is no second alignment
        assert plan.count("ArrowEvalPython") == 2
        assert plan.index("_word_counts(") < plan.index("REPARTITION_BY_NUM") < plan.index("_compose(")


def test_silence_is_told_from_the_reference(spark):
    texts = ["", "...", " \u00a0\x1c", "\u0301", "a", "4", "e\u0301", "\u2167", "İ", None]
    rows = scored(spark, [("g", t, h) for t in texts for h in ("uno", "", None)]).collect()
    assert {r.is_silence for r in rows} == {True, False, None}
    assert [r.is_silence for r in rows] == [None if r.w_n is None else r.w_n == 0 for r in rows]


def test_silence_insertions(spark):
    row = scored(spark, [("g", "...", "hola mundo")]).first()
    assert row.is_silence and (row.w_i, row.c_i) == (2, 9)


def test_corpus_rate_is_not_the_mean_of_file_rates(spark):
    rows = scored(spark, [("g", "uno", "dos"), ("g", "a b c d e f g h i", "a b c d e f g h i")])
    assert scoring.corpus_score(rows).first().wer == pytest.approx(0.1)
    assert scoring.mean_file_rates(rows).first().mean_file_wer == pytest.approx(0.5)


def coverage_inputs(spark):
    refs = spark.createDataFrame(
        [("ok", "g", "hola"), ("bad", "g", "x"), ("gone", "g", "y"), ("quiet", "g", "")], "sample_id string, group_id string, text string"
    )
    recs = spark.createDataFrame(
        [("ok", "", "ok", None), ("bad", None, "failed", "e"), ("quiet", "ruido", "ok", None), ("extra", "z", "ok", None)],
        "sample_id string, text string, status string, error string",
    )
    return refs, recs


def test_coverage_and_silence(spark):
    report = scoring.evaluate(*coverage_inputs(spark))
    cover = report.coverage.first()
    assert (cover.expected, cover.scored, cover.missing, cover.failed, cover.unexpected) == (4, 2, 1, 1, 1)
    assert (cover.rate, cover.complete) == (0.5, False)
    speech = report.speech.first()
    assert (speech.w_d, speech.w_n) == (1, 1)
    silence = report.silence.collect()
    assert [(r.sample_id, r.w_i) for r in silence] == [("quiet", 1)]
    details = {(r.coverage, r.sample_id) for r in report.coverage_details.collect()}
    assert details == {("missing", "gone"), ("failed", "bad"), ("unexpected", "extra")}


def test_empty_corpus_has_no_rate(spark):
    refs, recs = coverage_inputs(spark)
    none = scoring.evaluate(refs.where("false"), recs.where("false"))
    cover = none.coverage.first()
    assert (cover.expected, cover.rate, cover.complete) == (0, None, False)
    assert none.speech.first().wer is None


def test_scores_do_not_depend_on_partitions(spark):
    refs, recs = coverage_inputs(spark)
    small = scoring.evaluate(refs.coalesce(1), recs.coalesce(1)).utterances.collect()
    wide = scoring.evaluate(refs.repartition(7), recs.repartition(5)).utterances.collect()
    assert sorted(small) == sorted(wide)


def test_duplicates(spark):
    frame = spark.createDataFrame([("a",), ("a",), ("b",)], "sample_id string")
    assert [tuple(r) for r in duplicates(frame, "sample_id").collect()] == [("a", 2)]


def test_performance_policies(spark):
    rows = spark.createDataFrame(
        [(True, 2.0, 4.0, 10), (True, 1.0, None, 30), (False, 9.0, 9.0, 99), (True, None, 5.0, 50)],
        "has_transcript boolean, elapsed_seconds double, audio_seconds double, process_rss_peak_bytes bigint",
    )
    summary = scoring.performance_summary(rows).first()
    assert (summary.measured_samples, summary.real_time_factor, summary.process_rss_peak_bytes) == (2, 0.75, 30)
    assert scoring.performance_summary(rows, rtf_policy="paired").first().real_time_factor == 0.5
    assert scoring.performance_summary(rows.where("false")).first().real_time_factor is None


# --- bootstrap ------------------------------------------------------------------------------------


def counted(spark, groups=12, per_group=3):
    rng = random.Random(1)
    rows = []
    for g in range(groups):
        for k in range(per_group):
            n = rng.randint(1, 9)
            rows.append((f"{g}-{k}", f"g{g:02d}", rng.randint(0, n), rng.randint(0, 2), rng.randint(0, 2), n, rng.randint(0, n), 1, 1, n * 5, False))
    columns = "sample_id string, group_id string, " + ", ".join(f"{c} bigint" for c in scoring.COUNT_COLUMNS) + ", is_silence boolean"
    return spark.createDataFrame(rows, columns), rows


def percentile(values, p):
    ordered = sorted(values)
    position = (len(ordered) - 1) * p
    low = int(position)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] * (1 - (position - low)) + ordered[high] * (position - low)


def test_intervals_do_not_depend_on_row_order(spark):
    frame, _ = counted(spark)
    first = bootstrap.bootstrap_intervals(frame.repartition(5), replicates=60).first()
    second = bootstrap.bootstrap_intervals(frame.orderBy(F.rand(3)).coalesce(1), replicates=60).first()
    assert first == second


def test_group_numbers_are_dense(spark):
    groups = spark.range(500).select(F.concat(F.lit("g"), "id").alias("group_id"))
    numbered = bootstrap.number_groups(groups)
    assert sorted(r.slot for r in numbered.collect()) == list(range(500))
    assert {r.group_count for r in numbered.collect()} == {500}


def test_too_few_groups_have_a_reason(spark):
    frame, _ = counted(spark, groups=1)
    found = bootstrap.bootstrap_intervals(frame, replicates=10).first()
    assert found.wer_lower is None and found.valid_wer_replicates == 0
    assert found.reason == "fewer than two groups with speech"


def test_disabled_bootstrap(spark):
    frame, _ = counted(spark)
    found = bootstrap.bootstrap_intervals(frame, replicates=0).first()
    assert (found.reason, found.wer_lower, found.group_count) == ("no replicates were asked for", None, 12)


def test_bootstrap_parameters(spark):
    frame, _ = counted(spark)
    for bad in ({"replicates": -1}, {"confidence": 1.0}):
        with pytest.raises(ValueError):
            bootstrap.bootstrap_intervals(frame, **bad)


def test_paired_difference_of_equal_models_is_zero(spark):
    frame, _ = counted(spark)
    found = bootstrap.paired_difference(frame, frame, replicates=50).first()
    assert (found.wer_difference_lower, found.cer_difference_upper) == (0.0, 0.0)


def test_percentile_interpolates(spark):
    frame = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "v double")
    assert frame.agg(bootstrap.percentile(C("v"), 0.025)).first()[0] == pytest.approx(1.075)


def test_duplicate_ids_are_told_and_not_scored(spark):
    references = spark.createDataFrame(
        [("a", "g", "uno dos"), ("b", "g", "tres"), ("b", "h", "tres"), ("c", "g", "x"), (None, "g", "y"), (None, "g", "z")],
        "sample_id string, group_id string, text string",
    )
    recognitions = spark.createDataFrame(
        [("a", "uno", "ok", None), ("a", "uno", "ok", None), ("b", "tres", "ok", None), ("c", "x", "ok", None)],
        "sample_id string, text string, status string, error string",
    )
    report = scoring.evaluate(references, recognitions)
    coverage = report.coverage.first()
    assert (coverage.expected, coverage.scored, coverage.duplicate, coverage.complete) == (4, 1, 3, False)
    assert [(r.sample_id, r.w_n) for r in report.utterances.collect()] == [("c", 1)]
    details = {(r.coverage, r.sample_id) for r in report.coverage_details.collect()}
    assert details == {("duplicate", "a"), ("duplicate", "b"), ("duplicate", None)}


def test_written_scores_give_the_same_report(spark, tmp_path):
    references = spark.createDataFrame([("a", "g", "uno dos"), ("b", "g", "tres")], "sample_id string, group_id string, text string")
    recognitions = spark.createDataFrame([("a", "uno", "ok"), ("b", "tres", "ok")], "sample_id string, text string, status string")
    kept = scoring.evaluate(references, recognitions, scored_path=str(tmp_path / "scored"))
    assert kept.speech.collect() == scoring.evaluate(references, recognitions).speech.collect()
    with pytest.raises(Exception, match="EXISTS"):
        scoring.evaluate(references, recognitions, scored_path=str(tmp_path / "scored"))


def test_grouped_percentiles(spark):
    rng = random.Random(5)
    rows = [("a", rng.choice([1.0, 2.5, 2.5, 1e9])) for _ in range(500)] + [("b", rng.gauss(0, 1)) for _ in range(301)]
    rows += [("c", 7.0), ("d", None), ("e", -3.0), ("e", 5.0)]
    frame = spark.createDataFrame(rows, "k string, v double")
    wanted = {"low": 0.025, "half": 0.5, "high": 0.975, "all": 1.0}
    found = {r.k: r for r in bootstrap.grouped_percentiles(frame, ["k"], "v", wanted).collect()}
    assert set(found) == {"a", "b", "c", "e"}
    for key in found:
        own = [v for k, v in rows if k == key]
        for name, p in wanted.items():
            assert found[key][name] == pytest.approx(percentile(own, p))


def test_bootstrap_aligns_once(spark):
    references = spark.createDataFrame([(f"s{k}", f"g{k % 4}", "uno dos tres") for k in range(20)], "sample_id string, group_id string, text string")
    recognitions = spark.createDataFrame([(f"s{k}", "uno dos", "ok") for k in range(20)], "sample_id string, text string, status string")
    scored = scoring.score_utterances(scoring.classify_coverage(references, recognitions))
    for table in (bootstrap.bootstrap_intervals(scored, replicates=20), bootstrap.paired_difference(scored, scored, replicates=20)):
        assert "Python" not in table._jdf.queryExecution().optimizedPlan().toString()
        assert table.first().group_count == 4


def test_draws_spread_over_groups_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "BUCKET_GROUPS", 16)
    groups = spark.range(100).select(F.concat(F.lit("g"), "id").alias("group_id"), F.lit(1).alias("n"), *(F.when(C("id") == k, 1).otherwise(0).alias(f"n{k}") for k in range(4)))
    found = bootstrap.resample(groups, ["n", "n0", "n1", "n2", "n3"], replicates=4000, seed=7).collect()
    assert len(found) == 4000 and {(r.group_count, r.n) for r in found} == {(100, 100)}
    for k in range(4):  # a group is drawn once on average, with the variance of 100 draws out of 100
        counts = [r[f"n{k}"] for r in found]
        mean = sum(counts) / len(counts)
        variance = sum((c - mean) ** 2 for c in counts) / len(counts)
        assert abs(mean - 1) < 0.06 and abs(variance - 0.99) < 0.1
    together = sum(r.n0 * r.n1 for r in found) / len(found)
    assert abs(together - 0.99) < 0.06
    other = bootstrap.resample(groups, ["n0"], replicates=50, seed=8).orderBy("replicate").collect()
    same = bootstrap.resample(groups, ["n0"], replicates=50, seed=7).orderBy("replicate").collect()
    assert [r.n0 for r in same] == [r.n0 for r in sorted(found)[:50]] != [r.n0 for r in other]


def test_draws_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "BUCKET_GROUPS", 4096)
    groups = spark.range(3000).select(C("id").cast("string").alias("group_id"), F.lit(1).alias("n"))
    sums = bootstrap.resample(groups, ["n"], replicates=300, seed=1)
    sums.collect()
    plan = sums._jdf.queryExecution().executedPlan()
    nodes, written = [plan], []
    while nodes:
        node = nodes.pop()
        if node.metrics().contains("shuffleRecordsWritten"):
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(node.plan())
        children = node.children()
        nodes.extend(children.apply(k) for k in range(children.size()))
    assert written and max(written) <= 2 * 3000 + 300 < 300 * 3000


def test_percentiles_of_heavy_tails_gather_little(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("tail", math.exp(rng.gauss(0, 6))) for _ in range(40_000)] + [("same", 1.0)] * 3000 + [("small", float(k)) for k in range(7)]
    frame = spark.createDataFrame(rows, "k string, v double")
    gathered = []
    near = bootstrap._near

    def told(beside, keys):
        out = near(beside, keys)
        gathered.append({(r.k, r._place): r["count"] for r in out.select("k", "_place", "_v").distinct().groupBy("k", "_place").count().collect()})
        return out

    monkeypatch.setattr(bootstrap, "_near", told)
    wanted = {"low": 0.025, "half": 0.5, "high": 0.999}
    found = {r.k: r for r in bootstrap.grouped_percentiles(frame, ["k"], "v", wanted).collect()}
    for key in ("tail", "same", "small"):
        own = [v for k, v in rows if k == key]
        for name, p in wanted.items():
            assert found[key][name] == pytest.approx(percentile(own, p))
    assert max(gathered[0].values()) <= 40_000 * 0.0015
