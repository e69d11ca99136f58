import hashlib
import zlib
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusbench.llm import superkmers
from tests.llm import brute
from tests.llm.fixtures import awkward_rows, documents, text
from tests.llm.test_hyperminhash import expected as near_groups
from tests.llm.test_language import grams_of
from tests.llm.test_quality import measured


def corpus():
    import random

    r = random.Random(11)
    rows = awkward_rows(7) + [(2000 + k, text(r, r.randint(60, 300))) for k in range(40)]
    base = text(r, 200).split()
    for k in range(12):
        words = list(base)
        words[r.randrange(200)] = "changed"
        rows.append((3000 + k, " ".join(words)))
    rows.append((4000, "### $$$ %%% " * 40))
    rows.append((4001, "1234 5678 90 " * 3 + " ".join(str(n) for n in range(300))))
    return [row for row in rows if row[0] is not None]


def test_stages_against_plain_code(spark, tmp_path):
    rows = list({(d, t): None for d, t in corpus()})
    rows = [row for k, row in enumerate(rows) if row[0] not in {d for d, _ in rows[:k]}]
    folder = str(tmp_path)
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")

    kept = []
    for doc_id, body in rows:
        n, chars, symbols, lines, dup, repeat = measured(body)
        if not (n < 50 or 100 * repeat > 50 * n or 10 * symbols > n or 2 * dup > lines or chars < 2 * n or chars > 20 * n):
            kept.append((doc_id, body))
    assert 4000 not in dict(kept) and 4001 in dict(kept)
    kept = [(d, t) for d, t in kept if grams_of(t)]
    assert 4001 not in dict(kept)
    groups = near_groups(kept, corpus_pipeline.NEAR)
    assert not all(g[3] for g in groups)
    kept = [row for row, g in zip(kept, groups, strict=True) if g[3]]
    cleaned = brute.repeated_words(kept, superkmers.WINDOW)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {d: t for d, t in kept}
    tokens = Counter()
    shas = {d: (sha, n, gone) for d, n, gone, sha in cleaned}
    for d, t in texts.items():
        sha, n, gone = shas[d]
        if gone:
            t = plain_rest(kept, d)
            assert hashlib.sha256(t.encode()).hexdigest() == sha and gone <= n
        tokens[d] = len(library.encode(t, add_special_tokens=False).ids) + 1

    found = corpus_pipeline.run(spark, folder)
    assert {r.doc_id: r.n for r in found.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == dict(tokens)

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert zlib.crc32(b"") == 0 and docs.count() == len(tokens)


def test_one_row_of_each_group_stays_whole(spark, tmp_path):
    """Repeated rows, copies without an id, and ids that come twice, from the first stage to the last."""
    import random

    r = random.Random(5)
    twice, lost, shared = text(r, 120), text(r, 130), [text(r, 140), text(r, 150)]
    rows = awkward_rows(7) + [(5000, twice)] * 3 + [(None, twice), (None, lost), (None, lost)]
    rows += [(5001, shared[0]), (5001, shared[1]), (5002, shared[1] + " more")]
    folder = str(tmp_path)
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, folder)
    came = [(d.doc_id, d.text) for d in docs.collect()]
    docs = corpus_pipeline.minhash_near_dedup(spark, docs, folder)
    left = Counter((d.doc_id, d.text) for d in docs.collect())

    labels = [g[2] for g in near_groups([(k, t) for k, (_, t) in enumerate(came)], corpus_pipeline.NEAR)]
    groups = {}
    for label, row in zip(labels, came, strict=True):
        groups.setdefault(label, set()).add(row)
    assert sum(left.values()) == len(groups) < len(came)
    for members in groups.values():
        (stays,) = [row for row in members if row in left]
        assert left[stays] == 1
        assert stays[0] == min((d for d, _ in members), key=lambda d: (d is None, d))
    assert {(5000, twice), (None, lost), (5001, shared[0]), (5001, shared[1])} <= set(left)

    cleaned = Counter((d.doc_id, d.text) for d in corpus_pipeline.substring_dedup(spark, docs, folder).collect())
    assert {(5000, twice), (None, lost), (5001, shared[0]), (5001, shared[1])} <= set(cleaned)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for (d, t), n in cleaned.items():
        want[d] += n * (len(library.encode(t, add_special_tokens=False).ids) + 1)
    found = corpus_pipeline.run(spark, folder)
    assert {r.doc_id: r.n for r in found.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == dict(want)


def test_language_stage_rejects_scripts_without_a_profile(spark):
    rows = [row for row in corpus() if grams_of(row[1] or "")]
    foreign = [(9000, "съешь ещё этих мягких французских булок " * 12), (9001, "色は匂へど散りぬるを " * 30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    cells = [(d, t, "en", "s", len(t)) for d, t in rows] + [(d, t, None, "s", len(t)) for d, t in foreign]
    told = corpus_pipeline.language_id(spark, spark.createDataFrame(cells, schema), "")
    assert Counter(r.doc_id for r in told.collect()) == Counter(d for d, _ in rows)


def test_columns_named_like_an_operators_own_stay(spark):
    own = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "failures", "lang_pred", "score"]
    own += ["n_removed", "kept_text", "kept_sha256", "k1", "t1", "payload", "component_id", "kept", "spans"]
    rows = [row for row in corpus() if row[0] >= 2000 and row[0] < 3010]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in own)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t), *(f"{c} of {d}" for c in own)) for d, t in rows], schema)
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns
    found = docs.collect()
    assert len(found) > 40 and all(r[c] == f"{c} of {r.doc_id}" for r in found for c in own)


def plain_rest(rows, doc_id):
    lists = [brute.words_of(t) for _, t in rows]
    w = superkmers.WINDOW
    counts = Counter(tuple(x[i : i + w]) for x in lists for i in range(len(x) - w + 1))
    words = brute.words_of(dict(rows)[doc_id])
    gone = {i + j for i in range(len(words) - w + 1) if counts[tuple(words[i : i + w])] > 1 for j in range(w)}
    return " ".join(x for i, x in enumerate(words) if i not in gone)


def test_empty_documents(spark, tmp_path):
    documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
