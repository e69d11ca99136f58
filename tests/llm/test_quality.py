import re
from collections import Counter

from corpusbench.llm import quality
from tests.llm import brute
from tests.llm.fixtures import awkward_rows, documents

ODD = [
    "a b c a b c", "x y x y x y", "line one\nline one\n \n \nother\nline one", "### *** $$$ <a> | &", "ab\r\nab\r\n",
    "one two three four one two three", "a b c d", "😀 😀 😀 😀", "w " * 120, "a b c d\na b c d",
]


def measured(text):
    text = text or ""
    words = brute.words_of(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    repeat = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if brute.words_of(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
        len(lines) - len(set(lines)), len(repeat),
    )


def test_measures_bits_and_policies(spark):
    rows = awkward_rows() + [(800 + k, t) for k, t in enumerate(ODD)]
    docs = documents(spark, rows).withColumnRenamed("n_chars", "n_words")
    entries = quality.ledger(docs)
    assert "n_words" in entries.columns and entries.columns.count("n_words") == 1
    found = [(r.doc_id, *(r[m] for m in quality.MEASURES), r.failures) for r in entries.collect()]
    expected = []
    for doc_id, text in rows:
        n, chars, symbols, lines, dup, repeat = measured(text)
        fails = [n < 50, 100 * repeat > 50 * n, 10 * symbols > n, 2 * dup > lines, chars < 2 * n, chars > 20 * n]
        expected.append((doc_id, n, chars, symbols, lines, dup, repeat, sum(1 << k for k, f in enumerate(fails) if f)))
    assert sorted(found, key=brute.sort_key) == sorted(expected, key=brute.sort_key)

    for policy in quality.POLICIES.values():
        mask = quality.policy_mask(policy)
        kept = entries.where(quality.passes(policy)).count()
        assert kept == sum(not r[-1] & mask for r in expected)
        for r in quality.ablations(entries, policy).collect():
            bit = quality.policy_mask([r.rule])
            assert r.n_failed == sum(bool(x[-1] & bit) for x in expected)
            assert r.n_failed_alone == sum(x[-1] & mask == bit for x in expected)
            assert r.n_rejected == sum(bool(x[-1] & mask) for x in expected)


def test_empty_table(spark):
    entries = quality.ledger(documents(spark, []))
    assert entries.count() == 0
    assert quality.ablations(entries, quality.POLICIES["v2"]).count() == 0


def test_no_python_and_no_shuffle(spark):
    plan = quality.ledger(documents(spark, awkward_rows()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow", plan)
