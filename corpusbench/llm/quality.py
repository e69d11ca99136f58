"""Quality rules as a ledger: every rule evaluated once into failure bits, policies applied to the bits."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbench.llm.common import GAPS

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rule fails a document where ``fails`` is true; its place in the list of rules is its bit."""

    name: str
    fails: Callable[[], Column]


RULES = (
    Rule("few_words", lambda: F.col("n_words") < 50),
    Rule("repeated_words", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("repeated_lines", lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
    Rule("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule("long_words", lambda: F.col("word_chars") > 20 * F.col("n_words")),
)
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": tuple(rule.name for rule in RULES),
}
CURRENT = "v2"


def measure(documents: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``documents`` with the measurements of MEASURES, all of whole texts; columns of those names are replaced.

    Words are ``[^\\x20\\x09-\\x0D]+``.  word_chars: code points in words; n_symbols: characters
    ``#*$%&|<>``; n_lines: lines with a word; n_dup_lines: those equal to an earlier one;
    n_repeat_words: words inside windows of three words that the text has more than once, told by
    64-bit hashes.  A null or empty text measures 0 everywhere.  Every value is computed inside its
    row: nothing is shuffled, and a text of any length is one array at most.
    """
    kept = documents.select([c for c in documents.columns if c not in MEASURES])
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, GAPS, "")) > 0)
    # Each step is a column of its own, so that what several later steps use is computed once.
    parts = kept.withColumns({
        "_text": text,
        "_words": F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""),
        "_lines": lines,
    })
    counted = parts.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate("_text", GAPS, "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": _windows("_words"),
    })
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    sortable = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    told = counted.withColumn("_sorted", F.when(repeated, F.sort_array(sortable)).otherwise(F.array()))
    places = told.withColumn("_places", _repeated_places("_sorted"))
    covered = places.withColumn("n_repeat_words", _covered("_places"))
    # As the output of a generator the measurements are never copied into a filter that is pushed down.
    return covered.select(*kept.columns, F.inline(F.array(F.struct(*MEASURES))))


def _windows(words: str) -> Column:
    """A hash for every window of three words."""
    last = F.size(words) - 2
    starts = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    word = lambda i: F.get(F.col(words), i)
    return F.transform(starts, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))


def _repeated_places(ordered: str) -> Column:
    """Places of the windows whose hash stands beside an equal one in sorted order, in rising order."""
    hash_at = lambda k: F.get(F.col(ordered), k)["h"]
    twin = lambda x, k: (x["h"] == hash_at(k - 1)) | (x["h"] == hash_at(k + 1))
    return F.sort_array(F.transform(F.filter(F.col(ordered), lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"]))


def _covered(places: str) -> Column:
    """Words under windows of three that start at the given places."""
    step = lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col(places), k + 1) - p, F.lit(3)))
    steps = F.transform(F.col(places), step)
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)


def ledger(documents: DataFrame, rules: Iterable[Rule] = RULES, *, text_col: str = "text") -> DataFrame:
    """``documents`` with measurements and ``failures``, whose bit k is set where rule k fails the document."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(documents, text_col=text_col).withColumn("failures", bits)


def policy_mask(policy: Iterable[str], rules: Iterable[Rule] = RULES) -> int:
    """The bits of a policy's rules; an unknown name is refused."""
    place = {rule.name: k for k, rule in enumerate(rules)}
    return sum(1 << place[name] for name in set(policy))


def passes(policy: Iterable[str], rules: Iterable[Rule] = RULES) -> Column:
    """Whether a ledger row fails none of the policy's rules."""
    return F.col("failures").bitwiseAND(F.lit(policy_mask(policy, rules))) == 0


def ablations(entries: DataFrame, policy: Iterable[str], rules: Iterable[Rule] = RULES) -> DataFrame:
    """For each rule of a policy: rule, n_failed, n_failed_alone (those the policy keeps without the rule), n_rejected.

    Documents are first counted by their failure bits, of which there are at most 2 ** rules.
    """
    rules = tuple(rules)
    chosen = [(rule.name, 1 << k) for k, rule in enumerate(rules) if rule.name in set(policy)]
    inside = F.col("failures").bitwiseAND(F.lit(policy_mask(policy, rules)))
    by_bits = entries.groupBy(inside.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in chosen)))
    spread = by_bits.select("bits", "n", each.alias("r")).select("bits", "n", "r.rule", "r.bit")
    counted = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return spread.groupBy("rule").agg(
        counted(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        counted(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        counted(F.col("bits") != 0).alias("n_rejected"),
    )
