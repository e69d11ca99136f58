"""URL filters: rules indexed by their rarest literal token, looked up by the tokens of a URL."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class SiteRule:
    """``host/path``: fits a host and its subdomains where the URL's path starts with the rule's."""

    text: str
    verdict: str

    @property
    def regex(self) -> str:
        host, slash, path = self.text.partition("/")
        return r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(slash + path)

    @property
    def shape(self) -> str:
        """The rule with ``^`` where a token certainly ends; a path may go on after its last character."""
        return "^" + self.text + ("" if self.text.endswith("/") else "*")


@dataclass(frozen=True)
class PatternRule:
    """Text found anywhere in the lower-cased host and path; ``^`` is a separator or an end, ``*`` anything."""

    text: str
    verdict: str = "block"

    @property
    def regex(self) -> str:
        parts = {"*": ".*", "^": "(?:[^a-z0-9]|^|$)"}
        return "".join(parts.get(c, re.escape(c)) for c in self.text)

    @property
    def shape(self) -> str:
        return "*" + self.text + "*"


SITES = (
    SiteRule("net/", "block"), SiteRule("example.net/en/", "allow"),
    SiteRule("example.com/de/", "block"), SiteRule("org/fr/", "allow"),
)
PATTERNS = tuple(
    PatternRule(f"^{word}^")
    for word in ("casino", "bets", "betting", "poker", "slots", "porn", "xxx", "viagra", "cialis", "payday")
)


def literal_tokens(rule: SiteRule | PatternRule) -> list[str]:
    """Tokens that every URL the rule fits must have as whole tokens: those a wildcard does not touch."""
    shape = rule.shape.lower()
    return sorted({m[0] for m in _TOKEN.finditer(shape) if "*" not in (shape[m.start() - 1 : m.start()], shape[m.end() : m.end() + 1])})


def parts(url: str = "url"):
    """Columns host and path of a URL; both empty if it is null or has no ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    rest = F.regexp_extract(text, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path")


def token_counts(pages: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """In how many rows of host and path each of the rules' tokens occurs, over all rows; the rest is not kept."""
    words = F.array_distinct(F.split(F.lower(F.concat("host", F.lit(" "), "path")), "[^a-z0-9]+"))
    found = pages.select(F.explode(words).alias("token")).where(F.col("token").isin(list(tokens)))
    counted = {r.token: r.n for r in found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {t: counted.get(t, 0) for t in tokens}


def rule_index(
    rules: Sequence[SiteRule | PatternRule], counts: dict[str, int]
) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest token (ties: the first by name), and those without any, which must always run."""
    index: dict[str, list[int]] = {}
    always: list[int] = []
    for k, rule in enumerate(rules):
        tokens = literal_tokens(rule)
        if tokens:
            index.setdefault(min(tokens, key=lambda t: (counts[t], t)), []).append(k)
        else:
            always.append(k)
    return index, always


def judge(
    pages: DataFrame, sites: Sequence[SiteRule] = SITES, patterns: Sequence[PatternRule] = PATTERNS,
    *, default: str = "allow", id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """Every page with host, path, the longest site rule that fits, the first pattern that fits, and a verdict.

    A site rule's verdict goes before a pattern's, and that before ``default``.  Each rule is filed
    under its rarest literal token by counts over all URLs; a URL's tokens fetch its candidates, and
    only their regular expressions run.  The index is as large as the rules and goes with the tasks;
    no row is shuffled but for the counts of the rules' own tokens.

    A null URL, or one without ``://``, has an empty host and path and gets the default unless a rule
    fits that.  Null ids and repeated rows are kept; an empty table gives an empty one.
    """
    rules = (*sites, *patterns)
    split = pages.select(F.col(id_col).alias("page_id"), *parts(url_col))
    tokens = sorted({t for rule in rules for t in literal_tokens(rule)})
    index, always = rule_index(rules, token_counts(split, tokens) if tokens else {})
    kind = split.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, host string, path string, rule string, pattern string, verdict string"
    return split.mapInPandas(lambda it: _judge(it, rules, index, always, default), schema)


def _judge(batches: Iterator[pd.DataFrame], rules, index, always, default) -> Iterator[pd.DataFrame]:
    compiled = [re.compile(rule.regex) for rule in rules]

    def told(host: str, path: str) -> tuple[str | None, str | None, str]:
        site, pattern = None, None
        whole = host + path
        lowered = whole.lower()
        fetched = {k for token in set(_TOKEN.findall(f"{host} {path}".lower())) for k in index.get(token, ())}
        for k in sorted({*fetched, *always}):
            rule = rules[k]
            if isinstance(rule, SiteRule):
                if compiled[k].match(whole) and (site is None or len(rule.text) > len(site.text)):
                    site = rule
            elif pattern is None and compiled[k].search(lowered):
                pattern = rule
        chosen = site or pattern
        return site and site.text, pattern and pattern.text, chosen.verdict if chosen else default

    for batch in batches:
        answers: dict[tuple[str, str], tuple] = {}
        rows = []
        for key in zip(batch["host"], batch["path"], strict=True):
            if key not in answers:
                answers[key] = told(*key)
            rows.append(answers[key])
        extra = pd.DataFrame(rows, columns=["rule", "pattern", "verdict"], dtype=object)
        yield pd.concat([batch.reset_index(drop=True), extra], axis=1)
