"""Text identity: the three normalizers, their tokens and the ids derived from them.

Each normalizer has its own rule and none may stand in for another: scoring keeps accents, catalog
identity drops them, and matching also drops whatever has no ASCII form.  Two of the three map one
code point at a time, so they run as built-in expressions for every Unicode text.  Canonical
composition does not, so an Arrow UDF composes the few texts that hold a code point which could
change; all other texts reach it as NULL.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words a poem title is not matched on.
POEM_STOP_WORDS = ("a", "al", "de", "del", "el", "en", "la", "las", "los", "un", "una", "y")

# Whitespace as Python's str.split() sees it, spelled for a Java regular expression.
_SPACE = r"[\t-\r\x1C-\x20\x85\xA0  -     　]+"


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def _compat_fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def collapse_space(text: Column) -> Column:
    """Whitespace runs become one space; leading and trailing ones go."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def strip_text(text: Column) -> Column:
    """The text without white space at its ends; NULL when nothing is left."""
    return F.nullif(F.regexp_replace(text, rf"\A{_SPACE}|{_SPACE}\z", ""), F.lit(""))


def has_text(text: Column) -> Column:
    """Whether a text holds anything but white space; NULL for NULL."""
    return F.length(F.regexp_replace(text, _SPACE, "")) > 0


def composed(text: Column) -> Column:
    """NFC.  Texts below U+0300 are composed already and skip the UDF's work."""
    risky = text.rlike(r"[^\x{0}-\x{2FF}]")
    return F.coalesce(_compose(F.when(risky, text)), text)


def normalize_text(text: Column) -> Column:
    """Scoring form: composed, lower case, anything but letters and digits is a separator."""
    return F.trim(F.regexp_replace(F.lower(composed(text)), r"[^\p{L}\p{N}]+", " "))


def has_word(text: Column) -> Column:
    """Whether the scoring form holds a word; composing and lower case never make or unmake one."""
    return text.rlike(r"[\p{L}\p{N}]")


def split_words(normalized: Column) -> Column:
    """Words of an already normalized text; the empty text has none."""
    return F.array_remove(F.split(normalized, " "), "")


def split_characters(normalized: Column) -> Column:
    """Characters of an already normalized text, spaces excluded."""
    return F.array_remove(F.split(F.replace(normalized, F.lit(" "), F.lit("")), ""), "")


def word_tokens(text: Column) -> Column:
    return split_words(normalize_text(text))


def character_tokens(text: Column) -> Column:
    return split_characters(normalize_text(text))


@cache
def _fold_tables(ascii_only: bool) -> tuple[str, str, str, dict[str, str]]:
    """Derive the per-code-point rule: one-to-one pairs, deletions and one-to-many expansions.

    ``ascii_only`` is the matching rule (what has no ASCII form vanishes); otherwise it is the
    catalog rule (combining marks vanish, the rest separates words).
    """
    source, target, deleted, longer = [], [], [], {}
    # beyond this plane nothing decomposes to ASCII and nothing combines
    for code in range(0x80, 0x20000):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        char = chr(code)
        parts = unicodedata.normalize("NFKD", char)
        if ascii_only:
            folded = parts.encode("ascii", "ignore").decode().casefold()
            if not folded:
                continue
        else:
            kept = "".join(c for c in parts if not unicodedata.combining(c))
            if not kept:
                deleted.append(char)
                continue
            folded = kept.casefold()
        if not any(c.isascii() and c.isalnum() for c in folded):
            if not ascii_only:
                continue  # a separator either way
            folded = " "
        if len(folded) == 1 and code <= 0xFFFF:
            source.append(char)
            target.append(folded)
        else:
            longer[char] = folded
    return "".join(source), "".join(target), "".join(deleted), longer


def _regex_class(chars: list[str]) -> str:
    """A character class over code points, runs joined."""
    spans: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


def _expanded(text: Column, longer: dict[str, str]) -> Column:
    """Spell out code points that fold to several characters; only texts holding one pay for it."""
    pairs = "\x1e".join(f"{char}\x1f{folded}" for char, folded in longer.items())
    table = F.str_to_map(F.lit(pairs), F.lit("\x1e"), F.lit("\x1f"))
    spelled = F.array_join(
        F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ""
    )
    # the cheap first test settles most texts
    holds_one = text.rlike(r"[^\x00-\x7F\xC0-\xFF]") & text.rlike(_regex_class(list(longer)))
    return F.when(holds_one, spelled).otherwise(text)


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _folded(text: Column, ascii_only: bool) -> Column:
    """The rule of ``_fold_tables`` in lower case; it maps nothing in a text of ASCII only."""
    source, target, deleted, longer = _fold_tables(ascii_only)
    common = F.replace(text, F.lit("ß"), F.lit("" if ascii_only else "ss"))
    rest = {k: v for k, v in longer.items() if k != "ß"}
    narrow = F.translate(common, source + deleted, target)
    return F.lower(F.when(_is_ascii(text), text).otherwise(_expanded(narrow, rest)))


def normalized_identity(text: Column) -> Column:
    """Catalog form: accents dropped, case folded, runs of a-z and 0-9 joined by spaces."""
    return F.trim(F.regexp_replace(_folded(text, False), r"[^a-z0-9]+", " "))


def ascii_words(text: Column) -> Column:
    """Matching form: non-ASCII characters vanish, then runs of a-z and 0-9, in order."""
    folded = _folded(text, True)
    kept = F.when(_is_ascii(folded), folded).otherwise(F.regexp_replace(folded, r"[^\x00-\x7F]+", ""))
    return F.array_remove(F.split(kept, r"[^a-z0-9]+"), "")


def ascii_tokens(text: Column) -> Column:
    return F.array_distinct(ascii_words(text))


def poem_tokens(text: Column) -> Column:
    """Distinct catalog-form words, without stop words and one-letter words."""
    return poem_words(normalized_identity(text))


def poem_words(form: Column) -> Column:
    """``poem_tokens`` of a text in catalog form."""
    words = F.array_distinct(split_words(form))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*POEM_STOP_WORDS))


def book_identity(text: Column) -> Column:
    """Compatibility form with full case folding; punctuation and accents stay."""
    plain = text.rlike(r"^[\x00-\x7F\xC0-\xD6\xD8-\xF6\xF8-\xFF]*$")
    native = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return collapse_space(F.when(plain, native).otherwise(_compat_fold(F.when(~plain, text))))


def _digest(left: Column, right: Column, length: int) -> Column:
    return F.substring(F.sha2(F.concat(left, F.lit("\x00"), right).cast("binary"), 256), 1, length)


def stable_book_id(title: Column, author: Column) -> Column:
    return F.concat(F.lit("book_"), _digest(book_identity(title), book_identity(author), 24))


def derive_source_id(title: Column, author: Column) -> Column:
    digest = _digest(normalized_identity(F.trim(title)), normalized_identity(F.trim(author)), 20)
    return F.concat(F.lit("poem-"), digest)


def sample_id_from_path(relative_path: Column) -> Column:
    """Relative path without its last suffix, folders joined by two underscores."""
    stem = F.regexp_replace(relative_path, r"(?<=[^/])\.[^./]*$", "")
    return F.replace(stem, F.lit("/"), F.lit("__"))
