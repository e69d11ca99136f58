"""Strict JSON objects as columns: closed field sets, exact JSON types, no duplicate keys.

Spark's JSON reader drops unknown fields and keeps one of two equal keys, and no built-in tells duplicate
keys, the types as written and what follows the value in one go.  So raw texts pass a tokenizer once,
whole Arrow batches at a time, and everything is told from that pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SQL_TYPES = {"string": "string", "int": "bigint", "number": "double", "bool": "boolean"}
_ISSUES = T.ArrayType(T.StructType([T.StructField("rule", T.StringType()), T.StructField("message", T.StringType())]))
_SPACE = " \t\n\r"


class Field(NamedTuple):
    """One field of a closed object.  ``sql_type`` overrides the column type, for nested fields."""

    name: str
    kind: str = "string"
    nullable: bool = False
    optional: bool = False
    sql_type: str | None = None


def sql_schema(fields: Sequence[Field]) -> str:
    return ", ".join(f"`{f.name}` {f.sql_type or _SQL_TYPES.get(f.kind, 'string')}" for f in fields)


class _Object(list):
    """Names and values of an object, as written."""


class _Number(str):
    """A number that is not written as a whole one."""


class _Tokens:
    """Reads the first JSON value of a text and remembers whether any object in it repeats a key."""

    def __init__(self):
        self.decoder = json.JSONDecoder(object_pairs_hook=self._object, parse_float=_Number, parse_constant=self._constant)
        self.repeats = 0

    def _object(self, pairs: list[tuple[str, Any]]) -> _Object:
        self.repeats += _repeats(pairs)
        return _Object(pairs)

    @staticmethod
    def _constant(name: str) -> None:
        raise ValueError(f"{name} is no JSON value")

    def read(self, text: str | None) -> tuple[Any, bool]:
        """The value, and whether nothing follows it and no object in it repeats a key; (None, False) if there is none."""
        self.repeats = 0
        if text is None:
            return None, False
        try:
            value, end = self.decoder.raw_decode(text, len(text) - len(text.lstrip(_SPACE)))
        except (ValueError, RecursionError):
            return None, False
        return value, not self.repeats and not text[end:].strip(_SPACE)


def _repeats(pairs: Iterable[tuple[str, Any]]) -> bool:
    names = [name for name, _ in pairs]
    return len(set(names)) < len(names)


def _fits(value: Any, field: Field) -> bool:
    """Whether a value is of a field's type; whole numbers are written as such and fit 64 bits."""
    if value is None:
        return field.nullable
    if isinstance(value, bool):
        return field.kind == "bool"
    if isinstance(value, int):
        return field.kind == "number" or field.kind == "int" and -(1 << 63) <= value < 1 << 63
    if isinstance(value, _Number):
        return field.kind == "number"
    return {"string": str, "array": list, "object": _Object}.get(field.kind, _Number) is type(value)


def _problems(tokens: _Tokens, text: str | None, fields: Sequence[Field]) -> list[dict[str, str]]:
    value, alone = tokens.read(text)
    found: list[tuple[str, str]] = []
    is_object = isinstance(value, _Object)
    repeated = is_object and _repeats(value)
    if repeated:
        found.append(("duplicate_key", "duplicate keys"))
    elif not is_object or not alone:
        found.append(("json", "not a JSON object, or one with duplicate keys inside"))
    if is_object:
        names = {name for name, _ in value}
        missing = sorted(f.name for f in fields if not f.optional and f.name not in names)
        unknown = sorted(names - {f.name for f in fields})
        if missing:
            found.append(("missing", f"missing fields: {', '.join(missing)}"))
        if unknown:
            found.append(("unknown", f"unknown fields: {', '.join(unknown)}"))
        if not tokens.repeats:  # which of two equal keys counts is not for us to say
            own = dict(value)
            found.extend(
                ("type", f"{f.name} must be of type {f.kind}") for f in fields if f.name in own and not _fits(own[f.name], f)
            )
    return [{"rule": rule, "message": message} for rule, message in found]


def object_issues(text: Column, fields: Sequence[Field]) -> Column:
    """Array of (rule, message) that keep a JSON text from being an object of these fields.

    A null or unreadable text, another value than an object, and text behind the object are ``json``; with
    a key that comes twice, the fields' names are still checked, but not their types.
    """
    fields = tuple(fields)

    @F.pandas_udf(_ISSUES)
    def issues(texts: pd.Series) -> pd.Series:
        tokens = _Tokens()
        return pd.Series([_problems(tokens, t, fields) for t in texts], dtype=object)

    return issues(text)
