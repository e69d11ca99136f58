"""Small classifications and parses used inside table jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusbench.functions.text import normalized_identity

# Markers looked for inside a candidate title, in order of precedence.
CONTENT_KINDS = (
    ("fragment", ("fragmento", "extracto", "parcial")),
    ("recitation", ("recitacion", "recita", "recitando", "declamacion")),
    ("dramatization", ("dramatizacion", "drama", "teatral", "teatro")),
    ("reading", ("lectura", "leyendo")),
    ("performance", ("performance", "presentacion", "actuacion")),
    ("audio_poetry", ("audiopoesia", "audio poesia")),
)
# Words that mark an audiobook candidate as incomplete.
PARTIAL_MARKERS = ("fragmento", "fragmentos", "extracto", "parcial")
# Metadata fields kept as provenance.
PROVENANCE_FIELDS = (
    "id", "title", "extractor", "webpage_url", "duration", "format_id", "ext", "acodec",
)
# Exception families behind one failure code.
INVALID_ARGUMENT_ERRORS = ("ValueError", "TypeError", "FileNotFoundError", "KeyError")
MISSING_DEPENDENCY_ERRORS = ("ImportError", "ModuleNotFoundError")


def content_kind(title: Column) -> Column:
    """First kind one of whose markers occurs anywhere in the catalog form of the title."""
    # through a one-element array, so the form is computed once and not once per marker
    return F.get(F.transform(F.array(normalized_identity(title)), kind_of_form), F.lit(0))


def kind_of_form(form: Column) -> Column:
    """``content_kind`` of a title in catalog form."""
    chain = F.when(F.lit(False), "")
    for kind, markers in CONTENT_KINDS:
        chain = chain.when(reduce(lambda a, b: a | b, [form.contains(m) for m in markers]), kind)
    return chain.otherwise("other")


def display_duration(text: Column) -> Column:
    """Seconds of ``MM:SS`` or ``HH:MM:SS``; NULL when the text is no positive duration."""
    shape = F.trim(text)
    ok = shape.rlike(r"^\d+:0*[0-5]?\d$") | shape.rlike(r"^\d+:0*[0-5]?\d:0*[0-5]?\d$")
    parts = F.transform(F.split(F.when(ok, shape), ":"), lambda p: p.try_cast("bigint"))
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 60 + p)
    return F.when(total > 0, total.cast("double"))


def http_failure(status: Column) -> Column:
    """(code, retryable) of a fetch status; NULL for 2xx."""
    code = (
        F.when(status.isin(401, 403), "authentication")
        .when(status == 429, "rate_limit")
        .otherwise("http_error")
    )
    retryable = (status == 429) | (status >= 500)
    return F.when(
        ~status.between(200, 299), F.struct(code.alias("code"), retryable.alias("retryable"))
    )


def failure_code(families: Column, message: Column) -> Column:
    """Code of a failure from the names of its class and all its bases, and its message."""

    def one_of(*names: str) -> Column:
        return F.arrays_overlap(families, F.array(*map(F.lit, names)))

    memory = one_of("RuntimeError") & F.contains(F.lower(message), F.lit("out of memory"))
    return (
        F.when(one_of(*MISSING_DEPENDENCY_ERRORS), "dependency_missing")
        .when(one_of(*INVALID_ARGUMENT_ERRORS), "invalid_argument")
        .when(memory, "cuda_oom")
        .when(one_of("RuntimeError"), "invalid_state")
        .otherwise("backend_error")
    )


def provenance(metadata: Column) -> Column:
    """Keep the named fields of a metadata map that exist."""
    return F.map_filter(metadata, lambda key, _: key.isin(*PROVENANCE_FIELDS))


def canonical_fingerprint(*fields: Column) -> Column:
    """SHA-256 of a compact JSON object; pass the fields in alphabetical order.

    Characters beyond ASCII are escaped, so the digest does not depend on an encoding.
    """
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    escaped = F.array_join(F.transform(F.split(text, ""), _ascii_escape), "")
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), escaped).otherwise(text)
    return F.sha2(plain.cast("binary"), 256)


def _ascii_escape(char: Column) -> Column:
    """JSON escape of one character beyond ASCII, as one or two UTF-16 units."""
    units = F.lower(F.hex(F.encode(char, "UTF-16BE")))
    escape = F.regexp_replace(units, "([0-9a-f]{4})", r"\\u$1")
    return F.when(char.rlike(r"[^\x00-\x7F]"), escape).otherwise(char)
