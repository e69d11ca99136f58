"""Manifests, catalogs and audio folders as tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbench.contracts import rulesets
from corpusbench.contracts.rules import Rule, broken_rules, duplicates
from corpusbench.functions.text import sample_id_from_path, strip_text
from corpusbench.sources.files import file_fingerprints
from corpusbench.sources.strict import Field, object_issues, sql_schema

C = F.col

SCHEMA_VERSION = 1
# Audio file suffixes looked for.
AUDIO_SUFFIXES = ("aac", "flac", "m4a", "mp3", "ogg", "opus", "wav")


class CatalogSpec(NamedTuple):
    """Shape of a versioned document: header fields, the item list and its key."""

    items: str
    key: str
    fields: tuple[Field, ...]
    header: tuple[Field, ...]
    rules: list[Rule] | None = None


def _optional(name: str, kind: str = "string") -> Field:
    return Field(name, kind, nullable=True, optional=True)


def _nullable(name: str, kind: str = "string") -> Field:
    return Field(name, kind, nullable=True)


def _header(items: str, *more: Field) -> tuple[Field, ...]:
    return (Field("schema_version", "int"), *more, Field(items, "array"))


def stt_spec() -> CatalogSpec:
    fields = (
        Field("sample_id"), Field("audio_path"), Field("reference_text"), _optional("group_id"),
        _optional("split"), _optional("source"), _optional("sha256"),
    )
    header = _header("samples", Field("dataset_root"))
    return CatalogSpec("samples", "sample_id", fields, header, rulesets.audio_sample())


def book_spec() -> CatalogSpec:
    fields = (
        Field("book_id"), Field("title"), Field("author"), _nullable("publication_year", "int"),
        _nullable("source"),
    )
    return CatalogSpec("books", "book_id", fields, _header("books"), rulesets.book_seed())


def poem_spec() -> CatalogSpec:
    fields = (
        Field("source_id"), Field("title"), Field("author"), _nullable("publication_year", "int"),
        _nullable("genre"), _nullable("reference_text"), _nullable("provenance"),
    )
    return CatalogSpec("poems", "source_id", fields, _header("poems"), rulesets.poem_source())


def lyrics_spec() -> CatalogSpec:
    fields = (
        Field("request_id"), Field("query"), _optional("expected_title"), _optional("expected_artist"),
    )
    return CatalogSpec("requests", "request_id", fields, _header("requests"), rulesets.lyrics_request())


class Catalog(NamedTuple):
    """``items``: file, ord and the item's fields.  ``rejects``: file, ord, rule, message."""

    headers: DataFrame
    items: DataFrame
    rejects: DataFrame


def parse_catalog(documents: DataFrame, spec: CatalogSpec) -> Catalog:
    """Strictly read documents (file, value) of one kind.

    A document with any problem in its header yields no items; an item with a problem is rejected
    alone.  Every rejection is a row.
    """
    header_issues = object_issues(C("value"), spec.header)
    raw = F.from_json("value", "map<string,string>")
    version = raw["schema_version"].try_cast("bigint")
    listed = F.from_json(raw[spec.items], "array<string>")
    checked = documents.select(
        "file",
        header_issues.alias("issues"),
        version.alias("schema_version"),
        *[raw[f.name].alias(f.name) for f in spec.header[1:-1]],
        listed.alias("listed"),
    )
    header_rules = [
        Rule("schema_version", C("schema_version") == SCHEMA_VERSION, "unsupported schema_version"),
        Rule("items", F.size("listed") > 0, f"{spec.items} must not be empty"),
    ]
    checked = checked.withColumn(
        "issues", F.when(F.size("issues") > 0, C("issues")).otherwise(broken_rules(header_rules))
    )
    good = checked.where(F.size("issues") == 0)
    texts = good.select("file", F.posexplode("listed").alias("ord", "value"))
    typed = texts.select(
        "file", "ord", object_issues(C("value"), spec.fields).alias("shape"),
        F.from_json("value", sql_schema(spec.fields)).alias("item"),
    ).select("file", "ord", "shape", "item.*")
    rules = F.array().cast("array<struct<rule:string,message:string>>") if not spec.rules else broken_rules(spec.rules)
    judged = typed.withColumn("issues", F.when(F.size("shape") > 0, C("shape")).otherwise(rules))
    repeated = duplicates(judged.where(F.size("issues") == 0), "file", spec.key)
    items = (
        judged.where(F.size("issues") == 0)
        .drop("shape", "issues")
        .join(repeated.select("file", spec.key), ["file", spec.key], "left_anti")
        .select("file", "ord", *[f.name for f in spec.fields])
    )
    unknown_ord = F.lit(None).cast("int").alias("ord")
    rejects = (
        checked.select("file", unknown_ord, F.explode("issues").alias("e"))
        .unionByName(judged.select("file", "ord", F.explode("issues").alias("e")))
        .select("file", "ord", "e.rule", "e.message")
        .unionByName(
            repeated.select(
                "file", unknown_ord, F.lit("duplicate").alias("rule"),
                F.concat(F.lit(f"duplicate {spec.key}: "), spec.key).alias("message"),
            )
        )
    )
    headers = good.drop("issues", "listed")
    return Catalog(headers, items, rejects)


def read_catalog(spark: SparkSession, paths: str | Sequence[str], spec: CatalogSpec) -> Catalog:
    """Read whole-document JSON files."""
    texts = spark.read.text(paths, wholetext=True)
    return parse_catalog(texts.select(C("_metadata.file_path").alias("file"), "value"), spec)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def with_dataset_root(catalog: Catalog, override: str | None = None) -> DataFrame:
    """Manifest samples with the resolved root: absolute, or relative to the manifest's folder."""
    given = F.lit(override) if override else C("dataset_root")
    absolute = given.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:/)")
    root = F.when(absolute, given).otherwise(F.concat(folder_of(C("file")), F.lit("/"), given))
    roots = catalog.headers.select("file", root.alias("dataset_root"))
    return catalog.items.join(roots, "file")


def join_references(audio: DataFrame, texts: DataFrame) -> DataFrame:
    """Audio samples with the text beside them, or an empty reference.

    ``audio``: relative_path, sha256.  ``texts``: relative_path, text.
    """

    def stem(column: Column) -> Column:
        return F.regexp_replace(column, r"(?<=[^/])\.[^./]*$", "")

    sidecar = texts.select(stem(C("relative_path")).alias("_stem"), F.coalesce(strip_text(C("text")), F.lit("")).alias("_text"))
    joined = audio.withColumn("_stem", stem(C("relative_path"))).join(sidecar, "_stem", "left")
    return joined.select(
        sample_id_from_path(C("relative_path")).alias("sample_id"),
        C("relative_path").alias("audio_path"),
        F.coalesce("_text", F.lit("")).alias("reference_text"),
        F.lit("directory-discovery").alias("source"),
        "sha256",
        C("_text").isNull().alias("reference_missing"),
    )


def below(path: Column, root: str) -> Column:
    """``path`` relative to ``root``; scheme and authority don't count, a path elsewhere is refused."""
    place = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    start = re.sub(place, "", root).rstrip("/") + "/"
    plain = F.regexp_replace(path, place, "")
    elsewhere = F.raise_error(F.concat(F.lit("not below the root: "), path)).cast("string")
    return F.when(plain.startswith(start), F.substr(plain, F.lit(len(start) + 1))).otherwise(elsewhere)


def discover_samples(spark: SparkSession, root: str) -> DataFrame:
    """Samples found below an audio folder, sorted by path.  Check ids with ``duplicates``.

    Spark's readers do not list empty files: an empty audio file is no sample, and an empty text beside one
    counts as missing.
    """
    base = root.rstrip("/")

    def relative(path: Column) -> Column:
        return below(path, base)

    files = file_fingerprints(spark, base, AUDIO_SUFFIXES)
    audio = files.select(relative(C("path")).alias("relative_path"), "sha256")
    texts = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.txt")
        .text(base, wholetext=True)
        .select(relative(F.try_url_decode(F.replace(C("_metadata.file_path"), F.lit("+"), F.lit("%2B")))).alias("relative_path"), C("value").alias("text"))
    )
    return join_references(audio, texts).orderBy("audio_path")


def write_manifest(samples: DataFrame, target: str) -> None:
    """Freeze manifest samples; an existing target is never overwritten."""
    samples.write.mode("errorifexists").parquet(target)
