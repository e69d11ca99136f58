"""Scans and sinks over documents and payloads that Spark derives from the given tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbench.functions.classify import failure_code
from corpusbench.operators import inference
from corpusbench.operators.reports import write_run_artifact
from corpusbench.operators.spread import compute_partitions
from corpusbench.plans.registry import query, spread_table, table
from corpusbench.session import fresh_folder
from corpusbench.sources import files, ledgers, manifests, payloads
from corpusbench.sources.strict import Field, object_issues
from corpusbench.streaming.runs import run_transcription

C = F.col


def _object(*pairs: object) -> object:
    """A JSON object text from alternating names and JSON texts, duplicates and all."""
    parts = []
    for name, text in zip(pairs[::2], pairs[1::2]):
        parts.append(F.when(text.isNotNull(), F.concat(F.lit(f'"{name}":'), text)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _quoted(text: object) -> object:
    return F.concat(F.lit('"'), text, F.lit('"'))


@query(
    "s3_strict_json",
    """
SELECT doc_id, rule FROM (
  SELECT doc_id, 'missing' AS rule FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT doc_id, 'type' FROM labels WHERE quality = 0
  UNION ALL SELECT doc_id, 'type' FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND source IN ('src1', 'src2')
  UNION ALL SELECT doc_id, 'json' FROM documents WHERE source IN ('src3', 'src4') AND lang <> 'fr'
  UNION ALL SELECT doc_id, 'unknown' FROM documents WHERE lang = 'de'
  UNION ALL SELECT doc_id, 'duplicate_key' FROM documents WHERE lang = 'fr')
WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr') OR rule IN ('duplicate_key', 'missing')
""",
)
def strict_json(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as JSON rows: labels may be missing or of the wrong type, German rows have a field
    nobody knows and French ones repeat a key (so nothing more than their fields can be checked).
    Two sources write 1.0 and numbers beyond 64 bits, two go on after the object."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    joined = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    written = F.when(C("source") == "src1", "1.0").when(C("source") == "src2", "1" * 24).otherwise("1")
    label = F.when(C("quality") == 0, F.lit("true")).when(C("quality") == 1, written)
    lang = C("lang")
    text = _object(
        "doc_id", C("doc_id").cast("string"), "label", label, "lang", _quoted(lang),
        "extra", F.when(lang == "de", F.lit("[1,{}]")), "lang", F.when(lang == "fr", F.lit('"x"')),
    )
    text = F.when(C("source") == "src3", F.concat(text, F.lit(' {"z":2}'))).when(C("source") == "src4", F.concat(text, F.lit("}"))).otherwise(text)
    fields = (Field("doc_id", "int"), Field("label", "int"), Field("lang"))
    found = joined.select("doc_id", F.explode(object_issues(text, fields)).alias("e"))
    return found.select("doc_id", "e.rule")


def _catalog_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A poem catalog per document; German ones have another version, long ones a bad id."""
    docs = table(spark, sf, "documents")
    title, author = F.md5(C("text").cast("binary")), C("source")
    source_id = F.when(C("n_chars") > 20000, "BAD ID").otherwise(F.concat(F.lit("poem-"), title))
    item = F.struct(
        source_id.alias("source_id"), title.alias("title"), author.alias("author"),
        F.when(C("n_chars") < 100, 10000).otherwise(1900).alias("publication_year"),
        C("lang").alias("genre"), F.lit(None).cast("string").alias("reference_text"), F.lit(None).cast("string").alias("provenance"),
    )
    body = F.to_json(
        F.struct(F.when(C("lang") == "de", 2).otherwise(1).alias("schema_version"), F.array(item).alias("poems")), {"ignoreNullFields": "false"}
    )
    return docs.select(C("doc_id").cast("string").alias("file"), body.alias("value"))


@query(
    "s2_catalog_items",
    """
SELECT CAST(doc_id AS VARCHAR) AS file, md5(text) AS title, source AS author, lang AS genre FROM documents
WHERE lang <> 'de' AND n_chars BETWEEN 100 AND 20000
""",
)
def catalog_items(spark: SparkSession, sf: str) -> DataFrame:
    items = manifests.parse_catalog(_catalog_documents(spark, sf), manifests.poem_spec()).items
    return items.select("file", "title", "author", "genre")


@query(
    "s2_catalog_rejects",
    """
SELECT CAST(doc_id AS VARCHAR) AS file, CASE WHEN lang = 'de' THEN 'schema_version' WHEN n_chars > 20000 THEN 'source_id' ELSE 'year' END AS rule
FROM documents WHERE lang = 'de' OR n_chars NOT BETWEEN 100 AND 20000
""",
)
def catalog_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return manifests.parse_catalog(_catalog_documents(spark, sf), manifests.poem_spec()).rejects.select("file", "rule")


@query(
    "s1_manifest_samples",
    """
SELECT CAST(conv_id AS VARCHAR) AS file, turn AS ord, conv_id || '-' || turn AS sample_id, 'a/' || turn || '.wav' AS audio_path, text AS reference_text,
       '/data/' || conv_id AS dataset_root FROM conversations
""",
)
def manifest_samples(spark: SparkSession, sf: str) -> DataFrame:
    """One manifest per conversation, with its turns in order; relative roots below /data."""
    turns = table(spark, sf, "conversations")
    sample = F.struct(
        C("turn").alias("ord"),
        F.concat_ws("-", "conv_id", "turn").alias("sample_id"), F.format_string("a/%d.wav", "turn").alias("audio_path"),
        C("text").alias("reference_text"),
    )
    bodies = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(sample)).alias("samples"))
    listed = F.transform("samples", lambda s: F.struct(s["sample_id"].alias("sample_id"), s["audio_path"].alias("audio_path"), s["reference_text"].alias("reference_text")))
    documents = bodies.select(
        F.format_string("/data/%d.json", "conv_id").alias("file"),
        F.to_json(F.struct(F.lit(1).alias("schema_version"), C("conv_id").cast("string").alias("dataset_root"), listed.alias("samples"))).alias("value"),
    )
    rooted = manifests.with_dataset_root(manifests.parse_catalog(documents, manifests.stt_spec()))
    number = F.regexp_extract("file", r"(\d+)\.json$", 1)
    return rooted.select(number.alias("file"), "ord", "sample_id", "audio_path", "reference_text", "dataset_root")


@query(
    "s5_content_fingerprint",
    "SELECT doc_id, sha256(text) AS sha256 FROM documents",
)
def content_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(C("text").cast("binary"), 256).alias("sha256"))


@query(
    "s10_search_rows",
    """
SELECT l_orderkey, l_linenumber, substr(md5(CAST(l_suppkey AS VARCHAR)), 1, 11) AS video_id, 'part ' || l_partkey AS title,
       CAST(l_linenumber * 60 + CAST(l_quantity AS INTEGER) AS DOUBLE) AS duration_seconds
FROM lineitem WHERE l_returnflag <> 'N' AND l_tax > 0
""",
)
def search_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as raw search rows: untaxed ones have a short id, flag N is live (no length)."""
    nothing = F.lit(None)
    run = F.struct(F.lit(" part ").alias("text"))
    number = F.struct(C("l_partkey").cast("string").alias("text"))
    runs = F.struct(nothing.cast("string").alias("simpleText"), F.array(run, number).alias("runs"))
    shown = F.concat(C("l_linenumber").cast("string"), F.lit(":"), F.lpad(C("l_quantity").cast("int").cast("string"), 2, "0"))
    length = F.struct(shown.alias("simpleText"), nothing.cast("array<struct<text:string>>").alias("runs"))
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.substring(F.md5(C("l_suppkey").cast("string").cast("binary")), 1, F.when(C("l_tax") > 0, 11).otherwise(3)).alias("videoId"),
        runs.alias("title"), F.when(C("l_returnflag") != "N", length).alias("lengthText"),
    )
    return payloads.search_candidates(rows).drop("url")


def _song_payloads(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    hit = F.struct(
        F.struct(
            F.when(C("p_size") > 45, "0").otherwise(F.concat(C("p_size").cast("string"), F.lit("1"))).alias("id"),
            C("p_name").alias("title"), F.lit("https://genius.com/x").alias("url"),
            F.struct(F.when(C("p_size") > 3, C("p_brand")).otherwise(" ").alias("name")).alias("primary_artist"),
        ).alias("result")
    )
    second = F.struct(
        F.struct(F.lit("7").alias("id"), C("p_type").alias("title"), F.lit("https://genius.com/y").alias("url"), F.struct(C("p_brand").alias("name")).alias("primary_artist")).alias("result")
    )
    return part.select(C("p_partkey").alias("source_key"), F.struct(F.array(hit, second).alias("hits")).alias("response"))


@query(
    "s11_song_candidates",
    """
SELECT p_partkey AS source_key, 0 AS position, p_size || '1' AS song_id, p_name AS title, p_brand AS artist FROM part WHERE p_size BETWEEN 4 AND 45
UNION ALL SELECT p_partkey, 1, '7', p_type, p_brand FROM part WHERE p_size BETWEEN 4 AND 45
""",
)
def song_candidates(spark: SparkSession, sf: str) -> DataFrame:
    candidates, _ = payloads.song_candidates(_song_payloads(spark, sf))
    return candidates.select("source_key", "position", "song_id", "title", "artist")


@query(
    "s11_song_search_failures",
    "SELECT p_partkey AS source_key, 'invalid_response' AS code, false AS retryable FROM part WHERE p_size NOT BETWEEN 4 AND 45",
)
def song_failures(spark: SparkSession, sf: str) -> DataFrame:
    _, failures = payloads.song_candidates(_song_payloads(spark, sf))
    return failures.select("source_key", "code", "retryable")


@query(
    "s12_song_details",
    """
SELECT p_partkey AS source_key, p_name AS title, CASE WHEN p_size > 25 THEN p_type END AS genre, CASE WHEN p_size > 10 THEN p_brand END AS album,
       CASE WHEN p_size > 45 THEN 'identity_mismatch' WHEN p_size < 3 THEN 'invalid_response' END AS error_code FROM part
""",
)
def song_details(spark: SparkSession, sf: str) -> DataFrame:
    size = C("p_size")
    song = F.struct(
        F.when(size > 45, "99").when(size < 3, "abc").otherwise("5").alias("id"), C("p_name").alias("title"), F.lit("https://genius.com/x").alias("url"),
        F.struct(C("p_brand").alias("name")).alias("primary_artist"), F.struct(F.when(size > 25, C("p_type")).otherwise(" ").alias("name")).alias("primary_tag"),
        F.when(size > 10, F.struct(C("p_brand").alias("name"))).alias("album"), F.lit(None).cast("string").alias("label"), F.lit("2020").alias("release_date_for_display"),
    )
    answers = table(spark, sf, "part").select(C("p_partkey").alias("source_key"), F.lit("5").alias("requested_id"), F.struct(song.alias("song")).alias("response"))
    details = payloads.song_details(answers)
    return details.select("source_key", "title", F.get("genres", F.lit(0)).alias("genre"), "album", "error_code")


_ADS = r"""
SELECT page_id, nullif(regexp_replace(trim(regexp_replace(array_to_string(regexp_extract_all(html, '<div class="ad">([^<]*)</div>', 1), chr(10)), '[ \t]+', ' ', 'g'), E' \n'),
         ' ?\n[ \n]*', chr(10), 'g'), '') AS text
FROM pages
"""


@query("s13_page_text", _ADS)
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    """Advertisement blocks of whole pages as containers."""
    pages = spread_table(spark, sf, "pages", "page_id", "html")
    return pages.select("page_id", payloads.container_text(C("html"), attribute="class", value="ad").alias("text"))


@query("s13_page_text_compat", _ADS)
def page_text_compat(spark: SparkSession, sf: str) -> DataFrame:
    pages = spread_table(spark, sf, "pages", "page_id", "html")
    text = payloads.container_text(C("html"), attribute="class", value="ad", void_elements="compat")
    return pages.select("page_id", text.alias("text"))


@query("s13_page_text_case", _ADS)
def page_text_case(spark: SparkSession, sf: str) -> DataFrame:
    """The same pages, with the tags and attribute names of every second German one in capitals."""
    shouted = F.replace(F.replace(C("html"), F.lit('<div class="ad">'), F.lit('<DIV CLASS="&#97;d">')), F.lit("</div>"), F.lit("</DIV>"))
    html = F.when(C("html").contains('lang="de"'), shouted).otherwise(C("html"))
    pages = spread_table(spark, sf, "pages", "page_id", "html")
    return pages.select("page_id", payloads.container_text(html, attribute="class", value="ad").alias("text"))


@query(
    "s5_file_fingerprints",
    "SELECT item_id, sha256(text || chr(10)) AS sha256, strlen(text)::BIGINT + 1 AS bytes FROM benchmark",
)
def file_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items written as files, one folder each, and read back as hashes."""
    root = fresh_folder(spark, "items")
    table(spark, sf, "benchmark").repartition("item_id").write.partitionBy("item_id").text(root)
    item = F.regexp_extract("path", r"item_id=(\d+)/", 1).cast("bigint")
    return files.file_fingerprints(spark, root, ["txt"]).select(item.alias("item_id"), "sha256", "bytes")


@query(
    "s4_discovered_samples",
    """
SELECT sample_id, audio_path, CASE WHEN item_id % 3 > 0 THEN text ELSE '' END AS reference_text, 'directory-discovery' AS source,
       sha256(text || item_id) AS sha256, item_id % 3 = 0 AS reference_missing
FROM (SELECT *, 'set ' || item_id % 4 || '__item.' || item_id AS sample_id,
             'set ' || item_id % 4 || '/item.' || item_id || CASE WHEN item_id % 2 = 0 THEN '.wav' ELSE '.MP3' END AS audio_path FROM benchmark)
""",
)
def discovered_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as audio files in folders, two of three with their text beside them and all with notes
    that are no samples, found again."""
    root = fresh_folder(spark, "audio")
    items, number = table(spark, sf, "benchmark"), C("item_id")
    stem = F.format_string("set %d/item.%d", number % 4, number)
    audio = items.select(F.concat(stem, F.when(number % 2 == 0, ".wav").otherwise(".MP3")).alias("path"), F.concat("text", number).alias("content"))
    texts = items.where(number % 3 > 0).select(F.concat(stem, F.lit(".txt")).alias("path"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("content"))
    notes = items.select(F.concat(stem, F.lit(".json")).alias("path"), F.lit("{}").alias("content"))
    files.write_files(audio.union(texts).union(notes), root)
    return manifests.discover_samples(spark, root)


@query(
    "s6_frozen_manifest",
    """
SELECT CAST(doc_id AS VARCHAR) AS sample_id, lang AS group_id, sha256(text) AS sha256 FROM documents
""",
)
def frozen_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest written once and read back; a second writing is refused."""
    content = C("text").cast("binary")
    samples = table(spark, sf, "documents").select(
        C("doc_id").cast("string").alias("sample_id"), C("lang").alias("group_id"), F.sha2(content, 256).alias("sha256")
    )
    target = fresh_folder(spark, "manifest")
    manifests.write_manifest(samples, target)
    return spark.read.schema(samples.schema).parquet(target)


@query(
    "s7_stored_ledger",
    """
SELECT CAST(l.doc_id AS VARCHAR) AS dataset_id, d.lang AS preset_id, CASE WHEN l.toxic = 1 THEN 'failed' ELSE 'complete' END AS status,
       2 AS attempt, 1 AS written
FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1
UNION ALL SELECT CAST(l.doc_id AS VARCHAR), d.lang, 'pending', 1, 0 FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 0
""",
)
def stored_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches through the ledger's sink, the second of them twice, and the current rows read back."""
    spec = ledgers.suite_ledger()
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    first = _suite_rows(joined, F.lit("pending"), 1)
    second = _suite_rows(joined.where("quality = 1"), F.when(C("toxic") == 1, "failed").otherwise("complete"), 2)
    target = fresh_folder(spark, "ledger")
    write = ledgers.ledger_writer(target, spec.keys)
    for batch, number in ((first, 0), (second, 1), (second, 1)):
        write(batch, number)
    valid = ledgers.read_ledger(spark, target, spec).valid
    return valid.select("dataset_id", "preset_id", "status", "attempt", "written")


def _suite_rows(joined: DataFrame, status: Column, attempt: int) -> DataFrame:
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")
    return joined.select(
        C("doc_id").cast("string").alias("dataset_id"), C("lang").alias("preset_id"), status.alias("status"),
        F.lit(attempt).alias("attempt"), none.alias("output_dir"),
        *(zero.alias(c) for c in ("expected_samples", "succeeded_samples", "failed_samples")),
        none.alias("error_type"), none.alias("error_message"),
    )


@query(
    "s8_compacted_ledger",
    """
SELECT CAST(doc_id AS VARCHAR) AS dataset_id, lang AS preset_id, CASE WHEN doc_id % 10 = 9 THEN 'complete' ELSE 'running' END AS status,
       doc_id % 10 + 1 AS attempt, doc_id % 10 AS written, 1 AS files
FROM documents
""",
)
def compacted_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Ten batches, each with the documents still at work, compacted half-way and at the end: a bucket is one file then."""
    spec, docs = ledgers.suite_ledger(), table(spark, sf, "documents").select("doc_id", "lang")
    target = fresh_folder(spark, "compacted-ledger")
    write = ledgers.ledger_writer(target, spec.keys)
    for number in range(10):
        write(_suite_rows(docs.where(C("doc_id") % 10 >= number), F.lit("complete" if number == 9 else "running"), number + 1), number)
        if number in (4, 9):
            ledgers.compact_ledger(spark, target, spec, buckets=8)
    held = ledgers.base_files(spark, target, spec)
    valid = ledgers.read_ledger(spark, target, spec).valid
    return valid.select("dataset_id", "preset_id", "status", "attempt", "written").join(held, ["dataset_id", "preset_id"])


@query(
    "s9_run_artifact",
    """
SELECT l_returnflag, '{"l_returnflag":"' || l_returnflag || '","lines":' || count(*) || ',"orders":' || count(DISTINCT l_orderkey) || '}' AS value,
       count(DISTINCT l_orderkey) AS details
FROM lineitem GROUP BY l_returnflag
""",
)
def run_artifact(spark: SparkSession, sf: str) -> DataFrame:
    """An artifact with the totals per flag and their orders as details, written and read back."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey")
    counts = lines.groupBy("l_returnflag").agg(F.count("*").alias("lines"), F.count_distinct("l_orderkey").alias("orders"))
    target = fresh_folder(spark, "run-artifact")
    write_run_artifact(counts, {"details": lines.distinct()}, target)
    stored = spark.read.text(f"{target}/result").select(F.get_json_object("value", "$.l_returnflag").alias("l_returnflag"), "value")
    details = spark.read.parquet(f"{target}/details").groupBy("l_returnflag").agg(F.count("*").alias("details"))
    return stored.join(details, "l_returnflag")


class _Echo:
    """A stand-in recognizer: answers in upper case and fails on texts without a full stop."""

    def load(self) -> None:
        self.loaded = True

    def transcribe(self, sample: dict[str, Any]) -> dict[str, Any]:
        if "." not in sample["text"]:
            raise ValueError("no full stop")
        return {"text": sample["text"].upper(), "language": sample["lang"], "audio_duration_seconds": float(len(sample["text"]))}

    def close(self) -> None:
        self.loaded = False


@query(
    "x1_batch_transcription",
    """
SELECT CAST(doc_id AS VARCHAR) AS sample_id, CASE WHEN contains(text, '.') THEN 'ok' ELSE 'failed' END AS status,
       CASE WHEN contains(text, '.') THEN lang END AS language, CASE WHEN contains(text, '.') THEN length(text)::DOUBLE END AS audio_duration_seconds,
       CASE WHEN NOT contains(text, '.') THEN 'transcribe' END AS stage, CASE WHEN NOT contains(text, '.') THEN 'ValueError' END AS error_type
FROM documents
""",
)
def batch_transcription(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(C("doc_id").cast("string").alias("sample_id"), "text", "lang")
    results = inference.transcribe(docs, _Echo, warmup_runs=0, partitions=compute_partitions(spark))
    return results.select(
        "sample_id", "status", "transcript.language", "transcript.audio_duration_seconds", "failure.stage", "failure.error_type"
    )


class _RateLimit(RuntimeError):
    retryable = True


class _Limited(_Echo):
    """The stand-in recognizer on a service that serves no German."""

    def transcribe(self, sample: dict[str, Any]) -> dict[str, Any]:
        if sample["lang"] == "de":
            raise _RateLimit("HTTP 429")
        return super().transcribe(sample)


_RUN_BATCH = 64 << 20  # bytes of sample files in one micro-batch


@query(
    "x1_resumed_run",
    """
SELECT CAST(doc_id AS VARCHAR) AS sample_id, CASE WHEN contains(text, '.') THEN 'ok' ELSE 'failed' END AS status,
       CASE WHEN contains(text, '.') THEN lang END AS language, CASE WHEN NOT contains(text, '.') THEN 'ValueError' END AS error_type
FROM documents
""",
)
def resumed_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run that a rate limit stops after the batch of its first German document, and the run that goes on."""
    docs = table(spark, sf, "documents").select(C("doc_id").cast("string").alias("sample_id"), "text", "lang")
    samples, folder = fresh_folder(spark, "run-samples"), fresh_folder(spark, "run")
    docs.repartition(compute_partitions(spark), "sample_id").write.parquet(samples)
    limited = C("failure.error_type") == "_RateLimit"
    for backend in (_Limited, _Echo):
        done = run_transcription(spark, samples, folder, backend, batch_bytes=_RUN_BATCH, blocking=limited)
    return done.results.select("sample_id", "status", "transcript.language", "failure.error_type")


class _CudaOutOfMemory(RuntimeError):
    retryable = True


class _Failing(_Echo):
    """Refuses Spanish rows before it starts, runs out of memory on long ones, and can't be closed."""

    def preflight(self, sample: dict[str, Any]) -> None:
        if sample["lang"] == "es":
            raise ValueError("not in Spanish")

    def transcribe(self, sample: dict[str, Any]) -> dict[str, Any]:
        if len(sample["text"]) > 5000:
            raise _CudaOutOfMemory("CUDA out of memory")
        return {"text": sample["text"], "metadata": {"model": "echo"}, "gpu_peak_allocated_bytes": len(sample["text"])}

    def close(self) -> None:
        raise OSError("still busy")


@query(
    "x6_failure_stages",
    """
SELECT CAST(doc_id AS VARCHAR) AS sample_id, CASE WHEN lang = 'es' OR length(text) > 5000 THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN lang = 'es' THEN 'preflight' WHEN length(text) > 5000 THEN 'transcribe' END AS stage,
       CASE WHEN lang = 'es' THEN 'invalid_argument' WHEN length(text) > 5000 THEN 'cuda_oom' END AS code,
       CASE WHEN lang = 'es' THEN false WHEN length(text) > 5000 THEN true END AS retryable,
       CASE WHEN lang <> 'es' AND length(text) <= 5000 THEN length(text)::BIGINT END AS gpu_peak
FROM documents UNION ALL SELECT NULL, 'failed', 'close', 'backend_error', false, NULL
""",
)
def failure_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Stage and code of every row's failure; backends that can't be closed are told once."""
    docs = table(spark, sf, "documents").select(C("doc_id").cast("string").alias("sample_id"), "text", "lang")
    results = inference.transcribe(docs, _Failing, warmup_runs=0, partitions=compute_partitions(spark))
    code = F.when(C("failure").isNotNull(), failure_code(C("failure.families"), C("failure.message")))
    return results.select(
        "sample_id", "status", "failure.stage", code.alias("code"), "failure.retryable",
        C("measurement.gpu_peak_allocated_bytes").alias("gpu_peak"),
    ).distinct()


def _provider() -> Any:
    def search(text: str) -> list[dict[str, Any]]:
        if text.startswith("L"):
            raise RuntimeError("blocked")
        return [{"video_id": w, "title": text, "url": w, "duration_seconds": float(len(w))} for w in text.split()]

    return search


@query(
    "x3_candidate_provider",
    """
SELECT CAST(p_partkey AS VARCHAR) AS source_key, w AS video_id, i - 1 AS position, NULL AS error_type
FROM (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_brand, ' ')) AS w, unnest([1, 2, 3]) AS i FROM part WHERE p_type <> 'LARGE')
UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, NULL, 'RuntimeError' FROM part WHERE p_type = 'LARGE'
""",
)
def candidate_provider(spark: SparkSession, sf: str) -> DataFrame:
    """A provider that answers a part's words; searches starting with L are blocked."""
    text = F.when(C("p_type") == "LARGE", F.concat(F.lit("L"), "p_name")).otherwise(F.concat_ws(" ", "p_name", "p_brand"))
    asked = table(spark, sf, "part").select(C("p_partkey").cast("string").alias("source_key"), F.lit(0).alias("query_ord"), text.alias("query"))
    return inference.fetch_candidates(asked, _provider).select("source_key", "video_id", "position", "error_type")


