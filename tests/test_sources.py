import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusbench.functions.text import derive_source_id, has_text, stable_book_id, strip_text
from corpusbench.operators import inference, reports
from corpusbench.sources import manifests, payloads
from corpusbench.sources.strict import Field, object_issues

C = F.col


def written(tmp_path, name, document):
    path = tmp_path / name
    path.write_text(document if isinstance(document, str) else json.dumps(document), encoding="utf-8")
    return str(path)


def sample(**changes):
    return {"sample_id": "a", "audio_path": "x/a.wav", "reference_text": "Hola", **changes}


def manifest(*samples, **header):
    return {"schema_version": 1, "dataset_root": "audio", "samples": list(samples), **header}


def rules(catalog):
    return {(r.ord, r.rule) for r in catalog.rejects.collect()}


def test_manifest_items_and_root(spark, tmp_path):
    path = written(tmp_path, "m.json", manifest(sample(), sample(sample_id="b", audio_path="y/a.wav", sha256="F" * 64)))
    catalog = manifests.read_catalog(spark, path, manifests.stt_spec())
    rows = manifests.with_dataset_root(catalog).orderBy("ord").collect()
    assert [(r.ord, r.sample_id, r.audio_path) for r in rows] == [(0, "a", "x/a.wav"), (1, "b", "y/a.wav")]
    assert rows[0].dataset_root.endswith(f"{tmp_path}/audio")
    assert {r.dataset_root for r in manifests.with_dataset_root(catalog, "/other").collect()} == {"/other"}
    assert catalog.rejects.count() == 0


@pytest.mark.parametrize(
    "document, expected",
    [
        (manifest(sample(), schema_version=2), {(None, "schema_version")}),
        (manifest(sample(), schema_version=True), {(None, "type")}),
        (manifest(), {(None, "items")}),
        (manifest(sample(), extra=1), {(None, "unknown")}),
        ({"schema_version": 1, "samples": []}, {(None, "missing")}),
        ('{"schema_version": 1, "schema_version": 1, "dataset_root": "", "samples": []}', {(None, "duplicate_key")}),
        ("[1]", {(None, "json"), (None, "missing")} - {(None, "missing")}),
        (manifest(sample(extra=1)), {(0, "unknown")}),
        (manifest({"sample_id": "a"}), {(0, "missing")}),
        (manifest(sample(reference_text=5)), {(0, "type")}),
        (manifest(sample(audio_path="../a.wav")), {(0, "below_root")}),
        (manifest(sample(), sample(audio_path="z.wav")), {(None, "duplicate")}),
    ],
)
def test_manifest_rejects(spark, tmp_path, document, expected):
    catalog = manifests.read_catalog(spark, written(tmp_path, "m.json", document), manifests.stt_spec())
    assert rules(catalog) == expected
    assert catalog.items.count() == 0


def test_nested_duplicate_keys_are_rejected(spark, tmp_path):
    text = '{"schema_version": 1, "requests": [{"request_id": "a", "query": "q", "query": "r"}]}'
    assert rules(manifests.read_catalog(spark, written(tmp_path, "l.json", text), manifests.lyrics_spec())) == {(None, "json")}


def test_book_and_poem_catalogs(spark, tmp_path):
    row = spark.range(1).select(stable_book_id(F.lit("Over"), F.lit("X")).alias("b"), derive_source_id(F.lit("T"), F.lit("X")).alias("p")).first()
    book = {"book_id": row.b, "title": "Over", "author": "X", "publication_year": None, "source": None}
    books = {"schema_version": 1, "books": [book, {**book, "title": "Other"}, {**book, "publication_year": 999}]}
    catalog = manifests.read_catalog(spark, written(tmp_path, "b.json", books), manifests.book_spec())
    assert rules(catalog) == {(1, "derived_id"), (2, "year")}
    assert [r.title for r in catalog.items.collect()] == ["Over"]
    poem = {"source_id": row.p, "title": "T", "author": "X", "publication_year": 1900, "genre": None, "reference_text": None, "provenance": "p"}
    poems = manifests.read_catalog(spark, written(tmp_path, "p.json", {"schema_version": 1, "poems": [poem]}), manifests.poem_spec())
    assert [r.publication_year for r in poems.items.collect()] == [1900]


def test_discovery(spark, tmp_path):
    root = tmp_path / "audio files"
    (root / "album").mkdir(parents=True)
    (root / "album" / "song one.wav").write_bytes(b"abc")
    (root / "album" / "song one.txt").write_text("Hola, mundo\n", encoding="utf-8")
    (root / "other.MP3").write_bytes(b"xyz")
    (root / "ignored.json").write_text("{}")
    rows = manifests.discover_samples(spark, str(root)).collect()
    assert [(r.sample_id, r.audio_path, r.reference_text, r.source) for r in rows] == [
        ("album__song one", "album/song one.wav", "Hola, mundo", "directory-discovery"), ("other", "other.MP3", "", "directory-discovery"),
    ]
    assert rows[0].sha256 == hashlib.sha256(b"abc").hexdigest()
    assert [r.reference_missing for r in rows] == [False, True]


def test_sinks_never_overwrite(spark, tmp_path):
    frame = spark.createDataFrame([("a", "x")], "sample_id string, audio_path string")
    manifests.write_manifest(frame, str(tmp_path / "frozen"))
    with pytest.raises(Exception, match="(?i)exists"):
        manifests.write_manifest(frame, str(tmp_path / "frozen"))
    reports.write_run_artifact(frame, {"samples": frame}, str(tmp_path / "run"))
    assert json.loads(spark.read.text(str(tmp_path / "run" / "result")).first()[0]) == {"sample_id": "a", "audio_path": "x"}
    with pytest.raises(Exception, match="(?i)exists"):
        reports.write_run_artifact(frame, {}, str(tmp_path / "run"))
    tasks = spark.createDataFrame([("p", "o", True, True, "complete")], "preset_id string, output_dir string, worker_found boolean, preflight_ok boolean, status string")
    reports.write_batch_summary(tasks, str(tmp_path / "summary"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "summary")).first().asDict() == {"preset": "p", "status": "complete", "output": "o"}


def test_search_rows(spark):
    lines = [
        {"videoId": "abcdefghijk", "title": {"runs": [{"text": "Una "}, {"text": "canción"}]}, "lengthText": {"simpleText": "3:05"}},
        {"videoId": "abcdefghijl", "title": {"simpleText": "live"}},
        {"videoId": "abc", "title": {"simpleText": "short id"}, "lengthText": {"simpleText": "3:05"}},
        {"videoId": "abcdefghijm", "title": {"simpleText": " "}, "lengthText": {"simpleText": "3:05"}},
    ]
    text = spark.createDataFrame([(json.dumps(line),) for line in lines], "value string")
    rows = text.select(F.from_json("value", payloads.SEARCH_ROW).alias("r")).select("r.*")
    found = payloads.search_candidates(rows).collect()
    assert [(r.video_id, r.title, r.duration_seconds) for r in found] == [("abcdefghijk", "Una canción", 185.0)]
    assert found[0].url == "https://www.youtube.com/watch?v=abcdefghijk"


def parsed(spark, schema, rows):
    frame = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows], "source_key string, value string")
    return frame.select("source_key", F.from_json("value", schema).alias("p")).select("source_key", "p.*")


def hit(**changes):
    return {"result": {"id": 1, "title": "T", "url": "https://genius.com/t", "primary_artist": {"name": "A"}, **changes}}


def test_song_search(spark):
    rows = [("a", {"response": {"hits": [hit(), hit(id="22")]}}), ("b", {"response": {"hits": [hit(), hit(id=0)]}}), ("c", {"response": {}}), ("d", {"response": {"hits": []}})]
    candidates, failures = payloads.song_candidates(parsed(spark, payloads.SONG_SEARCH, rows))
    assert [(r.source_key, r.position, r.song_id) for r in candidates.orderBy("position").collect()] == [("a", 0, "1"), ("a", 1, "22")]
    assert sorted(r.source_key for r in failures.collect()) == ["b", "c"]


def test_song_details(spark):
    song = {"id": 5, "title": "T", "url": "u", "primary_artist": {"name": "A"}, "primary_tag": {"name": " rock "}, "album": {"name": " "}}
    rows = [("a", {"response": {"song": song}}), ("b", {"response": {"song": {**song, "id": 6}}}), ("c", {"response": {"song": None}})]
    frame = parsed(spark, payloads.SONG_DETAILS, rows).withColumn("requested_id", F.lit("5"))
    found = {r.source_key: r for r in payloads.song_details(frame).collect()}
    assert (found["a"].genres, found["a"].album, found["a"].error_code) == (["rock"], None, None)
    assert (found["b"].error_code, found["c"].error_code) == ("identity_mismatch", "invalid_response")


def container(spark, html, **options):
    return spark.createDataFrame([(html,)], "html string").select(payloads.container_text(C("html"), **options)).first()[0]


def test_page_text(spark):
    box = '<div data-lyrics-container="true">'
    song = f"<p>no</p>{box}[Coro]<br/>Ojalá (que <i>llueva</i>  café)</div><b>no</b>{box}Conuco de monte<script>var x = '<p>';</script></div>no"
    assert container(spark, song) == "[Coro]\nOjalá (que llueva café)\nConuco de monte"
    assert container(spark, f"{box}<div>Línea uno</div><p>Línea dos</p>Línea &aacute; tres</div>") == "Línea uno\nLínea dos\nLínea á tres"
    assert container(spark, "<div>nothing</div>") is None
    assert container(spark, f"{box} \n </div>") is None


def test_unclosed_break(spark):
    html = '<div data-lyrics-container="true">uno<br>dos</div>fuera'
    assert container(spark, html) == "uno\ndos"
    assert container(spark, html, void_elements="compat") == "uno\ndos\nfuera"


class Backend:
    def __init__(self, log, broken=None):
        self.log, self.broken = log, broken

    def note(self, word):
        with open(self.log, "a") as stream:
            stream.write(word + "\n")

    def load(self):
        self.note("load")
        if self.broken == "load":
            raise RuntimeError("no memory")

    def transcribe(self, row):
        self.note("transcribe")
        if row["text"] == "bad":
            raise ValueError("bad sample")
        return {"text": row["text"].upper()} if row["text"] != "odd" else None

    def close(self):
        self.note("close")


def test_transcription_lifecycle(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", "hola"), ("b", "bad"), ("c", "odd")], "sample_id string, text string")
    found = {r.sample_id: r for r in inference.transcribe(rows, lambda: Backend(log), warmup_runs=1, partitions=1).collect()}
    assert (found["a"].status, found["a"].transcript.text) == ("ok", "HOLA")
    assert found["a"].measurement.elapsed_seconds >= 0 and found["a"].failure is None
    assert (found["b"].failure.stage, found["b"].failure.error_type, found["b"].transcript) == ("transcribe", "ValueError", None)
    assert found["c"].failure.error_type == "TypeError"
    words = open(log).read().split()
    assert words[0] == "load" and words[-1] == "close" and words.count("load") == 1


def test_failed_load_closes_and_fails_every_row(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "sample_id string, text string")
    found = inference.transcribe(rows, lambda: Backend(log, "load"), partitions=1).collect()
    assert {r.failure.stage for r in found} == {"load"} and len(found) == 2
    assert open(log).read().split() == ["load", "close"]


def test_ledger_reads_the_last_valid_rows(spark, tmp_path):
    from corpusbench.sources import ledgers

    spec, path = ledgers.suite_ledger(), str(tmp_path / "ledger")
    write = ledgers.ledger_writer(path, spec.keys)

    def batch(*rows):
        schema = spec.schema.rsplit(", written", 1)[0]
        return spark.createDataFrame([(*r, None, 1, 1, 0, None, None) for r in rows], schema)

    write(batch(("d", "a", "running", 1), ("d", "b", "complete", 1)), 0)
    write(batch(("d", "a", "complete", 1), ("d", "c", "odd", 1)), 1)
    write(batch(("d", "a", "complete", 1), ("d", "c", "odd", 1)), 1)  # the same batch again
    valid, broken = ledgers.read_ledger(spark, path, spec)
    assert sorted((r.preset_id, r.status, r.written) for r in valid.collect()) == [("a", "complete", 1), ("b", "complete", 0)]
    assert [(r.preset_id, r.rule) for r in broken.collect()] == [("c", "status")]
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(Exception, match="without a key"):
        write(batch(("d", None, "complete", 1)), 2)


def test_ledger_schemas_fit_their_rules(spark):
    from corpusbench.sources import ledgers

    for spec in (ledgers.book_ledger(), ledgers.poem_ledger(), ledgers.lyrics_ledger(), ledgers.media_ledger(), ledgers.suite_ledger()):
        empty = spark.createDataFrame([], spec.schema)
        assert ledgers.current_rows(empty, spec).violations.count() == 0


def test_only_one_json_object_and_whole_numbers(spark):
    fields = (Field("a", "int"), Field("z", "string", optional=True))
    cases = {
        '{"a":1}': [], ' {"a":1} \n': [], '{"a":1} {"z":2}': ["json"], '{"a":1}}': ["json"], '{"a":1} junk}': ["json"],
        '{"a":1.0}': ["type"], '{"a":123456789012345678901234}': ["type"], '{"a":-9223372036854775808}': [], '{"a":1e2}': ["type"],
        '{"a":1,"z":"\\"]}"}': [], '[{"a":1}]': ["json"], "": ["json"],
    }
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    found = {r.t: [i.rule for i in r.issues] for r in frame.select("t", object_issues(C("t"), fields).alias("issues")).collect()}
    assert {t: f[:1] for t, f in found.items()} == cases


@pytest.mark.parametrize(
    "path, root, expected",
    [
        ("hdfs://nn/root/a.wav", "/root", "a.wav"), ("s3a://bucket/x/y/a.wav", "s3a://bucket/x/", "y/a.wav"),
        ("file:/data/a b.wav", "/data", "a b.wav"), ("file:///data/a.wav", "file:/data", "a.wav"), ("/database/a", "/data", None),
    ],
)
def test_paths_below_a_root(spark, path, root, expected):
    frame = spark.createDataFrame([(path,)], "p string").select(manifests.below(C("p"), root))
    if expected is None:
        with pytest.raises(Exception, match="not below the root"):
            frame.collect()
    else:
        assert frame.first()[0] == expected


def test_white_space_of_every_kind_is_blank(spark):
    frame = spark.createDataFrame([("\u00a0\u3000\u2003",), ("\u00a0x\u0085",), (None,)], "t string")
    assert [tuple(r) for r in frame.select(has_text(C("t")), strip_text(C("t"))).collect()] == [(False, None), (True, "x"), (None, None)]


def test_marked_pages_in_any_case(spark):
    def read(html):
        return spark.createDataFrame([(html,)], "html string").select(payloads.container_text(C("html"))).first()[0]

    assert read('<DIV DATA-Lyrics-Container="true">Uno<BR>dos<p>tres</DIV>') == "Uno\ndos\ntres"
    assert read('<div data-lyrics-container="&#116;rue">uno\n dos  tres</div>') == "uno\ndos tres"
    assert read("<div>true data-lyrics-container</div>") is None


def test_one_pass_tells_every_kind_of_problem(spark):
    fields = (Field("n", "int"), Field("x", "number", nullable=True), Field("l", "array", optional=True), Field("o", "object", optional=True))
    texts = {
        '{"n":1,"x":null,"l":[],"o":{}}': [],
        ' \n{"n":-0,"x":1e3} \t': [],
        '{"n":1.0,"x":"1","l":{},"o":[]}': ["type"] * 4,
        '{"n":9223372036854775808,"x":9223372036854775808}': ["type"],
        '{"n":null,"x":true}': ["type", "type"],
        '{"n":1,"n":2}': ["duplicate_key", "missing"],
        '{"n":"a","x":{"y":1,"y":2},"z":0}': ["json", "unknown"],
        '{"n":1,"x":2} {}': ["json"],
        '{"n":1,"x":NaN}': ["json"],
        '{"n":1,"x":"a\nb"}': ["json"],
        "[" * 5000: ["json"],
        "[1]": ["json"],
        "": ["json"],
    }
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    found = {r.t: [i.rule for i in r.issues] for r in frame.select("t", object_issues(C("t"), fields).alias("issues")).collect()}
    assert found == texts | {None: ["json"]}


def test_compaction_replaces_touched_buckets_only(spark, tmp_path):
    from corpusbench.sources import ledgers

    path, spec = str(tmp_path / "ledger"), ledgers.suite_ledger()
    write = ledgers.ledger_writer(path, spec.keys)

    def batch(ids, status):
        rows = [(f"d{i}", "p", status, 1, None, 0, 0, 0, None, None) for i in ids]
        return spark.createDataFrame(rows, spec.schema.replace(", written bigint", ""))

    def current():
        return {r.dataset_id: (r.status, r.written) for r in ledgers.read_ledger(spark, path, spec).valid.collect()}

    write(batch(range(40), "pending"), 0)
    write(batch(range(10), "running"), 1)
    before = current()
    assert len(ledgers.compact_ledger(spark, path, spec, buckets=8)) == 8 and current() == before
    assert ledgers.compact_ledger(spark, path, spec) == []  # nothing new
    write(batch([3], "complete"), 2)
    assert current() == before | {"d3": ("complete", 2)}
    held = ledgers._pointer(spark, path).held
    (touched,) = ledgers.compact_ledger(spark, path, spec, buckets=99)  # the first compaction's number stays
    now = ledgers._pointer(spark, path)
    assert {b for b in held if now.held[b] != held[b]} == {touched} and now.upto == 2 and now.buckets == 8
    assert current() == before | {"d3": ("complete", 2)}
    write(batch([3], "complete"), 2)  # a batch that is tried again after it was folded in changes nothing
    # A compaction that is lost before its pointer is written is not seen.
    write(batch([4], "failed"), 3)
    batch([4], "partial").withColumn("written", F.lit(9)).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/_base/lost")
    assert current() == before | {"d3": ("complete", 2), "d4": ("failed", 3)}
    ledgers.compact_ledger(spark, path, spec)
    assert current() == before | {"d3": ("complete", 2), "d4": ("failed", 3)}
    assert {r.files for r in ledgers.base_files(spark, path, spec).collect()} == {1}
