import hashlib

import pytest

from corpusbench.sources import files


def digest(content):
    return hashlib.sha256(content).hexdigest()


def write(spark, rows, root):
    files.write_files(spark.createDataFrame(rows, "path string, content binary"), str(root))


def test_one_file_a_row(spark, tmp_path):
    root = tmp_path / "in a folder"
    write(spark, [("a/b c+%20.wav", b"\x00\xff"), ("é.mp3", None), ("a/x.txt", b"t")], root)
    assert {p.relative_to(root).as_posix(): p.read_bytes() for p in root.rglob("*") if p.is_file() and p.suffix != ".crc"} == {
        "a/b c+%20.wav": b"\x00\xff", "é.mp3": b"", "a/x.txt": b"t",
    }
    write(spark, [("a/x.txt", b"again")], root)
    assert (root / "a" / "x.txt").read_bytes() == b"again"
    write(spark, [], tmp_path / "none")


@pytest.mark.parametrize("path", [None, "", "/abs", "a/../../b", "a//b", "."])
def test_paths_stay_below_the_root(spark, tmp_path, path):
    with pytest.raises(Exception, match="not a path below the root"):
        write(spark, [(path, b"x")], tmp_path / "root")
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_overwriting_is_refused(spark, tmp_path):
    write(spark, [("a", b"x")], tmp_path)
    frame = spark.createDataFrame([("a", b"y")], "path string, content binary")
    with pytest.raises(Exception, match="only appends"):
        frame.write.format("file_per_row").mode("overwrite").save(str(tmp_path))


def test_hashes_are_the_same_in_rows_and_in_chunks(spark, tmp_path):
    contents = {f"d {i % 3}/f{i}.WaV": bytes([i]) * (i * i * 50) for i in range(1, 40)}
    write(spark, list(contents.items()), tmp_path)
    write(spark, [("d 0/other.json", b"{}"), ("d 0/empty.wav", b"")], tmp_path)
    for in_row in (1 << 20, 10_000, 0, -1):
        found = files.file_fingerprints(spark, str(tmp_path), ["wav"], in_row=in_row, task_bytes=100_000)
        rows = {r.path.split(f"{tmp_path}/")[1]: (r.sha256, r.bytes) for r in found.collect()}
        assert rows == {p: (digest(c), len(c)) for p, c in contents.items()}, in_row


def test_a_file_larger_than_a_row_may_be(spark, tmp_path):
    big = tmp_path / "big.wav"
    with big.open("wb") as stream:
        stream.truncate((2 << 30) + 5)  # sparse, beyond what one row can hold
    row = files.file_fingerprints(spark, str(tmp_path), ["wav"]).first()
    expected = hashlib.sha256()
    for _ in range(512):
        expected.update(bytes(4 << 20))
    expected.update(bytes(5))
    assert (row.sha256, row.bytes) == (expected.hexdigest(), (2 << 30) + 5)


def test_large_files_are_dealt_by_size(spark):
    sizes = [1000] * 50 + [10] * 5000
    rows = spark.createDataFrame([(f"p{i}", s) for i, s in enumerate(sizes)], "path string, length long")
    dealt = files.deal_by_size(rows, "length", "path", 5000)
    loads = dealt.rdd.mapPartitions(lambda part: [sum(r.length for r in part)]).collect()
    assert len(loads) == 20 and sum(loads) == sum(sizes) and max(loads) <= 15_000
    assert files.deal_by_size(rows.where("false"), "length", "path", 5000) is None
