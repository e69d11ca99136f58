"""Single files as rows: a sink that writes one file a row, and hashes of files of any size."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

C = F.col

IN_ROW = 32 << 20  # bytes of a file that Spark's reader may hold as one row
TASK_BYTES = 4 << 30  # bytes of larger files that a task is meant to read
_CHUNK = 4 << 20
# Names that Hadoop and Arrow give the same file system.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "abfss": "abfss"}


def open_place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it, of a local path or a URI as Spark writes it (its path is not encoded)."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)", path)
    if not found or found[1] == "file":
        return fs.LocalFileSystem(), found[3] if found else path
    system, base = fs.FileSystem.from_uri(f"{_SCHEMES.get(found[1], found[1])}://{found[2] or ''}/")
    return system, base.rstrip("/") + found[3]


# ---------------------------------------------------------------- one file a row


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _FileWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, base = open_place(self.root)
        made: set[str] = set()
        files = 0
        for batch in iterator:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                self._place(system, base, name.as_py(), content.as_buffer() if content.is_valid else b"", made)
            files += batch.num_rows
        return _Written(files)

    @staticmethod
    def _place(system: fs.FileSystem, base: str, name: str | None, content: pa.Buffer | bytes, made: set[str]) -> None:
        parts = (name or "").split("/")
        if any(part in ("", ".", "..") for part in parts):
            raise ValueError(f"not a path below the root: {name!r}")
        folder = "/".join([base.rstrip("/"), *parts[:-1]])
        if folder not in made:
            system.create_dir(folder, recursive=True)
            made.add(folder)
        beside = f"{folder}/.{uuid.uuid4().hex}"
        with system.open_output_stream(beside) as stream:
            stream.write(content)
        system.move(beside, f"{folder}/{parts[-1]}")


class FilePerRow(DataSource):
    """``df.write.format("file_per_row").mode("append").save(root)`` with columns path and content.

    ``path`` is relative to the root and may have folders; one that is null, absolute or climbs with ``..`` fails the
    write.  A null content is an empty file.  A file appears whole, under its name, or not at all: it is written
    beside and moved, so a task that is lost and run again replaces its own files.  A write that fails leaves the files
    of its finished tasks, and writing again replaces them.  Paths should be unique: of equal ones any file stays.
    """

    @classmethod
    def name(cls) -> str:
        return "file_per_row"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> _FileWriter:
        if overwrite:
            raise ValueError("file_per_row only appends")
        if schema.simpleString() != "struct<path:string,content:binary>":
            raise ValueError(f"file_per_row takes path string, content binary, not {schema.simpleString()}")
        return _FileWriter(self.options["path"])


def write_files(files: DataFrame, root: str) -> None:
    """Write each row (path, content) as one file below ``root``."""
    files.sparkSession.dataSource.register(FilePerRow)
    rows = files.select(C("path").cast("string").alias("path"), C("content").cast("binary").alias("content"))
    rows.write.format("file_per_row").mode("append").save(root)


# ---------------------------------------------------------------- hashes


def _any_case(suffix: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, place = open_place(row["path"])
            digest, read = hashlib.sha256(), 0
            with system.open_input_stream(place) as stream:
                while chunk := stream.read(_CHUNK):
                    digest.update(chunk)
                    read += len(chunk)
            yield pa.RecordBatch.from_pylist([{"path": row["path"], "sha256": digest.hexdigest(), "bytes": read}])


def file_fingerprints(
    spark: SparkSession, root: str, suffixes: Sequence[str], *, in_row: int = IN_ROW, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """(path, sha256, bytes) of the files below a folder; files with other suffixes are never opened.

    Files of up to ``in_row`` bytes are hashed where Spark's reader has them as rows.  Larger ones, of any size,
    are only listed by it, dealt to tasks of about ``task_bytes``, and read there in chunks of 4 MB through Arrow's
    file systems: they have to be on one that Arrow knows (local, HDFS, S3, GCS, ABFS).  A file that grows meanwhile
    has the hash and the size of what was read.  Empty files have no row: Spark's readers do not list them.
    """
    pattern = "*.{" + ",".join(_any_case(s) for s in suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    small = files.where(C("length") <= in_row).select("path", F.sha2("content", 256).alias("sha256"), C("length").alias("bytes"))
    large = files.where(C("length") > in_row).select("path", "length")
    dealt = deal_by_size(large, "length", "path", task_bytes)
    if dealt is None:
        return small
    return small.unionByName(dealt.mapInArrow(_hash_files, "path string, sha256 string, bytes long"))


def deal_by_size(rows: DataFrame, size: str, key: str, task_bytes: int) -> DataFrame | None:
    """``rows`` in partitions of about ``task_bytes``, or None if there are none.

    Rows are parted by the power of two below their size, and each class dealt evenly over its share of the
    partitions, so that no partition holds many of the large ones.  The driver sees one sum a class, 63 at most.
    """
    power = F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")
    sums = rows.groupBy(power.alias("power")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).orderBy("power").collect()
    if not sums:
        return None
    first, pairs = 0, []
    for row in sums:
        parts = min(row.n, max(1, -(-int(row.bytes) // task_bytes)))
        pairs += [F.lit(row.power), F.struct(F.lit(first).alias("first"), F.lit(parts).alias("parts"))]
        first += parts
    share = F.element_at(F.create_map(*pairs), power)
    return rows.repartitionById(first, (share["first"] + F.pmod(F.xxhash64(key), share["parts"])).cast("int"))
