"""Text written by tasks to byte-bounded files, hashed as it is written.

A file is a row of chunks of ``CHUNK_BYTES``. The task that writes it returns one row for each chunk, with its bytes,
its records and its SHA-256. These rows are the commit messages: the caller stores them as a table, whose committer takes
one attempt of each task, and files that no stored row names are leftovers of other attempts (see ``drop_leftovers``).
So no file is read again to be hashed, and retries or speculation do no harm.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
SUMS = "name string, chunk long, bytes long, records long, sha256 string"
# Names under which the Python file systems know the schemes that Hadoop uses.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def write_stream(
    lines: DataFrame, target: str, most_bytes: int, order: list[str] | None = None, end: str = "", chunk_bytes: int | None = None
) -> DataFrame:
    """Writes the column ``line``, each with ``end`` after it, when the result is computed: ``name``, ``chunk``, ``bytes``,
    ``records``, ``sha256``. With ``order`` the files in name order are the text in that order; without, lines stay in the
    partitions they are in. A file ends after the line with which it holds ``most_bytes``."""
    if order:
        lines = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    return lines.select("line").mapInPandas(_writer(_with_scheme(lines.sparkSession, target), most_bytes, end, chunk_bytes or CHUNK_BYTES), SUMS)


def open_files(target: str):
    """A Python file system and the path in it."""
    from pyarrow import fs

    scheme, colon, rest = target.partition(":")
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


def _with_scheme(spark: SparkSession, target: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _writer(target: str, most_bytes: int, end: str, chunk_bytes: int):
    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = open_files(target)
        system.create_dir(root, recursive=True)
        task, number, out, size, held, records, done = TaskContext.get().partitionId(), 0, None, 0, bytearray(), 0, []

        def flush(upto: int) -> None:
            nonlocal records
            part = bytes(held[:upto])
            out.write(part)
            done.append((name, sum(row[0] == name for row in done), len(part), records, hashlib.sha256(part).hexdigest()))
            records = 0
            del held[:upto]

        for batch in batches:
            for line in batch["line"]:
                data = line.encode("utf-8", "replace") + end.encode()
                if out is None:
                    name, size = f"part-{task:05d}-{number:05d}-{uuid.uuid4().hex[:12]}", 0
                    out, number = system.open_output_stream(f"{root}/{name}", compression=None), number + 1
                held += data
                size += len(data)
                records += 1
                while len(held) >= chunk_bytes:
                    flush(chunk_bytes)
                if size >= most_bytes:
                    if held:
                        flush(len(held))
                    out.close()
                    out = None
                    yield pd.DataFrame(done, columns=["name", "chunk", "bytes", "records", "sha256"])
                    done = []
        if out is not None:
            if held:
                flush(len(held))
            out.close()
        yield pd.DataFrame(done, columns=["name", "chunk", "bytes", "records", "sha256"])

    return written


def drop_leftovers(spark: SparkSession, folder: str, names: DataFrame) -> None:
    """Deletes the files of a folder that the column ``name`` does not list: few, those of attempts that did not count."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return
    found = spark.read.format("binaryFile").load(folder).select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    for row in found.join(names.select("name").distinct(), "name", "left_anti").toLocalIterator():
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(row["path"]), False)


def file_sums(files: DataFrame, chunk_bytes: int | None = None) -> DataFrame:
    """The sums of the files that ``path`` and ``name`` list, read in chunks by the tasks they are dealt to; of any size. A
    file that cannot be read has no row."""
    size = chunk_bytes or CHUNK_BYTES

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, name in zip(batch["path"], batch["name"]):
                system, place = open_files(path)
                with system.open_input_stream(place, compression=None) as source:
                    chunk, rows = 0, []
                    while part := source.read(size):
                        rows.append((name, chunk, len(part), 0, hashlib.sha256(part).hexdigest()))
                        chunk += 1
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["name", "chunk", "bytes", "records", "sha256"])
                            rows = []
                yield pd.DataFrame(rows, columns=["name", "chunk", "bytes", "records", "sha256"])

    return files.select("path", "name").mapInPandas(summed, SUMS)


def first_byte_off(spark: SparkSession, path: str) -> None:
    """The same file without its first byte, for a file of bounded size."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    short = spark._jvm.org.apache.hadoop.fs.Path(path + ".short")
    conf = spark._jsc.hadoopConfiguration()
    files = target.getFileSystem(conf)
    source, out = files.open(target), files.create(short, True)
    source.seek(1)
    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, True)
    files.delete(target, False)
    files.rename(short, target)
