"""Packages: an export written once, published by a rename, described by a manifest.

A package is a folder of part files whose contents, one after the other (``head``, ``rows``, ``split``, ``tail``, each in
name order), are the export: a JSON document with its envelope, or CSV with comment and header. It is written under
a name of its own attempt, counted and hashed by the tasks that write it, then renamed; the manifest is written last, so a
reader that waits for it sees whole packages only.

The checksum is the root of a tree: chunks of a part, parts, groups of parts. The chunks' sums lie beside the package, so
that a changed part is known to the chunk.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from treeloom.definition import Envelope
from treeloom.plans.cells import typed_cells
from treeloom.plans.lines import (
    SCHEMA_VERSION,
    csv_comment,
    csv_header,
    csv_parts,
    envelope_frame,
    flat_json_parts,
    nested_json_parts,
    round_trip,
)
from treeloom.operators.checkpoints import checkpointed
from treeloom.plans.tree import TreeExport, cell_name
from treeloom.sinks.stream import CHUNK_BYTES, SUMS, drop_leftovers, file_sums, first_byte_off, write_stream

# Part names fall into this many groups, so that no checksum is taken over an unbounded list.
CHECKSUM_BUCKETS = 4096
TREE_FAN = 1024
RECORDS_PER_FILE = 100_000
PART_BYTES = 1 << 28
RECORDS = "(records)"


class EmptyExportError(RuntimeError):
    """The export has no records; nothing was published."""


class PackageError(RuntimeError):
    """The package could not be written; nothing was published."""


@dataclass(frozen=True)
class Format:
    """``ends`` gives what stands before and after the records, ``between`` what stands between two of them and
    ``after`` what ends each."""

    extension: str
    parts: Callable[[TreeExport], tuple[DataFrame, DataFrame | None]]
    ends: Callable[[TreeExport, Envelope | None, str, datetime], tuple[str, str]]
    between: str = ""
    after: str = ""


def _json_parts(export: TreeExport):
    return flat_json_parts(export) if export.named_by_leaf else nested_json_parts(export)


def _json_ends(export: TreeExport, envelope: Envelope | None, version: str, extracted_at: datetime) -> tuple[str, str]:
    return envelope_frame(envelope, extracted_at, version)


def _csv_ends(export: TreeExport, envelope: Envelope | None, version: str, extracted_at: datetime) -> tuple[str, str]:
    return csv_comment(version, extracted_at) + "\n" + csv_header(export.column_names()) + "\n", ""


FORMATS = {
    "json": Format("json", _json_parts, _json_ends, between=","),
    "csv": Format("csv", csv_parts, _csv_ends, after="\n"),
    "xlsx": Format("cells", TreeExport.flat_parts, lambda export, envelope, version, at: ("", "")),
}


def format_of(name: str) -> Format:
    """By name in any case; unknown names mean JSON."""
    return FORMATS.get(name.lower(), FORMATS["json"])


def package_name(sequence_no: int, extracted_at: datetime, extension: str) -> str:
    moment = extracted_at.astimezone(timezone.utc) if extracted_at.tzinfo else extracted_at
    return f"export_{sequence_no:04d}_{moment:%Y%m%dT%H%M%SZ}.{extension}"


def manifest_name(package: str) -> str:
    return package.rsplit(".", 1)[0] + ".manifest.json"


def write_package(
    export: TreeExport, folder: str, fmt: str, sequence_no: int, extracted_at: datetime,
    *, version: str = SCHEMA_VERSION, records_per_file: int = RECORDS_PER_FILE, envelope: Envelope | None = None,
) -> dict:
    """Write and publish one export; returns the manifest. ``envelope`` is the wrapper of a JSON document, that of
    the export's mapping if not given. Lines over the record budget are stored in the folder ``split``."""
    writer = format_of(fmt)
    name = package_name(sequence_no, extracted_at, writer.extension)
    final, parts_table = f"{folder}/{name}", f"{folder}/{name}.parts"
    staging = f"{final}.{uuid.uuid4().hex}.tmp"  # what another attempt left is never part of this one
    whole, pieces = writer.parts(export)
    spark = whole.sparkSession
    for taken in (final, f"{folder}/{manifest_name(name)}"):
        if _exists(spark, taken):
            raise PackageError(f"{taken} exists already")
    published = False
    try:
        if "line" in whole.columns:
            _write_lines(spark, staging, parts_table, writer, whole, pieces)
            records = spark.read.parquet(parts_table).agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
        else:
            counted = Observation("records")
            _write_cells(export, staging, whole.observe(counted, F.count(F.lit(1)).alias("n")), pieces, records_per_file)
            _sums_of_folder(spark, staging).write.mode("overwrite").parquet(parts_table)
            records = counted.get["n"]
        records += export.split_records
        if records == 0:
            raise EmptyExportError(f"export {sequence_no} has no records")
        head, tail = writer.ends(export, export.envelope if envelope is None else envelope, version, extracted_at)
        small = [(RECORDS, 0, 0, records, hashlib.sha256(str(records).encode()).hexdigest())]
        for part, text in (("head", head), ("tail", tail)):
            if text:
                name_of_part, raw = f"{part}.{writer.extension}", text.encode("utf-8")
                _write_text(spark, f"{staging}/{name_of_part}", text)
                cuts = range(0, len(raw), CHUNK_BYTES)
                small += [(name_of_part, n, len(raw[at : at + CHUNK_BYTES]), 0, hashlib.sha256(raw[at : at + CHUNK_BYTES]).hexdigest()) for n, at in enumerate(cuts)]
        spark.createDataFrame(small, SUMS).coalesce(1).write.mode("append").parquet(parts_table)
        digest = package_checksum(spark.read.parquet(parts_table))
        _rename(spark, staging, final)
        published = True
        manifest = {
            "SequenceNumber": sequence_no, "SchemaVersion": version, "ExtractedAt": round_trip(extracted_at),
            "RecordCount": records, "Sha256Checksum": digest,
        }
        _write_text(spark, f"{folder}/{manifest_name(name)}", json.dumps(manifest, indent=2))
    except EmptyExportError:
        _discard(spark, staging, parts_table)
        raise
    except Exception as error:
        _discard(spark, staging, parts_table, *([final] if published else []))
        raise PackageError(f"writing {name} failed: {error}") from error
    return manifest


def _write_lines(spark: SparkSession, staging: str, sums: str, writer: Format, whole: DataFrame, pieces: DataFrame | None) -> None:
    """Every record has the separator before it; the very first one loses it afterwards. The sums of the parts go to the
    table ``sums``; of the part that lost its first byte they are taken again."""
    lines = whole.select(F.concat(F.lit(writer.between), "line").alias("line"))
    found = write_stream(lines, f"{staging}/rows", PART_BYTES, end="\n")
    found.withColumn("name", F.concat(F.lit("rows/"), "name")).write.mode("overwrite").parquet(sums)
    if pieces is not None:
        first = pieces.groupBy("__record").agg(F.min("part").alias("first"), F.max("part").alias("last"))
        opens = F.when(F.col("part") == F.col("first"), F.lit(writer.between)).otherwise("")
        closes = F.when(F.col("part") == F.col("last"), F.lit(writer.after)).otherwise("")
        marked = pieces.join(first, "__record").select("__record", "part", F.concat(opens, "line", closes).alias("line"))
        found = write_stream(marked, f"{staging}/split", PART_BYTES, ["__record", "part"])
        found.select(F.concat(F.lit("split/"), "name").alias("name"), "chunk", "bytes", F.lit(0).cast("long").alias("records"), "sha256").write.mode("append").parquet(sums)
    written = spark.read.parquet(sums)
    for part in ("rows", "split"):
        drop_leftovers(spark, f"{staging}/{part}", written.where(F.startswith("name", F.lit(f"{part}/"))).select(F.substring("name", len(part) + 2, 1 << 20).alias("name")))
    if writer.between:
        shortened = written.where("bytes > 0").agg(F.min("name")).first()[0]  # rows before split, each in name order
        if shortened:
            first_byte_off(spark, f"{staging}/{shortened}")
            kept = written.where((F.col("name") == shortened)).agg(F.sum("records")).first()[0]
            again = file_sums(spark.createDataFrame([(_qualified(spark, f"{staging}/{shortened}"), shortened)], "path string, name string"))
            again = again.withColumn("records", F.when(F.col("chunk") == 0, kept).otherwise(0).cast("long"))
            written.where(F.col("name") != shortened).union(again).write.parquet(f"{sums}.new")
            _discard(spark, sums)
            _rename(spark, f"{sums}.new", sums)


def _write_cells(export: TreeExport, staging: str, whole: DataFrame, pieces: DataFrame | None, records_per_file: int) -> None:
    """Cells with the row's number; root keys are not part of a package."""
    names = export.column_names()
    places = [cell_name(number) for number in range(len(names))]
    rows = whole.withColumn("__row", F.monotonically_increasing_id())
    cells = typed_cells(rows, ["__row"], names, cells=places)
    cells.write.option("maxRecordsPerFile", records_per_file).parquet(f"{staging}/rows")
    _smaller(spark := rows.sparkSession, f"{staging}/rows", "parquet", records_per_file)
    if pieces is not None:
        fragments = typed_cells(pieces.withColumnRenamed("part", "__part"), ["__record"], names, "__part", cells=places)
        fragments.where("text <> ''").write.option("maxRecordsPerFile", records_per_file).parquet(f"{staging}/split")
        _smaller(spark, f"{staging}/split", "parquet", records_per_file)


def _smaller(spark: SparkSession, folder: str, kind: str, records_per_file: int) -> None:
    """Writes the files over the size limit again, each as several; the export itself does not run again."""
    while records_per_file > 1:
        files = spark.read.format("binaryFile").load(folder).where(~F.col("path").rlike(r"/[_.][^/]*$")).select("path", "length")
        large = [row["path"] for row in files.where(F.col("length") > PART_BYTES).limit(1000).collect()]
        if not large:
            return
        records_per_file = max(1, records_per_file // 4)
        for path in large:
            spark.read.format(kind).load(path).write.mode("append").option("maxRecordsPerFile", records_per_file).format(kind).save(folder)
            _discard(spark, path)


def package_text(spark: SparkSession, package: str) -> DataFrame:
    """``section`` (head, rows, split, tail as 0 to 3), ``name``, ``content`` of the parts of a JSON or CSV package: in this
    order their contents are the export."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(package)
    section = F.when(F.col("path").rlike(r"/head\.[a-z]+$"), 0).when(F.col("path").rlike("/rows/[^/]*$"), 1).when(
        F.col("path").rlike("/split/[^/]*$"), 2
    ).otherwise(3)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(section.alias("section"), name.alias("name"), F.col("content")).where(~F.col("name").rlike("^[_.]"))


def package_records(spark: SparkSession, package: str) -> DataFrame:
    """The records of a JSON package as a column ``record`` (VARIANT), read where they lie. A package with records that
    were too large for a row has no such column for them and is refused."""
    if _exists(spark, f"{package}/split"):
        raise PackageError(f"{package} holds records over the row budget")
    if not _exists(spark, f"{package}/rows"):
        raise PackageError(f"{package} has no records")
    lines = spark.read.text(f"{package}/rows").where("value <> ''")
    return lines.select(F.parse_json(F.regexp_replace("value", "^,", "")).alias("record"))


def write_document(lines: DataFrame, target: str) -> None:
    """One JSON document (see ``document_lines``) over ordered files: their contents in name order are the document."""
    found = f"{target}.{uuid.uuid4().hex}.sums"
    write_stream(lines, target, PART_BYTES, ["section", "record", "part"]).write.parquet(found)
    drop_leftovers(lines.sparkSession, target, lines.sparkSession.read.parquet(found))
    _discard(lines.sparkSession, found)


def _sums_of_folder(spark: SparkSession, package: str) -> DataFrame:
    """The sums of all parts of a package, read once."""
    inside = F.length(F.lit(_qualified(spark, package))) + 2
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(package).where(~F.col("path").rlike(r"/[_.][^/]*$"))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return file_sums(files.select("path", F.expr("path").substr(inside, F.lit(1 << 20)).alias("name")).repartition(spread, "path"))


def package_checksum(sums: DataFrame) -> str:
    """The root of the tree over the chunks' sums: groups of neighbouring chunks, level by level, up to one sum for each
    part; then groups of parts by their names, and the groups."""

    def digest(texts):
        return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(texts)), lambda one: one["text"]), "\n"), 256)

    largest = sums.agg(F.max("chunk")).first()[0] or 0
    level = sums.select("name", "chunk", "sha256")
    while True:
        upper = F.floor(F.col("chunk") / TREE_FAN).alias("upper")
        level = level.groupBy("name", upper).agg(digest(F.struct("chunk", F.col("sha256").alias("text"))).alias("sha256")).withColumnRenamed("upper", "chunk")
        if largest < TREE_FAN:
            break
        largest //= TREE_FAN
    bucket = F.pmod(F.xxhash64("name"), F.lit(CHECKSUM_BUCKETS)).alias("bucket")
    entry = F.struct("name", F.concat("name", F.lit(":"), "sha256").alias("text"))
    buckets = level.groupBy(bucket).agg(digest(entry).alias("sha256"))
    return buckets.agg(digest(F.struct("bucket", F.concat(F.col("bucket").cast("string"), F.lit(":"), "sha256").alias("text"))).alias("sha256")).first()["sha256"]


def read_manifest(spark: SparkSession, folder: str, package: str) -> dict:
    text = spark.read.text(f"{folder}/{manifest_name(package)}", wholetext=True).first()[0]
    return json.loads(text)


def damaged_chunks(spark: SparkSession, folder: str, package: str) -> DataFrame:
    """``name``, ``chunk``, ``problem`` (missing, not listed, changed) of every chunk that differs from its stored sum."""
    stored = spark.read.parquet(f"{folder}/{package}.parts").where(F.col("name") != RECORDS).select("name", "chunk", F.col("sha256").alias("stored"))
    actual = _sums_of_folder(spark, f"{folder}/{package}").select("name", "chunk", F.col("sha256").alias("actual"))
    problem = (
        F.when(F.col("actual").isNull(), "missing").when(F.col("stored").isNull(), "not listed").when(F.col("actual") != F.col("stored"), "changed")
    )
    return stored.join(actual, ["name", "chunk"], "full").select("name", "chunk", problem.alias("problem")).where("problem is not null")


def verify_package(spark: SparkSession, folder: str, package: str) -> DataFrame:
    """What differs from the manifest: ``name, problem``; no rows for a sound package. The parts are read once; whether the
    stored sums themselves are those of the manifest needs no part."""
    manifest = read_manifest(spark, folder, package)
    stored = spark.read.parquet(f"{folder}/{package}.parts")
    damaged = damaged_chunks(spark, folder, package).groupBy("name").agg(F.collect_set("problem").alias("found"))
    each = F.when(F.array_contains("found", "changed") | (F.size("found") > 1), "changed").otherwise(F.col("found")[0])
    problems = checkpointed(damaged.select("name", each.alias("problem")))
    records = stored.where(F.col("name") == RECORDS).agg(F.sum("records")).first()[0]
    broken = package_checksum(stored) != manifest["Sha256Checksum"] or not problems.isEmpty()
    summary = [
        (package, problem)
        for problem, wrong in (("checksum differs", broken), ("record count differs", records != manifest["RecordCount"]))
        if wrong
    ]
    return problems.union(spark.createDataFrame(summary, "name string, problem string"))


def expired_files(spark: SparkSession, folder: str, cutoff: datetime) -> DataFrame:
    """Package files last written before the cutoff; a listing, nothing is deleted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "modificationTime", "length").where(F.col("modificationTime") < F.lit(cutoff))


# --- files --------------------------------------------------------------------------------------


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _qualified(spark: SparkSession, path: str) -> str:
    """As Spark lists it."""
    files, target = _file_system(spark, path)
    return files.makeQualified(target).toString()


def _exists(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    return files.exists(target)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    files, old = _file_system(spark, source)
    if not files.rename(old, _file_system(spark, target)[1]):
        raise PackageError(f"cannot rename {source}")


def _discard(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        files, target = _file_system(spark, path)
        if files.exists(target):
            files.delete(target, True)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    files, target = _file_system(spark, path)
    stream = files.create(target, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
