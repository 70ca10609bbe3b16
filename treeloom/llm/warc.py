"""WARC archives: writing, a normaliser for monolithic gzip files, and reading by offset index.

A writer makes one gzip stream per file. The normaliser inflates such a stream once, as it comes, and writes every
record as a gzip member of its own, with a sidecar index of member offsets; the reader fetches members by the
index. Files are read and written piece by piece through ``pyarrow.fs`` in a folder that all executors share. A
task writes under a name of its own attempt and renames at the end, so a task that runs again or twice does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.operators.checkpoints import checkpointed, shared_folder

PIECE = 1 << 20
LEVEL = 6  # the usual one
NAME = "https://record.invalid/"
DATE = "2026-01-01T00:00:00Z"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(key: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record. A revisit keeps the HTTP head, with the payload's length, and leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{NAME}{key}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{NAME}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _line(text: str | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in text or "")


def headers_of(head: bytes) -> dict[str, str]:
    """Header names in lower case; continued lines are joined."""
    found: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").splitlines()[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


class Records:
    """Splits a growing stream of inflated bytes into records."""

    def __init__(self) -> None:
        self.held = bytearray()
        self.need = 0

    def feed(self, piece: bytes) -> Iterator[bytes]:
        self.held += piece
        while len(self.held) >= self.need:
            skip = 0
            while self.held[skip : skip + 1] in (b"\r", b"\n"):  # before a record, more line ends than it needs
                skip += 1
            if skip:
                del self.held[:skip]
            end = self.held.find(b"\r\n\r\n")
            if end < 0:
                self.need = len(self.held) + 1
                return
            size = end + 4 + int(headers_of(bytes(self.held[:end]))["content-length"]) + 4
            if len(self.held) < size:
                self.need = size
                return
            yield bytes(self.held[:size])
            del self.held[:size]
            self.need = 0

    def end(self) -> None:
        if bytes(self.held).strip(b"\r\n"):
            raise ValueError("the archive ends inside a record")


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file, whether one member or many."""
    inflate, raw, started = zlib.decompressobj(31), b"", False
    while True:
        raw = raw or source.read(PIECE)
        if not raw:
            if started and (rest := inflate.flush()):
                yield rest
            if started and not inflate.eof:
                raise ValueError("the gzip stream is cut off")
            return
        if inflate.eof:
            raw = raw.lstrip(b"\0")  # padding between members
            if not raw:
                continue
            inflate = zlib.decompressobj(31)
        piece, started = inflate.decompress(raw, PIECE), True
        raw = inflate.unconsumed_tail or inflate.unused_data
        if piece:
            yield piece


def _attempt(path: str) -> str:
    return f"{path}.{uuid.uuid4().hex}.tmp"


def _write(folder: str):
    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = place(folder)
        path = f"{root}/{TaskContext.get().partitionId():06d}.warc.gz"
        temporary, count, deflate, out = _attempt(path), 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31), None
        for batch in batches:
            for key, url, payload, refers_to in batch[["id", "url", "payload", "refers_to"]].itertuples(index=False, name=None):
                out = out or system.open_output_stream(temporary, compression=None)
                body = payload.encode("utf-8", "replace") if payload is not None else b""
                refers = None if pd.isna(refers_to) else str(int(refers_to))
                out.write(deflate.compress(record("" if pd.isna(key) else str(int(key)), url, body, base32_sha1(body), refers)))
                count += 1
        if out:
            out.write(deflate.flush())
            out.close()
            system.move(temporary, path)
            yield pd.DataFrame({"path": [path], "records": [count]})

    return written


def _normalise(folder: str):
    def normalised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = place(folder)
        for batch in batches:
            for source in batch["path"]:
                path = f"{root}/{source.rsplit('/', 1)[-1].removesuffix('.gz').removesuffix('.warc')}.warc.gz"
                temporary, offset, count, records = _attempt(path), 0, 0, Records()
                with (
                    system.open_input_stream(source, compression=None) as raw,
                    system.open_output_stream(temporary, compression=None) as out,
                    system.open_output_stream(temporary + ".idx", compression=None) as index,
                ):
                    for piece in inflated(raw):
                        for one in records.feed(piece):
                            member = zlib.compress(one, LEVEL, 31)
                            name = headers_of(one[: one.find(b"\r\n\r\n")]).get("warc-record-id", "")
                            out.write(member)
                            index.write(json.dumps([offset, len(member), name]).encode() + b"\n")
                            offset += len(member)
                            count += 1
                    records.end()
                system.move(temporary + ".idx", f"{path}.idx")
                system.move(temporary, path)
                yield pd.DataFrame({"path": [path], "records": [count]})

    return normalised


def _read(folder: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = place(folder)
        for batch in batches:
            for path in batch["path"]:
                out = []
                with system.open_input_file(path) as archive, system.open_input_stream(f"{path}.idx", compression=None) as index:
                    for offset, length, _ in map(json.loads, _lines(index)):
                        archive.seek(offset)
                        out.append(_parsed(zlib.decompress(archive.read(length), 31)))
                        if len(out) == 200:
                            yield pd.DataFrame(out, columns=COLUMNS)
                            out = []
                yield pd.DataFrame(out, columns=COLUMNS)

    return read


COLUMNS = ["record_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while piece := stream.read(PIECE):
        *lines, rest = (rest + piece).split(b"\n")
        yield from lines
    if rest:
        yield rest


def _parsed(one: bytes) -> tuple:
    split = one.find(b"\r\n\r\n")
    head = headers_of(one[:split])
    body = one[split + 4 : split + 4 + int(head["content-length"])]
    end = body.find(b"\r\n\r\n")
    http = headers_of(body[:end])
    payload = body[end + 4 :] if head["warc-type"] == "response" else None
    number = lambda name: head[name].strip("<>").removeprefix(NAME) if name in head else None
    size = len(payload) if payload is not None else int(http["content-length"])
    digest = base32_sha1(payload) if payload is not None else head["warc-payload-digest"].removeprefix("sha1:")
    return number("warc-record-id"), head.get("warc-target-uri"), head["warc-type"], number("warc-refers-to"), digest, size, payload


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """``path``, ``records`` of one monolithic file per partition of ``records`` (id, url, payload: string, refers_to)."""
    _make(folder)
    return checkpointed(records.mapInPandas(_write(folder), "path string, records long"))


def normalise_archives(files: DataFrame, folder: str) -> DataFrame:
    """``path``, ``records`` of the normalised files in ``folder``, each with its index at ``path`` + ``.idx``. ``files`` has
    the ``path`` of gzip archives, of one member or many; their file names must differ."""
    _make(folder)
    return checkpointed(_spread(files).mapInPandas(_normalise(folder), "path string, records long"))


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """The records of normalised archives; ``payload`` is null for revisits. Digests of responses are computed anew."""
    return _spread(files).mapInPandas(
        _read(folder), "record_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"
    )


def _make(folder: str) -> None:
    system, root = place(folder)
    system.create_dir(root, recursive=True)


def _spread(files: DataFrame) -> DataFrame:
    tasks = max(1, min(files.count(), 10_000))
    return files.select("path").repartition(tasks, "path")


def archive_pages(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", smallest: int = 0
) -> DataFrame:
    """Writes ``pages`` to archives, normalises them, and reads them back: ``page_id``, ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to``, ``url``, one row per record.

    Of records with equal payloads of at least ``smallest`` bytes, that with the largest id is a response and the
    others revisit it; smaller payloads are all responses. A null payload is empty. Rows that repeat an id are
    records of their own; where the largest id of equal payloads repeats, all its rows are responses. A row with
    a null id is a response. Other columns are ignored. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    digests = rows.where(F.col("id").isNotNull() & (F.octet_length("payload") >= smallest)).select("id", F.sha1(F.col("payload").cast("binary")).alias("sha1"))
    digests = checkpointed(digests)
    last = digests.groupBy("sha1").agg(F.max("id").alias("last"), F.min("id").alias("least")).where("least < last")
    again = digests.join(last, "sha1").where("id < last").select("id", "sha1", F.col("last").alias("refers_to")).distinct()
    own = F.sha1(F.col("payload").cast("binary"))
    marked = rows.withColumn("sha1", own).join(again, ["id", "sha1"], "left").select("id", "url", "payload", "refers_to")
    written = write_archives(marked, f"{folder}/monolithic")
    normal = normalise_archives(written, f"{folder}/normal")
    number = lambda name: F.when(F.col(name) != "", F.col(name)).cast("long")
    return read_archives(normal, folder).select(
        number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "url"
    )
