"""Substring dedup with content-defined chunks.

A gear rolling hash over the UTF-8 bytes (its last 32 bytes count) sets a chunk's end wherever chosen bits are zero,
so that chunk limits depend on the text around them and come back after an insertion. Chunks are compared by a
128-bit digest. A repeated chunk is one whose digest occurs earlier, by (document id, text hash, place). Most chunks
occur once: parts of the digests alone are dealt first, those that meet another fill a Bloom filter, and only chunks
that pass it are dealt with their places. Runs of neighbouring repeated chunks are seeds: ``whole_passages`` extends them byte by byte to both sides as long as the text
equals that around the first occurrence of the run's outer chunk, and then asks for ``least`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.filters import bloom, may_hold
from treeloom.operators.checkpoints import checkpointed

GEAR = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
MASK = np.uint32(0b11111 << 27)  # high bits: they depend on the last 28 to 32 bytes; on average every 32nd place ends a chunk
SHORTEST, LONGEST = 16, 256
PIECE = 1 << 20  # bytes hashed at once
REACH = 512  # bytes compared to each side of a run at first; four times as many where all are equal
ENTRIES = 500_000  # parts of digests compared in one task, about
HELD = 1 << 20  # and held by a task before they are dealt
FEW_ENDS = 10_000  # of so few runs' ends the documents are found by a broadcast


def gear_ends(data: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash asks for a cut."""
    ends = []
    for start in range(0, len(data), PIECE):
        from_ = max(0, start - 31)
        value = GEAR[data[from_ : start + PIECE]]
        for width in (1, 2, 4, 8, 16):
            if len(value) > width:
                value[width:] = value[width:] + (value[:-width] << np.uint32(width))
        hits = np.flatnonzero(value & MASK == 0) + from_
        ends.append(hits[hits >= start] + 1)
    return np.concatenate(ends) if ends else np.zeros(0, np.int64)


def chunk_limits(data: np.ndarray) -> list[int]:
    """0, the ends of all chunks but the last, and the length."""
    limits, last = [0], 0
    for end in gear_ends(data).tolist():
        while end - last > LONGEST:
            last += LONGEST
            limits.append(last)
        if end - last >= SHORTEST:
            limits.append(end)
            last = end
    while len(data) - last > LONGEST:
        last += LONGEST
        limits.append(last)
    if len(data) > last:
        limits.append(len(data))
    return limits


def _digests(raw: bytes, limits: list[int]) -> bytes:
    return b"".join(xxhash.xxh3_128_digest(raw[start:end]) for start, end in zip(limits, limits[1:]))


def digest_keys(digests: bytes | bytearray, buckets: int) -> np.ndarray:
    """Of every digest its bucket and 32 more bits, as one number: the more chunks, the more buckets and bits."""
    pairs = np.frombuffer(bytes(digests), np.uint64).reshape(-1, 2)
    return (pairs[:, 1] % np.uint64(buckets)) << np.uint64(32) | pairs[:, 0] & np.uint64(0xFFFFFFFF)


def _dealt(buckets: int):
    """Keys by their bucket, packed; of equal ones that a task holds at a time two are enough."""

    def packed(held: list[np.ndarray]) -> pd.DataFrame:
        keys = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        keys = keys[np.r_[True, True, keys[2:] != keys[:-2]][: len(keys)]]
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, np.diff(bucket) > 0][: len(bucket)])
        low = keys.astype(np.uint32)
        return pd.DataFrame({"bucket": bucket[starts], "entries": [low[a:b].tobytes() for a, b in zip(starts, np.r_[starts[1:], len(low)])]})

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for batch in batches:
            for text in batch["text"]:
                raw = (text or "").encode("utf-8", "replace")
                held.append(digest_keys(_digests(raw, chunk_limits(np.frombuffer(raw, np.uint8))), buckets))
            if sum(map(len, held)) >= HELD:
                yield packed(held)
                held = []
        yield packed(held)

    return dealt


def _met(bucket: pd.DataFrame) -> pd.DataFrame:
    keys = np.sort(np.frombuffer(b"".join(bucket["entries"]), np.uint32))
    keys = np.unique(keys[1:][keys[1:] == keys[:-1]]).astype(np.int64)
    return pd.DataFrame({"key": keys + (int(bucket["bucket"].iloc[0]) << 32)})


def may_repeat(docs: DataFrame, text_col: str = "text") -> tuple[Broadcast, int]:
    """A filter of the chunks that occur more than once, and the number of buckets its keys are made with."""
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    buckets = 1 + size // (2 * SHORTEST * ENTRIES)
    keys = docs.select(F.col(text_col).alias("text")).mapInPandas(_dealt(buckets), "bucket long, entries binary")
    met = bloom(checkpointed(keys.groupBy("bucket").applyInPandas(_met, "key long")))
    return docs.sparkSession.sparkContext.broadcast(met), buckets  # at most 64 MB, see filters


def _chunked(met: tuple[Broadcast, int] | None):
    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts, numbers, starts, ends, digests = [], [], [], [], [], bytearray()
            for key, of_text, text in zip(batch["id"], batch["of_text"], batch["text"]):
                raw = (text or "").encode("utf-8", "replace")
                limits = chunk_limits(np.frombuffer(raw, np.uint8))
                digests += _digests(raw, limits)
                count = len(limits) - 1
                ids += [key] * count
                texts += [of_text] * count
                numbers.append(np.arange(count, dtype=np.int32))
                starts += limits[:-1]
                ends += limits[1:]
            pairs = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
            frame = pd.DataFrame({
                "id": pd.array(ids, "Int64"), "of_text": texts, "chunk": np.concatenate(numbers) if numbers else [],
                "start": starts, "end": ends, "d0": pairs[:, 0], "d1": pairs[:, 1],
            })
            yield frame[may_hold(met[0].value, digest_keys(digests, met[1]))] if met else frame

    return chunked


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", met: tuple[Broadcast, int] | None = None) -> DataFrame:
    """``id``, ``of_text``, ``chunk`` (number), ``start``, ``end`` (bytes), ``d0``, ``d1`` (digest) of every chunk; with
    ``met`` (see ``may_repeat``) of those that may occur more than once."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("of_text"), F.col(text_col).alias("text"))
    return texts.mapInPandas(_chunked(met), "id long, of_text long, chunk int, start int, end int, d0 long, d1 long")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 120) -> DataFrame:
    """One row per repeated passage: ``doc_id``, ``start``, ``end`` (bytes of the UTF-8 text, end exclusive), ``chunks``,
    ``first_doc_id`` (a document that has the passage's longest chunk earlier, the first such).

    The first occurrence of a passage is not listed; repetitions inside a document are. Null and empty texts have no
    chunks. Rows that repeat both id and text are one document. A null id counts as the smallest. Other columns are
    ignored; an empty table gives an empty result.
    """
    runs = _runs(docs, id_col, text_col).where(F.col("end") - F.col("start") >= least)
    return runs.select(F.col("id").alias("doc_id"), "start", "end", "chunks", "first_doc_id")


def _runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Runs of neighbouring repeated chunks, and where their outer chunks occur first: ``head`` and ``tail`` (id, of_text
    and the place of the run's start or end there)."""
    cut = chunks(docs, id_col, text_col, may_repeat(docs, text_col))  # cut again rather than kept: cutting costs less than the disk
    place = F.struct("id", "of_text", "chunk", "start")
    # Counted, not compared by place: chunks that only rows repeating both id and text have drop out below.
    first = cut.groupBy("d0", "d1").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("places")).where("places > 1").drop("places")
    again = (
        cut.join(first, ["d0", "d1"]).where(place != F.col("first"))
        .select("id", "of_text", "chunk", "start", "end", "first")
        .distinct()
    )
    in_order = Window.partitionBy("id", "of_text").orderBy("chunk")
    runs = again.withColumn("run", F.col("chunk") - F.row_number().over(in_order))
    longest = F.struct((F.col("end") - F.col("start")).alias("size"), -F.col("chunk"), F.col("first.id").alias("first_doc_id"))
    there = F.col("first.start")
    outer = lambda at: F.struct("chunk", F.col("first.id").alias("id"), F.col("first.of_text").alias("of_text"), at.alias("at"))
    return runs.groupBy("id", "of_text", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("chunks"), F.max(longest)["first_doc_id"].alias("first_doc_id"),
        F.min(outer(there)).alias("head"), F.max(outer(there + F.col("end") - F.col("start"))).alias("tail"),
    )


def _around(raw: bytes, at: int, after: bool, reach: int) -> bytes:
    return raw[at : at + reach] if after else raw[max(0, at - reach) : at]


def _contexts(reach: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, no_id, of_text, text, *wanted in zip(*(batch[name] for name in (*DOCUMENT, "text", "at", "after"))):
                raw = text.encode("utf-8", "replace")
                out += [(key, no_id, of_text, at, after, _around(raw, at, after, reach)) for at, after in zip(*wanted)]
            yield pd.DataFrame(out, columns=[*THERE, "bytes"])

    return read


def equal_bytes(mine: bytes, other: bytes, after: bool) -> int:
    """How many first bytes (last ones, if not ``after``) are equal, whole letters of ``mine``."""
    if not after:
        mine, other = mine[::-1], other[::-1]
    size = min(len(mine), len(other))
    differ = np.frombuffer(mine, np.uint8, size) != np.frombuffer(other, np.uint8, size)
    size = int(differ.argmax()) if differ.any() else size
    edge = lambda: mine[size : size + 1] if after else mine[size - 1 : size]  # noqa: E731  the first byte of a letter
    while size and edge() and 0x80 <= edge()[0] < 0xC0:
        size -= 1
    return size


DOCUMENT = ("key", "no_id", "of_text")  # a document: its id (0 for null), whether that is null, and its text's hash
THERE = ("t_key", "t_no_id", "t_of_text", "t_at", "after")  # a place in a document, and to which side
END = ("run", "after", "at", *THERE[:4])


def _compared(reach: int):
    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, no_id, of_text, text, others, *ends in zip(*(batch[name] for name in (*DOCUMENT, "text", "bytes", *END))):
                raw = text.encode("utf-8", "replace")
                for other, *end in zip(others, *ends):
                    mine = _around(raw, end[2], end[1], reach)
                    whole = len(mine) == reach and mine == other
                    out.append((key, no_id, of_text, *end, equal_bytes(mine, other, end[1]), whole))
            yield pd.DataFrame(out, columns=[*DOCUMENT, *END, "more", "whole"])

    return compared


def _document(id_: Column | str, of_text: Column | str, before: str = "") -> list[Column]:
    id_, of_text = (F.col(c) if isinstance(c, str) else c for c in (id_, of_text))
    return [c.alias(before + name) for c, name in zip((F.coalesce(id_, F.lit(0)), id_.isNull(), of_text), DOCUMENT)]


def _extended(ends: DataFrame, docs: DataFrame, reach: int) -> DataFrame:
    """``ends`` of runs (``DOCUMENT`` and ``END``: the first occurrence's place with ``t_``) with ``more``, the equal bytes
    beyond them, and ``whole``: all that were compared are equal. The bytes around first occurrences go to the documents
    that repeat them; each text is shuffled once, if only few are asked for no other."""
    if len(ends.take(FEW_ENDS + 1)) <= FEW_ENDS:
        asked = ends.select(*DOCUMENT).union(ends.select(*THERE[:3])).distinct()
        docs = docs.join(F.broadcast(asked), list(DOCUMENT), "left_semi")
    texts = docs.dropDuplicates(list(DOCUMENT))  # rows that repeat id and text
    places = ends.select(*[F.col(t).alias(name) for t, name in zip(THERE, (*DOCUMENT, "at", "after"))]).distinct()
    places = places.groupBy(*DOCUMENT).agg(F.collect_list(F.struct("at", "after")).alias("each"))
    places = places.select(*DOCUMENT, F.col("each.at").alias("at"), F.col("each.after").alias("after"))
    kinds = "t_key long, t_no_id boolean, t_of_text long, t_at int, after boolean"
    there = texts.join(places, list(DOCUMENT)).select(*DOCUMENT, "text", "at", "after").mapInPandas(_contexts(reach), f"{kinds}, bytes binary")
    mine = ends.join(there, list(THERE)).groupBy(*DOCUMENT).agg(F.collect_list(F.struct("bytes", *END)).alias("each"))
    mine = mine.select(*DOCUMENT, *[F.col(f"each.{name}").alias(name) for name in ("bytes", *END)])
    kinds = "key long, no_id boolean, of_text long, run int, after boolean, at int, t_key long, t_no_id boolean, t_of_text long, t_at int"
    return texts.join(mine, list(DOCUMENT)).select(*DOCUMENT, "text", "bytes", *END).mapInPandas(_compared(reach), f"{kinds}, more int, whole boolean")


def whole_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 120) -> DataFrame:
    """As ``repeated_passages``, from where the copy begins to where it ends: runs of any size are extended against the
    first occurrence of their outer chunks, those that then overlap are one (``chunks`` added up, ``first_doc_id`` of
    the largest), and ``least`` bytes are asked of the result. A passage in which no chunk lies whole is not found."""
    texts = docs.where(F.col(text_col).isNotNull()).select(*_document(F.col(id_col).cast("long"), F.xxhash64(text_col)), F.col(text_col).alias("text"))
    runs = checkpointed(_runs(docs, id_col, text_col).withColumn("run", F.col("run").cast("int")))
    side = lambda after, at, outer: runs.select(
        *_document("id", "of_text"), "run", F.lit(after).alias("after"), F.col(at).cast("int").alias("at"),
        *_document(f"{outer}.id", f"{outer}.of_text", "t_"), F.col(f"{outer}.at").cast("int").alias("t_at"),
    )
    ends, limits, reach = side(False, "start", "head").union(side(True, "end", "tail")), [], REACH
    while True:
        found = checkpointed(_extended(ends, texts, reach))
        step = F.when(F.col("after"), F.col("more")).otherwise(-F.col("more"))
        found = found.withColumn("at", F.col("at") + step).withColumn("t_at", F.col("t_at") + step)
        limits.append(found.where("not whole").select(F.when(~F.col("no_id"), F.col("key")).alias("id"), "of_text", "run", "at"))
        ends = found.where("whole").drop("more", "whole")
        if ends.isEmpty():
            break
        reach *= 4
    every = limits[0]
    for each in limits[1:]:
        every = every.union(each)
    limit = every.groupBy("id", "of_text", "run").agg(F.min("at").alias("start"), F.max("at").alias("end"))
    limit = limit.select(F.col("id").alias("of_id"), F.col("of_text").alias("of"), F.col("run").alias("of_run"), "start", "end")
    same = runs["id"].eqNullSafe(limit["of_id"]) & (runs["of_text"] == limit["of"]) & (runs["run"] == limit["of_run"])
    long = runs.drop("start", "end").join(limit, same)
    in_order = Window.partitionBy("id", "of_text").orderBy("start", "end", "run")
    before = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    long = long.withColumn("new", F.when(F.col("start") < before, 0).otherwise(1)).withColumn("passage", F.sum("new").over(in_order))
    largest = F.struct((F.col("end") - F.col("start")).alias("size"), -F.col("run"), "first_doc_id")
    return (
        long.groupBy("id", "of_text", "passage")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("chunks").alias("chunks"), F.max(largest)["first_doc_id"].alias("first_doc_id"))
        .where(F.col("end") - F.col("start") >= least)
        .select(F.col("id").alias("doc_id"), "start", "end", "chunks", "first_doc_id")
    )


def _without(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch["text"], batch["spans"]):
            raw, kept, at = text.encode("utf-8", "replace"), [], 0
            for span in sorted(spans, key=lambda s: s["start"]):
                kept.append(raw[at : span["start"]])
                at = max(at, span["end"])
            kept.append(raw[at:])
            texts.append(b"".join(kept).decode("utf-8", "ignore"))  # a cut letter goes
        yield pd.DataFrame({"id": batch["id"].astype("Int64"), "text": texts})


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 120) -> DataFrame:
    """``doc_id`` and ``text`` of every distinct document, without its repeated passages (see ``whole_passages``;
    of documents that share an id, each loses the passages found in any of them)."""
    found = whole_passages(docs, id_col, text_col, least).groupBy(F.col("doc_id").alias("of")).agg(
        F.collect_list(F.struct("start", "end")).alias("spans")
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    whole = texts.join(found, texts["id"].eqNullSafe(found["of"]), "left")
    cut = whole.where("spans is not null and text is not null").select("id", "text", "spans").mapInPandas(_without, "id long, text string")
    return whole.where("spans is null or text is null").select("id", "text").union(cut).select(F.col("id").alias(id_col), F.col("text").alias(text_col))
