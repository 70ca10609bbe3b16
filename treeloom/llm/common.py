"""Helpers that several operators share: words, connected groups, and blocks of large groups."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.operators.checkpoints import checkpointed

#: Bytes that separate words: ASCII without line feeds, letters, digits and the underscore, all turned to blanks.
BETWEEN = bytes(byte if byte >= 128 or chr(byte).isalnum() or byte in b"_\n" else 32 for byte in range(256))
#: Unicode's blanks, dashes, quotes and marks of punctuation beyond ASCII that separate words as well.
MARKS = re.compile("[\u0080-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u2000-\u206f\u3000-\u3003\u3008-\u3020\u30fb\uff01-\uff0f\uff1a-\uff20\uff5b-\uff65]")
PIECE = 1 << 20
_random = np.random.default_rng(13)
LETTER = _random.integers(0, 2**63, 256, dtype=np.uint64)
POWER = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cleaned(text: str | None) -> bytes:
    """A lower-cased text in UTF-8, with blanks for punctuation, control characters and white space but line feeds."""
    text = (text or "").lower()
    if not text.isascii():
        text = MARKS.sub(" ", text)
    return text.encode("utf-8", "surrogatepass").translate(BETWEEN)


def hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between white space of a cleaned text, and where each begins. A text is hashed in
    pieces that end between words, so that memory does not follow its length."""
    hashes, places, start = [], [], 0
    while start < len(raw):
        end = start + PIECE
        if end < len(raw):
            cut = max(raw.rfind(b" ", start, end), raw.rfind(b"\n", start, end))
            after = [at for at in (raw.find(b" ", end), raw.find(b"\n", end)) if at >= 0]
            end = cut + 1 if cut >= start else min(after, default=len(raw))
        data = np.frombuffer(raw[start:end], np.uint8)
        inside = data > 32
        spots = np.flatnonzero(inside)
        if len(spots):
            first = np.flatnonzero(np.r_[True, np.diff(spots) > 1])
            sizes = np.diff(np.r_[first, len(spots)])
            place = np.arange(len(spots)) - np.repeat(first, sizes)
            sums = np.add.reduceat(LETTER[data[spots]] * POWER[place & 0xFFFF], first)
            hashes.append(mixed(sums + sizes.astype(np.uint64)))
            places.append(spots[first] + start)
        start = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def words_of(text: str | None) -> np.ndarray:
    """The hashes of a text's words in order."""
    return hash_words(cleaned(text))[0]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values, so that sums of word hashes spread over all bits."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; a shorter text is one run."""
    if not len(words):
        return words
    size = min(size, len(words))
    count, total = len(words) - size + 1, np.zeros(len(words) - size + 1, np.uint64)
    for at in range(size):
        total = mixed(total + words[at : at + count])
    return total


def components(edges: DataFrame) -> DataFrame:
    """Connected groups of the undirected ``edges`` (a, b: long): ``node``, ``root`` (smallest node of its group)
    for every node with an edge to another one.

    Rounds of large-star and small-star: every node is hung below the smallest node it knows, until nothing
    changes. Minima are combined before the shuffle, and a node with very many edges only makes one side of a
    join large, which adaptive execution splits. Every round is cut off by a checkpoint.
    """
    graph = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    graph, before = checkpointed(graph), None
    while True:
        state = graph.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == before or not state[0]:
            return graph.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                graph.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = tuple(state)
        low = graph.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = graph.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        graph = checkpointed(small.union(low.select("u", F.col("m").alias("v"))).distinct())


def in_blocks(members: DataFrame, most_rows: int, most_weight: int) -> DataFrame:
    """``members`` (id, root, weight, …) with ``block`` and ``blocks``: a group is cut into blocks of about ``most_rows``
    rows and ``most_weight``, so that no task gets a large group whole."""
    sizes = members.groupBy("root").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / F.lit(most_rows)), F.ceil(F.sum("weight") / F.lit(most_weight)), F.lit(1)
        ).cast("int").alias("blocks")
    )
    return members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def as_units(rows: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    """Rows with a block go to every unit of work of their group: the pairs of its blocks (``left``, ``right``), or those whose
    numbers differ by ``low`` or more and less than ``high``. A group of one block is one unit. Pairs of rows are compared
    inside units, never emitted."""
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    if high is not None:
        others = F.filter(others, lambda other: F.abs(other - F.col("block")).between(low, high - 1))
    return (
        rows.withColumn("other", F.explode(others))
        .withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).drop("other", "blocks")
    )


def each_unit(rows: DataFrame, function: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``function`` of every unit (rows of the same ``root``, ``left`` and ``right``, as arrays). Units are small and many:
    they are dealt to tasks in buckets, several to a shuffle partition."""
    buckets = 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def answered(bucket: pd.DataFrame) -> pd.DataFrame:
        columns = {name: bucket[name].to_numpy() for name in bucket.columns}
        keys = [columns[name] for name in ("right", "left", "root")]
        order = np.lexsort(keys)
        new = np.zeros(len(order), bool)
        for key in keys:
            new[1:] |= np.diff(key[order]) != 0
        starts = np.r_[0, np.flatnonzero(new)]
        found = [
            function({name: values[order[a:b]] for name, values in columns.items()})
            for a, b in zip(starts, np.r_[starts[1:], len(order)])
        ]
        return pd.DataFrame({name: np.concatenate([each[name] for each in found]) for name in found[0]})

    bucket = F.pmod(F.xxhash64("root", "left", "right"), F.lit(buckets))
    return rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(answered, schema)


class Groups:
    """Union-find over positions; the smallest position of a group is its root."""

    def __init__(self, count: int):
        self.up = list(range(count))

    def root(self, at: int) -> int:
        while self.up[at] != at:
            self.up[at] = at = self.up[self.up[at]]
        return at

    def link(self, a: int, b: int) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a
