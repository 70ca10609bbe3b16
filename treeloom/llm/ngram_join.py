"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

Words lie between white space; they are lower-cased and lose ASCII punctuation (words that are then empty go). An n-gram is ``n`` words in a row (a text
of fewer words is one n-gram). Documents with the same words in the same order are copies and are joined once,
through the copy with the smallest id. The number of bands and rows follows from the recall wanted at the threshold.

Documents that share a band form candidate groups; inside a group every pair is compared on its full n-gram sets.
Large groups are compared block by block. What leaves a task is one row per document, never a list of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import Groups, as_units, components, each_unit, gram_hashes, in_blocks, mixed, words_of
from treeloom.operators.checkpoints import checkpointed

BLOCK_ROWS = 1024
BLOCK_GRAMS = 1_000_000


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``most`` hashes that finds a pair at the threshold with
    the probability ``recall``."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def _digest(words: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(words.tobytes())


def _sets(n: int):
    """Of the rows with a member's id those that have its words, with their n-gram sets."""

    def built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                words = words_of(row.text)
                if _digest(words) == row.digest:
                    grams = np.unique(gram_hashes(words, n))
                    out.append((row.node, row.copies, row.root, row.block, row.blocks, grams.tobytes()))
            yield pd.DataFrame(out, columns=["id", "copies", "root", "block", "blocks", "set"])

    return built


def _signatures(n: int, bands: int, rows: int):
    random = np.random.default_rng(7)
    factor = random.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = random.integers(0, 2**63, bands * rows, dtype=np.uint64)
    place = np.arange(bands, dtype=np.uint64) + np.uint64(1)

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["id"], batch["text"]):
                words = words_of(text)
                grams = np.unique(gram_hashes(words, n))
                keys = None
                if len(grams):
                    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                    for at in range(0, len(grams), 2048):
                        some = grams[at : at + 2048, None] * factor + shift
                        np.minimum(low, some.min(axis=0), out=low)
                    keys = band_keys(low.reshape(bands, rows), place).view(np.int64)
                out.append((key, _digest(words), len(grams), keys))
            yield pd.DataFrame(out, columns=["id", "digest", "grams", "bands"])

    return signed


def band_keys(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One key per band; the band's number is part of it."""
    total = place
    for column in values.T:
        total = mixed(total + column)
    return total


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two of the sets have in common. N-grams of many sets are counted by a matrix
    product, rare ones by listing their few pairs."""
    size = len(sets)
    owner = np.repeat(np.arange(size), [len(s) for s in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    total = np.zeros((size, size), np.float32)
    total[np.diag_indices(size)] = [len(s) for s in sets]
    dense = often > max(8, size // 16)
    place = np.cumsum(dense) - 1
    pick = dense[column]
    rows, columns = owner[pick], place[column[pick]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    full = np.zeros((size, size), np.float32)
    for start in range(0, int(dense.sum()), 2048):
        a, b = np.searchsorted(columns, [start, start + 2048])
        part = np.zeros((size, 2048), np.float32)
        part[rows[a:b], columns[a:b] - start] = 1
        full += part @ part.T
    np.fill_diagonal(full, 0)
    total += full
    pick = ~dense[column] & (often[column] > 1)
    rows, columns = owner[pick], column[pick]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    flat = total.reshape(-1)
    for step in range(1, len(rows)):
        same = np.flatnonzero(columns[step:] == columns[:-step])
        if not len(same):
            break
        a, b = rows[same], rows[same + step]
        flat += np.bincount(np.concatenate([a * size + b, b * size + a]), minlength=size * size).astype(np.float32)
    return total


def _compare(threshold: float):
    def compared(unit: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        ids, first = np.unique(unit["id"], return_index=True)  # rows that repeat both id and text
        sets = [np.frombuffer(unit["set"][at], np.uint64) for at in first]
        copies, block = unit["copies"][first], unit["block"][first]
        sizes = np.array([len(s) for s in sets], np.float64)
        shared = shared_counts(sets).astype(np.float64)
        # shared / union >= threshold, without dividing
        linked = shared * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-9
        np.fill_diagonal(linked, False)
        if unit["left"][0] != unit["right"][0]:
            linked &= block[:, None] != block[None, :]
        groups, left = Groups(len(ids)), np.ones(len(ids), bool)
        for at in range(len(ids)):  # a walk through each group: one link for each new member
            if not left[at]:
                continue
            left[at], front = False, [at]
            while front:
                here = front.pop()
                new = np.flatnonzero(linked[here] & left)
                left[new] = False
                for other in new:
                    groups.link(here, int(other))
                front.extend(new.tolist())
        return {"node": ids, "links": linked @ copies, "low": ids[[groups.root(at) for at in range(len(ids))]]}

    return compared


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9995
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``class_id`` (smallest id of its connected group), ``links`` (other
    documents whose n-gram set has a Jaccard similarity of at least ``threshold``, copies included).

    Ids are integers. A null or wordless text has no n-grams: it is linked to nothing and its own class. A row
    with a null id takes no part: null class, no links. Rows that repeat an id and its words count as copies; where
    an id comes with different texts, each row has its own text's links. Other columns are ignored. An empty
    table gives an empty result.
    """
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = checkpointed(
        texts.mapInPandas(_signatures(n, bands, rows), "id long, digest binary, grams int, bands array<long>")
    )
    known = signed.where("id is not null and grams > 0")
    # one row per different text; its node is fixed by the checkpoint
    unique = checkpointed(
        known.groupBy("digest").agg(
            F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands")
        ).withColumn("node", F.monotonically_increasing_id())
    )
    keyed = unique.select("node", F.explode("bands").alias("band"))
    first = keyed.groupBy("band").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = components(keyed.join(first, "band").select("a", F.col("node").alias("b")))
    members = unique.join(found, "node").select(F.col("node").alias("id"), "least", "digest", "copies", "root", F.col("grams").alias("weight"))
    members = in_blocks(members, BLOCK_ROWS, BLOCK_GRAMS).select(F.col("id").alias("node"), F.col("least").alias("id"), "digest", "copies", "root", "block", "blocks")
    sets = texts.join(members, "id").mapInPandas(_sets(n), "id long, copies long, root long, block int, blocks int, set binary")
    compared = checkpointed(
        each_unit(as_units(sets), _compare(threshold), "node long, links long, low long")
    )
    linked = compared.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(compared.select(F.col("node").alias("a"), F.col("low").alias("b")))
    tied = (
        unique.select("node", "digest", "copies", "least").join(linked, "node", "left").join(joined, "node", "left")
        .withColumn("group", F.coalesce("root", "node"))
    )
    least = tied.groupBy("group").agg(F.min("least").alias("class_id"))
    tied = tied.join(least, "group").select("digest", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    some = F.col("id").isNotNull()
    return signed.join(tied, "digest", "left").select(
        F.col("id").alias(id_col),
        F.when(some, F.coalesce("class_id", "id")).alias("class_id"),
        F.when(some, F.coalesce("links", F.lit(0))).otherwise(0).alias("links"),
    )
