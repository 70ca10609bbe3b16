"""Benchmark decontamination: rare word n-grams of the test items are seeds, Smith-Waterman decides.

A first pass over the documents counts, for every n-gram of an item, the documents that hold it; n-grams that no document
holds seed nothing. The counts are joined with the items' n-grams. The weight of an n-gram is its documents times the
different item texts that hold it, that is, the alignments it would cause. It is a rare seed up to half as many alignments
as there are documents (or ``FEW``): a text copied into a third of all documents keeps its n-grams, a phrase of many items or
of most documents does not. An item without a rare seed is sought by its present n-grams of up to twice its least weight.

A second pass joins passages to items: wherever a document holds a seed, the passage around it is aligned with the item,
word by word (match +2, other word -1, missing or added word -1), unless it has too few of the item's words to reach
``least``. The score is the best local alignment divided by that of a verbatim copy; edited and paraphrased copies keep
most of it. A copy without ``n`` unchanged words in a row (every third word changed, score about 0.5) has no seed, nor has
an edited one that kept only common n-grams of an item that has rare ones.

The test items are taken in blocks of a measured size, each broadcast with its seeds; documents never leave their partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import gram_hashes, words_of
from treeloom.llm.filters import bloom, may_hold
from treeloom.operators.checkpoints import checkpointed

MATCH, OTHER, GAP = 2, -1, -1
BLOCK_CHARS = 16_000_000
SHARE = 0.5  # a rare seed causes so many alignments for each document at most,
FEW = 1000  # or so many in all


class Items:
    """Words and seeds of a block of test items, ready to be looked up."""

    def __init__(self, rows: list[tuple[int, str, np.ndarray]], n: int):
        """``rows``: (id, text, its seeds)."""
        words = [(key, words_of(text), seeds) for key, text, seeds in rows if len(seeds)]
        self.ids, self.words = [key for key, _, _ in words], [w for _, w, _ in words]
        self.sizes = sorted({min(n, len(w)) for w in self.words})
        grams = [gram_hashes(w, n) for w in self.words]
        places = [np.flatnonzero(np.isin(g, seeds)) for g, (_, _, seeds) in zip(grams, words)]
        self.owner = np.repeat(np.arange(len(grams)), [len(at) for at in places])
        self.place = np.concatenate(places) if grams else np.zeros(0, np.int64)
        grams = np.concatenate([g[at] for g, at in zip(grams, places)]) if grams else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner, self.place = grams[order], self.owner[order], self.place[order]
        self.seeds = np.unique(self.grams)
        self.maybe = np.zeros(1 << 20, bool)  # by the first bits of a seed
        self.maybe[self.seeds >> np.uint64(44)] = True

    def found(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in the document, seeds there), for each n-gram size in use."""
        for size in self.sizes:
            if len(words) >= size:
                grams = gram_hashes(words, size)
                hit = np.flatnonzero(self.maybe[grams >> np.uint64(44)])
                at = np.minimum(np.searchsorted(self.seeds, grams[hit]), len(self.seeds) - 1)
                hit = hit[self.seeds[at] == grams[hit]]
                yield hit, grams[hit]


def alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Score of the best local alignment, and the passage's position where it ends (the first such).

    One row of the table per item word; gaps along the row are a running maximum."""
    slope = -GAP * np.arange(len(passage) + 1)
    above, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        row = np.zeros_like(above)
        row[1:] = np.maximum(0, np.maximum(above[:-1] + np.where(passage == word, MATCH, OTHER), above[1:] + GAP))
        row = np.maximum.accumulate(row + slope) - slope
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
        above = row
    return best, end


def best_passage(item: np.ndarray, words: np.ndarray, places: np.ndarray, offsets: np.ndarray, least: float):
    """(score, first word, last word) of the best alignment near the seeds, or None below ``least``."""
    size, most = len(item), MATCH * len(item)
    starts = np.sort(np.unique(places - offsets)) - size
    best = None
    cuts = np.flatnonzero(np.diff(starts) > 3 * size) + 1
    for part in np.split(starts, cuts):
        a, b = max(0, int(part[0])), min(len(words), int(part[-1]) + 3 * size)
        passage = words[a:b]
        if MATCH * np.isin(item, passage).sum() < least * most:  # no alignment can match more words
            continue
        score, end = alignment(item, passage)
        if score >= least * most - 1e-9 and (best is None or score > best[0]):
            _, back = alignment(item[::-1], passage[:end][::-1])
            best = (score, a + end - back, a + end - 1)
    return best and (best[0] / most, best[1], best[2])


def _search(items, least: float):
    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = items.value
        for batch in batches:
            out = []
            for key, text in zip(batch["id"], batch["text"]):
                words = words_of(text)
                hits = []
                for places, seeds in known.found(words):
                    low, high = np.searchsorted(known.grams, seeds), np.searchsorted(known.grams, seeds, "right")
                    counts = high - low
                    which = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                    hits.append((known.owner[which], np.repeat(places, counts), known.place[which]))
                owners, places, offsets = (np.concatenate(part) for part in zip(*hits)) if hits else (np.zeros(0, np.int64),) * 3
                order = np.argsort(owners, kind="stable")
                for mine in np.split(order, np.flatnonzero(np.diff(owners[order])) + 1) if len(order) else []:
                    owner = int(owners[mine[0]])
                    if found := best_passage(known.words[owner], words, places[mine], offsets[mine], least):
                        out.append((key, known.ids[owner], *found))
            frame = pd.DataFrame(out, columns=["doc_id", "item_id", "score", "first_word", "last_word"])
            yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

    return searched


def _grams(n: int):
    """The distinct n-grams of each item text, and how many words they have."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for of_text, text in zip(batch["of_text"], batch["text"]):
                words = words_of(text)
                keys = np.unique(gram_hashes(words, n))
                yield pd.DataFrame({"of_text": of_text, "key": keys.view(np.int64), "size": min(n, len(words))})

    return listed


def _holding(wanted, sizes: list[int]):
    """How many documents of a batch hold each n-gram that the filter may know."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for text in batch["text"]:
                words = words_of(text)
                for size in sizes:
                    if len(words) >= size:
                        grams = gram_hashes(words, size)
                        found.append(np.unique(grams[may_hold(wanted.value, grams)]))
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"key": keys.view(np.int64), "documents": n.astype(np.int64)})

    return counted


def rare_seeds(texts: DataFrame, tests: DataFrame, n: int) -> DataFrame:
    """``of_text``, ``key``: the n-grams by which each item text is sought. ``texts`` has ``text``, ``tests`` also ``of_text``."""
    context = texts.sparkSession.sparkContext
    grams = checkpointed(tests.select("of_text", "text").distinct().mapInPandas(_grams(n), "of_text long, key long, size int"))
    sizes = sorted(row["size"] for row in grams.select("size").distinct().collect())  # 1 to n
    wanted = context.broadcast(bloom(grams.select("key")))
    holding = texts.select("text").mapInPandas(_holding(wanted, sizes), "key long, documents long").groupBy("key").agg(F.sum("documents").alias("documents"))
    owners = grams.groupBy("key").agg(F.count(F.lit(1)).alias("items"))
    weights = holding.join(owners, "key").select("key", (F.col("documents") * F.col("items")).alias("weight"))
    present = checkpointed(grams.join(weights, "key").select("of_text", "key", "weight"))
    bound = max(FEW, SHARE * texts.count())
    least = present.groupBy("of_text").agg(F.min("weight").alias("least"))
    sought = F.when(F.col("least") <= bound, F.col("weight") <= bound).otherwise(F.col("weight") <= 2 * F.col("least"))
    return present.join(least, "of_text").where(sought).select("of_text", "key")


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", n: int = 3, least: float = 0.5,
) -> DataFrame:
    """``doc_id``, ``item_id``, ``score`` (0 to 1), ``first_word``, ``last_word`` (of the aligned passage, words of
    the document counted from 0) for each document row and test item with a score of at least ``least``.

    Words lie between white space, lower-cased, without ASCII punctuation. Null, empty and wordless texts on either side
    match nothing; an item of fewer than ``n`` words is its own seed. Repeated rows are answered for each row
    (repeated items once per distinct id and text); ids may be null. Other columns are ignored; an empty table on
    either side gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tests = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    tests = checkpointed(tests.withColumn("of_text", F.xxhash64("text")))
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = math.ceil(chars / BLOCK_CHARS)
    schema = "doc_id long, item_id long, score double, first_word int, last_word int"
    total = spark.createDataFrame([], schema)
    seeds = checkpointed(rare_seeds(texts, tests, n)) if blocks else None
    for block in range(blocks):
        here = F.pmod(F.xxhash64("of_text"), F.lit(blocks)) == block
        mine = tests.where(here).orderBy("id", "text").collect()
        chosen = seeds.where(here).toPandas().groupby("of_text")["key"]  # not more than the block's words
        chosen = {key: keys.to_numpy().view(np.uint64) for key, keys in chosen}
        known = Items([(row["id"], row["text"], chosen.get(row["of_text"], ())) for row in mine], n)
        if not len(known.grams):
            continue
        total = total.union(texts.mapInPandas(_search(spark.sparkContext.broadcast(known), least), schema))
    return total


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds a test item (see ``contaminated``), whatever their ids: null and repeated
    ids are treated like others."""
    of_text = F.xxhash64(text_col)
    texts = docs.select(of_text.alias("__of_text"), F.col(text_col))
    found = contaminated(texts, items, "__of_text", text_col, **options).select(F.col("doc_id").alias("__of_text")).distinct()
    return docs.withColumn("__of_text", of_text).join(found, "__of_text", "left_anti").select(docs.columns)
