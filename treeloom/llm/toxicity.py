"""Toxicity by two Kneser-Ney models, one of texts labelled toxic and one of ordinary ones, over the bytes of words.

A word (a run of ASCII letters and bytes above 127 of the lower-cased text) is spelled byte by byte between word marks.
Each class has its own counts of grams of three to six bytes. Shorter ones are shared by both: their continuation
counts come from the grams of either class, so that an expression that is rare in both has the same probability
in both and decides nothing. A word's evidence is the difference of its two log-likelihoods.

A text's evidence is normalised by length twice: the mean over all its words, and the mean over the fiftieth of its words
with the most evidence, since a few words can make a long text toxic. A logistic regression on the two, fitted on a bounded
sample of labelled texts that no model has counted, gives the score.

Grams are packed into integers (length, then bytes), so that nothing is hashed and Spark derives all orders from the
counts of the longest grams. The counts cover all labelled rows and stay a table. Tasks get it as a broadcast only up to
``most_entries``; beyond, distinct words are joined to it and documents to their words, with the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import LETTER, POWER, mixed
from treeloom.llm.filters import bloom, may_hold
from treeloom.operators.checkpoints import checkpointed

ORDER = 6
SHARED = 2  # grams up to so many bytes are counted for both classes together
DISCOUNT = 0.75
UNIFORM = 1 / 256
TAIL = 50  # one word in so many makes the second mean
MARK = 32
BUFFER = 6 << 20
SEGMENT = 4 << 20
MOST_LABELS = 2_000_000  # labels (an id and a number) that are broadcast to the documents
KNOWN = 1_000_000  # words remembered by a task, which changes speed only
INSIDE = np.zeros(256, bool)
INSIDE[ord("a") : ord("z") + 1] = True
INSIDE[128:] = True


def held_out(id_col: str) -> Column:
    """Rows kept from learning: the remainder of the id's CRC-32 by 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


class Words:
    """The words of several texts: the distinct ones, and which word of which text each occurrence is."""

    def __init__(self, texts: list[bytes]):
        raw = b" ".join(texts)
        data = np.frombuffer(raw, np.uint8)
        inside = np.flatnonzero(INSIDE[data])
        first = np.flatnonzero(np.r_[True, np.diff(inside) > 1]) if len(inside) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, len(inside)])
        start = inside[first]
        self.text = np.searchsorted(np.cumsum([len(text) + 1 for text in texts]), start, "right")
        if len(first):
            place = POWER[(np.arange(len(inside)) - np.repeat(first, sizes)) & 0xFFFF]
            hashes = mixed(np.add.reduceat(LETTER[data[inside]] * place, first) + sizes.astype(np.uint64))
        else:
            hashes = np.zeros(0, np.uint64)
        self.hashes, at, self.number = np.unique(hashes, return_index=True, return_inverse=True)
        self.spots = list(zip(start[at].tolist(), (start + sizes)[at].tolist()))
        self.raw = raw

    def names(self, which: np.ndarray) -> list[bytes]:
        return [self.raw[a:b] for a, b in (self.spots[k] for k in which.tolist())]


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def segments(raw: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(raw):
        end = start + SEGMENT
        while end < len(raw) and INSIDE[raw[end]]:
            end += 1
        yield raw[start:end]
        start = end


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every byte of every word and the mark after it: its word, and the grams of 1 to ORDER bytes that end there
    (0 where the word's mark is nearer); column ORDER counts the bytes of the longest."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    marks = data == MARK
    word = np.cumsum(marks)[:-1] - 1
    since = np.arange(len(data)) - np.maximum.accumulate(np.where(marks, np.arange(len(data)), 0))
    reach = np.r_[0, since[:-1] + 1][1:]  # bytes between the mark before and here
    packed, table = data.astype(np.int64), np.zeros((len(reach), ORDER), np.int64)
    for size in range(1, ORDER + 1):
        if size > 1:
            packed = np.r_[0, packed[:-1]] << 8 | data
            packed &= (1 << 8 * size) - 1
        named = packed[1:] | size << 56
        table[:, size - 1] = np.where(reach + 1 >= size, named, 0)
    return word, table, np.minimum(reach + 1, ORDER)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[bytes], pd.DataFrame]]:
    """Texts (at most one of more than SEGMENT bytes) with the other columns of their rows."""
    for batch in batches:
        raw = [lowered(text) for text in batch["text"]]
        start, held = 0, 0
        for at, text in enumerate(raw):
            if at > start and held + len(text) > BUFFER:
                yield raw[start:at], batch.iloc[start:at]
                start, held = at, 0
            held += len(text)
        if raw:
            yield raw[start:], batch.iloc[start:]


def _tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the longest gram at every byte, by class."""
    for texts, rows in _blocks(batches):
        toxic = rows["toxic"].to_numpy()
        for label in (0, 1):
            for text in segments(b" ".join(text for text, own in zip(texts, toxic) if own == label)):
                words = Words([text])
                if not len(words.hashes):
                    continue
                word, table, longest = grams(words.names(np.arange(len(words.hashes))))
                keys, number = np.unique(table[np.arange(len(word)), longest - 1], return_inverse=True)
                n = np.bincount(number, np.bincount(words.number)[word]).astype(np.int64)
                yield pd.DataFrame({"toxic": label, "gram": keys, "n": n})


def _shorter(gram: Column, size: int, back: bool) -> Column:
    """A packed gram of ``size`` bytes without its last byte (``back``) or its first one."""
    bytes_ = gram.bitwiseAND(F.lit((1 << 8 * size) - 1))
    cut = F.shiftright(bytes_, 8) if back else bytes_.bitwiseAND(F.lit((1 << 8 * (size - 1)) - 1))
    return cut.bitwiseOR(F.lit((size - 1) << 56))


def entries(tops: DataFrame) -> DataFrame:
    """The two models as one table: ``gram``, and for each class what the gram has of its own (``a0``, ``a1``) and what a
    gram that it begins hands to the next shorter one (``b0``, ``b1``; null where the class has no such gram)."""
    size = F.shiftright(F.col("gram"), 56)
    level = tops.where(size == ORDER)
    parts: list[DataFrame] = []
    for order in range(ORDER, 0, -1):
        if order == SHARED:
            level = level.withColumn("toxic", F.lit(-1))
        of = ["toxic", _shorter(F.col("gram"), order, True).alias("context")]
        context = level.groupBy(*of).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        chance = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total")
        own = level.select("toxic", "gram", "n", of[1]).join(context, ["toxic", "context"])
        parts.append(own.select("toxic", "gram", chance.alias("a"), F.lit(None).cast("double").alias("b")))
        left = F.col("kinds") * DISCOUNT / F.col("total")
        parts.append(context.select("toxic", F.col("context").alias("gram"), F.lit(None).cast("double").alias("a"), left.alias("b")))
        if order > 1:
            longer = level if order > SHARED else level.withColumn("toxic", F.lit(-1))
            if order == SHARED + 1:  # what either class has counts once
                longer = level.select("gram").distinct().withColumn("toxic", F.lit(-1))
            below = longer.select("toxic", _shorter(F.col("gram"), order, False).alias("gram"), F.lit(1).cast("long").alias("n"))
            first = tops.where(size == order - 1).select(F.lit(-1).alias("toxic") if order - 1 <= SHARED else F.col("toxic"), "gram", "n")
            both = below.select("toxic", "gram", "n").union(first.select("toxic", "gram", "n"))
            level = checkpointed(both.groupBy("toxic", "gram").agg(F.sum("n").alias("n")))
    table = parts[0]
    for part in parts[1:]:
        table = table.union(part)
    of_class = [F.max(F.when(F.col("toxic").isin(label, -1), F.col(name))).cast("float").alias(f"{name}{label}") for name in "ab" for label in (0, 1)]
    return checkpointed(table.groupBy("gram").agg(*of_class))


def evidence(word: np.ndarray, count: int, longest: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The difference of the two log-likelihoods of each word. ``values[i, k]`` has a0, a1, b0, b1 of the gram of k bytes
    that ends at place i of the words (k = 0: of the empty gram), NaN where unknown; row 0 is the mark before the first word."""
    here, before = values[1:], values[:-1]
    chance = np.full((len(word), 2), UNIFORM)
    for size in range(1, ORDER + 1):
        own, left = here[:, size, :2], before[:, size - 1, 2:]
        known = (longest >= size)[:, None] & ~np.isnan(left)
        chance = np.where(known, np.nan_to_num(own) + np.nan_to_num(left) * chance, chance)
    logs = np.log(chance)
    return np.bincount(word, logs[:, 1] - logs[:, 0], count)


def with_marks(table: np.ndarray) -> np.ndarray:
    """Keys for all lookups of ``evidence``: a row for the mark before the first word, and the empty gram in front."""
    keys = np.zeros((len(table) + 1, ORDER + 1), np.int64)
    keys[1:, 1:] = table
    keys[0, 1] = MARK | 1 << 56
    return keys


class Model:
    """The table in a task."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys = np.r_[keys[order], np.iinfo(np.int64).max]
        self.values = np.concatenate([values[order], np.full((1, 4), np.nan, np.float32)])
        self.known, self.known_values = np.zeros(0, np.uint64), np.zeros(0)

    def look(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[self.keys[at] != keys] = len(self.keys) - 1
        return self.values[at]

    def of(self, names: list[bytes]) -> np.ndarray:
        word, table, longest = grams(names)
        return evidence(word, len(names), longest, self.look(with_marks(table)))

    def of_words(self, words: Words) -> np.ndarray:
        """The evidence of each distinct word; what was computed before is remembered."""
        at = np.minimum(np.searchsorted(self.known, words.hashes), max(len(self.known) - 1, 0))
        seen = self.known[at] == words.hashes if len(self.known) else np.zeros(len(words.hashes), bool)
        found = np.where(seen, self.known_values[at], 0.0) if len(self.known) else np.zeros(len(words.hashes))
        new = np.flatnonzero(~seen)
        for start in range(0, len(new), 50_000):
            part = new[start : start + 50_000]
            found[part] = self.of(words.names(part))
        if len(self.known) < KNOWN:
            known = np.concatenate([self.known, words.hashes[new]])
            order = np.argsort(known)
            self.known, self.known_values = known[order], np.concatenate([self.known_values, found[new]])[order]
        return found


def means(text: np.ndarray, value: np.ndarray, n: np.ndarray, count: int) -> np.ndarray:
    """Per text: the mean over all words, and over the fiftieth (at least one word) with the largest values; 0 without words."""
    order = np.lexsort((-value, text))
    text, value, n = text[order], value[order], n[order]
    words = np.bincount(text, n, count)
    upto = np.cumsum(n)
    before = upto - n - (np.cumsum(words) - words)[text]
    most = np.maximum(words // TAIL, 1)
    taken = np.clip(most[text] - before, 0, n)
    tail = np.bincount(text, taken, count)
    return np.stack([np.bincount(text, value * n, count) / np.maximum(words, 1), np.bincount(text, value * taken, count) / np.maximum(tail, 1)], axis=1)


def _features(shared):
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for texts, rows in _blocks(batches):
            text, value, n = [], [], []
            small = [raw if len(raw) <= SEGMENT else b"" for raw in texts]
            pieces = [(None, small)] + [(at, [part]) for at, raw in enumerate(texts) if len(raw) > SEGMENT for part in segments(raw)]
            for at, part in pieces:
                words = Words(part)
                of_word = model.of_words(words)
                if at is None:
                    text.append(words.text)
                    value.append(of_word[words.number])
                    n.append(np.ones(len(words.text)))
                else:  # of a long text, distinct words of a segment and how often they occur
                    text.append(np.full(len(of_word), at))
                    value.append(of_word)
                    n.append(np.bincount(words.number, minlength=len(of_word)).astype(float))
            found = means(np.concatenate(text), np.concatenate(value), np.concatenate(n), len(texts))
            yield rows.drop(columns="text").assign(whole=found[:, 0], tail=found[:, 1])

    return features


def _with(schema, *columns: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *columns])


def by_broadcast(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``docs`` (text, …) with ``whole`` and ``tail`` instead of the text; every task holds the table."""
    rows = table.toArrow()  # at most most_entries rows
    values = np.column_stack([rows.column(name).to_numpy() for name in ("a0", "a1", "b0", "b1")])
    shared = docs.sparkSession.sparkContext.broadcast((rows.column("gram").to_numpy(), values))
    return docs.mapInPandas(_features(shared), _with(docs.drop("text").schema, "whole double", "tail double"))


def by_join(docs: DataFrame, table: DataFrame) -> DataFrame:
    """The same by shuffles: distinct words meet the table by gram, documents meet their words. Documents are known by their
    columns and a hash of their text; rows that repeat both are answered alike."""
    key = docs.columns
    rest = [name for name in key if name != "text"]
    docs = docs.withColumn("__hash", F.xxhash64("text"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for texts, rows in _blocks(batches):
            for at, raw in enumerate(texts):
                for part in segments(raw):
                    words = Words([part])
                    if len(words.hashes):
                        yield pd.DataFrame({"__hash": rows["__hash"].iloc[at], "word": words.names(np.arange(len(words.hashes))), "n": np.bincount(words.number).astype(np.int64)})

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["word"]:
                _, table, _ = grams([name])
                keys = with_marks(table)
                at, size = np.nonzero((keys != 0) | (np.arange(ORDER + 1) == 0))
                yield pd.DataFrame({"word": name, "at": at, "size": size, "gram": keys[at, size]})

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for name, looked in zip(batch["word"], batch["looked"]):
                word, _, longest = grams([name])
                values = np.full((len(word) + 1, ORDER + 1, 4), np.nan, np.float32)
                for one in looked:
                    values[one["at"], one["size"]] = [np.nan if one[part] is None else one[part] for part in ("a0", "a1", "b0", "b1")]
                found.append(evidence(word, 1, longest, values)[0])
            yield pd.DataFrame({"word": batch["word"], "value": found})

    texts = docs.select("text", "__hash").dropDuplicates(["__hash"])
    of_text = checkpointed(texts.mapInPandas(counted, "__hash long, word binary, n long").groupBy("__hash", "word").agg(F.sum("n").alias("n")))
    looked = of_text.select("word").distinct().mapInPandas(spelled, "word binary, at int, size int, gram long").join(table, "gram", "left")
    each = F.collect_list(F.struct("at", "size", "a0", "a1", "b0", "b1")).alias("looked")
    values = looked.groupBy("word").agg(each).mapInPandas(summed, "word binary, value double")

    def averaged(rows: pd.DataFrame) -> pd.DataFrame:
        found = means(np.zeros(len(rows), np.int64), rows["value"].to_numpy(), rows["n"].to_numpy(float), 1)
        return pd.DataFrame({"__hash": [rows["__hash"].iloc[0]], "whole": found[:, 0], "tail": found[:, 1]})

    found = of_text.join(values, "word").groupBy("__hash").applyInPandas(averaged, "__hash long, whole double, tail double")
    filled = [F.coalesce(name, F.lit(0.0)).alias(name) for name in ("whole", "tail")]
    return docs.drop("text").join(found, "__hash", "left").select(*rest, *filled)


def _labelled(known):
    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[may_hold(known.value, batch["key"].to_numpy().view(np.uint64))]

    return labelled


def logistic(features: np.ndarray, labels: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the constant first) by Newton's method, a little drawn to zero; both classes weigh as they occur."""
    x = np.column_stack([np.ones(len(labels)), features])
    weights = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [penalty] * features.shape[1])
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (chance - labels) + ridge @ weights
        bend = (x * (chance * (1 - chance) + 1e-9)[:, None]).T @ x + ridge
        weights = weights - np.linalg.solve(bend, slope)
    return weights


@dataclass
class Learned:
    table: DataFrame
    small: bool
    weights: np.ndarray

    def features(self, docs: DataFrame) -> DataFrame:
        return by_broadcast(docs, self.table) if self.small else by_join(docs, self.table)


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_entries: int, fitted_rows: int, most_labels: int = MOST_LABELS) -> Learned | None:
    """The models of the labelled rows that are not held out; a fifth of them only fit the regression, ``fitted_rows`` of these
    (about, by the hashes of their ids and texts). None where a class has no row."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    marked = checkpointed(marked.where("toxic in (0, 1)"))
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if marked.count() <= most_labels:
        rows = rows.join(F.broadcast(marked), "id")
    else:  # texts without a label are left out before the others are shuffled
        known = docs.sparkSession.sparkContext.broadcast(bloom(marked.select(F.xxhash64("id").alias("key"))))
        rows = rows.withColumn("key", F.xxhash64("id")).mapInPandas(_labelled(known), rows.withColumn("key", F.xxhash64("id")).schema).drop("key").join(marked, "id")
    rows = rows.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(5)))
    tops = checkpointed(
        rows.where("share > 0").select("toxic", "text").mapInPandas(_tops, "toxic int, gram long, n long").groupBy("toxic", "gram").agg(F.sum("n").alias("n"))
    )
    if tops.select("toxic").distinct().count() < 2:
        return None
    learned = Learned(entries(tops), True, np.zeros(3))
    learned.small = learned.table.count() <= most_entries
    kept = rows.where("share = 0")
    part = min(1.0, fitted_rows / max(kept.select("id").count(), 1))
    sample = kept.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < part * (1 << 30)).select("toxic", "text")
    fitted = learned.features(sample).toPandas()
    if fitted["toxic"].nunique() < 2:
        learned.weights = np.array([-2.0, 0.0, 0.5])  # nothing to fit: evidence in the tail alone
    else:
        learned.weights = logistic(fitted[["whole", "tail"]].to_numpy(), fitted["toxic"].to_numpy(float))
    return learned


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    least: float = 0.7, most_entries: int = 4_000_000, fitted_rows: int = 20_000, most_labels: int = MOST_LABELS,
) -> DataFrame:
    """``docs`` without its text, with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``least`` on); columns of
    these names are replaced.

    Labels (0 or 1; the larger one where an id has several; others and nulls teach nothing) are learned from rows whose
    id's CRC-32 modulo 3 is not 1. Null and empty texts and those without a letter have no evidence. Rows with a null id
    are not held out and teach nothing. Repeated rows count each time and score alike. Texts of any length are read in
    segments. Without a labelled row of either class every score is 0. An empty table gives an empty result.
    """
    docs = docs.drop("held_out", "score", "predicted", "whole", "tail")
    learned = learn(docs, labels, id_col, text_col, label_col, most_entries, fitted_rows, most_labels)
    rest = [name for name in docs.columns if name != text_col]
    asked = docs.select(F.col(text_col).alias("text"), *[F.col(name).alias(f"c{at}") for at, name in enumerate(rest)])
    if learned is None:
        found, score = asked.drop("text"), F.lit(0.0)
    else:
        found = learned.features(asked)
        constant, whole, tail = map(float, learned.weights)
        score = 1 / (1 + F.exp(-(F.lit(constant) + whole * F.col("whole") + tail * F.col("tail"))))
    named = found.select(*[F.col(f"c{at}").alias(name) for at, name in enumerate(rest)], score.alias("score"))
    return named.withColumn("held_out", held_out(id_col)).withColumn("predicted", (F.col("score") >= least).cast("int"))
