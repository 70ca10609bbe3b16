"""Language ID with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum,
over all ways to cut it into pieces, of the products of their probabilities (the forward algorithm); that of a text
is the product over its words. Piece probabilities are learned by expectation maximisation: the forward and backward
sums give each piece's expected count in the words of a bounded sample of labelled rows.

Words are runs of letters of the lower-cased text, each with the vocabulary's word-start mark before it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.operators.checkpoints import checkpointed

LETTERS = re.compile(r"[^\W\d_]+")
BLANK = re.compile(r"\s")
STRETCH = 200  # longer runs of letters are learned from in stretches
START = "▁"
UNKNOWN = 1e-8  # of a letter that the vocabulary has no piece for
SMOOTHING = 0.02
TINY = 1e-120


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model, without its special and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Lattice:
    """All ways to cut words into pieces of a vocabulary."""

    def __init__(self, pieces: list[str]):
        self.ids = {piece: number for number, piece in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, piece or -1 for an unknown letter), by end."""
        found = []
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                piece = self.ids.get(word[start:end])
                if piece is not None:
                    found.append((start, end, piece))
                elif end - start == 1:
                    found.append((start, end, -1))
        return found


def forward(edges: list[tuple[int, int, int]], size: int, chance: list[float]) -> tuple[list[float], list[float]]:
    """Sums over all segmentations of each prefix, scaled; and the logarithms of the scales."""
    sums, scale = [1.0] + [0.0] * size, [0.0] * (size + 1)
    last, shift = 0, 0.0
    for start, end, piece in edges:
        if end != last:
            if last and sums[last] < TINY:
                shift = math.log(sums[last]) + scale[last]
            last = end
            scale[end] = shift
        part = sums[start] * (chance[piece] if piece >= 0 else UNKNOWN)
        sums[end] += part * math.exp(scale[start] - shift) if scale[start] != shift else part
    return sums, scale


def log_chance(edges: list[tuple[int, int, int]], size: int, chance: list[float]) -> float:
    sums, scale = forward(edges, size, chance)
    return math.log(sums[size]) + scale[size]


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    chances: list[list[float]]

    @property
    def lattice(self) -> Lattice:
        return Lattice(self.pieces)


class WordScores(dict):
    """Log probabilities of words between white space under every language, remembered up to a bound. A row of
    the table holds a word's sums over its runs of letters, and how many it has. New words are scored many at a time."""

    BOUND = 1_000_000
    SHORT = 24  # the probability of a run of so many letters is far from the smallest number
    SEGMENT = 1 << 20  # letters of a text split into words at once

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.lattice = model, model.lattice
        self.ids = self.lattice.ids
        languages = len(model.languages)
        # Two more rows: a letter without a piece, and no way to use several letters at once.
        self.unknown, self.never = len(model.pieces), len(model.pieces) + 1
        self.chances = np.concatenate([np.array(model.chances).reshape(languages, len(model.pieces)).T, np.full((1, languages), UNKNOWN), np.zeros((1, languages))])
        self.rows = np.zeros((4096, languages + 1))

    def add(self, words: Iterable[str]) -> None:
        """Scores the words that are new."""
        spelled = {word: LETTERS.findall(word) for word in words if word not in self}
        runs = list({run for found in spelled.values() for run in found if run not in self})
        self._put(runs, np.column_stack([self.logs(runs), np.ones(len(runs))]))
        mixed = [word for word in spelled if word not in self]
        sums = [self.rows[[self[run] for run in spelled[word]]].sum(axis=0) for word in mixed]
        self._put(mixed, np.array(sums).reshape(len(mixed), self.rows.shape[1]))

    def _put(self, words: list[str], rows: np.ndarray) -> None:
        if not words:
            return
        first = len(self)
        while first + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[first : first + len(words)] = rows
        self.update(zip(words, range(first, first + len(words))))

    def logs(self, runs: list[str]) -> np.ndarray:
        """The logarithms of the forward sums, a row for each run and a column for each language. Runs of one length take
        their steps together."""
        found = np.zeros((len(runs), len(self.model.languages)))
        by_size: dict[int, list[int]] = {}
        for at, run in enumerate(runs):
            by_size.setdefault(len(run) + 1, []).append(at)
        for size, places in by_size.items():
            if size > self.SHORT:
                for at in places:
                    found[at] = self._long(START + runs[at])
                continue
            steps = [(start, end) for end in range(1, size + 1) for start in range(max(0, end - self.lattice.longest), end)]
            default = [self.unknown if end - start == 1 else self.never for start, end in steps]
            get = self.ids.get
            for part in range(0, len(places), 20_000):
                here = places[part : part + 20_000]
                names = [START + runs[at] for at in here]
                pieces = np.array([[get(name[a:b], other) for (a, b), other in zip(steps, default)] for name in names], np.int32)
                sums = np.zeros((size + 1, len(here), found.shape[1]))
                sums[0] = 1
                for step, (start, end) in enumerate(steps):
                    sums[end] += sums[start] * self.chances[pieces[:, step]]
                found[here] = np.log(sums[size])
        return found

    def _long(self, run: str) -> np.ndarray:
        """One run of any length; only as many sums are held as a piece has letters."""
        ring, scale = [np.ones(self.chances.shape[1])], np.zeros(self.chances.shape[1])
        for end in range(1, len(run) + 1):
            total = np.zeros_like(scale)
            for back, before in enumerate(reversed(ring), 1):
                piece = self.ids.get(run[end - back : end], self.unknown if back == 1 else self.never)
                if piece != self.never:
                    total += before * self.chances[piece]
            if total.min() < TINY:
                ring, scale, total = [before / total for before in ring], scale + np.log(total), np.ones_like(total)
            ring = [*ring, total][-self.lattice.longest :]
        return np.log(ring[-1]) + scale

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        totals = np.zeros((len(texts), self.rows.shape[1]))
        waiting: list[tuple[int, list[str]]] = []
        held = 0
        for at, text in enumerate(texts):
            for segment in _segments((text or "").lower(), self.SEGMENT):
                waiting.append((at, segment.split()))
                held += len(segment)
                if held > self.SEGMENT:
                    self._sum_up(waiting, totals)
                    waiting, held = [], 0
        self._sum_up(waiting, totals)
        return [self._best(total) for total in totals]

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def _sum_up(self, waiting: list[tuple[int, list[str]]], totals: np.ndarray) -> None:
        if len(self) > self.BOUND:
            self.clear()
        self.add(set().union(*(words for _, words in waiting)))
        for at, words in waiting:
            totals[at] += self.rows[np.fromiter(map(self.__getitem__, words), np.int64, len(words))].sum(axis=0)

    def _best(self, total: np.ndarray) -> tuple[str, float]:
        if not total[-1] or not self.model.languages:
            return "und", 0.0
        best = int(total[:-1].argmax())
        return self.model.languages[best], float(1 / np.exp(total[:-1] - total[best]).sum())


def _segments(text: str, size: int) -> Iterator[str]:
    """A text in parts that end at white space."""
    start = 0
    while start < len(text):
        blank = BLANK.search(text, start + size)
        end = blank.end() if blank else len(text)
        yield text[start:end]
        start = end


def held_out(id_col: str) -> Column:
    """Rows kept from learning: the remainder of the id's CRC-32 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, vocabulary_path: str, per_language: int, rounds: int) -> Model:
    """``per_language`` bounds the labelled rows (about) taken of each language: those with the smallest hashes."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        "lang is not null and text is not null"
    )
    counts = {row["lang"]: row["n"] for row in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages, pieces = sorted(counts), vocabulary(vocabulary_path)
    if not languages:
        return Model([], pieces, [])
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / counts[k]))) for k in languages])
    sample = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < share * (1 << 30))

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                found = Counter(run for text in texts for run in LETTERS.findall(text.lower()))
                yield pd.DataFrame({"lang": lang, "word": list(found), "n": list(found.values())})

    words = checkpointed(
        sample.select("lang", "text").mapInPandas(words_of, "lang string, word string, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    model = Model(languages, pieces, [[1 / len(pieces)] * len(pieces) for _ in languages])
    for _ in range(rounds):
        expected = words.mapInPandas(_expected(words.sparkSession.sparkContext.broadcast(model)), "lang string, piece int, n double")
        totals = np.full((len(languages), len(pieces)), SMOOTHING)
        for row in expected.groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():  # at most languages x vocabulary
            totals[languages.index(row["lang"]), row["piece"]] += row["n"]
        model = Model(languages, pieces, (totals / totals.sum(axis=1, keepdims=True)).tolist())
    return model


def _expected(shared):
    def expected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        lattice = model.lattice
        chances = dict(zip(model.languages, model.chances))
        totals: dict[str, dict[int, float]] = {}
        for batch in batches:
            for lang, word, n in batch.itertuples(index=False):
                word, counts, chance = START + word, totals.setdefault(lang, {}), chances[lang]
                for at in range(0, len(word), STRETCH):
                    stretch = word[at : at + STRETCH]
                    for piece, part in piece_counts(lattice.edges(stretch), len(stretch), chance):
                        counts[piece] = counts.get(piece, 0.0) + n * part
        for lang, counts in totals.items():
            yield pd.DataFrame({"lang": lang, "piece": list(counts), "n": list(counts.values())})

    return expected


def piece_counts(edges: list[tuple[int, int, int]], size: int, chance: list[float]) -> Iterator[tuple[int, float]]:
    """The expected number of uses of each known piece in a word, edge by edge."""
    sums, scale = forward(edges, size, chance)
    whole = scale[size] + math.log(sums[size])
    back = [-math.inf] * size + [0.0]  # logarithms
    for start, end, piece in sorted(edges, key=lambda e: -e[0]):
        part = math.log(chance[piece] if piece >= 0 else UNKNOWN) + back[end]
        high = max(back[start], part)
        back[start] = high + math.log(math.exp(back[start] - high) + math.exp(part - high))
    for start, end, piece in edges:
        if piece >= 0 and sums[start] > 0:
            yield piece, math.exp(math.log(sums[start]) + scale[start] + math.log(chance[piece]) + back[end] - whole)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` (a learned language; ``und`` for a null text or one without a letter) and
    ``score`` (its share of the probability of all languages, 0 for ``und``). Ties go to the first name.
    With ``keep`` only these columns come back from the Python workers."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.drop("lang_pred", "score").schema
    names = schema.names

    def predicted(batches):
        import pyarrow as pa

        scores = WordScores(shared.value)
        for batch in batches:
            found = scores.predict_all(batch.column(names.index(text_col)).to_pylist())
            lang, score = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            passed = [column for name, column in zip(names, batch.columns) if name in kept]
            yield pa.RecordBatch.from_arrays([*passed, lang, score], names=[*kept, "lang_pred", "score"])

    kept = [name for name in names if keep is None or name in keep]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name in kept), "lang_pred string", "score double"])
    return docs.select(*names).mapInArrow(predicted, out)


def identify(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = 1500, rounds: int = 3, keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score`` (columns of these names are replaced).

    Learned from the text and the non-null ``lang_col`` of rows that are not held out; predictions use the text
    alone. Rows with a null id count as not held out but teach nothing beyond their text; repeated rows are
    answered alike. Without any labelled row every text is ``und``. An empty table gives an empty result.
    """
    docs = docs.withColumn("held_out", held_out(id_col))
    model = learn(docs.where("not held_out"), id_col, text_col, lang_col, vocabulary_path, per_language, rounds)
    return predict(docs, model, text_col, keep)
