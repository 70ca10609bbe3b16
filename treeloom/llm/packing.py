"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Every partition packs its own documents as they are read: documents are never shuffled. Examples wait in a buffer;
an open sequence takes the example with the largest dot product of its demands and the room left (both as shares of
the limits, weighted by the mean demand). When none fits whole, the best one is cut to fill the sequence.
What is left at the end of a partition becomes sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUFFER = 256
#: Pieces of the public tokenizer's own split pattern, for lower-cased text (fixed values of its file).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Letters whose lower case or composition depends on more than the letter, and separators on which libraries differ.
ODD = regex.compile(r"[\x1c-\x1f\u0250-\U0010ffff]|<\|")


def byte_letters() -> dict[int, int]:
    """The letters under which byte-level vocabularies keep bytes: visible ones stand for themselves, the others, in
    order, for the letters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in visible]
    return {byte: 256 + place for place, byte in enumerate(hidden)}


class Encoder(dict):
    """Token ids as little-endian unsigned 32-bit bytes. Words between white space are cut into the tokenizer's pieces
    and these are merged by its model, once; both are remembered. The tokenizer never merges across pieces, so the
    ids are its own. Texts with special tokens or letters beyond the first Unicode blocks go through it whole."""

    BOUND = 1_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.letters = Tokenizer.from_file(path), byte_letters()
        self.merge = self.tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        pieces = PIECES.findall(word)
        if pieces == [word]:
            letters = word.encode("utf-8").decode("latin-1").translate(self.letters)
            ids = np.array([token.id for token in self.merge(letters)], "<u4").tobytes()
        else:
            ids = b"".join([self[piece] for piece in pieces])
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if ODD.search(text) or not unicodedata.is_normalized("NFC", text):
            whole = self.tokenizer.encode(text.encode("utf-8", "replace").decode("utf-8"), add_special_tokens=False)
            return np.array(whole.ids, "<u4").tobytes()
        if len(self) > self.BOUND:
            self.clear()
        return b"".join(map(self.__getitem__, text.lower().split()))


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


class Packer:
    """Turns examples (id, token bytes, first loss-bearing token) into pieces with their sequences."""

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits, self.sequence = limits, first_sequence
        self.waiting: list[tuple] = []  # id, bytes, start, loss from, total

    def add(self, key, ids: bytes, loss_from: int) -> Iterator[tuple]:
        total, start, limits = len(ids) // 4, 0, self.limits
        while True:  # full sequences of one example
            size = self._fit(start, total - start, loss_from, limits.tokens, limits.loss)
            if size < limits.tokens:
                break
            yield from self._sequence([(key, ids, start, size, total)])
            start += size
        if start < total:
            self.waiting.append((key, ids, start, loss_from, total))
        if len(self.waiting) >= BUFFER:
            yield from self._pack(BUFFER // 4)

    def end(self) -> Iterator[tuple]:
        yield from self._pack(0)

    def _fit(self, start: int, size: int, loss_from: int, tokens: int, loss: int) -> int:
        """How many tokens from ``start`` fit."""
        size = min(size, tokens)
        return min(size, max(0, loss_from - start) + loss)

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for key, ids, start, size, total in pieces:
            yield key, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), total, self.sequence, offset
            offset += size
        self.sequence += 1

    def _pack(self, until: int) -> Iterator[tuple]:
        """Fill sequences until at most ``until`` examples wait; with 0, all goes."""
        full = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], np.int64)
        need = np.array([(total - at, 1, total - min(total, max(at, source))) for _, _, at, source, total in self.waiting], np.int64)
        alive = np.ones(len(need), bool)
        weight = need.mean(axis=0) / full / full / full if len(need) else full
        left = len(need)
        while left > until:
            room, pieces = full.copy(), []
            ends = not until and int(need[alive, 0].sum()) < full[0]
            while room[0] and room[1] and left:
                score = np.where(alive, need @ (room * weight), -1.0)
                whole = np.where((need <= room).all(axis=1), score, -1.0)
                pick = int(whole.argmax())
                if whole[pick] < 0:
                    pick = int(score.argmax())
                key, ids, start, source, total = self.waiting[pick]
                took = self._fit(start, total - start, source, int(room[0]), int(room[2]))
                if not took:
                    break
                pieces.append((key, ids, start, took, total))
                used = max(0, start + took - max(start, source))
                room -= (took, 1, used)
                self.waiting[pick] = (key, ids, start + took, source, total)
                need[pick] -= (took, 0, used)
                if not need[pick, 0]:
                    alive[pick] = False
                    left -= 1
            if ends and not left:
                for part in _powers(pieces):
                    yield from self._sequence(part)
            else:
                yield from self._sequence(pieces)
        self.waiting = [w for w, a in zip(self.waiting, alive) if a]


def _powers(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """The same pieces in sequences whose lengths are the powers of two in their sum."""
    left = sum(piece[3] for piece in pieces)
    pieces = pieces[::-1]
    for power in reversed(range(left.bit_length())):
        room, part = left & 1 << power, []
        while room:
            key, ids, start, size, total = pieces.pop()
            took = min(size, room)
            part.append((key, ids, start, took, total))
            if took < size:
                pieces.append((key, ids, start + took, size - took, total))
            room -= took
        if part:
            yield part


def _packed(path: str, end_id: int, limits: Limits):
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = Encoder(path), np.array([end_id], "<u4").tobytes()
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def frame(rows) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

        for batch in batches:
            out = []
            for key, prompt, text in zip(batch["id"], batch["prompt"], batch["text"]):
                before = encoder.encode(prompt)
                out += packer.add(key, before + encoder.encode(text) + end, len(before) // 4)
            yield frame(out)
        yield frame(list(packer.end()))

    return packed


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None,
    end_id: int = 2, limits: Limits = Limits(),
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (tokens of its document before it), ``length``, ``ids_crc32`` (unsigned,
    over little-endian unsigned 32-bit ids), ``doc_tokens``, ``sequence_id``, ``offset`` (in its sequence, gapless).

    A document is the ids of its prompt (which bear no loss), those of its text, and ``end_id``; null texts count as
    empty, so every row has at least one token and one piece. A sequence keeps to all three limits; it is to be
    padded to the limit of tokens unless its length is a power of two. Ids are integers, may be null or repeat:
    each row is packed by itself. Other columns are ignored; an empty table gives an empty result. Sequence ids
    are made of the partition's number and a counter, so that a task that runs again makes the same ones.
    """
    prompt = F.col(prompt_col) if prompt_col else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), prompt.alias("prompt"), F.col(text_col).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return texts.mapInPandas(_packed(tokenizer, end_id, limits), schema)
