"""Phrase collocations by partitioned mining: a phrase with ``least`` occurrences in all texts has a proportional share of
them in at least one shard.

Documents are dealt to a fixed number of shards by their id. Each shard is mined completely: its words and pairs are
counted first, then its phrases of three to five words whose pairs are all frequent there. What reaches the lowered
support (``least`` over the number of shards, rounded up) in any shard is a candidate. A last pass counts the candidates
in all texts, by their words and exactly. Hashes only choose candidates; a collision adds one.

A shard is no task: it is counted by all tasks that meet its documents, each combining what it read before the shuffle,
and the number of shards doesn't follow the input. With one shard for each task the lowered support would fall to one
occurrence on large inputs, and every phrase would be a candidate.

Frequent pairs and candidates reach the tasks as filters of bounded size (see ``filters``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from treeloom.llm.common import LETTER, POWER, mixed
from treeloom.llm.filters import bloom, may_hold
from treeloom.operators.checkpoints import checkpointed

LONGEST = 5
SHARD_BITS = 6  # the last bits of a counted hash are the shard
SHARD_MASK = np.uint64((1 << SHARD_BITS) - 1)
BUFFER = 1 << 20  # bytes of text read together; the arrays take about 60 bytes for each
HELD_KEYS = 1 << 22  # keys of several blocks counted together
SEGMENT = 1 << 20  # longer texts are read in segments
ROWS_OUT = 200_000  # rows handed to Spark together
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 blank, 2 between pieces
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
OTHER_LETTER = mixed(LETTER)


def segments(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """A text in segments that end between words, each after the last words of the one before, and how many these are."""
    start, back = 0, 0
    while start < len(raw) or not start:
        end = start + SEGMENT
        while end < len(raw) and not KIND[raw[end]]:
            end += 1
        before = raw[back:start]
        yield before + raw[start:end], int(np.count_nonzero(np.diff(np.r_[1, KIND[np.frombuffer(before, np.uint8)] > 0].astype(np.int8)) == -1))
        if end >= len(raw):
            return
        back, words = end, 0
        while back > 0 and words < LONGEST - 1:  # where the last words begin
            back -= 1
            words += bool(not KIND[raw[back]] and (not back or KIND[raw[back - 1]]))
        start = end


class Block:
    """The words of several texts: where they are, their pieces and hashes."""

    def __init__(self, texts: list[tuple[bytes, int, int]], second: bool = False):
        """``texts``: (segment, words to skip, number of its document)."""
        self.raw = b"\n".join(text for text, _, _ in texts)
        data = np.frombuffer(self.raw, np.uint8)
        kind = KIND[data]
        inside = np.flatnonzero(kind == 0)
        first = np.flatnonzero(np.r_[True, np.diff(inside) > 1]) if len(inside) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, len(inside)])
        self.start = inside[first]
        self.end = self.start + sizes
        self.piece = np.cumsum(kind == 2)[self.start] if len(first) else np.zeros(0, np.int64)
        lengths = np.array([len(text) + 1 for text, _, _ in texts])
        self.text = np.searchsorted(np.cumsum(lengths), self.start, "right")
        self.doc = np.array([doc for _, _, doc in texts])[self.text] if len(first) else np.zeros(0, np.int64)
        place = POWER[(np.arange(len(inside)) - np.repeat(first, sizes)) & 0xFFFF]
        self.words = [
            mixed(np.add.reduceat(letters[data[inside]] * place, first) + sizes.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)
            for letters in (LETTER, OTHER_LETTER)[: 1 + second]
        ]
        of_text = np.flatnonzero(np.r_[True, np.diff(self.text) > 0]) if len(first) else np.zeros(0, np.int64)
        skip = np.array([skip for _, skip, _ in texts])
        self.new = np.arange(len(first)) - np.repeat(of_text, np.diff(np.r_[of_text, len(first)])) >= skip[self.text]

    def phrases(self, which: int = 0, longest: int = LONGEST, every: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For 1 to ``longest`` words: how many, where phrases begin, and their hashes. With ``every``, also the phrases
        that the segment before has counted."""
        words = self.words[which]
        total = words
        for size in range(1, longest + 1):
            count = len(words) - size + 1
            if count <= 0:
                return
            if size > 1:
                total = mixed(total[:count] + words[size - 1 :] * np.uint64(3))
            at = np.flatnonzero((self.piece[:count] == self.piece[size - 1 :]) & (self.new[size - 1 :] | every))
            yield size, at, total[at]


def blocks(batches: Iterator[pd.DataFrame], second: bool = False) -> Iterator[tuple[Block, pd.DataFrame]]:
    """Texts read into blocks of bounded size, with the rows of their documents (text left out)."""
    texts, rows, held = [], [], 0
    for batch in batches:
        columns = [name for name in batch.columns if name != "text"]
        for text, *rest in zip(batch["text"], *(batch[name] for name in columns)):
            for segment, skip in segments((text or "").encode("utf-8", "surrogatepass").translate(LOWER)):
                texts.append((segment, skip, len(rows)))
                rows.append(rest)
                held += len(segment) + 1
                if held >= BUFFER:
                    yield Block(texts, second), pd.DataFrame(rows, columns=columns)
                    texts, rows, held = [], [], 0
    if texts:
        yield Block(texts, second), pd.DataFrame(rows, columns=columns)


def local_keys(block: Block, rows: pd.DataFrame, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of phrases in their language, with the shard in the last bits."""
    doc = block.doc[at]
    keys = mixed(hashes + rows["tongue"].to_numpy().view(np.uint64)[doc])
    return (keys & ~SHARD_MASK) | rows["shard"].to_numpy().astype(np.uint64)[doc]


def _mined(sizes: tuple[int, ...], shared) -> Callable:
    """Counts of the phrases of so many words; with a filter, of those whose pairs may all be in it."""

    def summed(found: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        for start in range(0, len(keys), ROWS_OUT):
            part = slice(start, start + ROWS_OUT)
            yield pd.DataFrame({"key": keys[part].view(np.int64), "n": n[part].astype(np.int64)})

    def mined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for block, rows in blocks(batches):
            linked = np.zeros(len(block.start), bool)  # the word and the next one are a frequent pair
            if shared is not None:
                *_, (_, at, hashes) = block.phrases(longest=2, every=True) if len(linked) > 1 else [(2, np.zeros(0, int), np.zeros(0, np.uint64))]
                linked[at[may_hold(shared.value, local_keys(block, rows, at, hashes))]] = True
            for size, at, hashes in block.phrases(longest=max(sizes)):
                if size in sizes:
                    if shared is not None:
                        keep = np.ones(len(at), bool)
                        for step in range(size - 1):
                            keep &= linked[at + step]
                        at, hashes = at[keep], hashes[keep]
                    found.append(local_keys(block, rows, at, hashes))
            if sum(map(len, found)) >= HELD_KEYS:
                yield from summed(found)
                found = []
        if found:
            yield from summed(found)

    return mined


def _counted(shared) -> Callable:
    """Exact counts of the candidates (``phrase``), and of all words of a language (``phrase`` null)."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, rows in blocks(batches, second=True):
            langs = rows["lang"].to_numpy()
            tongue = rows["tongue"].to_numpy().view(np.uint64)
            n_words = pd.Series(1, index=langs[block.doc[block.new]]).groupby(level=0).sum()
            yield pd.DataFrame({"lang": n_words.index.astype(object), "phrase": None, "n": n_words.to_numpy(np.int64)})
            for (size, at, hashes), (_, _, others) in zip(block.phrases(), block.phrases(1)):
                own = tongue[block.doc[at]]
                full = mixed(hashes + own)
                held = may_hold(shared.value, full & ~SHARD_MASK)
                at, full, others = at[held], full[held], others[held] + own[held]
                if not len(at):
                    continue
                order = np.argsort(full)
                other = np.diff(others[order]) != 0
                if np.any(other & (np.diff(full[order]) == 0)):  # a collision of the first hashes
                    order = np.lexsort((others, full))
                    other = np.diff(others[order]) != 0
                new = np.flatnonzero(np.r_[True, (np.diff(full[order]) != 0) | other])
                first, n = at[order[new]], np.diff(np.r_[new, len(order)])
                spots = zip(block.start[first].tolist(), block.end[first + size - 1].tolist())
                names = [b" ".join(block.raw[a:b].split()).decode("utf-8", "surrogatepass") for a, b in spots]
                yield pd.DataFrame({"lang": langs[block.doc[first]], "phrase": names, "n": n.astype(np.int64)})

    return counted


def phrase_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, least: int, shards: int) -> DataFrame:
    """``lang``, ``phrase``, ``n`` of every phrase of one to five words with ``least`` occurrences in its language, and of
    all words of a language under a null phrase."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = docs.select(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("tongue"),
        F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int").alias("shard"),
    )
    support = -(-least // shards)
    context = docs.sparkSession.sparkContext

    def mine(sizes: tuple[int, ...], shared) -> DataFrame:
        counts = rows.select("text", "tongue", "shard").mapInPandas(_mined(sizes, shared), "key long, n long")
        return checkpointed(counts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= support).select("key"))

    short = mine((1, 2), None)
    long = mine((3, 4, 5), context.broadcast(bloom(short)))
    candidates = checkpointed(short.union(long).select(F.col("key").bitwiseAND(F.lit(~int(SHARD_MASK))).alias("key")).distinct())
    counts = rows.select("text", "lang", "tongue").mapInPandas(_counted(context.broadcast(bloom(candidates))), "lang string, phrase string, n long")
    return checkpointed(counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("phrase").isNull() | (F.col("n") >= least)))


def collocations(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    least: int = 100, top: int = 2000, cover: int = 100, shards: int = 8,
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the ``top`` phrases of two to five words of each language.

    Texts are cut into pieces at ``.,;:!?`` and line ends (line feed to carriage return), pieces into words at spaces and
    tabs; A-Z is lower-cased. ``a`` is the phrase's number of occurrences, overlapping ones included, ``n`` that of all
    words of the language. The cut of a phrase into two parts with the lowest ``floor(1000 a n / (l r))`` gives ``score``
    and the parts' occurrences ``l`` and ``r``. A phrase goes if a longer one around it has ``cover`` percent of its occurrences.

    A null language is ``und``; null and empty texts have no words; repeated rows and ids count each time; other columns
    are not read. Texts of any length are read in segments. A language without a phrase has no row; an empty table gives none.
    """
    if not 1 <= shards <= 1 << SHARD_BITS or least < 1:
        raise ValueError("shards must lie between 1 and 64, and least must be positive")
    counts = phrase_counts(docs, id_col, text_col, lang_col, least, shards)
    words = F.split("phrase", " ")
    known = counts.where("phrase is not null")
    totals = counts.where("phrase is null").select("lang", F.col("n").alias("total"))
    found = known.select("lang", "phrase", F.col("n").alias("a"), words.alias("words"), F.size(words).alias("size")).where("size > 1")

    def joined(start, count):
        return F.array_join(F.slice("words", start, count), " ")

    inner = found.where("size > 2").select("lang", F.explode(F.array(joined(1, F.col("size") - 1), joined(2, F.col("size") - 1))).alias("phrase"), "a")
    covering = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = found.join(covering, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", joined(1, F.col("cut")).alias("left"), joined(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("right")
    )
    left = known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    exact = {name: F.col(name).cast("decimal(18,0)") for name in ("a", "l", "r", "total")}
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang").select(
        "lang", "phrase", "a", "cut", "l", "r", "total",
        (exact["a"] * exact["total"] * F.lit(1000).cast("decimal(4,0)")).alias("over"), (exact["l"] * exact["r"]).alias("under"),
    )
    scored = cuts.withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "total")).alias("best"))
    flat = best.select(
        "lang", "phrase", F.col("best.a").alias("a"), F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.total").alias("n"), F.col("best.score").alias("score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return flat.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


SQL = r"""
with rows as (
    select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), pieces as (
    select lang, regexp_extract_all(unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')), '[^\x20\x09]+') as ws from rows
), totals as (
    select lang, sum(len(ws)) as n from pieces group by lang
), grams as (
    select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase
    from pieces, range(1, 6) ks(k) where len(ws) >= k
), f as (
    select lang, k, phrase, count(*) as a from grams group by all having count(*) >= 100
), longer as (
    select lang, unnest([array_to_string(string_split(phrase, ' ')[1:k - 1], ' '), array_to_string(string_split(phrase, ' ')[2:k], ' ')]) as phrase, a
    from f where k > 2
), kept as (
    select f.* from f where k > 1 and not exists (
        select 1 from longer o where o.lang = f.lang and o.phrase = f.phrase and 100 * o.a >= 100 * f.a
    )
), cuts as (
    select lang, phrase, a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') as p, array_to_string(string_split(phrase, ' ')[c + 1:k], ' ') as q
    from kept, range(1, 5) cs(c) where c < k
), scored as (
    select cuts.lang, cuts.phrase, cuts.a, c, x.a as l, y.a as r, n,
        (1000::hugeint * cuts.a::hugeint * n::hugeint) // (x.a::hugeint * y.a::hugeint) as score
    from cuts join f x on x.lang = cuts.lang and x.phrase = p join f y on y.lang = cuts.lang and y.phrase = q
        join totals on totals.lang = cuts.lang
), best as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1
)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best
) where rank <= 2000
"""
