"""Spelling variants: a trie as an edge table, and a frontier of (word, rest, node, edits) states joined to it level by level.

Words are the distinct lower-cased runs of letters of all texts. Each is put into a path-compressed trie twice, forwards
and backwards. A node is named by a hash of its prefix; an edge carries the letters up to the next node that branches, ends
a word or ends the first half of one. A round joins every state to the edges of its node: the edge's letters are used up,
with one letter replaced or left out at most. A state that reaches the end of another word with one edit is a neighbour;
insertions are the deletions of the longer word.

One edit leaves the first or the last half of a word alone. So states begin at the node that ends the word's first half,
beyond which nodes have few edges; words written backwards find the edits before it. A collision of hashes can only join
two nodes, which adds paths; the distance of every pair found is checked at the end, so the result is exact.

A node with many words below has its edges repeated under several salts, among which states are dealt. Lineage is cut
after each level. The number of levels is the largest number of branching nodes on one path, not the length of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import mixed
from treeloom.operators.checkpoints import checkpointed

LETTERS = "a-zÀ-ÿ"
SHORTEST = 5
SALT_ROWS = 20_000  # words below a node for each of its salts
STATE = ("id", "rest", "node", "edits", "salts")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_counts(docs: DataFrame, id_col: str, text_col: str, least: int, shortest: int, spoil: int) -> DataFrame:
    """``word``, ``n``: runs of letters with ``least`` occurrences or more. Of runs whose CRC-32 with their document's id
    is divisible by ``spoil``, one letter is deleted."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.expr(f"regexp_extract_all(translate(`{text_col}`, '{upper}', '{lower}'), '[{LETTERS}]{{{shortest},}}', 0)")).alias("run"),
    )
    code = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.pmod(code, F.length("run")).cast("int")
    spoiled = F.concat(F.expr("run").substr(F.lit(1), at), F.expr("run").substr(at + 2, F.length("run")))
    words = runs.select(F.when(code % spoil == 0, spoiled).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def prefix_nodes(texts: list[str], sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every prefix of every text, the empty one included: which text, its length, its node and the next letter (-1 at the end)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), sizes + 1)
    starts = np.cumsum(sizes + 1) - sizes - 1
    depth = np.arange(len(row)) - starts[row]
    following = np.full(len(row), -1, np.int64)
    inner = np.ones(len(row), bool)
    inner[starts + sizes] = False
    following[inner] = codes
    terms = np.zeros(len(row), np.uint64)
    first = np.zeros(len(row), bool)
    first[starts] = True
    terms[~first] = mixed(mixed(codes + _STEP) + (depth[~first].astype(np.uint64) * _STEP))
    sums = np.cumsum(terms, dtype=np.uint64)
    prefix = sums - sums[starts][row]
    node = mixed(prefix + mixed(depth.astype(np.uint64) * np.uint64(2) + sides.astype(np.uint64)[row] + np.uint64(1)))
    return row, depth.astype(np.int32), node.view(np.int64), following


def _prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        row, depth, node, following = prefix_nodes(batch["text"].tolist(), batch["side"].to_numpy())
        ids = batch["id"].to_numpy()[row] * 2 + batch["side"].to_numpy()[row]
        half = depth == batch["text"].map(len).to_numpy()[row] // 2
        for start in range(0, len(row), 200_000):
            part = slice(start, start + 200_000)
            yield pd.DataFrame({"node": node[part], "path": ids[part], "depth": depth[part], "following": following[part], "half": half[part]})


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges along the part of a word's path that it owns: from its first node's parent to each of the nodes in ``depth``."""
    for batch in batches:
        texts = batch["text"].tolist()
        _, _, node, _ = prefix_nodes(texts, batch["side"].to_numpy())
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes + 1) - sizes - 1
        counts = batch["depth"].map(len).to_numpy()
        row, to = np.repeat(np.arange(len(texts)), counts), np.concatenate([*batch["depth"], np.zeros(0, np.int32)]).astype(np.int64)
        since = np.maximum(np.r_[0, to[:-1]][: len(to)], 0)
        new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        since[new] = np.maximum(batch["first"].to_numpy()[row[new]] - 1, 0)
        real = to > since  # not the root itself
        row, since, to = row[real], since[real], to[real]
        yield pd.DataFrame({
            "node": node[starts[row] + since], "child": node[starts[row] + to],
            "label": [texts[r][a:b] for r, a, b in zip(row.tolist(), since.tolist(), to.tolist())],
            "words": np.concatenate([*batch["words"], np.zeros(0, np.int64)]).astype(np.int64)[real],
            "ends": np.concatenate([*batch["ends"], np.zeros(0, bool)]).astype(bool)[real],
        })


def trie(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edge table of ``paths`` (id, side, text): node, salt, label, child, salts (of the child), ends.
    And the salts of every node that has edges.

    Every node belongs to the word with the smallest id below it. What a word owns is then one piece at the end of its
    path, and its edges follow from the branching nodes in that piece: no node looks at all words below it.
    """
    nodes = (
        paths.mapInPandas(_prefixes, "node long, path long, depth int, following long, half boolean").groupBy("node").agg(
            F.min("path").alias("path"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("words"),
            (F.min("following") != F.max("following")).alias("branches"), (F.min("following") == -1).alias("ends"),
            F.max("half").alias("half"),
        )
    )
    stop = F.when(F.col("branches") | F.col("ends") | F.col("half"), F.struct("depth", "words", "ends"))
    owned = nodes.groupBy("path").agg(F.min("depth").alias("first"), F.sort_array(F.collect_list(stop)).alias("stops"))
    keyed = paths.withColumn("path", F.col("id") * 2 + F.col("side"))
    stops = [F.col(f"stops.{name}").alias(name) for name in ("depth", "words", "ends")]
    found = checkpointed(
        keyed.join(owned, "path").select("text", "side", "first", *stops)
        .mapInPandas(_edges, "node long, child long, label string, words long, ends boolean")
    )
    salts = checkpointed(found.groupBy("node").agg(F.ceil(F.sum("words") / F.lit(SALT_ROWS)).cast("int").alias("salts")))
    below = salts.withColumnRenamed("node", "child")
    edges = found.join(salts.withColumnRenamed("salts", "own"), "node").join(below, "child", "left").select(
        "node", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("salt"), "label", "child",
        F.coalesce("salts", F.lit(1)).alias("salts"), "ends",
    )
    return checkpointed(edges), salts


def _outcomes() -> Column:
    """What an edge makes of a state: (rest, edits) for each way to use up its label, null where there is none."""
    rest, label, size = F.col("rest"), F.col("label"), F.length("label")
    same = F.startswith(rest, label)

    def outcome(used: Column, edits: Column) -> Column:
        return F.struct(F.substr(rest, used + 1, F.length(rest)).alias("rest"), edits.alias("edits"))

    def one_edit(used: Column) -> Column:
        part = F.substr(rest, F.lit(1), used)
        return (F.col("edits") == 0) & ~same & (F.length(part) == used) & (F.levenshtein(part, label, 1) == 1)

    replaced = one_edit(size) & (F.substr(rest, F.lit(1), size) < label)  # each such pair is found from its smaller word
    return F.array(
        F.when(same, outcome(size, F.col("edits"))), F.when(replaced, outcome(size, F.lit(1))), F.when(one_edit(size + 1), outcome(size + 1, F.lit(1)))
    )


def neighbours(words: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) of ``id`` of the checkpointed ``words`` (id, word) that are one edit apart, each in both orders."""
    sides = [words.select("id", F.lit(side).alias("side"), text.alias("text")) for side, text in ((0, F.col("word")), (1, F.reverse("word")))]
    paths = sides[0].union(sides[1])
    edges, salts = trie(paths)
    edges = edges.repartition("node", "salt").persist()  # read by every round; lost parts come from the checkpoint
    places = checkpointed(paths.mapInPandas(_places, "id long, rest string, node long, ending long"))
    frontier = places.join(salts.where("salts > 1"), "node", "left").select(
        "id", "rest", "node", F.lit(0).alias("edits"), F.coalesce("salts", F.lit(1)).alias("salts")
    )
    hits: list[DataFrame] = []
    while True:
        dealt = frontier.withColumn("salt", F.pmod(F.xxhash64("id", "rest"), F.col("salts")).cast("int")).drop("salts")
        met = dealt.join(edges, ["node", "salt"]).where((F.col("edits") == 0) | F.startswith("rest", F.col("label")))
        stepped = checkpointed(
            met.select("id", F.explode(_outcomes()).alias("now"), "child", "salts", "ends").where("now is not null")
            .select("id", F.col("now.rest").alias("rest"), F.col("child").alias("node"), F.col("now.edits").alias("edits"), "salts", "ends")
        )
        if stepped.isEmpty():
            break
        hits.append(stepped.where(F.col("ends") & (F.length("rest") + F.col("edits") == 1)).select(F.col("id").alias("a"), "node"))
        frontier = stepped.where("rest <> ''").select(*STATE)
    edges.unpersist()
    if not hits:
        return words.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    ended = places.select(F.col("id").alias("b"), F.col("ending").alias("node"))
    met = reduce(DataFrame.union, hits).join(ended, "node").select("a", "b").where("a <> b").distinct()
    text = words.select("id", "word")
    checked = (
        met.join(text.select(F.col("id").alias("a"), F.col("word").alias("x")), "a").join(text.select(F.col("id").alias("b"), F.col("word").alias("y")), "b")
        .where(F.levenshtein("x", "y", 1) == 1).select("a", "b")
    )
    checked = checkpointed(checked)
    return checked.union(checked.select("b", "a")).distinct()


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where a word's states begin: what is left after its first half and the node there; and the node where it ends."""
    for batch in batches:
        texts = batch["text"].tolist()
        _, _, node, following = prefix_nodes(texts, batch["side"].to_numpy())
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes + 1) - sizes - 1
        yield pd.DataFrame({
            "id": batch["id"], "rest": [text[len(text) // 2 :] for text in texts], "node": node[starts + sizes // 2], "ending": node[following == -1],
        })


def last_forms(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: where following ``form`` ends, by doubling the length of the steps in each round. A form has at
    least twice the occurrences, so that chains are short and have no circles."""
    reached = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = checkpointed(reached.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reached = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            return reached


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, shortest: int = SHORTEST, times: int = 2, spoil: int = 97
) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of ``shortest`` letters with ``least`` occurrences.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased. Two are near if one inserted, deleted or
    replaced letter makes them equal. A word's form is its near word of largest ``n`` (ties: the smallest) if that has ``times``
    (at least 2) its occurrences. Null and empty texts have no words; a null id counts as an empty one; repeated rows count each
    time; other columns are not read. Words may be of any length. An empty table gives an empty result.
    """
    if times < 2:
        raise ValueError("a form must have at least twice the occurrences")
    words = checkpointed(word_counts(docs, id_col, text_col, least, shortest, spoil).withColumn("id", F.monotonically_increasing_id()))
    near = neighbours(words)
    of = words.select(F.col("id").alias("b"), F.col("n").alias("near_n"), F.col("word").alias("near"))
    best = near.join(of, "b").groupBy(F.col("a").alias("id")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    larger = -F.col("best.less") >= F.col("n") * F.lit(times)
    found = checkpointed(
        words.join(best, "id", "left").select(
            "word", F.when(larger, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(larger, -F.col("best.less")).alias("form_n"),
        )
    )
    ends = last_forms(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
