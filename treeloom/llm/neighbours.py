"""Approximate nearest neighbours by learned partitions.

On a bounded sample the exact neighbour graph is built and cut into balanced parts: the parts start from a balanced
hierarchy of splits, and vectors then move to the part that holds most of their neighbours, within the parts'
capacity. A small network (one hidden layer, softmax) learns the part of a vector from the vector. Every row is
indexed under its most probable part; a query goes to its most probable parts, as many as queries need that were kept
out of graph and training, and to further ones until they hold enough rows. There it is answered by exact inner products
in double precision. The number of parts follows the sample, not the table: it is what the network can tell apart. Large
parts are read in blocks.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.operators.checkpoints import checkpointed

SAMPLE = 8192  # about as many rows are fitted on, at most twice as many
MOST_PARTS = 32
SAMPLE_ROWS = 32  # of a part, at least
BLOCK_ROWS = 20_000  # rows of a part in one task
QUERY_ROWS = 5_000  # queries of a part in one task
NEIGHBOURS = 16


@dataclass
class Router:
    """Part probabilities of vectors; ``probes`` parts are searched for a query."""

    shift: np.ndarray
    scale: float
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    probes: int = 1

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        inside = np.maximum(((vectors - self.shift) * self.scale) @ self.hidden + self.hidden_bias, 0)
        return inside @ self.out + self.out_bias

    def parts(self, vectors: np.ndarray, count: int) -> np.ndarray:
        return np.argsort(-self.scores(vectors), axis=1, kind="stable")[:, :count].astype(np.int32)


def nearest(vectors: np.ndarray, queries: np.ndarray, count: int) -> np.ndarray:
    """Positions of the largest inner products, for each query, the query itself included if it is a vector."""
    found = []
    for start in range(0, len(queries), 256):
        score = queries[start : start + 256] @ vectors.T
        found.append(np.argpartition(-score, min(count, score.shape[1]) - 1, axis=1)[:, :count])
    return np.concatenate(found)


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """A part for each vector, of nearly equal sizes, with most edges of ``graph`` inside parts."""
    random, size = np.random.default_rng(3), len(vectors)
    label = np.zeros(size, np.int64)
    todo = [(np.arange(size), 0, parts)]
    while todo:  # halve along the direction in which the rows spread most
        rows, first, count = todo.pop()
        if count == 1 or len(rows) < 2:
            label[rows] = first
            continue
        centred = vectors[rows] - vectors[rows].mean(axis=0)
        axis = random.standard_normal(vectors.shape[1])
        for _ in range(12):
            axis = centred.T @ (centred @ axis)
            axis /= np.linalg.norm(axis) + 1e-30
        order = np.argsort(centred @ axis, kind="stable")
        half = count // 2
        cut = len(rows) * half // count
        todo += [(rows[order[:cut]], first, half), (rows[order[cut:]], first + half, count - half)]
    capacity = int(np.ceil(size / parts * 1.1))
    held = np.bincount(label, minlength=parts)
    for _ in range(rounds):  # move towards neighbours, best gain first, where there is room
        near = label[graph]
        votes = np.zeros((size, parts), np.float32)
        np.add.at(votes, (np.repeat(np.arange(size), graph.shape[1]), near.ravel()), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(size), best] - votes[np.arange(size), label]
        moved = 0
        for row in np.argsort(-gain, kind="stable"):
            if gain[row] <= 0:
                break
            if held[best[row]] < capacity:
                held[label[row]] -= 1
                held[best[row]] += 1
                label[row] = best[row]
                moved += 1
        if not moved:
            break
    return label


def train(vectors: np.ndarray, label: np.ndarray, parts: int, width: int = 128, epochs: int = 60) -> Router:
    """Adam on the cross-entropy, a fixed seed."""
    random = np.random.default_rng(5)
    shift = vectors.mean(axis=0)
    scale = 1 / (np.sqrt(((vectors - shift) ** 2).mean()) + 1e-30)
    x = (vectors - shift) * scale
    weights = [
        random.standard_normal((x.shape[1], width)) * np.sqrt(2 / x.shape[1]), np.zeros(width),
        random.standard_normal((width, parts)) * np.sqrt(1 / width), np.zeros(parts),
    ]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = random.permutation(len(x))
        for start in range(0, len(x), 256):
            rows = order[start : start + 256]
            inside = np.maximum(x[rows] @ weights[0] + weights[1], 0)
            score = inside @ weights[2] + weights[3]
            score = np.exp(score - score.max(axis=1, keepdims=True))
            error = score / score.sum(axis=1, keepdims=True)
            error[np.arange(len(rows)), label[rows]] -= 1
            error /= len(rows)
            back = (error @ weights[2].T) * (inside > 0)
            slopes = [x[rows].T @ back, back.sum(axis=0), inside.T @ error, error.sum(axis=0)]
            step += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                weights[k] -= 2e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Router(shift, scale, *weights)


def fit(sample: np.ndarray, recall: float, count: int) -> Router:
    """``sample``: finite vectors other than zero, one per row."""
    sample = np.unique(sample, axis=0)  # copies would fill a part
    size = len(sample)
    parts = max(1, min(MOST_PARTS, size // SAMPLE_ROWS))
    mixed = np.random.default_rng(9).permutation(size)
    asked, known = mixed[: min(1024, size // 8)], np.sort(mixed[min(1024, size // 8) :])
    graph = nearest(sample[known], sample[known], min(NEIGHBOURS, len(known)))
    router = train(sample[known], balanced_parts(sample[known], graph, parts), parts)
    if not len(asked) or parts == 1:
        router.probes = parts
        return router
    # How many parts hold the neighbours that queries want which neither graph nor network have seen.
    wanted = nearest(sample, sample[asked], min(count + 1, size))
    others = wanted != asked[:, None]
    home = router.parts(sample, 1)[:, 0]
    order = router.parts(sample[asked], parts)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts, dtype=order.dtype)[None, :].repeat(len(order), 0), axis=1)
    place = np.take_along_axis(rank, home[wanted], axis=1)[others]
    share = np.array([(place < probes).mean() for probes in range(1, parts + 1)])
    router.probes = min(parts, int(np.searchsorted(share, recall)) + 1)
    return router


def _fit(recall: float, count: int):
    """The model is fitted in one task, on the bounded sample; the driver gets the model alone."""

    def fitted(sample: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(sample["v"].to_numpy())
        return pd.DataFrame({"model": [pickle.dumps(fit(vectors[np.lexsort(vectors.T)], recall, count))]})

    return fitted


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows that take part."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.coalesce(whole & F.exists("v", lambda x: x != 0), F.lit(False)))


def search(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = 20, recall: float = 0.97
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of each query's ``count`` nearest rows found, by the inner
    product of the original vectors in double precision; ties go to the smaller id. The query's own row does not count.

    Both tables have an id and a vector. Rows that are null, zero or hold null or non-finite components take no
    part, nor do rows whose number of components is not the most common one, nor null ids. Rows that repeat an
    id and a vector count once; an id that comes with several vectors keeps its best score per query. A query with
    fewer candidates than ``count`` gets all that its parts hold. Other columns are ignored. An empty table on either
    side gives an empty result. ``recall`` is aimed at on the sample; measure it on the data.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vector_col).distinct()
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    out = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], out)
    total, rows = sizes["n"], checkpointed(rows.where(F.size("v") == sizes["size"]))
    asked = _usable(queries, id_col, vector_col).where(F.size("v") == sizes["size"]).distinct()
    share = min(1.0, SAMPLE / total)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).select("v").limit(2 * SAMPLE)
    router = pickle.loads(sample.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(_fit(recall, count), "model binary").first()["model"])
    shared = spark.sparkContext.broadcast(router)

    def routed(held: np.ndarray | None):
        """With the rows that each part holds: to so many parts that these hold ``count`` rows besides the query."""

        def route(batches):
            for batch in batches:
                if not len(batch):
                    continue
                vectors = np.stack(batch["v"].to_numpy())
                if held is None:
                    batch["part"] = list(shared.value.parts(vectors, 1))
                else:
                    order = shared.value.parts(vectors, len(held))
                    enough = (np.cumsum(held[order], axis=1) <= count).sum(axis=1) + 1
                    batch["part"] = [own[: max(probes, router.probes)] for own, probes in zip(order, enough)]
                yield batch

        return route

    schema = "id long, v array<double>, part array<int>"
    base = checkpointed(rows.mapInPandas(routed(None), schema).withColumn("part", F.col("part")[0]))
    held = np.zeros(router.out.shape[1], np.int64)
    for row in base.groupBy("part").agg(F.countDistinct("id").alias("n")).collect():  # at most MOST_PARTS
        held[row["part"]] = row["n"]
    asked = checkpointed(asked.mapInPandas(routed(held), schema).withColumn("part", F.explode("part")))
    per_part = base.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    per_query = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("slices"))
    shape = F.broadcast(per_part.join(per_query, "part"))  # one row per part, at most MOST_PARTS
    block, part_slice = F.pmod(F.xxhash64("id"), F.col("blocks")), F.pmod(F.xxhash64("id"), F.col("slices"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - F.lit(1).cast("long")))
    left = base.join(shape, "part").select("part", block.alias("block"), every("slices").alias("slice"), "id", "v")
    right = asked.join(shape, "part").select("part", every("blocks").alias("block"), part_slice.alias("slice"), "id", "v")
    keys = ["part", "block", "slice"]
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(_answer(count), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")


def _answer(count: int):
    def answered(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            order = np.argsort(rows["id"].to_numpy(), kind="stable")
            ids, base = rows["id"].to_numpy()[order], np.stack(rows["v"].to_numpy())[order]
            names, queries = asked["id"].to_numpy(), np.stack(asked["v"].to_numpy())
            slack = 1e-9 * (np.abs(base).max() * np.abs(queries).max() * base.shape[1] + 1e-300)
            for start in range(0, len(queries), 256):
                rough = queries[start : start + 256] @ base.T
                take = min(count + 1, rough.shape[1])
                limits = -np.partition(-rough, take - 1, axis=1)[:, take - 1] - slack
                for name, query, score, limit in zip(names[start:], queries[start:], rough, limits):
                    near = np.flatnonzero(score >= limit)
                    near = near[ids[near] != name]
                    exact = (base[near] * query).sum(axis=1)  # the same sum for the same vector, wherever it stands
                    best = np.lexsort((ids[near], -exact))[:count]
                    out.append((np.full(len(best), name), ids[near][best], exact[best]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    return answered
