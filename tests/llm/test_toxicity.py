"""Toxicity: the models against plain dictionaries, both ways to reach the table, held-out quality, and edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from treeloom.llm import toxicity as op


def words_of(text):
    return [w for w in re.split(rb"[^a-z\x80-\xff]+", (text or "").lower().encode()) if w]


def models(texts):
    """Interpolated Kneser-Ney from (label, text) rows: a function of (label, word) for its log-likelihood."""
    tops = {0: Counter(), 1: Counter()}
    for label, text in texts:
        for word in words_of(text):
            spelled = b" " + word + b" "
            for end in range(2, len(spelled) + 1):
                tops[label][spelled[max(0, end - op.ORDER) : end]] += 1
    counts = {}
    for label in (0, 1):
        level = Counter({g: n for g, n in tops[label].items() if len(g) == op.ORDER})
        for size in range(op.ORDER, op.SHARED, -1):
            counts[label, size] = level
            level = Counter(g[1:] for g in level) + Counter({g: n for g, n in tops[label].items() if len(g) == size - 1})
    level = Counter(g[1:] for g in set(counts[0, op.SHARED + 1]) | set(counts[1, op.SHARED + 1]))
    for size in range(op.SHARED, 0, -1):
        for label in (0, 1):
            level += Counter({g: n for g, n in tops[label].items() if len(g) == size})
        counts[0, size] = counts[1, size] = level
        level = Counter(g[1:] for g in level)
    sums = {}
    for key, level in counts.items():
        of = sums[key] = defaultdict(lambda: [0, 0])
        for g, n in level.items():
            of[g[:-1]][0] += n
            of[g[:-1]][1] += 1

    def log_likelihood(label, word):
        spelled, total = b" " + word + b" ", 0.0
        for end in range(2, len(spelled) + 1):
            chance = op.UNIFORM
            for size in range(1, min(end, op.ORDER) + 1):
                g = spelled[end - size : end]
                n, kinds = sums[label, size].get(g[:-1], (0, 0))
                if n:
                    chance = max(counts[label, size][g] - op.DISCOUNT, 0) / n + op.DISCOUNT * kinds / n * chance
            total += math.log(chance)
        return total

    return log_likelihood


@pytest.fixture(scope="module")
def made():
    """Labelled texts of invented words; toxic ones have a few rude stems with any ending."""
    dice = random.Random(5)
    plain = ["".join(dice.choice("abcdeghilmnoprstuü") for _ in range(dice.randint(2, 8))) for _ in range(150)]
    texts = []
    for key in range(700):
        toxic = key % 5 == 0
        words = dice.choices(plain, k=dice.randint(8, 90))
        for _ in range(max(1, len(words) // 30) if toxic else 0):
            words[dice.randrange(len(words))] = dice.choice(["vexkraz", "wuffjik"]) + dice.choice(plain)[:3]
        texts.append((key, " ".join(words).capitalize() + ".", int(toxic)))
    return texts


@pytest.fixture
def frames(spark, docs_of):
    def both(texts, extra=()):
        docs = docs_of([(key, text) for key, text, _ in texts] + list(extra)).withColumnRenamed("root", "score")
        labels = spark.createDataFrame([(key, 1, toxic) for key, _, toxic in texts if toxic is not None and key % 10 != 9], "doc_id long, quality int, toxic int")
        return docs, labels

    return both


def test_evidence_equals_plain_models(frames, made):
    docs, labels = frames(made)
    learned = op.learn(docs, labels, "doc_id", "text", "toxic", 10**6, 1000)
    rows = learned.table.toArrow()
    model = op.Model(rows.column("gram").to_numpy(), np.column_stack([rows.column(n).to_numpy().astype(np.float32) for n in ("a0", "a1", "b0", "b1")]))
    from pyspark.sql import functions as F

    counted = {r[0] for r in docs.where(~op.held_out("doc_id") & (F.pmod(F.xxhash64("doc_id"), F.lit(5)) > 0)).select("doc_id").collect()}
    plain = models([(toxic, text) for key, text, toxic in made if key in counted and key % 10 != 9])
    words = sorted({w for _, text, _ in made[:60] for w in words_of(text)} | {b"a", "ßéx".encode(), b"vexkrazqq", b"zzzzzzzzzzzz"})
    want = [plain(1, w) - plain(0, w) for w in words]
    assert np.allclose(model.of(words), want, atol=1e-4)


def test_held_out_rows_are_told_apart(frames, made):
    docs, labels = frames(made)
    got = {r["doc_id"]: r for r in op.toxicity(docs, labels).collect()}
    truth = {key: toxic for key, _, toxic in made}
    for held in (True, False):
        rows = [r for r in got.values() if r["held_out"] is held]
        assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for k, r in got.items())


def test_a_large_table_is_joined(frames, made, corpus, monkeypatch):
    docs, labels = frames(made[:200], corpus)
    small = sorted(((r["doc_id"] or -1, r["score"]) for r in op.toxicity(docs, labels).collect()))
    joined = sorted(((r["doc_id"] or -1, r["score"]) for r in op.toxicity(docs, labels, most_entries=10, most_labels=5).collect()))
    assert len(small) == 200 + len(corpus) and [k for k, _ in small] == [k for k, _ in joined]
    assert np.allclose([s for _, s in small], [s for _, s in joined], atol=1e-5)


def test_long_texts_in_segments(frames, made, monkeypatch):
    extra = [(10_001, " ".join(text for _, text, _ in made[:80])), (10_002, "x" * 5000), (10_003, None), (10_004, " .,1"), (None, "Vexkrazor!")]
    docs, labels = frames(made[:300], extra)
    whole = {r["doc_id"]: r["score"] for r in op.toxicity(docs, labels).collect()}
    monkeypatch.setattr(op, "SEGMENT", 200)
    for _, text in extra:
        pieces = [op.Words([part]) for part in op.segments(op.lowered(text))]
        names = [name for piece in pieces for name in piece.names(piece.number)]
        assert sorted(names) == sorted(words_of(text))
    assert whole[10_003] == whole[10_004] < 0.7 and None in whole and len(whole) == 305


def test_means_count_repeats():
    text, value, n = np.array([0, 0, 1, 1, 1]), np.array([1.0, 3.0, 5.0, 2.0, 2.0]), np.array([1.0, 2.0, 1.0, 99.0, 50.0])
    got = op.means(text, value, n, 3)
    assert np.allclose(got, [[7 / 3, 3], [303 / 150, (5 + 2 * 2) / 3], [0, 0]])


def test_nothing_to_learn(frames, made):
    for texts in ([], [(1, "a b", 0)], [(k, "only ordinary words", 0) for k in range(40)]):
        docs, labels = frames(texts)
        assert {(r["score"], r["predicted"]) for r in op.toxicity(docs, labels).collect()} <= {(0.0, 0)}
