"""Collocations against plain counting of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from treeloom.llm import collocations as op
from treeloom.llm import filters

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, cover):
    """Rows are (id, text, lang)."""
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                for at in range(len(words) - size + 1):
                    f[lang, tuple(words[at : at + size])] += 1
    out = {}
    for (lang, words), a in f.items():
        if len(words) < 2 or a < least:
            continue
        around = [b for (other, long), b in f.items() if other == lang and b >= least and len(long) > len(words) and any(long[k : k + len(words)] == words for k in range(len(long)))]
        if any(100 * b >= cover * a for b in around):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items() for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)
    )


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(8)
    words = ["New", "york", "city", "the", "of", "Ähre", "x y", "hall", "to", "be", "1"]
    made = []
    for key in range(60):
        text = "".join(dice.choice(words) + dice.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\x0b"]) for _ in range(dice.randint(0, 60)))
        made.append((key % 50, text + " to be to be to be or New  York\tCity hall", dice.choice(["en", "de", None])))
    return made + [(None, "new york " * 9, "en"), (None, None, None), (7, "", "fr"), (8, ". ,\t", "fr"), (9, "a b a b a b a b", "fr")] + [made[0]] * 3


@pytest.fixture
def frame(spark, docs_of):
    return lambda rows: spark.createDataFrame([(*row, 5, "x", "y") for row in rows], "doc_id long, text string, lang string, rank int, phrase string, n string")


@pytest.mark.parametrize(("least", "top", "cover", "shards"), [(6, 12, 100, 3), (4, 2000, 80, 1), (20, 3, 100, 8)])
def test_equals_counting(frame, rows, least, top, cover, shards):
    got = sorted(tuple(r) for r in op.collocations(frame(rows), least=least, top=top, cover=cover, shards=shards).collect())
    want = brute(rows, least, top, cover)
    assert got == want and want


def test_segments_and_small_buffers_count_alike(frame, rows, monkeypatch):
    text = " ".join(text for _, text, _ in rows if text)
    for size in (1, 7, 50):
        monkeypatch.setattr(op, "SEGMENT", size)
        raw = text.encode().translate(op.LOWER)
        whole = Counter()
        for segment, skip in op.segments(raw):
            block = op.Block([(segment, skip, 0)])
            for _, _, hashes in block.phrases():
                whole.update(hashes.tolist())
        monkeypatch.setattr(op, "SEGMENT", 1 << 22)
        once = Counter()
        for _, _, hashes in op.Block([(raw, 0, 0)]).phrases():
            once.update(hashes.tolist())
        assert whole == once


def test_exact_beyond_64_bits(spark, monkeypatch):
    counts = [("en", None, 10**14), ("en", "a", 10**12), ("en", "b", 10**11), ("en", "a b", 10**11 - 1)]
    frame = spark.createDataFrame(counts, "lang string, phrase string, n long")
    monkeypatch.setattr(op, "phrase_counts", lambda *_: frame)
    row = op.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).first()
    assert row["score"] == 1000 * (10**11 - 1) * 10**14 // (10**12 * 10**11)


def test_filter_keeps_its_keys(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 3000)
    bits = filters.bloom(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert filters.may_hold(bits, keys.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 2**63, 10_000).astype(np.uint64)
    assert filters.may_hold(bits, others).mean() < 0.01


def test_nothing(frame):
    assert op.collocations(frame([])).collect() == []
    assert op.collocations(frame([(1, "a b", "en")])).collect() == []
    with pytest.raises(ValueError):
        op.collocations(frame([]), shards=0)
