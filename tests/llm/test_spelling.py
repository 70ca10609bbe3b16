"""Spelling variants against a dictionary of deletions over all words."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from treeloom.llm import spelling as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, spoil=97):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            code = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if code % spoil == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            counts[run] += len(run) >= 5
    n = {word: count for word, count in counts.items() if count >= least}
    holes, near = defaultdict(set), defaultdict(set)
    for word in n:
        for at in range(len(word)):
            holes[word[:at] + "*" + word[at + 1 :]].add(word)
    for word in n:
        for at in range(len(word)):
            near[word] |= holes[word[:at] + "*" + word[at + 1 :]] - {word}
            if (shorter := word[:at] + word[at + 1 :]) in n:
                near[word].add(shorter)
                near[shorter].add(word)
    best = {word: min(others, key=lambda other: (-n[other], other)) for word, others in near.items() if others}
    form = {word: other for word, other in best.items() if n[other] >= 2 * n[word]}
    out = set()
    for word in n:
        last = word
        while last in form:
            last = form[last]
        out.add((word, form.get(word), last, n[word], len(near[word]), n.get(form.get(word))))
    return out


def check(docs_of, rows, **options):
    got = [tuple(r) for r in op.spelling_variants(docs_of(rows), **options).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, **{k: v for k, v in options.items() if k != "times"})
    return got


def test_equals_brute_force(docs_of, corpus):
    found = {row[0]: row for row in check(docs_of, corpus, least=1, spoil=5)}
    assert any(row[1] for row in found.values()) and any(row[4] > 1 for row in found.values())


def test_edits_everywhere_and_chains(docs_of):
    words = {"colour": 40, "color": 9, "colours": 4, "collour": 3, "xolour": 3, "colouß": 3, "aaaaa": 8, "aaaaaa": 3, "aaaaaaa": 20, "Àbcdé": 3, "àbcdé": 7, "short": 2}
    rows = [(1, " ".join(f"{word} " * count for word, count in words.items())), (2, "COLOUR,Colour;coLour"), (None, "x×y÷zz x×y÷zz1x×y÷zz")]
    found = {row[0]: row for row in check(docs_of, rows)}
    assert found["color"][1] == "colour" and found["aaaaaa"][1] == "aaaaaaa" and "short" not in found


def test_very_long_words_and_a_hot_prefix(docs_of, monkeypatch):
    monkeypatch.setattr(op, "SALT_ROWS", 3)
    long = "abcdefghij" * 3000
    rows = [(1, " ".join([long, long[:-1], long[1:], "x" + long[1:], long + long] * 3))]
    rows += [(k, " ".join(f"prefixes{a}{b}" for a in "abcdefg" for b in ("", "x", "y"))) for k in range(3, 6)]
    check(docs_of, rows)


def test_nothing_to_do(docs_of):
    for rows in ([], [(1, None), (2, ""), (3, "ab cd 12345")]):
        assert op.spelling_variants(docs_of(rows)).collect() == []
    with pytest.raises(ValueError):
        op.spelling_variants(docs_of([]), times=1)
