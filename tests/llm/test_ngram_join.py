import numpy as np
import pytest

from treeloom.llm import ngram_join as op
from treeloom.llm.common import Groups, components, gram_hashes, hash_words, words_of


def brute(rows, threshold=0.8):
    sets = [set(gram_hashes(words_of(text), 5).tolist()) for _, text in rows]
    links, groups = [0] * len(rows), Groups(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if None not in (rows[i][0], rows[j][0]) and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                groups.link(i, j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[groups.root(i)] = min(key, least.get(groups.root(i), key))
    return sorted(((key, None if key is None else least[groups.root(i)], links[i]) for i, (key, _) in enumerate(rows)), key=str)


def test_equals_all_pairs(docs_of, corpus):
    got = sorted((tuple(r) for r in op.ngram_join(docs_of(corpus)).collect()), key=str)
    assert got == brute(corpus)


def test_large_groups_are_compared_in_blocks(docs_of, corpus, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ROWS", 2)
    got = sorted((tuple(r) for r in op.ngram_join(docs_of(corpus)).collect()), key=str)
    assert got == brute(corpus)


def test_empty_table(docs_of):
    assert op.ngram_join(docs_of([])).collect() == []


def test_bands_reach_the_recall():
    bands, rows = op.choose_bands(0.8, 0.9995)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_words_in_pieces_and_long_words(prose, monkeypatch):
    from treeloom.llm import common

    text = prose(300, 1) + "\n" + "x" * 70_000 + " ende, Zwölf\tx_1 !!! (a)"
    want = [hash_words(w.encode())[0][0] for w in common.cleaned(text).decode().split()]
    assert len(set(want)) > 200 and words_of(text).tolist() == want
    monkeypatch.setattr(common, "PIECE", 64)
    assert words_of(text).tolist() == want
    assert words_of("A, b-c") .tolist() == words_of("a b\u2014\u201cc!").tolist() and not len(words_of(" .,; "))


def test_shared_counts():
    random = np.random.default_rng(1)
    sets = [np.unique(np.r_[random.integers(0, 400, 60), np.arange(1000, 1030)]).astype(np.uint64) for _ in range(40)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert op.shared_counts(sets).astype(int).tolist() == want


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 50)]])
def test_components(spark, edges):
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {node: 50 if node >= 50 else 0 for edge in edges for node in edge if edge[0] != edge[1]}
    assert found == want
