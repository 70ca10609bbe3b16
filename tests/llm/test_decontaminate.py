from collections import Counter

import numpy as np

from treeloom.llm import decontaminate as op


def table_score(a, b):
    best, rows = 0, [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, rows[-1][j - 1] + (op.MATCH if x == y else op.OTHER), rows[-1][j] + op.GAP, row[-1] + op.GAP))
        rows.append(row)
        best = max(best, max(row))
    return best


def test_alignment_equals_the_table():
    random = np.random.default_rng(1)
    for _ in range(100):
        a, b = random.integers(0, 5, random.integers(1, 12)), random.integers(0, 5, random.integers(1, 30))
        assert op.alignment(a, b)[0] == table_score(a.tolist(), b.tolist())


def test_copies_edits_and_clean(spark, docs_of, corpus, prose):
    item = prose(40, 50).split()
    edited = [w for k, w in enumerate(item) if k % 11] + ["tail"]
    shuffled = item[::-1]
    rows = corpus + [
        (100, prose(300, 51) + " " + " ".join(item) + " " + prose(20, 52)), (101, " ".join(edited)), (102, " ".join(shuffled)),
        (103, "See: yes, TINY item!"), (None, " ".join(item)),
    ]
    items = spark.createDataFrame([(1, " ".join(item), 3), (2, "tiny ITEM", 3), (3, None, 3), (4, " ..", 3), (None, "", 3), (1, " ".join(item), 3)], "item_id long, text string, score int")
    got = {(r["doc_id"], r["item_id"]): r for r in op.contaminated(docs_of(rows), items).collect()}
    assert set(got) == {(100, 1), (101, 1), (103, 2), (None, 1)}
    assert got[100, 1]["score"] == 1 and (got[100, 1]["first_word"], got[100, 1]["last_word"]) == (300, 339)
    assert 0.5 <= got[101, 1]["score"] < 1
    rows.append((3, " ".join(item)))  # an id that clean rows have as well
    kept = [(r["doc_id"], r["text"]) for r in op.decontaminate(docs_of(rows), items).collect()]
    assert Counter(kept) == Counter(row for row in rows if row[0] not in (100, 101, 103) and row[1] != " ".join(item))


def test_blocks_of_items(spark, docs_of, prose, monkeypatch):
    items = spark.createDataFrame([(k, prose(30, 60 + k)) for k in range(12)], "item_id long, text string")
    rows = [(k, prose(10, 90 + k) + " " + prose(30, 60 + k)) for k in range(12)]
    monkeypatch.setattr(op, "BLOCK_CHARS", 700)
    assert sorted((r["doc_id"], r["item_id"]) for r in op.contaminated(docs_of(rows), items).collect()) == [(k, k) for k in range(12)]


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.contaminated(docs_of([(1, "a b c")]), none).collect() == []
    assert op.contaminated(docs_of([]), spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).collect() == []


def test_edited_copies_are_found_as_by_full_alignment(spark, docs_of, prose):
    from treeloom.llm.common import words_of

    dice, items, rows = np.random.default_rng(7), [prose(40, 500 + k) for k in range(40)], []
    for k, item in enumerate(items):
        words = item.split()
        rows.append((k, f"{prose(30, k)} {item}"))  # a verbatim copy, so that lost n-grams occur in one document
        for every in (6, 5, 4):
            rows.append((1000 * every + k, " ".join("edited" if at % every == every - 1 else w for at, w in enumerate(words))))
        for percent in (15, 20, 25, 30):
            changed = []
            for w in words:
                kind = dice.choice(4, p=[1 - percent / 100, percent / 200, percent / 400, percent / 400])
                changed += [[w], ["other"], [], [w, "more"]][kind]
            rows.append((100_000 * percent + k, f"{prose(20, 900 + k)} {' '.join(changed)} {prose(20, 950 + k)}"))
    frame = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(80 * r["score"]) for r in op.contaminated(docs_of(rows), frame).collect()}
    full = {(key, at): op.alignment(words_of(item), words_of(text))[0] for key, text in rows for at, item in enumerate(items) if key % 1000 == at}
    want = {pair: score for pair, score in full.items() if score >= 40}
    assert {pair: want[pair] for pair in got} == got
    assert {pair for pair in want if pair[0] < 100_000} <= set(got)
    for percent in (15, 20, 25, 30):
        wanted = {pair for pair in want if pair[0] // 100_000 == percent}
        assert len(wanted) > 20 and len(wanted & set(got)) >= 0.97 * len(wanted), (percent, len(wanted), len(wanted & set(got)))


def seeds_of(spark, rows, items, n=3):
    from pyspark.sql import functions as F

    texts = spark.createDataFrame(rows, "id long, text string").select("text")
    tests = spark.createDataFrame(items, "id long, text string").withColumn("of_text", F.xxhash64("text"))
    named = {r["of_text"]: r["id"] for r in tests.collect()}
    found = {}
    for row in op.rare_seeds(texts, tests, n).collect():
        found.setdefault(named[row["of_text"]], set()).add(row["key"])
    return found


def keys_of(text, n=3):
    from treeloom.llm.common import gram_hashes, words_of

    return set(gram_hashes(words_of(text), n).view(np.int64).tolist())


def test_rare_seeds_equal_counting(spark, docs_of, prose, monkeypatch):
    monkeypatch.setattr(op, "FEW", 3)
    phrase = "one of the many"
    items = [(k, f"{prose(12, 700 + k)} {phrase}") for k in range(30)] + [(50, phrase), (51, "tiny item")]
    rows = [(k, f"{prose(20, 800 + k)} {phrase} {prose(5, 840 + k)}") for k in range(25)]
    rows += [(100 + k, items[k][1]) for k in range(5)] + [(200 + k, items[7][1]) for k in range(12)] + [(300, "a tiny item"), (301, ""), (302, None)]
    held = [keys_of(text) | keys_of(text, 2) for _, text in rows if text]
    want = {}
    owners = [keys_of(text) for _, text in items]
    for (key, _), mine in zip(items, owners):
        weight = {g: sum(g in h for h in held) * sum(g in o for o in owners) for g in mine}
        weight = {g: w for g, w in weight.items() if w}
        bound = max(3, len(rows) / 2)
        if weight:
            least = min(weight.values())
            want[key] = {g for g, w in weight.items() if w <= (bound if least <= bound else 2 * least)}
    got = seeds_of(spark, rows, items)
    assert got == want
    assert not keys_of(phrase) & got[0] and got[50] == keys_of(phrase)  # common in 31 items; the only n-grams of one of them
    assert got[7] >= keys_of(items[7][1].rsplit(" ", 4)[0])  # copied into many documents, still rare


def test_common_phrases_of_thousands_of_items(spark, docs_of, prose):
    phrase = "which of the following is"
    items = [(k, f"{phrase} {prose(14, 2000 + k)}") for k in range(3000)]
    rows = [(k, f"{prose(30, 6000 + k)} {phrase} {prose(30, 7000 + k)}") for k in range(60)]
    rows += [(1000 + k, f"{prose(10, 8000 + k)} {items[k][1]}") for k in range(0, 3000, 100)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op.contaminated(docs_of(rows), frame).collect()}
    assert got == {(1000 + k, k) for k in range(0, 3000, 100)}
