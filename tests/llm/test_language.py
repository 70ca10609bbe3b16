import itertools
import math
import zlib

import pytest
from pyspark.sql import functions as F

from treeloom.llm import language as op
from treeloom.llm.queries import op3_language, tokenizer_path

SF = "/root/testdata/sf0.001"


def all_cuts(word, ids, chance):
    total = 0.0
    for bits in itertools.product((0, 1), repeat=len(word) - 1):
        parts, start = [], 0
        for at, bit in enumerate((*bits, 1), 1):
            if bit:
                parts.append(word[start:at])
                start = at
        if all(p in ids or len(p) == 1 for p in parts):
            total += math.prod(chance[ids[p]] if p in ids else op.UNKNOWN for p in parts)
    return total


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", "bb"]
    lattice, chance = op.Lattice(pieces), [0.3, 0.2, 0.2, 0.1, 0.1, 0.1]
    for word in ("a", "ab", "abab", "bbaabx", "xx"):
        edges = lattice.edges(word)
        assert math.isclose(math.exp(op.log_chance(edges, len(word), chance)), all_cuts(word, lattice.ids, chance), rel_tol=1e-9)
        counts = sum(part for _, part in op.piece_counts([e for e in edges], len(word), chance))
        assert counts <= len(word) + 1e-9


def test_side_by_side_sums_equal_the_forward_algorithm():
    pieces = ["▁", "a", "b", "▁ab", "ab", "ba", "aba"]
    model = op.Model(["x", "y"], pieces, [[0.3, 0.1, 0.2, 0.1, 0.1, 0.1, 0.1], [0.1, 0.3, 0.1, 0.2, 0.1, 0.1, 0.1]])
    scores = op.WordScores(model)
    for word in ("▁ab", "▁abab", "▁" + "abxa" * 5, "▁" + "ab" * 200):
        edges = model.lattice.edges(word)
        want = [op.log_chance(edges, len(word), chance) for chance in model.chances]
        assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(scores.logs([word.removeprefix(op.START)])[0], want))
    scores.add(["ab,ba!"])
    row = scores.rows[scores["ab,ba!"]]
    assert row[-1] == 2 and math.isclose(row[0], sum(scores.logs([w])[0][0] for w in ("ab", "ba")))
    scores.add(["12"])
    assert scores.rows[scores["12"]].tolist() == [0, 0, 0]
    for number in range(5000):  # the table grows
        word = "".join("ab"[number >> bit & 1] for bit in range(13))
        scores.add([f"({word})"])
        places = scores[f"({word})"], scores[word]
        assert scores.rows[places[0]].tolist() == scores.rows[places[1]].tolist()


def test_long_words_do_not_underflow():
    lattice = op.Lattice(["a", "aa"])
    word = "a" * 5000 + "x" * 100
    value = op.log_chance(lattice.edges(word), len(word), [1e-5, 1e-6])
    assert math.isfinite(value) and value < -1000


@pytest.fixture(scope="module")
def answered(spark):
    return {r["doc_id"]: r for r in op3_language(spark, SF).collect()}


def test_held_out_accuracy(spark, answered):
    from treeloom.llm.queries import ready

    ready(spark)
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(answered) == set(truth)
    for key, row in answered.items():
        assert row["held_out"] == (zlib.crc32(str(key).encode()) % 4 == 2) and 0 <= row["score"] <= 1
    held = [k for k, r in answered.items() if r["held_out"] and truth[k]]
    assert sum(answered[k]["lang_pred"] == truth[k] for k in held) >= 0.95 * len(held)


def test_odd_texts(spark):
    train = [(k, text, lang) for k in range(20) for text, lang in ((f"the thing and the other {k}", "en"), (f"der die das und nicht {k}", "de"))]
    odd = [(900, None, "en"), (901, "", "en"), (902, "12 34 .,;", "en"), (903, "the other thing", None), (903, "und das", "xx"), (None, "the and", "en"), (904, "漢字", None), (905, "the " * 20_000, None)]
    rows = [(k * 100 + (lang == "de"), t, lang) for k, t, lang in train] + odd
    frame = spark.createDataFrame([(*r, 1.5, "x") for r in rows], "doc_id long, text string, lang string, score double, held_out string")
    frame = frame.where("lang is null or lang <> 'xx' or doc_id = 903")
    got = op.identify(frame, tokenizer_path("piece_bpe_32k.model"))
    assert set(got.columns) == {"doc_id", "text", "lang", "score", "held_out", "lang_pred"}
    by = {(r["doc_id"], r["text"]): r for r in got.collect()}
    for key in ((900, None), (901, ""), (902, "12 34 .,;")):
        assert by[key]["lang_pred"] == "und" and by[key]["score"] == 0
    assert by[903, "the other thing"]["lang_pred"] == "en" and by[905, "the " * 20_000]["lang_pred"] == "en"
    assert by[None, "the and"]["held_out"] is False
    none = op.identify(frame.where("false"), tokenizer_path("piece_bpe_32k.model"))
    assert none.collect() == []
    unlabelled = op.identify(frame.withColumn("lang", F.lit(None).cast("string")), tokenizer_path("piece_bpe_32k.model"))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
