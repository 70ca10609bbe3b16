import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import packing as op
from treeloom.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encoder_gives_the_tokenizers_ids(tokenizer, corpus):
    encoder = op.Encoder(PATH)
    every = "".join(chr(c) for c in range(1, 0x250))
    texts = [t for _, t in corpus if t] + ["it's I'LL 12 3.5 a_b ²½ x<|endoftext|>y", every, " ".join(every), "été \x1c\x1d \x85\xa0n", "a\ud800b".encode("utf-8", "replace").decode()]
    for text in texts + texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check(pieces, want, limits):
    cover, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        cover[p["doc_id"], p["doc_tokens"]].append(p)
        sequences[p["sequence_id"]].append(p)
    assert sorted((k, len(v)) for k, v in want) == sorted((k, n) for (k, n), v in cover.items() for _ in range(sum(p["start"] == 0 for p in v)))
    by_size = {(k, len(v)): v for k, v in want}
    for key, parts in cover.items():
        ids = by_size[key]
        for p in parts:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
        copies = sum(p["start"] == 0 for p in parts)
        assert sum(p["length"] for p in parts) == copies * len(ids)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= limits.tokens and len(parts) <= limits.segments
    return sequences


def ids_of(tokenizer, rows):
    return [(k, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for k, t in rows]


@pytest.mark.parametrize("limits", [op.Limits(), op.Limits(64, 3, 64), op.Limits(100, 5, 40)])
def test_every_token_in_one_piece(docs_of, corpus, tokenizer, limits):
    rows = [r for n, r in enumerate(corpus) if r[0] is not None and n not in (15, 17)]
    pieces = op.pack(docs_of(rows).coalesce(1), PATH, limits=limits).collect()
    sequences = check(pieces, ids_of(tokenizer, rows), limits)
    if limits == op.Limits():
        lengths = [sum(p["length"] for p in s) for s in sequences.values()]
        assert all(n & (n - 1) == 0 for n in lengths)  # no padding at all


def test_null_and_repeated_ids_are_packed(docs_of, corpus):
    assert op.pack(docs_of(corpus), PATH).where("start = 0").count() == len(corpus)
    assert op.pack(docs_of([]), PATH).count() == 0


def test_limit_on_loss_bearing_tokens(spark, prose):
    rows = [(k, prose(5 + 7 * k % 60, k), prose(3 + k % 40, 500 + k)) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, prompt string, text string").coalesce(1)
    limits = op.Limits(256, 8, 100)
    encoder = op.Encoder(PATH)
    prompt = {k: len(encoder.encode(p)) // 4 for k, p, _ in rows}
    loss = defaultdict(int)
    for p in op.pack(frame, PATH, prompt_col="prompt", limits=limits).collect():
        loss[p["sequence_id"]] += max(0, p["start"] + p["length"] - max(p["start"], prompt[p["doc_id"]]))
    assert max(loss.values()) <= 100


def test_one_partition_packs_closely(spark, prose):
    frame = spark.createDataFrame([(k, prose(20 + k * 37 % 700, k)) for k in range(300)], "doc_id long, text string").coalesce(1)
    lengths = [r["n"] for r in op.pack(frame, PATH).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(n < 4096 for n in lengths) <= 12 and sum(4096 - n for n in lengths if n & (n - 1)) == 0
