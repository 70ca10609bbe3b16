import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from test_line_dedup import brute as dropped_lines
from test_ngram_join import brute as classes
from test_packing import check, ids_of
from treeloom.llm import decontaminate, packing
from treeloom.llm.common import words_of
from treeloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def holds_item(items, text):
    words = words_of(text)
    for item in items:
        item = words_of(item)
        if len(item) and len(words) and decontaminate.alignment(item, words)[0] >= 0.5 * decontaminate.MATCH * len(item) - 1e-9:
            return True
    return False


def test_stages_equal_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90_001, None, "en", "s", None), (90_002, "12 .. 34", None, "s", 8), (90_003, "", "de", None, 0)], docs.schema)
    docs, columns, seen = docs.union(odd), docs.columns, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert number == 4 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        seen.append(docs)
    start = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    known = seen[0].collect()
    assert {r["doc_id"] for r in known} == start

    gone = dropped_lines([tuple(r) for r in seen[0].select("doc_id", F.xxhash64("text"), "text").collect()])
    hashed = {r["doc_id"]: r["h"] for r in seen[0].select("doc_id", F.xxhash64("text").alias("h")).collect()}
    want = {
        r["doc_id"]: "\n".join(line for n, line in enumerate(r["text"].split("\n")) if n not in gone.get((r["doc_id"], hashed[r["doc_id"]]), []))
        for r in known
    }
    lines = {r["doc_id"]: r["text"] for r in seen[1].collect()}
    assert lines == want
    assert all(r["n_chars"] == len(r["text"]) for r in seen[1].collect())

    kept = {key for key, first, _ in classes(sorted(lines.items())) if key == first}
    assert {r["doc_id"] for r in seen[2].collect()} == kept

    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {key: lines[key] for key in kept if not holds_item(items, lines[key])}
    assert {r["doc_id"]: r["text"] for r in seen[3].collect()} == clean

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    check(seen[4].collect(), ids_of(tokenizer, sorted(clean.items())), packing.Limits())


def test_run_equals_the_stages_and_registers(spark):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and [k for k in entry.queries() if k.startswith("op")] and len(corpus_pipeline.STAGES) == 5
    pieces = entry.queries()["pipeline"](spark, SF)
    assert pieces.where("start = 0").count() == pieces.select("doc_id").distinct().count() > 100

