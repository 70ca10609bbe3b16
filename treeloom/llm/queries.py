"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import chunks, collocations, decontaminate, language, line_dedup, neighbours, ngram_join, packing, secrets, spelling, toxicity, url_filter, warc
from treeloom.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ready(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes: long texts must not add up in a Python worker."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, folder, "documents"))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs, tokenizer_path("piece_bpe_32k.model"), keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_pages(table(spark, folder, "pages")).drop("url")


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    rules = url_filter.rules(spark, block=[("net", "/"), ("example.com", "/de/")], allow=[("example.net", "/en/"), ("org", "/fr/")])
    return url_filter.judge(pages, rules, url_filter.links_in_pages(pages))


def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.whole_passages(table(spark, folder, "documents"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What to drop of every document; the pipeline's stage writes the texts."""
    return line_dedup.line_dedup(table(spark, folder, "documents")).select("doc_id", "lines", "dropped")


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


CATALOGUE: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_ngram_join": op2_ngram_join,
    "op3_language": op3_language,
    "op4_warc": op4_warc,
    "op5_url_filter": op5_url_filter,
    "op6_neighbours": op6_neighbours,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_packing": op8_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_collocations": op11_collocations,
    "op12_toxicity": op12_toxicity,
    "op13_spelling": op13_spelling,
}
ORACLE: dict[str, str] = {"op11_collocations": collocations.SQL}


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    return CATALOGUE[name](spark, folder)
