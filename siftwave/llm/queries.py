"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom, chosenpath, lines, packing, pstable, quality, sitetree, spelling, substrings, suffixes, toxicity, warc, whitening
from .oracle import ORACLE  # noqa: F401
from .tables import NO_ID

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    judged = substrings.judge_repeats(table(spark, d, "documents"))
    return judged.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    judged = suffixes.judge_contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return judged.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


@query
def op4_packing(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack(table(spark, d, "documents"), tokenizer_file())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    judged = toxicity.judge_toxicity(docs, docs, table(spark, d, "labels"))
    return judged.select("row.doc_id", "held_out", "score", "predicted")


@query
def op3_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    judged = lines.judge_lines(docs, lines.new_state(docs))
    return judged.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query
def op6_url_filter(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    return bloom.judge_urls(table(spark, d, "pages"), rules).select("row.page_id", "host", "path", "rule", "verdict")


@query
def op9_warc(spark: SparkSession, d: str) -> DataFrame:
    archive = warc.write_archive(table(spark, d, "pages"))
    records = warc.read_records(archive)
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op1_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    judged = pstable.near_vectors(table(spark, d, "embeddings"), columns=["vec_id"])
    component = F.when(F.col("component") != NO_ID, F.col("component"))
    return judged.select("row.vec_id", "n_links", component.alias("component_id"), F.col("first").alias("kept"))


@query
def op10_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    judged = chosenpath.judge_near(table(spark, d, "documents"), columns=["doc_id"])
    component = F.when(F.col("component") != NO_ID, F.col("component"))
    return judged.select("row.doc_id", "n_links", component.alias("component_id"), F.col("first").alias("kept"))


@query
def op8_quality(spark: SparkSession, d: str) -> DataFrame:
    """A document's source stands for its host, source and language for its path."""
    docs = table(spark, d, "documents")
    judged = quality.judge_quality(docs, table(spark, d, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))
    doc_id = F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id")
    kept = (F.col("predicted") == 1).alias("kept")
    return judged.select(doc_id, "held_out", "host", "path", "evidence", "host_mean", "path_mean", "score", "predicted", kept)


@query
def op13_embedding_whitening(spark: SparkSession, d: str) -> DataFrame:
    rows = whitening.by_component(whitening.whiten(table(spark, d, "embeddings")))
    return rows.select("row.vec_id", "component", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened", "explained", "identity_error")


TYPO_RULE = 199  # one in so many words of a document loses a letter


@query
def op12_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    words = spelling.count_words(table(spark, d, "documents"), drop_one_in=TYPO_RULE)
    return spelling.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op11_html_main_text(spark: SparkSession, d: str) -> DataFrame:
    judged = sitetree.extract_main(table(spark, d, "pages")).withColumn("text", F.array_join("blocks", " "))
    return judged.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
