"""The numbered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import (
    alignment,
    bpe_automaton,
    decontaminate,
    fill_middle,
    language_id,
    license_scan,
    packing,
    quality,
    secret_scan,
    simhash,
    substring_dedup,
    token_files,
    url_filter,
)


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"),
        F.size("licenses").cast("long").alias("n_licenses"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents")).drop("host_rejected")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.findings(_table(spark, sf_dir, "documents")).drop("text_key")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary_file())


#: Explicit rules of the URL filter, fixed.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


#: The number in the path of a page's address is the id of its document.
PAGE_DOCUMENT = r"://[^/]*/[^/?#]*/(\d+)"


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of documents with a label."""
    pages = _table(spark, sf_dir, "pages").select("url", F.regexp_extract("url", PAGE_DOCUMENT, 1).try_cast("long").alias("doc_id"))
    bad = _table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return pages.join(bad, "doc_id").select("url", "bad")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), labelled_urls(spark, sf_dir), URL_RULES)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), vocabulary_file())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages of documents say of their language, one row per page."""
    url = F.col("url")
    pages = _table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", PAGE_DOCUMENT, 1).try_cast("long").alias("doc_id"), url_filter.host_of(url).alias("host"),
        url_filter.path_of(url).alias("path"), language_id.markup_language(F.col("html")).alias("markup"),
    )
    return pages.where("doc_id is not null").withColumn("domain", F.regexp_extract("host", r"[^.]+\.[^.]+$", 0))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"), page_evidence(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicated(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_file("word_bpe_49k.json")
    found = bpe_automaton.decode(bpe_automaton.encode(_table(spark, sf_dir, "documents"), path), path)
    return found.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(_table(spark, sf_dir, "documents"), vocabulary_file(), vocabulary_file("piece_bpe_32k.model"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_secret_scan": op4_secret_scan,
    "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter,
    "op7_token_files": op7_token_files,
    "op8_simhash": op8_simhash,
    "op9_language_id": op9_language_id,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_bpe_automaton": op11_bpe_automaton,
    "op12_token_alignment": op12_token_alignment,
    "op13_fill_in_middle": op13_fill_in_middle,
}
