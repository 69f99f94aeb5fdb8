"""Registered queries of this subpackage: the test tables mapped to the operators and back."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm import (
    decontaminate,
    divergence,
    embedding_dedup,
    fill_middle,
    html_extract,
    language_id,
    near_dedup,
    packing,
    piece_codec,
    sharding,
    token_output,
    toxicity,
    url_filter,
)
from rankspark.llm.common import crc_remainder
from rankspark.session import scratch_path, spread

HELD_LANGUAGE = (4, 2)
HELD_TOXICITY = (5, 0)
RULES = (
    url_filter.Rule("allow", "org"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def back(df: DataFrame, **names: str) -> DataFrame:
    """Result columns under the names of the tables."""
    return df.withColumnsRenamed(names)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    # the url travels as part of the key, so that no join is needed
    keyed = pages.select(F.struct("page_id", "url").alias("job_id"), "html")
    made = html_extract.extract_job_texts(keyed)
    return made.select("job_id.page_id", "job_id.url", F.col("jd_text").alias("text"), "n_chars")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), RULES)
    return judged.withColumn("purity", F.floor(F.col("purity") * 1e6 + 0.5) / 1e6)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    made = near_dedup.near_duplicates(docs, near_dedup.NearDedupConfig(words=4), candidate_id="doc_id")
    return back(made, candidate_id="doc_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    made = decontaminate.job_passages(docs, items, candidate_id="doc_id", job_id="item_id", jd_text="text")
    return back(made, candidate_id="doc_id", job_id="item_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.fit(docs.where(language_id.learnable(F.col("doc_id"), *HELD_LANGUAGE)), candidate_id="doc_id")
    parts, held = HELD_LANGUAGE
    made = back(language_id.predict(spread(docs.select("doc_id", "text")), model, candidate_id="doc_id"), candidate_id="doc_id")
    is_held = F.coalesce(crc_remainder(F.col("doc_id"), parts) == held, F.lit(False))
    return made.select("doc_id", is_held.alias("held_out"), "lang_pred", "score", "rejected")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return back(sharding.shard_candidates(docs, 40, candidate_id="doc_id"), candidate_id="doc_id")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), candidate_id="vec_id")
    return back(made, candidate_id="vec_id")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    path = scratch_path(spark, "tokens")
    definition = token_output.load_definition(public_tokenizers.path("word_bpe_49k.json"))
    token_output.write_tokens(docs, path, definition, candidate_id="doc_id")
    return back(token_output.read_tokens(spark, path, checksums_only=True), candidate_id="doc_id")


def piece_model() -> bytes:
    return piece_codec.load_model(public_tokenizers.path("piece_bpe_32k.model"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    return back(piece_codec.codec_digests(docs, piece_model(), candidate_id="doc_id"), candidate_id="doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    parts, held = HELD_TOXICITY
    known = table(spark, sf_dir, "labels", "doc_id", "toxic").where(language_id.learnable(F.col("doc_id"), parts, held))
    model = toxicity.fit(docs, known, candidate_id="doc_id")
    made = back(toxicity.score(spread(docs), model, candidate_id="doc_id"), candidate_id="doc_id")
    is_held = F.coalesce(crc_remainder(F.col("doc_id"), parts) == held, F.lit(False))
    return made.select("doc_id", is_held.alias("held_out"), "score", "predicted", "sentences")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "text", "lang", "source")
    made = divergence.company_divergence(spread(docs), current_industry="lang", current_company="source")
    return back(made, current_industry="lang", current_company="source")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    definition = token_output.load_definition(public_tokenizers.path("word_bpe_49k.json"))
    made = packing.pack_candidates(docs, definition, candidate_id="doc_id").withColumn("ids", F.crc32("ids"))
    return back(made, candidate_id="doc_id", ids="ids_crc32", candidate_tokens="doc_tokens")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    made = back(fill_middle.fill_in_middle(docs, candidate_id="doc_id"), candidate_id="doc_id", n_lines="n")
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored("output", "form"), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_url_filter,
        op3_near_dedup,
        op4_decontamination,
        op5_language_id,
        op6_sharding,
        op7_embedding_dedup,
        op8_token_output,
        op9_sentencepiece,
        op10_toxicity,
        op11_source_divergence,
        op12_packing,
        op13_fill_in_middle,
    )
}
