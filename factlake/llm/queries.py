"""Queries of the llm operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import chat, importance, licenses, mixing, periodic_runs, quality_rules, secrets, toxicity, urls
from factlake.llm.embedding_dedup import LINKS_SQL, embedding_links
from factlake.llm.near_dedup import NEAR_SQL, near_duplicates
from factlake.llm.sentencepiece_sampling import sample_encode
from factlake.llm.substring_dedup import SPANS_SQL, remove_repeated_spans
from factlake.storage import written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document."""
    return sample_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), MODEL, k=2)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base metrics, and the verdict of a decision list learned from ``labels.quality``."""
    stats = written(quality_rules.text_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")), "statistics")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality_rules.learn_rules(stats, labels, "doc_id", "quality", quality_rules.Settings())
    return quality_rules.apply_rules(stats, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the dated list, at a fetch time made from its id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.select("page_id", "url", urls.fetch_time(F.col("page_id")).alias("fetched"))
    out = urls.filter_captures(captures, urls.dated_list(spark), "url", "fetched")
    return out.select("page_id", "url", "fetched", "host", "entry", "action", "blocked")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), licenses.known_texts(spark))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.digests(chat.format_paths(chat.best_paths(chat.linear_tree(messages))))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pieces = mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixing.mixed_words(documents, pieces).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out())
    model = toxicity.fit(documents, labels, "doc_id", "text", "toxic", toxicity.Settings())
    return toxicity.score(documents, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = importance.resample(documents, benchmark)
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = periodic_runs.plant_periods(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return periodic_runs.digests(periodic_runs.find_runs(planted, "id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece_sampling,
        op2_quality_rules,
        op3_url_filters,
        op4_minhash_near_dedup,
        op5_embedding_near_dedup,
        op6_substring_dedup,
        op7_license_scan,
        op8_chat_formatting,
        op9_mixing,
        op10_toxicity,
        op11_secret_scan,
        op12_importance_resampling,
        op13_periodic_runs,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filters": urls.FILTER_SQL,
    "op4_minhash_near_dedup": NEAR_SQL,
    "op5_embedding_near_dedup": LINKS_SQL,
    "op6_substring_dedup": SPANS_SQL,
    "op7_license_scan": licenses.SCAN_SQL,
    "op8_chat_formatting": chat.DIGEST_SQL,
    "op9_mixing": mixing.MIX_SQL,
    "op12_importance_resampling": importance.RESAMPLE_SQL,
    "op13_periodic_runs": periodic_runs.RUNS_SQL,
}
