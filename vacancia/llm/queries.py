"""The registered queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.llm import decontaminate, licenses, line_dedup, near_dups, packing, pii, quality, secrets, storage, token_files, toxicity, urls, vector_codes, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents"), storage.shared_dir(spark, "secret-ledger")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.groups(_table(spark, sf_dir, "documents"))


def op6_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.shared_dir(spark, "token-blocks")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path)
    read = token_files.read_tokens(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(_table(spark, sf_dir, "documents")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.digest(urls.judge(_table(spark, sf_dir, "pages")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_table(spark, sf_dir, "documents")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(*vector_codes.compress(_table(spark, sf_dir, "embeddings"), carry=("vec_id", "label")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(*whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.digest(toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": secrets.digest_sql(), "op2_decontamination": decontaminate.digest_sql(), "op3_line_dedup": line_dedup.digest_sql(), "op5_near_duplicates": near_dups.digest_sql(), "op8_license_scan": licenses.digest_sql(), "op9_url_filter": urls.digest_sql(),
        "op11_vector_codes": vector_codes.digest_sql(),
    }
