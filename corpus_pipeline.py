"""A training corpus from raw documents: quality rules, line de-duplication, near-duplicates, decontamination, packing.

Each stage takes all that the one before kept and returns the columns of documents (the last: pieces of sequences). Other
columns of the input, whatever their names, aren't carried along. Nulls and odd rows:

* quality rules: a null or empty text has no words and goes; rows with a null or repeated doc_id are judged by their texts;
* line dedup: rows with a null doc_id stay as they are; rows that repeat a doc_id count as one document;
* near-duplicates: rows with a null doc_id stay; where one row of a doc_id goes, all its rows go;
* decontamination: a text without words stays; rows are judged one by one;
* packing: a null text is one end id; every row is packed.

An empty table gives an empty table in every stage. Without labels no rules are learned and only the base limits reject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.llm import decontaminate, line_dedup, near_dups, packing, quality, storage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Hundredths of their shingles that near-duplicates have in common.
SIMILARITY = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and the learned rules."""
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs.select(*COLUMNS), rules).where("kept").select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that three or more documents share; n_chars follows."""
    kept = line_dedup.dedup(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    gone = near_dups.groups(docs, SIMILARITY).where("not kept").select("doc_id").distinct().hint("merge")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    scanned = decontaminate.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS[1:])
    return scanned.where("n_hit = 0").select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 ids, with the ids' checksum."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", sequence_packing),
]

#: The learned rules and the column generation can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = storage.written(docs, "corpus")
    return docs
