"""From raw documents to packed token files, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's docs. The first three drop documents, the fourth puts them in the order of the mix,
the last writes them as token ids in that order and returns a row per document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from webledger.llm import decontam, mixing, neardup, quality, tokens
from webledger.llm.common import table
from webledger.llm.queries import tokenizer_file
from webledger.scale import work_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, documents in the order in which the stage before wrote them."""
    return tokens.read_tokens(tokens.write_tokens(docs, tokenizer_file(), end_id=2, order=tokens.file_order(docs)))


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_dedup),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mixing),
    ("token files", token_files),
]

# Trees and token files are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{work_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
