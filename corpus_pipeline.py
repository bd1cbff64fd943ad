"""The pipeline over documents: quality rules, near-dedup, secrets, the mix, and packing.

Each stage takes any documents: extra columns go along, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import dartminhash, mixing, packing, quality, secrets
from quarry.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep. Null and empty texts have no words and go; repeated rows are judged alike; other columns, null or not, don't matter."""
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the least id, null last; of repeated rows one, always the same. Texts without words are no copies of one another and stay."""
    return dartminhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated ones included; secrets in their texts are replaced by a mark, and n_chars follows. Null texts stay null."""
    return secrets.clean(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of training, each as often as the mix takes it. A null source is one of its own; null ids are as good as others; texts without words are never taken; repeated rows are taken each."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens with their places in sequences. A null text is the end's token alone; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("source_mix", source_mix), ("best_fit_packing", best_fit_packing)]

#: The tokenizer and the signatures are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
