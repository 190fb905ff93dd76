"""A corpus pipeline: each stage reads what the one before it kept, and its decisions take effect.

Toxic documents go, then exact copies, then near copies, then repeated passages; what is left is packed into windows.
All stages but the last return the columns of ``documents``.

Edge cases, through the whole chain: a null or empty text has no words, so it is never toxic; of all such rows one stays and ends as a window piece of one
end id; repeated rows are exact copies, of which one stays; a null id is kept as it is and sorts first; texts of any length go through whole; of equal
copies the smallest id stays; an empty table, or one without labels, gives an empty plan or rejects nothing; extra columns are carried to the last stage, which drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import cut, table
from tidemark.llm.exact_dedup import drop_exact_copies
from tidemark.llm.near_copies import drop_near_copies
from tidemark.llm.packing import pack_documents
from tidemark.llm.queries import tokenizer_file
from tidemark.llm.substring_dedup import drop_repeated_passages
from tidemark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs, keep="smallest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, words=5, least=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(docs, length=20)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=1, capacity=2048)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("substring dedup", repeated_passages),
    ("packing", packing),
]

#: Neither the trained model, nor the shingles' hash, nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
