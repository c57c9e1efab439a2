"""A training corpus from raw documents: toxic texts go, then copies, then near copies; personal data is replaced; what stays is packed.

A stage is a function of (spark, docs, sf_dir). Each works on all that the stage before kept; all but the last return the columns of
documents. run() writes every stage's result to the shared folder and reads it again as the next one's input.

Odd rows: null ids and texts pass through every stage (a null text is an empty one for both kinds of copies, so one of them stays);
texts of any length are read whole; of copies and near copies the smallest id stays, of rows that repeat it one; an empty table gives
an empty result; extra columns stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebar.llm.common import cut, table
from tidebar.llm.exact_dedup import drop_copies
from tidebar.llm.near_dedup import drop_near_copies
from tidebar.llm.packing import pack
from tidebar.llm.pii import replace_personal_data
from tidebar.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return replace_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: Classifier chains, near duplicates and packing are not to be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
