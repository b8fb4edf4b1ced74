"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's documents.

All stages but the last keep every column, whatever its name; an empty table passes all of them and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import decontaminate, linededup, mixing, simhash, toxicity
from auditlake.llm.common import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the toxicity model rejects go.

    Null and empty texts stay; repeated rows go or stay together. Without labels of both kinds nothing goes.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: lines that repeat an earlier line, or nearly so, are cut; every document stays, n_chars follows.

    Earlier: by doc_id, then by line. Null texts stay null, lines without a word stay; rows of one id and text lose the
    same lines; rows without an id count by their text.
    """
    return linededup.without_repeated_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near duplicates the document with the smallest doc_id stays.

    Texts without a word, null or not, are one group. Repeated rows count as one; different texts of one id are told
    apart; a row without an id stays only where its group has none with one.
    """
    return simhash.keep_first_of_groups(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark window go.

    Null and empty texts hold none; benchmark rows without an id, a text or a word match nothing.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: how many words of each document the mix takes.

    One row for each row of docs; null and empty texts have size 0; a null source is one of its own, the last.
    """
    return mixing.mixture(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The toxicity model can't be expressed in SQL; a test compares all rows with plain loops over the documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
