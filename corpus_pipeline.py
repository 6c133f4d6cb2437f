"""The corpus pipeline: documents in, packed training sequences out.

Each stage's result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, whatever further columns there are.

A null or empty text fails the quality rules' base and goes.  A null id is a document
like any other, and of a group of copies one with an id stays.  Ties of a group go to the
least id, then to the least hash of the row; equal rows are copies, one of them stays;
rows that repeat an id with other texts are documents of their own.  A null source
mixes as the source ''.  Texts are read whole at any length.  An empty table gives no
sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausemill.llm.op1_mixing import in_mixed_order
from clausemill.llm.op2_minhash import without_near_duplicates
from clausemill.llm.op8_pii import without_pii
from clausemill.llm.op9_quality import only_good
from clausemill.llm.op10_packing import best_fit_packed
from clausemill.llm.scratch import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is too low go."""
    return only_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity of 0.8 or more) one document stays."""
    return without_near_duplicates(docs, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind."""
    return without_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the sources' target weights."""
    return in_mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' tokens, in sequences of fixed length numbered by the mixed order.

    The order depends on the rows alone, not on their files, so it is found here again
    as the mixing stage has it.
    """
    return best_fit_packed(in_mixed_order(docs, position_col="position"), position_col="position")


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: EM verdicts and signatures are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
