"""From raw documents to token files: STAGES, applied in order by run().

Each stage takes (spark, docs, sf_dir), works on all that the one before has kept, and returns a
DataFrame; all but the last return the columns of documents. Each result is written to the shared
folder and read again, so a lost executor costs no more than its stage.

Null and empty texts pass every filter; an empty table makes an empty result; rows are judged by their
own texts, so ids may repeat or be missing; the defined results of each stage's operator hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fiscora.llm.common import read, written
from fiscora.llm.op1_token_planes import op1_token_planes
from fiscora.llm.op2_decontaminate import uncontaminated
from fiscora.llm.op5_near_dedup import first_of_groups
from fiscora.llm.op8_toxicity import clean_documents
from fiscora.llm.op10_mixture import Target, mix_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return clean_documents(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) one row, that of the smallest doc_id, stays."""
    return first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark text go."""
    return uncontaminated(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: every document once at least, no source more than twice."""
    return mix_documents(docs, Target(entropy=0.98, repetition=2.0))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in byte planes, read back: a row for each document."""
    return op1_token_planes(spark, docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixture", mixture), ("tokens", tokens)]

#: Tokenisation, MinHash and the toxicity model have no SQL form: tests compare with the rows expected
#: of a small corpus, stage by stage in tests/llm/test_rows.py and whole in test_operators.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
