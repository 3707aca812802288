"""The corpus pipeline: quality, exact copies, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``, and any others that the table has, whatever their names.

Cases, in every stage: a null text is an empty one; a null ``doc_id`` is kept like any
other and counts as no id that labels know; an empty table gives no rows. Of repeated
rows, equal or near texts one is left after the third stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import Workspace, table
from tidelog.llm.exact_dedup import keepers, sorted_runs
from tidelog.llm.packing import pack
from tidelog.llm.quality import keep_good
from tidelog.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on the labelled ones; an empty
    or null text has the score of the output's bias, and repeated rows are judged each."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, a null being smaller than any;
    of equal ids one row. Null and empty texts are equal."""
    return keepers(sorted_runs(docs, Workspace(spark, "pipeline-exact")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the row with the smallest doc_id stays, a null being larger than any.
    A text without words has fingerprint zero and is near what else has nearly none set."""
    return one_of_each(docs, Workspace(spark, "pipeline-simhash"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their ids; an empty text is its end id."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup), ("packing", packing)]

#: The classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
