"""From raw documents to packed training sequences: quality rules, near-duplicates, repeated passages, packing.

Every stage takes any table with the columns of documents; further columns go along, whatever they are called, and an empty table gives
an empty one. Each stage says what it does with nulls, empty and equal texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import packing, quality, repeats, simhash
from tabloom.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go.

    Null and empty texts have no words and go. Rows are judged one by one, so repeated rows all stay or all go, and a null id does not
    matter. With fewer than 50 labelled documents, or labels all alike, the base rules alone decide.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id, and of several rows with it the first.

    Null and empty texts have the fingerprint zero and are one group. Rows without an id stay if their group has none with one, the first of
    them only.
    """
    return simhash.keep_one(docs, shingle=3, distance=3)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also stand in a document with a smaller id are cut out; a document of which nothing is left goes.

    Null and empty texts have no passage and stay as they are, a text shorter than a passage too. Repeated rows of one id do not count as
    different documents.
    """
    return repeats.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences. Null and empty texts are an end token, repeated rows are packed each, a null source is a source."""
    return packing.pack(docs, 2048).drop("queue")


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages), ("packing", packed)]

#: Trees, SimHash and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
