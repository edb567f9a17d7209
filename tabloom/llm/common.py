"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import shared_folder

#: The white space that separates words: space and the control characters from tab to carriage return.
BLANKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder that all executors share and read it from there.

    This cuts the lineage, and ids that depend on the order of rows stay as they were written when an executor is lost.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_column: str, text_column: str, *others: str | Column) -> DataFrame:
    """Only the columns that an operator reads, under its own names; any further column may be called as it likes."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"),
                       *(F.col(c) if isinstance(c, str) else c for c in others))


def numbered_rows(docs: DataFrame, name: str, *columns) -> DataFrame:
    """A stored table of ``columns`` with a row number ``row`` that is unique and, once stored, final."""
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), *columns), name)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]
