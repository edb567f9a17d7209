"""Run ledger and contact intake as append-only tables."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.indexing import with_row_key
from tabloom.session import materialize

ROW = "_arrival"
BATCH = "batch"
#: Columns of the run ledger.
RUNS = "run_id string, strategy string, rows long"

# Starting totals, the visibility threshold and the address pattern.
SEED_ROWS, SEED_DATASETS, VISIBLE_FROM = 18450, 47, 25
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
INTEREST_CHARS, RECENT = 80, 5


def commit(rows: DataFrame, path: str, batch: str) -> None:
    """Append ``rows`` as one batch of the table at ``path``. A batch that is committed again, after a failure or by mistake, takes its
    own place instead of being added twice; no other batch is touched."""
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    rows.withColumn(BATCH, F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def committed(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """All rows of all batches with their ``batch``; none if nothing was ever committed."""
    fields = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*fields.fields, T.StructField(BATCH, T.StringType())])
    try:
        return spark.read.schema(whole).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def append_contacts(contacts: DataFrame, path: str, batch: str, order_by: list[str]) -> DataFrame:
    """Append the new contacts of a batch to the table at ``path``; gives all valid ones with ``already``, as ``new_contacts`` does.

    What the same batch has written before does not count as known, so a repeated batch changes nothing. Batches are appended one
    after the other, not at the same time.
    """
    known = committed(contacts.sparkSession, path, contacts.schema).where((F.col(BATCH) != batch) & F.col("email").isNotNull())
    marked = materialize(new_contacts(contacts, known.select("email").distinct(), order_by))
    commit(marked.where("NOT already").drop("already").select(*contacts.columns), path, batch)
    return marked


def totals(runs: DataFrame, rows: str = "rows") -> DataFrame:
    """Cumulative rows and runs; runs without rows add nothing to the rows."""
    positive = F.when(F.col(rows) > 0, F.col(rows).cast("long"))
    return runs.agg((F.coalesce(F.sum(positive), F.lit(0)) + SEED_ROWS).alias("total_rows"),
                    (F.count(F.lit(1)) + SEED_DATASETS).alias("total_datasets"))


def recent_runs(runs: DataFrame, order_by: str, columns: list[str], n: int = RECENT) -> DataFrame:
    return runs.orderBy(F.desc(order_by)).limit(n).select(order_by, *columns)


def validate_contacts(contacts: DataFrame) -> DataFrame:
    """Clean (email, interest); ``valid`` is false for a given but malformed address, and an empty one becomes null."""
    email = F.lower(F.regexp_replace(F.coalesce("email", F.lit("")), r"^\s+|\s+$", ""))
    interest = F.substring(F.regexp_replace(F.coalesce("interest", F.lit("")), r"^\s+|\s+$", ""), 1, INTEREST_CHARS)
    cleaned = contacts.withColumns({"email": email, "interest": interest})
    return cleaned.withColumns({
        "valid": (F.col("email") == "") | F.col("email").rlike(EMAIL),
        "email": F.when((F.col("email") != "") & F.col("email").rlike(EMAIL), F.col("email"))})


def new_contacts(batch: DataFrame, known: DataFrame, order_by: list[str]) -> DataFrame:
    """Valid rows of a batch with ``already``: true where the address is known or came earlier in the batch. Rows
    without an address are always new. First arrivals are found by a minimum per address, so a much repeated address
    is combined before the shuffle instead of being sorted in one task. ``order_by`` need not be unique: rows that
    arrive together are ordered by their interest, and of fully equal rows one, marked by a stored row key, is the first."""
    valid = with_row_key(validate_contacts(batch).where("valid").drop("valid"), ROW)
    arrival = F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate([*order_by, "interest"])], F.col(ROW))
    first = valid.where("email is not null").groupBy("email").agg(F.min(arrival).alias("first"))
    fresh = first.join(known.select("email"), "email", "left_anti").select(F.col(f"first.{ROW}").alias(ROW), F.lit(True).alias("_new"))
    return valid.join(fresh, ROW, "left").withColumn(
        "already", F.col("email").isNotNull() & F.col("_new").isNull()).drop("_new", ROW)


def summary(contacts: DataFrame) -> DataFrame:
    return contacts.agg(F.count(F.lit(1)).alias("contact_count")).withColumn(
        "visible", F.col("contact_count") >= VISIBLE_FROM)
