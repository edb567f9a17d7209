"""Value frequencies: one (column, value, n) row per distinct non-null value, the base of modes, shares and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.kinds import FLOAT, INTEGER, kinds
from tabloom.functions.small import small_frame


def _cell(name: str, kind: str) -> Column:
    """Floats travel as numbers and the rest as text, so no float is ever formatted."""
    col = F.col(f"`{name}`")
    text = F.lit(None).cast("string") if kind == FLOAT else col.cast("string")
    number = col.cast("double") if kind in (FLOAT, INTEGER) else F.lit(None).cast("double")
    return F.struct(F.lit(name).alias("column"), text.alias("value"), number.alias("number"))


def value_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Counts per distinct value of every given column in one scan; counts combine before the shuffle."""
    by_kind = kinds(df)
    columns = columns or df.columns
    cells = F.array(*[_cell(c, by_kind[c]) for c in columns])
    return (
        df.select(F.explode(cells).alias("cell")).select("cell.*")
        .where(F.col("value").isNotNull() | F.col("number").isNotNull())
        .groupBy("column", "value", "number")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value per column, the smallest one on ties: (column, value, number, n)."""
    if not columns:
        return small_frame(df.sparkSession, [], "column string, value string, number double, n long")
    best = F.min(F.struct((-F.col("n")).alias("m"), "number", "value")).alias("best")
    return value_frequencies(df, columns).groupBy("column").agg(best).select(
        "column", "best.value", "best.number", (-F.col("best.m")).alias("n"))


def frequent_values(df: DataFrame, columns: list[str], min_share: float) -> tuple[dict[str, list[str]], set[str]]:
    """Per column the values holding at least ``min_share`` of the non-null rows, and the columns having rarer ones.

    At most ``1 / min_share`` values qualify per column, so the collected list is bounded whatever the data.
    """
    if not columns:
        return {}, set()
    counts = value_frequencies(df, columns)
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))  # one row per column
    shared = counts.join(F.broadcast(totals), "column").withColumn("keep", F.col("n") / F.col("total") >= min_share)
    rows = shared.groupBy("column").agg(
        F.collect_list(F.when(F.col("keep"), F.col("value"))).alias("kept"),
        F.count_if(~F.col("keep")).alias("rare"),
    ).collect()
    return {r["column"]: r["kept"] for r in rows}, {r["column"] for r in rows if r["rare"]}


def class_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of one column with counts: (value string, n)."""
    return (
        df.where(F.col(f"`{column}`").isNotNull())
        .groupBy(F.col(f"`{column}`").cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
