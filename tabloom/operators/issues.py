"""Data-quality issues as predicates over the typed profile frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.small import small_frame
from tabloom.operators.profile import CATEGORICAL_HIGH, CONTINUOUS, DISCRETE, ID_COLUMN, share

# Names whose zeros are expected, and the limits of the issue rules (percent).
ZERO_IS_NORMAL = ("outcome", "target", "label", "class", "count", "quantity", "flag")
MISSING_HIGH, ZERO_MIN, ZERO_HIGH = 20.0, 10.0, 30.0

# Fix names.
FILL, ZEROS, CAP, DROP = "fill_missing", "fix_zeros", "cap_outliers", "drop_column"

EXPLANATIONS = [
    (FILL, "has empty cells", "a model fitted on gaps learns incomplete patterns",
     "empty cells get the column's median, or its most frequent value if it is not numeric"),
    (ZEROS, "holds more zeros than a measured quantity usually does", "zeros that stand for missing data get imitated",
     "zeros get the median of the non-zero values"),
    (CAP, "has values far from the bulk of the data", "a few extremes stretch the learned range",
     "values beyond the quartiles by more than 1.5 interquartile ranges are set to that limit"),
    (DROP, "is empty, constant, an identifier or nearly unique", "there is no repeating pattern to learn from it",
     "the column is removed"),
]

COLUMNS = ("column", "ordinal", "rule", "issue", "fix_type", "recommendation", "severity")


def _rows(typed: DataFrame, rule: int, when: Column, issue: Column, fix: str, advice: Column, severity: Column) -> DataFrame:
    return typed.where(when).select(
        "column", "ordinal", F.lit(rule).alias("rule"), issue.alias("issue"), F.lit(fix).alias("fix_type"),
        advice.alias("recommendation"), severity.alias("severity"))


def _high_if(condition: Column) -> Column:
    return F.when(condition, "high").otherwise("medium")


def missing_values(typed: DataFrame) -> DataFrame:
    numeric = F.col("col_type").isin(CONTINUOUS, DISCRETE)
    return _rows(
        typed, 1, (F.col("num_missing") > 0) & (F.col("num_missing") < F.col("n_rows")),
        F.format_string("%d gaps, %.1f%% of all cells", "num_missing", share("num_missing")), FILL,
        F.when(numeric, "Put the median into the gaps").otherwise("Put the commonest value into the gaps"),
        _high_if(share("num_missing") > MISSING_HIGH))


def empty_columns(typed: DataFrame) -> DataFrame:
    return _rows(typed, 2, (F.col("num_missing") > 0) & (F.col("num_missing") == F.col("n_rows")),
                 F.lit("Column holds no values"), DROP, F.lit("Drop this column"), F.lit("high"))


def zero_inflation(typed: DataFrame) -> DataFrame:
    pct = F.col("num_zeros") / F.col("n_rows") * 100
    return _rows(
        typed, 3,
        (F.col("col_type") == CONTINUOUS) & ~F.lower("column").isin(*ZERO_IS_NORMAL) & (pct > ZERO_MIN),
        F.format_string("zero in %d rows, %.1f%% of all", "num_zeros", F.round(pct, 1)), ZEROS,
        F.concat(F.lit("Put the median of the other values in place of zeros: "),
                 F.coalesce(F.format_string("%.2f", F.round("nonzero_median", 2)), F.lit("of the column"))),
        _high_if(pct > ZERO_HIGH))


def iqr_outliers(typed: DataFrame) -> DataFrame:
    return _rows(
        typed, 4, F.col("col_type").isin(CONTINUOUS, DISCRETE) & (F.col("num_iqr_outliers") > 0),
        F.format_string("%d outliers outside the typical range", "num_iqr_outliers"), CAP,
        F.lit("Cap values at the interquartile fences"), F.lit("medium"))


def constant_columns(typed: DataFrame) -> DataFrame:
    return _rows(typed, 5, F.col("num_unique") == 1, F.lit("Column has a single value"), DROP,
                 F.lit("Drop this column"), F.lit("high"))


def high_cardinality(typed: DataFrame) -> DataFrame:
    return _rows(
        typed, 6, F.col("col_type") == CATEGORICAL_HIGH,
        F.format_string("%d different values, %.1f%% of the row count", "num_unique", share("num_unique")), DROP,
        F.lit("Drop this column"), F.lit("high"))


def id_columns(typed: DataFrame) -> DataFrame:
    return _rows(typed, 7, F.col("col_type") == ID_COLUMN, F.lit("Column looks like a row identifier"), DROP,
                 F.lit("Drop this column"), F.lit("high"))


RULES = (missing_values, empty_columns, zero_inflation, iqr_outliers, constant_columns, high_cardinality, id_columns)


def issue_report(typed: DataFrame) -> DataFrame:
    """Every issue of every column; order by (ordinal, rule) to list them in table order."""
    report = None
    for rule in RULES:
        found = rule(typed)
        report = found if report is None else report.unionByName(found)
    return report


def columns_to_drop(report: DataFrame) -> DataFrame:
    return report.where(F.col("fix_type") == DROP).select("column").distinct()


def explained(report: DataFrame) -> DataFrame:
    """Issues with a short what / impact / action text per fix."""
    texts = small_frame(
        report.sparkSession, EXPLANATIONS, "fix_type string, what string, impact string, action string")
    return report.join(F.broadcast(texts), "fix_type").withColumn("what", F.concat_ws(" ", "column", "what"))
