"""Automatic cleaning: drop what cannot be modelled, expand dates, fill gaps, group rare categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.kinds import FLOAT, INTEGER, TEMPORAL, kinds
from tabloom.functions.quantiles import exact_quantiles
from tabloom.operators.fixes import number_like
from tabloom.operators.frequencies import frequent_values, modes
from tabloom.operators.profile import (CATEGORICAL_HIGH, CATEGORICAL_LOW, CONTINUOUS, DATETIME, DISCRETE, ID_COLUMN,
                                       TableProfile, parse_time)
from tabloom.session import working_copy

# Categories below this share of the rows are merged under one name.
RARE_SHARE, OTHER = 0.01, "Other"


def drop_identifiers(df: DataFrame, profile: TableProfile) -> DataFrame:
    return df.drop(*[c for c, t in profile.types.items() if t in (ID_COLUMN, CATEGORICAL_HIGH)])


def drop_empty(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or df.columns
    if not columns:
        return df
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return df.drop(*[c for i, c in enumerate(columns) if row[f"n{i}"] == 0])


def drop_constant(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop columns with exactly one distinct value: smallest and largest are equal."""
    columns = columns or df.columns
    if not columns:
        return df
    row = df.agg(*[(F.min(F.col(f"`{c}`")) == F.max(F.col(f"`{c}`"))).alias(f"k{i}")
                   for i, c in enumerate(columns)]).first()
    return df.drop(*[c for i, c in enumerate(columns) if row[f"k{i}"]])


def date_parts(moment: Column, name: str) -> list[Column]:
    """Year, month, day and weekday (Monday is 0)."""
    return [F.year(moment).alias(f"{name}_year"), F.month(moment).alias(f"{name}_month"),
            F.dayofmonth(moment).alias(f"{name}_day"), F.weekday(moment).alias(f"{name}_dayofweek")]


def expand_datetimes(df: DataFrame, profile: TableProfile) -> DataFrame:
    """Replace date columns by their parts (appended at the end); a date column that cannot be read is dropped."""
    by_kind, parts, gone = kinds(df), [], []
    for row in profile.rows:
        c = row["column"]
        if row["col_type"] != DATETIME or c not in by_kind:
            continue
        gone.append(c)
        if by_kind[c] == TEMPORAL:
            parts += date_parts(F.col(f"`{c}`"), c)
        elif row["date_format"]:
            parts += date_parts(parse_time(c, row["date_format"]), c)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in gone], *parts)


def fill_by_type(df: DataFrame, profile: TableProfile) -> DataFrame:
    """Median for numeric types, most frequent value for the others; only columns with gaps in the profile."""
    by_kind, types = kinds(df), profile.types
    gaps = [r["column"] for r in profile.rows
            if r["num_missing"] > 0 and r["column"] in by_kind and types[r["column"]] != DATETIME]
    by_median = [c for c in gaps if types[c] in (CONTINUOUS, DISCRETE) and by_kind[c] in (INTEGER, FLOAT)]
    medians = exact_quantiles(df, {c: (F.col(f"`{c}`"), [0.5]) for c in by_median})
    by_mode = [c for c in gaps if c not in by_median]
    most = {r["column"]: r for r in modes(df, by_mode).collect()} if by_mode else {}
    changed: dict[str, Column] = {}
    empty = []
    for c in gaps:
        if c in by_median and medians[c][0] is not None:
            x, (fill,) = number_like(F.col(f"`{c}`"), by_kind[c], medians[c][0])
            changed[c] = F.coalesce(x, fill)
        elif c in most:
            value = most[c]["number"] if by_kind[c] in (INTEGER, FLOAT) else most[c]["value"]
            changed[c] = F.coalesce(F.col(f"`{c}`"), F.lit(value).cast(df.schema[c].dataType))
        else:
            empty.append(c)
    return df.withColumns(changed).drop(*empty)


def group_rare(df: DataFrame, columns: list[str], min_share: float = RARE_SHARE) -> DataFrame:
    """Merge categories holding less than ``min_share`` of the rows. The values kept number at most 1 / min_share."""
    kept, with_rare = frequent_values(df, columns, min_share)
    return df.withColumns({
        c: F.when(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").isin(*kept[c]), F.col(f"`{c}`")).otherwise(F.lit(OTHER))
        for c in columns if c in with_rare
    })


def auto_clean(df: DataFrame, profile: TableProfile, target: str | None = None) -> DataFrame:
    """The whole cleaning pass. Rare classes of ``target`` are kept apart, since they are what is to be learned."""
    with working_copy(drop_identifiers(df, profile)) as rows:
        return _clean(rows, profile, target)


def _clean(df: DataFrame, profile: TableProfile, target: str | None) -> DataFrame:
    df = drop_empty(df, [c for c in df.columns if c in profile.types])
    df = fill_by_type(df, profile)
    df = drop_constant(df, [c for c in df.columns if profile.types.get(c, DATETIME) != DATETIME])
    low = [c for c in df.columns if profile.types.get(c) == CATEGORICAL_LOW and c != target]
    df = group_rare(df, [c for c in low if kinds(df)[c] == "string"])
    return expand_datetimes(df, profile)
