"""Storage kinds of columns and name tests shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, FLOAT, STRING, BOOLEAN, TEMPORAL, NESTED = "integer", "float", "string", "boolean", "temporal", "nested"


def storage_kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.IntegralType):
        return INTEGER
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return FLOAT
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TEMPORAL
    return NESTED


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: storage_kind(f.dataType) for f in df.schema.fields}


def numeric_columns(df: DataFrame) -> list[str]:
    """Integer and float columns, booleans excluded."""
    return [c for c, k in kinds(df).items() if k in (INTEGER, FLOAT)]


def flat_table(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Keep scalar columns, turn NaN into null and decimals into doubles; nested columns come back with a reason."""
    kept: list[Column] = []
    rejected: dict[str, str] = {}
    for f in df.schema.fields:
        kind, col = storage_kind(f.dataType), F.col(f"`{f.name}`")
        if kind == NESTED:
            rejected[f.name] = f"nested type {f.dataType.simpleString()} has no tabular profile"
        elif kind == FLOAT:
            value = col.cast("double")
            kept.append(F.when(~F.isnan(value), value).alias(f.name))
        else:
            kept.append(col)
    return df.select(*kept), rejected


def name_tokens(name: str) -> list[str]:
    """Words of a column name: split on non-letters and on camelCase humps, lower-cased."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return [t for t in re.split(r"[^a-z]+", spaced.lower()) if t]


def name_matches(name: str, words: tuple[str, ...], mode: str = "token") -> bool:
    """Whether a column name mentions one of ``words``: as a whole token (default) or anywhere (``substring``)."""
    if mode == "substring":
        return any(w in name.lower() for w in words)
    lowered, tokens = name.lower(), set(name_tokens(name))
    plurals = {t[:-1] for t in tokens if len(t) > 3 and t.endswith("s")}
    return any((w in tokens or w in plurals) if w.isalpha() else w in lowered for w in words)
