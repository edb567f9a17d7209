"""Approved fixes as projections: statistics are gathered first, the change itself is a lazy select."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.kinds import FLOAT, INTEGER, kinds
from tabloom.functions.quantiles import exact_quantiles
from tabloom.operators.frequencies import modes
from tabloom.operators.issues import CAP, DROP, FILL, ZEROS
from tabloom.operators.profile import IQR_FENCE


@dataclass(frozen=True)
class Fix:
    column: str
    fix_type: str
    approved: bool = True


def fixes_from_report(report: DataFrame) -> list[Fix]:
    """Every reported issue as an approved fix, in table order (one row per issue, so a short list)."""
    rows = report.orderBy("ordinal", "rule").select("column", "fix_type").collect()
    return [Fix(r["column"], r["fix_type"]) for r in rows]


def number_like(column: Column, kind: str, *values: float | None) -> tuple[Column, list[Column]]:
    """Literals to mix into a numeric column: it stays integer when every value is whole, else becomes double."""
    whole = kind == INTEGER and all(v is None or float(v).is_integer() for v in values)
    if whole:
        return column.cast("long"), [F.lit(None if v is None else int(v)).cast("long") for v in values]
    return column.cast("double"), [F.lit(v).cast("double") for v in values]


def fences(q1: float | None, q3: float | None) -> tuple[float, float] | None:
    if q1 is None or q3 is None or not q3 > q1:
        return None
    reach = IQR_FENCE * (q3 - q1)
    return q1 - reach, q3 + reach


def clip(column: Column, low: Column, high: Column) -> Column:
    """Limit to [low, high]; nulls stay null (Spark's greatest and least would skip them)."""
    return F.when(column < low, low).when(column > high, high).otherwise(column)


def apply_fixes(df: DataFrame, fixes: list[Fix]) -> DataFrame:
    """Apply approved fixes in order. Fixes of different columns are independent, so the k-th fixes of all
    columns share one statistics scan; a later fix of a column sees the earlier ones."""
    unknown = [f for f in fixes if f.approved and (f.column not in df.columns or f.fix_type not in (FILL, ZEROS, CAP, DROP))]
    if unknown:
        raise ValueError(f"cannot apply {unknown}")
    queues: dict[str, list[str]] = {}
    for f in fixes:
        if f.approved:
            queues.setdefault(f.column, []).append(f.fix_type)
    dropped = {c for c, q in queues.items() if DROP in q}
    df = df.drop(*dropped)
    queues = {c: q for c, q in queues.items() if c not in dropped}
    for level in range(max(map(len, queues.values()), default=0)):
        df = _apply_level(df, {c: q[level] for c, q in queues.items() if len(q) > level and c in df.columns})
    return df


def _apply_level(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    by_kind = kinds(df)
    numeric = {c for c, k in by_kind.items() if k in (INTEGER, FLOAT)}
    requests: dict[str, tuple[Column, list[float]]] = {}
    for c, fix in wanted.items():
        x = F.col(f"`{c}`")
        if c not in numeric:
            continue
        if fix == CAP:
            requests[c] = (x, [0.25, 0.75])
        else:
            requests[c] = (F.when(x != 0, x) if fix == ZEROS else x, [0.5])
    found = exact_quantiles(df, requests)
    texts = [c for c, fix in wanted.items() if fix == FILL and c not in numeric]
    most = {r["column"]: r["value"] for r in modes(df, texts).collect()} if texts else {}

    changed: dict[str, Column] = {}
    empty = []
    for c, fix in wanted.items():
        x, kind = F.col(f"`{c}`"), by_kind[c]
        if fix == FILL and c in numeric:
            if found[c][0] is None:
                empty.append(c)
                continue
            x, (median,) = number_like(x, kind, found[c][0])
            changed[c] = F.coalesce(x, median)
        elif fix == FILL:
            if c not in most:
                empty.append(c)
                continue
            changed[c] = F.coalesce(x, F.lit(most[c]).cast(df.schema[c].dataType))
        elif fix == ZEROS and c in numeric and found[c][0] is not None:
            x, (median,) = number_like(x, kind, found[c][0])
            changed[c] = F.when(x == 0, median).otherwise(x)
        elif fix == CAP and c in numeric and fences(*found[c]):
            x, (low, high) = number_like(x, kind, *fences(*found[c]))
            changed[c] = clip(x, low, high)
    return df.withColumns(changed).drop(*empty)
