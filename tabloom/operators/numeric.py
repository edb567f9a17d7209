"""Facts about numeric columns, shared by cleaning, type repair and scoring."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.kinds import INTEGER, kinds, numeric_columns

SCAN_WIDTH = 6


@dataclass(frozen=True)
class Facts:
    """One numeric column: counts, moments, extremes; ``between`` counts values strictly inside (low, high)."""

    n: int
    missing: int
    mean: float | None
    std: float | None
    low: float | None
    high: float | None
    skew: float | None
    whole: bool
    integer: bool
    between: int

    @property
    def binary(self) -> bool:
        return self.n > 0 and self.low != self.high and self.between == 0

    @property
    def constant(self) -> bool:
        return self.n > 0 and self.low == self.high


def numeric_facts(df: DataFrame, columns: list[str] | None = None) -> dict[str, Facts]:
    """Moments and extremes a few columns at a time (see ``profile.SCAN_WIDTH``), then values strictly between them."""
    columns = numeric_columns(df) if columns is None else columns
    if not columns:
        return {}
    by_kind = kinds(df)
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    finite = {c: F.when(~F.isnan(x[c]) & (F.abs(x[c]) != F.lit(float("inf"))), x[c]) for c in columns}
    row: dict = {}
    for start in range(0, len(columns), SCAN_WIDTH):
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, c in list(enumerate(columns))[start:start + SCAN_WIDTH]:
            v = finite[c]
            aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"),
                     F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.skewness(v).alias(f"k{i}"),
                     F.bool_and(v == F.floor(v)).alias(f"w{i}")]
        row.update(df.agg(*aggs).first().asDict())
    inner = df.agg(*[
        F.count_if((finite[c] > F.lit(row[f"lo{i}"])) & (finite[c] < F.lit(row[f"hi{i}"]))).alias(f"b{i}")
        for i, c in enumerate(columns)
    ]).first()
    facts = {}
    for i, c in enumerate(columns):
        n, skew = row[f"n{i}"], row[f"k{i}"]
        if skew is not None:
            skew = skew * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 else None
        facts[c] = Facts(n, row["rows"] - n, row[f"m{i}"], row[f"s{i}"], row[f"lo{i}"], row[f"hi{i}"], skew,
                         bool(row[f"w{i}"]), by_kind[c] == INTEGER, inner[f"b{i}"])
    return facts
