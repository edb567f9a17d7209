"""Column profile: one row per column, from a few kinds of scans whatever the column count.

First counts, moments, extremes and distinct-count sketches. Then exact counts of values: columns the sketch calls
small share one unpivoted aggregation, which also yields their quantiles; each large one reads only its own column and
gets its quantiles by bracketing. Last, outliers with the limits found before. Only per-column numbers reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.kinds import (BOOLEAN, FLOAT, INTEGER, STRING, TEMPORAL, flat_table, kinds, name_matches)
from tabloom.functions.quantiles import exact_quantiles
from tabloom.functions.small import small_frame
from tabloom.operators.frequencies import value_frequencies
from tabloom.session import working_copy

SMALL_VOCABULARY = 10_000
# Aggregates of about this many columns still compile to methods the JVM optimises; wider ones ran several times slower.
# Each batch reads its own columns only, so a columnar table is read once whatever the width.
SCAN_WIDTH = 3
SHORT_TEXT = 32

# Column types.
CONTINUOUS, DISCRETE = "numerical_continuous", "numerical_discrete"
CATEGORICAL_LOW, CATEGORICAL_HIGH = "categorical_low", "categorical_high"
BOOLEAN_TYPE, DATETIME, ID_COLUMN = "boolean", "datetime", "id_column"

# Limits of the column rules.
ID_SHARE, ID_MIN_ROWS, HIGH_SHARE, DISCRETE_VALUES, SIGMAS, IQR_FENCE, ZERO_SHARE = 0.95, 20, 0.5, 20, 3.0, 1.5, 0.10

# Text pairs read as booleans, and name words hinting at dates.
BOOLEAN_TEXTS = ("yes", "no", "true", "false")
DATE_WORDS = ("date", "time", "timestamp")

# Date and time layouts a text column may use throughout.
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy", "MM/dd/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss", "M/d/yyyy", "dd/MM/yyyy", "d/M/yyyy", "dd-MM-yyyy",
    "dd.MM.yyyy", "dd MMM yyyy", "dd-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy",
)

FRAME_SCHEMA = """ordinal int, column string, storage string, n_rows long, num_missing long, num_zeros long,
    mean double, std double, low double, high double, low_text string, high_text string, num_unique long,
    top_count long, num_outliers long, q1 double, q3 double, num_iqr_outliers long, nonzero_median double,
    date_format string, date_named boolean"""


def _batches(items: list, size: int) -> list[list]:
    return [items[i:i + size] for i in range(0, len(items), size)]


def _first_scan(df: DataFrame, by_kind: dict[str, str]) -> dict[str, dict]:
    """Counts, moments and extremes in compiled aggregates; the distinct-count sketches, which are not compiled, apart."""
    facts: dict[str, dict] = {}
    for batch in _batches(list(by_kind), SCAN_WIDTH):
        wanted: list[Column] = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(batch):
            col, kind = F.col(f"`{c}`"), by_kind[c]
            wanted.append(F.count(col).alias(f"n{i}"))
            if kind in (INTEGER, FLOAT):
                x = col.cast("double")
                wanted += [F.count_if(col == 0).alias(f"z{i}"), F.avg(x).alias(f"m{i}"),
                           F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
            elif kind == STRING:
                wanted += [F.min(col).alias(f"lt{i}"), F.max(col).alias(f"ht{i}")]
        row = df.agg(*wanted).first().asDict()
        for i, c in enumerate(batch):
            facts[c] = {"n_rows": row["rows"], "present": row[f"n{i}"],
                        "num_zeros": row.get(f"z{i}", 0), "mean": row.get(f"m{i}"), "std": row.get(f"s{i}"),
                        "low": row.get(f"lo{i}"), "high": row.get(f"hi{i}"),
                        "low_text": row.get(f"lt{i}"), "high_text": row.get(f"ht{i}")}
    sketches = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(by_kind)]).first()
    for i, c in enumerate(by_kind):
        facts[c]["sketch"] = sketches[f"d{i}"]
    return facts


def _needed_ranks(fact: dict) -> dict[str, tuple[int, float]]:
    """Quantiles the issue rules read: quartiles, and the non-zero median of a zero-inflated column, as
    (how many values, probability)."""
    wanted = {"q1": (fact["present"], 0.25), "q3": (fact["present"], 0.75)}
    if fact["num_zeros"] > fact["n_rows"] * ZERO_SHARE:
        wanted["nonzero_median"] = (fact["present"] - fact["num_zeros"], 0.5)
    return {k: v for k, v in wanted.items() if v[0] > 0}


def _small_columns(df: DataFrame, columns: list[str], facts: dict[str, dict], numeric: list[str]) -> None:
    """Exact distinct counts, top counts and quantiles of columns with few values, all from one frequency table."""
    targets = []
    for c in columns:
        if c in numeric:
            for name, (n, p) in _needed_ranks(facts[c]).items():
                at = p * (n - 1)
                targets.append((c, name, math.floor(at), math.ceil(at), name == "nonzero_median"))
    counts = value_frequencies(df, columns)
    running = Window.partitionBy("column").orderBy("number")
    nonzero = F.when(F.col("number") != 0, F.col("n")).otherwise(0)
    ranked = counts.withColumns({"upto": F.sum("n").over(running), "upto_nonzero": F.sum(nonzero).over(running)})
    aggs = [F.count(F.lit(1)).alias("num_unique"), F.max("n").alias("top_count")]
    for i, (c, _, first, last, skip_zero) in enumerate(targets):
        upto = F.col("upto_nonzero" if skip_zero else "upto")
        usable = (F.col("column") == c) & (F.lit(not skip_zero) | (F.col("number") != 0))
        aggs += [F.min(F.when(usable & (upto > rank), F.col("number"))).alias(f"{end}{i}")
                 for end, rank in (("a", first), ("b", last))]
    for r in ranked.groupBy("column").agg(*aggs).collect():
        fact = facts[r["column"]]
        fact.update(num_unique=r["num_unique"], top_count=r["top_count"])
        for i, (c, name, first, _, _) in enumerate(targets):
            if c == r["column"]:
                n, p = _needed_ranks(fact)[name]
                fact[name] = r[f"a{i}"] + (r[f"b{i}"] - r[f"a{i}"]) * (p * (n - 1) - first)


def _large_columns(df: DataFrame, columns: list[str], facts: dict[str, dict], numeric: list[str]) -> None:
    """Columns with many values: each is counted on its own, reading nothing else; quantiles by bracketing."""
    parts = None
    for c in columns:
        # Long texts are told apart by a digest, so no text is shuffled.
        raw = F.col(f"`{c}`")
        value = raw if df.schema[c].dataType.simpleString() != "string" else F.when(F.length(raw) > SHORT_TEXT, F.concat(F.lit("\0"), F.md5(raw))).otherwise(raw)
        counted = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        one = counted.agg(F.count(F.lit(1)).alias("num_unique"), F.max("n").alias("top_count")).withColumn("column", F.lit(c))
        parts = one if parts is None else parts.unionByName(one)
    for r in parts.collect() if parts is not None else []:
        facts[r["column"]].update(num_unique=r["num_unique"], top_count=r["top_count"])
    wanted: dict[str, tuple[Column, list[float]]] = {}
    known: dict[str, tuple[int, float, float]] = {}
    for c in columns:
        if c in numeric:
            x = F.col(f"`{c}`").cast("double")
            ends = (facts[c]["low"], facts[c]["high"])
            wanted[c], known[c] = (x, [0.25, 0.75]), (facts[c]["present"], *ends)
            if "nonzero_median" in _needed_ranks(facts[c]):
                wanted[f"{c}\0nonzero"] = (F.when(x != 0, x), [0.5])
                known[f"{c}\0nonzero"] = (facts[c]["present"] - facts[c]["num_zeros"], *ends)
    found = exact_quantiles(df, wanted, known=known)
    for c in columns:
        if c in numeric:
            facts[c]["q1"], facts[c]["q3"] = found[c]
            facts[c]["nonzero_median"] = found.get(f"{c}\0nonzero", [None])[0]


def datetime_formats(df: DataFrame, columns: list[str], ends: dict[str, tuple[str, str]] | None = None) -> dict[str, str]:
    """The one layout that parses every non-null text of a column, for the columns that have one.

    Only layouts that parse the column's smallest and largest text are tried on the data, so prose costs no scan.
    """
    if not columns:
        return {}
    if ends is None:
        row = df.agg(*[F.min(f"`{c}`").alias(f"a{i}") for i, c in enumerate(columns)],
                     *[F.max(f"`{c}`").alias(f"b{i}") for i, c in enumerate(columns)]).first()
        ends = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(columns)}
    pairs = [(c, *ends[c], f) for c in columns if all(map(_date_like, ends[c])) for f in DATE_FORMATS]
    if not pairs:
        return {}
    tried = small_frame(df.sparkSession, pairs, "column string, a string, b string, layout string")
    fits = [F.try_to_timestamp(F.trim(end), F.col("layout")).isNotNull() for end in ("a", "b")]
    candidates = [(r["column"], r["layout"]) for r in tried.where(fits[0] & fits[1]).collect()]
    if not candidates:
        return {}
    misses = df.agg(*[
        F.count_if(F.col(f"`{c}`").isNotNull() & parse_time(c, f).isNull()).alias(f"m{i}")
        for i, (c, f) in enumerate(candidates)
    ]).first()
    found: dict[str, str] = {}
    for i, (c, f) in enumerate(candidates):
        if misses[f"m{i}"] == 0:
            found.setdefault(c, f)
    return found


def _date_like(text: str | None) -> bool:
    """Every layout holds a digit and is shorter than 40 characters."""
    return text is not None and len(text) <= 40 and any(ch.isdigit() for ch in text)


def parse_time(column: str, layout: str) -> Column:
    return F.try_to_timestamp(F.trim(F.col(f"`{column}`")), F.lit(layout))


def profile_frame(df: DataFrame) -> DataFrame:
    """Raw facts of every scalar column as a small DataFrame (one row per column, in column order)."""
    df, _ = flat_table(df)
    with working_copy(df) as copy:
        return small_frame(df.sparkSession, _profile_rows(copy), FRAME_SCHEMA)


def _profile_rows(df: DataFrame) -> list[tuple]:
    by_kind = kinds(df)
    facts = _first_scan(df, by_kind)
    numeric = [c for c, k in by_kind.items() if k in (INTEGER, FLOAT)]
    small = [c for c, f in facts.items() if 0 < f["sketch"] <= SMALL_VOCABULARY]
    large = [c for c, f in facts.items() if f["sketch"] > SMALL_VOCABULARY]
    if small:
        _small_columns(df, small, facts, numeric)
    if large:
        _large_columns(df, large, facts, numeric)
    texts = [c for c, k in by_kind.items() if k == STRING and facts[c]["present"]]
    layouts = datetime_formats(df, texts, {c: (facts[c]["low_text"], facts[c]["high_text"]) for c in texts})

    outliers = []
    for c in numeric:
        f, x = facts[c], F.col(f"`{c}`").cast("double")
        if f["std"] and f["std"] > 0:
            outliers.append((c, "num_outliers", F.abs(x - F.lit(f["mean"])) > F.lit(SIGMAS * f["std"])))
        if f["present"] >= 4 and f["q3"] > f["q1"]:
            reach = IQR_FENCE * (f["q3"] - f["q1"])
            outliers.append((c, "num_iqr_outliers", (x < F.lit(f["q1"] - reach)) | (x > F.lit(f["q3"] + reach))))
    for batch in _batches(outliers, 16 * SCAN_WIDTH):
        row = df.agg(*[F.count_if(cond).alias(f"o{i}") for i, (_, _, cond) in enumerate(batch)]).first()
        for i, (c, field, _) in enumerate(batch):
            facts[c][field] = row[f"o{i}"]

    rows = []
    for ordinal, c in enumerate(by_kind):
        f = facts[c]
        rows.append((ordinal, c, by_kind[c], f["n_rows"], f["n_rows"] - f["present"], f["num_zeros"] or 0, f["mean"],
                     f["std"], f["low"], f["high"], f["low_text"], f["high_text"], f.get("num_unique", 0),
                     f.get("top_count", 0), f.get("num_outliers", 0), f.get("q1"), f.get("q3"),
                     f.get("num_iqr_outliers", 0), f.get("nonzero_median"), layouts.get(c),
                     name_matches(c, DATE_WORDS, "substring")))
    return rows


def share(part: str, digits: int = 1) -> Column:
    """A percentage of the row count, 0 for an empty table."""
    rows = F.col("n_rows")
    return F.when(rows > 0, F.round(F.col(part) / rows * 100, digits)).otherwise(F.lit(0.0))


def with_column_types(frame: DataFrame, numeric_names_as_dates: bool = False) -> DataFrame:
    """Add ``col_type``. ``numeric_names_as_dates`` also reads number columns with a date-like name as dates."""
    storage, unique = F.col("storage"), F.col("num_unique")
    ratio = unique / F.when(F.col("n_rows") > 0, F.col("n_rows"))
    number = storage.isin(INTEGER, FLOAT)
    named = F.lit(numeric_names_as_dates) & number & F.col("date_named")
    dated = (storage == TEMPORAL) | F.col("date_format").isNotNull() | named
    zero_one = number & (F.col("low") == 0) & (F.col("high") == 1)
    yes_no = F.col("low_text").isin(*BOOLEAN_TEXTS) & F.col("high_text").isin(*BOOLEAN_TEXTS)
    two_way = (unique == 2) & F.coalesce(zero_one | yes_no | (storage == BOOLEAN), F.lit(False))
    keyed = (ratio > ID_SHARE) & (F.col("n_rows") > ID_MIN_ROWS) & (storage != FLOAT)
    kind = (
        F.when(dated, DATETIME).when(two_way, BOOLEAN_TYPE).when(keyed, ID_COLUMN)
        .when((storage == STRING) & (ratio > HIGH_SHARE), CATEGORICAL_HIGH)
        .when(storage == FLOAT, CONTINUOUS)
        .when((storage == INTEGER) & (unique > DISCRETE_VALUES), CONTINUOUS)
        .when(storage == INTEGER, DISCRETE)
        .otherwise(CATEGORICAL_LOW)
    )
    return frame.withColumn("col_type", kind)


def column_report(typed: DataFrame) -> DataFrame:
    """The public column profile."""
    return typed.select(
        "column", F.col("storage").alias("dtype"), "col_type", "num_missing", share("num_missing").alias("missing_pct"),
        "num_zeros", share("num_zeros").alias("zero_pct"), "num_outliers", "num_unique",
        share("num_unique").alias("unique_pct"))


@dataclass
class TableProfile:
    """A typed profile frame plus its rows on the driver (one per column)."""

    frame: DataFrame
    rows: list

    @property
    def types(self) -> dict[str, str]:
        return {r["column"]: r["col_type"] for r in self.rows}

    @property
    def n_rows(self) -> int:
        return self.rows[0]["n_rows"] if self.rows else 0

    def fact(self, column: str):
        return next(r for r in self.rows if r["column"] == column)


def profile_table(df: DataFrame, numeric_names_as_dates: bool = False) -> TableProfile:
    frame = with_column_types(profile_frame(df), numeric_names_as_dates)
    return TableProfile(frame, frame.orderBy("ordinal").collect())
