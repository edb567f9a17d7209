"""Dataset-level inference over the typed profile frame: size, type, target, imbalance, usability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.kinds import BOOLEAN, FLOAT, INTEGER, name_matches
from tabloom.operators.frequencies import class_counts
from tabloom.operators.profile import DATETIME

# Name hints.
EVENT_DATE_HINTS = (
    "signup", "sign_up", "created", "updated", "modified", "registered", "joined", "birth", "dob", "order",
    "purchase", "last_", "_at", "expiry", "expiration", "hire", "enroll",
)
REGRESSION_HINTS = (
    "price", "charges", "charge", "cost", "amount", "salary", "wage", "revenue", "sales", "income", "value", "amt",
    "total", "spend", "spending", "fare", "rent", "premium", "balance", "duration", "length", "weight", "height",
    "temperature", "temp", "consumption", "demand", "yield", "profit", "mpg",
)
CLASSIFICATION_HINTS = (
    "default", "churn", "fraud", "survived", "outcome", "target", "label", "class", "result", "approved",
    "converted", "clicked", "purchased", "cancelled", "failed", "success", "win", "loss", "y", "output", "response",
    "event", "flag", "status", "disease", "died", "dead", "active", "inactive", "valid", "invalid", "sentiment",
    "category", "grade", "type", "tier", "level",
)

# Size limits and thresholds.
TINY, SMALL, MEDIUM = 100, 500, 5000
MAX_CLASSES, CLASS_SHARE, TARGET_LOW, TARGET_HIGH = 20, 0.5, 0.05, 0.999
SERIES_UNIQUE, SERIES_WIDTH, IMBALANCED_COLUMN, IMBALANCED_TARGET = 0.95, 4, 0.80, 0.60
MIN_ROWS, MIN_UNIQUE_ROWS = 2, 10


def size_category(n: Column) -> Column:
    return F.when(n < TINY, "tiny").when(n < SMALL, "small").when(n < MEDIUM, "medium").otherwise("large")


def _hinted(frame: DataFrame, words: tuple[str, ...], mode: str) -> Column:
    """Name tests run on the handful of column names, not on data."""
    names = [r["column"] for r in frame.select("column").collect()]
    return F.col("column").isin(*[n for n in names if name_matches(n, words, mode)])


def continuous_target() -> Column:
    ratio = F.col("num_unique") / F.col("n_rows")
    fits = (F.col("storage") == FLOAT) | ((F.col("storage") == INTEGER) & (ratio > TARGET_LOW) & (ratio < TARGET_HIGH))
    return (F.col("num_unique") > MAX_CLASSES) & fits


def class_candidate() -> Column:
    return F.col("num_unique").between(2, MAX_CLASSES) & (F.col("num_unique") / F.col("n_rows") < CLASS_SHARE)


def target_type() -> Column:
    return F.when(continuous_target(), "regression").otherwise("classification")


def target_candidates(typed: DataFrame, hint_match: str = "token") -> DataFrame:
    """Columns that could be a target with their rank class (1 = best) and type; the best is the first by
    (priority, -ordinal). ``hint_match='substring'`` matches hints anywhere in a name."""
    last = typed.agg(F.max("ordinal")).first()[0]
    is_last = F.col("ordinal") == F.lit(last)
    number, regress, classify = F.col("storage").isin(INTEGER, FLOAT, BOOLEAN), continuous_target(), class_candidate()
    zero_one = number & F.coalesce((F.col("low").isin(0.0, 1.0) & F.col("high").isin(0.0, 1.0)), F.col("storage") == BOOLEAN)
    ranked = (
        F.when(is_last & regress, 1).when(is_last & classify, 1)
        .when(_hinted(typed, CLASSIFICATION_HINTS, hint_match) & classify, 2)
        .when(_hinted(typed, REGRESSION_HINTS, hint_match) & regress, 3)
        .when(classify & zero_one, 4)
        .when(classify & (F.col("num_unique") == 2), 5)
        .when(classify, 6)
        .when(regress, 7)
    )
    return (
        typed.withColumn("priority", ranked).where("priority is not null")
        .withColumn("target_type", target_type())
        .select("column", "ordinal", "priority", "target_type", "num_unique", "top_count", "num_missing", "n_rows")
    )


def suggest_target(typed: DataFrame, hint_match: str = "token") -> DataFrame:
    """At most one row: the suggested target and its type."""
    return target_candidates(typed, hint_match).orderBy("priority", F.desc("ordinal")).limit(1)


def top_share() -> Column:
    return F.round(F.col("top_count") / F.nullif(F.col("n_rows") - F.col("num_missing"), F.lit(0)), 3)


def time_series_flags(typed: DataFrame) -> DataFrame:
    """One row: whether the table is a series (one row per moment, few measures) and the facts behind it."""
    dated = F.col("col_type") == DATETIME
    event = _hinted(typed, EVENT_DATE_HINTS, "substring")
    return typed.agg(
        F.count_if(dated).alias("datetime_columns"),
        F.count_if(~dated).alias("other_columns"),
        F.max(F.when(dated, F.col("num_unique") / F.col("n_rows"))).alias("uniqueness"),
        F.coalesce(F.bool_or(dated & event), F.lit(False)).alias("event_named"),
    ).withColumn("is_time_series", F.coalesce(
        (F.col("datetime_columns") == 1) & ~F.col("event_named") & (F.col("uniqueness") >= SERIES_UNIQUE)
        & (F.col("other_columns") <= SERIES_WIDTH), F.lit(False)))


def dataset_profile(typed: DataFrame, hint_match: str = "token", target: str | None = None) -> DataFrame:
    """One row describing the table. ``target`` overrides the suggestion."""
    if target is None:
        chosen = suggest_target(typed, hint_match)
    else:
        chosen = typed.where(F.col("column") == target).withColumn("target_type", target_type())
    picked = chosen.select("column", "target_type", top_share().alias("ratio")).collect()
    name, kind, ratio = (picked[0]["column"], picked[0]["target_type"], picked[0]["ratio"]) if picked else (None,) * 3
    two_valued = F.col("num_unique") == 2
    lopsided = two_valued & (F.col("top_count") / (F.col("n_rows") - F.col("num_missing")) > IMBALANCED_COLUMN)
    summary = typed.agg(
        F.max("n_rows").alias("num_rows"), F.count(F.lit(1)).alias("num_cols"),
        F.bool_or(F.col("col_type") == DATETIME).alias("has_datetime"),
        F.coalesce(F.bool_or(lopsided), F.lit(False)).alias("lopsided"),
        F.min(F.when(two_valued, F.struct("ordinal", top_share().alias("r")))).alias("first_binary"),
    )
    series = time_series_flags(typed).first()["is_time_series"]
    ratio_col = F.lit(ratio).cast("double") if picked else F.col("first_binary.r")
    return summary.select(
        "num_rows", "num_cols", size_category(F.col("num_rows")).alias("size_category"),
        F.when(F.lit(series), "time_series").when(F.col("lopsided"), "imbalanced").otherwise("standard")
        .alias("dataset_type"),
        "has_datetime", F.lit(bool(picked)).alias("has_target_column"), F.lit(name).cast("string").alias("target_column"),
        F.lit(kind).cast("string").alias("target_type"),
        F.coalesce(ratio_col > IMBALANCED_TARGET, F.lit(False)).alias("is_imbalanced"),
        ratio_col.alias("imbalance_ratio"))


def target_classes(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of a target with 2 to 20 values, otherwise no row."""
    counts = class_counts(df, column).limit(MAX_CLASSES + 1)
    return counts.where(counts.agg(F.count(F.lit(1))).scalar().between(2, MAX_CLASSES))


def usability(typed: DataFrame, has_text: bool = False) -> DataFrame:
    """One row per usability rule: (rule, refused, reason)."""
    with_null = F.col("num_unique") + (F.col("num_missing") > 0).cast("long")
    facts = typed.agg(
        F.coalesce(F.max("n_rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("cols"),
        F.max(with_null).alias("widest"), F.min(with_null).alias("narrowest"))
    rules = (
        ("min_rows", F.col("rows") < MIN_ROWS, "fewer than two rows"),
        ("single_constant", (F.col("cols") == 1) & (F.col("widest") <= 1), "a single column with one value"),
        ("all_unique", F.lit(not has_text) & (F.col("rows") >= MIN_UNIQUE_ROWS) & (F.col("narrowest") == F.col("rows")),
         "every column is unique in every row"),
    )
    return facts.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.coalesce(refused, F.lit(False)).alias("refused"), F.lit(reason).alias("reason"))
        for name, refused, reason in rules])).alias("r")).select("r.*")


def override_target(profile, target: str, hint_match: str = "token") -> tuple[DataFrame, str | None]:
    """Dataset profile for a user's target; a constant choice is dropped with a note and leaves no target."""
    fact = profile.fact(target)
    if fact["num_unique"] + (fact["num_missing"] > 0) < 2:
        note = f"target {target} has one value in every row, so it was dropped"
        return dataset_profile(profile.frame, hint_match).withColumns({
            "has_target_column": F.lit(False), "target_column": F.lit(None).cast("string"),
            "target_type": F.lit(None).cast("string")}), note
    return dataset_profile(profile.frame, hint_match, target), None
