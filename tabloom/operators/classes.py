"""Class plans (how many rows per class) and generation by class or by cluster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.small import small_frame
from tabloom.operators.copula import GROUP, CopulaModel, fit_copula, proportional_counts, sample_copula
from tabloom.operators.frequencies import class_counts
from tabloom.operators.keyed_copula import KeyedModel, fit_keyed, jobs_of, sample_keyed, with_starts
from tabloom.operators.modes import LEAST_ROWS, grouping
from tabloom.operators.scarce import condition, sample_scarce
from tabloom.session import materialize

# Least number of real rows a class needs.
MIN_CLASS_ROWS = 10
#: A class with one in so many of the rows or more is large: at most this many classes are.
LARGE_CLASSES = 100


def allocation(df: DataFrame, target: str, n: int) -> DataFrame:
    """Rows per class in proportion to the real shares, at least one each: (value, real, rows)."""
    counts = class_counts(df, target)
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(
        "value", F.col("n").alias("real"),
        F.greatest(F.lit(1), F.bround(F.lit(n) * (F.col("n") / total), 0).cast("long")).alias("rows"))


def balance_plan(classes: DataFrame, n: int) -> DataFrame:
    """Split ``n`` rows evenly over the classes (at most 20) in text order, the first ones taking the remainder."""
    ordered = classes.select("value").withColumn("i", F.row_number().over(Window.orderBy("value")) - 1)
    ordered = ordered.withColumn("k", classes.agg(F.count(F.lit(1))).scalar())
    base = F.floor(F.lit(n) / F.col("k"))
    return ordered.select(
        "value", (base + F.when(F.col("i") < F.lit(n) - base * F.col("k"), 1).otherwise(0)).alias("rows"))


def class_plan(df: DataFrame, target: str, requested: dict[str, int] | DataFrame) -> DataFrame:
    """Check a request against the real rows: (value, requested, real_examples, skipped). Only positive counts of the
    request take part; a class with fewer than ten real rows is skipped. A request of any size is a table (value, requested)."""
    if isinstance(requested, DataFrame):
        wanted = requested.select(F.col("value").cast("string"), F.col("requested").cast("long")).where("requested > 0")
    else:
        rows = [(str(v), int(n)) for v, n in requested.items() if n and n > 0]
        wanted = small_frame(df.sparkSession, rows, "value string, requested long")
    return wanted.join(class_counts(df, target), "value", "left").select(
        "value", "requested", F.coalesce("n", F.lit(0)).alias("real_examples"),
        (F.coalesce("n", F.lit(0)) < MIN_CLASS_ROWS).alias("skipped"))


@dataclass
class ClassModels:
    """The models behind rows generated by class: the large classes and the pool of scarce ones, and all others."""

    numeric: list[str]
    parts: list[CopulaModel | KeyedModel]

    def median(self, column: str) -> float:
        """Size-weighted median over the classes, used to fill gaps of whole-number columns."""
        sizes = [sum(m.sizes.values()) if isinstance(m, CopulaModel) else m.size for m in self.parts]
        return sum(n * m.median(column) for n, m in zip(sizes, self.parts)) / sum(sizes)


@dataclass
class Generated:
    rows: DataFrame | None
    model: CopulaModel | ClassModels | None
    strategy: str
    skipped: list[dict] | DataFrame


def generate_per_class(df: DataFrame, columns: list[str], target: str, counts: dict[str, int] | DataFrame, seed: int = 42) -> Generated:
    """Exact row counts per class, each class from its own marginals and dependence. ``counts`` of any number of classes is a table
    (value, requested), and what was skipped is then a table too."""
    plan = class_plan(df, target, counts)
    if isinstance(counts, DataFrame):
        plan = materialize(plan)
        skipped = plan.where("skipped").select(F.col("value").alias("class_value"), "requested", "real_examples")
    else:
        rows = plan.collect()  # no more than were asked for
        plan = small_frame(df.sparkSession, [tuple(r) for r in rows], "value string, requested long, real_examples long, skipped boolean")
        skipped = [{"class_value": r["value"], "requested": r["requested"], "real_examples": r["real_examples"]} for r in rows if r["skipped"]]
    usable = with_starts(plan.where(~F.col("skipped")).select("value", F.col("real_examples").alias("real"), F.col("requested").alias("rows")))
    if usable.isEmpty():
        return Generated(None, None, "per_class", skipped)
    return _by_class(df, columns, target, usable, seed, "per_class", skipped)


def generate_conditional(df: DataFrame, columns: list[str], target: str, n: int, seed: int = 42) -> Generated:
    """Rows per class in proportion to the real shares. Classes with enough rows have their own model; the others share one
    that is conditioned on the class."""
    return _by_class(df, columns, target, with_starts(allocation(df, target, n)), seed, "conditional", [])


def _by_class(df: DataFrame, columns: list[str], target: str, plan: DataFrame, seed: int, strategy: str, skipped: list[dict] | DataFrame) -> Generated:
    """Rows for each (value, real, rows, start) of ``plan``.

    Large classes and the pool of all scarce ones are few, and fitted where their rows are. Every other class holds less than 1% of the
    rows; plan and models of those are tables keyed by class. So the driver holds no list that grows with the classes.
    """
    spark, rest = df.sparkSession, "rest"
    enough = F.col("real") >= MIN_CLASS_ROWS
    total = plan.agg(F.sum("real")).first()[0] or 0
    large = {r["value"]: r for r in plan.where(enough & (LARGE_CLASSES * F.col("real") >= total)).collect()}
    small = plan.where(~F.col("value").isin(*large))
    size = small.agg(F.count_if(enough).alias("keyed"), F.count_if(~enough).alias("scarce")).first()
    key, others = F.col(f"`{target}`").cast("string"), [c for c in columns if c != target]
    if not others:
        ids = jobs_of(plan).select(F.explode(F.sequence("low", F.col("high") - 1)).alias("row_id"), F.col("value").cast(df.schema[target].dataType).alias(target))
        return Generated(ids, ClassModels([], []), strategy, skipped)
    names = [F.col(f"`{c}`") for c in others]
    valued = df.where(key.isNotNull()).select(*names, key.alias("_value"))
    fitted = valued.where(F.col("_value").isin(*large)).withColumn(GROUP, F.col("_value")) if large else None
    if size["keyed"] or size["scarce"]:
        # The join keeps the rows of planned classes alone; no class here has more than 1% of them.
        found = materialize(valued.where(~F.col("_value").isin(*large)).join(small.select(F.col("value").alias("_value"), enough.alias("_own")), "_value"))
        if size["scarce"]:
            pool = found.where(~F.col("_own")).drop("_own").withColumn(GROUP, F.lit(rest))
            fitted = pool if fitted is None else fitted.withColumn(GROUP, F.concat(F.lit("class:"), GROUP)).unionByName(pool)
    parts, made = [], []
    if fitted is not None:
        model = fit_copula(fitted, others, F.col(GROUP))
        parts.append(model)
        if size["scarce"]:
            means = condition(pool, model, rest)
            made.append(sample_scarce(model, small.where(~enough), means, rest, seed))
        if large:
            models = {v: f"class:{v}" for v in large} if size["scarce"] else None
            made.append(sample_copula(spark, model, {v: r["rows"] for v, r in large.items()}, seed, models, {v: r["start"] for v, r in large.items()}))
    if size["keyed"]:
        keyed = fit_keyed(found.where("_own").select(*names, F.col("_value").alias(GROUP)), others)
        parts.append(keyed)
        made.append(sample_keyed(keyed, small.where(enough).withColumn(GROUP, F.col("value")), seed))
    rows = made[0]
    for more in made[1:]:
        rows = rows.unionByName(more)
    rows = rows.withColumn(target, F.col(GROUP).cast(df.schema[target].dataType)).drop(GROUP)
    return Generated(rows.select("row_id", *[F.col(f"`{c}`") for c in columns]), ClassModels(parts[0].numeric, parts), strategy, skipped)


def generate_mixture(df: DataFrame, columns: list[str], n: int, seed: int = 42) -> Generated:
    """A copula for each group of rows with the same modes, which follows several peaks and shapes a single copula cannot.

    Groups with fewer than ``LEAST_ROWS`` rows share one model. At most ``modes.MOST_GROUPS`` groups reach the driver.
    """
    bare = df.select(*[F.col(f"`{c}`") for c in columns])
    grouped = bare.withColumn("_modes", grouping(bare, columns))
    sizes = grouped.groupBy("_modes").count().collect()
    few = [r["_modes"] for r in sizes if r["count"] < LEAST_ROWS]
    group = F.when(F.col("_modes").isin(*few), "rest").otherwise(F.concat(F.lit("modes:"), "_modes")) if few else F.col("_modes")
    model = fit_copula(grouped, columns, group=group)
    rows = sample_copula(df.sparkSession, model, proportional_counts(model.sizes, n), seed).drop(GROUP)
    return Generated(rows.select("row_id", *[F.col(f"`{c}`") for c in columns]), model, "mixture", [])


def generate_pooled(df: DataFrame, columns: list[str], n: int, seed: int = 42) -> Generated:
    model = fit_copula(df, columns)
    rows = sample_copula(df.sparkSession, model, {"": n}, seed).drop(GROUP)
    return Generated(rows.select("row_id", *columns), model, "copula", [])


def plan_check(plan: DataFrame, n: int) -> DataFrame:
    """Add to a class plan the total of its requests and whether that total replaces the ``n`` rows asked for."""
    total = F.coalesce(plan.agg(F.sum("requested")).scalar(), F.lit(0))
    return plan.withColumn("total_requested", total).withColumn(
        "overrides_total", (F.col("total_requested") > 0) & (F.col("total_requested") != n))
