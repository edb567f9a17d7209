"""Categories of any number: frequent ones are listed in a model, the tail of rare ones stays a table.

A value with at least 1 in ``HEAD`` of its group's present values is listed, so a list has at most ``HEAD`` entries. All others are
the tail of their column. Inside the tail values stand in the order of a hash, which gives a row its place without a
lookup; a generated row that falls into the tail finds its value by an interval join with the running shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.indexing import with_running_sum
from tabloom.session import materialize

HEAD = 1000
#: Values of a tail that a slice holds on average.
SLICE = 16
GROUP = "_group"
#: Keys that rows without a tail value spread over in the interval join, where they find nothing.
IDLE = 4096
#: Tails whose totals are broadcast. More of them are joined by their group, which then holds a small share of the rows each.
FEW_TAILS = 10_000


def place_of(value: Column) -> Column:
    """The place of a value in [0, 1) in the order of the tail."""
    return F.shiftrightunsigned(F.xxhash64(value), 11).cast("double") / F.lit(float(1 << 53))


def category_counts(df: DataFrame, categorical: list[str]) -> DataFrame:
    """(GROUP, column, value, n) of all present values."""
    long = df.select(GROUP, *[F.col(f"`{c}`").cast("string").alias(c) for c in categorical]).unpivot([GROUP], categorical, "column", "value")
    return long.where("value IS NOT NULL").groupBy(GROUP, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def listed(counts: DataFrame, present: DataFrame) -> DataFrame:
    """Per (GROUP, column): the frequent values with their counts as ``pairs``, at most ``HEAD`` of them, and ``tail_n`` rows with
    ``tail_values`` values of the tail. ``present`` has (GROUP, column, present)."""
    often = F.col("n") * HEAD >= F.col("present")
    return counts.join(present, [GROUP, "column"]).groupBy(GROUP, "column").agg(
        F.collect_list(F.when(often, F.struct("value", "n"))).alias("pairs"),
        F.coalesce(F.sum(F.when(~often, F.col("n"))), F.lit(0)).alias("tail_n"), F.count_if(~often).alias("tail_values"))


def slices_of(values: Column | int) -> Column | int:
    """Slices that the unit interval of a tail of so many values is cut into."""
    return F.greatest(F.lit(1), F.floor(values / SLICE)) if isinstance(values, Column) else max(1, values // SLICE)


def tail_table(counts: DataFrame, present: DataFrame) -> DataFrame:
    """The tail values of all groups as intervals of their tail, from ``before`` to ``after`` of its ``total``:
    (GROUP, column, value, before, after, total, slice).

    The unit interval of a tail is cut into slices of ``SLICE`` values on average, and a value has a row for each slice it touches: little
    more rows than values. They are stored once, without slices.
    """
    rare = counts.join(present, [GROUP, "column"]).where(F.col("n") * HEAD < F.col("present")).drop("present")
    summed = with_running_sum(rare, [GROUP, "column", place_of(F.col("value")), "value"], "n", "_before")
    tails = materialize(summed.groupBy(GROUP, "column").agg(F.min("_before").alias("_first"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("_k")))
    if tails.count() <= FEW_TAILS:  # by a shuffle the values of a long tail would all meet in one task
        tails = F.broadcast(tails)
    before = F.col("_before") - F.col("_first")
    cut = summed.join(tails, [GROUP, "column"]).select(GROUP, "column", "value", before.alias("before"), (before + F.col("n")).alias("after"), "total", slices_of(F.col("_k")).alias("_k"))
    lower, upper = (F.floor(F.col(x) / F.col("total") * F.col("_k")) for x in ("before", "after"))
    return cut.withColumn("slice", F.explode(F.sequence(lower, F.least(upper, F.col("_k") - 1)))).drop("_k")


def fill_tails(rows: DataFrame, tails: DataFrame | None, wide: list[str]) -> DataFrame:
    """Put the tail values into ``rows``, which say for each ``wide`` column where a row falls: ``_tail:c`` in [0, 1), null if it has
    a value or none at all, and ``_slice:c``. ``_fitted`` names the group a row was drawn from."""
    for c in wide:
        mine = tails.where(F.col("column") == c).select(F.col(GROUP).alias("_fitted"), F.col("slice").alias(f"_slice:{c}"), "value", "before", "after", "total")
        at = F.col(f"_tail:{c}")
        found = [rows["_fitted"] == mine["_fitted"], rows[f"_slice:{c}"] == mine[f"_slice:{c}"], at >= F.col("before") / F.col("total"), at < F.col("after") / F.col("total")]
        joined = rows.join(mine, found, "left").drop(mine["_fitted"], mine[f"_slice:{c}"])
        rows = joined.withColumn(c, F.coalesce(F.col(f"`{c}`"), F.col("value"))).drop("value", "before", "after", "total", f"_tail:{c}", f"_slice:{c}")
    return rows.drop("_fitted")
