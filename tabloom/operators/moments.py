"""Pairwise correlation of many columns in one scan, with pairwise treatment of missing values.

Every task adds up counts, sums and products of its rows as small matrices (a matrix product per Arrow batch); the
matrices of all tasks are then summed by group and pair. No pair of rows and no row itself is ever shuffled. The matrix of a wide
table is made in strips of ``TILE`` columns, and a scan makes as many strips as a task can hold.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a strip, and numbers of a batch that are worked on at a time.
TILE = 256
#: Sums of a kind that a task holds at a time: a scan makes as many strips as fit.
SUMS = 1 << 20
CELLS = 2_000_000
#: Rows of sums that a task hands over at a time.
BLOCK = 65_536
#: Columns beyond which their expressions may exceed a method.
MANY = 30
SCHEMA = "grp string, a int, b int, n double, sa double, sb double, saa double, sbb double, sab double"

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class MomentTask:
    """Task side: ``score(group, table)`` gives a float matrix with NaN for missing, one column per measure."""

    def __init__(self, score: Callable[[str, pa.Table], np.ndarray], group: str, width: int, strips: list[tuple[int, int]] | None = None):
        self.score, self.group, self.strips = score, group, [slice(*s) for s in strips or [(0, width)]]
        self.step = max(1, CELLS // max(1, width))

    def __call__(self, batches):
        totals: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, self.step):
                table = pa.Table.from_batches([batch.slice(at, self.step)])
                keys = table.column(self.group)
                names = pc.unique(keys).to_pylist()
                for name in names:
                    part = table if len(names) == 1 else table.filter(pc.equal(keys, name))
                    scores = self.score(name, part)
                    for k, strip in enumerate(self.strips):
                        sums = self._sums(scores[:, strip.start:], slice(0, strip.stop - strip.start))  # no pair is made twice
                        if (name, k) in totals:
                            totals[name, k] += sums
                        else:
                            totals[name, k] = sums
        for (name, k), sums in totals.items():
            yield from self._rows(name, sums, self.strips[k].start)

    @staticmethod
    def _sums(x: np.ndarray, strip: slice = slice(None)) -> np.ndarray:
        """Counts, sums and products of the columns of ``strip`` with all columns. What a column loses where another one is missing
        is taken off for the columns with gaps alone."""
        absent = np.isnan(x)
        gaps = np.flatnonzero(absent.any(axis=0))
        if len(gaps):
            x = np.where(absent, 0.0, x)
        square, n, width = x * x, float(len(x)), x.shape[1]
        sums, squares = x.sum(axis=0), square.sum(axis=0)
        inside = np.arange(width)[strip]
        out = np.empty((6, len(inside), width))
        out[0], out[1], out[2], out[3], out[4] = n, sums[strip][:, None], sums, squares[strip][:, None], squares
        out[5] = x[:, strip].T @ x
        if len(gaps):
            mask = (~absent).astype(np.float64)
            mine = np.flatnonzero(np.isin(inside, gaps))
            held = inside[mine]
            out[0][:, gaps], out[0][mine] = mask[:, strip].T @ mask[:, gaps], mask[:, held].T @ mask
            out[1][:, gaps], out[3][:, gaps] = x[:, strip].T @ mask[:, gaps], square[:, strip].T @ mask[:, gaps]
            out[2][mine], out[4][mine] = mask[:, held].T @ x, mask[:, held].T @ square
        return out

    @staticmethod
    def _rows(name: str, sums: np.ndarray, start: int):
        a, b = np.nonzero(np.arange(sums.shape[2])[None, :] > np.arange(sums.shape[1])[:, None])
        for at in range(0, len(a), BLOCK):
            i, j = a[at:at + BLOCK], b[at:at + BLOCK]
            arrays = [pa.array([name], pa.string()).take(pa.array(np.zeros(len(i), np.int32))), pa.array(i + start, pa.int32()), pa.array(j + start, pa.int32())]
            arrays += [pa.array(sums[k][i, j]) for k in range(6)]
            yield pa.RecordBatch.from_arrays(arrays, names=["grp", "a", "b", "n", "sa", "sb", "saa", "sbb", "sab"])


def number_rows(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """The numbers of a row as one array ``x``, then ``more``: Spark asks each field for its size after each row it hands to Python, and an array
    is one field, which needs no stacking there. The expressions of many columns exceed a method if their stage is compiled as one; Spark
    compiles them apart where any column has a function over an array, here ``gap``."""
    numbers = [F.col(f"`{c}`").cast("double") for c in columns]
    apart = [F.exists(F.array(numbers[0]), lambda x: x.isNull()).alias("gap")] if len(columns) > MANY else []
    return df.select(F.array(*numbers).alias("x"), *more, *apart)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of an array column, NaN for null."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


class Standardize:
    """Scores for plain columns, which come as one array: centred and scaled, which keeps the sums of squares accurate."""

    def __init__(self, centers: list[float], scales: list[float]):
        self.centers, self.scales = np.asarray(centers), np.asarray(scales)

    def __call__(self, group: str, table: pa.Table) -> np.ndarray:
        x = matrix(table.column(0), len(self.centers)) - self.centers
        x /= self.scales
        return x


def centers(df: DataFrame, columns: list[str]) -> Standardize:
    """Means and deviations of any number of columns from one scan, near enough to standardise them."""
    width = len(columns)

    def summed(batches):
        n, total, square, shift = np.zeros(width), np.zeros(width), np.zeros(width), None
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, CELLS // width)):
                x = matrix(batch.column(0).slice(at, max(1, CELLS // width)), width)
                present = np.isfinite(x)
                shift = np.where(present[0], x[0], 0.0) if shift is None else shift
                x = x - shift
                if not present.all():
                    x[~present] = 0.0
                n, total, square = n + present.sum(axis=0), total + x.sum(axis=0), square + np.einsum("ij,ij->j", x, x)
        if shift is not None:
            mean = np.divide(total, n, out=np.zeros(width), where=n > 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(n), pa.array(mean + shift), pa.array(np.maximum(square - n * mean * mean, 0))], ["i", "n", "m", "q"])

    parts = number_rows(df, columns).mapInArrow(summed, "i long, n double, m double, q double")
    whole = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum("q").alias("q"), F.min(F.when(F.col("n") > 0, F.col("m"))).alias("low"),
                                   F.max(F.when(F.col("n") > 0, F.col("m"))).alias("high")).collect()  # a row for each column
    center, scale = np.zeros(width), np.ones(width)
    for r in whole:
        if r["n"]:
            center[r["i"]] = r["s"] / r["n"]
            scale[r["i"]] = max(math.sqrt(r["q"] / r["n"]), r["high"] - r["low"]) or 1.0
    return Standardize(center.tolist(), scale.tolist())


def pairwise_moments(df: DataFrame, score: Callable, group: str, width: int) -> DataFrame:
    """(grp, a, b, corr) for a < b; ``corr`` is null where a side does not vary over the rows both have."""
    def scan(strips: list[tuple[int, int]]) -> DataFrame:
        task = MomentTask(score, group, width, strips)
        return df.mapInArrow(lambda batches: task(batches), SCHEMA)

    strips = [(low, min(low + TILE, width)) for low in range(0, max(width, 1), TILE)]
    most = max(1, SUMS // max(1, TILE * width))
    scans = [scan(strips[at:at + most]) for at in range(0, len(strips), most)]
    sums = reduce(lambda x, y: x.unionAll(y), scans).groupBy("grp", "a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    var_a, var_b = (F.col("n") * F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") for c in "ab")
    floor = F.lit(1e-9) * F.col("n") * F.col("n")
    cov = F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")
    return sums.select("grp", "a", "b", F.when(
        (F.col("n") > 1) & (var_a > floor) & (var_b > floor), cov / F.sqrt(var_a) / F.sqrt(var_b)).alias("corr"))


def pairwise_correlation(df: DataFrame, score: Callable, width: int, group: str, groups: list[str]) -> dict[str, np.ndarray]:
    """Correlation matrix per group, 0 where undefined (a width x width matrix per group reaches the driver)."""
    matrices = {g: np.eye(width) for g in groups}
    found = pairwise_moments(df, score, group, width).toArrow()
    for name in groups:
        mine = found.filter(pc.equal(found["grp"], name))
        a, b = mine["a"].to_numpy(), mine["b"].to_numpy()
        matrices[name][a, b] = matrices[name][b, a] = np.clip(np.nan_to_num(mine["corr"].to_numpy()), -1.0, 1.0)
    return matrices
