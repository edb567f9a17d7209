"""Gaussian copula: marginals as quantile grids or category shares, dependence as a correlation of normal scores.

One code path serves a pooled model (one group), one model per class and one per cluster: rows carry a group key and
all groups are fitted at once. Marginals are a grouped aggregation. Scores, their products and the sampled rows are
NumPy over Arrow batches inside map tasks without a shuffle: as column expressions the grid lookups of a few columns
already exceed the method size the JVM compiles; in single trial runs they were many times slower.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import draws, gaussian
from tabloom.functions.kinds import FLOAT, INTEGER, kinds
from tabloom.functions.quantiles import grouped_quantiles
from tabloom.functions.small import small_frame
from tabloom.operators import tails
from tabloom.operators.moments import CELLS, pairwise_correlation
from tabloom.operators.tails import GROUP
from tabloom.session import discard, materialize, working_copy

GRID = 100
ACCURACY = 10_000
MIN_EIGENVALUE = 1e-8
#: Columns whose marginals are fitted in one scan.
SCAN_COLUMNS = 100

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Marginal:
    """One column within one group. Numeric: ``grid`` of quantiles. Category: frequent ``values`` with ``upper`` cumulative
    shares; the share above them belongs to ``tail_values`` rare ones. ``missing`` is the share of nulls."""

    grid: list[float] = field(default_factory=list)
    values: list[str] = field(default_factory=list)
    upper: list[float] = field(default_factory=list)
    tail_values: int = 0
    missing: float = 0.0

    @property
    def head(self) -> float:
        """Share of the frequent values."""
        return (self.upper[-1] if self.upper else 0.0) if self.tail_values else 1.0

    def knots(self) -> tuple[list[float], list[float]]:
        """Distinct grid values with the mean probability of each run of equal ones."""
        grid = np.asarray(self.grid)
        values, start, runs = np.unique(grid, return_index=True, return_counts=True)
        return values.tolist(), ((start + (runs - 1) / 2.0) / GRID).tolist()

    def middles(self) -> list[float]:
        upper = np.asarray(self.upper)
        return ((upper + np.concatenate([[0.0], upper[:-1]])) / 2).tolist()


@dataclass
class CopulaModel:
    numeric: list[str]
    categorical: list[str]
    types: dict[str, str]
    groups: dict[str, dict[str, Marginal]]
    sizes: dict[str, int]
    correlation: dict[str, np.ndarray] = field(default_factory=dict)
    factor: dict[str, np.ndarray] = field(default_factory=dict)
    #: Categorical columns that have a tail in any group, and the values of the tails.
    wide: list[str] = field(default_factory=list)
    tails: DataFrame | None = None

    @property
    def columns(self) -> list[str]:
        return self.numeric + self.categorical

    def median(self, column: str) -> float:
        """Size-weighted median over the groups, used to fill gaps of whole-number columns."""
        total = sum(self.sizes.values())
        return sum(m[column].grid[GRID // 2] * self.sizes[g] for g, m in self.groups.items() if m[column].grid) / total


def fit_marginals(df: DataFrame, numeric: list[str], categorical: list[str], exact: bool = False) -> CopulaModel:
    """Grids and category shares per group, in one grouped aggregation and one grouped count.

    At every size the grid comes from a mergeable quantile sketch whose rank error is 1 in ``ACCURACY``; category shares
    are exact counts. ``exact`` asks for interpolated quantiles, which take two more scans and a shuffle of the values near them.
    """
    by_type = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    probs = [i / GRID for i in range(GRID + 1)]
    found: dict[str, dict] = {}
    columns = [*((i, c, True) for i, c in enumerate(numeric)), *((i, c, False) for i, c in enumerate(categorical))]
    for start in range(0, max(1, len(columns)), SCAN_COLUMNS):  # a wide table in several scans of its own columns
        aggs: list[Column] = [F.count(F.lit(1)).alias("size")]
        for i, c, number in columns[start:start + SCAN_COLUMNS]:
            if not number:
                aggs.append(F.count(F.col(f"`{c}`").cast("string")).alias(f"c{i}"))
                continue
            x = F.col(f"`{c}`").cast("double")
            if not exact:
                aggs.append(F.percentile_approx(x, probs, ACCURACY).alias(f"g{i}"))
            aggs.append(F.count(x).alias(f"n{i}"))
        for r in df.groupBy(GROUP).agg(*aggs).collect():
            found.setdefault(str(r[GROUP]), {}).update(r.asDict())
        if exact:
            grids = grouped_quantiles(df, GROUP, {f"g{i}": (F.col(f"`{c}`"), probs) for i, c, number in columns[start:start + SCAN_COLUMNS] if number})
            for g, mine in grids.items():
                found[g].update(mine)
    sizes = {g: r["size"] for g, r in found.items()}
    groups: dict[str, dict[str, Marginal]] = {g: {c: Marginal() for c in numeric + categorical} for g in sizes}
    for g, r in found.items():
        for i, c in enumerate(numeric):
            groups[g][c] = Marginal(grid=list(r[f"g{i}"]) if r[f"n{i}"] else [], missing=1 - r[f"n{i}"] / sizes[g])
    model = CopulaModel(numeric, categorical, by_type, groups, sizes)
    present = [(g, c, r[f"c{i}"]) for g, r in found.items() for i, c in enumerate(categorical) if r[f"c{i}"]]
    if present:
        _fit_categories(df, model, small_frame(df.sparkSession, present, f"{GROUP} string, column string, present long"))
    return model


def _fit_categories(df: DataFrame, model: CopulaModel, present: DataFrame) -> None:
    """Frequent values to the driver, at most ``tails.HEAD`` a group and column; a tail stays a table."""
    counts, present = materialize(tails.category_counts(df, model.categorical)), F.broadcast(present)
    for r in tails.listed(counts, present).collect():
        marginal = category_marginal([(p["value"], p["n"]) for p in r["pairs"]], model.sizes[str(r[GROUP])], r["tail_n"], r["tail_values"])
        model.groups[str(r[GROUP])][r["column"]] = marginal
    model.wide = [c for c in model.categorical if any(m[c].tail_values for m in model.groups.values())]
    if model.wide:
        model.tails = tails.tail_table(counts.where(F.col("column").isin(*model.wide)), present)
    discard(counts)


def category_marginal(pairs: list[tuple[str, int]], size: int, tail_n: int = 0, tail_values: int = 0) -> Marginal:
    pairs = sorted(pairs, key=lambda p: (-p[1], p[0]))
    total = sum(n for _, n in pairs) + tail_n
    return Marginal(values=[v for v, _ in pairs], upper=(np.cumsum([n for _, n in pairs]) / total).tolist(), tail_values=tail_values,
                    missing=1 - total / size)


class ScoreTask:
    """Task side of the fit: turns values into normal scores, column by column, for one group."""

    def __init__(self, model: CopulaModel):
        self.numeric, self.categorical = len(model.numeric), len(model.categorical)
        self.knots = {g: [m[c].knots() if m[c].grid else ([], []) for c in model.numeric] for g, m in model.groups.items()}
        self.values = {g: [(m[c].values, m[c].middles(), m[c].head) for c in model.categorical] for g, m in model.groups.items()}
        self.place = {model.categorical.index(c): self.numeric + self.categorical + i for i, c in enumerate(model.wide)}

    def __call__(self, group: str, table: pa.Table) -> np.ndarray:
        """Scores as a (rows, columns) matrix with NaN for nulls."""
        return gaussian.inverse_cdf(self.units(group, table))

    def units(self, group: str, table: pa.Table | pa.RecordBatch) -> np.ndarray:
        """The places of the values among those of their group, in [0, 1]."""
        units = np.full((table.num_rows, self.numeric + self.categorical), np.nan)
        for j, (x, u) in enumerate(self.knots[group]):
            if x:
                raw = table.column(j).to_numpy(zero_copy_only=False)
                units[:, j] = np.where(np.isnan(raw), np.nan, np.interp(raw, x, u))
        for k, (values, middles, head) in enumerate(self.values[group]):
            j = self.numeric + k
            if values:
                place = pc.index_in(table.column(j), value_set=pa.array(values, pa.string()))
                known = np.asarray(middles + [np.nan])
                units[:, j] = known[place.fill_null(len(middles)).to_numpy(zero_copy_only=False)]
            if head < 1:
                rare = np.isnan(units[:, j]) & table.column(j).is_valid().to_numpy(zero_copy_only=False)
                units[rare, j] = head + (1 - head) * table.column(self.place[k]).to_numpy(zero_copy_only=False)[rare]
        return units


def score_input(df: DataFrame, model: CopulaModel, *more: Column) -> DataFrame:
    """What ``ScoreTask`` reads: numbers, categories, and the place in the tail for columns that have one; then ``more`` columns."""
    return df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(model.numeric)],
                     *[F.col(f"`{c}`").cast("string").alias(f"w{i}") for i, c in enumerate(model.categorical)],
                     *[tails.place_of(F.col(f"`{c}`").cast("string")).alias(f"h{i}") for i, c in enumerate(model.wide)], *more, GROUP)


def fit_dependence(df: DataFrame, model: CopulaModel) -> CopulaModel:
    """Correlation of the normal scores per group. Each task sums products of its own rows; only those sums move."""
    found = pairwise_correlation(score_input(df, model), ScoreTask(model), len(model.columns), GROUP, list(model.groups))
    for group, matrix in found.items():
        set_dependence(model, group, matrix)
    return model


def set_dependence(model: CopulaModel, group: str, matrix: np.ndarray) -> None:
    model.correlation[group] = matrix
    model.factor[group] = cholesky_factor(matrix)


def cholesky_factor(matrix: np.ndarray) -> np.ndarray:
    """Repair to a valid correlation matrix (eigenvalues clipped, unit diagonal) and give its Cholesky factor; of one matrix or a stack."""
    values, vectors = np.linalg.eigh(matrix)
    repaired = (vectors * np.maximum(values, MIN_EIGENVALUE)[..., None, :]) @ vectors.swapaxes(-1, -2)
    scale = np.sqrt(np.diagonal(repaired, axis1=-2, axis2=-1))
    repaired = repaired / (scale[..., :, None] * scale[..., None, :])
    return np.linalg.cholesky(repaired + MIN_EIGENVALUE * np.eye(matrix.shape[-1]))


def fit_copula(df: DataFrame, columns: list[str], group: Column | None = None) -> CopulaModel:
    """Fit marginals and dependence of ``columns``, per ``group`` if given. Numeric columns get a quantile grid, all
    others are categories. The driver holds the grids and frequent values of every group, so groups must be few."""
    by_kind = kinds(df)
    numeric = [c for c in columns if by_kind[c] in (INTEGER, FLOAT)]
    categorical = [c for c in columns if c not in numeric]
    keyed = df.select(*[F.col(f"`{c}`") for c in columns],
                      (F.lit("") if group is None else group.cast("string")).alias(GROUP)).where(F.col(GROUP).isNotNull())
    with working_copy(keyed) as rows:
        return fit_dependence(rows, fit_marginals(rows, numeric, categorical))


class SampleTask:
    """Task side of sampling: latent normals, dependence, then each column's inverse marginal.

    ``starts`` are the row ids at which the rows of each group begin; they follow each other if it is not given."""

    def __init__(self, model: CopulaModel, counts: dict[str, int], seed: int, models: dict[str, str] | None = None,
                 starts: dict[str, int] | None = None):
        self.groups = list(counts)
        self.model_of = {g: (models or {}).get(g, g) for g in counts}
        used = set(self.model_of.values())
        self.ends = np.cumsum(list(counts.values()))
        self.shift = {g: starts[g] - (end - counts[g]) if starts else 0 for g, end in zip(counts, self.ends)}
        self.columns, self.numeric, self.seed = model.columns, len(model.numeric), seed
        self.factor = {g: model.factor[g] for g in used}
        self.marginals = {g: [model.groups[g][c] for c in self.columns] for g in used}
        self.gaps = {c for c in self.columns if any(model.groups[g][c].missing > 0 for g in used)}
        self.wide = model.wide
        self.step = max(1, CELLS // max(1, len(self.columns)))

    def __call__(self, batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            place = np.searchsorted(self.ends, ids, side="right")
            for g in np.unique(place):
                name = self.groups[g]
                mine = ids[place == g] + self.shift[name]
                for at in range(0, len(mine), self.step):
                    part = mine[at:at + self.step]
                    yield self.rows(name, part, self.latent(part))

    def latent(self, ids: np.ndarray) -> np.ndarray:
        return np.column_stack([draws.array_normal(self.seed, f"latent:{k}", ids) for k in range(len(self.columns))])

    def rows(self, group: str, ids: np.ndarray, latent: np.ndarray, centers: np.ndarray | float = 0.0) -> pa.RecordBatch:
        """Rows of one group; ``centers`` are the means of their scores."""
        fitted = self.model_of[group]
        units = gaussian.cdf(latent @ self.factor[fitted].T + centers)
        arrays = [pa.array(ids, pa.int64()), pa.array([group] * len(ids), pa.string())]
        tail: dict[str, list[pa.Array]] = {}
        for j, (c, m) in enumerate(zip(self.columns, self.marginals[fitted])):
            u = units[:, j]
            empty = np.zeros(len(ids), bool)
            if c in self.gaps:
                empty = draws.array_uniform(draws.stream_key(self.seed, f"missing:{c}"), ids) < m.missing
            if j < self.numeric:
                x = np.interp(u, np.arange(GRID + 1) / GRID, m.grid) if m.grid else np.zeros(len(ids))
                arrays.append(pa.array(x, pa.float64(), mask=empty | (not m.grid)))
                continue
            rare = (u > m.head) & ~empty if m.tail_values else np.zeros(len(ids), bool)
            if m.values:
                at = np.minimum(np.searchsorted(m.upper, u, side="left"), len(m.values) - 1)
                arrays.append(pa.DictionaryArray.from_arrays(pa.array(at, pa.int32(), mask=empty | rare),
                                                             pa.array(m.values, pa.string())).cast(pa.string()))
            else:
                arrays.append(pa.nulls(len(ids), pa.string()))
            if c in self.wide:
                t = np.clip((u - m.head) / max(1 - m.head, 1e-12), 0, 1 - 2**-53)
                cut = np.where(rare, np.floor(t * tails.slices_of(m.tail_values)), -1 - ids % tails.IDLE).astype(np.int64)
                tail[c] = [pa.array(t, pa.float64(), mask=~rare), pa.array(cut)]
        names = ["row_id", GROUP, *self.columns]
        if self.wide:
            arrays += [pa.array([fitted] * len(ids), pa.string()), *(a for c in self.wide for a in tail[c])]
            names += ["_fitted", *(f"{k}:{c}" for c in self.wide for k in ("_tail", "_slice"))]
        return pa.RecordBatch.from_arrays(arrays, names=names)


def sample_schema(numeric: list[str], categorical: list[str], wide: list[str]) -> T.StructType:
    return T.StructType(
        [T.StructField("row_id", T.LongType()), T.StructField(GROUP, T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in numeric] + [T.StructField(c, T.StringType()) for c in categorical]
        + [T.StructField("_fitted", T.StringType())] * bool(wide)
        + [f for c in wide for f in (T.StructField(f"_tail:{c}", T.DoubleType()), T.StructField(f"_slice:{c}", T.LongType()))])


def finished(rows: DataFrame, model: CopulaModel) -> DataFrame:
    """Sampled rows with their tail values and the types of the real columns."""
    filled = tails.fill_tails(rows, model.tails, model.wide) if model.wide else rows
    return filled.withColumns({c: F.col(f"`{c}`").cast(model.types[c]) for c in model.categorical})


def sample_copula(spark: SparkSession, model: CopulaModel, counts: dict[str, int], seed: int = 42,
                  models: dict[str, str] | None = None, starts: dict[str, int] | None = None) -> DataFrame:
    """Rows keyed by ``row_id`` with ``counts[group]`` rows per group; ``models`` names the fitted group that serves a
    group without a model of its own, ``starts`` the first row id of each group. Every draw depends only on seed and row id, so
    the rows are the same under any partitioning and after any retry."""
    counts = {g: n for g, n in counts.items() if n > 0}
    task = SampleTask(model, counts, seed, models, starts)
    rows = spark.range(sum(counts.values())).mapInArrow(lambda batches: task(batches), sample_schema(model.numeric, model.categorical, model.wide))
    return finished(rows, model)


def proportional_counts(sizes: dict[str, int], n: int) -> dict[str, int]:
    """Split exactly ``n`` rows over the groups by their sizes, the largest remainders first."""
    total = sum(sizes.values())
    exact = {g: n * s / total for g, s in sizes.items()}
    counts = {g: math.floor(v) for g, v in exact.items()}
    spare = n - sum(counts.values())
    for g in sorted(exact, key=lambda g: (counts[g] - exact[g], g))[:spare]:
        counts[g] += 1
    return counts
