"""Copulas of any number of groups: plan, grids, category shares and factors stay tables keyed by group.

The parameters of a group reach the rows they belong to by the same hash partition, sorted in front of them, so a
task holds one group at a time and the driver none. It serves groups that hold a small share of the rows each; the few
large ones are fitted without a shuffle by ``copula``. Only sums of products leave the tasks of the fit.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import gaussian
from tabloom.functions.kinds import FLOAT, INTEGER, kinds
from tabloom.operators import tails
from tabloom.operators.copula import (ACCURACY, GRID, GROUP, CopulaModel, Marginal, SampleTask, ScoreTask, category_marginal, cholesky_factor, finished,
                                      sample_schema, score_input)
from tabloom.operators.indexing import with_running_sum
from tabloom.operators.moments import MomentTask
from tabloom.session import discard, materialize

#: Seats that the generated rows of a group with many of them are dealt over.
SALTS = 64
#: Generated rows that a task holds at once.
CHUNK = 10_000
#: Numbers of the matrices or scores of several groups that a task works on at once.
STACK = 1 << 16

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class KeyedModel:
    """``table``: a row per group with its name, ``size`` and ``params``, the struct that ``one_group`` reads."""

    numeric: list[str]
    categorical: list[str]
    types: dict[str, str]
    table: DataFrame
    wide: list[str] = field(default_factory=list)
    tails: DataFrame | None = None

    @cached_property
    def size(self) -> int:
        return self.table.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    @cached_property
    def _medians(self) -> dict[str, float]:
        sums = [F.coalesce(F.sum(F.col("size") * F.col("params.grids")[i][GRID // 2]) / F.sum("size"), F.lit(0.0)) for i in range(len(self.numeric))]
        return dict(zip(self.numeric, self.table.agg(*sums).first())) if sums else {}

    def median(self, column: str) -> float:
        """Size-weighted median over the groups, used to fill gaps of whole-number columns."""
        return self._medians[column]


def one_group(params: dict, numeric: list[str], categorical: list[str], wide: list[str]) -> CopulaModel:
    """The model of a single group, in a task."""
    name, size = params["name"], params["size"]
    found = {c: Marginal() for c in numeric + categorical}
    for c, grid, n in zip(numeric, params["grids"], params["present"]):
        found[c] = Marginal(grid=grid if n else [], missing=1 - n / size)
    for entry in params["shares"] or []:
        found[entry["column"]] = category_marginal([(p["value"], p["n"]) for p in entry["pairs"]], size, entry["tail_n"], entry["tail_values"])
    model = CopulaModel(numeric, categorical, {}, {name: found}, {name: size}, wide=wide)
    if params.get("factor") is not None and len(params["factor"]):
        model.factor[name] = np.array(params["factor"]).reshape(len(found), len(found))
    return model


def beside_params(rows: DataFrame, params: DataFrame, seats: DataFrame) -> DataFrame:
    """``rows`` with (GROUP, _salt) behind a row with the ``params`` of their group; ``seats`` are the salts of each group."""
    ours = rows.select(GROUP, "_salt", F.lit(None).cast(params.schema["params"].dataType).alias("params"), *[c for c in rows.columns if c not in (GROUP, "_salt")])
    heads = params.select(GROUP, "params").join(seats, GROUP)
    both = heads.select(GROUP, "_salt", "params").unionByName(ours, allowMissingColumns=True)
    return both.repartition(GROUP, "_salt").sortWithinPartitions(GROUP, "_salt", F.col("params").isNull())


def by_params(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, pa.RecordBatch]]:
    """Stretches of rows of one seat, with the parameters where they change and None where the stretch goes on."""
    for batch in batches:
        column = batch.column("params")
        at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        if not len(at) or at[0]:
            yield None, batch.slice(0, int(at[0]) if len(at) else batch.num_rows)
        heads = plain_params(column.take(pa.array(at))) if len(at) else []
        for params, a, b in zip(heads, at.tolist(), [*at[1:].tolist(), batch.num_rows]):
            yield params, batch.slice(a + 1, b - a - 1)


def plain_params(column: pa.StructArray) -> Iterator[dict]:
    """The parameters of many groups as Python values; lists of numbers are taken from the buffers, as number by number they cost most of a task."""
    fields = [f.name for f in column.type]
    grids, factor = column.field("grids"), column.field("factor") if "factor" in fields else None
    cuts, ends, numbers = grids.offsets.to_pylist(), grids.values.offsets.to_pylist(), grids.values.values.to_numpy(zero_copy_only=False)
    rest = {f: column.field(f).to_pylist() for f in fields if f not in ("grids", "factor")}
    if factor is not None:
        own, entries = factor.offsets.to_pylist(), factor.values.to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        params = {f: values[i] for f, values in rest.items()}
        params["grids"] = [numbers[ends[j]:ends[j + 1]].tolist() for j in range(cuts[i], cuts[i + 1])]
        if factor is not None:
            params["factor"] = entries[own[i]:own[i + 1]]
        yield params


def correlation(sums: np.ndarray) -> np.ndarray:
    """Correlation matrices from sums of products, 0 where a side does not vary over the rows both have."""
    n, sa, sb, saa, sbb, sab = sums
    var_a, var_b, floor = n * saa - sa * sa, n * sbb - sb * sb, 1e-9 * n * n
    sure = (n > 1) & (var_a > floor) & (var_b > floor)
    root = np.sqrt(np.where(sure, var_a, 1.0)) * np.sqrt(np.where(sure, var_b, 1.0))
    upper = np.triu(np.clip(np.where(sure, (n * sab - sa * sb) / root, 0.0), -1.0, 1.0), 1)
    return upper + upper.swapaxes(-1, -2) + np.eye(n.shape[-1])


def fit_keyed(rows: DataFrame, columns: list[str]) -> KeyedModel:
    """Fit ``columns`` per GROUP; a group's rows are brought to one task."""
    by_kind = kinds(rows)
    numeric = [c for c in columns if by_kind[c] in (INTEGER, FLOAT)]
    categorical = [c for c in columns if c not in numeric]
    width, probs = len(columns), [i / GRID for i in range(GRID + 1)]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    numbers = [F.col(f"`{c}`").cast("double") for c in numeric]
    grids = rows.groupBy(GROUP).agg(F.count(F.lit(1)).alias("size"), *[F.percentile_approx(x, probs, ACCURACY).alias(f"g{i}") for i, x in enumerate(numbers)],
                                    *[F.count(x).alias(f"n{i}") for i, x in enumerate(numbers)], *[F.count(F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, c in enumerate(categorical)])
    shares, present = "array<struct<column: string, pairs: array<struct<value: string, n: bigint>>, tail_n: bigint, tail_values: bigint>>", None
    if categorical:
        grids = materialize(grids)
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("present")) for i, c in enumerate(categorical)]))
        present = grids.select(GROUP, each.alias("each")).select(GROUP, "each.*")
        counts = materialize(tails.category_counts(rows, categorical))
        lists = tails.listed(counts, present)
        grids = grids.join(lists.groupBy(GROUP).agg(F.collect_list(F.struct("column", "pairs", "tail_n", "tail_values")).alias("shares")), GROUP, "left")
    else:
        grids = grids.withColumn("shares", F.lit(None))
    parts = [F.col(GROUP).alias("name"), F.col("size"), F.array(*[f"g{i}" for i in range(len(numeric))]).cast("array<array<double>>").alias("grids"),
             F.array(*[f"n{i}" for i in range(len(numeric))]).cast("array<bigint>").alias("present"), F.col("shares").cast(shares).alias("shares")]
    marginals = materialize(grids.select(GROUP, "size", F.struct(*parts).alias("params")))
    model = CopulaModel(numeric, categorical, types, {}, {})
    if categorical:
        entries = marginals.select(F.explode("params.shares").alias("entry")).where("entry.tail_values > 0")
        tailed = {r[0] for r in entries.select("entry.column").distinct().collect()}
        model.wide = [c for c in categorical if c in tailed]
        if model.wide:
            model.tails = tails.tail_table(counts.where(F.col("column").isin(*model.wide)), present)
        discard(counts)

    salted = score_input(rows, model).withColumn("_salt", F.lit(0))
    seats = marginals.select(GROUP, F.lit(0).alias("_salt"))
    wide = model.wide

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, totals, waiting, held = [], [], [], 0  # what costs the same for a group as for many is done for many at a time

        def settle() -> None:
            scores = np.split(gaussian.inverse_cdf(np.concatenate([u for _, u in waiting])), np.cumsum([len(u) for _, u in waiting])[:-1])
            for (k, _), mine in zip(waiting, scores):
                totals[k] += MomentTask._sums(mine)
            waiting.clear()

        def row() -> pa.RecordBatch:
            if waiting:
                settle()
            flat = cholesky_factor(correlation(np.stack(totals, axis=1))).reshape(-1)
            each = pa.array(np.arange(len(names) + 1) * width * width, pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.ListArray.from_arrays(each, pa.array(flat))], [GROUP, "factor"])

        for params, batch in by_params(batches):
            if params is not None:
                if len(names) * width * width >= STACK:
                    yield row()
                    names, totals, held = [], [], 0
                names.append(params["name"])
                totals.append(np.zeros((6, width, width)))
                score = ScoreTask(one_group(params, numeric, categorical, wide))
            if batch.num_rows:
                waiting.append((len(names) - 1, score.units(names[-1], batch.select(batch.schema.names[3:]))))
                held += batch.num_rows * width
                if held >= STACK:
                    settle()
                    held = 0
        if names:
            yield row()

    found = beside_params(salted, marginals, seats).mapInArrow(factors, f"{GROUP} string, factor array<double>")
    table = marginals.join(found, GROUP).withColumn("params", F.col("params").withField("factor", F.col("factor"))).drop("factor")
    return KeyedModel(numeric, categorical, types, materialize(table), model.wide, model.tails)


def with_starts(plan: DataFrame) -> DataFrame:
    """Add ``start``: the sum of ``rows`` of all smaller values."""
    return materialize(with_running_sum(plan, ["value"], "rows", "start"))


def jobs_of(plan: DataFrame, *more: Column | str) -> DataFrame:
    """Ranges of row ids (value, low, high), of ``CHUNK`` rows at most, for each (value, rows, start) of ``plan``; and the seat of a range."""
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK)))
    return plan.where("rows > 0").select("*", chunk.alias("_k")).select(
        *more, F.pmod(F.when(F.col("rows") > CHUNK, F.col("_k")).otherwise(F.xxhash64("value")), F.lit(SALTS)).cast("int").alias("_salt"), "value",
        (F.col("start") + F.col("_k") * CHUNK).alias("low"), F.least(F.col("start") + F.col("rows"), F.col("start") + (F.col("_k") + 1) * CHUNK).alias("high"))


def ids_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row ids of the jobs in ``batch`` and the place of each id's job, ``CHUNK`` ids or one job at a time."""
    low, high = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("low", "high"))
    at = 0
    while at < batch.num_rows:
        sizes = high[at:] - low[at:]
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes), CHUNK, side="right")))
        sizes = sizes[:end - at]
        yield np.repeat(low[at:end] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum())), np.repeat(np.arange(at, end), sizes)
        at = end


def named(batch: pa.RecordBatch, values: pa.Array, place: np.ndarray) -> pa.RecordBatch:
    """Generated rows with the value of their job as GROUP."""
    return pa.RecordBatch.from_arrays([batch.column(0), values.take(pa.array(place)), *batch.columns[2:]], names=batch.schema.names)


def sample_keyed(model: KeyedModel, plan: DataFrame, seed: int = 42) -> DataFrame:
    """Rows keyed by ``row_id`` for each (value, rows, start) of ``plan``, from the model of its GROUP, with the value as GROUP.
    Every draw depends only on seed and row id."""
    numeric, categorical, wide = model.numeric, model.categorical, model.wide
    jobs = jobs_of(plan, GROUP)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, task, waiting, held = None, None, [], 0

        def block() -> pa.RecordBatch:
            """The rows of all jobs that wait: their draws depend on seed and row id alone, so they are made at once."""
            latent = np.split(waiting[0][1].latent(np.concatenate([w[2] for w in waiting])), np.cumsum([len(w[2]) for w in waiting])[:-1])
            parts = [named(task.rows(name, ids, mine), values, place) for (name, task, ids, values, place), mine in zip(waiting, latent)]
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        for params, batch in by_params(batches):
            if params is not None:
                name, task = params["name"], SampleTask(one_group(params, numeric, categorical, wide), {params["name"]: 1}, seed)
            for ids, place in ids_of(batch):
                waiting.append((name, task, ids, batch.column("value"), place))
                held += len(ids)
                if held >= CHUNK:
                    yield block()
                    waiting, held = [], 0
        if held:
            yield block()

    rows = beside_params(jobs, model.table, jobs.select(GROUP, "_salt").distinct()).mapInArrow(made, sample_schema(numeric, categorical, wide))
    return finished(rows, model)
