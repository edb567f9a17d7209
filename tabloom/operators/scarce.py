"""Classes with too few rows for a model of their own: one model of all their rows, conditioned on the class.

The scores of a row are Gaussian together with the mean scores of its class. Given the class, a row has the class's means, and
the covariance is the Schur complement: that of all rows less that of the means. So the means are a table keyed by class, and one small
matrix serves any number of classes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.copula import GROUP, MIN_EIGENVALUE, CopulaModel, SampleTask, ScoreTask, finished, sample_schema, score_input
from tabloom.operators.keyed_copula import ids_of, jobs_of, named
from tabloom.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def class_means(rows: DataFrame, model: CopulaModel, group: str) -> DataFrame:
    """(value, n, means): the mean score of each column for each ``_value`` of ``rows``, in units of all rows' deviation from their mean.
    A missing value counts as an average one."""
    task, width = ScoreTask(model), range(len(model.columns))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.nan_to_num(task(group, pa.Table.from_batches([batch])))
            yield pa.RecordBatch.from_arrays([batch.column("value"), *(pa.array(scores[:, j]) for j in width)], ["value", *(f"s{j}" for j in width)])

    inputs = score_input(rows, model, F.col("_value").alias("value"))
    scores = inputs.mapInArrow(scored, ", ".join(["value string", *(f"s{j} double" for j in width)]))
    classes = materialize(scores.groupBy("value").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"s{j}").alias(f"m{j}") for j in width],
                                                      *[F.avg(F.col(f"s{j}") ** 2).alias(f"q{j}") for j in width]))
    sums = classes.agg(F.sum("n"), *[F.sum(F.col("n") * F.col(f"m{j}")) for j in width], *[F.sum(F.col("n") * F.col(f"q{j}")) for j in width]).first()
    mean, square = (np.array(sums[k:k + len(width)]) / sums[0] for k in (1, 1 + len(width)))
    deviation = np.sqrt(np.maximum(square - mean**2, 0))
    units = [((F.col(f"m{j}") - float(mean[j])) / float(deviation[j])) if deviation[j] > 1e-9 else F.lit(0.0) for j in width]
    return classes.select("value", "n", F.array(*units).alias("means"))


def spread_of_means(classes: DataFrame, width: int) -> np.ndarray:
    """The covariance of the class means over all rows, from sums of products in the tasks."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            means = batch.column("means").flatten().to_numpy().reshape(-1, width)
            total += (means * batch.column("n").to_numpy()[:, None]).T @ means
        at = np.arange(width * width)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "product"])

    found = classes.select("n", "means").mapInArrow(summed, "at long, product double").groupBy("at").agg(F.sum("product").alias("product"))
    matrix = np.zeros(width * width)
    for r in found.collect():  # a number for each pair of columns
        matrix[r["at"]] = r["product"]
    return matrix.reshape(width, width) / classes.agg(F.sum("n")).first()[0]


def condition(rows: DataFrame, model: CopulaModel, group: str) -> DataFrame:
    """Condition the model of ``group`` on the class of its ``rows`` (``_value``); gives the means of the classes."""
    classes = class_means(rows, model, group)
    inside = model.correlation[group] - spread_of_means(classes, len(model.columns))
    values, vectors = np.linalg.eigh((inside + inside.T) / 2)
    model.factor[group] = np.linalg.cholesky(vectors @ np.diag(np.maximum(values, MIN_EIGENVALUE)) @ vectors.T + MIN_EIGENVALUE * np.eye(len(values)))
    return classes.select("value", "means")


def sample_scarce(model: CopulaModel, plan: DataFrame, means: DataFrame, group: str, seed: int = 42) -> DataFrame:
    """Rows keyed by ``row_id`` for each (value, rows, start) of ``plan`` from the conditioned model of ``group``, the value as GROUP."""
    task, width = SampleTask(model, {group: 1}, seed), len(model.columns)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centers = batch.column("means").flatten().to_numpy().reshape(-1, width)
            for ids, place in ids_of(batch):
                yield named(task.rows(group, ids, task.latent(ids), centers[place]), batch.column("value"), place)

    jobs = jobs_of(plan.join(means, "value"), "means")
    return finished(jobs.mapInArrow(made, sample_schema(model.numeric, model.categorical, model.wide)), model)
