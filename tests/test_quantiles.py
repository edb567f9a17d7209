from functools import partial

import numpy as np
from pyspark.sql import functions as F

from tabloom.functions import quantiles
from tabloom.functions.quantiles import exact_quantiles, grouped_quantiles
from tabloom.operators import copula
from tabloom.queries import generation

PROBS = [i / 20 for i in range(21)]


def test_grouped_quantiles_are_those_of_percentile(spark):
    df = spark.range(20_000, numPartitions=5).select(
        F.when(F.col("id") < 3, "few").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 2).cast("string")).alias("g"),
        F.when(F.col("id") % 11 > 0, F.sin("id") * 1000).alias("spread"), (F.floor(F.abs(F.sin("id")) * 3)).alias("ties"),
        F.when(F.col("id") % 5 > 0, F.lit(float("nan"))).otherwise(F.col("id").cast("double")).alias("nan"), F.when(F.col("g") == "1", F.col("id")).alias("gap"))
    columns = ["spread", "ties", "nan", "gap"]
    requests = {c: (F.col(c), PROBS) for c in columns}
    want = {str(r["g"]): r for r in df.groupBy("g").agg(*[F.percentile(c, F.array(*map(F.lit, PROBS))).alias(c) for c in columns]).collect()}
    for found in (grouped_quantiles(df, "g", requests, value_budget=0), grouped_quantiles(df, "g", requests, value_budget=0, accuracy=20), grouped_quantiles(df, "g", requests)):
        assert found.keys() == want.keys()
        for g, r in want.items():
            for c in columns:
                assert repr(found[g][c]) == repr(list(r[c]) if r[c] is not None else [None] * len(PROBS)), (g, c)


def test_exact_grids_and_properties_without_a_buffer_of_all_values(spark, folder, monkeypatch):
    def answers():
        return [sorted(query(spark, folder).collect()) for query in (generation.copula_marginals, generation.copula_sample_properties, generation.mixture_two_peaks)]

    short = answers()
    for module in (copula, generation):
        monkeypatch.setattr(module, "grouped_quantiles", partial(grouped_quantiles, value_budget=0))
    assert answers() == short


def test_counted_bins_hold_the_ranks_without_a_sketch(spark, monkeypatch):
    values = np.concatenate([np.random.default_rng(2).normal(50, 9, 6000), np.zeros(3900), [-700.0, 2500.0]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    requests = {"x": (F.col("x"), PROBS), "nonzero": (F.when(F.col("x") != 0, F.col("x")), [0.5]), "same": (F.lit(4.0), [0.5])}
    want = {"x": np.quantile(values, PROBS), "nonzero": [np.median(values[values != 0])], "same": [4.0]}
    with monkeypatch.context() as patch:
        patch.delattr(quantiles.F, "percentile_approx")
        found = exact_quantiles(df, requests, value_budget=0, bracket_limit=100)
    far = np.concatenate([values, [-1e308, 1e308, 1e300, float("inf")]])  # one bin for nearly all, and a width that is no number
    wide = spark.createDataFrame([(float(v),) for v in far], "x double")
    sketched = [exact_quantiles(rows, {"x": (F.col("x"), PROBS[:-1])}, value_budget=0, bracket_limit=100)["x"] for rows in (wide, wide.where("x < 1e307"))]
    assert all(np.allclose(found[n], want[n], rtol=1e-12) for n in want)
    assert all(np.allclose(x, np.quantile(v, PROBS[:-1]), rtol=1e-12) for x, v in zip(sketched, (far, far[far < 1e307])))
