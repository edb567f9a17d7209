import os

import numpy as np
from pyspark.sql import functions as F

from tabloom.operators import moments, scoring
from tabloom.queries import scoring as queries
from tabloom.session import ensure_checkpoint_dir


def _kept(spark):
    """Bytes under the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    top = spark.sparkContext._jsc.sc().getCheckpointDir().get().split(":")[-1]
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(top) for f in files)


def test_wide_tables_are_not_copied(spark, folder):
    before = _kept(spark)
    assert queries.correlation_wide(spark, folder).count() == len(queries._WIDE_PAIRS)
    assert _kept(spark) == before


def test_many_columns_with_gaps_come_as_one_array(spark):
    width, at = moments.MANY + 5, np.arange(400)
    x = np.column_stack([np.sin(at * (k + 1) / 7.0) + 1e6 * k for k in range(width)])
    x[(at[:, None] + np.arange(width)) % 11 == 0] = np.nan
    df = spark.createDataFrame([(*(None if np.isnan(v) else float(v) for v in row),) for row in x], ", ".join(f"`c.{k}` double" for k in range(width)))
    assert len(moments.number_rows(df, df.columns, F.lit("").alias("grp")).drop("gap").columns) == 2
    got = {(r["a"], r["b"]): r["real"] for r in scoring.correlations(df, df).collect()}
    assert len(got) == width * (width - 1) // 2
    for i, j in ((0, 1), (3, 17), (width - 2, width - 1)):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert abs(got[f"c.{i}", f"c.{j}"] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 6e-4
