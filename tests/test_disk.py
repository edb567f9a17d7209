import os
import time

import pyarrow.parquet as pq

from tabloom.operators import copula, tails
from tabloom.session import discard, ensure_checkpoint_dir, materialize


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_") and f.endswith(".data")}


def _tables(spark):
    ensure_checkpoint_dir(spark)
    top = spark.sparkContext._jsc.sc().getCheckpointDir().get().split(":")[-1]
    return {os.path.join(top, d) for d in os.listdir(top)} if os.path.isdir(top) else set()


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = _shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    made = materialize(spark.range(20_000).selectExpr("id % 9973 AS k").groupBy("k").count())
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before and made.count() == 9973
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_a_discarded_table_is_gone(spark):
    made = materialize(spark.range(10).toDF("k"))
    place = made.inputFiles()[0].split("://")[-1].rsplit("/", 1)[0]
    discard(made)
    assert not os.path.exists(place)


def test_a_tail_is_stored_once_with_a_row_for_each_value(spark, monkeypatch):
    monkeypatch.setattr(tails, "HEAD", 8)
    df = spark.range(5000).selectExpr("id * 1.0 AS x", "concat('v', id) AS v")
    before = _tables(spark)
    model = copula.fit_copula(df, ["x", "v"])
    files = [pq.ParquetFile(os.path.join(t, f)) for t in _tables(spark) - before for f in os.listdir(t) if f.endswith(".parquet")]
    assert sum(f.metadata.num_rows for f in files if "value" in f.schema_arrow.names) == 5000
    assert model.tails.select("value").distinct().count() == 5000 and model.tails.count() < 5000 * 1.2
