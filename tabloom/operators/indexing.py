"""Row keys and dense row numbers without a single-partition sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.session import materialize

ROWS_PER_BUCKET = 500_000
MAX_PREFIX = 5


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """A stable unique id for tables that have no key of their own.

    The ids are written with the rows to the checkpoint folder before use: a task that is repeated after an executor
    is lost then reads the same ids instead of numbering its rows anew.
    """
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


def key_digest(keys: list[Column]) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]))


def dense_index(df: DataFrame, keys: list[str], within: str | None = None, name: str = "idx") -> tuple[DataFrame, DataFrame]:
    """Number the rows 0, 1, 2, ... in the order of md5(keys), separately per value of ``within`` if given.

    Rows fall into equal buckets by the first hex digits of the digest, which a hot ``within`` value cannot unbalance.
    Each bucket is numbered on its own and shifted by the sizes of the buckets before it, so no task sorts more
    than a bucket. Returns the numbered rows and the pool sizes (``within``, ``size``).
    """
    group = [F.col(f"`{within}`").alias("_pool")] if within else [F.lit("").alias("_pool")]
    digest = key_digest([F.col(f"`{k}`") for k in keys])
    tagged = df.select("*", *group, digest.alias("_digest")).where(F.col("_pool").isNotNull())
    total = df.count()
    prefix = 1
    while prefix < MAX_PREFIX and total / 16**prefix > ROWS_PER_BUCKET:
        prefix += 1
    tagged = tagged.withColumn("_bucket", F.substring("_digest", 1, prefix))
    sizes = tagged.groupBy("_pool", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_pool").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_pool", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_pool", "_bucket").orderBy("_digest", *[F.col(f"`{k}`") for k in keys])
    numbered = (
        tagged.withColumn("_row", F.row_number().over(inside))
        .join(starts, ["_pool", "_bucket"])
        .withColumn(name, F.col("_start") + F.col("_row") - 1)
    )
    pools = sizes.groupBy("_pool").agg(F.sum("_n").alias("size"))
    dropped = ["_digest", "_bucket", "_start", "_row", "_pool"]
    return numbered.drop(*dropped), pools.withColumnRenamed("_pool", within or "pool")


def with_running_sum(df: DataFrame, order: list[str | Column], amount: str, name: str) -> DataFrame:
    """Add ``name``: the sum of the whole numbers ``amount`` over all rows before a row in ``order``, which must be unique.

    Rows are cut into ranges of the order; a task sums its range as it writes it, and the sums of the ranges before it are added when
    rows are read.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField(name, T.LongType())])
    at = df.columns.index(amount)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            mine = batch.column(at).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            upto = done + np.cumsum(mine)
            if len(mine):
                done = int(upto[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - mine)], names=schema.names)

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged.mapInArrow(summed, schema))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    bases = ranged.groupBy("_part").agg(F.sum(amount).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    return ranged.join(F.broadcast(bases), "_part").withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base")
