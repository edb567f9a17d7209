"""Small driver-side results (per column, per class) as local relations, so using them starts no Python job."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    struct = T.DataType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [() for _ in struct.fields]
    arrays = [pa.array(list(values), type=to_arrow_type(f.dataType)) for values, f in zip(columns, struct.fields)]
    table = pa.Table.from_arrays(arrays, names=struct.names)
    return spark.createDataFrame(table, schema=struct)
