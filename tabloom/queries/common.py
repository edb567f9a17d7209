"""Shared inputs of the queries and SQL building blocks of their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Book:
    """Queries and their SQL, filled by the ``add`` decorator."""

    def __init__(self):
        self.queries = {}
        self.oracles = {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = sql
            return fn
        return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# Column kinds of the test tables, for the SQL builders.
COLUMNS = {
    "lineitem": {"l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer",
                 "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
                 "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "temporal"},
    "orders": {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "float",
               "o_orderdate": "temporal", "o_orderpriority": "string"},
    "customer": {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "float",
                 "c_mktsegment": "string"},
    "part": {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer",
             "p_retailprice": "float"},
    "supplier": {"s_suppkey": "integer", "s_name": "string", "s_nationkey": "integer", "s_acctbal": "float"},
    "nation": {"n_nationkey": "integer", "n_name": "string", "n_regionkey": "integer"},
    "events": {"event_id": "integer", "ts": "temporal", "user_id": "integer", "event_type": "string", "value": "float",
               "props": "string"},
    "documents": {"doc_id": "integer", "text": "string", "lang": "string", "source": "string", "n_chars": "integer"},
    "labels": {"doc_id": "integer", "quality": "integer", "toxic": "integer"},
    "pages": {"page_id": "integer", "url": "string"},
    "benchmark": {"item_id": "integer", "text": "string"},
    "dirty": {"o_orderkey": "integer", "o_totalprice": "float", "discount_amt": "float", "note": "string",
              "empty_col": "float", "const_col": "string", "free_key": "string", "rare_cat": "string",
              "o_orderdate": "temporal", "flag": "integer"},
}

DIRTY_SELECT = """SELECT o_orderkey,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 97 = 1 THEN o_totalprice * 50 ELSE o_totalprice END
        AS o_totalprice,
    CASE WHEN o_orderkey % 5 < 2 THEN cast(0 AS DOUBLE) ELSE o_totalprice / cast(100 AS DOUBLE) END AS discount_amt,
    CASE WHEN o_orderkey % 4 <> 0 THEN NULL ELSE o_orderpriority END AS note,
    cast(NULL AS DOUBLE) AS empty_col, 'x' AS const_col,
    concat('k', cast(o_orderkey % (SELECT cast(floor(count(*) * cast(0.6 AS DOUBLE)) AS BIGINT) FROM orders) AS VARCHAR(20))) AS free_key,
    CASE WHEN o_orderkey % 500 = 0 THEN 'z' ELSE o_orderstatus END AS rare_cat,
    o_orderdate, cast(CASE WHEN o_orderkey % 10 = 1 THEN 1 ELSE 0 END AS INTEGER) AS flag
FROM orders"""

DIRTY = f"({DIRTY_SELECT})"


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with missing values, zeros, outliers, an empty, a constant, a key-like and a rare-category column."""
    orders = table(spark, folder, "orders")
    text = DIRTY_SELECT.replace("VARCHAR(20)", "STRING").replace("FROM orders", "FROM {orders}")
    return spark.sql(text, orders=orders)


ROW_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "price_cents"]


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Lineitem plus the derived revenue, the class it falls in, and the price in cents (part of the row key)."""
    revenue = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    return table(spark, folder, "lineitem").withColumns({
        "rev": revenue, "price_cents": F.round(F.col("l_extendedprice") * 100).cast("long"),
    }).withColumn("big", (F.col("rev") > 45000).cast("int"))


SALES = """(SELECT *, l_extendedprice * (1e0 - l_discount) AS rev, cast(round(l_extendedprice * 100) AS BIGINT) AS price_cents,
    cast(l_extendedprice * (1e0 - l_discount) > 45000 AS INTEGER) AS big FROM lineitem)"""


_SIDE = "(l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7 + l_linenumber + price_cents) % 2"


def halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two disjoint halves of the sales table."""
    rows = sales(spark, folder)
    return rows.where(f"{_SIDE} = 0"), rows.where(f"{_SIDE} = 1")


def unit_sql(seed: int, stream: str, *keys: str, part: int = 0) -> str:
    """SQL of a hashed uniform draw; ``part`` 1 is the second half of the digest."""
    text = " || '|' || ".join([f"'{seed}|{stream}'"] + [f"coalesce(cast({k} AS VARCHAR), '')" for k in keys])
    return f"((('0x' || substr(md5({text}), {1 + 13 * part}, 13))::BIGINT + 0.5e0) / 4503599627370496e0)"


def normal_sql(seed: int, stream: str, *keys: str) -> str:
    first, second = unit_sql(seed, stream, *keys), unit_sql(seed, stream, *keys, part=1)
    return f"(sqrt(-2e0 * ln({first})) * cos(2e0 * pi() * {second}))"


REAL_HALF = f"(SELECT * FROM {SALES} WHERE {_SIDE} = 0)"
OTHER_HALF = f"(SELECT * FROM {SALES} WHERE {_SIDE} = 1)"


def facts_sql(rel: str, columns: dict[str, str]) -> str:
    """One row per column with every fact the profile rules need."""
    parts = []
    for i, (c, kind) in enumerate(columns.items()):
        numeric = kind in ("integer", "float")
        x = f"cast({c} AS DOUBLE)"
        if numeric:
            more = f"""count(*) FILTER ({c} = 0) AS num_zeros, avg({x}) AS mean, stddev_samp({x}) AS std,
                min({x}) AS low, max({x}) AS high, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3,
                quantile_cont({x}, 0.5) FILTER ({c} <> 0) AS nonzero_median,
                NULL AS low_text, NULL AS high_text"""
            spread = f"""(SELECT count(*) FROM {rel} t WHERE abs(cast(t.{c} AS DOUBLE) - f.mean) > 3 * f.std) AS num_outliers,
                CASE WHEN q3 > q1 THEN (SELECT count(*) FROM {rel} t WHERE t.{c} < f.q1 - 1.5 * (f.q3 - f.q1)
                    OR t.{c} > f.q3 + 1.5 * (f.q3 - f.q1)) ELSE 0 END AS num_iqr"""
        else:
            ends = f"min({c}) AS low_text, max({c}) AS high_text" if kind == "string" else "NULL AS low_text, NULL AS high_text"
            more = f"""0 AS num_zeros, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS low, NULL::DOUBLE AS high,
                NULL::DOUBLE AS q1, NULL::DOUBLE AS q3, NULL::DOUBLE AS nonzero_median, {ends}"""
            spread = "0 AS num_outliers, 0 AS num_iqr"
        parts.append(f"""SELECT f.*, {spread},
            coalesce((SELECT max(k) FROM (SELECT count(*) AS k FROM {rel} t WHERE {c} IS NOT NULL GROUP BY {c})), 0) AS top_count
            FROM (SELECT {i} AS ordinal, '{c}' AS "column", '{kind}' AS storage, count(*) AS n_rows,
                count(*) - count({c}) AS num_missing, count(DISTINCT {c}) AS num_unique, {more} FROM {rel}) f""")
    return " UNION ALL ".join(f"({p})" for p in parts)


def typed_sql(rel: str, columns: dict[str, str]) -> str:
    """Facts plus the inferred column type."""
    return f"""SELECT *, CASE
        WHEN storage = 'temporal' THEN 'datetime'
        WHEN num_unique = 2 AND ((storage IN ('integer', 'float') AND low = 0 AND high = 1)
            OR (low_text IN ('yes', 'no', 'true', 'false') AND high_text IN ('yes', 'no', 'true', 'false'))) THEN 'boolean'
        WHEN num_unique / n_rows > 0.95 AND n_rows > 20 AND storage <> 'float' THEN 'id_column'
        WHEN storage = 'string' AND num_unique / n_rows > 0.5 THEN 'categorical_high'
        WHEN storage = 'string' THEN 'categorical_low'
        WHEN storage = 'float' OR num_unique > 20 THEN 'numerical_continuous'
        ELSE 'numerical_discrete' END AS col_type FROM ({facts_sql(rel, columns)})"""


def union_sql(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)
