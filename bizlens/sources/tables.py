"""Table sources and sinks.

Parquet is the native format: reads only name the needed columns so the
scan's ``ReadSchema`` is pruned and filters are pushed to the row groups.
CSV is bound by header name to a declared schema, never ``inferSchema``.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


# Column types of the driver tables that the library reads. A declared read
# schema skips the footer-reading inference job and prunes the scan.
TABLE_TYPES = {
    "customer": {"c_custkey": "BIGINT", "c_name": "STRING", "c_nationkey": "INT",
                 "c_acctbal": "DOUBLE", "c_mktsegment": "STRING"},
    "orders": {"o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "STRING",
               "o_totalprice": "DOUBLE", "o_orderdate": "TIMESTAMP_NTZ", "o_orderpriority": "STRING"},
    "lineitem": {"l_orderkey": "BIGINT", "l_partkey": "BIGINT", "l_suppkey": "BIGINT",
                 "l_linenumber": "INT", "l_quantity": "DOUBLE", "l_extendedprice": "DOUBLE",
                 "l_discount": "DOUBLE", "l_tax": "DOUBLE", "l_returnflag": "STRING",
                 "l_linestatus": "STRING", "l_shipdate": "TIMESTAMP_NTZ"},
    "events": {"event_id": "BIGINT", "ts": "TIMESTAMP_NTZ", "user_id": "BIGINT",
               "event_type": "STRING", "value": "DOUBLE", "props": "STRING"},
    "nation": {"n_nationkey": "INT", "n_name": "STRING", "n_regionkey": "INT"},
}


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table, projected to ``columns`` right at the scan."""
    types = TABLE_TYPES.get(name)
    if columns and types and all(c in types for c in columns):
        ddl = ", ".join(f"{c} {types[c]}" for c in columns)
        return spark.read.schema(ddl).parquet(table_path(sf_dir, name))
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


# Cell texts that mean "no value" in the CSV files the jobs exchange.
NA_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
            "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV file(s) with a header row (S1), as the columns and types of ``schema``.

    Columns are found by their header name, whatever their order; a column
    that the header lacks is an error. Quotes inside a quoted cell are doubled.
    The usual words for a missing value are null (the word ``none`` is a value), and
    a cell that its type can't hold is an error.
    """
    cells = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
             .option("inferSchema", False).csv(path))
    return cells.select(*[
        F.when(~F.col(f"`{f.name}`").isin(*NA_WORDS), F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Sequence[str] | None = None) -> None:
    """Overwrite ``path`` with ``df`` (S2). Parents are created by the writer."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
