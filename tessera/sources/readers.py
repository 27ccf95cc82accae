"""Arrays from files, tables and queries."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from ..operators.array import CoordArray


def read_parquet(spark: SparkSession, path: str | list[str], value, dims, schema=None, **options: Any) -> CoordArray:
    """An array of Parquet files or partitioned folders. A schema is needed only for empty data."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return CoordArray.from_coo(reader.parquet(*([path] if isinstance(path, str) else path)), value, dims, **options)


def read_csv(spark: SparkSession, path: str | list[str], value, dims, schema=None, **options: Any) -> CoordArray:
    """An array of CSV files with a header, gzipped or not; without a schema one more pass infers it."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return CoordArray.from_coo(reader.csv(path), value, dims, **options)


def read_table(spark: SparkSession, name: str, value, dims, **options: Any) -> CoordArray:
    return CoordArray.from_coo(spark.table(name), value, dims, **options)


def read_sql(spark: SparkSession, query: str, value, dims, **options: Any) -> CoordArray:
    return CoordArray.from_coo(spark.sql(query), value, dims, **options)
