"""Delimited files, database tables and literal tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Comma-separated file with a header and ``NA`` for missing. Give the schema to save the pass that
    infers it."""
    reader = spark.read.option("header", True).option("nullValue", "NA")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Folder of comma-separated files with headers and ``NA`` for missing."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def read_table(spark: SparkSession, table: str, url: str | None = None, **options) -> DataFrame:
    """A catalog table, or with ``url`` a database table; filters and columns are pushed to either.

    Connection options (user, password, partitionColumn, lowerBound, upperBound, numPartitions …) are
    the caller's.
    """
    if url is None:
        return spark.table(table)
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table written out in code."""
    return spark.createDataFrame(list(rows), schema)
