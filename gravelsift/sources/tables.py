"""Relational tables over JDBC, read in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table (or a query in brackets with a name). key: a whole-number column (quoted as the database wants it) by whose range it is read in `parts` tasks.

    The range is asked of the database first, one row. Rows whose key is null are in the first part. Without a key, or for
    an empty table, one task reads all.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if key is not None:
        low, high = reader.option("query", f"SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}").load().first()
        if low is not None:
            reader = spark.read.format("jdbc").option("url", url).options(**options)
            reader = reader.options(partitionColumn=key, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=max(1, min(parts, int(high) - int(low) + 1)))
        else:
            reader = spark.read.format("jdbc").option("url", url).options(**options)
    return reader.option("dbtable", table).load()


def append_table(rows: DataFrame, url: str, table: str, **options: str) -> None:
    """Append rows; the table is made where it isn't there."""
    rows.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("append").save()
