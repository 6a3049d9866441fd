"""Database tables through Spark's JDBC source. The driver jar comes with the cluster."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from loomprep.functions.nulls import normalize_nulls

MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str] | None = None,
    row_limit: int | None = None,
    partition_column: str | None = None,
    num_partitions: int | None = None,
    bounds: tuple[object, object] | None = None,
) -> DataFrame:
    """A whole table, or its first rows (the limit is pushed to the database).

    With ``partition_column`` the table is read by ranges in parallel; missing bounds are asked from the database.
    """
    options = dict(properties or {})
    if partition_column is None:
        df = spark.read.jdbc(url, table, properties=options)
    else:
        low, high = bounds or _bounds(spark, url, table, partition_column, options)
        if low is None:
            df = spark.read.jdbc(url, table, properties=options)
        else:
            parts = num_partitions or spark.sparkContext.defaultParallelism
            df = spark.read.jdbc(url, table, partition_column, str(low), str(high), parts, properties=options)
    df = normalize_nulls(df)
    return df if row_limit is None else df.limit(row_limit)


def _bounds(spark: SparkSession, url: str, table: str, column: str, options: Mapping[str, str]) -> tuple[object, object]:
    # The database answers with one row; an aggregate over the table would fetch the whole column first.
    asked = f"(SELECT min({column}) AS low, max({column}) AS high FROM {table}) bounds"
    row = spark.read.jdbc(url, asked, properties=dict(options)).first()
    return row["low"], row["high"]


def register_catalog(spark: SparkSession, name: str, url: str, properties: Mapping[str, str] | None = None) -> None:
    """Make a database available as the catalog ``name``."""
    prefix = f"spark.sql.catalog.{name}"
    spark.conf.set(prefix, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    spark.conf.set(f"{prefix}.url", url)
    for key, value in (properties or {}).items():
        spark.conf.set(f"{prefix}.{key}", value)


def list_tables(spark: SparkSession, catalog: str, schema: str) -> DataFrame:
    """(name) of the tables in a schema of a registered catalog."""
    return spark.sql(f"SHOW TABLES IN `{catalog}`.`{schema}`").select(F.col("tableName").alias("name"))


def write_table(
    df: DataFrame, url: str, table: str, if_exists: str = "replace", properties: Mapping[str, str] | None = None
) -> int:
    """Write and return the number of rows written, counted while writing."""
    if if_exists not in MODES:
        raise ValueError(f"unknown mode {if_exists!r}; choose from {list(MODES)}")
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.jdbc(url, table, MODES[if_exists], dict(properties or {}))
    return seen.get["rows"]
