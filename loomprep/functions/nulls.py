"""One notion of missing: SQL NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomprep.functions.columns import col, is_float


def normalize_nulls(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column; infinities stay values."""
    return df.select(
        [
            F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name) if is_float(f.dataType) else col(f.name)
            for f in df.schema.fields
        ]
    )


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    """Keep the rows where ``column`` is present."""
    return df.where(col(column).isNotNull())


def complete_cases(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Keep the rows where all ``columns`` (default: every column) are present."""
    condition = F.lit(True)
    for name in columns or df.columns:
        condition = condition & col(name).isNotNull()
    return df.where(condition)
