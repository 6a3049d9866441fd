"""Column lookup, storage-type tests and small aggregate helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any, TypeVar

from pyspark.sql import Column, DataFrame, functions as F, types as T

R = TypeVar("R")

# Aggregates per job. Past about thirty the generated method outgrows what the JVM compiles.
AGGREGATES_PER_JOB = 24
PARALLEL_JOBS = 8


def col(name: str) -> Column:
    """The top-level column called ``name``, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def field(df: DataFrame, name: str) -> T.StructField:
    for f in df.schema.fields:
        if f.name == name:
            return f
    raise ValueError(f"no column named {name!r}; columns are {df.columns}")


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_float(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def is_string(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.CharType, T.VarcharType))


def is_temporal(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the columns with a numeric storage type; booleans are not numeric."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select([col(c) for c in numeric_columns(df)])


def with_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` that keeps the position and also accepts dotted names."""
    field(df, name)
    return df.select([value.alias(c) if c == name else col(c) for c in df.columns])


def run_jobs(jobs: Sequence[Callable[[], R]]) -> list[R]:
    """Run independent small-result Spark jobs side by side, so that one narrow scan does not idle the cluster."""
    if len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(max_workers=min(PARALLEL_JOBS, len(jobs))) as pool:
        return list(pool.map(lambda job: job(), jobs))


def chunked(items: Sequence[Any], size: int) -> Iterable[Sequence[Any]]:
    for start in range(0, len(items), size):
        yield items[start : start + size]


def collect_aggregates(df: DataFrame, exprs: Mapping[Any, Column]) -> dict[Any, Any]:
    """Values of ungrouped aggregates by label.

    Each job reads only the columns of its own chunk; only one row per chunk comes back.
    """
    labels = list(exprs)

    def job(chunk: Sequence[Any]) -> Callable[[], dict[Any, Any]]:
        def go() -> dict[Any, Any]:
            row = df.agg(*[exprs[label].alias(f"a{i}") for i, label in enumerate(chunk)]).first()
            return dict(zip(chunk, row))

        return go

    out: dict[Any, Any] = {}
    for part in run_jobs([job(chunk) for chunk in chunked(labels, AGGREGATES_PER_JOB)]):
        out.update(part)
    return out


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals; 0 when there is nothing to divide by."""
    return F.coalesce(F.round(F.try_divide(part * F.lit(100.0), whole), 2), F.lit(0.0))
