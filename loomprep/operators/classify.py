"""Semantic type of each column: numeric, categorical, datetime, boolean, text or empty."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomprep.functions.columns import col, collect_aggregates, field, is_numeric, is_string, is_temporal
from loomprep.functions.convert import datetime_value, numeric_value
from loomprep.operators.frequencies import distinct_counts, has_long_texts

LOCATION = ("count", "min", "max", "mean", "zeros", "negatives")

# Fixed values of the classification rule.
PARSED_SHARE = 0.8
CATEGORICAL_SHARE = 0.5
CATEGORICAL_VALUES = 50
REGRESSION_VALUES = 20


@dataclass
class ColumnFacts:
    """What one pass over a column tells about it."""

    present: int
    numbers: int = 0
    dates: int = 0
    longest: int | None = None
    location: dict[str, Any] | None = None


def location_exprs(name: str, x: Column) -> dict[tuple[str, str], Column]:
    """count, min, max, mean, zeros and negatives of one DOUBLE expression."""
    return dict(
        zip(
            [(key, name) for key in LOCATION],
            [F.count(x), F.min(x), F.max(x), F.avg(x), F.count_if(x == 0), F.count_if(x < 0)],
        )
    )


def scan_facts(
    df: DataFrame, columns: Sequence[str] | None = None, locate: bool = False
) -> tuple[int, dict[str, ColumnFacts]]:
    """Row count and per-column facts, collected as one small row per job.

    ``locate`` takes the location numbers of numeric columns along in the same pass.
    """
    names = list(columns or df.columns)
    exprs = {("rows", ""): F.count(F.lit(1))}
    for name in names:
        data_type = field(df, name).dataType
        exprs[("present", name)] = F.count(col(name))
        if locate and is_numeric(data_type):
            exprs.update(location_exprs(name, col(name).cast("double")))
        if is_string(data_type):
            exprs[("numbers", name)] = F.count(numeric_value(col(name), data_type))
            exprs[("dates", name)] = F.count(datetime_value(col(name), data_type))
            exprs[("longest", name)] = F.max(F.length(col(name)))
    got = collect_aggregates(df, exprs)
    facts = {
        name: ColumnFacts(
            got[("present", name)],
            got.get(("numbers", name), 0),
            got.get(("dates", name), 0),
            got.get(("longest", name)),
            {key: got[(key, name)] for key in LOCATION} if ("count", name) in got else None,
        )
        for name in names
    }
    return got[("rows", "")], facts


def settled_type(data_type: T.DataType, facts: ColumnFacts) -> str | None:
    """The type as far as storage and parse tests settle it; None leaves it to the number of values."""
    if facts.present == 0 or isinstance(data_type, T.NullType):
        return "empty"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if is_numeric(data_type):
        return "numeric"
    if is_temporal(data_type):
        return "datetime"
    if is_string(data_type):
        if facts.numbers >= PARSED_SHARE * facts.present:
            return "numeric"
        if facts.dates >= PARSED_SHARE * facts.present:
            return "datetime"
        return None
    return "text"


def type_by_values(unique: int, present: int) -> str:
    if unique / present < CATEGORICAL_SHARE or unique <= CATEGORICAL_VALUES:
        return "categorical"
    return "text"


def infer_types(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    facts: Mapping[str, ColumnFacts] | None = None,
) -> dict[str, str]:
    """Type by column name. Distinct values are counted only where the parse tests left the type open."""
    names = list(columns or df.columns)
    if facts is None:
        _, facts = scan_facts(df, names)
    types = {name: settled_type(field(df, name).dataType, facts[name]) for name in names}
    undecided = [name for name in names if types[name] is None]
    if undecided:
        long_texts = has_long_texts([facts[name].longest for name in undecided])
        for name, unique in distinct_counts(df, undecided, long_texts).collect():
            types[name] = type_by_values(unique, facts[name].present)
    return types


def classify_columns(df: DataFrame) -> DataFrame:
    """(name, inferred_type), one row per column."""
    types = infer_types(df)
    return df.sparkSession.createDataFrame(
        [(name, types[name]) for name in df.columns], "name string, inferred_type string"
    )


def classify_column(df: DataFrame, column: str) -> str:
    return infer_types(df, [column])[column]


def infer_task(df: DataFrame, target: str) -> str:
    """regression for a numeric target with more than 20 different values, else classification."""
    if classify_column(df, target) != "numeric":
        return "classification"
    unique = distinct_counts(df, [target]).first()
    return "regression" if unique and unique["unique"] > REGRESSION_VALUES else "classification"
