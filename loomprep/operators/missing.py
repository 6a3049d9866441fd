"""Missing values: profile, strategies and bulk application."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from loomprep.functions.columns import percent
from loomprep.operators.classify import infer_types
from loomprep.operators.profile import missing_counts

# Strategy names and the types each applies to (None: every type).
STRATEGIES: dict[str, tuple[str, ...] | None] = {
    "drop_rows": None,
    "fill_mean": ("numeric",),
    "fill_median": ("numeric",),
    "fill_mode": None,
    "fill_custom": None,
    "fill_forward": None,
    "fill_backward": None,
    "interpolate": ("numeric",),
    "leave": None,
}
ORDERED = {"fill_forward": "forward", "fill_backward": "backward", "interpolate": "interpolate"}


def missing_profile(df: DataFrame) -> DataFrame:
    """(name, missing, missing_pct, total, inferred_type) of the columns with at least one gap."""
    counted = missing_counts(df).where(F.col("missing") > 0)
    names = [r["name"] for r in counted.select("name").collect()]
    types = infer_types(df, names) if names else {}
    labels = df.sparkSession.createDataFrame(sorted(types.items()), "name string, inferred_type string")
    # One row per column on both sides.
    return counted.join(F.broadcast(labels), "name").select(
        "name", "missing", percent(F.col("missing"), F.col("total")).alias("missing_pct"), "total", "inferred_type"
    )


def missing_totals(df: DataFrame) -> DataFrame:
    """One row: rows, cols, columns_with_missing, total_missing."""
    return missing_counts(df).agg(
        F.max("total").alias("rows"),
        F.count(F.lit(1)).alias("cols"),
        F.count_if(F.col("missing") > 0).alias("columns_with_missing"),
        F.sum("missing").alias("total_missing"),
    )


def applicable_strategies(inferred_type: str) -> list[str]:
    return [name for name, types in STRATEGIES.items() if types is None or inferred_type in types]


def check_strategy(strategy: str, inferred_type: str | None = None) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; choose from {list(STRATEGIES)}")
    if inferred_type is not None and strategy not in applicable_strategies(inferred_type):
        raise ValueError(f"strategy {strategy!r} does not apply to a column of type {inferred_type!r}")


def apply_strategy(
    df: DataFrame,
    column: str,
    strategy: str,
    custom_value: Any = None,
    order_by: str | Sequence[str] = (),
    partition_by: str | Sequence[str] = (),
) -> DataFrame:
    """Apply one strategy to one column. The ordered fills need ``order_by`` with a unique last key."""
    spec = {column: {"strategy": strategy, "custom_value": custom_value}}
    return apply_strategies(df, spec, order_by, partition_by)


def apply_strategies(
    df: DataFrame,
    strategies: Mapping[str, Mapping[str, Any]],
    order_by: str | Sequence[str] = (),
    partition_by: str | Sequence[str] = (),
) -> DataFrame:
    """Apply ``{column: {"strategy", "custom_value"}}`` in order; later columns see the rows dropped before."""
    from loomprep.plans.recipe import Recipe, missing_steps

    return Recipe(missing_steps(strategies)).fit(df, order_by, partition_by).transform(df)
