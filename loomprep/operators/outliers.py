"""Outliers by inter-quartile range or z-score: masks, report and remediation."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from loomprep.functions.columns import col, collect_aggregates, field, numeric_columns
from loomprep.functions.convert import numeric_value
from loomprep.operators.profile import location_stats, spread_stats
from loomprep.operators.quantiles import exact_quantiles

# Default thresholds and names.
IQR_MULTIPLIER = 1.5
ZSCORE_THRESHOLD = 3.0
METHODS = ("iqr", "zscore")
REMEDIES = ("remove", "cap", "log", "leave")

REPORT_SCHEMA = """
    name string, outlier_count bigint, outlier_pct double, lower_bound double, upper_bound double,
    min double, max double, mean double, std double
"""


@dataclass(frozen=True)
class Bounds:
    """Fitted limits. A z-score flags by ``center`` and ``scale``; its reported limits use the sample deviation."""

    lower: float | None
    upper: float | None
    center: float | None = None
    scale: float | None = None
    threshold: float | None = None

    def mask(self, x: Column) -> Column:
        """True for outliers, false for the rest and for missing values."""
        if self.threshold is not None:
            if not self.scale:
                return F.lit(False)
            return F.coalesce(F.abs(x - F.lit(self.center)) / F.lit(self.scale) > F.lit(self.threshold), F.lit(False))
        if self.lower is None:
            return F.lit(False)
        return F.coalesce((x < F.lit(self.lower)) | (x > F.lit(self.upper)), F.lit(False))

    def clamp(self, x: Column) -> Column:
        if self.lower is None:
            return x
        return F.when(x < F.lit(self.lower), F.lit(self.lower)).when(x > F.lit(self.upper), F.lit(self.upper)).otherwise(x)


def default_threshold(method: str) -> float:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; choose from {METHODS}")
    return IQR_MULTIPLIER if method == "iqr" else ZSCORE_THRESHOLD


Stats = Mapping[str, Mapping[str, Any]]


def fit_bounds(
    df: DataFrame,
    requests: Mapping[str, tuple[str, float | None]],
    ddof: int = 0,
    known: tuple[Stats, Stats] | None = None,
) -> dict[str, Bounds]:
    """Bounds of several columns at once: ``{column: (method, threshold)}``.

    ``ddof`` is the deviation the z-score itself divides by (0: population). ``known`` holds location and spread
    numbers an earlier pass already brought.
    """
    x = {n: numeric_value(col(n), field(df, n).dataType) for n in requests}
    limits = {n: t if t is not None else default_threshold(m) for n, (m, t) in requests.items()}
    by_iqr = {n: x[n] for n, (m, _) in requests.items() if m == "iqr"}
    by_z = {n: x[n] for n in requests if n not in by_iqr}
    for m, _ in requests.values():
        default_threshold(m)
    out: dict[str, Bounds] = {}
    if by_iqr:
        counts = {n: known[0][n]["count"] for n in by_iqr} if known else None
        for n, (q1, q3) in exact_quantiles(df, by_iqr, (0.25, 0.75), counts).items():
            if q1 is None:
                out[n] = Bounds(None, None)
            else:
                out[n] = Bounds(q1 - limits[n] * (q3 - q1), q3 + limits[n] * (q3 - q1))
    if by_z:
        location = known[0] if known else location_stats(df, by_z)
        spread = known[1] if known else spread_stats(df, by_z, location)
        for n in by_z:
            mean, std = location[n]["mean"], spread[n]["std"]
            scale = spread[n]["std_pop"] if ddof == 0 else std
            if mean is None or std is None:
                out[n] = Bounds(None, None, mean, None, limits[n])
            else:
                out[n] = Bounds(mean - limits[n] * std, mean + limits[n] * std, mean, scale if std else None, limits[n])
    return out


def outlier_mask(
    df: DataFrame, column: str, method: str = "iqr", threshold: float | None = None, ddof: int = 0
) -> Column:
    """Boolean column expression, fitted on ``df``."""
    bounds = fit_bounds(df, {column: (method, threshold)}, ddof)[column]
    return bounds.mask(numeric_value(col(column), field(df, column).dataType))


def outlier_report(df: DataFrame, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """Numeric columns with at least one outlier: count, share of all rows, bounds and the column's spread."""
    names = numeric_columns(df)
    x = {n: col(n).cast("double") for n in names}
    location = location_stats(df, x)
    spread = spread_stats(df, x, location)
    requests = {n: (method, threshold) for n in names if location[n]["count"]}
    bounds = fit_bounds(df, requests, known=(location, spread))
    counted = collect_aggregates(
        df, {"": F.count(F.lit(1)), **{n: F.count_if(bounds[n].mask(x[n])) for n in bounds}}
    )
    rows = []
    for n in bounds:
        if counted[n]:
            where, shape = location[n], spread[n]
            rows.append(
                (
                    n,
                    counted[n],
                    counted[n] * 100.0 / counted[""],
                    bounds[n].lower,
                    bounds[n].upper,
                    where["min"],
                    where["max"],
                    where["mean"],
                    shape["std"],
                )
            )
    out = df.sparkSession.createDataFrame(rows, REPORT_SCHEMA)
    return out.withColumns(
        {
            "outlier_pct": F.round("outlier_pct", 2),
            "lower_bound": F.round("lower_bound", 4),
            "upper_bound": F.round("upper_bound", 4),
        }
    )


def outlier_totals(report: DataFrame) -> DataFrame:
    """One row over an outlier report: columns_affected, total_outliers."""
    return report.agg(
        F.count(F.lit(1)).alias("columns_affected"), F.coalesce(F.sum("outlier_count"), F.lit(0)).alias("total_outliers")
    )


def log_value(x: Column, smallest: float | None) -> Column:
    """log(1 + x), shifted so that the smallest value of a column reaching zero or below becomes log 2."""
    if smallest is not None and smallest <= 0:
        return F.log1p(x + F.lit(abs(smallest) + 1.0))
    return F.log1p(x)


def apply_remedy(
    df: DataFrame, column: str, strategy: str, method: str = "iqr", threshold: float | None = None
) -> DataFrame:
    """Remove outlier rows, cap to the bounds, log-transform the column, or leave it."""
    return apply_remedies(df, {column: {"strategy": strategy, "method": method, "threshold": threshold}})


def apply_remedies(df: DataFrame, remedies: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Apply ``{column: {"strategy", "method", "threshold"}}`` in order, each fitted on the table it meets."""
    from loomprep.plans.recipe import Recipe, outlier_steps

    return Recipe(outlier_steps(remedies)).fit(df).transform(df)


def check_remedy(strategy: str, method: str) -> None:
    if strategy not in REMEDIES:
        raise ValueError(f"unknown remedy {strategy!r}; choose from {REMEDIES}")
    default_threshold(method)

