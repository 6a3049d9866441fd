"""A cleaning recipe: ordered steps, fitted once, then a lazy transformation of any table with the same columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field as dc_field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomprep.functions.columns import col, collect_aggregates, field, is_numeric, is_string, run_jobs, with_column
from loomprep.functions.convert import numeric_value
from loomprep.functions.nulls import drop_missing
from loomprep.operators.classify import infer_types
from loomprep.operators.frequencies import mode_of
from loomprep.operators.missing import ORDERED, check_strategy
from loomprep.operators.ordered import ROWS_PER_RANGE, Ranges, fill_ordered, plan_ranges
from loomprep.operators.outliers import Bounds, check_remedy, fit_bounds, log_value
from loomprep.operators.quantiles import exact_quantiles

MISSING, OUTLIER = "missing_values", "outlier_remediation"
DROPS_ROWS = ("drop_rows", "remove")


@dataclass(frozen=True)
class Step:
    """One column, one strategy."""

    operation: str
    column: str
    strategy: str
    custom_value: Any = None
    method: str = "iqr"
    threshold: float | None = None

    def check(self) -> None:
        if self.operation == MISSING:
            check_strategy(self.strategy)
        elif self.operation == OUTLIER:
            check_remedy(self.strategy, self.method)
        else:
            raise ValueError(f"unknown operation {self.operation!r}")


@dataclass(frozen=True)
class FittedStep:
    """A step with the numbers it needs; applying it is a projection, a filter or an ordered fill."""

    step: Step
    value: Any = None
    bounds: Bounds | None = None
    ranges: Ranges | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        name, strategy = self.step.column, self.step.strategy
        data_type = field(df, name).dataType
        x = numeric_value(col(name), data_type)
        if strategy == "leave":
            return df
        if strategy == "drop_rows":
            return drop_missing(df, name)
        if strategy in ("fill_mean", "fill_median"):
            return with_column(df, name, x if self.value is None else F.coalesce(x, F.lit(self.value)))
        if strategy in ("fill_mode", "fill_custom"):
            return df if self.value is None else with_column(df, name, _constant_fill(col(name), data_type, self.value))
        if strategy in ORDERED:
            return fill_ordered(df, {name: ORDERED[strategy]}, plan=self.ranges)
        if strategy == "remove":
            return df.where(~self.bounds.mask(x))
        if strategy == "cap":
            return with_column(df, name, self.bounds.clamp(x))
        return with_column(df, name, log_value(x, self.value))


def _constant_fill(value: Column, data_type, constant: Any) -> Column:
    """Keep the column's type unless a number would lose its fraction."""
    if is_string(data_type):
        return F.coalesce(value, F.lit(str(constant)))
    if isinstance(data_type, T.DecimalType) and isinstance(constant, Decimal):
        return F.coalesce(value, F.lit(constant).cast(data_type))
    if is_numeric(data_type):
        number = float(constant)
        if number.is_integer() or data_type.simpleString() in ("double", "float"):
            return F.coalesce(value, F.lit(constant).cast(data_type))
        return F.coalesce(value.cast("double"), F.lit(number))
    return F.coalesce(value, F.lit(constant).cast(data_type))


def missing_steps(strategies: Mapping[str, Mapping[str, Any] | str]) -> list[Step]:
    return [
        Step(MISSING, c, spec.get("strategy", "leave"), custom_value=spec.get("custom_value"))
        for c, spec in ((c, _spec(s)) for c, s in strategies.items())
    ]


def outlier_steps(remedies: Mapping[str, Mapping[str, Any] | str]) -> list[Step]:
    return [
        Step(
            OUTLIER,
            c,
            spec.get("strategy", "leave"),
            method=spec.get("method") or "iqr",
            threshold=spec.get("threshold"),
        )
        for c, spec in ((c, _spec(s)) for c, s in remedies.items())
    ]


def _spec(detail: Mapping[str, Any] | str) -> Mapping[str, Any]:
    """A bare strategy name is short for a specification without options."""
    return detail if isinstance(detail, Mapping) else {"strategy": str(detail)}


@dataclass(frozen=True)
class FittedRecipe:
    steps: tuple[FittedStep, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Lazy plan. Neighbouring ordered fills share one range assignment, one shuffle and one sort."""
        run: list[FittedStep] = []
        for fitted in self.steps:
            ordered = fitted.step.strategy in ORDERED
            clash = any(f.step.column == fitted.step.column for f in run)
            if run and (not ordered or clash):
                df, run = _apply_run(df, run), []
            if ordered:
                run.append(fitted)
            else:
                df = fitted.apply(df)
        return _apply_run(df, run) if run else df


def _apply_run(df: DataFrame, run: Sequence[FittedStep]) -> DataFrame:
    return fill_ordered(df, {f.step.column: ORDERED[f.step.strategy] for f in run}, plan=run[0].ranges)


@dataclass(frozen=True)
class Recipe:
    steps: Sequence[Step] = dc_field(default_factory=list)

    def fit(
        self,
        df: DataFrame,
        order_by: str | Sequence[str] = (),
        partition_by: str | Sequence[str] = (),
        rows_per_range: int = ROWS_PER_RANGE,
    ) -> FittedRecipe:
        """Learn every mean, mode, bound and cut the steps need.

        Steps are fitted in groups. A group ends before a step that touches a column the group already changes and
        after a step that removes rows, because what follows must see the table those leave behind.
        """
        steps = [s for s in self.steps if s.strategy != "leave"]
        for s in steps:
            s.check()
            field(df, s.column)
        keys = {n for names in (order_by, partition_by) for n in ((names,) if isinstance(names, str) else names or ())}
        ranges = None
        done: list[FittedStep] = []
        group: list[Step] = []

        def close() -> None:
            nonlocal ranges
            if group:
                current = FittedRecipe(tuple(done)).transform(df)
                if ranges is None and any(s.strategy in ORDERED for s in group):
                    ranges = plan_ranges(current, order_by, partition_by, rows_per_range)
                done.extend(_fit_group(current, group, ranges))
                if any(s.column in keys for s in group):
                    ranges = None  # the cuts are made anew on the changed keys
                group.clear()

        for s in steps:
            if any(s.column == g.column or (g.column in keys and s.strategy in ORDERED) for g in group):
                close()
            group.append(s)
            if s.strategy in DROPS_ROWS:
                close()
        close()
        return FittedRecipe(tuple(done))


def _fit_group(df: DataFrame, group: Sequence[Step], ranges: Ranges | None) -> list[FittedStep]:
    kinds = _text_types(df, group)
    for s in group:
        if s.operation == MISSING:
            check_strategy(s.strategy, kinds.get(s.column) or _storage_type(df, s.column))
    x = {s.column: numeric_value(col(s.column), field(df, s.column).dataType) for s in group}

    def columns(*strategies: str) -> list[str]:
        return [s.column for s in group if s.strategy in strategies]

    def one_pass() -> dict[str, Any]:
        exprs = {n: F.avg(x[n]) for n in columns("fill_mean")}
        exprs.update({n: F.min(x[n]) for n in columns("log")})
        return collect_aggregates(df, exprs) if exprs else {}

    def medians() -> dict[str, Any]:
        wanted = {n: x[n] for n in columns("fill_median")}
        return {n: q[0] for n, q in exact_quantiles(df, wanted, (0.5,)).items()} if wanted else {}

    def limits() -> dict[str, Bounds]:
        wanted = {s.column: (s.method, s.threshold) for s in group if s.strategy in ("remove", "cap")}
        return fit_bounds(df, wanted) if wanted else {}

    def modes() -> dict[str, Any]:
        return {n: mode_of(df, n) for n in columns("fill_mode")}

    simple, middle, bounds, common = run_jobs([one_pass, medians, limits, modes])
    values = {**simple, **middle, **common}
    fitted = []
    for s in group:
        f = FittedStep(s, values.get(s.column), bounds.get(s.column), ranges if s.strategy in ORDERED else None)
        if s.strategy == "fill_custom":
            f = replace(f, value=_custom(s, kinds.get(s.column) or _storage_type(df, s.column)))
        fitted.append(f)
    return fitted


def _custom(step: Step, kind: str) -> Any:
    """A text given for a numeric column is read as a number."""
    if kind == "numeric" and isinstance(step.custom_value, str):
        return float(step.custom_value)
    return step.custom_value


def _storage_type(df: DataFrame, name: str) -> str | None:
    data_type = field(df, name).dataType
    if is_numeric(data_type):
        return "numeric"
    return "boolean" if data_type.simpleString() == "boolean" else "datetime" if not is_string(data_type) else None


def _text_types(df: DataFrame, group: Sequence[Step]) -> dict[str, str]:
    """Inferred type of the text columns for which the strategy depends on it."""
    asked = [
        s.column
        for s in group
        if s.strategy in ("fill_mean", "fill_median", "interpolate") and is_string(field(df, s.column).dataType)
    ]
    return infer_types(df, asked) if asked else {}
