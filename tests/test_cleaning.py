import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomprep.operators.missing import (
    applicable_strategies,
    apply_strategies,
    apply_strategy,
    missing_profile,
    missing_totals,
)
from loomprep.operators.ordered import fill_ordered, plan_ranges, row_numbers
from loomprep.operators.outliers import apply_remedies, apply_remedy, fit_bounds, outlier_mask, outlier_report
from loomprep.plans.recipe import Recipe, missing_steps, outlier_steps


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(0, 1.0, "a", 1), (1, 2.0, None, 2), (2, None, "b", 3), (3, 4.0, "a", 4), (4, None, None, 5)]
    return spark.createDataFrame(rows, "row_id bigint, num double, cat string, full int")


def values(df, column, order="row_id"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_missing_profile(gaps):
    got = {r["name"]: r for r in missing_profile(gaps).collect()}
    assert set(got) == {"num", "cat"}
    assert (got["num"]["missing"], got["num"]["missing_pct"], got["num"]["total"]) == (2, 40.0, 5)
    assert (got["num"]["inferred_type"], got["cat"]["inferred_type"]) == ("numeric", "categorical")
    total = missing_totals(gaps).first()
    assert (total["columns_with_missing"], total["total_missing"]) == (2, 4)


@pytest.mark.parametrize(
    "column, strategy, custom, expected",
    [
        ("num", "drop_rows", None, [1.0, 2.0, 4.0]),
        ("num", "fill_mean", None, [1.0, 2.0, 7 / 3, 4.0, 7 / 3]),
        ("num", "fill_median", None, [1.0, 2.0, 2.0, 4.0, 2.0]),
        ("num", "fill_mode", None, [1.0, 2.0, 1.0, 4.0, 1.0]),
        ("cat", "fill_mode", None, ["a", "a", "b", "a", "a"]),
        ("num", "fill_custom", 99, [1.0, 2.0, 99.0, 4.0, 99.0]),
        ("num", "fill_custom", "99", [1.0, 2.0, 99.0, 4.0, 99.0]),
        ("cat", "fill_custom", "z", ["a", "z", "b", "a", "z"]),
        ("num", "fill_custom", None, [1.0, 2.0, None, 4.0, None]),
        ("num", "fill_forward", None, [1.0, 2.0, 2.0, 4.0, 4.0]),
        ("num", "fill_backward", None, [1.0, 2.0, 4.0, 4.0, None]),
        ("cat", "fill_backward", None, ["a", "b", "b", "a", None]),
        ("num", "interpolate", None, [1.0, 2.0, 3.0, 4.0, 4.0]),
        ("num", "leave", None, [1.0, 2.0, None, 4.0, None]),
    ],
)
def test_strategies(gaps, column, strategy, custom, expected):
    assert values(apply_strategy(gaps, column, strategy, custom, "row_id"), column) == pytest.approx(expected)


def test_strategy_checks(gaps):
    with pytest.raises(ValueError, match="unknown strategy"):
        apply_strategy(gaps, "num", "guess")
    with pytest.raises(ValueError, match="does not apply"):
        apply_strategy(gaps, "cat", "fill_mean")
    with pytest.raises(ValueError, match="no column"):
        apply_strategy(gaps, "nope", "fill_mode")
    with pytest.raises(ValueError, match="order_by"):
        apply_strategy(gaps, "num", "fill_forward")
    assert "fill_mean" in applicable_strategies("numeric") and "fill_mean" not in applicable_strategies("text")


def test_numeric_texts_become_numbers(spark):
    df = spark.createDataFrame([(0, "1"), (1, None), (2, "3")], "row_id int, x string")
    assert values(apply_strategy(df, "x", "fill_mean"), "x") == [1.0, 2.0, 3.0]


def test_all_missing_stays_missing(spark):
    df = spark.createDataFrame([(0, None), (1, None)], "row_id int, x double")
    for strategy in ("fill_mean", "fill_median", "fill_mode", "interpolate"):
        assert values(apply_strategy(df, "x", strategy, order_by="row_id"), "x") == [None, None]


def test_bulk_sees_rows_dropped_before(gaps):
    spec = {"cat": {"strategy": "drop_rows"}, "num": {"strategy": "fill_mean"}, "full": {"strategy": "leave"}}
    assert values(apply_strategies(gaps, spec), "num") == [1.0, 2.5, 4.0]
    turned = {"num": {"strategy": "fill_mean"}, "cat": {"strategy": "drop_rows"}}
    assert values(apply_strategies(gaps, turned), "num") == pytest.approx([1.0, 7 / 3, 4.0])


def test_ties_in_the_order_are_an_error(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 3.0)], "k int, x double")
    with pytest.raises(Exception, match="not unique"):
        fill_ordered(df, {"x": "forward"}, "k").collect()


@pytest.fixture(scope="module")
def long_gaps(spark):
    hashed = F.abs(F.hash("id"))
    return spark.range(5000).select(
        F.col("id"),
        (F.col("id") / 3).cast("int").alias("tied"),
        F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 40).alias("user"),
        F.when(hashed % 3 == 0, F.col("id") * 1.0).alias("often"),
        F.when((F.col("id") > 900) & (F.col("id") < 4100), None).otherwise(hashed % 97 * 1.0).alias("hole"),
        F.when(hashed % 500 == 0, F.col("id").cast("string")).alias("rare"),
        F.lit(None).cast("double").alias("never"),
    ).cache()


@pytest.mark.parametrize("partition_by", [(), ("user",)])
@pytest.mark.parametrize("rows_per_range", [70, 900])
def test_ranges_fill_like_one_window(long_gaps, partition_by, rows_per_range):
    methods = {"often": "forward", "hole": "interpolate", "rare": "backward", "never": "interpolate"}
    order = ["tied", "id"]
    plan = plan_ranges(long_gaps, order, partition_by, rows_per_range)
    assert plan.count > 4
    one = fill_ordered(long_gaps, methods, order, partition_by).orderBy("id").collect()
    many = fill_ordered(long_gaps, methods, plan=plan).orderBy("id").collect()
    assert len(one) == 5000
    for a, b in zip(one, many):
        assert a.asDict() == pytest.approx(b.asDict())


def test_ranges_survive_rows_dropped_later(long_gaps):
    plan = plan_ranges(long_gaps, ["id"], rows_per_range=100)
    kept = long_gaps.where((F.col("id") < 300) | (F.col("id") > 2000))
    one = fill_ordered(kept, {"often": "forward", "hole": "interpolate"}, ["id"]).orderBy("id").collect()
    many = fill_ordered(kept, {"often": "forward", "hole": "interpolate"}, plan=plan).orderBy("id").collect()
    for a, b in zip(one, many):
        assert a.asDict() == pytest.approx(b.asDict())


@pytest.mark.parametrize("partition_by", [(), ("user",)])
def test_row_numbers_over_ranges(long_gaps, partition_by):
    plan = plan_ranges(long_gaps, ["tied", "id"], partition_by, 80)
    one = row_numbers(long_gaps, ["tied", "id"], partition_by).orderBy("id").select("id", "row_number").collect()
    assert row_numbers(long_gaps, (), plan=plan).orderBy("id").select("id", "row_number").collect() == one


def test_iqr_bounds_cap_and_remove(spark):
    df = spark.createDataFrame(list(zip(range(6), [1.0, 2.0, 3.0, 4.0, 5.0, 100.0])), "row_id int, x double")
    bounds = fit_bounds(df, {"x": ("iqr", None)})["x"]
    assert (bounds.lower, bounds.upper) == (-1.5, 8.5)
    assert [r[0] for r in df.orderBy("row_id").select(outlier_mask(df, "x")).collect()] == [False] * 5 + [True]
    assert apply_remedy(df, "x", "remove").count() == 5
    assert max(values(apply_remedy(df, "x", "cap"), "x")) == 8.5
    row = outlier_report(df).where("name = 'x'").first()
    assert (row["outlier_count"], row["outlier_pct"], row["upper_bound"]) == (1, 16.67, 8.5)


def test_missing_values_are_no_outliers(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5, 100)] + [(None,)], "x double")
    assert apply_remedy(df, "x", "remove").where("x is null").count() == 1
    assert apply_remedy(df, "x", "cap").where("x is null").count() == 1
    assert apply_remedy(df, "x", "remove", "zscore", 2.0).count() == 6


def test_constant_and_empty_columns_have_no_outliers(spark):
    df = spark.createDataFrame([(5.0, None)] * 4, "x double, y double")
    for method in ("iqr", "zscore"):
        assert outlier_report(df, method).count() == 0
        assert apply_remedy(df, "x", "remove", method).count() == 4
        assert apply_remedy(df, "y", "remove", method).count() == 4
        assert apply_remedy(df, "y", "cap", method).count() == 4


def test_log_shifts_negative_columns(spark):
    df = spark.createDataFrame([(float(x),) for x in (-5, -1, 0, 1, 5, 100)], "x double")
    got = [r["x"] for r in apply_remedy(df, "x", "log").collect()]
    assert got[0] == pytest.approx(math.log(2)) and all(math.isfinite(v) for v in got)


def test_seeded_outliers(spark):
    np.random.seed(42)
    numbers = np.concatenate([np.random.normal(50, 10, 100), [200, -100, 300]])
    df = spark.createDataFrame([(float(v), i, "a") for i, v in enumerate(numbers)], "values double, clean int, cat string")
    assert df.where(outlier_mask(df, "values")).count() >= 3
    assert df.where(outlier_mask(df, "values", "zscore")).count() >= 3
    tight = df.where(outlier_mask(df, "values", "iqr", 1.0)).count()
    assert tight >= df.where(outlier_mask(df, "values", "iqr", 3.0)).count()
    assert [r["name"] for r in outlier_report(df).collect()] == ["values"]
    assert apply_remedy(df, "values", "cap").count() == 103
    with pytest.raises(ValueError, match="unknown remedy"):
        apply_remedy(df, "values", "shrink")


def test_remedies_in_bulk(spark):
    rows = [(float(a), float(b)) for a, b in zip([1, 2, 3, 4, 5, 100], [1, 2, 3, 4, 5, 200])]
    df = spark.createDataFrame(rows, "a double, b double")
    both = apply_remedies(df, {"a": {"strategy": "cap"}, "b": {"strategy": "cap"}})
    assert both.agg(F.max("a")).first()[0] == both.agg(F.max("b")).first()[0] == 8.5
    # The row with the outlier of a is gone before b is looked at.
    in_turn = apply_remedies(df, {"a": {"strategy": "remove"}, "b": {"strategy": "remove"}})
    assert in_turn.count() == 5


def test_same_column_steps_are_fitted_in_turn(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5, 100)] + [(None,)] * 3, "x double")
    recipe = Recipe(missing_steps({"x": "fill_custom"}) + outlier_steps({"x": "cap"}))
    whole = Recipe([missing_steps({"x": {"strategy": "fill_custom", "custom_value": 50}})[0], *outlier_steps({"x": "cap"})])
    fitted = whole.fit(df)
    filled = df.na.fill(50.0)
    assert fitted.steps[1].bounds == fit_bounds(filled, {"x": ("iqr", None)})["x"]
    assert recipe.fit(df).transform(df).where("x is null").count() == 3
    # A fitted recipe is a plain projection: another table of the same columns takes the learned numbers.
    other = spark.createDataFrame([(1000.0,), (None,)], "x double")
    assert [r["x"] for r in fitted.transform(other).collect()] == [fitted.steps[1].bounds.upper, 50.0]
