import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from loomprep.functions.convert import convert_column
from loomprep.functions.nulls import normalize_nulls
from loomprep.operators.charts import boxplot, histogram
from loomprep.operators.classify import classify_column, infer_task
from loomprep.operators.correlation import correlation
from loomprep.operators.frequencies import distinct_counts, top_values
from loomprep.operators.paging import page, page_count, search
from loomprep.operators.profile import profile, table_overview
from loomprep.operators.quantiles import approximate_quantiles, exact_quantiles


@pytest.fixture(scope="module")
def mixed(spark):
    day = lambda y, m: dt.datetime(y, m, 1)
    rows = [
        (1.0, "a", day(2023, 1), "foo", True),
        (2.0, "b", day(2023, 6), "bar", False),
        (3.0, "a", day(2023, 12), "baz", True),
        (4.0, "b", None, "qux", False),
        (5.0, "a", day(2024, 1), None, True),
        (None, "c", day(2024, 6), "zap", None),
    ]
    return spark.createDataFrame(rows, "num double, cat string, dt timestamp, text string, bool_col boolean")


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_profile_of_mixed_columns(mixed):
    got = by_name(profile(mixed))
    assert got["num"]["inferred_type"] == "numeric" and got["num"]["missing"] == 1
    assert got["num"]["missing_pct"] == 16.67
    assert got["num"]["min"] == 1 and got["num"]["max"] == 5 and got["num"]["mean"] == 3 and got["num"]["median"] == 3
    assert got["cat"]["inferred_type"] == "categorical" and got["cat"]["most_common"] == "a"
    assert [tuple(v) for v in got["cat"]["top_values"]] == [("a", 3), ("b", 2), ("c", 1)]
    assert got["dt"]["inferred_type"] == "datetime" and got["dt"]["date_range_days"] == 517
    assert got["bool_col"]["inferred_type"] == "boolean" and got["bool_col"]["most_common"] is None
    over = table_overview(mixed).first()
    assert (over["rows"], over["cols"], over["total_missing"], over["total_cells"]) == (6, 5, 4, 30)


def test_profile_of_empty_and_short_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), (None, 2.0)], "empty string, x double")
    got = by_name(profile(df))
    assert got["empty"]["inferred_type"] == "empty" and got["empty"]["missing"] == 3
    assert got["x"]["skew"] is None and got["x"]["kurtosis"] is None and got["x"]["std"] == pytest.approx(math.sqrt(0.5))
    none = by_name(profile(df.where("x > 100")))
    assert none["x"]["inferred_type"] == "empty" and none["x"]["missing_pct"] == 0.0


def test_moments_follow_the_bias_corrected_formulas(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "x double")
    got = by_name(profile(df))["x"]
    assert got["skew"] == pytest.approx(1.697056, abs=1e-6) and got["kurtosis"] == pytest.approx(3.152, abs=1e-6)
    flat = by_name(profile(spark.createDataFrame([(0.1,)] * 5, "x double")))["x"]
    assert flat["std"] == 0 and flat["skew"] == 0 and flat["kurtosis"] == 0


def test_nan_is_missing_and_infinity_is_not(spark):
    df = normalize_nulls(spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),)], "x double"))
    got = by_name(profile(df))["x"]
    assert got["missing"] == 1 and got["max"] == float("inf")


@pytest.mark.parametrize(
    "values, data_type, expected",
    [
        ([1.0, 2.0], "double", "numeric"),
        (["1", "2.5", "-3e2"], "string", "numeric"),
        (["1d", "NaN", "Infinity", "0x1p3"], "string", "categorical"),
        (["a", "b", "c"] * 40, "string", "categorical"),
        ([dt.date(2024, 1, 1)], "date", "datetime"),
        (["2024-01-01", "2024-02-01 10:00:00", "03/04/2024"], "string", "datetime"),
        (["now", "12:30", "2020x"], "string", "categorical"),
        ([True, None], "boolean", "boolean"),
        ([f"text number {i}" for i in range(200)], "string", "text"),
        ([None, None], "string", "empty"),
        ([[1], [2]], "array<int>", "text"),
    ],
)
def test_classification(spark, values, data_type, expected):
    df = spark.createDataFrame([(v,) for v in values], f"x {data_type}")
    assert classify_column(df, "x") == expected


def test_task_follows_type_and_values(spark):
    df = spark.range(100).select(F.col("id").alias("many"), (F.col("id") % 5).alias("few"), F.lit("a").alias("word"))
    assert infer_task(df, "many") == "regression"
    assert infer_task(df, "few") == infer_task(df, "word") == "classification"


def test_correlation(spark):
    df = spark.createDataFrame([(1, 2, 10), (2, 4, 20), (3, 6, 30), (4, 8, 40)], "a int, b int, c int")
    assert all(r["r"] == pytest.approx(1.0) for r in correlation(df).collect())
    assert correlation(df.select("a")) is None
    flat = df.withColumn("k", F.lit(7)).withColumn("g", F.when(F.col("a") > 2, F.col("b")))
    got = {(r["col_a"], r["col_b"]): r["r"] for r in correlation(flat).collect()}
    assert got[("a", "k")] is None and got[("k", "k")] is None and got[("a", "g")] == pytest.approx(1.0)


@pytest.mark.parametrize("sorted_rows", [10, 500, 100_000])
def test_quantiles_are_exact_with_hot_values(spark, sorted_rows):
    hot = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.abs(F.hash("id")) % 1000 / 10.0).alias("x"),
        F.lit(2.0).alias("flat"),
        F.when(F.col("id") < 0, 1.0).alias("none"),
    )
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    got = exact_quantiles(hot, {c: F.col(c) for c in hot.columns}, probabilities, sorted_rows=sorted_rows)
    wanted = hot.agg(F.expr("percentile(x, array(0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0))")).first()[0]
    assert got["x"] == pytest.approx(wanted)
    assert got["flat"] == [2.0] * 7 and got["none"] == [None] * 7
    near = approximate_quantiles(hot, {"x": F.col("x")}, (0.5,))["x"][0]
    assert near == pytest.approx(wanted[3], rel=0.05)


def test_long_texts_are_told_apart_by_their_end(spark):
    head = "x" * 300
    texts = [head + "a"] * 2 + [head + "b"] * 3 + ["short"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert distinct_counts(df).first()["unique"] == 3
    top = sorted((r["rank"], r["value"], r["count"]) for r in top_values(df, ["t"], 2).collect())
    assert top == [(1, head + "b", 3), (2, head + "a", 2)]


def test_top_values_keep_few_rows_per_task(spark, capsys):
    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("t"))
    top_values(df, ["t"], 3, long_texts=False).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (30.0,), (None,)], "x double")
    rows = sorted(histogram(df, "x").collect())
    assert len(rows) == 30 and sum(r["count"] for r in rows) == 3
    assert rows[29]["count"] == 1 and rows[1]["count"] == 1
    flat = sorted(histogram(spark.createDataFrame([(5.0,)] * 4, "x double"), "x").collect())
    assert flat[0]["lower"] == 4.5 and flat[29]["upper"] == 5.5 and flat[15]["count"] == 4
    assert histogram(df.where("x > 99"), "x").count() == 0


def test_boxplot(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5, 100)], "x double")
    row = boxplot(df, "x").first()
    assert (row["q1"], row["q3"], row["whisker_low"], row["whisker_high"], row["fliers"]) == (2.25, 4.75, 1.0, 5.0, 1)


def test_pages_shallow_and_deep_agree(spark, monkeypatch):
    from loomprep.operators import paging

    df = spark.range(1050).select(F.pmod(F.hash("id"), F.lit(100)).alias("k"), "id")
    assert page_count(df) == 11 and page_count(df.where("id < 0")) == 1
    shallow = page(df, 7, ["k", "id"]).collect()
    last = page(df, 10, ["k", "id"]).collect()
    assert len(last) == 50
    monkeypatch.setattr(paging, "SHALLOW_ROWS", 200)
    assert page(df, 7, ["k", "id"]).collect() == shallow
    assert page(df, 10, ["k", "id"]).collect() == last
    assert page(df, 11, ["k", "id"]).collect() == []


def test_search_reads_every_column(mixed):
    assert search(mixed, "BA").count() == 2
    assert search(mixed, "2024").count() == 2
    assert search(mixed, "nothing").count() == 0


def test_conversions_never_fail(spark):
    df = spark.createDataFrame([("1",), ("yes",), ("No",), (" 2.5 ",), ("1d",), (None,), ("2024-02-30",)], "x string")
    numbers = [r["x"] for r in convert_column(df, "x", "numeric").collect()]
    assert numbers == [1.0, None, None, 2.5, None, None, None]
    flags = [r["x"] for r in convert_column(df, "x", "boolean").collect()]
    assert flags == [True, True, False, None, None, None, None]
    assert [r["x"] for r in convert_column(df, "x", "datetime").collect()] == [None] * 7


@pytest.mark.parametrize("gaps", [False, True])
def test_wide_correlation_equals_pairs(spark, monkeypatch, gaps):
    from loomprep.operators import correlation as module

    x = [(F.abs(F.hash("id", F.lit(i))) % 1000 + 1000 + F.col("id") * (i % 3)) for i in range(6)]
    if gaps:
        x = [F.when(F.abs(F.hash("id", F.lit(-i))) % 4 > 0, e) for i, e in enumerate(x)]
    df = spark.range(500).select(*[e.cast("double").alias(f"x{i}") for i, e in enumerate(x)], F.lit(3.0).alias("flat"))
    narrow = sorted((r["col_a"], r["col_b"], r["r"]) for r in correlation(df).collect())
    monkeypatch.setattr(module, "PAIRWISE_COLUMNS", 2)
    wide = sorted((r["col_a"], r["col_b"], r["r"]) for r in correlation(df).collect())
    for a, b in zip(narrow, wide):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9)
