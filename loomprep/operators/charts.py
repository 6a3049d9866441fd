"""The numbers behind the charts: histogram bins, box plot, bars and heat-map cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomprep.functions.columns import col, collect_aggregates, field
from loomprep.functions.convert import numeric_value
from loomprep.operators.correlation import correlation
from loomprep.operators.frequencies import top_values
from loomprep.operators.quantiles import exact_quantiles

HISTOGRAM_BINS = 30
BAR_VALUES = 15
WHISKER = 1.5


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, lower, upper, count) of equal-width bins from min to max; the last bin is closed, empty bins stay.

    Bins cover the finite values; an infinite one is in no bin.
    """
    x = numeric_value(col(column), field(df, column).dataType)
    x = F.when(F.abs(x) != float("inf"), x)
    ends = collect_aggregates(df, {"lo": F.min(x), "hi": F.max(x)})
    schema = "bin bigint, lower double, upper double, count bigint"
    if ends["lo"] is None:
        return df.sparkSession.createDataFrame([], schema)
    lo, hi = ends["lo"], ends["hi"]
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.lit(hi)).otherwise(F.lit(lo) + i * F.lit(step))

    values = df.select(x.alias("x")).where(F.col("x").isNotNull())
    guess = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1).cast("bigint"))
    placed = values.withColumn("guess", guess)
    # Rounding may put a value one bin off its edges; compare with the edges themselves.
    g = F.col("guess")
    index = (
        F.when(F.col("x") < edge(g), g - 1)
        .when((g < bins - 1) & (F.col("x") >= edge(g + 1)), g + 1)
        .otherwise(g)
    )
    counted = placed.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return frame.join(counted, "bin", "left").select(
        "bin",
        edge(F.col("bin")).alias("lower"),
        edge(F.col("bin") + 1).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def boxplot(df: DataFrame, column: str, whisker: float = WHISKER) -> DataFrame:
    """One row: q1, median, q3, whisker_low, whisker_high, fliers (their number)."""
    x = numeric_value(col(column), field(df, column).dataType)
    q1, median, q3 = exact_quantiles(df, {column: x}, (0.25, 0.5, 0.75))[column]
    if q1 is None:
        return df.sparkSession.createDataFrame(
            [], "q1 double, median double, q3 double, whisker_low double, whisker_high double, fliers bigint"
        )
    low, high = q1 - whisker * (q3 - q1), q3 + whisker * (q3 - q1)
    return df.agg(
        F.least(F.min(F.when(x >= low, x)), F.lit(q1)).alias("whisker_low"),
        F.greatest(F.max(F.when(x <= high, x)), F.lit(q3)).alias("whisker_high"),
        F.count_if((x < low) | (x > high)).alias("fliers"),
    ).select(
        F.lit(q1).alias("q1"),
        F.lit(median).alias("median"),
        F.lit(q3).alias("q3"),
        "whisker_low",
        "whisker_high",
        "fliers",
    )


def boxplot_fliers(df: DataFrame, column: str, whisker: float = WHISKER) -> DataFrame:
    """The rows beyond the whiskers."""
    x = numeric_value(col(column), field(df, column).dataType)
    q1, q3 = exact_quantiles(df, {column: x}, (0.25, 0.75))[column]
    if q1 is None:
        return df.where(F.lit(False))
    return df.where((x < q1 - whisker * (q3 - q1)) | (x > q3 + whisker * (q3 - q1)))


def bars(df: DataFrame, column: str, k: int = BAR_VALUES) -> DataFrame:
    """(value, count) of the ``k`` most frequent values."""
    return top_values(df, [column], k).select("value", "count")


def heatmap(df: DataFrame) -> DataFrame | None:
    """Cells (col_a, col_b, r) of the correlation matrix."""
    return correlation(df)
