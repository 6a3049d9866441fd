"""Scores of predictions, from one confusion count or one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomprep.functions.columns import col

# Fixed value: the smallest double step at 1, the least denominator of a relative error.
EPSILON = 2.220446049250313e-16


def confusion(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n)."""
    return predictions.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, balanced_accuracy, and precision, recall, f1 weighted by class support; 0 where undefined.

    The rows are reduced to the confusion table first; only that small table is grouped again.
    """
    table = confusion(predictions, label, prediction)
    sides = table.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called")),
            )
        ),
        F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"),
    )
    per_class = sides.groupBy("class").agg(
        F.sum("support").alias("support"),
        F.sum("called").alias("called"),
        F.sum(F.when(F.col("support") > 0, F.col("hit")).otherwise(0)).alias("hits"),
    )
    precision = F.coalesce(F.try_divide("hits", "called"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    scored = per_class.select("support", "hits", precision.alias("p"), recall.alias("r"), f1.alias("f"))
    whole = F.sum("support")
    return scored.agg(
        F.round(F.sum("hits") / whole, 4).alias("accuracy"),
        F.round(F.avg(F.when(F.col("support") > 0, F.col("r"))), 4).alias("balanced_accuracy"),
        F.round(F.sum(F.col("p") * F.col("support")) / whole, 4).alias("precision"),
        F.round(F.sum(F.col("r") * F.col("support")) / whole, 4).alias("recall"),
        F.round(F.sum(F.col("f") * F.col("support")) / whole, 4).alias("f1"),
    )


def log_loss(predictions: DataFrame, probability: str, label: str = "label") -> DataFrame:
    """One row: mean negative log of the probability given to the true class (an array column, label as index)."""
    return loss_of(predictions, F.get(col(probability), col(label).cast("int")).cast("double"))


def loss_of(predictions: DataFrame, true_probability: Column) -> DataFrame:
    """Log loss from the probability given to the true class."""
    safe = F.least(F.greatest(true_probability, F.lit(EPSILON)), F.lit(1.0 - EPSILON))
    return predictions.agg(F.round(F.avg(-F.log(safe)), 4).alias("log_loss"))


def regression_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: r2, mae, rmse, mse, max_error, mape (a fraction)."""
    y, e = col(label).cast("double"), col(label).cast("double") - col(prediction).cast("double")
    sums = predictions.agg(
        F.count(F.lit(1)).alias("n"),
        F.var_pop(y).alias("variance"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.max(F.abs(e)).alias("max_error"),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"),
    )
    # A constant truth scores 1 when met exactly, else 0.
    r2 = F.when(F.col("variance") == 0, F.when(F.col("mse") == 0, 1.0).otherwise(0.0)).otherwise(
        1.0 - F.try_divide("mse", "variance")
    )
    return sums.select(
        F.round(r2, 4).alias("r2"),
        F.round("mae", 4).alias("mae"),
        F.round(F.sqrt("mse"), 4).alias("rmse"),
        F.round("mse", 4).alias("mse"),
        F.round("max_error", 4).alias("max_error"),
        F.round("mape", 4).alias("mape"),
    )


def top_importances(importances: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` features of largest absolute importance."""
    return importances.orderBy(F.abs("importance").desc(), F.col("feature").asc()).limit(k)


