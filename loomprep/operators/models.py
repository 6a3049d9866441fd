"""Training runs: the twelve algorithms on MLlib (nearest neighbours on joins, the regression forest on packed rows), their
scores and importances."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.types import IntegralType

from loomprep.functions.columns import col, field
from loomprep.operators.classify import infer_task
from loomprep.operators.features import FEATURES, LABEL, SEED, PreparedData, prepare_features, stratified_split
from loomprep.operators.forest import grow_forest
from loomprep.operators.metrics import classification_metrics, log_loss, loss_of, regression_metrics
from loomprep.operators.neighbors import mean_of_neighbors, nearest, vote
from loomprep.operators.ordered import row_numbers
from loomprep.session import scratch_path

# Algorithm names per task and their sizes.
ALGORITHMS = {
    "classification": ("Logistic Regression", "Random Forest", "Gradient Boosting", "KNN", "Decision Tree", "SVM"),
    "regression": ("Linear Regression", "Random Forest", "Gradient Boosting", "KNN", "Decision Tree", "Ridge"),
}
TREES = 100
BOOSTING_DEPTH = 3
BOOSTING_RATE = 0.1
ITERATIONS = 1000
RIDGE_ALPHA = 1.0
LEAST_ROWS = 10
# Prepared rows of one task: every core gets some of them, and no task more than it can hold.
FEWEST_TASK_ROWS, MOST_TASK_ROWS = 1_000, 50_000
ROW = "__row"
TRUE_PROBABILITY = "true_probability"

# MLlib grows a tree level by level and keeps it on the driver; it allows 30 levels at most. Deep trees keep the node of every
# row between the levels (``cacheNodeIds``) instead of walking down all trees again; they come out the same.
TREE_DEPTH = 30
FOURIER_FEATURES = 256


@dataclass
class TrainingResult:
    """``metrics`` has one row, ``importances`` (feature, importance) one row per feature; ``predictions`` has the label and the
    prediction of each test row, beside other columns; ``error`` is None on success."""

    task: str
    algorithm: str
    target: str
    n_features: int = 0
    n_train: int = 0
    n_test: int = 0
    rows_dropped: int = 0
    metrics: DataFrame | None = None
    importances: DataFrame | None = None
    predictions: DataFrame | None = None
    error: str | None = None


def algorithms(task: str) -> list[str]:
    return list(ALGORITHMS.get(task, ()))


def train_model(
    df: DataFrame,
    target: str,
    algorithm: str,
    task: str | None = None,
    test_size: float = 0.2,
    key: str | None = None,
    trees: int = TREES,
    tree_depth: int = TREE_DEPTH,
) -> TrainingResult:
    """Prepare, split, fit, predict and score. What goes wrong comes back as ``error``.

    The split is exact and stratified by class. With a unique ``key`` it is the same on every run; without one the
    prepared rows are numbered and written to the scratch folder first.
    """
    result = TrainingResult(task or "", algorithm, target)
    try:
        result.task = task or infer_task(df, target)
        if algorithm not in ALGORITHMS.get(result.task, ()):
            raise ValueError(f"unknown algorithm {algorithm!r} for {result.task}")
        _run(df, result, test_size, key, trees, tree_depth)
    except Exception as error:  # noqa: BLE001 - a failed run is a result, as documented
        result.error = str(error)
    return result


def _run(df: DataFrame, result: TrainingResult, test_size: float, key: str | None, trees: int, depth: int) -> None:
    stratified = LABEL if result.task == "classification" else None
    named = df if key else df.withColumn(ROW, F.monotonically_increasing_id())
    prepared = prepare_features(named, result.target, [key or ROW], result.task)
    # Row numbers change when rows are computed again, so they are written down before anything depends on them.
    # The split looks at the keys and classes several times.
    data = spread(prepared.data, prepared.rows, key).persist() if key else spread(_written(prepared.data), prepared.rows, ROW)
    flagged = stratified_split(data, key or ROW, stratified, test_size)
    key = key or ROW
    # Every iteration reads the training rows again; kept in memory, spilled to disk, recomputed if an executor goes.
    flagged = flagged.persist()
    try:
        train, test = flagged.where(~F.col("is_test")), flagged.where("is_test")
        sizes = flagged.groupBy("is_test").count().collect()
        found = {r["is_test"]: r["count"] for r in sizes}
        result.n_train, result.n_test = found.get(False, 0), found.get(True, 0)
        result.n_features, result.rows_dropped = prepared.n_features, prepared.rows_dropped
        if result.n_train + result.n_test < LEAST_ROWS:
            raise ValueError(f"not enough rows after preparation: at least {LEAST_ROWS} are needed")
        if result.algorithm == "KNN":
            predictions, weights = _neighbors(train, test, result.task, key), None
        elif (result.task, result.algorithm) == ("regression", "Random Forest"):
            predictions, weights = grow_forest(train, test, key, prepared.n_features, trees, depth)
        else:
            predictions, weights = _fit(train, test, result, prepared, trees, depth)
        result.predictions = predictions
        scored = _score(predictions, result.task)
        spark = df.sparkSession
        result.metrics = spark.createDataFrame([scored], scored_schema(result.task))
        if weights is not None:
            rows = [(n, round(float(w), 4)) for n, w in zip(prepared.feature_names, weights)]
            rows.sort(key=lambda r: (-abs(r[1]), r[0]))
            result.importances = spark.createDataFrame(rows, "feature string, importance double")
    finally:
        flagged.unpersist()
        data.unpersist()


def spread(data: DataFrame, rows: int, key: str) -> DataFrame:
    """The rows over as many tasks as their number asks for: a small file becomes one task, though its vectors are large."""
    cores = data.sparkSession.sparkContext.defaultParallelism
    wanted = min(math.ceil(rows / FEWEST_TASK_ROWS), max(cores, math.ceil(rows / MOST_TASK_ROWS)))
    return data.repartition(max(1, wanted), col(key))


def _written(data: DataFrame) -> DataFrame:
    path = scratch_path(data.sparkSession, "prepared")
    data.write.parquet(path)
    return data.sparkSession.read.parquet(path)


def scored_schema(task: str) -> str:
    names = (
        ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "log_loss")
        if task == "classification"
        else ("r2", "mae", "rmse", "mse", "max_error", "mape")
    )
    return ", ".join(f"{n} double" for n in names)


def _score(predictions: DataFrame, task: str) -> Row:
    if task == "regression":
        return regression_metrics(predictions).first()
    scores = classification_metrics(predictions).first().asDict()
    scores["log_loss"] = None
    if TRUE_PROBABILITY in predictions.columns:
        scores["log_loss"] = loss_of(predictions, F.col(TRUE_PROBABILITY)).first()["log_loss"]
    elif "probability" in predictions.columns:
        as_array = predictions.select(LABEL, vector_to_array("probability").alias("probability"))
        scores["log_loss"] = log_loss(as_array, "probability").first()["log_loss"]
    return Row(**scores)


def _fit(
    train: DataFrame, test: DataFrame, result: TrainingResult, prepared: PreparedData, trees: int, depth: int
) -> tuple[DataFrame, Any]:
    classes = int(train.agg(F.max(LABEL)).first()[0]) + 1 if result.task == "classification" else 0
    if result.algorithm == "SVM":
        return _kernel_svm(train, test, classes), None
    if result.task == "classification":
        estimator = classifier(result.algorithm, classes, result.n_train, trees, depth)
    else:
        spread = train.agg(F.stddev_pop(LABEL)).first()[0] if result.algorithm == "Ridge" else None
        estimator = regressor(result.algorithm, result.n_train, spread, trees, depth)
    model = estimator.fit(train)
    predictions = model.transform(test)
    if result.algorithm == "Gradient Boosting" and classes > 2:
        predictions = predictions.withColumn(TRUE_PROBABILITY, _one_against_rest_probability())
    return predictions, _weights(model)


def _one_against_rest_probability() -> Column:
    """Share of the true class among the boosted models' own probabilities, 1 / (1 + exp(-2 margin))."""
    each = F.transform(vector_to_array("rawPrediction"), lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
    whole = F.aggregate(each, F.lit(0.0), lambda a, p: a + p)
    return F.try_divide(F.get(each, F.col(LABEL).cast("int")), whole)


def classifier(algorithm: str, classes: int, rows: int, trees: int = TREES, depth: int = TREE_DEPTH) -> Estimator:
    if algorithm == "Logistic Regression":
        # A penalty of 1/n on the mean loss is a penalty of one on the summed loss.
        return LogisticRegression(regParam=1.0 / rows, standardization=False, maxIter=ITERATIONS, tol=1e-10)
    if algorithm == "Random Forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, cacheNodeIds=True, seed=SEED)
    if algorithm == "Decision Tree":
        return DecisionTreeClassifier(maxDepth=depth, cacheNodeIds=True, seed=SEED)
    if algorithm == "Gradient Boosting":
        boosted = GBTClassifier(maxIter=trees, maxDepth=BOOSTING_DEPTH, stepSize=BOOSTING_RATE, seed=SEED)
        return boosted if classes <= 2 else OneVsRest(classifier=boosted)
    raise ValueError(f"unknown classifier {algorithm!r}")


def regressor(
    algorithm: str, rows: int, label_spread: float | None = None, trees: int = TREES, depth: int = TREE_DEPTH
) -> Estimator:
    if algorithm == "Linear Regression":
        return LinearRegression(solver="normal", regParam=0.0)
    if algorithm == "Ridge":
        # MLlib scales the label to unit deviation before it applies the penalty.
        penalty = RIDGE_ALPHA / rows * (label_spread or 0.0)
        return LinearRegression(solver="normal", regParam=penalty, elasticNetParam=0.0, standardization=False)
    if algorithm == "Random Forest":
        return RandomForestRegressor(numTrees=trees, maxDepth=depth, cacheNodeIds=True, seed=SEED)
    if algorithm == "Decision Tree":
        return DecisionTreeRegressor(maxDepth=depth, cacheNodeIds=True, seed=SEED)
    if algorithm == "Gradient Boosting":
        return GBTRegressor(maxIter=trees, maxDepth=BOOSTING_DEPTH, stepSize=BOOSTING_RATE, seed=SEED)
    raise ValueError(f"unknown regressor {algorithm!r}")


def _weights(model: Any) -> np.ndarray | None:
    """Tree importances, else mean absolute coefficient over the classes."""
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "coefficientMatrix"):
        return np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    if hasattr(model, "coefficients"):
        return np.abs(model.coefficients.toArray())
    if hasattr(model, "models"):
        parts = [_weights(m) for m in model.models]
        return np.mean(parts, axis=0)
    return None


def fourier_features(df: DataFrame, gamma: float, size: int, width: int, output: str = "mapped") -> DataFrame:
    """Random cosine features whose products approximate exp(-gamma * squared distance)."""
    source = np.random.default_rng(SEED)
    directions = source.normal(0.0, math.sqrt(2.0 * gamma), (width, size))
    offsets = source.uniform(0.0, 2.0 * math.pi, size)

    @F.pandas_udf("array<double>")
    def project(vectors):  # noqa: ANN001, ANN202
        import pandas as pd

        x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, width))
        return pd.Series(list(math.sqrt(2.0 / size) * np.cos(x @ directions + offsets)))

    return df.withColumn(output, array_to_vector(project(vector_to_array(FEATURES))))


def _kernel_svm(train: DataFrame, test: DataFrame, classes: int) -> DataFrame:
    """RBF kernel by random Fourier features under a linear SVM; no probabilities."""
    width = train.select(F.size(vector_to_array(FEATURES)).alias("n")).first()["n"]
    x = F.explode(vector_to_array(FEATURES))
    variance = train.select(x.alias("x")).agg(F.var_pop("x")).first()[0] or 1.0
    gamma = 1.0 / (width * variance)
    svm = LinearSVC(featuresCol="mapped", maxIter=100, regParam=1.0 / max(1, train.count()), standardization=False)
    estimator = svm if classes <= 2 else OneVsRest(classifier=svm, featuresCol="mapped")
    model = estimator.fit(fourier_features(train, gamma, FOURIER_FEATURES, width))
    scored = model.transform(fourier_features(test, gamma, FOURIER_FEATURES, width))
    return scored.select(LABEL, "prediction")


def _neighbors(train: DataFrame, test: DataFrame, task: str, key: str) -> DataFrame:
    if not isinstance(field(train, key).dataType, IntegralType):
        numbers = row_numbers(train.select(col(key)).unionByName(test.select(col(key))), key, name=ROW)
        train, test, key = train.join(numbers, key), test.join(numbers, key), ROW
    vectors = [col(key).cast("bigint").alias("id"), vector_to_array(FEATURES).alias("vector")]
    asking = test.select(*vectors)
    found = nearest(asking, train.select(*vectors, F.col(LABEL).cast("double").alias("label")))
    truth = test.select(col(key).cast("bigint").alias("id"), F.col(LABEL))
    if task == "regression":
        return truth.join(mean_of_neighbors(found), "id").select("id", LABEL, "prediction")
    shares = found.withColumnRenamed("label", "near").join(truth, "id").groupBy("id").agg(
        F.avg((F.col("near") == F.col(LABEL)).cast("double")).alias(TRUE_PROBABILITY)
    )
    return truth.join(vote(found), "id").join(shares, "id").select("id", LABEL, "prediction", TRUE_PROBABILITY)
