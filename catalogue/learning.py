"""Features, models and scores."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogue.tables import table
from loomprep.operators.features import (
    drop_unusable,
    label_codes,
    label_encode,
    one_hot,
    prepare_features,
    stratified_split,
)
from loomprep.operators.metrics import classification_metrics, log_loss, regression_metrics, top_importances
from loomprep.operators.models import regressor, train_model
from loomprep.operators.neighbors import mean_of_neighbors, nearest, vote

SEGMENTS = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def dummies(spark: SparkSession, d: str) -> DataFrame:
    return one_hot(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


def encoded(spark: SparkSession, d: str) -> DataFrame:
    return label_encode(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "code")


def category_codes(spark: SparkSession, d: str) -> DataFrame:
    return label_codes(table(spark, d, "documents"), "source")


def split_customers(spark: SparkSession, d: str) -> DataFrame:
    flagged = stratified_split(table(spark, d, "customer"), "c_custkey", "c_mktsegment")
    return flagged.select("c_custkey", "is_test")


def split_sql(source: str, key: str, label: str, name: str = "s") -> str:
    """Proportional test sizes by largest remainder; the largest hashes of each class are the test rows."""
    return f"""
    {name}_n AS (SELECT {label} AS g, count(*) AS n FROM {source} GROUP BY 1),
    {name}_t AS (SELECT sum(n) AS total, ceil(0.2::DOUBLE * sum(n)) AS tests FROM {name}_n),
    {name}_e AS (SELECT g, n * tests / total::DOUBLE AS exact, floor(n * tests / total::DOUBLE) AS low, tests
                 FROM {name}_n, {name}_t),
    {name}_k AS (SELECT g, low + CASE WHEN row_number() OVER (ORDER BY exact - low DESC, CAST(g AS VARCHAR))
                   <= tests - sum(low) OVER () THEN 1 ELSE 0 END AS size FROM {name}_e),
    {name} AS (SELECT x.*, row_number() OVER (PARTITION BY {label} ORDER BY md5(CAST({key} AS VARCHAR)) DESC) <= size
                 AS is_test FROM {source} x JOIN {name}_k ON g = {label})"""


def usable_columns(spark: SparkSession, d: str) -> DataFrame:
    return drop_unusable(table(spark, d, "orders"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with simple numbers drawn from their whole text."""
    documents = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return documents.withColumns(
        {
            "words": F.size(F.split("text", " ")),
            "lines": F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1,
        }
    )


PREPARED = """
WITH s AS (SELECT list(DISTINCT source ORDER BY source DESC) AS found FROM documents JOIN labels USING (doc_id))
SELECT d.doc_id, l.quality::DOUBLE AS label, concat_ws(',', n_chars, toxic, len(string_split(text, ' ')),
  length(text) - length(replace(text, chr(10), '')) + 1,
  (lang = 'fr')::INT, (lang = 'es')::INT, (lang = 'en')::INT,
  array_to_string(list_transform(s.found[:-2], lambda x: (source = x)::INT), ',')) AS features
FROM documents d JOIN labels l USING (doc_id), s
"""


def prepared_by_language(spark: SparkSession, d: str) -> DataFrame:
    ready = prepare_features(_documents(spark, d), "quality", ["doc_id"])
    values = vector_to_array("features").cast("array<bigint>")
    return ready.data.select("doc_id", F.array_join(values, ",").alias("features"), "label")


def _training(algorithm: str, task: str):
    """The run's numbers beside its scores, over all columns and with as many and as deep trees as by default."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        if task == "classification":
            df, target, key = _documents(spark, d), "quality", "doc_id"
        else:
            df = table(spark, d, "part")
            target, key = "p_retailprice", "p_partkey"
        result = train_model(df, target, algorithm, task, key=key)
        if result.error:
            raise RuntimeError(result.error)
        return result.metrics.select(
            F.lit(result.algorithm).alias("algorithm"),
            F.lit(result.n_features).alias("n_features"),
            F.lit(result.n_train).alias("n_train"),
            F.lit(result.n_test).alias("n_test"),
            F.lit(result.rows_dropped).alias("rows_dropped"),
            "*",
        )

    return run


def _two_groups(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose class and value follow from their segment alone."""
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    named = F.col("segment").isin("BUILDING", "MACHINERY")
    return customers.withColumns({"wanted": F.when(named, "a").otherwise("b"), "value": F.when(named, 10.5).otherwise(20.25)})


def _exact(algorithm: str, task: str):
    """A full-sized run that has to be right everywhere."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        target, other = ("wanted", "value") if task == "classification" else ("value", "wanted")
        result = train_model(_two_groups(spark, d).drop(other), target, algorithm, task, key="c_custkey")
        if result.error:
            raise RuntimeError(result.error)
        numbers = [F.lit(n).cast("bigint").alias(k) for k, n in (
            ("n_features", result.n_features), ("n_train", result.n_train), ("n_test", result.n_test), ("rows_dropped", result.rows_dropped))]
        scores = ("accuracy", "balanced_accuracy", "precision", "recall", "f1") if task == "classification" else ("r2", "mae", "rmse")
        return result.metrics.select(*numbers, *[F.round(k, 4).alias(k) for k in scores])

    return run


def _exact_sql(task: str) -> str:
    scores = {k: 1.0 for k in ("accuracy", "balanced_accuracy", "precision", "recall", "f1")} if task == "classification" else {"r2": 1.0, "mae": 0.0, "rmse": 0.0}
    shown = ", ".join(f"{x}::DOUBLE AS {k}" for k, x in scores.items())
    return f"""SELECT (count(DISTINCT c_mktsegment) - 1)::BIGINT AS n_features, (count(*) - ceil(0.2::DOUBLE * count(*)))::BIGINT AS n_train,
    ceil(0.2::DOUBLE * count(*))::BIGINT AS n_test, 0::BIGINT AS rows_dropped, {shown} FROM customer"""


def exact_importances(spark: SparkSession, d: str) -> DataFrame:
    """Only one segment decides."""
    customers = _two_groups(spark, d).select("c_custkey", "segment", F.when(F.col("segment") == "BUILDING", "a").otherwise("b").alias("wanted"))
    result = train_model(customers, "wanted", "Decision Tree", "classification", key="c_custkey")
    if result.error:
        raise RuntimeError(result.error)
    return result.importances


def exact_forest(spark: SparkSession, d: str) -> DataFrame:
    """A target that follows from the only column: every tree of the full-sized forest has to be right."""
    named = (F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).cast("int").alias("named")
    customers = table(spark, d, "customer").select("c_custkey", named)
    result = train_model(customers.withColumn("value", 20.25 - 9.75 * F.col("named")), "value", "Random Forest", "regression", key="c_custkey")
    if result.error:
        raise RuntimeError(result.error)
    numbers = [F.lit(n).cast("bigint").alias(k) for k, n in (
        ("n_features", result.n_features), ("n_train", result.n_train), ("n_test", result.n_test), ("rows_dropped", result.rows_dropped))]
    return result.metrics.select(*numbers, *[F.round(k, 4).alias(k) for k in ("r2", "mae", "rmse")])


def exact_top_importances(spark: SparkSession, d: str) -> DataFrame:
    """The segment that decides, then those that do not, by name."""
    return top_importances(exact_importances(spark, d), 2)


def split_by_levels(spark: SparkSession, d: str) -> DataFrame:
    """The boundary of every class is followed down to a single row."""
    return stratified_split(table(spark, d, "customer"), "c_custkey", "c_mktsegment", boundary_rows=1).select("c_custkey", "is_test")


def text_keys(spark: SparkSession, d: str) -> DataFrame:
    """Nearest neighbours of rows whose key is a text."""
    customers = _two_groups(spark, d).withColumn("c_custkey", F.concat(F.lit("k"), F.col("c_custkey"))).drop("value")
    result = train_model(customers, "wanted", "KNN", "classification", key="c_custkey")
    if result.error:
        raise RuntimeError(result.error)
    return result.metrics.select(F.lit(result.n_test).cast("bigint").alias("n_test"), "accuracy")


EXACT_RUNS = (
    ("classification", ("Logistic Regression", "Random Forest", "Gradient Boosting", "KNN", "Decision Tree", "SVM")),
    ("regression", ("Linear Regression", "Gradient Boosting", "KNN", "Decision Tree")),
)


def importances(spark: SparkSession, d: str) -> DataFrame:
    df = _documents(spark, d)
    result = train_model(df, "quality", "Random Forest", "classification", key="doc_id")
    if result.error:
        raise RuntimeError(result.error)
    return top_importances(result.importances)


def _line(spark: SparkSession, d: str, algorithm: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    lines = table(spark, d, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    data = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(lines)
    size = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
    model = regressor(algorithm, size["n"], size["s"]).fit(data)
    row = (round(float(model.coefficients[0]), 4), round(float(model.intercept), 3))
    return spark.createDataFrame([row], "slope double, intercept double")


def ols(spark: SparkSession, d: str) -> DataFrame:
    return _line(spark, d, "Linear Regression")


def ridge(spark: SparkSession, d: str) -> DataFrame:
    return _line(spark, d, "Ridge")


def knn_classes(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    flagged = stratified_split(vectors, "vec_id", "label").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"),
        F.col("label").cast("double").alias("label"), "is_test",
    )
    found = nearest(flagged.where("is_test"), flagged.where("not is_test").drop("is_test"))
    return vote(found)


KNN_CLASSES = f"""
WITH {split_sql("embeddings", "vec_id", "label")},
p AS (SELECT q.vec_id AS id, t.vec_id AS n, t.label, row_number() OVER (PARTITION BY q.vec_id
        ORDER BY list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), t.vec_id) AS r
      FROM s q, s t WHERE q.is_test AND NOT t.is_test),
v AS (SELECT id, label, count(*) AS c FROM p WHERE r <= 5 GROUP BY id, label)
SELECT id, label::DOUBLE AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, label) = 1
"""


def knn_values(spark: SparkSession, d: str) -> DataFrame:
    """Few different vectors with many copies each: ties decide."""
    flagged = stratified_split(table(spark, d, "part"), "p_partkey").select(
        F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double")).alias("vector"),
        F.col("p_retailprice").alias("label"), "is_test",
    )
    found = nearest(flagged.where("is_test"), flagged.where("not is_test").drop("is_test"))
    return mean_of_neighbors(found).withColumn("prediction", F.round("prediction", 6))


KNN_VALUES = """
WITH s AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(p_partkey AS VARCHAR)) DESC)
             <= ceil(0.2::DOUBLE * count(*) OVER ()) AS is_test FROM part),
p AS (SELECT q.p_partkey AS id, t.p_retailprice AS y, row_number() OVER (PARTITION BY q.p_partkey
        ORDER BY abs(q.p_size - t.p_size), t.p_partkey) AS r FROM s q, s t WHERE q.is_test AND NOT t.is_test)
SELECT id, round(avg(y), 6) AS prediction FROM p WHERE r <= 5 GROUP BY id
"""


def class_scores(spark: SparkSession, d: str) -> DataFrame:
    """A length rule as the prediction of quality."""
    documents = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    ruled = documents.select(
        F.col("quality").cast("double").alias("label"), (F.col("n_chars") >= 1000).cast("double").alias("prediction")
    )
    return classification_metrics(ruled)


CLASS_SCORES = """
WITH p AS (SELECT quality AS y, (n_chars >= 1000)::INT AS z FROM documents JOIN labels USING (doc_id)),
c AS (SELECT k, (SELECT count(*) FROM p WHERE y = k) AS support, (SELECT count(*) FROM p WHERE z = k) AS called,
             (SELECT count(*) FROM p WHERE y = k AND z = k) AS hits FROM (SELECT y AS k FROM p UNION SELECT z FROM p)),
s AS (SELECT *, CASE WHEN called = 0 THEN 0 ELSE hits::DOUBLE / called END AS pr,
                CASE WHEN support = 0 THEN 0 ELSE hits::DOUBLE / support END AS re FROM c)
SELECT round(sum(hits)::DOUBLE / sum(support), 4) AS accuracy,
       round(avg(re) FILTER (support > 0), 4) AS balanced_accuracy,
       round(sum(pr * support) / sum(support), 4) AS precision, round(sum(re * support) / sum(support), 4) AS recall,
       round(sum(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END * support) / sum(support), 4) AS f1 FROM s
"""


def loss(spark: SparkSession, d: str) -> DataFrame:
    """The share of a document's characters in the longest as its probability of quality."""
    documents = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    p = F.col("n_chars") / (F.col("n_chars") + 500)
    return log_loss(documents.select(F.col("quality").alias("label"), F.array(1 - p, p).alias("probability")), "probability")


def value_scores(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2100.0).alias("prediction")
    )
    return regression_metrics(lines)


VALUE_SCORES = """
WITH p AS (SELECT l_extendedprice AS y, l_quantity * 2100.0::DOUBLE AS z FROM lineitem)
SELECT round(1 - avg((y - z) * (y - z)) / var_pop(y), 4) AS r2, round(avg(abs(y - z)), 4) AS mae,
       round(sqrt(avg((y - z) * (y - z))), 4) AS rmse, round(avg((y - z) * (y - z)), 4) AS mse,
       round(max(abs(y - z)), 4) AS max_error,
       round(avg(abs(y - z) / greatest(abs(y), 2.220446049250313e-16)), 4) AS mape FROM p
"""


def split_by_label(spark: SparkSession, d: str) -> DataFrame:
    """An uneven class split, as sizes."""
    flagged = stratified_split(table(spark, d, "labels"), "doc_id", "toxic")
    return flagged.groupBy("toxic", "is_test").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    **{
        f"exact_{task}_{name.lower().replace(' ', '_')}": (_exact(name, task), _exact_sql(task)) for task, names in EXACT_RUNS for name in names
    },
    "exact_importances": (
        exact_importances,
        "SELECT DISTINCT 'segment_' || c_mktsegment AS feature, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END::DOUBLE AS importance "
        "FROM customer WHERE c_mktsegment > (SELECT min(c_mktsegment) FROM customer)",
    ),
    "exact_regression_random_forest": (exact_forest, _exact_sql("regression").replace("(count(DISTINCT c_mktsegment) - 1)::BIGINT", "1::BIGINT")),
    "top_importances": (
        exact_top_importances,
        "SELECT DISTINCT 'segment_' || c_mktsegment AS feature, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END::DOUBLE AS importance "
        "FROM customer WHERE c_mktsegment > (SELECT min(c_mktsegment) FROM customer) ORDER BY importance DESC, feature LIMIT 2",
    ),
    "stratified_split_levels": (split_by_levels, f"WITH {split_sql('customer', 'c_custkey', 'c_mktsegment')} SELECT c_custkey, is_test FROM s"),
    "knn_text_keys": (text_keys, "SELECT ceil(0.2::DOUBLE * count(*))::BIGINT AS n_test, 1.0::DOUBLE AS accuracy FROM customer"),
    "one_hot": (
        dummies,
        "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS c_mktsegment_{s}" for s in SEGMENTS)
        + " FROM customer",
    ),
    "drop_unusable": (
        usable_columns,
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    ),
    "label_encode": (
        encoded, "SELECT p_partkey, p_brand, (dense_rank() OVER (ORDER BY p_brand) - 1)::BIGINT AS code FROM part",
    ),
    "category_codes": (
        category_codes,
        "SELECT source AS level, (row_number() OVER (ORDER BY source) - 1)::BIGINT AS code "
        "FROM (SELECT DISTINCT source FROM documents)",
    ),
    "stratified_split": (
        split_customers,
        f"WITH {split_sql('customer', 'c_custkey', 'c_mktsegment')} SELECT c_custkey, is_test FROM s",
    ),
    "stratified_split_uneven": (
        split_by_label,
        f"WITH {split_sql('labels', 'doc_id', 'toxic')} SELECT toxic, is_test, count(*)::BIGINT AS n FROM s GROUP BY ALL",
    ),
    "prepare_features": (prepared_by_language, PREPARED),
    "ols_regression": (
        ols,
        "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, "
        "round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem",
    ),
    "ridge_regression": (
        ridge,
        "WITH r AS (SELECT regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 1) AS b, "
        "avg(l_extendedprice) AS y, avg(l_quantity) AS x FROM lineitem) "
        "SELECT round(b, 4) AS slope, round(y - b * x, 3) AS intercept FROM r",
    ),
    "knn_classify": (knn_classes, KNN_CLASSES),
    "knn_regress": (knn_values, KNN_VALUES),
    "classification_metrics": (class_scores, CLASS_SCORES),
    "log_loss": (
        loss,
        "SELECT round(avg(-ln(CASE WHEN quality = 1 THEN p ELSE 1 - p END)), 4) AS log_loss FROM "
        "(SELECT quality, n_chars / (n_chars + 500)::DOUBLE AS p FROM documents JOIN labels USING (doc_id))",
    ),
    "regression_metrics": (value_scores, VALUE_SCORES),
    "feature_importances": (importances, None),
    **{
        "train_" + a.lower().replace(" ", "_") + "_classifier": (_training(a, "classification"), None)
        for a in ("Logistic Regression", "Random Forest", "Gradient Boosting", "KNN", "Decision Tree", "SVM")
    },
    **{
        "train_" + a.lower().replace(" ", "_") + "_regressor": (_training(a, "regression"), None)
        for a in ("Linear Regression", "Random Forest", "Gradient Boosting", "KNN", "Decision Tree", "Ridge")
    },
}
