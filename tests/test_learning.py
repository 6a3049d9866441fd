import numpy as np
import pytest
from pyspark.sql import functions as F

from loomprep.operators.features import label_codes, one_hot, prepare_features, stratified_split, test_sizes as sizes
from loomprep.operators.metrics import classification_metrics, log_loss, regression_metrics, top_importances
from loomprep.operators.models import ALGORITHMS, algorithms, train_model
from loomprep.operators.neighbors import nearest


@pytest.fixture(scope="module")
def classes(spark):
    r = np.random.RandomState(42)
    rows = [
        (i, float(a), float(b), str(c), str(t))
        for i, (a, b, c, t) in enumerate(
            zip(r.randn(100), r.randn(100), r.choice(["x", "y", "z"], 100), r.choice(["cat", "dog"], 100))
        )
    ]
    return spark.createDataFrame(rows, "id bigint, feat_a double, feat_b double, cat_feat string, target string").cache()


@pytest.fixture(scope="module")
def line(spark):
    r = np.random.RandomState(42)
    x1, x2 = r.randn(100), r.randn(100)
    y = 2.5 * x1 - 1.3 * x2 + 0.1 * r.randn(100)
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x1, x2, y))]
    return spark.createDataFrame(rows, "id bigint, feat_a double, feat_b double, target double").cache()


@pytest.mark.parametrize("algorithm", ALGORITHMS["classification"])
def test_classifiers(classes, algorithm):
    result = train_model(classes, "target", algorithm, "classification", key="id", trees=5, tree_depth=4)
    assert result.error is None
    assert (result.n_features, result.n_train, result.n_test) == (4, 80, 20)
    row = result.metrics.first()
    assert all(0 <= row[m] <= 1 for m in ("accuracy", "balanced_accuracy", "precision", "recall", "f1"))
    assert (row["log_loss"] is None) == (algorithm == "SVM")
    assert (result.importances is None) == (algorithm in ("SVM", "KNN"))


@pytest.mark.parametrize("algorithm", ALGORITHMS["regression"])
def test_regressors(line, algorithm):
    result = train_model(line, "target", algorithm, "regression", key="id", trees=20, tree_depth=5)
    assert result.error is None
    row = result.metrics.first()
    assert row["r2"] > 0.6 and row["mae"] <= row["rmse"] <= row["max_error"]
    if algorithm == "Linear Regression":
        top = top_importances(result.importances, 1).first()
        assert top["feature"] == "feat_a" and top["importance"] == pytest.approx(2.5, abs=0.1)


def test_many_classes_and_no_key(spark):
    df = spark.range(120).select((F.col("id") % 3 * 10 + F.rand(1)).alias("x"), F.concat(F.lit("c"), F.col("id") % 3).alias("t"))
    for algorithm in ("Gradient Boosting", "KNN"):
        result = train_model(df, "t", algorithm, trees=3)
        assert result.error is None and result.metrics.first()["accuracy"] > 0.9
        assert (result.n_train, result.n_test) == (96, 24)
        assert result.metrics.first()["log_loss"] < 1.0
    numbered = df.select("x", (F.substring("t", 2, 1).cast("int") * 5 + 2).alias("t"))
    result = train_model(numbered, "t", "Decision Tree")
    assert result.task == "classification" and result.error is None and result.metrics.first()["accuracy"] > 0.9


def test_errors_come_back_as_results(classes):
    assert train_model(classes, "nope", "SVM", "classification").error
    assert "unknown algorithm" in train_model(classes, "target", "Ridge", "classification").error
    assert "not enough rows" in train_model(classes.limit(5), "target", "Decision Tree", "classification", key="id").error
    assert algorithms("unknown") == [] and len(algorithms("regression")) == 6


def test_preparation(spark, classes):
    ready = prepare_features(classes.withColumn("day", F.current_timestamp()), "target", ["id"])
    assert ready.feature_names[:2] == ["feat_a", "feat_b"] and sorted(ready.feature_names[2:]) == ["cat_feat_y", "cat_feat_z"]
    assert ready.classes == ["cat", "dog"] and ready.rows_dropped == 0
    holes = spark.createDataFrame(
        [(float(i) if i != 3 else None, 10.0 * i if i != 2 else None, "ab"[i % 2]) for i in range(20)],
        "feat_a double, feat_b double, target string",
    )
    ready = prepare_features(holes, "target")
    assert ready.rows_dropped == 2 and ready.data.count() == 18


def test_missing_category_is_all_zeros(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "c")], "id int, c string")
    rows = [tuple(r) for r in one_hot(df, ["c"]).orderBy("id").collect()]
    assert rows == [(1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 0, 1)]
    codes = sorted(tuple(r) for r in label_codes(df, "c").collect())
    assert codes == [("a", 0), ("b", 1), ("c", 2)]


def test_split_sizes_and_repeatability(spark):
    assert sizes({"a": 50, "b": 30, "c": 20}, 0.2) == {"a": 10, "b": 6, "c": 4}
    assert sum(sizes({"a": 33, "b": 33, "c": 34}, 0.2).values()) == 20
    assert sizes({"a": 50, "b": 1}, 0.2) is None
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("c"))
    one = stratified_split(df, "id", "c")
    assert one.where("is_test").count() == 200
    assert sorted(one.collect()) == sorted(stratified_split(df.repartition(5), "id", "c").collect())
    single = df.withColumn("c", F.when(F.col("id") == 0, "rare").otherwise("x"))
    assert stratified_split(single, "id", "c").where("is_test").count() == 200


def test_nearest_equals_brute_force_with_copies_and_blocks(spark):
    r = np.random.RandomState(7)
    train = np.round(r.randn(600, 3), 1)
    train[:200] = train[0]
    asked = np.vstack([np.round(r.randn(60, 3), 1), train[:20]])
    rows = [(int(i), [float(x) for x in v], float(i % 4)) for i, v in enumerate(train)]
    t = spark.createDataFrame(rows, "id bigint, vector array<double>, label double")
    q = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(asked)], "id bigint, vector array<double>")
    got = {}
    for x in nearest(q, t, pivots=12, block_rows=40, batch_rows=25).collect():
        got.setdefault(x["id"], []).append((x["rank"], x["neighbor"]))
    for i, v in enumerate(asked):
        d = np.zeros(len(train))
        for j in range(3):
            d += (v[j] - train[:, j]) ** 2
        best = sorted(range(len(train)), key=lambda n: (np.sqrt(d[n]), n))[:5]
        assert [n for _, n in sorted(got[i])] == best


def test_scores_where_nothing_is_defined(spark):
    p = spark.createDataFrame([(0.0, 1.0), (0.0, 1.0), (2.0, 1.0)], "label double, prediction double")
    row = classification_metrics(p).first()
    assert (row["accuracy"], row["balanced_accuracy"], row["precision"], row["f1"]) == (0, 0, 0, 0)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    assert regression_metrics(flat).first()["r2"] == 1.0
    sure = spark.createDataFrame([(1, [0.0, 1.0]), (0, [0.0, 1.0])], "label int, probability array<double>")
    assert log_loss(sure, "probability").first()["log_loss"] == pytest.approx(18.0218, abs=1e-3)


def test_a_key_that_repeats_on_the_boundary_is_an_error(spark):
    import pytest

    from loomprep.operators.features import stratified_split

    rows = [(i // 2,) for i in range(20)]  # four test rows of ten pairs: two whole pairs
    with pytest.raises(ValueError, match="not unique"):
        stratified_split(spark.createDataFrame(rows, "k int"), "k")
    alone = stratified_split(spark.createDataFrame([(i,) for i in range(20)], "k int"), "k", boundary_rows=1)
    assert alone.where("is_test").count() == 4


def test_one_dictionary_for_all_categories(spark):
    rows = [(i, f"v{i % 7}" if i % 11 else None, f"w{i % 3}", "same", float(i), f"t{i % 2}") for i in range(210)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string, x double, y string")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    ready = prepare_features(df, "y", ["id"])
    assert ready.feature_names == ["x", *[f"a_v{j}" for j in range(6, 0, -1)], "b_w2", "b_w1"] and ready.classes == ["t0", "t1"]
    for r in ready.data.collect():
        i = r["id"]
        one_of_seven = [float(i % 11 != 0 and i % 7 == j) for j in range(6, 0, -1)]
        assert r["features"].toArray().tolist() == [float(i), *one_of_seven, float(i % 3 == 2), float(i % 3 == 1)] and r["label"] == i % 2
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before  # nothing is left in memory
    assert prepare_features(df.where("id < 0"), "x", ["id"]).data.count() == 0
