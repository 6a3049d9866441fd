"""The regression forest: the same trees as MLlib's where nothing is drawn, arrays in files, tasks and jobs."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from loomprep.operators import forest
from loomprep.operators.features import FEATURES, LABEL
from loomprep.operators.forest import Layout, Rows, Shelf, grow, grow_forest, predicted, thresholds_of
from loomprep.operators.models import regressor, train_model


def some_rows(spark, n=400, seed=5):
    """Numbers of few values, zeros and negative ones among them, and columns of 0 and 1; vectors sparse and dense."""
    r = np.random.default_rng(seed)
    x = np.column_stack([r.integers(-3, 9, n) * 0.5, r.integers(0, 20, n), *(r.random((3, n)) < 0.3), np.zeros(n)]).astype(float)
    y = x[:, 0] * 2 + (x[:, 1] % 7) * x[:, 2] - 5 * x[:, 3] + r.normal(0, 1, n)
    vectors = [Vectors.dense(v) if i % 3 else Vectors.sparse(len(v), [(j, a) for j, a in enumerate(v.tolist()) if a]) for i, v in enumerate(x)]
    rows = [(f"k{i}", v, float(a), i % 5 == 0) for i, (v, a) in enumerate(zip(vectors, y))]
    return spark.createDataFrame(rows, ["key", FEATURES, LABEL, "is_test"])


@pytest.mark.parametrize("depth", [0, 3, 30])
def test_one_tree_is_that_of_mllib(spark, depth):
    df = some_rows(spark).cache()
    # Small nodes have equal splits, of which any may be taken; the rows that a full tree was grown from end in the same leaves.
    train, test = df.where("not is_test"), df.where("is_test" if depth < 30 else "not is_test")
    got, weights = grow_forest(train.repartition(3), test, "key", 6, trees=1, depth=depth, bootstrap=False)
    model = regressor("Decision Tree", 320, depth=depth).fit(train)
    wanted = {r["key"]: (r[LABEL], r["prediction"]) for r in model.transform(test).collect()}
    found = {r["key"]: (r[LABEL], r["prediction"]) for r in got.collect()}
    assert got.columns == ["key", LABEL, "prediction"] and found.keys() == wanted.keys() and len(found) == (80 if depth < 30 else 320)
    for k, (label, value) in wanted.items():
        assert found[k][0] == label and found[k][1] == pytest.approx(value, abs=1e-9)
    assert weights == pytest.approx(model.featureImportances.toArray(), abs=1e-9 if depth < 30 else 0.02)


def test_a_forest_is_as_good_as_that_of_mllib_and_repeats(spark):
    df = some_rows(spark, 3000).cache()
    train, test = df.where("not is_test"), df.where("is_test")
    one, weights = grow_forest(train, test, "key", 6, trees=100, depth=30)
    again, _ = grow_forest(train, test, "key", 6, trees=100, depth=30)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, again.collect()))
    model = regressor("Random Forest", 2400, trees=100).fit(train)
    error = F.avg((F.col(LABEL) - F.col("prediction")) ** 2)
    ours, theirs = (p.agg(error).first()[0] for p in (one, model.transform(test)))
    assert ours < 1.25 * theirs
    assert weights == pytest.approx(model.featureImportances.toArray(), abs=0.05) and weights.sum() == pytest.approx(1.0)


def local_rows(n, seed=1):
    r = np.random.default_rng(seed)
    layout = Layout([thresholds_of(np.arange(40.0), 0, 32), np.array([0.5]), np.zeros(0), np.array([-1.5, 0.5, 2.5])])
    x = np.column_stack([r.integers(0, 40, n), r.integers(0, 2, n), np.ones(n), r.integers(-3, 5, n)]).astype(float)
    row, feature = np.repeat(np.arange(n), 4), np.tile(np.arange(4), n)
    cells = layout.cells(feature, x.ravel()).reshape(n, 4).astype(layout.kind)
    return layout, x, cells, r.normal(0, 1, n) + x[:, 0] * x[:, 1] + x[:, 3], r.integers(1, 4, n)


def brute_force(x, y, w, thresholds, depth, asked):
    if depth == 0 or len(set(y)) == 1:
        return np.full(len(asked), np.average(y, weights=w))
    error = lambda m: np.sum(w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2)
    cuts = [(f, t, x[:, f] <= t) for f, ts in enumerate(thresholds) for t in ts]
    scored = [(error(left) + error(~left), f, t) for f, t, left in cuts if left.any() and not left.all()]
    if not scored:
        return np.full(len(asked), np.average(y, weights=w))
    _, f, t = min(scored, key=lambda s: s[0])
    out, there = np.empty(len(asked)), asked[:, f] <= t
    for side, of in ((x[:, f] <= t, there), (x[:, f] > t, ~there)):
        out[of] = brute_force(x[side], y[side], w[side], thresholds, depth - 1, asked[of])
    return out


@pytest.mark.parametrize(("rows", "cells", "in_file"), [(1 << 14, 1 << 17, 1 << 25), (16, 100, 0), (1, 1, 0), (50, 1 << 17, 0)])
def test_parts_and_files_give_the_same_tree(tmp_path, monkeypatch, rows, cells, in_file):
    layout, x, packed, y, w = local_rows(600)
    wanted = brute_force(x, y, w, layout.thresholds, 9, x)
    monkeypatch.setattr(forest, "ROWS", rows)
    monkeypatch.setattr(forest, "CELLS", cells)
    monkeypatch.setattr(forest, "IN_FILE", in_file)
    shelf = Shelf(str(tmp_path))
    here, there = (Rows.on(shelf, 600, 4, layout) for _ in range(2))
    assert isinstance(here.labels, np.memmap) == (in_file == 0)
    here.put(slice(0, 600), y, w, packed)
    weights = grow(here, there, 600, layout, 9, layout.width, [42, 0], shelf.path())
    nodes = np.fromfile(tmp_path / str(shelf.number), forest.NODE)
    assert predicted(nodes, packed) == pytest.approx(wanted, abs=1e-9)
    assert weights[2] == 0 and (weights[[0, 1, 3]] > 0).all()


def test_cuts():
    assert thresholds_of(np.array([3.0, 3.0]), 0, 32).tolist() == thresholds_of(np.zeros(0), 5, 32).tolist() == []
    assert thresholds_of(np.array([1.0, -1.0, 1.0]), 2, 32).tolist() == [-0.5, 0.5]
    many = thresholds_of(np.repeat(np.arange(100.0), 3), 0, 32)
    assert len(many) == 31 and all(abs(c - (i + 1) * 100 / 32) <= 1 for i, c in enumerate(many.tolist()))
    near = np.array([1.0, np.nextafter(1.0, 2.0)])
    (cut,) = thresholds_of(near, 0, 32)
    assert near[0] <= cut < near[1]


def test_a_value_too_rare_for_the_sample_is_told_apart(spark, monkeypatch):
    monkeypatch.setattr(forest, "SAMPLED", 20)
    monkeypatch.setattr(forest, "BINS", 4)
    rows = [(i, Vectors.sparse(3, [(0, i % 2 + 1.0), (1, 1.0)] if i != 777 else [(0, 1.0), (1, 1.0), (2, 1.0)]), 500.0 if i == 777 else 1.0) for i in range(3000)]
    train = spark.createDataFrame(rows, ["key", FEATURES, LABEL])
    got, weights = grow_forest(train, train, "key", 3, trees=1, depth=1, bootstrap=False)
    assert weights.tolist() == [0, 0, 1] and all(r["prediction"] == r[LABEL] for r in got.collect())


def test_jobs_do_not_grow_with_the_depth(spark):
    df = spark.range(3000).select("id", (F.col("id") * 7919 % 1000).cast("double").alias("x"), (F.col("id") * 104729 % 3001).cast("double").alias("y"))
    jobs = []
    for depth in (2, 25):
        spark.sparkContext.setJobGroup(f"forest-{depth}", "")
        result = train_model(df, "y", "Random Forest", "regression", key="id", trees=4, tree_depth=depth)
        assert result.error is None and result.metrics.count() == 1 and result.importances.count() == 1
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{depth}")))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs[0] == jobs[1] > 0
