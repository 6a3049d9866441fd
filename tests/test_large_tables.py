"""What grows with the table: partitions, rows of one task, what reaches the driver."""

import numpy as np
from pyspark.sql import functions as F

from loomprep.operators.models import classifier, regressor, train_model
from loomprep.operators.neighbors import _candidates, _distances
from loomprep.operators.ordered import assign_ranges, bring_together, fill_ordered, plan_ranges, row_numbers


def test_small_ranges_share_tasks(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 7 == 3, F.col("id")).alias("x"))
    plan = plan_ranges(df, "id", rows_per_range=2)
    assert plan.count > 1000
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert bring_together(assign_ranges(df, plan), plan).rdd.getNumPartitions() <= configured
    filled = {r["id"]: r["x"] for r in fill_ordered(df, {"x": "backward"}, plan=plan).collect()}
    assert all(filled[i] == (i + (3 - i) % 7 if i + (3 - i) % 7 < 3000 else None) for i in range(3000))
    assert all(r["n"] == r["id"] + 1 for r in row_numbers(df, "id", name="n", plan=plan).collect())


def test_one_large_file_is_trained_on_by_many_tasks(spark):
    rows = spark.range(8000).coalesce(1).select("id", (F.col("id") % 97).cast("double").alias("x"), F.concat(F.lit("g"), F.col("id") % 5).alias("c"))
    df = rows.withColumn("y", F.col("x") * 2 + F.length("c"))
    for algorithm, task, target in (("Decision Tree", "regression", "y"), ("Decision Tree", "classification", "c")):
        result = train_model(df, target, algorithm, task, key="id", tree_depth=30)
        assert result.error is None
        each = [r["count"] for r in result.predictions.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(each) == 1600 and max(each) < 600


def test_deep_trees_keep_the_nodes_of_rows():
    for made in (classifier("Random Forest", 2, 10), classifier("Decision Tree", 2, 10), regressor("Random Forest", 10), regressor("Decision Tree", 10)):
        assert made.getCacheNodeIds()


def test_the_product_rules_out_no_neighbour():
    r = np.random.default_rng(3)
    for scale, shift, digits in ((1.0, 0.0, 0), (1e6, 1e8, 0), (1e-3, 5.0, 4)):
        b = np.round(r.normal(shift, scale, (700, 9)), digits)
        b[300:500] = b[:200]
        a = np.vstack([np.round(r.normal(shift, scale, (50, 9)), digits), b[:10]])
        row, at, d = _candidates(a, b, 5)
        exact = _distances(a, b)
        assert (exact[row, at] == d).all() and len(row) < a.shape[0] * len(b) // 4
        found = set(zip(row.tolist(), at.tolist()))
        limit = np.sort(exact, axis=1)[:, 4]
        assert all((i, j) in found for i, j in zip(*np.nonzero(exact <= limit[:, None])))
    far = np.array([[np.inf, 1.0], [0.0, 1.0], [2.0, 1.0]])
    row, at, d = _candidates(np.zeros((1, 2)), far, 1)
    assert at[np.argmin(d)] == 1
