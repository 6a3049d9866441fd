"""Exact nearest neighbours of every query row, by cells around sampled pivots.

Train rows go to the cell of their nearest pivot. For a query row the cell radii bound the distance within which k
neighbours must lie; cells wholly beyond it are skipped. Cells are cut into blocks of bounded size and query rows
into batches, so one task meets one block and one batch; it emits the k nearest of each query row, never all pairs.
Of train rows with the same vector only the k smallest ids can ever be neighbours, so copies do not pile up.
Inside a block a matrix product gives squared distances with a known rounding error; what it cannot rule out is measured
exactly.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from loomprep.session import scratch_path

# Executors get these functions with the task and need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEIGHBORS = 5
FEWEST_PIVOTS, MOST_PIVOTS = 16, 2048
# A query row is sent to every cell it cannot skip, which costs more than comparing it with this many rows.
CELL_ROWS = 2048
BLOCK_ROWS = 8192
BATCH_ROWS = 8192
# Query rows compared at a time inside a task, which bounds the distance matrix it holds.
SLICE_ROWS = 256


def nearest(
    queries: DataFrame,
    train: DataFrame,
    k: int = NEIGHBORS,
    pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """(id, rank, neighbor, label, distance) from ``queries(id, vector)`` and ``train(id, vector, label)``.

    ``vector`` is ARRAY<DOUBLE>, distance is Euclidean, ties go to the smaller id.
    """
    spark = queries.sparkSession
    copies = Window.partitionBy("vector").orderBy("id")
    kept = _written(train.withColumn("__c", F.row_number().over(copies)).where(F.col("__c") <= k).drop("__c"), "neighbors-kept")
    rows = kept.count()
    if rows == 0:
        return spark.createDataFrame([], "id bigint, rank int, neighbor bigint, label double, distance double")
    pivots = pivots or min(MOST_PIVOTS, max(FEWEST_PIVOTS, min(math.isqrt(rows) // 2, rows // CELL_ROWS)))
    fraction = min(1.0, 4.0 * pivots / rows)
    sampled = kept.select("vector").sample(fraction, seed=11).orderBy(F.xxhash64("vector")).limit(pivots).collect() or kept.select("vector").take(1)
    centers = np.unique(np.array([r["vector"] for r in sampled], dtype=float), axis=0)

    def to_cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                d = _distances(np.stack(pdf["vector"].to_numpy()), centers)
                yield pdf.assign(cell=d.argmin(axis=1).astype("int32"), reach=d.min(axis=1))

    placed = _written(kept.mapInPandas(to_cells, "id bigint, vector array<double>, label double, cell int, reach double"), "neighbors-placed")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius")).collect()
    size = {r["cell"]: r["n"] for r in cells}
    blocks = {c: math.ceil(n / block_rows) for c, n in size.items()}
    order = sorted(size)
    counts = np.array([size[c] for c in order])
    radius = np.array([r["radius"] for r in sorted(cells, key=lambda r: r["cell"])])
    living = centers[order]
    cell_ids = np.array(order)

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if not len(pdf):
                continue
            d = _distances(np.stack(pdf["vector"].to_numpy()), living)
            far = d + radius
            by_far = np.argsort(far, axis=1)
            reached = np.cumsum(counts[by_far], axis=1) >= min(k, counts.sum())
            bound = np.take_along_axis(far, by_far, axis=1)[np.arange(len(d)), reached.argmax(axis=1)]
            # The slack keeps rounding from excluding a cell that touches the bound.
            near = d - radius <= bound[:, None] * (1 + 1e-9) + 1e-12
            yield pdf.assign(cell=[cell_ids[m].astype("int32").tolist() for m in near])

    asking_rows = queries.select("id", "vector").repartition(max(spark.sparkContext.defaultParallelism, math.ceil(queries.count() / BATCH_ROWS)), "id")
    routed = _written(asking_rows.mapInPandas(route, "id bigint, vector array<double>, cell array<int>"), "neighbors-routed")
    routed = routed.select("id", "vector", F.explode("cell").alias("cell"))
    # One row per cell, at most MOST_PIVOTS rows.
    plan = spark.createDataFrame([(c, blocks[c]) for c in order], "cell int, blocks int")
    asked = routed.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    plan = plan.join(F.broadcast(asked), "cell").withColumn(
        "batches", F.greatest(F.lit(1), F.ceil(F.col("m") / batch_rows)).cast("int")
    )
    plan = plan.select("cell", "blocks", "batches")
    batched = routed.join(F.broadcast(plan), "cell").select(
        "id",
        "vector",
        "cell",
        F.pmod(F.xxhash64("id"), F.col("batches")).cast("int").alias("batch"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    stored = placed.join(F.broadcast(plan), "cell").select(
        "id",
        "vector",
        "label",
        "cell",
        F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch"),
    )

    def closest(asking: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(known):
            return pd.DataFrame({"id": [], "neighbor": [], "label": [], "distance": []})
        known = known.sort_values("id", kind="stable")
        vectors, ids, labels = np.stack(known["vector"].to_numpy()), known["id"].to_numpy(), known["label"].to_numpy()
        each = min(k, len(ids))
        parts = []
        for start in range(0, len(asking), SLICE_ROWS):
            part = asking.iloc[start : start + SLICE_ROWS]
            row, at, d = _candidates(np.stack(part["vector"].to_numpy()), vectors, each)
            order = np.lexsort((at, d, row))
            row, at, d = row[order], at[order], d[order]
            first = np.searchsorted(row, np.arange(len(part)))
            kept = np.arange(len(row)) - first[row] < each
            row, at, d = row[kept], at[kept], d[kept]
            parts.append(
                pd.DataFrame(
                    {"id": part["id"].to_numpy()[row], "neighbor": ids[at], "label": labels[at], "distance": d}
                )
            )
        return pd.concat(parts)

    keys = ["cell", "block", "batch"]
    found = (
        batched.groupBy(*keys)
        .cogroup(stored.groupBy(*keys))
        .applyInPandas(closest, "id bigint, neighbor bigint, label double, distance double")
    )
    best = Window.partitionBy("id").orderBy("distance", "neighbor")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("id", "rank", "neighbor", "label", "distance")


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _candidates(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of pairs that hold the k nearest of every row of a, with all ties."""
    squares_a, squares_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    # Far above what rounding makes of the product, of the distances and of their roots.
    slack = 16 * (a.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(squares_a) + np.sqrt(squares_b.max())) ** 2
    if np.isfinite(slack).all():
        rough = squares_a[:, None] + squares_b - 2.0 * (a @ b.T)
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + slack
        row, at = np.nonzero(rough <= limit[:, None])
    else:
        row, at = (x.ravel() for x in np.indices((len(a), len(b))))
    total = np.zeros(len(row))
    for j in range(a.shape[1]):  # added up as in _distances
        step = a[row, j] - b[at, j]
        total += step * step
    return row, at, np.sqrt(total)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, added up dimension by dimension so that equal vectors always get equal sums."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        step = a[:, j, None] - b[None, :, j]
        total += step * step
    return np.sqrt(total)


def vote(neighbors: DataFrame) -> DataFrame:
    """(id, prediction): the most frequent label among the neighbours, ties to the smaller label."""
    counted = neighbors.groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("prediction"))


def mean_of_neighbors(neighbors: DataFrame) -> DataFrame:
    """(id, prediction): the mean label of the neighbours."""
    return neighbors.groupBy("id").agg(F.avg("label").alias("prediction"))
