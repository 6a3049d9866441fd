"""A regression forest whose trees are grown each by one task from packed rows.

Growing all trees together level by level sends the statistics of every node through a shuffle, although deep nodes hold few
rows, and keeps the node of every row in every tree. Here the rows are cut into bins and packed once; a task reads the packed
rows, keeps them in files of its temporary folder where they are many, grows some of the trees one after the other and adds
up what they give for the test rows. Trees stay in the task: what reaches the driver is a weight per feature.

The method is the usual one: every tree sees the rows as often as a Poisson draw of mean one says, each node looks at a third of
the features drawn anew (a single tree at all of them), and takes the split of greatest decrease of the
squared error among at most 32 bins a feature. A node is a leaf when its labels are equal, no split helps or it is too deep.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Row, functions as F

from loomprep.functions.columns import col, field
from loomprep.operators.features import FEATURES, LABEL, SEED
from loomprep.session import scratch_path

BINS = 32
# Training rows that the cuts between bins are drawn from, at least.
SAMPLED = 10_000
# Rows looked at together (few enough for a core's cache), cells of histograms filled together, bytes from which an array is
# kept in a file.
ROWS, CELLS, IN_FILE = 1 << 14, 1 << 17, 1 << 25
# Tasks that grow trees, for every core: so that none waits long for the last.
TASKS_A_CORE = 4
# A decrease under this share of a node's squared error is rounding.
LEAST_GAIN = 1e-12
NODE = np.dtype([("value", "<f8"), ("child", "<i8"), ("low", "<u4"), ("high", "<u4"), ("rest_left", "?")])


class Layout:
    """The cells of all features: one for each bin, those of a feature side by side. A feature that has but one bin has no cell.

    A row names only cells away from its features' bins of zero, so that rows with many zeros stay short.
    """

    def __init__(self, thresholds: Sequence[np.ndarray]) -> None:
        self.width = len(thresholds)
        self.thresholds = thresholds
        bins = np.array([len(t) + 1 for t in thresholds], np.int64)
        bins[bins == 1] = 0
        self.first = np.cumsum(bins) - bins
        self.size = int(bins.sum())
        self.zero = np.array([np.searchsorted(t, 0.0) for t in thresholds], np.int64)
        self.kind = np.dtype("<u2" if self.size < 1 << 15 else "<u4")  # half of it is free, as differences wrap around
        # (features, cells of each, place of the bin of zero) of the features with equally many bins.
        self.alike = []
        for n in np.unique(bins[bins > 0]):
            which = np.flatnonzero(bins == n)
            self.alike.append((which, self.first[which][:, None] + np.arange(n), self.zero[which]))
        self.bins = bins

    def cells(self, features: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The cell of each value; ``size`` for one that need not be named."""
        out = np.full(len(values), self.size, np.int64)
        order = np.argsort(features, kind="stable")
        bounds = np.searchsorted(features[order], np.arange(self.width + 1))
        for f in np.unique(features).tolist():
            if self.bins[f]:
                at = order[bounds[f] : bounds[f + 1]]
                found = np.searchsorted(self.thresholds[f], values[at])  # a value on a threshold is to its left
                out[at] = np.where(found == self.zero[f], self.size, found + self.first[f])
        return out


def thresholds_of(values: np.ndarray, zeros: int, bins: int) -> np.ndarray:
    """At most ``bins - 1`` cuts between different values: all of them, or those at equal strides of the sorted rows."""
    found, counts = np.unique(values, return_counts=True)
    if zeros:
        found, counts = np.append(found, 0.0), np.append(counts, zeros)
        found, place = np.unique(found, return_inverse=True)
        counts = np.bincount(place, weights=counts).astype(np.int64)
    if len(found) < 2:
        return np.zeros(0)
    middle = found[:-1] / 2 + found[1:] / 2
    middle = np.where((middle >= found[:-1]) & (middle < found[1:]), middle, found[:-1])
    if len(middle) < bins:
        return middle
    below = np.cumsum(counts)
    wanted = below[-1] * np.arange(1, bins) / bins
    # The cut whose number of rows below comes nearest to each stride.
    after = np.clip(np.searchsorted(below[:-1], wanted), 0, len(middle) - 1)
    before = np.maximum(after - 1, 0)
    near = np.where(np.abs(below[before] - wanted) <= np.abs(below[after] - wanted), before, after)
    return middle[np.unique(near)]


def sparse_entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the entries of a column of vectors, sparse or dense."""
    values, indices = vectors.field("values"), vectors.field("indices")
    sizes = values.value_lengths().to_numpy(zero_copy_only=False)
    dense = vectors.field("type").to_numpy(zero_copy_only=False) == 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    feature = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    feature[~dense[row]] = indices.flatten().to_numpy(zero_copy_only=False)
    return row, feature, values.flatten().to_numpy(zero_copy_only=False)


def _layout(train: DataFrame, key: str, rows: int, width: int) -> Layout:
    """Cuts from a sample of the training rows, as many as MLlib draws for them; every row is then sorted into the bins."""
    bins = min(BINS, max(rows, 2))
    wanted = max(bins * bins, SAMPLED)
    # The rows of a partition come in any order, the sample goes by it.
    some = train if rows <= wanted else train.select(col(key), FEATURES).sortWithinPartitions(col(key)).sample(False, wanted / rows, SEED)
    vectors = [r[0] for r in some.select(FEATURES).collect()]
    row, feature, value = [], [], []
    for v in vectors:
        found = np.flatnonzero(v.toArray()) if not hasattr(v, "indices") else v.indices
        feature.append(found)
        value.append(v.values if hasattr(v, "indices") else v.values[found])
    feature, value = np.concatenate([np.zeros(0, np.int64), *feature]), np.concatenate([np.zeros(0), *value])
    order = np.argsort(feature, kind="stable")
    bounds = np.searchsorted(feature[order], np.arange(width + 1))
    each = [value[order[low:high]] for low, high in zip(bounds[:-1], bounds[1:])]
    cuts = [thresholds_of(v, len(vectors) - len(v), bins) for v in each]
    alone = [f for f, c in enumerate(cuts) if not len(c)]
    if alone and some is not train:
        # The sample has one value; a rare one beside it still has to be told apart.
        ends = train.select(Summarizer.metrics("min", "max").summary(F.col(FEATURES)).alias("s")).select("s.*").first()
        least, greatest = ends["min"].toArray(), ends["max"].toArray()
        for f in alone:
            cuts[f] = thresholds_of(np.array([least[f], *each[f][:1], greatest[f]]), len(vectors) - len(each[f]), bins)
    return Layout(cuts)


def _pack(df: DataFrame, key: str, layout: Layout) -> DataFrame:
    """(block, n, k, cells, labels, keys): a block of rows in a row, its cells as a table of n rows of k, filled up with ``size``.
    Written, so that a block always has the same rows."""
    spark = df.sparkSession
    kind = field(df, key).dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            n = batch.num_rows
            if not n:
                continue
            row, feature, value = sparse_entries(batch.column(1))
            cell = layout.cells(feature, value)
            row, cell = row[cell < layout.size], cell[cell < layout.size]
            each = np.bincount(row, minlength=n)
            k = int(each.max())
            table = np.full((n, k), layout.size, layout.kind)
            table[row, np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)] = cell
            labels = batch.column(2).to_numpy(zero_copy_only=False).astype("<f8")
            keys = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + i]), pa.array([n]), pa.array([k]), pa.array([table.tobytes()]), pa.array([labels.tobytes()]), keys],
                names=["block", "n", "k", "cells", "labels", "keys"],
            )

    path = scratch_path(spark, "forest-rows")
    schema = f"block bigint, n bigint, k bigint, cells binary, labels binary, keys array<{kind}>"
    plain = df.sortWithinPartitions(col(key)).select(col(key), F.unwrap_udt(col(FEATURES)).alias(FEATURES), col(LABEL).cast("double"))
    plain.mapInArrow(packed, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


class Shelf:
    """Arrays in memory or, where they are large, in files of a folder that goes with them."""

    def __init__(self, folder: str) -> None:
        self.folder, self.number = folder, 0

    def path(self) -> str:
        self.number += 1
        return os.path.join(self.folder, str(self.number))

    def array(self, shape: tuple[int, ...], kind: Any) -> np.ndarray:
        if math.prod(shape) * np.dtype(kind).itemsize < IN_FILE:
            return np.empty(shape, kind)
        return np.memmap(self.path(), kind, "w+", shape=shape)


@dataclass
class Rows:
    """Labels, how often each counts, and cells."""

    labels: np.ndarray
    times: np.ndarray
    cells: np.ndarray

    @classmethod
    def on(cls, shelf: Shelf, n: int, k: int, layout: Layout) -> Rows:
        return cls(shelf.array((n,), "<f8"), shelf.array((n,), "u1"), shelf.array((n, k), layout.kind))

    def put(self, at: slice | np.ndarray, labels: np.ndarray, times: np.ndarray, cells: np.ndarray) -> None:
        self.labels[at], self.times[at], self.cells[at] = labels, times, cells

    def part(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.asarray(self.labels[low:high]), np.asarray(self.times[low:high]), np.asarray(self.cells[low:high])


def _slices(low: int, high: int) -> list[tuple[int, int]]:
    return [(a, min(a + ROWS, high)) for a in range(low, high, ROWS)]


def _best_splits(
    counts: np.ndarray, sums: np.ndarray, weight: np.ndarray, layout: Layout, looked_at: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, last bin to the left) of each node; the sums are of labels less the node's mean, so they add up to 0."""
    n = len(weight)
    gain, feature, last = np.full(n, -1.0), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for which, cells, zero in layout.alike:
        places = np.arange(len(which))
        left, less = counts[:, cells], sums[:, cells]
        left[:, places, zero] = weight[:, None] - left.sum(axis=2)
        less[:, places, zero] = -less.sum(axis=2)
        left, less = np.cumsum(left[:, :, :-1], axis=2), np.cumsum(less[:, :, :-1], axis=2)
        right = weight[:, None, None] - left
        fits = (left > 0) & (right > 0)
        if looked_at is not None:
            fits &= looked_at[:, which][:, :, None]
        value = np.where(fits, less * less * weight[:, None, None] / np.where(fits, left * right, 1.0), -1.0).reshape(n, -1)
        top = value.argmax(axis=1)
        found, at = value[np.arange(n), top], which[top // left.shape[2]]
        better = (found > gain) | ((found == gain) & (at < feature))  # of equal ones the first feature's first cut
        gain[better], feature[better], last[better] = found[better], at[better], (top % left.shape[2])[better]
    return gain, feature, last


def grow(here: Rows, there: Rows, n: int, layout: Layout, depth: int, looked: int, seed: Sequence[int], path: str) -> np.ndarray:
    """Grow a tree from the first ``n`` rows and write its nodes to ``path``, a level after the other; the decrease of the squared
    error by feature. Rows lie by their node and are moved to the other place from level to level, in parts of ROWS."""
    weights = np.zeros(layout.width)
    sizes, numbered = np.array([n], np.int64), 0
    size = layout.size + 1  # with the cell that fills up
    most = max(1, CELLS // max(size, layout.width))
    with open(path, "wb") as file:
        for level in range(depth + 1):
            ends = np.cumsum(sizes)
            numbered += len(sizes)
            splits, free, following, first = 0, 0, [], 0
            while first < len(sizes):
                start = int(ends[first] - sizes[first])
                end = min(first + most, int(np.searchsorted(ends, start + ROWS, "right")))
                end = max(end, first + 1)
                stop, m = int(ends[end - 1]), end - first
                parts = _slices(start, stop) if m == 1 else [(start, stop)]
                node = np.repeat(np.arange(m), sizes[first:end]) if m > 1 else None
                begin = ends[first:end] - sizes[first:end] - start

                weight, total, least, greatest = np.zeros(m), np.zeros(m), np.full(m, np.inf), np.full(m, -np.inf)
                for a, b in parts:
                    y, w, _ = here.part(a, b)
                    at = begin if m > 1 else [0]
                    weight += np.add.reduceat(w, at, dtype=np.float64)
                    total += np.add.reduceat(w * y, at)
                    least = np.minimum(least, np.minimum.reduceat(y, at))
                    greatest = np.maximum(greatest, np.maximum.reduceat(y, at))
                mean = total / weight
                nodes = np.zeros(m, NODE)
                nodes["value"] = np.where(least == greatest, least, np.clip(mean, least, greatest))
                goes_on = (greatest > least) & (level < depth)
                if goes_on.any() and layout.size:
                    opened = np.flatnonzero(goes_on)
                    place = np.cumsum(goes_on) - 1
                    counts, sums, error = np.zeros(len(opened) * size), np.zeros(len(opened) * size), np.zeros(len(opened))
                    for a, b in parts:
                        y, w, c = here.part(a, b)
                        at = np.zeros(b - a, np.int64) if node is None else node
                        if len(opened) < m:
                            kept = goes_on[at]
                            y, w, c, at = y[kept], w[kept], c[kept], at[kept]
                        off = y - mean[at]
                        at, w = place[at], w.astype(np.float64)
                        cell = ((at * size)[:, None] + c).ravel()
                        off_w = off * w
                        error += np.bincount(at, off * off_w, len(opened))
                        counts += np.bincount(cell, np.repeat(w, c.shape[1]), len(counts))
                        sums += np.bincount(cell, np.repeat(off_w, c.shape[1]), len(sums))
                    looked_at = None
                    if looked < layout.width:
                        draw = np.random.default_rng([*seed, level, numbered - len(sizes) + first])
                        chosen = draw.random((len(opened), layout.width), np.float32).argpartition(looked - 1, axis=1)[:, :looked]
                        looked_at = np.zeros((len(opened), layout.width), bool)
                        np.put_along_axis(looked_at, chosen, True, axis=1)
                    gain, feature, last = _best_splits(
                        counts.reshape(-1, size), sums.reshape(-1, size), weight[opened], layout, looked_at
                    )
                    helps = gain > LEAST_GAIN * error
                    cut, feature, last = opened[helps], feature[helps], last[helps]
                    weights += np.bincount(feature, gain[helps], layout.width)
                    if len(cut):
                        # Rows with a named cell of this feature from low to high are on one side, the rest on the other.
                        lowest, border = layout.first[feature], layout.first[feature] + last
                        rest_left = layout.zero[feature] <= last
                        nodes["rest_left"][cut] = rest_left
                        nodes["low"][cut] = np.where(rest_left, border + 1, lowest)
                        nodes["high"][cut] = np.where(rest_left, lowest + layout.bins[feature] - 1, border)
                        nodes["child"][cut] = numbered + 2 * (splits + np.arange(len(cut)))
                        splits += len(cut)
                        lefts, rights = _move(here, there, parts, node, nodes, cut, sizes[first:end], free)
                        free += int(sizes[first:end][cut].sum())
                        following.append(np.column_stack([lefts, rights]).ravel())
                nodes.tofile(file)
                first = end
            if not following:
                break
            sizes = np.concatenate(following)
            here, there = there, here
    return weights


def _goes_right(cells: np.ndarray, low: np.ndarray, high: np.ndarray, rest_left: np.ndarray) -> np.ndarray:
    low, span = low.astype(cells.dtype), (high - low).astype(cells.dtype)  # what is under ``low`` wraps around
    if cells.shape[1] > 16:
        return ((cells - low[:, None]) <= span[:, None]).any(axis=1) == rest_left
    named = np.zeros(len(cells), bool)
    for column in cells.T:
        named |= (column - low) <= span
    return named == rest_left


def _move(
    here: Rows, there: Rows, parts: list[tuple[int, int]], node: np.ndarray | None, nodes: np.ndarray, cut: np.ndarray, sizes: np.ndarray, free: int
) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the split nodes go to ``there`` from ``free`` on, those of a left child before those of the right one; the
    numbers of both."""
    low, high, rest_left = (nodes[k][cut] for k in ("low", "high", "rest_left"))
    if node is None:  # one node, perhaps in several parts: the right child is filled from the end
        front, back = free, free + int(sizes[0])
        for a, b in parts:
            y, w, c = here.part(a, b)
            right = _goes_right(c, *(np.broadcast_to(x, (b - a,)) for x in (low, high, rest_left)))
            n = int(right.sum())
            there.put(slice(front, front + b - a - n), y[~right], w[~right], c[~right])
            there.put(slice(back - n, back), y[right], w[right], c[right])
            front, back = front + b - a - n, back - n
        return np.array([front - free]), np.array([free + int(sizes[0]) - back])
    (a, b) = parts[0]
    y, w, c = here.part(a, b)
    place = np.full(len(nodes), -1)
    place[cut] = np.arange(len(cut))
    at = place[node]
    if len(cut) < len(nodes):
        kept = at >= 0
        y, w, c, at = y[kept], w[kept], c[kept], at[kept]
    right = _goes_right(c, low[at], high[at], rest_left[at])
    sizes = sizes[cut]
    begin = np.cumsum(sizes) - sizes
    rights = np.add.reduceat(right, begin, dtype=np.int64)
    lefts = sizes - rights
    upto = np.cumsum(right)  # rows to the right, this one too
    before = (upto[begin] - right[begin])[at]
    to_right = begin[at] + lefts[at] + upto - before - 1
    to_left = np.arange(len(at)) - (upto - before)
    order = np.empty(len(at), np.int64)
    order[np.where(right, to_right, to_left)] = np.arange(len(at))
    there.put(slice(free, free + len(at)), y[order], w[order], c[order])
    return lefts, rights


def predicted(nodes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The value of the leaf of each row."""
    at, going = np.zeros(len(cells), np.int64), np.arange(len(cells))
    while len(going):
        found = nodes[at[going]]
        inner = found["child"] > 0
        going, found = going[inner], found[inner]
        at[going] = found["child"] + _goes_right(cells[going], found["low"], found["high"], found["rest_left"])
    return nodes["value"][at]


def _growing(
    layout: Layout, n_train: int, n_test: int, k: int, tasks: int, trees: int, depth: int, bootstrap: bool
) -> Callable[[int, Iterator[Row]], Iterator[tuple[int, int, bytes]]]:
    """For a task's number and all blocks: (block, task, sum over the task's trees) of the test blocks; weights as block -1."""

    def grown(task: int, blocks: Iterator[Row]) -> Iterator[tuple[int, int, bytes]]:
        with tempfile.TemporaryDirectory(prefix="forest-") as folder:
            shelf = Shelf(folder)
            labels = shelf.array((n_train,), "<f8")
            cells = {True: shelf.array((n_test, k), layout.kind), False: shelf.array((n_train, k), layout.kind)}
            places: dict[bool, list[tuple[int, int, int]]] = {True: [], False: []}
            ends = {True: 0, False: 0}
            for r in blocks:
                low = ends[r["is_test"]]
                ends[r["is_test"]] = high = low + r["n"]
                places[r["is_test"]].append((r["block"], low, high))
                into = cells[r["is_test"]]
                into[low:high, r["k"] :] = layout.size
                into[low:high, : r["k"]] = np.frombuffer(r["cells"], layout.kind).reshape(r["n"], r["k"])
                if not r["is_test"]:
                    labels[low:high] = np.frombuffer(r["labels"], "<f8")
            if (ends[False], ends[True]) != (n_train, n_test):
                raise RuntimeError(f"{ends} rows instead of {n_train} and {n_test}")
            here, there = (Rows.on(shelf, n_train, k, layout) for _ in range(2))
            sums, weights = shelf.array((n_test,), "<f8"), np.zeros(layout.width)
            sums[:] = 0.0
            path = shelf.path()
            looked = layout.width if trees == 1 else math.ceil(layout.width / 3)
            for tree in range(task, trees, tasks):
                n = 0
                for block, a, b in places[False]:
                    for low, high in _slices(a, b):
                        drawn = np.random.default_rng([SEED, tree, block, low - a]).poisson(1.0, high - low) if bootstrap else np.ones(high - low, int)
                        kept = np.flatnonzero(drawn)
                        here.put(slice(n, n + len(kept)), labels[low:high][kept], drawn[kept], cells[False][low:high][kept])
                        n += len(kept)
                if not n:  # no row was drawn
                    here.put(slice(0, n_train), labels, np.ones(n_train, int), cells[False])
                    n = n_train
                part = grow(here, there, n, layout, depth, looked, [SEED, tree], path)
                weights += part / (part.sum() or 1.0)
                nodes = np.fromfile(path, NODE) if os.path.getsize(path) < IN_FILE else np.memmap(path, NODE, "r")
                for low, high in _slices(0, n_test):
                    sums[low:high] += predicted(nodes, cells[True][low:high])
                del nodes
            for block, low, high in places[True]:
                yield block, task, sums[low:high].tobytes()
            yield -1, task, weights.tobytes()

    return grown


def grow_forest(
    train: DataFrame, test: DataFrame, key: str, width: int, trees: int, depth: int, bootstrap: bool = True
) -> tuple[DataFrame, np.ndarray]:
    """(key, label, prediction) of the test rows, written, and the features' weights, which add up to one."""
    spark = train.sparkSession
    context = spark.sparkContext
    layout = _layout(train, key, train.count(), width)
    packed = {flag: _pack(df, key, layout) for flag, df in ((False, train), (True, test))}
    seen = {flag: df.agg(F.sum("n"), F.max("k")).first() for flag, df in packed.items()}
    n_train, n_test = (int(seen[flag][0] or 0) for flag in (False, True))
    k = max(int(seen[flag][1] or 0) for flag in (False, True))
    tasks = min(trees, TASKS_A_CORE * context.defaultParallelism)
    # Every task reads all blocks. A union of DataFrames of one partition each would be brought into one task.
    blocks = [df.select(F.lit(flag).alias("is_test"), "block", "n", "k", "cells", "labels") for flag, df in packed.items()]
    read = blocks[0].unionByName(blocks[1]).rdd.coalesce(1)
    grown = context.union([read] * tasks).mapPartitionsWithIndex(_growing(layout, n_train, n_test, k, tasks, trees, depth, bootstrap))
    path = scratch_path(spark, "forest-sums")
    schema = "block bigint, task bigint, sums binary"
    spark.createDataFrame(grown, schema, verifySchema=False).write.parquet(path)
    found = spark.read.schema(schema).parquet(path)
    weights = np.sum([np.frombuffer(r["sums"]) for r in found.where("block = -1").orderBy("task").collect()], axis=0)

    kind = packed[True].schema["keys"].dataType
    names = [key, LABEL, "prediction"]

    def averaged(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")  # the test block itself is the first
        parts = [np.frombuffer(x.as_py(), "<f8") for x in table.column("sums")]
        keys = table.column("keys").combine_chunks().flatten()
        return pa.Table.from_arrays([keys, pa.array(parts[0]), pa.array(np.sum(parts[1:], axis=0) / trees)], names=names)

    known = packed[True].select("block", F.lit(-1).cast("bigint").alias("task"), F.col("labels").alias("sums"), "keys")
    each = found.where("block <> -1").withColumn("keys", F.lit(None).cast(kind))
    out = scratch_path(spark, "forest-predictions")
    made = f"`{key}` {kind.elementType.simpleString()}, {LABEL} double, prediction double"
    known.unionByName(each).groupBy("block").applyInArrow(averaged, made).write.parquet(out)
    predictions = spark.read.schema(made).parquet(out)
    return predictions, weights / (weights.sum() or 1.0)
