"""What several operators of this folder share: tables, written intermediates, graph components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loomprep.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends, a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare(name: str, columns: Sequence[str]) -> str:
    """A column name that is not taken."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: The one large table that this Python worker holds: workers live on after a task, and so would tables of earlier jobs.
_held: dict[str, Any] = {}


def worker_table(key: str, load: Callable[[], Any]) -> Any:
    """What ``load`` gives for the key, kept until this worker asks for another."""
    if key not in _held:
        no_table()
        _held[key] = load()
    return _held[key]


def no_table() -> None:
    """For tasks that need no table: the one that this worker holds goes."""
    _held.clear()
    gc.collect()
    given_back()


def given_back() -> None:
    """Gives memory that is free to the system. Spark keeps a worker after its task, with all that it has not given back, and
    lets the others of the executor run beside it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
        ctypes.CDLL(None).malloc_trim(0)


def some_texts(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, after the last) of texts that go together, about ``most`` bytes."""
    low, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()):
        size += n
        if size >= most or i == len(texts) - 1:
            yield low, i + 1
            low, size = i + 1, 0


def bucketed(df: DataFrame, label: str, column: str, buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder whose files are dealt by ``column``: joins on it move only the other side."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
    df.write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(name)
    return spark.table(name)


#: Cells of a sieve, each of 64 bits.
CELLS = 1 << 18


def _spot(value: Column) -> tuple[Column, Column]:
    """The cell of a value, and its bit there."""
    hashed = F.xxhash64(value)
    return hashed.bitwiseAND(F.lit(CELLS - 1)), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(hashed, 32).bitwiseAND(F.lit(63)).cast("int"))


def sieve(values: DataFrame, label: str) -> DataFrame:
    """(cell, bits) of the only column of ``values``, for ``sifted``: at most CELLS rows, however many the values are."""
    cell, bit = _spot(F.col(values.columns[0]))
    return written(values.select(cell.alias("cell"), bit.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")), label)


def sifted(df: DataFrame, column: str, cells: DataFrame, name: str = "maybe") -> DataFrame:
    """``df`` with a boolean column ``name``: true in all rows whose ``column`` is one of the values of the sieve, and in
    some others. No row is moved: what is rare in a large table is picked out before a join that would move all of it, and
    that join still decides."""
    cell, bit = _spot(F.col(column))
    place, bits = spare("_cell", df.columns), spare("_bits", df.columns)
    marked = df.withColumn(place, cell).join(F.broadcast(cells.select(F.col("cell").alias(place), F.col("bits").alias(bits))), place, "left")
    return marked.withColumn(name, F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))).drop(place, bits)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b): root is the smallest node it can reach.

    Alternates the large-star and small-star steps, so the rounds grow with the logarithm of the longest path and a hub
    never gathers its neighbours in one row: a step is a minimum per node (combined before the shuffle) and a join whose
    hot keys the adaptive planner splits. Loops, repeated edges and nulls are allowed; nulls are left out.
    """
    stars = written(edges.select("a", "b").where("a <> b").distinct(), label)
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), label)
        large = written(
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), label
        )
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = written(down.groupBy("a").agg(F.min("b").alias("low")), label)
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        own = least.select("a", F.col("low").alias("b"))
        stars = written(small.unionByName(own).where("a <> b").distinct(), label)
        facts = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if facts == before:
            break
        before = facts
    roots = stars.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def scanned(df: DataFrame, order: list[Column], xors: Sequence[str] = (), label: str = "scanned") -> DataFrame:
    """``df`` with ``number``, each row's place from 1 in the given order over all rows, and for every long column named in
    ``xors`` its ``<name>_up_to``: the exclusive or of the column over all rows up to this one.

    A scan in two steps: rows are range-partitioned and sorted, every task runs its own part, and one row per task carries
    the rest. Rows with equal keys are told apart by where they were read, so that a key of a third of all rows is spread as
    well; which of them comes first is not defined. Nulls in ``xors`` count as zero.
    """
    spark, columns = df.sparkSession, df.columns
    ups = [f"{x}_up_to" for x in xors]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in ("_part", "number", *ups))])

    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, carried = TaskContext.get().partitionId(), 0, [np.int64(0)] * len(xors)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            made = [np.full(n, part, np.int64), np.arange(before + 1, before + n + 1)]
            for i, x in enumerate(xors):
                values = np.asarray(batch.column(x).fill_null(0), np.int64)
                made.append(np.bitwise_xor.accumulate(values) ^ carried[i])
                carried[i] = made[-1][-1]
            before += n
            own = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, made)], names=names)

    marked = df.withColumn("_read", F.monotonically_increasing_id())
    keys = [*order, F.col("_read")]
    rows = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read")
    local = written(rows.mapInArrow(run, schema), label)
    last = local.groupBy("_part").agg(F.max("number").alias("n"), *(F.max_by(u, "number").alias(u) for u in ups))
    offsets, total, carried = [], 0, [0] * len(ups)
    for r in sorted(last.collect(), key=lambda r: r["_part"]):
        offsets.append((r["_part"], total, *carried))
        total += r["n"]
        carried = [c ^ r[u] for c, u in zip(carried, ups, strict=True)]
    parts = spark.createDataFrame(offsets, ", ".join(f"{n} bigint" for n in ["_part", "_n0", *(f"_x{i}" for i in range(len(ups)))]))
    joined = local.join(F.broadcast(parts), "_part")
    up_to = [F.col(u).bitwiseXOR(F.col(f"_x{i}")).alias(u) for i, u in enumerate(ups)]
    return joined.select(*(F.col(c) for c in df.columns), (F.col("number") + F.col("_n0")).alias("number"), *up_to)
