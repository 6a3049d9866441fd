"""Operators that follow row order, spread over key ranges instead of one sorted partition.

Rows are cut into ranges of (partition_by, order_by) at sampled keys. Each range is filled by a window of its
own; what one range hands to the next (last value, row count, ...) is one small row per range. A partition value
that holds a third of the table is simply cut into many ranges. Where the table is small, or no key was cut,
everything is one range and the plain window remains.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from loomprep.functions.columns import col, field, with_column
from loomprep.functions.convert import numeric_value

ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 32_768
SAMPLES_PER_RANGE = 10

BUCKET, HEAD, TAIL = "__range", "__head", "__tail"
HOUSEKEEPING = (BUCKET, HEAD, TAIL)
METHODS = ("forward", "backward", "interpolate")


@dataclass(frozen=True)
class Ranges:
    """Ascending cut keys; range i holds the keys from cut i up to, but without, cut i + 1. ``rows`` is the table's size."""

    order_by: tuple[str, ...]
    partition_by: tuple[str, ...]
    cuts: tuple[tuple, ...] = ()
    types: tuple[T.DataType, ...] = ()
    rows: int = 0

    @property
    def keys(self) -> tuple[str, ...]:
        return self.partition_by + self.order_by

    @property
    def count(self) -> int:
        return len(self.cuts) + 1


def plan_ranges(
    df: DataFrame,
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
    max_ranges: int = MAX_RANGES,
) -> Ranges:
    """Choose the cuts from a sample of the key columns; at most a fixed number of keys reaches the driver.

    No cut is needed where the whole table, or every partition of it, is small enough for one task.
    """
    order, parts = _names(order_by), _names(partition_by)
    if not order:
        raise ValueError("row order has no meaning in a distributed table: give order_by with a unique last key")
    for name in order + parts:
        field(df, name)
    plan = Ranges(order, parts)
    rows = df.count()
    wanted = min(max_ranges, math.ceil(rows / rows_per_range))
    if wanted <= 1:
        return plan
    if parts:
        sizes = df.groupBy([col(p) for p in parts]).agg(F.count(F.lit(1)).alias("n"))
        if sizes.agg(F.max("n")).first()[0] <= rows_per_range:
            return plan
    keys = df.select([col(k) for k in plan.keys])
    fraction = min(1.0, wanted * SAMPLES_PER_RANGE / rows)
    sample = keys.sample(fraction, seed=17) if fraction < 1.0 else keys
    picked = [tuple(r) for r in sample.orderBy([col(k) for k in plan.keys]).collect()]
    cuts: list[tuple] = []
    for i in range(1, wanted):
        if picked:
            cut = picked[min(len(picked) - 1, i * len(picked) // wanted)]
            if not cuts or cut != cuts[-1]:
                cuts.append(cut)
    return Ranges(order, parts, tuple(cuts), tuple(field(df, k).dataType for k in parts + order), rows)


def _names(names: str | Sequence[str]) -> tuple[str, ...]:
    return (names,) if isinstance(names, str) else tuple(names or ())


def _cut_array(df: DataFrame, plan: Ranges) -> Column:
    """All cuts as one array value, evaluated once per query."""
    key = T.StructType([T.StructField(f"k{i}", t) for i, t in enumerate(plan.types)])
    schema = T.StructType([T.StructField("cuts", T.ArrayType(key))])
    return df.sparkSession.createDataFrame([(list(plan.cuts),)], schema).scalar()


def assign_ranges(df: DataFrame, plan: Ranges) -> DataFrame:
    """Add the range number and whether the row's partition goes on before (head) and after (tail) the range."""
    if plan.count == 1:
        return df.withColumns({BUCKET: F.lit(0), HEAD: F.lit(False), TAIL: F.lit(False)})
    cuts = _cut_array(df, plan)
    key = F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(plan.keys)])
    # Halving search: one comparison per step, the range number grows by the cuts at or below the key.
    out = df.withColumn(BUCKET, F.lit(0))
    step = 1 << (len(plan.cuts).bit_length() - 1)
    while step:
        probe = F.get(cuts, F.col(BUCKET) + (step - 1))
        out = out.withColumn(BUCKET, F.col(BUCKET) + F.when(key >= probe, step).otherwise(0))
        step //= 2
    return out.withColumns(
        {
            HEAD: _same_partition(plan, F.get(cuts, F.col(BUCKET) - 1)),
            TAIL: _same_partition(plan, F.get(cuts, F.col(BUCKET))),
        }
    )


def bring_together(ranged: DataFrame, plan: Ranges) -> DataFrame:
    """Bring each range together. Small ranges share a task: what every task reports to the driver grows with the number of
    partitions, so that follows the rows, not the ranges."""
    configured = int(ranged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(plan.count, math.ceil(plan.rows / ROWS_PER_RANGE))
    if wanted > configured:
        return ranged.repartition(wanted, BUCKET)
    return ranged.repartition(BUCKET)


def _same_partition(plan: Ranges, cut: Column) -> Column:
    same = [col(p).eqNullSafe(cut.getField(f"k{i}")) for i, p in enumerate(plan.partition_by)]
    return cut.isNotNull() & reduce(lambda a, b: a & b, same, F.lit(True))


def within(df: DataFrame, plan: Ranges, first: int, last: int) -> DataFrame:
    """Rows of the ranges ``first`` to ``last``, as a plain comparison of the keys."""
    cuts = _cut_array(df, plan)
    key = F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(plan.keys)])
    inside = F.lit(True)
    if first > 0:
        inside = inside & (key >= F.get(cuts, F.lit(first - 1)))
    if last < plan.count - 1:
        inside = inside & (key < F.get(cuts, F.lit(last)))
    return df.where(inside)


def windows(plan: Ranges) -> tuple[WindowSpec, WindowSpec]:
    """Row order inside a range and partition, and its reverse (a running frame towards the end would be quadratic)."""
    parts = [F.col(BUCKET)] + [col(p) for p in plan.partition_by]
    ahead = Window.partitionBy(*parts).orderBy([col(k).asc() for k in plan.order_by])
    back = Window.partitionBy(*parts).orderBy([col(k).desc() for k in plan.order_by])
    return ahead, back


def range_frame(df: DataFrame, plan: Ranges) -> DataFrame:
    """(range, head_of, tail_of): every range with the partition values that cross its lower and upper cut."""
    spark = df.sparkSession
    parts = T.StructType([T.StructField(f"k{i}", field(df, p).dataType) for i, p in enumerate(plan.partition_by)])
    schema = T.StructType(
        [T.StructField(BUCKET, T.IntegerType()), T.StructField("head_of", parts), T.StructField("tail_of", parts)]
    )
    width = len(plan.partition_by)
    rows = [
        (
            i,
            plan.cuts[i - 1][:width] if i > 0 else None,
            plan.cuts[i][:width] if i < len(plan.cuts) else None,
        )
        for i in range(plan.count)
    ]
    return spark.createDataFrame(rows, schema)


def _strict_order(plan: Ranges, ahead: WindowSpec) -> Column:
    """True where the row has the same keys as the one before it: its place in the order is undefined."""
    key = F.struct(*[col(k) for k in plan.order_by])
    return F.lag(key).over(ahead).eqNullSafe(key)


def _checked(value: Column, tied: Column, data_type: T.DataType, plan: Ranges) -> Column:
    message = f"order_by {list(plan.order_by)} is not unique: add a tie-breaker"
    return F.when(tied, F.raise_error(F.lit(message)).cast(data_type)).otherwise(value)


def fill_ordered(
    df: DataFrame,
    methods: Mapping[str, str],
    order_by: str | Sequence[str] = (),
    partition_by: str | Sequence[str] = (),
    plan: Ranges | None = None,
) -> DataFrame:
    """Fill gaps of several columns in row order: forward, backward or linear interpolation by row position.

    Forward takes the last present value, backward the next. Interpolation draws a line by position, repeats the last
    value after the end and leaves a gap at the start; its result is DOUBLE.
    """
    for name, method in methods.items():
        field(df, name)
        if method not in METHODS:
            raise ValueError(f"unknown fill method {method!r}; choose from {METHODS}")
    plan = plan or plan_ranges(df, order_by, partition_by)
    source = df
    for name, method in methods.items():
        if method == "interpolate":
            source = with_column(source, name, numeric_value(col(name), field(df, name).dataType))
    ranged = assign_ranges(source, plan)
    ahead, back = windows(plan)
    if plan.count > 1:
        ranged = bring_together(ranged, plan)
        carried = _carry(source, ranged, methods, plan, ahead)
    work = ranged.withColumn("__tied", _strict_order(plan, ahead))
    if "interpolate" in methods.values():
        work = work.withColumn("__pos", F.row_number().over(ahead).cast("bigint"))
    names = list(methods)
    for i, name in enumerate(names):
        value, method = col(name), methods[name]
        seen = value
        if method == "interpolate":
            seen = F.when(value.isNotNull(), F.struct(F.col("__pos").alias("p"), value.alias("v")))
        if method in ("forward", "interpolate"):
            work = work.withColumn(f"__before{i}", F.last(seen, ignorenulls=True).over(ahead))
        if method in ("backward", "interpolate"):
            work = work.withColumn(f"__after{i}", F.last(seen, ignorenulls=True).over(back))
    if plan.count > 1:
        work = work.join(carried, BUCKET, "left")
    filled: dict[str, Column] = {}
    for i, name in enumerate(names):
        method, data_type = methods[name], field(source, name).dataType
        before, after = F.col(f"__before{i}"), F.col(f"__after{i}")
        shift = F.lit(0).cast("bigint")
        if plan.count > 1:
            shift = F.when(F.col(HEAD), F.coalesce("__offset", F.lit(0))).otherwise(0)
        carried_before = F.when(F.col(HEAD), F.col(f"__before_val{i}")) if plan.count > 1 else None
        carried_after = F.when(F.col(TAIL), F.col(f"__after_val{i}")) if plan.count > 1 else None
        if method == "forward":
            value = before if carried_before is None else F.coalesce(before, carried_before)
        elif method == "backward":
            value = after if carried_after is None else F.coalesce(after, carried_after)
        else:
            b_value, b_pos = before.getField("v"), before.getField("p") + shift
            a_value, a_pos = after.getField("v"), after.getField("p") + shift
            if plan.count > 1:
                b_pos = F.coalesce(b_pos, F.when(F.col(HEAD), F.col(f"__before_pos{i}")))
                b_value = F.coalesce(b_value, carried_before)
                a_pos = F.coalesce(a_pos, F.when(F.col(TAIL), F.col(f"__after_pos{i}")))
                a_value = F.coalesce(a_value, carried_after)
            pos = F.col("__pos") + shift
            line = b_value + (a_value - b_value) * F.try_divide(pos - b_pos, a_pos - b_pos)
            value = F.coalesce(col(name), F.when(b_value.isNotNull(), F.coalesce(line, b_value)))
        filled[name] = _checked(value, F.col("__tied"), data_type, plan)
    return work.select([filled[c].alias(c) if c in filled else col(c) for c in df.columns])


def _carry(
    source: DataFrame, ranged: DataFrame, methods: Mapping[str, str], plan: Ranges, ahead: WindowSpec
) -> DataFrame:
    """One row per range: row offset and values arriving from the ranges before and after it.

    Only rows of a partition that crosses a cut take part, so this holds at most one row per range however many
    partitions there are.
    """
    names = list(methods)
    looks_back = [i for i, n in enumerate(names) if methods[n] in ("forward", "interpolate")]
    looks_ahead = [i for i, n in enumerate(names) if methods[n] in ("backward", "interpolate")]
    slim = ranged.select(
        *[F.col(c) for c in HOUSEKEEPING],
        *[col(k).alias(f"__k{i}") for i, k in enumerate(plan.keys)],
        *[col(n).alias(f"__c{i}") for i, n in enumerate(names)],
        F.row_number().over(ahead).cast("bigint").alias("__pos"),
    )
    sums = [F.count_if(F.col(TAIL)).alias("rows")]
    for i in looks_back:
        at = F.when(F.col(TAIL) & F.col(f"__c{i}").isNotNull(), F.col("__pos"))
        sums += [F.max(at).alias(f"last_pos{i}"), F.max_by(F.col(f"__c{i}"), at).alias(f"last_val{i}")]
    for i in looks_ahead:
        at = F.when(F.col(HEAD) & F.col(f"__c{i}").isNotNull(), F.col("__pos"))
        sums += [F.min(at).alias(f"first_pos{i}"), F.min_by(F.col(f"__c{i}"), at).alias(f"first_val{i}")]
    # From here on: one row per range, at most MAX_RANGES rows.
    per_range = range_frame(source, plan).join(slim.groupBy(BUCKET).agg(*sums), BUCKET, "left")
    rows = F.coalesce("rows", F.lit(0))
    chain = Window.partitionBy("tail_of").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = per_range.where(F.col("tail_of").isNotNull()).withColumn("__through", F.sum(rows).over(chain))
    arriving = [(F.col(BUCKET) + 1).alias(BUCKET), F.col("__through").alias("__offset")]
    for i in looks_back:
        last = F.when(
            F.col(f"last_pos{i}").isNotNull(),
            F.struct((F.col("__through") - rows + F.col(f"last_pos{i}")).alias("p"), F.col(f"last_val{i}").alias("v")),
        )
        nearest = F.last(last, ignorenulls=True).over(chain)
        arriving += [nearest["p"].alias(f"__before_pos{i}"), nearest["v"].alias(f"__before_val{i}")]
    before = tails.select(*arriving)
    if not looks_ahead:
        return before
    heads = per_range.where(F.col("head_of").isNotNull()).join(before.select(BUCKET, "__offset"), BUCKET, "left")
    back = Window.partitionBy("head_of").orderBy(F.col(BUCKET).desc())
    back = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leaving = [(F.col(BUCKET) - 1).alias(BUCKET)]
    for i in looks_ahead:
        first = F.when(
            F.col(f"first_pos{i}").isNotNull(),
            F.struct((F.col("__offset") + F.col(f"first_pos{i}")).alias("p"), F.col(f"first_val{i}").alias("v")),
        )
        nearest = F.last(first, ignorenulls=True).over(back)
        leaving += [nearest["p"].alias(f"__after_pos{i}"), nearest["v"].alias(f"__after_val{i}")]
    return before.join(heads.select(*leaving), BUCKET, "full")


def row_numbers(
    df: DataFrame,
    order_by: str | Sequence[str],
    partition_by: str | Sequence[str] = (),
    name: str = "row_number",
    plan: Ranges | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in the order (within its partition)."""
    plan = plan or plan_ranges(df, order_by, partition_by)
    ranged = assign_ranges(df, plan)
    ahead, _ = windows(plan)
    if plan.count == 1:
        return ranged.withColumn(name, F.row_number().over(ahead).cast("bigint")).drop(*HOUSEKEEPING)
    per_range = range_frame(df, plan).join(
        ranged.groupBy(BUCKET).agg(F.count_if(F.col(TAIL)).alias("rows")), BUCKET, "left"
    )
    chain = Window.partitionBy("tail_of").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = per_range.where(F.col("tail_of").isNotNull()).select(
        F.sum(F.coalesce("rows", F.lit(0))).over(chain).alias("__offset"), (F.col(BUCKET) + 1).alias(BUCKET)
    )
    local = bring_together(ranged, plan).withColumn(name, F.row_number().over(ahead).cast("bigint"))
    placed = local.join(offsets, BUCKET, "left")
    shift = F.when(F.col(HEAD), F.coalesce("__offset", F.lit(0))).otherwise(0)
    return placed.withColumn(name, F.col(name) + shift).select(*[col(c) for c in df.columns], F.col(name))
