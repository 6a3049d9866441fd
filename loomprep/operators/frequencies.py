"""Distinct counts, most frequent values and modes from one narrow count per (column, value)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from loomprep.functions.columns import chunked, col, field, is_float, is_nested, is_temporal

# Longer texts are counted by their digest, so that the shuffle carries keys and not documents.
PLAIN_LENGTH = 64
# One generated row per column and input row: wider tables are counted in several scans of few columns each.
COLUMNS_PER_SCAN = 64


def _family(data_type: T.DataType) -> str | None:
    if isinstance(data_type, T.NullType):
        return None
    if isinstance(data_type, (T.IntegralType, T.BooleanType)) or is_temporal(data_type):
        return "bigint"
    if is_float(data_type):
        return "double"
    return "string"


def _key(df: DataFrame, name: str, family: str) -> Column:
    value, data_type = col(name), field(df, name).dataType
    if is_temporal(data_type):
        return F.unix_micros(value.cast("timestamp"))
    if isinstance(data_type, T.BooleanType):
        return value.cast("int").cast("bigint")
    if is_nested(data_type):
        return F.hex(value) if isinstance(data_type, T.BinaryType) else F.to_json(F.struct(value.alias("v")))
    return value.cast(family)


def _text(value: Column) -> tuple[Column, Column]:
    """Leading characters (all of them when few) and, for long texts, the digest of the whole text."""
    long = F.length(value) > PLAIN_LENGTH
    return F.when(long, F.substring(value, 1, PLAIN_LENGTH)).otherwise(value), F.when(long, F.md5(value))


def _counts(df: DataFrame, names: Sequence[str], family: str, long_texts: bool) -> DataFrame:
    """(name, value[, digest], count) over the present values. Equal values meet map-side, so hot ones stay cheap."""
    entries = []
    for name in names:
        key = _key(df, name, family)
        parts = [F.lit(name).alias("name")]
        if family == "string" and long_texts:
            head, digest = _text(key)
            parts += [head.alias("value"), digest.alias("digest")]
        else:
            parts += [key.alias("value")]
        entries.append(F.struct(*parts))
    flat = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("value").isNotNull())
    return flat.groupBy(flat.columns).agg(F.count(F.lit(1)).alias("count"))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, long_texts: bool = True) -> DataFrame:
    """(name, unique): number of different present values of each column, exactly.

    Columns are counted by storage family, which keeps shuffled keys at eight bytes for numbers and dates.
    """
    wanted = list(columns or df.columns)
    parts = []
    for family in ("bigint", "double", "string"):
        names = [c for c in wanted if _family(field(df, c).dataType) == family]
        for chunk in chunked(names, COLUMNS_PER_SCAN):
            counted = _counts(df, chunk, family, long_texts)
            parts.append(counted.groupBy("name").agg(F.count(F.lit(1)).alias("unique")))
    if not parts:
        return df.sparkSession.createDataFrame([], "name string, unique bigint")
    return reduce(DataFrame.unionAll, parts)


def approximate_distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, rsd: float = 0.01) -> DataFrame:
    """Opt-in sketch of :func:`distinct_counts`."""
    wanted = [c for c in (columns or df.columns) if _family(field(df, c).dataType)]
    row = df.agg(*[F.approx_count_distinct(col(c), rsd).alias(c) for c in wanted])
    entries = F.array(*[F.struct(F.lit(c).alias("name"), col(c).alias("unique")) for c in wanted])
    return row.select(F.inline(entries))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10, long_texts: bool = True) -> DataFrame:
    """(name, rank, value, count): the ``k`` most frequent present values of each column as text.

    Ties go to the smaller value. Texts over 64 characters are counted by their digest; only those that can be among
    the first ``k`` by count and leading characters are read again, and the whole texts settle their ties. Every task
    keeps its own best ``k`` per column before the final ranking.
    """
    as_text = df.select([col(c).cast("string").alias(c) for c in columns])
    counted = _counts(as_text, columns, "string", long_texts)
    by_value = Window.partitionBy("name").orderBy(F.col("count").desc(), F.col("value").asc())
    if long_texts:
        near = counted.withColumn("rank", F.rank().over(by_value)).where(F.col("rank") <= k).drop("rank")
        counted = _restore_texts(as_text, columns, near)
    ranked = counted.withColumn("rank", F.row_number().over(by_value))
    return ranked.where(F.col("rank") <= k).select("name", "rank", "value", "count")


def _restore_texts(as_text: DataFrame, columns: Sequence[str], near: DataFrame) -> DataFrame:
    """(name, value, count) with the whole text where a digest stood."""
    entries = [F.struct(F.lit(c).alias("name"), col(c).alias("text")) for c in columns]
    long = as_text.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.length("text") > PLAIN_LENGTH)
    wanted = near.where(F.col("digest").isNotNull())
    texts = long.withColumn("digest", F.md5("text")).join(wanted.select("name", "digest"), ["name", "digest"], "left_semi")
    whole = texts.groupBy("name", "digest").agg(F.min("text").alias("value"))
    restored = wanted.drop("value").join(whole, ["name", "digest"]).select("name", "value", "count")
    return near.where(F.col("digest").isNull()).select("name", "value", "count").unionByName(restored)


def value_frequencies(df: DataFrame, column: str) -> DataFrame:
    """(value, count) of the present values of one column, in its own type."""
    return df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def mode_of(df: DataFrame, column: str):
    """Most frequent present value, ties to the smallest; None when all are missing. Dates come as text."""
    counted = value_frequencies(df, column)
    best = F.min_by("value", F.struct(-F.col("count"), F.col("value")))
    # A date goes through the driver as text: a Python datetime would depend on the driver's time zone.
    return counted.agg((best.cast("string") if is_temporal(field(df, column).dataType) else best).alias("mode")).first()["mode"]


def has_long_texts(max_lengths: Sequence[int | None]) -> bool:
    return any((n or 0) > PLAIN_LENGTH for n in max_lengths)


__all__ = [
    "approximate_distinct_counts",
    "distinct_counts",
    "has_long_texts",
    "mode_of",
    "top_values",
    "value_frequencies",
]
