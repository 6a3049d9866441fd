"""File sources: CSV, TSV, JSON and Parquet, chosen by suffix."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from loomprep.functions.columns import chunked, col, collect_aggregates
from loomprep.functions.convert import NUMBER
from loomprep.functions.nulls import normalize_nulls
from loomprep.session import scratch_path
from loomprep.sources.elements import split_elements
from loomprep.sources.records import split_records

# Suffix to file type.
SUFFIXES = {
    ".csv": "CSV",
    ".tsv": "TSV",
    ".tab": "TSV",
    ".json": "JSON",
    ".parquet": "Parquet",
    ".pq": "Parquet",
}

# The words a delimited file uses for a missing value.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
BOOLEAN_WORDS = {"True": True, "TRUE": True, "true": True, "False": False, "FALSE": False, "false": False}
INTEGER = r"^[+-]?[0-9]+$"
WIDE_INTEGER = T.DecimalType(38, 0)
INFINITY = r"^[+-]?(?i)(inf|infinity)$"


def file_type(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported file type {suffix!r}; supported: {', '.join(SUFFIXES)}")
    return SUFFIXES[suffix]


def read_table(
    spark: SparkSession,
    path: str,
    row_limit: int | None = None,
    encoding: str = "UTF-8",
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
    flatten: bool = False,
) -> DataFrame:
    """Read a file or a folder of part files by its suffix; NaN becomes NULL."""
    kind = file_type(path)
    try:
        if kind == "CSV":
            df = read_delimited(spark, path, ",", encoding, schema, multi_line)
        elif kind == "TSV":
            df = read_delimited(spark, path, "\t", encoding, schema, multi_line)
        elif kind == "JSON":
            df = read_json(spark, path, schema, multi_line, flatten)
        else:
            df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"file not found: {path}") from error
        raise
    df = normalize_nulls(df)
    return df if row_limit is None else df.limit(row_limit)


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    encoding: str = "UTF-8",
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Header row, quoted fields, missing words to NULL, types from the whole columns unless a schema is given.

    A file is split over tasks also where quoted fields cross lines, which is checked when ``multi_line`` is None. Texts of
    two or four bytes a character are read by a task per file.
    """
    wide = encoding.upper().replace("-", "").startswith(("UTF16", "UTF32"))
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("quote", '"').option("escape", '"')
    if multi_line is None:
        multi_line = wide or _crosses_lines(spark, path, encoding)
    if multi_line and not wide:
        raw = split_records(spark, path, sep, encoding, reader.option("multiLine", True).csv(path).columns)
    else:
        raw = reader.option("multiLine", multi_line).csv(path)
    words = raw.select([F.when(~col(c).isin(*MISSING_WORDS), col(c)).alias(c) for c in raw.columns])
    if schema is None:
        return _typed(words)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return words.select([_read_as(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in wanted.fields])


def _crosses_lines(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether some line has an odd number of quotes, as one that starts or ends a field over the line break has."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.option("encoding", encoding).text(path).where(quotes % 2 == 1).head(1))


def _read_as(value, data_type: T.DataType):
    if isinstance(data_type, T.BooleanType):
        return F.when(value.isin([w for w, b in BOOLEAN_WORDS.items() if b]), F.lit(True)).when(
            value.isin([w for w, b in BOOLEAN_WORDS.items() if not b]), F.lit(False)
        )
    return value if isinstance(data_type, T.StringType) else F.trim(value).try_cast(data_type)


def _typed(words: DataFrame) -> DataFrame:
    """BIGINT, DOUBLE or BOOLEAN where every present value reads so; text otherwise.

    Whole numbers that a BIGINT cannot hold become DECIMAL(38, 0), and text where that cannot hold them either: as a DOUBLE
    different ones would read as one.
    """
    bits = {
        "whole": lambda c, text: text.rlike(INTEGER),
        "long": lambda c, text: text.rlike(INTEGER) & text.try_cast("bigint").isNotNull(),
        "wide": lambda c, text: text.rlike(INTEGER) & text.try_cast(WIDE_INTEGER).isNotNull(),
        "number": lambda c, text: text.rlike(NUMBER) | text.rlike(INFINITY),
        "flag": lambda c, text: col(c).isin(*BOOLEAN_WORDS),
        "absent": lambda c, text: F.lit(False),
    }

    def mask(c: str) -> Column:
        """A bit for everything that a value could be; a missing one could be anything."""
        marks = [F.when(test(c, F.trim(col(c))), 1 << i).otherwise(0) for i, test in enumerate(bits.values())]
        return F.when(col(c).isNull(), (1 << len(bits)) - 1).otherwise(reduce(lambda a, b: a + b, marks)).cast("bigint")

    # What all values of a column could be, ten columns in a number: one job for hundreds of columns.
    together = list(chunked(words.columns, 63 // len(bits)))
    exprs = {
        i: F.bit_and(reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(mask(c), len(bits) * j) for j, c in enumerate(part)]))
        for i, part in enumerate(together)
    }
    found = collect_aggregates(words, exprs)
    out = []
    for place, c in enumerate(words.columns):
        number, shift = divmod(place, 63 // len(bits))
        left = found[number]
        could = {name: left is not None and bool(left >> (len(bits) * shift + i) & 1) for i, name in enumerate(bits)}
        if could["absent"] or left is None:
            target: T.DataType = T.StringType()
        elif could["whole"]:
            target = T.LongType() if could["long"] else WIDE_INTEGER if could["wide"] else T.StringType()
        elif could["number"]:
            target = T.DoubleType()
        elif could["flag"]:
            target = T.BooleanType()
        else:
            target = T.StringType()
        out.append(_read_as(col(c), target).alias(c))
    return words.select(out)


def read_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
    flatten: bool = False,
) -> DataFrame:
    """Records from JSON Lines, or from an array or objects that go over several lines; a file is told by its first line.

    A file over several lines is read in parts by many tasks; without a schema its records are written as lines first. The
    driver holds the names of the files that are not in lines, or of those that are, when a folder has both.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    files: dict[bool, str | list[str]] = {not multi_line: path}
    if multi_line is None:
        first = (
            spark.read.text(path)
            .where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
            .select(F.col("_metadata.file_path").alias("file"), F.ltrim("value").alias("line"), F.monotonically_increasing_id().alias("place"))
            .groupBy("file")
            .agg(F.min_by("line", "place").alias("line"))
        )
        in_lines = first.select("file", F.get_json_object("line", "$").isNotNull().alias("lines"))
        kinds = {r["lines"] for r in in_lines.select("lines").distinct().collect()}
        files = {kinds != {False}: path}
        if len(kinds) > 1:
            files = {k: [r["file"] for r in in_lines.where(F.col("lines") == k).collect()] for k in (True, False)}
    parts = [reader.json(where) if lines else _over_lines(spark, reader, where, schema) for lines, where in files.items()]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return flatten_structs(df) if flatten else df


def _over_lines(spark: SparkSession, reader: DataFrameReader, path: str | list[str], schema: T.StructType | str | None) -> DataFrame:
    records = split_elements(spark, path)
    if schema:
        return records.select(F.from_json("value", schema).alias("r")).select("r.*")
    lines = scratch_path(spark, "json-lines")
    records.write.text(lines)
    return reader.json(lines)


def flatten_structs(df: DataFrame) -> DataFrame:
    """Nested record fields become columns named ``parent.child``."""

    def leaves(prefix: Sequence[str], data_type: T.DataType) -> list[tuple[str, ...]]:
        if not isinstance(data_type, T.StructType):
            return [tuple(prefix)]
        return [leaf for f in data_type.fields for leaf in leaves([*prefix, f.name], f.dataType)]

    paths = [p for f in df.schema.fields for p in leaves([f.name], f.dataType)]
    return df.select([F.col(".".join(f"`{part}`" for part in p)).alias(".".join(p)) for p in paths])


def first_rows(df: DataFrame, n: int, order_by: str | Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in the given order; without one, any ``n`` rows."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return (df.orderBy([col(k) for k in keys]) if keys else df).limit(n)


def cap_rows(
    df: DataFrame, order_by: str | Sequence[str], threshold: int, keep: int
) -> tuple[DataFrame, dict[str, int | bool]]:
    """Keep the asked number of rows of a table over the asked threshold, and say so. Neither has a default."""
    rows = df.count()
    if rows <= threshold:
        return df, {"limited": False, "original_total_rows": rows}
    return first_rows(df, keep, order_by), {"limited": True, "original_total_rows": rows}


def source_info(df: DataFrame, path: str, encoding: str | None = None) -> DataFrame:
    """One row: type, file_type, path, filename, encoding, total_rows, total_cols."""
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        F.lit("file").alias("type"),
        F.lit(file_type(path)).alias("file_type"),
        F.lit(path).alias("path"),
        F.lit(os.path.basename(path.rstrip("/"))).alias("filename"),
        F.lit(encoding).cast("string").alias("encoding"),
        "total_rows",
        F.lit(len(df.columns)).cast("bigint").alias("total_cols"),
    )
