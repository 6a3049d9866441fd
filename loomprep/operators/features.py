"""Feature preparation: typed columns, one-hot and label encoding, complete cases, train/test split."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomprep.functions.columns import col, field
from loomprep.functions.convert import numeric_value
from loomprep.functions.nulls import complete_cases
from loomprep.operators.classify import infer_types
from loomprep.operators.ordered import row_numbers
from loomprep.session import scratch_path

SEED = 42
BOUNDARY_ROWS = 100_000
# A column's levels up to this many are broadcast to the rows; they were counted before.
BROADCAST_LEVELS = 100_000
# Hexadecimal digits of a key's hash that one level of counts looks at.
DIGITS_A_LEVEL = 3

FEATURES, LABEL = "features", "label"
UNUSABLE = ("datetime", "text", "empty")


def levels(df: DataFrame, column: str) -> DataFrame:
    """(level) different present values as text, ascending when collected by :func:`one_hot`."""
    return df.where(col(column).isNotNull()).select(col(column).cast("string").alias("level")).distinct()


def one_hot(df: DataFrame, columns: Sequence[str], drop_first: bool = True) -> DataFrame:
    """Replace each column by one 0/1 column per level, named ``column_level``; a missing value is all zeros."""
    out: list[Column] = [col(c) for c in df.columns if c not in columns]
    for c in columns:
        found = sorted(r["level"] for r in levels(df, c).collect())  # the names of the new columns
        for level in found[1:] if drop_first else found:
            hit = F.coalesce(col(c).cast("string") == F.lit(level), F.lit(False))
            out.append(hit.cast("int").alias(f"{c}_{level}"))
    return df.select(out)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(level, code): ascending levels numbered from 0, whatever their number."""
    numbered = row_numbers(levels(df, column), "level", name="code")
    return numbered.withColumn("code", F.col("code") - 1)


def label_encode(df: DataFrame, column: str, output: str) -> DataFrame:
    """Add the code of each present value; a missing value has none."""
    codes = label_codes(df, column)
    key = "__level"
    return (
        df.withColumn(key, col(column).cast("string"))
        .join(codes.withColumnRenamed("level", key).withColumnRenamed("code", output), key, "left")
        .select(*[col(c) for c in df.columns], col(output))
    )


@dataclass
class PreparedData:
    """Feature vectors and labels with what was done to get them.

    ``names`` is a table of (place, feature): the levels of a column may be many, and nothing here needs them on the driver.
    """

    data: DataFrame
    names: DataFrame
    n_features: int
    classes: list[str] | None
    rows_dropped: int
    rows: int = 0

    @cached_property
    def feature_names(self) -> list[str]:
        """All names on the driver, for models that report a weight for each."""
        return [r["feature"] for r in self.names.orderBy("place").collect()]


def drop_unusable(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop the date, text and empty columns, which no model here can use."""
    kinds = infer_types(df)
    return df.select([col(c) for c in df.columns if c in keep or kinds[c] not in UNUSABLE])


def prepare_features(
    df: DataFrame, target: str, keep: Sequence[str] = (), task: str | None = None
) -> PreparedData:
    """Vectors and labels: date, text and empty columns go, categories become one-hot (first level dropped), the
    target becomes a class code where it is no number or the task is classification, and rows with a gap in a number
    or the target go.

    ``keep`` names columns to carry along (for example the row key).
    """
    field(df, target)
    kinds = infer_types(df)
    names = [c for c in df.columns if c != target and c not in keep]
    numeric = [c for c in names if kinds[c] in ("numeric", "boolean")]
    grouped = [c for c in names if kinds[c] == "categorical"]
    picked = [numeric_value(col(c), field(df, c).dataType).alias(f"n{i}") for i, c in enumerate(numeric)]
    firsts = _first_levels(df, grouped)
    # A gap joins the dropped first level, which is all zeros.
    picked += [F.coalesce(col(c).cast("string"), F.lit(firsts[c])).alias(f"c{i}") for i, c in enumerate(grouped)]
    encode = task == "classification" or kinds[target] != "numeric"
    goal = col(target).cast("string") if encode else numeric_value(col(target), field(df, target).dataType)
    work = df.select(*[col(k) for k in keep], *picked, goal.alias("__target"))
    needed = [f"n{i}" for i in range(len(numeric))] + ["__target"]
    complete = complete_cases(work, needed)
    # Counting both sides reads the few needed columns once.
    counted = work.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.when(_all_present(needed), F.lit(True)).otherwise(False)).alias("kept"),
    ).first()

    spark = df.sparkSession
    tables = [spark.createDataFrame([(i, n) for i, n in enumerate(numeric)], "place bigint, feature string")]
    inputs, width = [f"n{i}" for i in range(len(numeric))], len(numeric)
    whole = complete
    coded_columns = [*[f"c{i}" for i in range(len(grouped))], *(["__target"] if encode else [])]
    dictionary, sizes = _dictionary(whole, coded_columns)
    for i, c in enumerate(grouped):
        # Levels are numbered downwards, so that the first one is the last and is the one left out.
        n = sizes.get(i, 0)
        if n < 2:
            continue
        codes = dictionary.where(F.col("place") == i).select("level", "code")
        down = codes.select(F.col("level").alias(f"c{i}"), (F.lit(n - 1) - F.col("code")).cast("double").alias(f"c{i}i"))
        complete = complete.join(F.broadcast(down) if n <= BROADCAST_LEVELS else down, f"c{i}")
        inputs.append(f"c{i}v")
        shown = F.concat(F.lit(f"{c}_"), F.col("level"))
        tables.append(codes.where("code > 0").select((F.lit(width + n - 1) - F.col("code")).alias("place"), shown.alias("feature")))
        width += n - 1
    coded = [f"c{i}i" for i in range(len(grouped)) if f"c{i}v" in inputs]
    if coded:
        encoder = OneHotEncoder(inputCols=coded, outputCols=[f"{c[:-1]}v" for c in coded], dropLast=True)
        complete = encoder.fit(complete).transform(complete)
    classes = None
    if encode:
        found = dictionary.where(F.col("place") == len(grouped)).select("level", "code")
        classes = [r["level"] for r in found.orderBy("code").collect()]  # as many as a model can tell apart
        coded_classes = found.select(F.col("level").alias("__target"), F.col("code").cast("double").alias(LABEL))
        complete = complete.join(F.broadcast(coded_classes), "__target")
    else:
        complete = complete.withColumn(LABEL, F.col("__target"))
    data = VectorAssembler(inputCols=inputs, outputCol=FEATURES).transform(complete)
    out = data.select(*[col(k) for k in keep], FEATURES, LABEL)
    return PreparedData(out, reduce(DataFrame.unionByName, tables), width, classes, counted["rows"] - counted["kept"], counted["kept"])


def _dictionary(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[int, int]]:
    """(place, level, code) of all columns from one reading of the table, written to the scratch folder, and the number of
    levels by the column's place. Ascending levels of a column are numbered from 0."""
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "place int, level string, code bigint"), {}
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), col(c).cast("string").alias("level")) for i, c in enumerate(columns)]))
    found = df.select(pairs.alias("one")).select("one.*").where("level IS NOT NULL").distinct()
    path = scratch_path(spark, "levels")
    numbered = row_numbers(found, ["place", "level"], name="number")
    numbered.write.parquet(path)
    numbered = spark.read.parquet(path)
    ranges = numbered.groupBy("place").agg(F.min("number").alias("low"), F.count(F.lit(1)).alias("n")).collect()  # a row per column
    lows = F.create_map(*[F.lit(x) for r in ranges for x in (r["place"], r["low"])]) if ranges else F.lit(None)
    coded = numbered.select("place", "level", (F.col("number") - F.element_at(lows, F.col("place"))).alias("code")) if ranges else numbered.withColumnRenamed("number", "code")
    return coded, {r["place"]: r["n"] for r in ranges}


def _all_present(names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(n).isNotNull()
    return condition


def _first_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    if not columns:
        return {}
    row = df.agg(*[F.min(col(c).cast("string")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] or "" for i, c in enumerate(columns)}


def test_sizes(counts: Mapping[object, int], test_size: float) -> dict[object, int] | None:
    """Test rows per class: proportional shares of ceil(size * n), rounded by largest remainder (ties: class order).

    None where a split by class is impossible: a class of one row, or fewer train or test rows than classes.
    """
    n = sum(counts.values())
    tests = math.ceil(test_size * n)
    if not counts or min(counts.values()) < 2 or tests < len(counts) or n - tests < len(counts):
        return None
    exact = {c: m * tests / n for c, m in counts.items()}
    sizes = {c: math.floor(x) for c, x in exact.items()}
    left = tests - sum(sizes.values())
    for c in sorted(counts, key=lambda c: (-(exact[c] - sizes[c]), c))[:left]:
        sizes[c] += 1
    return sizes


def _reached(counted: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """Of counts (g, ``by``, n), from the highest value down, the one per group that holds the wanted row; ``need`` goes on
    within it."""
    from_top = Window.partitionBy("g").orderBy(F.col(by).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counted.withColumn("upto", F.sum("n").over(from_top)).join(F.broadcast(wanted), "g")
    inside = (F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))
    return upto.where(inside).select("g", by, "n", (F.col("need") - F.col("upto") + F.col("n")).alias("need"))


def _boundaries(base: DataFrame, sizes: Mapping[str, int], boundary_rows: int) -> list[tuple[str, str, int]]:
    """(g, h, rows with it): per group of (g, h) the hash at the wanted place from the top.

    A level counts the next digits of the hashes that agree with the boundary so far, 4,096 counts a group at most, until
    so few rows are left that their hashes themselves are counted.
    """
    spark, rows, wanted, level = base.sparkSession, base, list(sizes.items()), 0
    while True:
        needs = spark.createDataFrame(wanted, "g string, need bigint")
        digits = F.substring("h", 1 + DIGITS_A_LEVEL * level, DIGITS_A_LEVEL)
        found = _reached(rows.groupBy("g", digits.alias("p")).agg(F.count(F.lit(1)).alias("n")), needs, "p").collect()
        edges = spark.createDataFrame([(r["g"], r["p"]) for r in found], "g string, p string")
        rows = rows.join(F.broadcast(edges), "g").where(digits == F.col("p")).select("g", "h")
        wanted, level = [(r["g"], r["need"]) for r in found], level + 1
        if max((r["n"] for r in found), default=0) <= boundary_rows or DIGITS_A_LEVEL * level >= 32:
            break
    needs = spark.createDataFrame(wanted, "g string, need bigint")
    last = _reached(rows.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n")), needs, "h")
    return [(r["g"], r["h"], r["n"]) for r in last.collect()]


def stratified_split(
    df: DataFrame, key: str, label: str | None = None, test_size: float = 0.2, flag: str = "is_test", boundary_rows: int = BOUNDARY_ROWS
) -> DataFrame:
    """Add a boolean column that marks the test rows.

    In each class the rows with the largest md5 of their key are the test rows; without a class column, or where a
    class is too small, in the whole table. No rows move: counts by three digits of the hash after another give one
    boundary hash per class, and the flag is a comparison with it. A missing class is a class of its own. Rows that share
    a key are on one side; where that would make the test side larger than asked for, it is an error. The driver holds one
    row per class.
    """
    group = F.coalesce(F.concat(F.lit("="), col(label).cast("string")), F.lit("")) if label else F.lit("")
    base = df.select(group.alias("g"), F.md5(col(key).cast("string")).alias("h"))
    sizes = None
    if label:
        small = base.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()
        sizes = test_sizes({r["g"]: r["n"] for r in small}, test_size)
    if sizes is None:
        group = F.lit("")
        base = base.withColumn("g", group)
        total = base.count()
        sizes = {"": math.ceil(test_size * total)}
    spark = df.sparkSession
    limits = _boundaries(base, sizes, boundary_rows)
    if double := [g for g, _, n in limits if n > 1]:
        raise ValueError(f"{key!r} is not unique: rows that share a key stand on the boundary of {len(double)} classes")
    limit_table = spark.createDataFrame([(g, h) for g, h, _ in limits], "__g string, __limit string")
    # Without the hint all rows of a class would be brought into one task.
    marked = df.withColumn("__g", group).join(F.broadcast(limit_table), "__g", "left")
    test = F.coalesce(F.md5(col(key).cast("string")) >= F.col("__limit"), F.lit(False))
    return marked.select(*[col(c) for c in df.columns], test.alias(flag))
