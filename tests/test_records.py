"""Delimited files whose quoted fields cross lines, read in parts; types of wide files in one job."""

import os
import random

import pytest

from loomprep.sources import readers
from loomprep.sources.records import ends_inside, split_records

FIELDS = ["plain", "", "two\nlines", 'say ""hi""', "a,b", "x\r\ny", '""', "long " * 30 + "\n" * 3 + "end", "5' pipe", "\n"]


def quoted(field):
    return f'"{field}"' if any(c in field for c in ',\n\r"') else field


def written(folder, name, rows, end="\n"):
    with open(os.path.join(folder, name), "w", newline="") as file:
        file.write("id,one,two" + end + "".join(",".join([str(i), *map(quoted, r)]) + end for i, r in enumerate(rows)))


def whole_file(spark, path):
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return reader.csv(path)


def as_set(df):
    return sorted(map(repr, (tuple(None if v is None else v.replace("\r\n", "\n") for v in r) for r in df.collect())))


@pytest.fixture
def small_parts(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    for k, v in old.items():
        spark.conf.set(k, v)


def test_a_line_ends_inside_a_field_or_not():
    assert not ends_inside('a,"b",c', False, ",") and ends_inside('a,"b', False, ",")
    assert not ends_inside('b",c', True, ",") and ends_inside('b"",c', True, ",")
    assert not ends_inside('5" pipe,x', False, ",")  # not the first character: a quote like any other
    assert ends_inside('b","c', True, ",") and not ends_inside('"a"x"y,z', False, ",")


@pytest.mark.parametrize("size", [64, 257, 1 << 20])
def test_parts_give_the_records_of_the_whole_file(spark, small_parts, tmp_path, size):
    draw = random.Random(size)
    for name in ("a.csv", "b.csv"):
        rows = [(draw.choice(FIELDS), draw.choice(FIELDS)) for _ in range(60)]
        written(tmp_path, name, rows, end=draw.choice(["\n", "\r\n"]))
    small_parts(size)
    path = str(tmp_path)
    got = split_records(spark, path, ",", "UTF-8", ["id", "one", "two"])
    if size < 1000:
        assert got.rdd.getNumPartitions() > 8
    assert as_set(got) == as_set(whole_file(spark, path))
    assert got.count() == 120


def test_lines_are_read_in_two_passes(spark, tmp_path):
    """One that tells how parts end, one that cuts them: nothing that is done with the records reads the lines again."""
    rows = [("x", "\n".join(["many", 'short ""lines""', "of", ""] * 50)) for _ in range(40)]
    written(tmp_path, "a.csv", rows)
    got = split_records(spark, str(tmp_path), ",", "UTF-8", ["id", "one", "two"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and as_set(got) == as_set(whole_file(spark, str(tmp_path)))


def test_a_header_that_goes_over_lines_and_parts(spark, small_parts, tmp_path):
    with open(tmp_path / "a.csv", "w") as file:
        file.write('\n"a\nlong name of a column that fills the first part",b\n1,"x\ny"\n2,z\n')
    small_parts(16)
    df = readers.read_table(spark, str(tmp_path / "a.csv"))
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x\ny"), (2, "z")] and df.columns[1] == "b"


def test_a_stray_quote_does_not_join_lines(spark, tmp_path):
    with open(tmp_path / "a.csv", "w") as file:
        file.write('a,b\n5" pipe,1\nx,2\n')
    rows = readers.read_table(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [('5" pipe', 1), ("x", 2)]


def test_wide_files_are_typed_in_one_job(spark, tmp_path):
    kinds = {"1": "bigint", "99999999999999999999": "decimal(38,0)", "1.5": "double", "true": "boolean", "x": "string", "": "string", "9" * 40: "string"}
    values = [list(kinds)[i % len(kinds)] for i in range(200)]
    with open(tmp_path / "wide.csv", "w") as file:
        file.write(",".join(f"c{i}" for i in range(200)) + "\n" + "".join(",".join(values) + "\n" for _ in range(3)) + "," * 199 + "\n")
    tracker = spark.sparkContext.statusTracker()
    raw = spark.read.option("header", True).csv(str(tmp_path / "wide.csv"))
    words = raw.select([readers.F.when(~readers.col(c).isin(*readers.MISSING_WORDS), readers.col(c)).alias(c) for c in raw.columns])
    spark.sparkContext.setJobGroup("typing", "typing")
    try:
        typed = readers._typed(words)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [t for _, t in typed.dtypes] == [kinds[v] for v in values]
    assert len(tracker.getJobIdsForGroup("typing")) <= 2  # the job and, with adaptive execution, its second stage
    assert typed.count() == 4
