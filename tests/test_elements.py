"""JSON files over several lines, read in parts."""

import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomprep.sources.elements import AT_ONCE, split_elements, steps, together
from loomprep.sources.readers import read_json, read_table

STRINGS = ["plain", "", 'say "hi"', "br[ack]et{s}", "back\\slash\\", '\\"', "é 日本 🎉", "two\nlines", "}]", '"{', "x" * 300]


def some_records(n, seed=3):
    draw = random.Random(seed)
    return [{"id": i, "s": draw.choice(STRINGS), "in": {"k": draw.choice(STRINGS), "l": [draw.randint(0, 9)] * draw.randint(0, 4)}} for i in range(n)]


@pytest.fixture
def small_parts(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, str(size)) for k in old]
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def read_back(df):
    return sorted((json.loads(r["value"]) for r in df.collect()), key=lambda r: r["id"])


def test_brackets_in_strings_do_not_count():
    assert steps(b'{"a[": ["\\"]", 1]}').tolist() == [1, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, -1, -1]


@pytest.mark.parametrize(("size", "ends"), [(300, "\n"), (1000, "\r\n"), (1 << 20, "\n")])
def test_arrays_and_objects_in_parts(spark, tmp_path, small_parts, size, ends):
    records = some_records(40)
    shapes = {
        "indented": json.dumps(records, indent=2, ensure_ascii=False), "no_indent": json.dumps(records, indent=0), "bom": "﻿" + json.dumps(records, indent=1),
        "a_line_each": "[\n" + ",\n".join(map(json.dumps, records)) + "\n]\n", "objects": "\n".join(json.dumps(r, indent=2) for r in records),
        "two_arrays": json.dumps(records[:20], indent=2) + "\n" + json.dumps(records[20:], indent=2), "one": json.dumps(records[0], indent=3),
    }
    small_parts(size)
    for name, text in shapes.items():
        path = tmp_path / f"{name}.json"
        path.write_bytes(text.replace("\n", ends).encode())
        found = split_elements(spark, str(path))
        assert read_back(found) == (records[:1] if name == "one" else records), name
    if size == 300:
        path = str(tmp_path / "indented.json")
        assert spark.read.text(path).rdd.getNumPartitions() > 8
        # Every file keeps its own depth, also in one folder.
        assert len(split_elements(spark, str(tmp_path)).collect()) == 6 * 40 + 1


def test_equal_to_reading_whole_files(spark, tmp_path, small_parts):
    path = str(tmp_path / "array.json")
    with open(path, "w") as file:
        json.dump(some_records(200), file, indent=2)
    small_parts(500)
    whole = spark.read.option("multiLine", True).json(path)
    for df in (read_json(spark, path), read_json(spark, path, schema=whole.schema), read_json(spark, path, multi_line=True)):
        assert df.schema == whole.schema and df.exceptAll(whole).count() == whole.exceptAll(df).count() == 0
    assert read_table(spark, path, flatten=True).columns == ["id", "in.k", "in.l", "s"]


def test_files_that_share_a_task_and_parts_that_cross_batches(spark, tmp_path, small_parts):
    records = some_records(60)
    (tmp_path / "d").mkdir()
    for i in range(6):
        (tmp_path / "d" / f"{i}.json").write_text(json.dumps(records[10 * i : 10 * i + 10], indent=2, ensure_ascii=False))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        small_parts(2500)
        assert read_back(split_elements(spark, str(tmp_path / "d"))) == records
    finally:
        spark.conf.set(size, old)


def test_lines_are_taken_together_as_bytes():
    lines = pa.array(["", '{"a"', "x" * AT_ONCE, "é}", "y" * (AT_ONCE // 2), "z" * AT_ONCE, ""])
    for some in (lines, lines.slice(1, 5), lines.slice(3, 1), lines.slice(0, 0)):
        found = list(together(some))
        assert b"".join(found) == "".join(f"{t} " for t in some.to_pylist()).encode()
        assert all(len(part) < AT_ONCE * 2 + 2 for part in found) and len(found) <= 1 + len(some)


def test_odd_files(spark, tmp_path):
    cases = {"empty": "", "blank": "\n \n", "no_elements": "[\n]\n", "not_objects": '[\n {"id": 1},\n 2,\n "x{"\n]', "cut_off": '[\n {"id": 1},\n {"id":\n'}
    for name, text in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = {n: sorted(r["value"].strip() for r in split_elements(spark, str(tmp_path / f"{n}.json")).collect()) for n in cases}
    assert found["empty"] == found["blank"] == found["no_elements"] == []
    assert found["not_objects"] == ['2,  "x{"', '{"id": 1}'] and found["cut_off"] == ['{"id":', '{"id": 1}']
    df = read_json(spark, str(tmp_path / "cut_off.json"), schema="id long")
    assert sorted(map(repr, (r["id"] for r in df.collect()))) == ["1", "None"]


def test_folder_of_all_kinds(spark, tmp_path):
    records = some_records(30)
    os.makedirs(tmp_path / "d.json")
    for name, text in (("a", json.dumps(records[:10], indent=1)), ("b", "\n".join(map(json.dumps, records[10:20]))), ("c", json.dumps(records[20:]))):
        (tmp_path / "d.json" / f"{name}.json").write_text(text)
    df = read_table(spark, str(tmp_path / "d.json"))
    assert sorted(r["id"] for r in df.select(F.col("id")).collect()) == list(range(30))
