"""Nothing is lost or changed on the way through files, logs and small statistics."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from loomprep.operators.charts import histogram
from loomprep.operators.correlation import correlation
from loomprep.operators.frequencies import distinct_counts, mode_of, top_values
from loomprep.operators.profile import datetime_stats
from loomprep.plans.audit import AuditLog
from loomprep.plans.replay import replay
from loomprep.session import scratch_path
from loomprep.sources.readers import read_table
from loomprep.sources.writers import write_table


def test_a_table_is_not_written_over_its_own_files(spark, tmp_path):
    source = write_table(spark.range(5).select("id", F.lit(1.5).alias("x")), str(tmp_path / "t"), "parquet")
    log = AuditLog(spark, str(tmp_path / "log"), "s")
    df = read_table(spark, source)
    log.record_load(df, {"path": source})
    log.record_operation("missing_values", {"x": {"strategy": "fill_mean"}}, df, df)
    log.record_export(df, source, "parquet")
    with pytest.raises(ValueError, match="another place"):
        replay(spark, log.events())
    assert read_table(spark, source).count() == 5
    cleaned, _ = replay(spark, log.events(), output=str(tmp_path / "other"))
    assert cleaned.count() == 5 and read_table(spark, str(tmp_path / "other.parquet")).count() == 5


def test_replay_reads_in_the_logged_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,x\nJosé,1\n".encode("latin-1"))
    log = AuditLog(spark, str(tmp_path / "log"), "s")
    df = read_table(spark, str(tmp_path / "a.csv"), encoding="ISO-8859-1")
    log.record_load(df, {"path": str(tmp_path / "a.csv"), "encoding": "ISO-8859-1"})
    assert replay(spark, log.events())[0].first()["name"] == "José"


def test_padded_texts_and_microseconds(spark, tmp_path):
    moment = dt.datetime(2024, 1, 2, 3, 4, 5, 123456)
    df = spark.createDataFrame([("  x  ", moment)], "t string, at timestamp")
    for fmt in ("csv", "tsv", "json"):
        back = read_table(spark, write_table(df, str(tmp_path / fmt), fmt), schema=df.schema)
        assert back.collect() == df.collect()


def test_intermediates_need_a_shared_folder_on_a_cluster(spark):
    absent = SimpleNamespace(get=lambda key, default=None: default)
    for master, fails in (("local[8]", False), ("local-cluster[2,1,512]", True), ("yarn", True)):
        context = SimpleNamespace(getConf=lambda: absent, master=master)
        session = SimpleNamespace(conf=absent, sparkContext=context)
        if fails:
            with pytest.raises(ValueError, match="share"):
                scratch_path(session, "x")
        else:
            assert "x-" in scratch_path(session, "x")


def test_long_texts_tie_by_the_whole_text(spark):
    head = "h" * 70
    rows = [(head + x,) for x in "fcaedb" for _ in range(2)] + [("short",)]
    df = spark.createDataFrame(rows, "t string")
    found = [r["value"] for r in top_values(df, ["t"], 4).orderBy("rank").collect()]
    assert found == [head + x for x in "abcd"] and found[0] == mode_of(df, "t")


def test_nested_values_are_counted(spark):
    df = spark.sql("select array(id % 3) a, struct(id % 2 as x) s, cast(string(id % 4) as binary) b, map('k', id % 5) m from range(20)")
    assert {r["name"]: r["unique"] for r in distinct_counts(df).collect()} == {"a": 3, "s": 2, "b": 4, "m": 5}


def test_infinite_values_are_in_no_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(float("inf"),), (float("-inf"),)], "x double")
    assert [r["count"] for r in histogram(df, "x", 5).orderBy("bin").collect()] == [2] * 5


def test_fractions_of_a_second_are_shown(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:00.25' t union all select timestamp'2024-01-03 00:00:00'")
    got = datetime_stats(df, {"t": F.col("t")})["t"]
    assert (got["min_date"], got["max_date"]) == ("2024-01-01 00:00:00.25", "2024-01-03 00:00:00")


def test_correlation_does_not_depend_on_the_width(spark):
    columns = ["id as a", "if(id % 2 = 0, 1e9 + id % 7 * 1e-3, null) as b", "if(id % 2 = 0, 5D, id) as c", "if(id % 5 > 0, sin(id), null) as d"]
    df = spark.range(1000).selectExpr(*columns)
    plain = {(r["col_a"], r["col_b"]): r["r"] for r in correlation(df).collect()}
    wide = {(r["col_a"], r["col_b"]): r["r"] for r in correlation(df, pairwise_columns=1).collect()}
    assert plain[("b", "c")] is None and plain[("a", "b")] is not None
    assert {k for k, v in plain.items() if v is None} == {k for k, v in wide.items() if v is None}
    assert all(abs(plain[k] - wide[k]) < 1e-9 for k, v in plain.items() if v is not None)
