import json

import pytest
from pyspark.sql import functions as F

from loomprep.operators.missing import apply_strategies
from loomprep.operators.ordered import plan_ranges
from loomprep.operators.outliers import apply_remedies
from loomprep.plans.audit import EVENT_SCHEMA, AuditLog, before_after, cleaning_summary, snapshot_columns, snapshot_table
from loomprep.plans.replay import recipe_of, replay, resolve_undo
from loomprep.sources import jdbc
from loomprep.sources.readers import cap_rows, read_table, source_info
from loomprep.sources.writers import target_path, write_table


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1, "x", 1.1), (2, "y", 2.2), (3, "z", 3.3)], "a bigint, b string, c double")


@pytest.mark.parametrize("fmt", ["csv", "tsv", "tab", "json", "parquet"])
def test_round_trip(spark, small, tmp_path, fmt):
    path = write_table(small, str(tmp_path / "deep" / "out.xyz"), fmt)
    assert path.endswith({"csv": ".csv", "tsv": ".tsv", "tab": ".tab", "json": ".json", "parquet": ".parquet"}[fmt])
    back = read_table(spark, path)
    assert back.dtypes == small.dtypes and back.orderBy("a").collect() == small.orderBy("a").collect()
    assert read_table(spark, path, row_limit=2).count() == 2
    info = source_info(back, path).first()
    assert (info["total_rows"], info["total_cols"]) == (3, 3)


def test_bad_paths_and_formats(spark, small, tmp_path):
    with pytest.raises(ValueError, match="unsupported file type"):
        read_table(spark, str(tmp_path / "a.xyz"))
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="unsupported export format"):
        write_table(small, str(tmp_path / "a"), "xyz")
    assert target_path("/x/a.csv", "json") == "/x/a.json"


def test_missing_words_quotes_and_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('i,f,b,s,q\n1,1.5,True,x,"a ""b"", c"\nNA,nan,False,null,"two\nlines"\n3,inf,true,N/A,\n')
    df = read_table(spark, str(path))
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "s": "string", "q": "string"}
    rows = df.collect()
    assert [r["i"] for r in rows] == [1, None, 3] and [r["f"] for r in rows] == [1.5, None, float("inf")]
    assert [r["s"] for r in rows] == ["x", None, None]
    assert [r["q"] for r in rows] == ['a "b", c', "two\nlines", None]


def test_json_arrays_lines_and_nesting(spark, tmp_path):
    records = [{"a": 1, "n": {"b": "x", "m": {"c": 1}}}, {"a": 2, "n": {"b": "y", "m": {"c": 2}}}]
    array, lines = tmp_path / "array.json", tmp_path / "lines.json"
    array.write_text(json.dumps(records, indent=2))
    lines.write_text("\n".join(json.dumps(r) for r in records))
    for path in (array, lines):
        df = read_table(spark, str(path), flatten=True)
        assert df.columns == ["a", "n.b", "n.m.c"]
        assert sorted(tuple(r) for r in df.collect()) == [(1, "x", 1), (2, "y", 2)]


def test_row_cap_is_flagged(small):
    kept, info = cap_rows(small, "a", threshold=2, keep=1)
    assert kept.collect()[0]["a"] == 1 and info == {"limited": True, "original_total_rows": 3}
    assert cap_rows(small, "a", threshold=10, keep=1)[1]["limited"] is False


def test_database_write_mode_is_checked(small):
    with pytest.raises(ValueError, match="unknown mode"):
        jdbc.write_table(small, "jdbc:none:", "t", "merge")


@pytest.fixture(scope="module")
def audited(spark):
    rows = [
        (25.0, "Alice", 88.5), (30.0, "Bob", 92.0), (None, None, 76.3), (45.0, "Dave", None), (200.0, "Eve", 95.1),
    ]
    return spark.createDataFrame(rows, "age double, name string, score double")


def test_snapshots_and_difference(audited):
    assert tuple(snapshot_table(audited).first()) == (5, 3, 3, 20.0)
    got = {r["name"]: r for r in snapshot_columns(audited).collect()}
    assert got["age"]["missing"] == 1 and got["age"]["mean"] == 75.0 and got["name"]["mean"] is None
    row = before_after(audited, audited.na.drop()).first()
    assert (row["rows_delta"], row["cols_delta"], row["missing_delta"]) == (-2, 0, -3)
    summary = cleaning_summary(audited, audited.na.drop(), 1).first()
    assert (summary["rows_removed"], summary["missing_fixed"], summary["operations"]) == (2, 3, 1)


def test_replay_equals_the_live_run(spark, audited, tmp_path):
    fill = {
        "age": {"strategy": "fill_mean"},
        "name": {"strategy": "fill_custom", "custom_value": "Unknown"},
        "score": {"strategy": "fill_median"},
    }
    cap = {"age": {"strategy": "cap", "method": "iqr", "threshold": 1.5}}
    source = write_table(audited, str(tmp_path / "in"), "parquet")
    log = AuditLog(spark, str(tmp_path / "log"), "s1")
    log.record_load(audited, {"path": source})
    filled = apply_strategies(audited, fill)
    log.record_operation("missing_values", fill, audited, filled)
    dropped = filled.where("score > 80")
    log.record_operation("missing_values", {"score": {"strategy": "drop_rows"}}, filled, dropped)
    log.record_undo("missing_values")
    live = apply_remedies(filled, cap)
    log.record_operation("outlier_remediation", cap, filled, live)
    log.record_export(live, str(tmp_path / "out.csv"), "csv")
    told = log.session_report().first()
    assert (told["total_events"], told["n_operations"], told["n_undos"], told["n_standing"]) == (6, 3, 1, 2)
    assert told["session_start"] <= told["session_end"]
    change = {r["name"]: r for r in log.column_changes().collect()}
    assert change["age"]["missing_before"] == 1 and change["age"]["missing_delta"] == -1
    assert change["age"]["mean_before"] == 75.0 and change["name"]["unique_after"] == 5
    events = log.report()
    assert [r["event"] for r in events.collect()] == ["load", "operation", "operation", "undo", "operation", "export"]
    again, _ = replay(spark, log.events(), session="s1")
    key = lambda r: (r["name"], r["score"])
    for a, b in zip(sorted(live.collect(), key=key), sorted(again.collect(), key=key)):
        assert a.asDict() == pytest.approx(b.asDict(), abs=1e-6)
    written = read_table(spark, str(tmp_path / "out.csv"))
    assert written.count() == 5
    assert [s.strategy for s in recipe_of(log.events(), "s1").steps] == ["fill_mean", "fill_custom", "fill_median", "cap"]


@pytest.mark.parametrize(
    "kinds, kept",
    [
        ("lox", "lox"),
        ("loux", "lx"),
        ("loouux", "lx"),
        ("louox", [0, 3, 4]),
        ("lux", [0, 2]),
        ("loouox", [0, 1, 4, 5]),
    ],
)
def test_undo_resolution(spark, kinds, kept):
    names = {"l": "load", "o": "operation", "u": "undo", "x": "export"}
    events = spark.createDataFrame([("s", i, names[k]) for i, k in enumerate(kinds)], "session string, seq int, event string")
    got = resolve_undo(events).orderBy("seq").collect()
    if isinstance(kept, list):
        assert [r["seq"] for r in got] == kept
    else:
        assert [r["event"] for r in got] == [names[k] for k in kept]


def test_undo_resolution_over_ranges_matches_a_stack(spark):
    hashed = F.abs(F.hash(F.col("id") * 31)) % 20
    events = spark.range(4000).select(
        F.when(F.col("id") < 2000, "hot").otherwise((F.col("id") % 50).cast("string")).alias("session"),
        F.col("id").alias("seq"),
        F.when(hashed < 9, "operation").when(hashed < 18, "undo").otherwise("export").alias("event"),
    ).cache()
    stacks, kept = {}, set()
    for r in sorted(events.collect(), key=lambda r: r["seq"]):
        stack = stacks.setdefault(r["session"], [])
        if r["event"] == "undo":
            if stack:
                kept.discard(stack.pop())
            continue
        kept.add(r["seq"])
        if r["event"] == "operation":
            stack.append(r["seq"])
    plan = plan_ranges(events, ["seq"], ["session"], 90)
    assert plan.count > 20
    assert {r["seq"] for r in resolve_undo(events, plan=plan).collect()} == kept
    assert {r["seq"] for r in resolve_undo(events).collect()} == kept


def test_event_schema_names():
    assert EVENT_SCHEMA.names[:4] == ["session", "seq", "event", "ts"]
