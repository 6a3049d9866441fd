"""Snapshots, before/after differences and the event log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loomprep.functions.columns import col, field, numeric_columns, run_jobs
from loomprep.operators.classify import scan_facts
from loomprep.operators.frequencies import distinct_counts, has_long_texts
from loomprep.operators.profile import numeric_stats, table_overview

SNAPSHOT_SCHEMA = """
    name string, dtype string, missing bigint, missing_pct double, unique bigint,
    min double, max double, mean double, median double, std double
"""

def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, data_type) for name, data_type in fields.items()])


_TEXT, _COUNT = T.StringType(), T.LongType()
_SHAPE = _record(rows=_COUNT, cols=_COUNT, total_missing=_COUNT)
# An array, not a map: the order of the steps is part of what they do.
_DETAIL = _record(column=_TEXT, strategy=_TEXT, method=_TEXT, threshold=T.DoubleType(), custom_value=_TEXT)

_REAL = T.DoubleType()
# What a snapshot says of a column, as an event keeps it.
_COLUMN = _record(
    name=_TEXT, dtype=_TEXT, missing=_COUNT, missing_pct=_REAL, unique=_COUNT, min=_REAL, max=_REAL, mean=_REAL, median=_REAL, std=_REAL
)

EVENT_SCHEMA = _record(
    session=_TEXT,
    seq=_COUNT,
    event=_TEXT,
    ts=T.TimestampType(),
    operation=_TEXT,
    details=T.ArrayType(_DETAIL),
    source=T.MapType(_TEXT, _TEXT),
    destination=_TEXT,
    format=_TEXT,
    before=_SHAPE,
    after=_SHAPE,
    diff=_record(rows_delta=_COUNT, cols_delta=_COUNT, missing_delta=_COUNT),
    columns=T.ArrayType(_COLUMN),
    extra=T.MapType(_TEXT, _TEXT),
)


def snapshot_columns(df: DataFrame) -> DataFrame:
    """One row per column: type, gaps, different values and, for numeric storage, rounded location and spread."""
    total, facts = scan_facts(df, locate=True)
    numeric = {n: col(n).cast("double") for n in numeric_columns(df) if facts[n].present}
    long_texts = has_long_texts([f.longest for f in facts.values()])
    uniques, stats = run_jobs(
        [
            lambda: {r["name"]: r["unique"] for r in distinct_counts(df, None, long_texts).collect()},
            lambda: numeric_stats(df, numeric, known={n: facts[n].location for n in numeric}),
        ]
    )
    rows = []
    for n in df.columns:
        missing, s = total - facts[n].present, stats.get(n, {})
        rows.append(
            (
                n,
                field(df, n).dataType.simpleString(),
                missing,
                missing * 100.0 / total if total else 0.0,
                uniques.get(n, 0),
                *[s.get(k) for k in ("min", "max", "mean", "median", "std")],
            )
        )
    out = df.sparkSession.createDataFrame(rows, SNAPSHOT_SCHEMA).withColumn("missing_pct", F.round("missing_pct", 2))
    return out.withColumns({k: F.round(k, 4) for k in ("mean", "median", "std")})


def snapshot_table(df: DataFrame) -> DataFrame:
    """One row: rows, cols, total_missing, missing_pct."""
    return table_overview(df).select("rows", "cols", "total_missing", "missing_pct")


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: shape and gaps of two tables and their differences."""
    sides = snapshot_table(before).withColumn("side", F.lit("before")).unionByName(
        snapshot_table(after).withColumn("side", F.lit("after"))
    )

    def on(side: str, name: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name)))

    shape = sides.agg(
        *[on(s, n).alias(f"{n}_{s}") for s in ("before", "after") for n in ("rows", "cols", "total_missing")]
    )
    return shape.withColumns(
        {
            "rows_delta": F.col("rows_after") - F.col("rows_before"),
            "cols_delta": F.col("cols_after") - F.col("cols_before"),
            "missing_delta": F.col("total_missing_after") - F.col("total_missing_before"),
        }
    )


def cleaning_summary(original: DataFrame, current: DataFrame, operations: int) -> DataFrame:
    """One row: original and current shape, rows removed, gaps fixed, number of operations."""
    return before_after(original, current).select(
        F.col("rows_before").alias("original_rows"),
        F.col("cols_before").alias("original_cols"),
        F.col("rows_after").alias("current_rows"),
        F.col("cols_after").alias("current_cols"),
        (-F.col("rows_delta")).alias("rows_removed"),
        (-F.col("missing_delta")).alias("missing_fixed"),
        F.lit(operations).cast("bigint").alias("operations"),
    )


class AuditLog:
    """Append-only event table of one cleaning session, kept as Parquet in a shared folder."""

    def __init__(self, spark: SparkSession, path: str, session: str) -> None:
        self.spark, self.path, self.session = spark, path, session
        self._seq = self._next()

    def _next(self) -> int:
        """A session that is opened again goes on where it stopped."""
        try:
            last = self.events().where(F.col("session") == self.session).agg(F.max("seq")).first()[0]
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            last = None
        return 0 if last is None else last + 1

    def record_load(self, df: DataFrame, source: Mapping[str, Any]) -> None:
        """The table as it came, with a snapshot of every column."""
        shape, columns = self._snapshot(df)
        self._append("load", source={k: str(v) for k, v in source.items()}, before=shape, after=shape, columns=columns)

    def record_operation(
        self, operation: str, details: Mapping[str, Any], before: DataFrame, after: DataFrame
    ) -> None:
        row = before_after(before, after).first()
        self._append(
            "operation",
            operation=operation,
            details=[_detail(c, d) for c, d in details.items()],
            before=tuple(row[f"{n}_before"] for n in ("rows", "cols", "total_missing")),
            after=tuple(row[f"{n}_after"] for n in ("rows", "cols", "total_missing")),
            diff=(row["rows_delta"], row["cols_delta"], row["missing_delta"]),
        )

    def record_undo(self, operation: str | None = None) -> None:
        self._append("undo", operation=operation)

    def record_export(self, df: DataFrame, destination: str, fmt: str, extra: Mapping[str, Any] | None = None) -> None:
        """The table as it went, with a snapshot of every column and what the caller has to add."""
        shape, columns = self._snapshot(df)
        noted = {k: str(v) for k, v in (extra or {}).items()}
        self._append("export", destination=destination, format=fmt, after=shape, columns=columns, extra=noted)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENT_SCHEMA).parquet(self.path)

    def report(self) -> DataFrame:
        """Events of this session in order."""
        return self.events().where(F.col("session") == self.session).orderBy("seq")

    def column_snapshots(self) -> DataFrame:
        """One row per column and recorded snapshot of this session: seq, event and what the snapshot says."""
        return self.report().select("seq", "event", F.explode("columns").alias("c")).select("seq", "event", "c.*")

    def session_report(self) -> DataFrame:
        """One row: when the session's last load and last event were, its events by kind, and the steps that were not undone.

        Undo takes back the last step that still stands; an undo without one takes back nothing.
        """
        from loomprep.plans.replay import resolve_undo

        own = self.events().where(F.col("session") == self.session)
        kinds = ("load", "operation", "undo", "export")
        counts = [F.count_if(F.col("event") == k).alias(f"n_{k}s") for k in kinds]
        standing = resolve_undo(own).where("event = 'operation'").agg(F.count(F.lit(1)).alias("n_standing"))
        start = F.max(F.when(F.col("event") == "load", F.col("ts"))).alias("session_start")
        facts = own.agg(F.lit(self.session).alias("session"), start, F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("total_events"), *counts)
        return facts.withColumn("n_standing", F.lit(standing.first()[0]))

    def column_changes(self) -> DataFrame:
        """One row per column of the last load and the last export: gaps, different values and mean in both, and the change.

        A column that only one of them has is null in the other.
        """
        snapshots = self.column_snapshots()
        numbers = ("missing", "unique", "mean")
        sides = []
        for event, side in (("load", "before"), ("export", "after")):
            own = snapshots.where(F.col("event") == event)
            last = own.agg(F.max("seq")).first()[0]
            sides.append(own.where(F.col("seq") == F.lit(last)).select("name", *[F.col(n).alias(f"{n}_{side}") for n in numbers]))
        both = sides[0].join(sides[1], "name", "full")
        return both.select(
            "name", *[f"{n}_{side}" for n in numbers for side in ("before", "after")], (F.col("missing_after") - F.col("missing_before")).alias("missing_delta")
        )

    def _snapshot(self, df: DataFrame) -> tuple[tuple[int, int, int], list[tuple]]:
        """Shape and columns; what the driver holds is a row per column."""
        row, columns = run_jobs([lambda: snapshot_table(df).first(), lambda: snapshot_columns(df).collect()])
        return (row["rows"], row["cols"], row["total_missing"]), [tuple(c[n] for n in _COLUMN.names) for c in columns]

    def _append(self, event: str, **values: Any) -> None:
        now = dt.datetime.now(dt.timezone.utc).replace(microsecond=0)
        known = {"session": self.session, "seq": self._seq, "event": event, "ts": now, **values}
        row = tuple(known.get(name) for name in EVENT_SCHEMA.names)
        self.spark.createDataFrame([row], EVENT_SCHEMA).write.mode("append").parquet(self.path)
        self._seq += 1


def _detail(column: str, detail: Mapping[str, Any] | str) -> tuple[str, str, str | None, float | None, str | None]:
    if not isinstance(detail, Mapping):
        return (column, str(detail), None, None, None)
    threshold, custom = detail.get("threshold"), detail.get("custom_value")
    return (
        column,
        detail.get("strategy", "leave"),
        detail.get("method"),
        None if threshold is None else float(threshold),
        None if custom is None else str(custom),
    )
