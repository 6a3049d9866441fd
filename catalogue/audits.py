"""Snapshots, differences, undo resolution and recipe replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogue.tables import GAPPED_EVENTS, gapped_events, table
from loomprep.operators.missing import apply_strategy
from loomprep.plans.audit import EVENT_SCHEMA, AuditLog, before_after, cleaning_summary, snapshot_columns, snapshot_table
from loomprep.plans.replay import replay, resolve_undo
from loomprep.session import scratch_path


def table_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_table(gapped_events(spark, d)).withColumnRenamed("rows", "n_rows")


TABLE_SNAPSHOT = f"""
WITH {GAPPED_EVENTS}, c AS (
  SELECT count(*) AS n, 6 * count(*) - count(event_id) - count(ts) - count(user_id) - count(event_type) - count(value)
         - count(props) AS m FROM g)
SELECT n::BIGINT AS n_rows, 6::BIGINT AS cols, m::BIGINT AS total_missing, round(m * 100.0::DOUBLE / (6 * n), 2) AS missing_pct
FROM c
"""


def column_snapshot(spark: SparkSession, d: str) -> DataFrame:
    found = snapshot_columns(gapped_events(spark, d))
    return found.select(
        "name", "missing", "missing_pct", F.col("unique").alias("n_unique"), F.col("min").alias("min_value"),
        F.col("max").alias("max_value"), "mean", "median", "std",
    )


def _column_snapshot_sql() -> str:
    parts = []
    for c in ("event_id", "ts", "user_id", "event_type", "value", "props"):
        numeric = c in ("event_id", "user_id", "value")
        stats = (
            f"min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, round(avg({c}::DOUBLE), 4) AS mean, "
            f"round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(stddev_samp({c}::DOUBLE), 4) AS std"
            if numeric
            else "NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, NULL::DOUBLE AS mean, NULL::DOUBLE AS median, "
            "NULL::DOUBLE AS std"
        )
        parts.append(
            f"""SELECT '{c}' AS name, (count(*) - count({c}))::BIGINT AS missing,
            round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct,
            count(DISTINCT {c})::BIGINT AS n_unique, {stats} FROM g"""
        )
    return f"WITH {GAPPED_EVENTS} " + " UNION ALL ".join(parts)


def difference(spark: SparkSession, d: str) -> DataFrame:
    before = gapped_events(spark, d)
    return before_after(before, apply_strategy(before, "user_id", "drop_rows"))


DIFFERENCE = f"""
WITH {GAPPED_EVENTS}, k AS (SELECT * FROM g WHERE user_id IS NOT NULL),
b AS (SELECT count(*) AS n, 6 * count(*) - count(event_id) - count(ts) - count(user_id) - count(event_type)
      - count(value) - count(props) AS m FROM g),
a AS (SELECT count(*) AS n, 6 * count(*) - count(event_id) - count(ts) - count(user_id) - count(event_type)
      - count(value) - count(props) AS m FROM k)
SELECT b.n::BIGINT AS rows_before, 6::BIGINT AS cols_before, b.m::BIGINT AS total_missing_before,
       a.n::BIGINT AS rows_after, 6::BIGINT AS cols_after, a.m::BIGINT AS total_missing_after,
       (a.n - b.n)::BIGINT AS rows_delta, 0::BIGINT AS cols_delta, (a.m - b.m)::BIGINT AS missing_delta FROM a, b
"""


def summary(spark: SparkSession, d: str) -> DataFrame:
    before = gapped_events(spark, d)
    after = apply_strategy(apply_strategy(before, "user_id", "drop_rows"), "value", "fill_mean")
    return cleaning_summary(before, after, 2)


SUMMARY = f"""
WITH {GAPPED_EVENTS}, k AS (SELECT * FROM g WHERE user_id IS NOT NULL)
SELECT (SELECT count(*) FROM g)::BIGINT AS original_rows, 6::BIGINT AS original_cols,
       (SELECT count(*) FROM k)::BIGINT AS current_rows, 6::BIGINT AS current_cols,
       ((SELECT count(*) FROM g) - (SELECT count(*) FROM k))::BIGINT AS rows_removed,
       ((SELECT sum((user_id IS NULL)::INT + (value IS NULL)::INT + (props IS NULL)::INT) FROM g)
        - (SELECT sum((props IS NULL)::INT) FROM k))::BIGINT AS missing_fixed,
       2::BIGINT AS operations
"""


def undo_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events read as a cleaning session: clicks and views operate, errors undo, sign-ups load."""
    kind = F.col("event_type")
    events = table(spark, d, "events").select(
        F.col("user_id").alias("session"),
        F.col("event_id").alias("seq"),
        F.when(kind.isin("click", "view"), "operation")
        .when(kind == "error", "undo")
        .when(kind == "signup", "load")
        .otherwise("export")
        .alias("event"),
    )
    return resolve_undo(events)


UNDO = """
WITH e AS (SELECT user_id AS session, event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN 'operation'
             WHEN event_type = 'error' THEN 'undo' WHEN event_type = 'signup' THEN 'load' ELSE 'export' END AS event
           FROM events),
s AS (SELECT *, sum(CASE event WHEN 'operation' THEN 1 WHEN 'undo' THEN -1 ELSE 0 END)
             OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM e),
m AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS depth FROM s),
l AS (SELECT *, min(depth) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
             AS later FROM m)
SELECT session, seq, event FROM l WHERE event <> 'undo' AND NOT (event = 'operation' AND later < depth)
"""


def _cleaning_log(spark: SparkSession) -> DataFrame:
    """A session that fills, tries a drop, takes it back, and caps."""

    def detail(
        column: str, strategy: str, method: str | None = None, threshold: float | None = None, custom: str | None = None
    ):
        return (column, strategy, method, threshold, custom)

    steps = [
        ("load", None, None),
        ("operation", "missing_values", [detail("value", "fill_mean"), detail("props", "fill_custom", custom="none")]),
        ("operation", "missing_values", [detail("user_id", "drop_rows")]),
        ("undo", "missing_values", None),
        ("operation", "missing_values", [detail("user_id", "fill_median")]),
        ("operation", "outlier_remediation", [detail("value", "cap", "iqr", 1.5), detail("user_id", "leave")]),
    ]
    rows = []
    for i, (event, operation, details) in enumerate(steps):
        known = {"session": "s", "seq": i, "event": event, "operation": operation, "details": details}
        rows.append(tuple(known.get(n) for n in EVENT_SCHEMA.names))
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def recipe_replay(spark: SparkSession, d: str) -> DataFrame:
    cleaned, _ = replay(spark, _cleaning_log(spark), gapped_events(spark, d))
    return cleaned.select("event_id", "user_id", F.round("value", 6).alias("value"), "props")


REPLAY = f"""
WITH {GAPPED_EVENTS},
f AS (SELECT event_id, coalesce(user_id::DOUBLE, (SELECT quantile_cont(user_id::DOUBLE, 0.5) FROM g)) AS user_id,
             coalesce(value, (SELECT avg(value) FROM g)) AS value, coalesce(props, 'none') AS props FROM g),
b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f)
SELECT event_id, user_id, round(CASE WHEN value < q1 - 1.5::DOUBLE * (q3 - q1) THEN q1 - 1.5::DOUBLE * (q3 - q1)
  WHEN value > q3 + 1.5::DOUBLE * (q3 - q1) THEN q3 + 1.5::DOUBLE * (q3 - q1) ELSE value END, 6) AS value, props FROM f, b
"""


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Log a load, an operation, an undo and an export of the whole table, and read the log back."""
    log = AuditLog(spark, scratch_path(spark, "audit"), "s")
    before = gapped_events(spark, d)
    log.record_load(before, {"table_name": "events"})
    after = apply_strategy(before, "user_id", "drop_rows")
    log.record_operation("missing_values", {"user_id": {"strategy": "drop_rows"}}, before, after)
    log.record_undo("missing_values")
    log.record_export(before, "events.parquet", "parquet")
    return log.report().select(
        "seq", "event", "operation", F.col("after.rows").alias("n_rows"), F.col("diff.rows_delta").alias("rows_delta")
    )


def _cleaned_session(spark: SparkSession, d: str) -> AuditLog:
    """Load, two steps of which one is undone, export with a note."""
    log = AuditLog(spark, scratch_path(spark, "audit"), "s")
    before = gapped_events(spark, d)
    log.record_load(before, {"table_name": "events"})
    after = apply_strategy(before, "user_id", "drop_rows")
    log.record_operation("missing_values", {"user_id": {"strategy": "drop_rows"}}, before, after)
    fewer = apply_strategy(after, "value", "drop_rows")
    log.record_operation("missing_values", {"value": {"strategy": "drop_rows"}}, after, fewer)
    log.record_undo("missing_values")
    log.record_export(after, "events.parquet", "parquet", {"reason": "weekly", "rows_kept": after.count()})
    return log


def event_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """What the log keeps of every column at load and export."""
    found = _cleaned_session(spark, d).column_snapshots()
    return found.select("seq", "event", "name", "dtype", "missing", "missing_pct", "unique", "min", "max")


def _snapshots_sql() -> str:
    parts = []
    for seq, event, rows in ((0, "load", "g"), (4, "export", "(SELECT * FROM g WHERE user_id IS NOT NULL)")):
        for c, kind in (("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string")):
            low, high = (f"min({c})::DOUBLE", f"max({c})::DOUBLE") if kind in ("bigint", "double") else ("NULL::DOUBLE", "NULL::DOUBLE")
            parts.append(
                f"SELECT {seq}::BIGINT AS seq, '{event}' AS event, '{c}' AS name, '{kind}' AS dtype, (count(*) - count({c}))::BIGINT AS missing, "
                f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct, count(DISTINCT {c})::BIGINT AS unique, {low} AS min, {high} AS max FROM {rows}"
            )
    return f"WITH {GAPPED_EVENTS} " + " UNION ALL ".join(parts)


def session_report(spark: SparkSession, d: str) -> DataFrame:
    """The session's numbers beside the change of every column."""
    log = _cleaned_session(spark, d)
    numbers = log.session_report().where("session_start <= session_end").drop("session_start", "session_end").first()
    noted = log.report().where("event = 'export'").select(F.col("extra")["reason"].alias("reason")).first()["reason"]
    changes = log.column_changes().drop("mean_before", "mean_after")
    return changes.select("*", F.lit(numbers["session"]).alias("session"), *[F.lit(n).cast("bigint").alias(k) for k, n in numbers.asDict().items() if k != "session"], F.lit(noted).alias("reason"))


SESSION_REPORT = f"WITH {GAPPED_EVENTS}, k AS (SELECT * FROM g WHERE user_id IS NOT NULL) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS name, (SELECT count(*) - count({c}) FROM g)::BIGINT AS missing_before, (count(*) - count({c}))::BIGINT AS missing_after,
    (SELECT count(DISTINCT {c}) FROM g)::BIGINT AS unique_before, count(DISTINCT {c})::BIGINT AS unique_after,
    (count(*) - count({c}) - (SELECT count(*) - count({c}) FROM g))::BIGINT AS missing_delta, 's' AS session, 5::BIGINT AS total_events,
    1::BIGINT AS n_loads, 2::BIGINT AS n_operations, 1::BIGINT AS n_undos, 1::BIGINT AS n_exports, 1::BIGINT AS n_standing, 'weekly' AS reason FROM k"""
    for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
)


EVENT_LOG = """
SELECT 0::BIGINT AS seq, 'load' AS event, NULL::VARCHAR AS operation, count(*)::BIGINT AS n_rows,
       NULL::BIGINT AS rows_delta FROM events
UNION ALL SELECT 1, 'operation', 'missing_values', (count(*) FILTER (event_type <> 'signup'))::BIGINT,
       (-(count(*) FILTER (event_type = 'signup')))::BIGINT FROM events
UNION ALL SELECT 2, 'undo', 'missing_values', NULL, NULL
UNION ALL SELECT 3, 'export', NULL, count(*)::BIGINT, NULL FROM events
"""

QUERIES = {
    "snapshot_table": (table_snapshot, TABLE_SNAPSHOT),
    "snapshot_columns": (column_snapshot, _column_snapshot_sql()),
    "before_after_diff": (difference, DIFFERENCE),
    "cleaning_summary": (summary, SUMMARY),
    "event_log": (event_log, EVENT_LOG),
    "event_log_snapshots": (event_snapshots, _snapshots_sql()),
    "session_report": (session_report, SESSION_REPORT),
    "undo_resolution": (undo_resolution, UNDO),
    "recipe_replay": (recipe_replay, REPLAY),
}
