"""Outlier masks, reports and remedies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogue.tables import GAPPED_EVENTS, gapped_events, table
from loomprep.operators.outliers import apply_remedies, apply_remedy, outlier_mask, outlier_report, outlier_totals

DOCUMENT_NUMBERS = ("doc_id", "n_chars")


def _mask(method: str, threshold: float | None = None, ddof: int = 0):
    def run(spark: SparkSession, d: str) -> DataFrame:
        events = gapped_events(spark, d)
        return events.select("event_id", outlier_mask(events, "value", method, threshold, ddof).alias("is_outlier"))

    return run


def _report(method: str, name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = gapped_events(spark, d) if name == "events" else table(spark, d, name)
        found = outlier_report(df, method)
        return found.select(
            "name", "outlier_count", "outlier_pct", "lower_bound", "upper_bound", F.col("min").alias("min_value"),
            F.col("max").alias("max_value"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        )

    return run


def _bounds_sql(source: str, x: str) -> str:
    return f"""(SELECT quantile_cont({x}::DOUBLE, 0.25) AS q1, quantile_cont({x}::DOUBLE, 0.75) AS q3,
      avg({x}::DOUBLE) AS m, stddev_samp({x}::DOUBLE) AS s, stddev_pop({x}::DOUBLE) AS p FROM {source})"""


IQR_OUT = "coalesce({x} < q1 - 1.5::DOUBLE * (q3 - q1) OR {x} > q3 + 1.5::DOUBLE * (q3 - q1), false)"
Z_OUT = "coalesce(abs({x} - m) / p > {t}, false)"


def _report_sql(method: str, source: str, columns) -> str:
    low, high = (
        ("q1 - 1.5::DOUBLE * (q3 - q1)", "q3 + 1.5::DOUBLE * (q3 - q1)")
        if method == "iqr"
        else ("m - 3.0::DOUBLE * s", "m + 3.0::DOUBLE * s")
    )
    parts = []
    for c in columns:
        out = (IQR_OUT if method == "iqr" else Z_OUT).format(x=c, t="3.0::DOUBLE")
        parts.append(
            f"""SELECT '{c}' AS name, (count(*) FILTER ({out}))::BIGINT AS outlier_count,
            round((count(*) FILTER ({out})) * 100.0::DOUBLE / count(*), 2) AS outlier_pct,
            round(any_value({low}), 4) AS lower_bound, round(any_value({high}), 4) AS upper_bound,
            min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, round(avg({c}::DOUBLE), 4) AS mean,
            round(stddev_samp({c}::DOUBLE), 4) AS std
            FROM {source}, {_bounds_sql(source, c)} b HAVING count(*) FILTER ({out}) > 0"""
        )
    return " UNION ALL ".join(parts)


def _remedy(strategy: str, method: str = "iqr", threshold: float | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = apply_remedy(gapped_events(spark, d), "value", strategy, method, threshold)
        return out.select("event_id", F.round("value", 6).alias("value"))

    return run


def log_negative(spark: SparkSession, d: str) -> DataFrame:
    out = apply_remedy(table(spark, d, "customer"), "c_acctbal", "log")
    return out.select("c_custkey", F.round("c_acctbal", 8).alias("c_acctbal"))


def in_bulk(spark: SparkSession, d: str) -> DataFrame:
    """Removing rows by one column changes the bounds fitted for the next."""
    spec = {
        "value": {"strategy": "remove", "method": "iqr"},
        "user_id": {"strategy": "cap", "method": "zscore", "threshold": 1.0},
        "event_id": {"strategy": "leave"},
    }
    out = apply_remedies(gapped_events(spark, d), spec)
    return out.select("event_id", "value", F.round("user_id", 6).alias("user_id"))


IN_BULK = f"""
WITH {GAPPED_EVENTS}, b AS {_bounds_sql("g", "value")},
k AS (SELECT g.* FROM g, b WHERE NOT {IQR_OUT.format(x="value")}), z AS {_bounds_sql("k", "user_id")}
SELECT event_id, value, round(CASE WHEN user_id < m - s THEN m - s WHEN user_id > m + s THEN m + s
                              ELSE user_id::DOUBLE END, 6) AS user_id FROM k, z
"""


def totals(spark: SparkSession, d: str) -> DataFrame:
    return outlier_totals(outlier_report(table(spark, d, "lineitem"), "zscore", 1.5))


def _totals_sql() -> str:
    names = (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )
    parts = " UNION ALL ".join(
        f"SELECT count(*) FILTER ({Z_OUT.format(x=c, t='1.5::DOUBLE')}) AS n FROM lineitem, {_bounds_sql('lineitem', c)} b"
        for c in names
    )
    return f"""SELECT (count(*) FILTER (n > 0))::BIGINT AS columns_affected, sum(n)::BIGINT AS total_outliers
    FROM ({parts})"""


def _cap_sql(low: str, high: str) -> str:
    return f"""WITH {GAPPED_EVENTS}, b AS {_bounds_sql("g", "value")}
    SELECT event_id, round(CASE WHEN value < {low} THEN {low} WHEN value > {high} THEN {high} ELSE value END, 6) AS value
    FROM g, b"""


QUERIES = {
    "outliers_iqr": (
        _mask("iqr"),
        f"WITH {GAPPED_EVENTS}, b AS {_bounds_sql('g', 'value')} "
        f"SELECT event_id, {IQR_OUT.format(x='value')} AS is_outlier FROM g, b",
    ),
    "outliers_zscore": (
        _mask("zscore"),
        f"WITH {GAPPED_EVENTS}, b AS {_bounds_sql('g', 'value')} "
        f"SELECT event_id, {Z_OUT.format(x='value', t='3.0::DOUBLE')} AS is_outlier FROM g, b",
    ),
    "outliers_zscore_sample": (
        _mask("zscore", 2.0, ddof=1),
        f"WITH {GAPPED_EVENTS}, b AS {_bounds_sql('g', 'value')} "
        "SELECT event_id, coalesce(abs(value - m) / s > 2.0::DOUBLE, false) AS is_outlier FROM g, b",
    ),
    "outlier_report_iqr": (
        _report("iqr", "events"),
        f"WITH {GAPPED_EVENTS} " + _report_sql("iqr", "g", ("event_id", "user_id", "value")),
    ),
    "outlier_report_zscore": (_report("zscore", "documents"), _report_sql("zscore", "documents", DOCUMENT_NUMBERS)),
    "outlier_totals": (totals, _totals_sql()),
    "outlier_remove": (
        _remedy("remove"),
        f"WITH {GAPPED_EVENTS}, b AS {_bounds_sql('g', 'value')} "
        f"SELECT event_id, round(value, 6) AS value FROM g, b WHERE NOT {IQR_OUT.format(x='value')}",
    ),
    "outlier_remove_zscore": (
        _remedy("remove", "zscore"),
        f"WITH {GAPPED_EVENTS}, b AS {_bounds_sql('g', 'value')} "
        f"SELECT event_id, round(value, 6) AS value FROM g, b WHERE NOT {Z_OUT.format(x='value', t='3.0::DOUBLE')}",
    ),
    "outlier_cap": (_remedy("cap"), _cap_sql("(q1 - 1.5::DOUBLE * (q3 - q1))", "(q3 + 1.5::DOUBLE * (q3 - q1))")),
    "outlier_cap_zscore": (
        _remedy("cap", "zscore", 2.0), _cap_sql("(m - 2.0::DOUBLE * s)", "(m + 2.0::DOUBLE * s)"),
    ),
    "outlier_log": (
        _remedy("log"),
        f"WITH {GAPPED_EVENTS}, b AS (SELECT min(value) AS lo FROM g) SELECT event_id, "
        "round(CASE WHEN lo <= 0 THEN ln(1 + value + abs(lo) + 1) ELSE ln(1 + value) END, 6) AS value FROM g, b",
    ),
    "outlier_log_negative": (
        log_negative,
        "WITH b AS (SELECT min(c_acctbal) AS lo FROM customer) SELECT c_custkey, "
        "round(CASE WHEN lo <= 0 THEN ln(1 + c_acctbal + abs(lo) + 1) ELSE ln(1 + c_acctbal) END, 8) AS c_acctbal "
        "FROM customer, b",
    ),
    "remediate_bulk": (in_bulk, IN_BULK),
}
