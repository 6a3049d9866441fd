"""Missing values and conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogue.tables import EVENT_ORDER, GAPPED_EVENTS, gapped_events, labelled_documents, table
from loomprep.functions.convert import convert_column
from loomprep.functions.nulls import complete_cases
from loomprep.operators.missing import apply_strategies, apply_strategy, missing_profile, missing_totals


def profile_of_gaps(spark: SparkSession, d: str) -> DataFrame:
    return missing_profile(gapped_events(spark, d))


MISSING_PROFILE = f"WITH {GAPPED_EVENTS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS name, (count(*) - count({c}))::BIGINT AS missing,
    round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct, count(*)::BIGINT AS total,
    {kind} AS inferred_type FROM g HAVING count(*) > count({c})"""
    for c, kind in {
        "event_id": "'numeric'",
        "user_id": "'numeric'",
        "value": "'numeric'",
        "event_type": "'categorical'",
        "props": "CASE WHEN count(DISTINCT props) < 0.5 * count(props) OR count(DISTINCT props) <= 50 "
        "THEN 'categorical' ELSE 'text' END",
    }.items()
)


def totals_of_gaps(spark: SparkSession, d: str) -> DataFrame:
    return missing_totals(gapped_events(spark, d)).withColumnRenamed("rows", "n_rows")


MISSING_TOTALS = f"""
WITH {GAPPED_EVENTS}
SELECT count(*)::BIGINT AS n_rows, 6::BIGINT AS cols,
  ((count(*) > count(event_id))::INT + (count(*) > count(ts))::INT + (count(*) > count(user_id))::INT
   + (count(*) > count(event_type))::INT + (count(*) > count(value))::INT + (count(*) > count(props))::INT)::BIGINT
    AS columns_with_missing,
  (6 * count(*) - count(event_id) - count(ts) - count(user_id) - count(event_type) - count(value) - count(props))::BIGINT
    AS total_missing
FROM g
"""


def _one(column: str, strategy: str, custom=None, digits: int | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        order = EVENT_ORDER if strategy in ("fill_forward", "fill_backward", "interpolate") else ()
        out = apply_strategy(gapped_events(spark, d), column, strategy, custom, order)
        filled = F.col(column) if digits is None else F.round(column, digits).alias(column)
        return out.select("event_id", filled)

    return run


def _gap_sql(expression: str, name: str) -> str:
    return f"WITH {GAPPED_EVENTS} SELECT event_id, {expression} AS {name} FROM g"


INTERPOLATE = """
n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS p FROM g),
a AS (SELECT *, CASE WHEN value IS NOT NULL THEN p END AS q FROM n),
b AS (SELECT *, last_value(q IGNORE NULLS) OVER w AS p0, last_value(value IGNORE NULLS) OVER w AS v0,
        first_value(q IGNORE NULLS) OVER z AS p1, first_value(value IGNORE NULLS) OVER z AS v1
      FROM a WINDOW w AS (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    z AS (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT event_id, ts, user_id, event_type, props,
        CASE WHEN value IS NOT NULL THEN value WHEN p1 IS NULL THEN v0
             ELSE v0 + (v1 - v0) * ((p - p0)::DOUBLE / (p1 - p0)) END AS value FROM b)"""


def forward_by_user(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    out = apply_strategy(events, "value", "fill_forward", None, EVENT_ORDER, "user_id")
    return out.select("event_id", "value")


def in_bulk(spark: SparkSession, d: str) -> DataFrame:
    """Dropping rows first changes every later statistic."""
    spec = {
        "user_id": {"strategy": "drop_rows"},
        "value": {"strategy": "fill_mean"},
        "event_type": {"strategy": "leave"},
        "props": {"strategy": "fill_mode"},
    }
    out = apply_strategies(gapped_events(spark, d), spec)
    return out.select("event_id", "user_id", F.round("value", 6).alias("value"), "props")


IN_BULK = f"""
WITH {GAPPED_EVENTS}, k AS (SELECT * FROM g WHERE user_id IS NOT NULL)
SELECT event_id, user_id, round(coalesce(value, (SELECT avg(value) FROM k)), 6) AS value,
  coalesce(props, (SELECT props FROM k WHERE props IS NOT NULL GROUP BY props ORDER BY count(*) DESC, props LIMIT 1))
    AS props FROM k
"""


def complete(spark: SparkSession, d: str) -> DataFrame:
    """Complete rows, each with the number of rows that went."""
    documents = labelled_documents(spark, d).select("doc_id", "n_chars", "quality", "toxic")
    kept = complete_cases(documents)
    return kept.withColumn("rows_dropped", F.lit(documents.count() - kept.count()).cast("bigint"))


def to_numeric(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
        .otherwise(F.concat(F.substring("o_orderpriority", 1, 1), F.lit(".5e1")))
        .alias("reading"),
    )
    return convert_column(words, "reading", "numeric")


def to_boolean(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    words = table(spark, d, "orders").select(
        "o_orderkey", F.when(status == "F", "YES").when(status == "O", "0").otherwise("maybe").alias("reading")
    )
    return convert_column(words, "reading", "boolean")


def to_datetime(spark: SparkSession, d: str) -> DataFrame:
    kind, day = F.col("o_orderpriority"), F.col("o_orderdate")
    words = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(kind == "1-URGENT", F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == "2-HIGH", F.date_format(day, "MM/dd/yyyy"))
        .when(kind == "3-MEDIUM", F.date_format(day, "yyyy/MM/dd HH:mm:ss"))
        .when(kind == "5-LOW", F.lit("soon"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
        .alias("reading"),
    )
    return convert_column(words, "reading", "datetime").withColumn("reading", F.col("reading").cast("timestamp_ntz"))


TO_DATETIME = """
WITH w AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
  WHEN '2-HIGH' THEN strftime(o_orderdate, '%m/%d/%Y') WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y/%m/%d %H:%M:%S')
  WHEN '5-LOW' THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS r FROM orders)
SELECT o_orderkey, coalesce(try_strptime(r, '%Y-%m-%d %H:%M:%S'), try_strptime(r, '%Y-%m-%d'),
  try_strptime(r, '%Y/%m/%d %H:%M:%S'), try_strptime(r, '%m/%d/%Y'), try_strptime(r, '%d/%m/%Y')) AS reading FROM w
"""


def to_category(spark: SparkSession, d: str) -> DataFrame:
    return convert_column(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "categorical")


QUERIES = {
    "missing_profile": (profile_of_gaps, MISSING_PROFILE),
    "missing_totals": (totals_of_gaps, MISSING_TOTALS),
    "drop_missing": (
        _one("value", "drop_rows"), f"WITH {GAPPED_EVENTS} SELECT event_id, value FROM g WHERE value IS NOT NULL",
    ),
    "leave": (_one("value", "leave"), _gap_sql("value", "value")),
    "fill_mean": (
        _one("value", "fill_mean", digits=6), _gap_sql("round(coalesce(value, (SELECT avg(value) FROM g)), 6)", "value"),
    ),
    "fill_median": (
        _one("user_id", "fill_median", digits=6),
        _gap_sql("round(coalesce(user_id, (SELECT quantile_cont(user_id::DOUBLE, 0.5) FROM g)), 6)::DOUBLE", "user_id"),
    ),
    "fill_mode": (
        _one("props", "fill_mode"),
        _gap_sql(
            "coalesce(props, (SELECT props FROM g WHERE props IS NOT NULL GROUP BY props "
            "ORDER BY count(*) DESC, props LIMIT 1))", "props",
        ),
    ),
    "fill_mode_numeric": (
        _one("user_id", "fill_mode"),
        _gap_sql(
            "coalesce(user_id, (SELECT user_id FROM g WHERE user_id IS NOT NULL GROUP BY user_id "
            "ORDER BY count(*) DESC, user_id LIMIT 1))", "user_id",
        ),
    ),
    "fill_custom": (_one("value", "fill_custom", "-1.5"), _gap_sql("coalesce(value, -1.5::DOUBLE)", "value")),
    "fill_custom_text": (_one("props", "fill_custom", "unknown"), _gap_sql("coalesce(props, 'unknown')", "props")),
    "fill_forward": (
        _one("value", "fill_forward"),
        _gap_sql(
            "last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
            "value",
        ),
    ),
    "fill_backward": (
        _one("props", "fill_backward"),
        _gap_sql(
            "first_value(props IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
            "props",
        ),
    ),
    "fill_forward_by_user": (
        forward_by_user,
        "SELECT event_id, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER "
        "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events",
    ),
    "interpolate_linear": (
        _one("value", "interpolate", digits=6),
        f"WITH {GAPPED_EVENTS}, {INTERPOLATE} SELECT event_id, round(value, 6) AS value FROM i",
    ),
    "fill_bulk": (in_bulk, IN_BULK),
    "complete_cases": (
        complete,
        "SELECT d.doc_id, d.n_chars, l.quality, l.toxic, ((SELECT count(*) FROM documents) - count(*) OVER ())::BIGINT "
        "AS rows_dropped FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL",
    ),
    "convert_numeric": (
        to_numeric,
        "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority "
        "ELSE left(o_orderpriority, 1) || '.5e1' END AS DOUBLE) AS reading FROM orders",
    ),
    "convert_boolean": (
        to_boolean,
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS reading FROM orders",
    ),
    "convert_datetime": (to_datetime, TO_DATETIME),
    "convert_categorical": (to_category, "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part"),
}
