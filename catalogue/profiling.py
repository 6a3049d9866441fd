"""Types, profiles, frequencies, overview, correlation."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogue.tables import GAPPED_EVENTS, gapped_events, labelled_documents, table
from loomprep.functions.columns import select_numeric
from loomprep.operators.classify import classify_columns, infer_task
from loomprep.operators.correlation import correlation
from loomprep.operators.frequencies import distinct_counts, top_values
from loomprep.operators.profile import profile, table_overview

LINEITEM_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
)


def numeric_sql(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS name, 'numeric' AS inferred_type, count(*)::BIGINT AS total,
        (count(*) - count({c}))::BIGINT AS missing,
        round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct, count({c})::BIGINT AS present,
        count(DISTINCT {c})::BIGINT AS n_unique, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value,
        round(avg({c}::DOUBLE), 4) AS mean, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median,
        round(stddev_samp({c}::DOUBLE), 4) AS std, round(skewness({c}::DOUBLE), 5) AS skew,
        round(kurtosis({c}::DOUBLE), 5) AS kurtosis, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q1,
        round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q3,
        (count(*) FILTER ({c} = 0))::BIGINT AS zeros, (count(*) FILTER ({c} < 0))::BIGINT AS negatives
        FROM {source}"""
        for c in columns
    )


def numeric_part(profiled: DataFrame) -> DataFrame:
    rounded = {"mean": 4, "median": 4, "std": 4, "skew": 5, "kurtosis": 5, "q1": 4, "q3": 4}
    return profiled.where("inferred_type = 'numeric'").select(
        "name", "inferred_type", "total", "missing", "missing_pct", "present",
        F.col("unique").alias("n_unique"), F.col("min").alias("min_value"), F.col("max").alias("max_value"),
        *[F.round(c, d).alias(c) for c, d in rounded.items()], "zeros", "negatives",
    )


def profile_numeric(spark: SparkSession, d: str) -> DataFrame:
    return numeric_part(profile(table(spark, d, "lineitem")))


def profile_numeric_gaps(spark: SparkSession, d: str) -> DataFrame:
    return numeric_part(profile(gapped_events(spark, d)))


def profile_numeric_negative(spark: SparkSession, d: str) -> DataFrame:
    return numeric_part(profile(table(spark, d, "customer")))


def profile_categorical(spark: SparkSession, d: str) -> DataFrame:
    found = profile(gapped_events(spark, d)).where("inferred_type in ('categorical', 'text')")
    return found.select(
        "name", "inferred_type", "missing", "present", F.col("unique").alias("n_unique"), "most_common", "most_common_count"
    )


def _categorical_sql() -> str:
    parts = [
        f"""SELECT '{c}' AS name,
        CASE WHEN count(DISTINCT {c}) < 0.5 * count({c}) OR count(DISTINCT {c}) <= 50 THEN 'categorical' ELSE 'text' END
          AS inferred_type,
        (count(*) - count({c}))::BIGINT AS missing, count({c})::BIGINT AS present,
        count(DISTINCT {c})::BIGINT AS n_unique,
        (SELECT {c} FROM g WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS most_common,
        (SELECT count(*)::BIGINT FROM g WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)
          AS most_common_count
        FROM g"""
        for c in ("event_type", "props")
    ]
    return f"WITH {GAPPED_EVENTS} " + " UNION ALL ".join(parts)


def profile_datetime(spark: SparkSession, d: str) -> DataFrame:
    found = profile(table(spark, d, "orders")).where("inferred_type = 'datetime'")
    return found.select("name", "present", F.col("unique").alias("n_unique"), "min_date", "max_date", "date_range_days")


PROFILE_DATETIME = """
SELECT 'o_orderdate' AS name, count(o_orderdate)::BIGINT AS present, count(DISTINCT o_orderdate)::BIGINT AS n_unique,
       strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min_date,
       strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max_date,
       floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000)::BIGINT AS date_range_days
FROM orders
"""


def _typed_events(spark: SparkSession, d: str) -> DataFrame:
    """Every semantic type in one table, the text ones read from text."""
    return gapped_events(spark, d).select(
        "event_id",
        "ts",
        "value",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"),
        F.regexp_extract("props", "([0-9]+)", 1).alias("k_text"),
        (F.col("value") > 50).alias("large"),
        "event_type",
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("remark"),
        F.when(F.col("event_id") < 0, F.col("props")).alias("nothing"),
    )


def classify_all(spark: SparkSession, d: str) -> DataFrame:
    return classify_columns(_typed_events(spark, d))


def _classify_sql() -> str:
    text = """CASE WHEN count({c}) = 0 THEN 'empty'
      WHEN count(TRY_CAST({c} AS DOUBLE)) >= 0.8 * count({c}) THEN 'numeric'
      WHEN count(TRY_CAST({c} AS TIMESTAMP)) >= 0.8 * count({c}) THEN 'datetime'
      WHEN count(DISTINCT {c}) < 0.5 * count({c}) OR count(DISTINCT {c}) <= 50 THEN 'categorical' ELSE 'text' END"""
    stored = "CASE WHEN count({c}) = 0 THEN 'empty' ELSE '{kind}' END"
    kinds = {"event_id": "numeric", "ts": "datetime", "value": "numeric", "large": "boolean"}
    parts = [f"SELECT '{c}' AS name, {stored.format(c=c, kind=k)} AS inferred_type FROM t" for c, k in kinds.items()]
    parts += [
        f"SELECT '{c}' AS name, {text.format(c=c)} AS inferred_type FROM t"
        for c in ("ts_text", "k_text", "event_type", "remark", "nothing")
    ]
    return f"""WITH {GAPPED_EVENTS}, t AS (
      SELECT event_id, ts, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text,
             regexp_extract(props, '([0-9]+)', 1) AS k_text, value > 50 AS large, event_type,
             event_type || ' ' || event_id AS remark, CASE WHEN event_id < 0 THEN props END AS nothing
      FROM g) """ + " UNION ALL ".join(parts)


def task_types(spark: SparkSession, d: str) -> DataFrame:
    lineitem = table(spark, d, "lineitem")
    names = ["l_extendedprice", "l_linenumber", "l_returnflag"]
    return spark.createDataFrame([(n, infer_task(lineitem, n)) for n in names], "name string, task string")


TASK_TYPES = """
SELECT 'l_extendedprice' AS name,
       CASE WHEN count(DISTINCT l_extendedprice) > 20 THEN 'regression' ELSE 'classification' END AS task FROM lineitem
UNION ALL SELECT 'l_linenumber',
       CASE WHEN count(DISTINCT l_linenumber) > 20 THEN 'regression' ELSE 'classification' END FROM lineitem
UNION ALL SELECT 'l_returnflag', 'classification'
"""


def unique_counts(spark: SparkSession, d: str) -> DataFrame:
    return distinct_counts(table(spark, d, "lineitem")).withColumnRenamed("unique", "n_unique")


UNIQUE_COUNTS = " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(DISTINCT {c})::BIGINT AS n_unique FROM lineitem"
    for c in (*LINEITEM_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate")
)


def most_frequent(spark: SparkSession, d: str) -> DataFrame:
    found = top_values(table(spark, d, "part"), ["p_brand", "p_type", "p_name"], 10)
    return found.select("name", F.col("rank").cast("bigint").alias("rank"), "value", F.col("count").alias("n"))


def _top_sql(source: str, columns, k: int, ties: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS name,
          row_number() OVER (ORDER BY count(*) DESC, {ties.format(c=c)})::BIGINT AS rank,
          {c} AS value, count(*)::BIGINT AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= {k}"""
        for c in columns
    )


def most_frequent_texts(spark: SparkSession, d: str) -> DataFrame:
    found = top_values(table(spark, d, "documents"), ["text", "lang", "source"], 10)
    return found.select("name", F.col("rank").cast("bigint").alias("rank"), "value", F.col("count").alias("n"))


def overview(spark: SparkSession, d: str) -> DataFrame:
    return table_overview(gapped_events(spark, d)).select(
        F.col("rows").alias("n_rows"), "cols", "total_missing", "total_cells", "missing_pct"
    )


OVERVIEW = f"""
WITH {GAPPED_EVENTS}, c AS (
  SELECT count(*) AS n, 6 * count(*) - count(event_id) - count(ts) - count(user_id) - count(event_type) - count(value)
         - count(props) AS m FROM g)
SELECT n::BIGINT AS n_rows, 6::BIGINT AS cols, m::BIGINT AS total_missing, (6 * n)::BIGINT AS total_cells,
       round(m * 100.0::DOUBLE / (6 * n), 2) AS missing_pct FROM c
"""


def numeric_selection(spark: SparkSession, d: str) -> DataFrame:
    return select_numeric(table(spark, d, "customer"))


def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return correlation(table(spark, d, "lineitem")).withColumn("r", F.round("r", 8) + F.lit(0.0))


def correlation_gaps(spark: SparkSession, d: str) -> DataFrame:
    return correlation(labelled_documents(spark, d)).withColumn("r", F.round("r", 8) + F.lit(0.0))


def correlation_sql(source: str, columns) -> str:
    def r(a: str, b: str) -> str:
        return f"corr({a}::DOUBLE, {b}::DOUBLE)"

    return " UNION ALL ".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b,
        CASE WHEN isnan({r(a, b)}) THEN NULL ELSE round({r(a, b)}, 8) + 0.0 END AS r FROM {source}"""
        for a, b in product(columns, columns)
    )


DOCUMENT_NUMBERS = ("doc_id", "n_chars", "quality", "toxic")

QUERIES = {
    "profile_numeric": (profile_numeric, numeric_sql("lineitem", LINEITEM_NUMBERS)),
    "profile_numeric_gaps": (
        profile_numeric_gaps, f"WITH {GAPPED_EVENTS} " + numeric_sql("g", ("event_id", "user_id", "value")),
    ),
    "profile_numeric_negative": (
        profile_numeric_negative, numeric_sql("customer", ("c_custkey", "c_nationkey", "c_acctbal")),
    ),
    "profile_categorical": (profile_categorical, _categorical_sql()),
    "profile_datetime": (profile_datetime, PROFILE_DATETIME),
    "classify_columns": (classify_all, _classify_sql()),
    "infer_task": (task_types, TASK_TYPES),
    "unique_counts": (unique_counts, UNIQUE_COUNTS),
    "top_values": (most_frequent, _top_sql("part", ("p_brand", "p_type", "p_name"), 10, "{c}")),
    "top_values_long_text": (
        most_frequent_texts, _top_sql("documents", ("text", "lang", "source"), 10, "{c}"),
    ),
    "table_overview": (overview, OVERVIEW),
    "select_numeric": (numeric_selection, "SELECT c_custkey, c_nationkey, c_acctbal FROM customer"),
    "correlation_matrix": (correlation_matrix, correlation_sql("lineitem", LINEITEM_NUMBERS)),
    "correlation_gaps": (
        correlation_gaps,
        "WITH d AS (SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)) "
        + correlation_sql("d", DOCUMENT_NUMBERS),
    ),
}
