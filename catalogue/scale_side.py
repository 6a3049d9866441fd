"""The plans that large tables take, run with small thresholds over the same tables, and the exactness of files and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogue.fills import INTERPOLATE
from catalogue.profiling import DOCUMENT_NUMBERS, LINEITEM_NUMBERS, correlation_sql
from catalogue.tables import EVENT_ORDER, GAPPED_EVENTS, gapped_events, labelled_documents, table
from loomprep.functions.convert import convert_column
from loomprep.operators.charts import histogram
from loomprep.operators.correlation import correlation
from loomprep.operators.features import stratified_split
from loomprep.operators.missing import apply_strategy
from loomprep.operators.ordered import fill_ordered, plan_ranges, row_numbers
from loomprep.operators.paging import page
from loomprep.operators.quantiles import exact_quantiles
from loomprep.plans.audit import AuditLog
from loomprep.plans.recipe import MISSING, Recipe, Step
from loomprep.session import scratch_path
from loomprep.sources.readers import read_table
from loomprep.sources.writers import write_table

RANGE_ROWS = 250


def _filled_in_ranges(method: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        events = gapped_events(spark, d)
        out = fill_ordered(events, {"value": method}, plan=plan_ranges(events, EVENT_ORDER, (), RANGE_ROWS))
        return out.select("event_id", F.round("value", 6).alias("value"))

    return run


def _last(order: str) -> str:
    return f"""WITH {GAPPED_EVENTS} SELECT event_id, round(coalesce(value, last_value(value IGNORE NULLS) OVER (
    ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS value FROM g"""


def after_key_change(spark: SparkSession, d: str) -> DataFrame:
    """The fill follows users whose missing ids are filled first, which turns the key into a DOUBLE."""
    events = gapped_events(spark, d)
    recipe = Recipe([Step(MISSING, "user_id", "fill_mean"), Step(MISSING, "value", "fill_forward")])
    out = recipe.fit(events, EVENT_ORDER, "user_id", rows_per_range=RANGE_ROWS).transform(events)
    return out.select("event_id", F.round("user_id", 6).alias("user_id"), "value")


AFTER_KEY_CHANGE = f"""
WITH {GAPPED_EVENTS}, k AS (SELECT event_id, ts, value, coalesce(user_id::DOUBLE, (SELECT avg(user_id) FROM g)) AS user_id FROM g)
SELECT event_id, round(user_id, 6) AS user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id
  ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM k
"""


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("r", F.round("r", 8) + F.lit(0.0))


def wide_correlation(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(correlation(table(spark, d, "lineitem"), pairwise_columns=1))


def wide_correlation_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(correlation(labelled_documents(spark, d), pairwise_columns=1))


def narrowed_quantiles(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    wanted = {c: F.col(c).cast("double") for c in LINEITEM_NUMBERS}
    found = exact_quantiles(lines, wanted, (0.1, 0.25, 0.5, 0.75, 0.9), sorted_rows=100)
    return spark.createDataFrame([(c, *[round(x, 6) for x in q]) for c, q in found.items()], "name string, q10 double, q25 double, q50 double, q75 double, q90 double")


def deep_page(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return page(orders, 11, ["o_orderdate", "o_orderkey"], shallow_rows=200)


def numbered_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every row of a full sort with its place."""
    parts = table(spark, d, "part")
    return row_numbers(parts, ["p_retailprice", "p_partkey"], name="place").select("p_partkey", F.col("place").cast("bigint").alias("place"))


def _exact_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with times to the microsecond and padded texts."""
    return table(spark, d, "events").select(
        "event_id",
        F.timestamp_micros(F.lit(1_600_000_000_000_000) + F.col("event_id") * 1_000_003).alias("at"),
        F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")).alias("padded"),
        (F.lit(9_100_000_000_000_000_000) + F.col("event_id")).alias("long_id"),
    )


EXACT = """
SELECT event_id, make_timestamp(1600000000000000 + event_id * 1000003) AS at, '  ' || event_type || ' ' AS padded,
       9100000000000000000 + event_id AS long_id FROM events
"""


def _exact_round_trip(fmt: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        source = _exact_events(spark, d)
        back = read_table(spark, write_table(source, scratch_path(spark, "exact"), fmt), schema=source.schema)
        return back.withColumn("at", F.col("at").cast("timestamp_ntz"))

    return run


def inferred_long_ids(spark: SparkSession, d: str) -> DataFrame:
    """Nineteen and twenty-one digits: a BIGINT and a DECIMAL, never a DOUBLE."""
    ids = table(spark, d, "orders").select("o_orderkey", (F.lit(9_100_000_000_000_000_000) + F.col("o_orderkey")).alias("long_id"),
                                           F.concat(F.lit("123456789012345"), F.lpad("o_orderkey", 10, "0")).alias("wide_id"))
    back = read_table(spark, write_table(ids, scratch_path(spark, "ids"), "csv"))
    return back.select("o_orderkey", "long_id", F.col("wide_id").cast("string").alias("wide_id"))


ARRAY_KEYS = 1000  # keys of one array


def mixed_json(spark: SparkSession, d: str) -> DataFrame:
    """A folder with JSON lines, lines that are arrays, and arrays over several lines, an array for so many keys."""
    names = ["o_orderkey", "o_custkey", "o_orderpriority"]
    orders = table(spark, d, "orders").select(*names)
    folder = scratch_path(spark, "mixed") + ".json"
    orders.where("o_orderkey % 3 = 0").write.json(folder)
    for part, shape in ((1, {}), (2, {"pretty": "true"})):
        ranges = orders.where(F.col("o_orderkey") % 3 == part).groupBy(F.floor(F.col("o_orderkey") / ARRAY_KEYS))
        arrays = ranges.agg(F.to_json(F.collect_list(F.struct(*names)), shape).alias("value"))
        arrays.select("value").write.mode("append").text(folder)
    return read_table(spark, folder).select(*names)


FORMATS = ("MMM d, yyyy", "d MMMM yyyy", "yyyyMMdd", "MM/dd/yyyy", "MM/dd/yy", "yyyy-MM-dd")


def datetime_formats(spark: SparkSession, d: str) -> DataFrame:
    """Month names, compact dates, half-day clocks and two-digit years."""
    orders = table(spark, d, "orders")
    words = F.lit(None).cast("string")
    for i, shape in enumerate(FORMATS):
        clock = F.when(F.col("o_orderkey") % 3 == 0, " 3:45 PM").when(F.col("o_orderkey") % 3 == 1, " 12:05 am").otherwise("")
        shown = F.date_format("o_orderdate", shape)
        words = F.when(F.col("o_custkey") % len(FORMATS) == i, shown if shape == "yyyyMMdd" else F.concat(shown, clock)).otherwise(words)
    out = convert_column(orders.select("o_orderkey", words.alias("reading")), "reading", "datetime")
    return out.withColumn("reading", F.col("reading").cast("timestamp_ntz"))


DATETIME_FORMATS = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE WHEN o_custkey % 6 = 2 THEN INTERVAL 0 MINUTE WHEN o_orderkey % 3 = 0
  THEN INTERVAL 945 MINUTE WHEN o_orderkey % 3 = 1 THEN INTERVAL 5 MINUTE ELSE INTERVAL 0 MINUTE END AS reading FROM orders
"""


def infinite_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Orders of one kind have an infinite price, which is in no bin."""
    price = F.when(F.col("o_orderpriority") == "5-LOW", float("inf")).otherwise(F.col("o_totalprice").cast("double"))
    return histogram(table(spark, d, "orders").select(price.alias("x")), "x", 10).select(F.col("count").alias("n"), "bin")


INFINITE_HISTOGRAM = """
WITH v AS (SELECT o_totalprice::DOUBLE AS x FROM orders WHERE o_orderpriority <> '5-LOW'), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
p AS (SELECT least(floor((x - lo) / (hi - lo) * 10), 9)::BIGINT AS bin FROM v, e), c AS (SELECT bin, count(*) AS n FROM p GROUP BY bin)
SELECT i::BIGINT AS bin, coalesce(n, 0)::BIGINT AS n FROM range(10) r(i) LEFT JOIN c ON bin = i
"""


def mode_of_decimals(spark: SparkSession, d: str) -> DataFrame:
    gaps = F.when(F.col("l_linenumber") != 2, F.col("l_quantity").cast("decimal(20,2)"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", gaps.alias("quantity"))
    out = apply_strategy(lines, "quantity", "fill_mode")
    return out.groupBy("quantity").agg(F.count(F.lit(1)).alias("n")).select(F.col("quantity").cast("string").alias("quantity"), "n")


MODE_OF_DECIMALS = """
WITH q AS (SELECT CASE WHEN l_linenumber <> 2 THEN CAST(l_quantity AS DECIMAL(20,2)) END AS quantity FROM lineitem),
m AS (SELECT quantity AS mode FROM q WHERE quantity IS NOT NULL GROUP BY quantity ORDER BY count(*) DESC, quantity LIMIT 1)
SELECT CAST(coalesce(quantity, mode) AS VARCHAR) AS quantity, count(*) AS n FROM q, m GROUP BY 1
"""


def mode_of_times(spark: SparkSession, d: str) -> DataFrame:
    moment = F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).cast("timestamp_ntz") + F.expr("INTERVAL 10 HOURS")
    orders = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", moment).alias("moment"))
    return apply_strategy(orders, "moment", "fill_mode")


MODE_OF_TIMES = """
WITH q AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 10 HOUR END AS moment FROM orders),
m AS (SELECT moment AS mode FROM q WHERE moment IS NOT NULL GROUP BY moment ORDER BY count(*) DESC, moment LIMIT 1)
SELECT o_orderkey, coalesce(moment, mode) AS moment FROM q, m
"""


def split_with_missing_classes(spark: SparkSession, d: str) -> DataFrame:
    documents = labelled_documents(spark, d)
    return stratified_split(documents, "doc_id", "quality").select("doc_id", "is_test")


SPLIT_WITH_MISSING = """
WITH x AS (SELECT d.doc_id, coalesce('=' || CAST(l.quality AS VARCHAR), '') AS g FROM documents d LEFT JOIN labels l USING (doc_id)),
n AS (SELECT g, count(*) AS n FROM x GROUP BY g), t AS (SELECT ceil(0.2::DOUBLE * sum(n)) AS tests, sum(n) AS total FROM n),
e AS (SELECT g, n * tests / total::DOUBLE AS exact, floor(n * tests / total::DOUBLE) AS low, tests FROM n, t),
k AS (SELECT g, low + CASE WHEN row_number() OVER (ORDER BY exact - low DESC, g) <= tests - sum(low) OVER () THEN 1 ELSE 0 END AS size FROM e)
SELECT doc_id, row_number() OVER (PARTITION BY x.g ORDER BY md5(CAST(doc_id AS VARCHAR)) DESC) <= size AS is_test FROM x JOIN k USING (g)
"""


def reopened_log(spark: SparkSession, d: str) -> DataFrame:
    """A log that is opened again goes on counting its events."""
    path, events = scratch_path(spark, "audit"), gapped_events(spark, d)
    AuditLog(spark, path, "s").record_load(events, {"table_name": "events"})
    again = AuditLog(spark, path, "s")
    again.record_undo()
    again.record_export(events, "events.parquet", "parquet")
    return again.report().select("seq", "event", F.col("after.rows").alias("n_rows"))


QUERIES = {
    "fill_forward_ranges": (_filled_in_ranges("forward"), _last("ts, event_id")),
    "fill_backward_ranges": (_filled_in_ranges("backward"), _last("ts DESC, event_id DESC")),
    "interpolate_ranges": (
        _filled_in_ranges("interpolate"), f"WITH {GAPPED_EVENTS}, {INTERPOLATE} SELECT event_id, round(value, 6) AS value FROM i",
    ),
    "fill_after_key_change": (after_key_change, AFTER_KEY_CHANGE),
    "correlation_wide": (wide_correlation, correlation_sql("lineitem", LINEITEM_NUMBERS)),
    "correlation_wide_gaps": (
        wide_correlation_gaps,
        "WITH d AS (SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)) "
        + correlation_sql("d", DOCUMENT_NUMBERS),
    ),
    "quantiles_narrowed": (
        narrowed_quantiles,
        " UNION ALL ".join(
            f"SELECT '{c}' AS name, " + ", ".join(f"round(quantile_cont({c}::DOUBLE, {p / 100}), 6) AS q{p}" for p in (10, 25, 50, 75, 90)) + " FROM lineitem"
            for c in LINEITEM_NUMBERS
        ),
    ),
    "deep_page": (deep_page, "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100 OFFSET 1100"),
    "sort_places": (numbered_parts, "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS place FROM part"),
    "csv_round_trip_events": (_exact_round_trip("csv"), EXACT),
    "json_round_trip_events": (_exact_round_trip("json"), EXACT),
    "csv_long_ids": (
        inferred_long_ids,
        "SELECT o_orderkey, 9100000000000000000 + o_orderkey AS long_id, '123456789012345' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS wide_id FROM orders",
    ),
    "json_mixed_folder": (mixed_json, "SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_orderpriority FROM orders"),
    "convert_datetime_formats": (datetime_formats, DATETIME_FORMATS),
    "histogram_infinite": (infinite_histogram, INFINITE_HISTOGRAM),
    "fill_mode_decimal": (mode_of_decimals, MODE_OF_DECIMALS),
    "fill_mode_timestamp": (mode_of_times, MODE_OF_TIMES),
    "stratified_split_nulls": (split_with_missing_classes, SPLIT_WITH_MISSING),
    "event_log_reopened": (
        reopened_log,
        "SELECT 0::BIGINT AS seq, 'load' AS event, count(*)::BIGINT AS n_rows FROM events UNION ALL SELECT 1, 'undo', NULL "
        "UNION ALL SELECT 2, 'export', count(*) FROM events",
    ),
}
