"""Chart numbers, paging, sorting and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogue.tables import gapped_events, table
from loomprep.operators.charts import bars, boxplot, boxplot_fliers, heatmap, histogram
from loomprep.operators.paging import PAGE_SIZE, page, page_count, search, sort_rows
from loomprep.sources.readers import first_rows


def histogram_30(spark: SparkSession, d: str) -> DataFrame:
    return histogram(table(spark, d, "lineitem"), "l_extendedprice").select(
        "bin", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"), F.col("count").alias("n")
    )


HISTOGRAM = """
WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT i AS bin, lo + i * ((hi - lo) / 30) AS lower,
             CASE WHEN i = 29 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 30) END AS upper
      FROM range(30) r(i), e),
p AS (SELECT l_extendedprice AS x, least(floor((l_extendedprice - lo) / (hi - lo) * 30), 29)::BIGINT AS bin
      FROM lineitem, e),
c AS (SELECT CASE WHEN x < b.lower THEN p.bin - 1 WHEN p.bin < 29 AND x >= b.upper THEN p.bin + 1 ELSE p.bin END AS bin,
             count(*) AS n FROM p JOIN b USING (bin) GROUP BY 1)
SELECT b.bin::BIGINT AS bin, round(lower, 4) AS lower, round(upper, 4) AS upper, coalesce(n, 0)::BIGINT AS n
FROM b LEFT JOIN c ON b.bin = c.bin
"""


def boxplot_stats(spark: SparkSession, d: str) -> DataFrame:
    found = boxplot(gapped_events(spark, d), "value")
    return found.select(*[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "fliers")


BOX = """
WITH v AS (SELECT event_id, value AS x FROM events WHERE event_type <> 'error'),
q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM v),
f AS (SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi FROM q)
"""


def fliers(spark: SparkSession, d: str) -> DataFrame:
    return boxplot_fliers(gapped_events(spark, d), "value").select("event_id", "value")


def bar_top15(spark: SparkSession, d: str) -> DataFrame:
    return bars(table(spark, d, "part"), "p_brand").select("value", F.col("count").alias("n"))


def correlation_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return heatmap(table(spark, d, "supplier")).withColumn("r", F.round("r", 8) + F.lit(0.0))


def page_of_rows(spark: SparkSession, d: str) -> DataFrame:
    return page(table(spark, d, "orders"), 3, ["o_orderdate", "o_orderkey"])


def last_page(spark: SparkSession, d: str) -> DataFrame:
    """The last page with the number of pages beside each row."""
    orders = table(spark, d, "orders")
    pages = page_count(orders)
    return page(orders, pages - 1, ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.lit(pages).cast("bigint").alias("pages"))


LAST_PAGE = f"""
WITH n AS (SELECT greatest(1, (count(*) - 1) // {PAGE_SIZE} + 1)::BIGINT AS pages FROM orders),
r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i FROM orders)
SELECT o_orderkey, pages FROM r, n WHERE i > (pages - 1) * {PAGE_SIZE}
"""


def sorted_head(spark: SparkSession, d: str) -> DataFrame:
    return sort_rows(table(spark, d, "part"), "p_retailprice", "p_partkey", descending=True).limit(PAGE_SIZE)


def search_rows(spark: SparkSession, d: str) -> DataFrame:
    return search(table(spark, d, "part"), "RING")


SEARCH = "SELECT * FROM part WHERE " + " OR ".join(
    f"contains(lower(CAST({c} AS VARCHAR)), 'ring')"
    for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
)


def head_rows(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(table(spark, d, "events"), 500, ["ts", "event_id"])


QUERIES = {
    "histogram_30": (histogram_30, HISTOGRAM),
    "boxplot_stats": (
        boxplot_stats,
        BOX + """SELECT round(min(q1), 6) AS q1, round(min(median), 6) AS median, round(min(q3), 6) AS q3,
        round(min(x) FILTER (x >= lo), 6) AS whisker_low, round(max(x) FILTER (x <= hi), 6) AS whisker_high,
        (count(*) FILTER (x < lo OR x > hi))::BIGINT AS fliers FROM v, f""",
    ),
    "boxplot_fliers": (fliers, BOX + "SELECT event_id, x AS value FROM v, f WHERE x < lo OR x > hi"),
    "bar_top15": (
        bar_top15,
        "SELECT p_brand AS value, count(*)::BIGINT AS n FROM part GROUP BY p_brand ORDER BY n DESC, value LIMIT 15",
    ),
    "correlation_heatmap": (
        correlation_heatmap,
        " UNION ALL ".join(
            f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}::DOUBLE, {b}::DOUBLE), 8) + 0.0 AS r FROM supplier"
            for a in ("s_suppkey", "s_nationkey", "s_acctbal")
            for b in ("s_suppkey", "s_nationkey", "s_acctbal")
        ),
    ),
    "page_of_rows": (page_of_rows, "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100 OFFSET 300"),
    "last_page": (last_page, LAST_PAGE),
    "sort_limit": (sorted_head, "SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100"),
    "search_rows": (search_rows, SEARCH),
    "head_rows": (head_rows, "SELECT * FROM events ORDER BY ts, event_id LIMIT 500"),
}
