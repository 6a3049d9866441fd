"""Sources and sinks: whole tables written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogue.tables import table
from loomprep.session import scratch_path
from loomprep.sources.readers import cap_rows, flatten_structs, read_table, source_info
from loomprep.sources.writers import write_table


def _round_trip(name: str, fmt: str, typed: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        source = table(spark, d, name)
        path = write_table(source, scratch_path(spark, name), fmt)
        return read_table(spark, path, schema=source.schema if typed else None)

    return run


def texts_with_line_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Conversations hold quotes and line breaks inside fields."""
    return _round_trip("conversations", "csv")(spark, d)


def texts_over_many_lines(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, every word on a line of its own: most line breaks of the files do not end a record."""
    lines = F.translate("text", " ", "\n")
    source = table(spark, d, "documents").select("doc_id", F.concat(lines, F.lit('\n"end", and')).alias("text"), "lang")
    return read_table(spark, write_table(source, scratch_path(spark, "lines"), "csv"))


def flatten_json(spark: SparkSession, d: str) -> DataFrame:
    """Nested records written as JSON Lines, read and flattened to ``parent.child`` columns."""
    nested = table(spark, d, "events").select(
        "event_id", F.struct(F.from_json("props", "k bigint").alias("p"), F.col("event_type").alias("t")).alias("r")
    )
    path = write_table(nested, scratch_path(spark, "nested"), "json")
    flat = read_table(spark, path, flatten=True)
    return flat.select("event_id", F.col("`r.p.k`").alias("k"), F.col("`r.t`").alias("t"))


def flatten_in_place(spark: SparkSession, d: str) -> DataFrame:
    nested = table(spark, d, "nation").select("n_nationkey", F.struct("n_name", "n_regionkey").alias("about"))
    flat = flatten_structs(nested)
    return flat.select("n_nationkey", F.col("`about.n_name`").alias("n_name"), F.col("`about.n_regionkey`").alias("n_regionkey"))


def load_metadata(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d.rstrip('/')}/lineitem.parquet"
    return source_info(read_table(spark, path), path).select("type", "file_type", "filename", "total_rows", "total_cols")


def capped(spark: SparkSession, d: str) -> DataFrame:
    """The optional load cap, with its flag; the threshold is the size of the smaller of two tables."""
    smaller = table(spark, d, "part").count()
    kept, info = cap_rows(table(spark, d, "orders"), "o_orderkey", threshold=smaller, keep=smaller // 2)
    return kept.select("o_orderkey", F.lit(info["limited"]).alias("limited"), F.lit(info["original_total_rows"]).cast("bigint").alias("total"))


QUERIES = {
    "csv_round_trip": (_round_trip("orders", "csv", typed=True), "SELECT * FROM orders"),
    "csv_quoted_line_breaks": (
        texts_with_line_breaks,
        "SELECT conv_id, turn, role, text FROM conversations",
    ),
    "csv_texts_in_parts": (
        texts_over_many_lines,
        """SELECT doc_id, replace(text, ' ', chr(10)) || chr(10) || '"end", and' AS text, lang FROM documents""",
    ),
    "csv_inferred_types": (_round_trip("customer", "csv"), "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, "
                           "c_acctbal, c_mktsegment FROM customer"),
    "tsv_round_trip": (_round_trip("part", "tsv", typed=True), "SELECT * FROM part"),
    "tab_round_trip": (_round_trip("supplier", "tab", typed=True), "SELECT * FROM supplier"),
    "json_round_trip": (_round_trip("customer", "json", typed=True), "SELECT * FROM customer"),
    "parquet_round_trip": (_round_trip("lineitem", "parquet"), "SELECT * FROM lineitem"),
    "flatten_json": (
        flatten_json,
        "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type AS t FROM events",
    ),
    "flatten_structs": (flatten_in_place, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "source_info": (
        load_metadata,
        "SELECT 'file' AS type, 'Parquet' AS file_type, 'lineitem.parquet' AS filename, count(*)::BIGINT AS total_rows, "
        "11::BIGINT AS total_cols FROM lineitem",
    ),
    "cap_rows": (
        capped,
        "SELECT o_orderkey, true AS limited, (SELECT count(*) FROM orders)::BIGINT AS total FROM orders "
        "ORDER BY o_orderkey LIMIT (SELECT count(*) // 2 FROM part)",
    ),
}
