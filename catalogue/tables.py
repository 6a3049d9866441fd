"""Test tables as the queries use them, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomprep.functions.nulls import normalize_nulls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return normalize_nulls(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def gapped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose readings are missing by kind: errors carry no value, sign-ups no user, views no properties."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").withColumns(
        {
            "user_id": F.when(kind != "signup", F.col("user_id")),
            "value": F.when(kind != "error", F.col("value")),
            "props": F.when(kind != "view", F.col("props")),
        }
    )


GAPPED_EVENTS = """
g AS (
  SELECT event_id, ts,
         CASE WHEN event_type <> 'signup' THEN user_id END AS user_id,
         event_type,
         CASE WHEN event_type <> 'error' THEN value END AS value,
         CASE WHEN event_type <> 'view' THEN props END AS props
  FROM events
)"""

EVENT_ORDER = ["ts", "event_id"]


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels; most have none."""
    documents = table(spark, sf_dir, "documents")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")
