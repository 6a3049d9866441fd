"""Session settings the engine is written for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE re-plans joins and splits skewed partitions from measured sizes, so no operator hard-codes a strategy.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "loomprep", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the engine's defaults; anything the cluster already set wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    given = {key for key, _ in spark.sparkContext.getConf().getAll()}
    for key, value in DEFAULTS.items():
        if key not in given:
            spark.conf.set(key, value)
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """New path for a written intermediate, under the shared folder of ``spark.checkpoint.dir``.

    Where that setting is absent a session that runs in one process uses a local temporary folder. Executors of a cluster
    would each write to a disk of their own, and what is read back would be incomplete, so there it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = shared.rstrip("/") if shared else tempfile.mkdtemp(prefix="loomprep-")
    return f"{root}/{label}-{uuid.uuid4().hex}"
