"""File sinks: CSV, TSV, TAB, JSON and Parquet."""

from __future__ import annotations

import os

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame

# Format name to suffix.
FORMATS = {"csv": ".csv", "json": ".json", "parquet": ".parquet", "tsv": ".tsv", "tab": ".tab"}

# Text formats keep the microseconds of a timestamp.
INSTANT, WALL_CLOCK = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def target_path(path: str, fmt: str) -> str:
    """``path`` with the suffix of the format; an unknown format is an error."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported export format {fmt!r}; choose from {list(FORMATS)}")
    base, suffix = os.path.splitext(path)
    return path if suffix.lower() == FORMATS[fmt] else base + FORMATS[fmt]


def _place(path: str) -> str:
    parts = urlparse(path)
    return os.path.normpath(unquote(parts.path)) if parts.scheme in ("", "file") else path.rstrip("/")


def check_target(df: DataFrame, target: str) -> None:
    """A table that is read from its own target would be gone before it is written."""
    place = _place(target)
    if any(_place(f) == place or _place(f).startswith(f"{place}/") for f in df.inputFiles()):
        raise ValueError(f"{target} holds files the table is read from: write to another place")


def write_table(
    df: DataFrame, path: str, fmt: str, mode: str = "overwrite", single_file: bool = False, encoding: str = "UTF-8"
) -> str:
    """Write part files below the path and return it. ``single_file`` is for small results: one task writes all.

    What the target held before goes, unless ``mode`` says otherwise; the table's own input is refused as a target.
    """
    target = target_path(path, fmt)
    check_target(df, target)
    writer = (df.coalesce(1) if single_file else df).write.mode(mode)
    if fmt == "parquet":
        writer.parquet(target)
    elif fmt == "json":
        times = writer.option("timestampFormat", INSTANT).option("timestampNTZFormat", WALL_CLOCK)
        times.option("ignoreNullFields", False).json(target)
    else:
        sep = "," if fmt == "csv" else "\t"
        writer = writer.option("timestampFormat", INSTANT).option("timestampNTZFormat", WALL_CLOCK)
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        writer.option("header", True).option("sep", sep).option("escape", '"').option("encoding", encoding).csv(target)
    return target
