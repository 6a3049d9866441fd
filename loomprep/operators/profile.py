"""Column profile and table overview."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomprep.functions.columns import chunked, col, collect_aggregates, field, percent, run_jobs
from loomprep.functions.convert import datetime_value, numeric_value
from loomprep.operators.classify import LOCATION, location_exprs, scan_facts, settled_type, type_by_values
from loomprep.operators.frequencies import distinct_counts, has_long_texts, top_values
from loomprep.operators.quantiles import approximate_quantiles, exact_quantiles

TOP_VALUES = 10
QUARTILES = (0.25, 0.5, 0.75)
MICROS_PER_DAY = 86_400_000_000

PROFILE_SCHEMA = """
    name string, dtype string, inferred_type string, total bigint, missing bigint, missing_pct double,
    present bigint, unique bigint, min double, max double, mean double, median double, std double, skew double,
    kurtosis double, q1 double, q3 double, zeros bigint, negatives bigint,
    top_values array<struct<value: string, count: bigint>>, most_common string, most_common_count bigint,
    min_date string, max_date string, date_range_days bigint
"""


def _finite(value: float | None) -> float | None:
    return None if value is None or math.isnan(value) else value


def location_stats(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, dict[str, Any]]:
    """count, min, max, mean, zeros and negatives of each DOUBLE expression."""
    exprs = {key: e for name, x in columns.items() for key, e in location_exprs(name, x).items()}
    got = collect_aggregates(df, exprs) if exprs else {}
    return {n: {key: got[(key, n)] for key in LOCATION} for n in columns}


def spread_stats(
    df: DataFrame, columns: Mapping[str, Column], location: Mapping[str, Mapping[str, Any]]
) -> dict[str, dict[str, float | None]]:
    """Sample and population deviation, bias-corrected skew and excess kurtosis.

    Power sums around the known mean: plain sums that stay in generated code and lose no digits.
    """
    exprs: dict[tuple[str, int], Column] = {}
    for name, x in columns.items():
        if location[name]["count"]:
            d = x - F.lit(location[name]["mean"])
            for power, term in enumerate((d, d * d, d * d * d, d * d * d * d), start=1):
                exprs[(name, power)] = F.sum(term)
    got = collect_aggregates(df, exprs) if exprs else {}
    out = {}
    for name in columns:
        n = location[name]["count"]
        if not n:
            out[name] = {"std": None, "std_pop": None, "skew": None, "kurtosis": None}
            continue
        constant = location[name]["min"] == location[name]["max"]
        s1, s2, s3, s4 = (got[(name, p)] for p in (1, 2, 3, 4))
        shift = s1 / n
        m2 = 0.0 if constant else s2 - n * shift**2
        m3 = s3 - 3 * shift * s2 + 2 * n * shift**3
        m4 = s4 - 4 * shift * s3 + 6 * shift**2 * s2 - 3 * n * shift**4
        usable = m2 > 0 and math.isfinite(m2)
        skew = kurtosis = 0.0 if m2 == 0 else None
        if usable:
            g1 = (m3 / n) / (m2 / n) ** 1.5
            g2 = (m4 / n) / (m2 / n) ** 2 - 3.0
            skew = g1 * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 else None
            kurtosis = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if n > 3 else None
        out[name] = {
            "std": _finite(math.sqrt(m2 / (n - 1))) if n > 1 and m2 >= 0 else None,
            "std_pop": _finite(math.sqrt(m2 / n)) if m2 >= 0 else None,
            "skew": _finite(skew) if n > 2 else None,
            "kurtosis": _finite(kurtosis) if n > 3 else None,
        }
    return out


def numeric_stats(
    df: DataFrame,
    columns: Mapping[str, Column],
    exact: bool = True,
    known: Mapping[str, Mapping[str, Any]] | None = None,
) -> dict[str, dict[str, Any]]:
    """Location, spread, shape and quartiles of each expression; ``exact=False`` takes quantiles from a sketch.

    ``known`` holds location numbers an earlier pass already brought.
    """
    if not columns:
        return {}
    known = known or {}
    located = location_stats(df, {n: x for n, x in columns.items() if n not in known})
    location = {n: known.get(n) or located[n] for n in columns}
    counts = {n: location[n]["count"] for n in columns}

    def quantiles() -> dict[str, list[float | None]]:
        if exact:
            return exact_quantiles(df, columns, QUARTILES, counts)
        return approximate_quantiles(df, columns, QUARTILES)

    spread, quartiles = run_jobs([lambda: spread_stats(df, columns, location), quantiles])
    out = {}
    for n in columns:
        q1, median, q3 = quartiles[n]
        out[n] = {**location[n], **spread[n], "q1": q1, "median": median, "q3": q3, "mean": _finite(location[n]["mean"])}
    return out


def _moment(value: Column) -> Column:
    """Whole seconds, and the fraction where there is one."""
    shown = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def datetime_stats(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, dict[str, Any]]:
    """Earliest and latest moment as text and the whole days between them."""
    exprs: dict[tuple[str, str], Column] = {}
    for n, t in columns.items():
        low, high = F.min(t), F.max(t)
        exprs[(n, "min_date")] = _moment(low)
        exprs[(n, "max_date")] = _moment(high)
        exprs[(n, "date_range_days")] = F.floor((F.unix_micros(high) - F.unix_micros(low)) / MICROS_PER_DAY)
    got = collect_aggregates(df, exprs) if exprs else {}
    return {n: {k: got[(n, k)] for k in ("min_date", "max_date", "date_range_days")} for n in columns}


def _tops(df: DataFrame, columns: Sequence[str], k: int, long_texts: bool) -> dict[str, list[tuple[str, int]]]:
    out: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
    if columns:
        rows = top_values(df, columns, k, long_texts).collect()
        for r in sorted(rows, key=lambda r: (r["name"], r["rank"])):
            out[r["name"]].append((r["value"], r["count"]))
    return out


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """One row per column with every statistic that fits its inferred type.

    The driver holds one small record per column; all counting, ranking and selection runs on executors.
    """
    names = list(columns or df.columns)
    total, facts = scan_facts(df, names, locate=True)
    types = {n: settled_type(field(df, n).dataType, facts[n]) for n in names}
    long_texts = has_long_texts([facts[n].longest for n in names])
    listed = [n for n in names if types[n] in (None, "boolean")]
    numbers = {n: numeric_value(col(n), field(df, n).dataType) for n in names if types[n] == "numeric"}
    known = {n: facts[n].location for n in numbers if facts[n].location}
    moments = {n: datetime_value(col(n), field(df, n).dataType) for n in names if types[n] == "datetime"}
    uniques, tops, numeric, dates = run_jobs(
        [
            lambda: {r["name"]: r["unique"] for r in distinct_counts(df, names, long_texts).collect()},
            lambda: _tops(df, listed, TOP_VALUES, long_texts),
            lambda: numeric_stats(df, numbers, exact, known),
            lambda: datetime_stats(df, moments),
        ]
    )
    rows = []
    for n in names:
        fact, unique = facts[n], uniques.get(n, 0)
        kind = types[n] or type_by_values(unique, fact.present)
        missing = total - fact.present
        row: dict[str, Any] = {
            "name": n,
            "dtype": field(df, n).dataType.simpleString(),
            "inferred_type": kind,
            "total": total,
            "missing": missing,
            "missing_pct": missing * 100.0 / total if total else 0.0,
            "present": fact.present,
            "unique": unique,
        }
        row.update({k: v for k, v in numeric.get(n, {}).items() if k not in ("count", "std_pop")})
        row.update(dates.get(n, {}))
        if n in tops:
            row["top_values"] = tops[n]
        if tops.get(n) and kind != "boolean":
            row["most_common"], row["most_common_count"] = tops[n][0]
        rows.append(row)
    fields = T.StructType.fromDDL(PROFILE_SCHEMA).names
    out = df.sparkSession.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], PROFILE_SCHEMA)
    return out.withColumn("missing_pct", F.round("missing_pct", 2))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(name, missing, total) for every column from one aggregate per forty columns."""
    names = list(columns or df.columns)
    parts = []
    for chunk in chunked(names, 40):
        one = df.agg(F.count(F.lit(1)).alias("__total"), *[F.count(col(c)).alias(c) for c in chunk])
        entries = [
            F.struct(
                F.lit(c).alias("name"),
                (F.col("__total") - col(c)).alias("missing"),
                F.col("__total").alias("total"),
            )
            for c in chunk
        ]
        parts.append(one.select(F.inline(F.array(*entries))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def table_overview(df: DataFrame) -> DataFrame:
    """One row: rows, cols, total_missing, total_cells, missing_pct."""
    cols = len(df.columns)
    counted = missing_counts(df).agg(F.max("total").alias("rows"), F.sum("missing").alias("total_missing"))
    cells = F.col("rows") * F.lit(cols)
    return counted.select(
        "rows",
        F.lit(cols).cast("bigint").alias("cols"),
        "total_missing",
        cells.alias("total_cells"),
        percent(F.col("total_missing"), cells).alias("missing_pct"),
    )

