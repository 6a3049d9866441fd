"""Pearson correlation of numeric columns over pairwise-complete rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

from loomprep.functions.columns import col, collect_aggregates, numeric_columns

SCHEMA = "col_a string, col_b string, r double"
# Up to this many columns pairs are plain aggregates; more columns go through one matrix product, after which the pairs
# in which a side hardly varies are summed as plain aggregates too.
PAIRWISE_COLUMNS = 16
HARDLY = 1e-6


def correlation(df: DataFrame, pairwise_columns: int = PAIRWISE_COLUMNS) -> DataFrame | None:
    """Long form (col_a, col_b, r) of the full matrix; None with fewer than two numeric columns.

    r is NULL where a side is constant over the rows that have both values, told by its least and greatest value. Columns
    without gaps share their own sums, so k columns cost k(k-1)/2 products; only pairs that touch a gap carry sums of
    their own. The driver holds a number per pair of columns.
    """
    names = numeric_columns(df)
    if len(names) < 2:
        return None
    x = {n: col(n).cast("double") for n in names}
    first: dict[tuple[str, str], Column] = {("", "rows"): F.count(F.lit(1))}
    for n in names:
        first[(n, "count")] = F.count(x[n])
        first[(n, "mean")] = F.avg(x[n])
        first[(n, "min")] = F.min(x[n])
        first[(n, "max")] = F.max(x[n])
    base = collect_aggregates(df, first)
    rows = base[("", "rows")]
    live = [n for n in names if base[(n, "count")] and base[(n, "min")] != base[(n, "max")]]
    full = {n for n in live if base[(n, "count")] == rows}
    d = {n: x[n] - F.lit(base[(n, "mean")]) for n in live}

    if len(live) > pairwise_columns:
        pairs, unsettled = _wide_pairs(df, live, full, d)
        return _as_matrix(df, names, set(live), {**pairs, **_plain_pairs(df, unsettled, full, d, rows)})
    return _as_matrix(df, names, set(live), _plain_pairs(df, list(combinations(live, 2)), full, d, rows))


def _plain_pairs(
    df: DataFrame, wanted: Sequence[tuple[str, str]], full: set[str], d: Mapping[str, Column], rows: int
) -> dict[tuple[str, str], float | None]:
    second: dict[tuple[str, ...], Column] = {}
    for n in sorted({n for pair in wanted for n in pair} & full):
        second[("s", n)] = F.sum(d[n])
        second[("ss", n)] = F.sum(d[n] * d[n])
    for a, b in wanted:
        second[("ab", a, b)] = F.sum(d[a] * d[b])
        if a not in full or b not in full:
            both = d[a].isNotNull() & d[b].isNotNull()
            second[("n", a, b)] = F.count_if(both)
            for side, n in (("a", a), ("b", b)):
                only = F.when(both, d[n])
                second[("s" + side, a, b)] = F.sum(only)
                second[("ss" + side, a, b)] = F.sum(only * only)
                second[("lo" + side, a, b)] = F.min(only)
                second[("hi" + side, a, b)] = F.max(only)
    got = collect_aggregates(df, second) if second else {}

    def pair(a: str, b: str) -> float | None:
        if a in full and b in full:
            n, sa, sb, saa, sbb = rows, got[("s", a)], got[("s", b)], got[("ss", a)], got[("ss", b)]
        else:
            n = got[("n", a, b)]
            if n < 2 or any(got[("lo" + s, a, b)] == got[("hi" + s, a, b)] for s in "ab"):
                return None
            sa, sb, saa, sbb = (got[(key, a, b)] for key in ("sa", "sb", "ssa", "ssb"))
        va, vb = saa - sa * sa / n, sbb - sb * sb / n
        if not (va > 0 and vb > 0):
            return None
        r = (got[("ab", a, b)] - sa * sb / n) / math.sqrt(va) / math.sqrt(vb)
        return None if math.isnan(r) else max(-1.0, min(1.0, r))

    return {(a, b): pair(a, b) for a, b in wanted}


def _as_matrix(
    df: DataFrame, names: Sequence[str], live: set[str], pairs: Mapping[tuple[str, str], float | None]
) -> DataFrame:
    def r(a: str, b: str) -> float | None:
        if a == b:
            return 1.0 if a in live else None
        return pairs.get((a, b), pairs.get((b, a)))

    return df.sparkSession.createDataFrame([(a, b, r(a, b)) for a in names for b in names], SCHEMA)


def _wide_pairs(
    df: DataFrame, live: Sequence[str], full: set[str], d: Mapping[str, Column]
) -> tuple[dict[tuple[str, str], float | None], list[tuple[str, str]]]:
    """All pairs of many columns from one distributed Gram matrix, and the pairs that it leaves to be settled.

    A row is the vector of centred values, presence marks and centred squares (gaps as zero), so that the products of
    these parts are the pairwise-complete sums. Where next to nothing of a side's sum of squares is left, rounding could
    pass for variation and the pair is left. The driver holds (3k)^2 numbers for k columns.
    """
    k = len(live)
    zero = [F.coalesce(d[n], F.lit(0.0)) for n in live]
    gaps = len(full) < k
    parts = list(zero)
    if gaps:
        parts += [d[n].isNotNull().cast("double") for n in live] + [z * z for z in zero]
    vectors = df.select(array_to_vector(F.array(*parts)).alias("v"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()
    product = gram[:k, :k]
    if gaps:
        count, total, square = gram[k : 2 * k, k : 2 * k], gram[:k, k : 2 * k], gram[2 * k :, k : 2 * k]
    else:
        sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(d[n]).alias(f"s{i}") for i, n in enumerate(live)]).first()
        count = np.full((k, k), float(sums["n"]))
        total = np.repeat(np.array([sums[f"s{i}"] for i in range(k)])[:, None], k, axis=1)
        square = np.repeat(np.diag(product)[:, None], k, axis=1)
    out: dict[tuple[str, str], float | None] = {}
    unsettled: list[tuple[str, str]] = []
    for i, j in combinations(range(k), 2):
        n = count[i, j]
        if n < 2:
            out[(live[i], live[j])] = None
            continue
        vi, vj = square[i, j] - total[i, j] ** 2 / n, square[j, i] - total[j, i] ** 2 / n
        if vi <= HARDLY * square[i, j] or vj <= HARDLY * square[j, i]:
            unsettled.append((live[i], live[j]))
            continue
        r = (product[i, j] - total[i, j] * total[j, i] / n) / math.sqrt(vi) / math.sqrt(vj)
        out[(live[i], live[j])] = None if math.isnan(r) else max(-1.0, min(1.0, float(r)))
    return out, unsettled
