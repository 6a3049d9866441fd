"""Pages, sorted listings and full-table text search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomprep.functions.columns import col
from loomprep.operators.ordered import BUCKET, assign_ranges, plan_ranges, within

PAGE_SIZE = 100
# Every task keeps offset + limit rows for a top-k sort; deeper pages are narrowed to few key ranges first.
SHALLOW_ROWS = 100_000


def page_count(df: DataFrame, size: int = PAGE_SIZE) -> int:
    return max(1, (df.count() - 1) // size + 1)


def page(
    df: DataFrame, number: int, order_by: str | Sequence[str], size: int = PAGE_SIZE, shallow_rows: int = SHALLOW_ROWS
) -> DataFrame:
    """Rows [number*size, (number+1)*size) in the order of ``order_by`` (unique), counting pages from 0.

    A deep page is found by counts per key range; only the ranges it lies in are sorted.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    start = number * size
    part = df
    while start + size > shallow_rows:
        plan = plan_ranges(part, keys, rows_per_range=max(1, shallow_rows // 4))
        if plan.count == 1:
            break
        counts = {r[BUCKET]: r["count"] for r in assign_ranges(part, plan).groupBy(BUCKET).count().collect()}
        before, first, last, skipped = 0, None, 0, 0
        for i in range(plan.count):
            after = before + counts.get(i, 0)
            if before < start + size and after > start:
                if first is None:
                    first, skipped = i, before
                last = i
            before = after
        if first is None:
            return df.where(F.lit(False))
        part = within(part, plan, first, last)
        if skipped == 0 and last == plan.count - 1:
            break
        start -= skipped
    return part.orderBy([col(k) for k in keys]).offset(start).limit(size)


def sort_rows(
    df: DataFrame, column: str, tie_breaker: str | Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """All rows by one column, then by the tie-breaker: a range-partitioned sort."""
    ties = [tie_breaker] if isinstance(tie_breaker, str) else list(tie_breaker)
    first = col(column).desc_nulls_last() if descending else col(column).asc_nulls_last()
    return df.orderBy([first] + [col(t) for t in ties])


def search_condition(df: DataFrame, term: str) -> Column:
    needle = F.lit(term.lower())
    hits = [F.coalesce(F.lower(col(c).cast("string")).contains(needle), F.lit(False)) for c in df.columns]
    return reduce(lambda a, b: a | b, hits)


def search(df: DataFrame, term: str) -> DataFrame:
    """Rows in which any column, read as text, holds ``term`` in any case."""
    return df.where(search_condition(df, term))
