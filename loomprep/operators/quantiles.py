"""Exact linear-interpolated quantiles without sorting or holding a column in one place.

A random sample proposes cut values around each wanted rank, an exact count tells which gap between cuts
holds the rank, and only that gap is looked at again. When a gap holds few rows they are sorted in one
aggregate. The sample only steers; the answer is exact whatever it proposes, and equal values (however many)
are settled by the count alone. Sketches, counts and sorted gaps are aggregates of single columns: no row is multiplied or joined.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomprep.functions.columns import collect_aggregates, run_jobs

# A gap of at most this many rows is sorted inside one aggregate buffer.
SORTED_ROWS = 100_000
SAMPLE_ROWS = 100_000
LARGEST_SAMPLE = 5_000_000


# Quantiles of the sample that cuts are chosen from.
GRID = 1_000
# Rows that the sorted gaps of one job hold together.
ROWS_A_JOB = 500_000


@dataclass(frozen=True)
class Gap:
    """Open interval of a column's values holding ``size`` rows, with ``below`` rows at or under its lower end."""

    column: int
    low: float | None
    high: float | None
    below: int
    size: int
    ranks: tuple[int, ...]


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probabilities: Sequence[float],
    counts: Mapping[str, int] | None = None,
    sorted_rows: int = SORTED_ROWS,
) -> dict[str, list[float | None]]:
    """Quantiles of each DOUBLE expression, in the order of ``probabilities``; NULLs are left out."""
    names = list(columns)
    if counts is None:
        counts = collect_aggregates(df, {n: F.count(columns[n]) for n in names})
    out: dict[str, list[float | None]] = {n: [None] * len(probabilities) for n in names}

    present = [n for n in names if counts[n]]
    sizes = [int(counts[n]) for n in present]
    out.update(_quantiles(df, {n: columns[n] for n in present}, sizes, probabilities, sorted_rows))
    return out


def approximate_quantiles(
    df: DataFrame, columns: Mapping[str, Column], probabilities: Sequence[float], accuracy: int = 10_000
) -> dict[str, list[float | None]]:
    """Opt-in sketch: rank error at most 1/accuracy of the rows, one pass."""
    ps = F.array(*[F.lit(float(p)) for p in probabilities])
    got = collect_aggregates(df, {n: F.percentile_approx(e, ps, accuracy) for n, e in columns.items()})
    return {n: list(v) if v is not None else [None] * len(probabilities) for n, v in got.items()}


def _quantiles(
    df: DataFrame, columns: Mapping[str, Column], sizes: Sequence[int], probabilities: Sequence[float], sorted_rows: int
) -> dict[str, list[float | None]]:
    values = df.select([e.alias(f"v{i}") for i, e in enumerate(columns.values())])
    positions = [[p * (n - 1) for p in probabilities] for n in sizes]
    wanted = [sorted({r for x in xs for r in (math.floor(x), min(math.ceil(x), n - 1))}) for xs, n in zip(positions, sizes)]
    found = _order_statistics(values, [Gap(c, None, None, 0, n, tuple(r)) for c, (n, r) in enumerate(zip(sizes, wanted))], sorted_rows)
    out = {}
    for c, name in enumerate(columns):
        line: list[float | None] = []
        for x in positions[c]:
            low, high = found[(c, math.floor(x))], found[(c, min(math.ceil(x), sizes[c] - 1))]
            share = x - math.floor(x)
            line.append(low if low == high or share == 0 else low + (high - low) * share)
        out[name] = line
    return out


def _order_statistics(values: DataFrame, gaps: Sequence[Gap], sorted_rows: int) -> dict[tuple[int, int], float]:
    """Value at each (column, 0-based rank) among the present values."""
    found: dict[tuple[int, int], float] = {}
    unlucky: set[Gap] = set()  # gaps of which the sample had no row
    round_number = 0
    while wide := [g for g in gaps if g.size > sorted_rows]:
        round_number += 1
        shares = [1.0 if g in unlucky else min(1.0, min(max(SAMPLE_ROWS, g.size // 1000), LARGEST_SAMPLE) / g.size) for g in wide]
        proposed = _sampled_grid(values, wide, shares, round_number)
        cuts = [_cuts(g, proposed[i], shares[i]) for i, g in enumerate(wide)]
        narrowed = [g for g in gaps if g.size <= sorted_rows]
        for g, counts in zip(wide, _counted(values, wide, cuts)):
            parts = _narrow(g, counts, found)
            narrowed += parts
            unlucky |= {p for p in parts if p == g}
        gaps = narrowed
    if gaps:
        found.update(_sorted_values(values, gaps))
    return found


def _inside(gap: Gap) -> Column:
    """Value of a gap's column where it lies in the gap, else NULL."""
    v = F.col(f"v{gap.column}")
    if gap.low is None and gap.high is None:
        return v
    above = F.lit(True) if gap.low is None else v > gap.low
    under = F.lit(True) if gap.high is None else v < gap.high
    return F.when(above & under, v)


def _sampled_grid(values: DataFrame, gaps: Sequence[Gap], shares: Sequence[float], seed: int) -> list[Sequence[float] | None]:
    """Evenly spaced quantiles of a sample of every gap that the sample has rows of: sketches that tasks merge."""
    drawn = values.withColumn("drawn", F.rand(seed))
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    picked = {i: _inside(g) if s >= 1 else F.when(F.col("drawn") < s, _inside(g)) for i, (g, s) in enumerate(zip(gaps, shares))}
    got = collect_aggregates(drawn, {i: F.percentile_approx(v, grid, 10 * GRID) for i, v in picked.items()})
    return [got[i] for i in range(len(gaps))]


def _cuts(gap: Gap, grid: Sequence[float] | None, share: float) -> list[float]:
    """Two sampled values around each wanted rank, two deviations of the sampling error apart from it."""
    if not grid:
        return []
    error = max(2.0 / math.sqrt(max(1.0, share * gap.size)), 1e-6)
    picked = set()
    for r in gap.ranks:
        position = (r - gap.below) / gap.size
        picked |= {grid[max(0, math.floor((position - error) * GRID))], grid[min(GRID, math.ceil((position + error) * GRID))]}
    return sorted(picked)


def _counted(values: DataFrame, gaps: Sequence[Gap], cuts: Sequence[Sequence[float]]) -> list[dict[tuple[float | None, float | None, bool], int]]:
    """Rows of every gap between its cuts and at them, by (low, high, at the cut): counts that each task makes for itself."""
    exprs = {}
    for i, (g, own) in enumerate(zip(gaps, cuts)):
        for c in own:
            exprs[(i, c, "under")] = F.count_if(_inside(g) < c)
            exprs[(i, c, "up to")] = F.count_if(_inside(g) <= c)
    got = collect_aggregates(values, exprs) if exprs else {}
    out = []
    for i, (g, own) in enumerate(zip(gaps, cuts)):
        cells: dict[tuple[float | None, float | None, bool], int] = {}
        low, passed = g.low, 0
        for c in own:
            cells[(low, c, False)] = got[(i, c, "under")] - passed
            cells[(c, c, True)] = got[(i, c, "up to")] - got[(i, c, "under")]
            low, passed = c, got[(i, c, "up to")]
        cells[(low, g.high, False)] = g.size - passed
        out.append(cells)
    return out


def _sorted_values(values: DataFrame, gaps: Sequence[Gap]) -> dict[tuple[int, int], float]:
    """The wanted ranks of small gaps, each sorted in one aggregate; a job takes gaps of a bounded number of rows."""
    groups: list[list[Gap]] = []
    for g in gaps:
        if not groups or sum(x.size for x in groups[-1]) + g.size > ROWS_A_JOB:
            groups.append([])
        groups[-1].append(g)

    def job(part: Sequence[Gap]):
        def run() -> dict[tuple[int, int], float]:
            listed = values.agg(*[F.sort_array(F.collect_list(_inside(g))).alias(f"g{i}") for i, g in enumerate(part)])
            picked = [F.get(f"g{i}", F.lit(r - g.below)) for i, g in enumerate(part) for r in g.ranks]
            keys = [(g.column, r) for g in part for r in g.ranks]
            return dict(zip(keys, listed.select(*[p.alias(f"p{i}") for i, p in enumerate(picked)]).first()))

        return run

    return {k: v for found in run_jobs([job(part) for part in groups]) for k, v in found.items()}


def _narrow(gap: Gap, counts: Mapping[tuple[float | None, float | None, bool], int], found: dict[tuple[int, int], float]) -> list[Gap]:
    """Settle the ranks that fall on a cut; give the others the gap between cuts they fall in."""
    cuts = sorted(low for low, _, point in counts if point)
    ends = [gap.low, *cuts, gap.high]
    inner: dict[tuple[float | None, float | None, int, int], list[int]] = {}
    below, waiting = gap.below, list(gap.ranks)
    for low, high in zip(ends, ends[1:]):
        size = counts[(low, high, False)]
        for r in [r for r in waiting if r < below + size]:
            inner.setdefault((low, high, below, size), []).append(r)
        below += size
        waiting = [r for r in waiting if r >= below]
        if high is not None and high in cuts:
            at = counts[(high, high, True)]
            found.update({(gap.column, r): high for r in waiting if r < below + at})
            below += at
            waiting = [r for r in waiting if r >= below]
    return [Gap(gap.column, low, high, start, size, tuple(rs)) for (low, high, start, size), rs in inner.items()]
