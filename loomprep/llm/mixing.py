"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. A small network routes the words of
the patterns to the quotas of the sources: each further repetition of a pattern's words costs one more, so words are
repeated only where fresh ones cannot fill a quota. The network has one node per pattern and source and is solved on the
driver; documents are then chosen in a seeded order by cumulative size, which three rounds of counting find without
sorting a source.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomprep.llm.common import written

REPEATS = 3  # most times a document is taken
WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 3  # hex digits of the seeded order per round of counting: 4,096 cells per pattern


def water_fill(weights: dict[str | None, float], sizes: dict[str | None, int], repeats: int = REPEATS) -> dict[str | None, float]:
    """Targets that share the sum of sizes by weight; none above ``repeats`` times its size, the excess shared anew."""
    order = sorted(weights, key=lambda s: (repeats * sizes[s] / weights[s], s is None, s or ""))
    left, heavy, targets = float(sum(sizes.values())), float(sum(weights.values())), {}
    for place, source in enumerate(order):
        level = left / heavy
        if level * weights[source] <= repeats * sizes[source]:
            targets |= {s: level * weights[s] for s in order[place:]}
            break
        targets[source] = float(repeats * sizes[source])
        left -= targets[source]
        heavy -= weights[source]
    return targets


def route(capacity: dict[tuple, int], quota: dict[str | None, int], repeats: int = REPEATS) -> dict[tuple, dict[str | None, int]]:
    """Words that each pattern sends to each of its sources: quotas filled as far as capacities allow, least repetition.

    Successive shortest paths. The cost of a path is that of the last pattern it draws on (the number of times its words
    are already used), so patterns are tried by layer of repetition and each layer is a maximum flow by augmenting paths.
    """
    sent: dict[tuple, dict[str | None, int]] = {p: dict.fromkeys(p, 0) for p in capacity}
    users: dict[str | None, list[tuple]] = defaultdict(list)
    for p in capacity:
        for s in p:
            users[s].append(p)
    left = dict(quota)
    for layer in range(1, repeats + 1):
        for source in quota:
            while left[source] > 0:
                # From the quota back to a pattern with room in this layer, over words another source could release.
                seen, queue, found = {source: None}, [source], None
                for s in queue:
                    for p in users[s]:
                        room = layer * capacity[p] - sum(sent[p].values())
                        if room > 0:
                            found = (s, p, room)
                            break
                        for other in p:
                            if other not in seen and sent[p][other] > 0:
                                seen[other] = (s, p)
                                queue.append(other)
                    if found:
                        break
                if not found:
                    break
                s, p, room = found
                steps, amount, at = [], min(left[source], room), s
                while seen[at] is not None:
                    back, via = seen[at]
                    steps.append((back, via, at))
                    amount = min(amount, sent[via][at])
                    at = back
                sent[p][s] += amount
                for back, via, at in steps:
                    sent[via][at] -= amount
                    sent[via][back] += amount
                left[source] -= amount
    return sent


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def mix(
    docs: DataFrame,
    sources: Column,
    size: Column | None = None,
    weights: dict[str | None, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    repeats: int = REPEATS,
    seed: str = "mix",
    carried: dict[str, str] | None = None,
) -> tuple[DataFrame, list[dict[str, object]]]:
    """(rows, sources): per row (id, sources, size, taken); per source its name, size, weight, target and routed words.

    ``sources`` is an array of the sources of a row; a null in it is a source of its own, and a null or empty array
    belongs to none and is not taken. Without ``weights`` the sources, by code point and null last, weigh 1, 2, 3 in
    turn. ``taken`` counts words with repetition and never exceeds ``repeats`` times the size; at most one row per
    pattern is taken in part, so a source gets its target to the word where its documents suffice. Rows without words
    take nothing. Repeated rows and null ids are rows like any other. An empty table gives no rows and no sources. The
    order depends on seed, id and size alone, so reruns agree. The driver holds a row per membership pattern.

    ``carried``, new names for size and taken, asks for the rows of ``docs`` with all their columns and these two; they are
    read again where they lie and not joined with the result.
    """
    counted = word_count(F.col(text_col)) if size is None else size
    own = F.sort_array(F.array_distinct(F.coalesce(sources.cast("array<string>"), F.array().cast("array<string>"))))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    pattern = F.to_json(own, {"ignoreNullFields": "false"})
    slim = [F.col(id_col).alias("id"), own.alias("sources"), pattern.alias("pattern"), counted.alias("size"), order.alias("seeded")]
    sized = written(docs.select(*slim), "mix-sized")
    totals = {tuple(json.loads(r["pattern"])): int(r["n"]) for r in sized.groupBy("pattern").agg(F.sum("size").alias("n")).collect()}
    names = sorted({s for p in totals for s in p}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(n for p, n in totals.items() if s in p) for s in names}
    weights = weights or {s: float(1 + i % 3) for i, s in enumerate(names)}
    targets = water_fill({s: weights[s] for s in names}, sizes, repeats)
    sent = route({p: n for p, n in totals.items() if p}, {s: int(targets[s]) for s in names}, repeats)
    report = [
        {"source": s, "size": sizes[s], "weight": weights[s], "target": targets[s], "routed": sum(x.get(s, 0) for x in sent.values())} for s in names
    ]
    plan = [(json.dumps(list(p), ensure_ascii=False, separators=(",", ":")), *divmod(sum(sent[p].values()), totals[p])) for p in sent if totals[p]]
    spark = docs.sparkSession
    routed = spark.createDataFrame(plan, "pattern string, base bigint, rest bigint")
    if carried is None:
        return chosen(sized, routed).select("id", "sources", "size", "taken"), report
    whole = docs.select(*slim, F.struct(*docs.columns).alias("row"))
    return chosen(sized, routed, whole).select("row.*", *(F.col(c).alias(name) for c, name in carried.items())), report


def cell(level: int) -> Column:
    return F.substring("seeded", 1 + DIGITS * level, DIGITS)


def boundary(rows: DataFrame, level: int, needs: DataFrame) -> DataFrame:
    """Per pattern the cell of this level in which the cumulative size reaches its ``need``, and what is left before it.

    Sizes are summed per cell before anything is brought together by pattern, which then has 4,096 rows at most.
    """
    name = f"cell{level}"
    summed = rows.groupBy("pattern", cell(level).alias(name)).agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("pattern").orderBy(name))
    reached = summed.join(needs, "pattern").withColumn("upto", upto).where("upto - n < need and upto >= need")
    return reached.select("pattern", name, F.expr("need - (upto - n)").alias("need"))


def chosen(sized: DataFrame, routed: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Rows with ``taken``: base times the size, and once more in the seeded order until the rest is used up. ``rows`` are
    those of ``sized`` with more columns, which are returned in their place and, but for the last cells, not moved."""
    celled = sized.withColumns({"cell0": cell(0), "cell1": cell(1)})
    returned = sized if rows is None else rows
    first = written(boundary(sized, 0, routed.selectExpr("pattern", "rest AS need")), "mix-first")
    inside = celled.join(first.select("pattern", "cell0"), ["pattern", "cell0"])
    second = boundary(inside, 1, first.select("pattern", "need"))
    ends = first.join(second.withColumnRenamed("need", "last_need"), "pattern").selectExpr("pattern", "cell0 AS end0", "cell1 AS end1", "last_need")
    plan = written(routed.join(ends, "pattern", "left"), "mix-plan")
    if rows is not None:
        celled, plan = rows.withColumns({"cell0": cell(0), "cell1": cell(1)}), F.broadcast(plan)
    base = F.coalesce("base", F.lit(0)) * F.col("size")
    placed = celled.join(plan, "pattern", "left")
    before = (F.col("cell0") < F.col("end0")) | ((F.col("cell0") == F.col("end0")) & (F.col("cell1") < F.col("end1")))
    at_end = F.coalesce((F.col("cell0") == F.col("end0")) & (F.col("cell1") == F.col("end1")), F.lit(False))
    whole = placed.where(~at_end).withColumn("taken", base + F.when(before, F.col("size")).otherwise(0))
    # The rows of the last cell of a pattern: about one of 16 million.
    last = plan.where("end0 is not null").selectExpr("pattern", "end0 AS cell0", "end1 AS cell1", "base", "last_need")
    order = Window.partitionBy("pattern").orderBy("seeded", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if rows is not None:
        last = F.broadcast(last)
    cut = celled.join(last, ["pattern", "cell0", "cell1"]).withColumn("upto", F.sum("size").over(order))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.expr("last_need - (upto - size)")))
    cut = cut.withColumn("taken", base + part)
    columns = [*returned.columns, "taken"]
    return whole.select(columns).unionByName(cut.select(columns))
