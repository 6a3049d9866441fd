"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of bounded size, and a block is broadcast. Every pass scores all candidates against the block
and keeps only counts: each task builds one histogram per query over the interval that still holds the k-th score. The
summed histograms show which bin holds it, and the next pass refines that bin, until it is one value. A last pass filters
on that value. A task reports only bins from its own k-th score upwards, since the global k-th cannot lie below it, so
what is shuffled is at most k rows per query and task, whatever the number of equal vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomprep.session import scratch_path

BINS = 1024
BLOCK_BYTES = 16 << 20  # of broadcast query vectors
BLOCK_QUERIES = 2048  # bounds a task's histograms: queries x BINS counts
ROWS_AT_ONCE = 1024  # candidates per score matrix
EXACT_FLOAT = 2.0**53


def matrix(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of whole numbers, held as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).reshape(len(column), dim)


class Block:
    """A block of queries with the interval [low, low + width), cut into bins, that holds each one's k-th score."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, bound: float, scale: int):
        self.ids, self.k, self.scale = ids, k, scale
        self.exact = np.float64 if bound < EXACT_FLOAT else np.int64
        self.rows = rows.astype(self.exact)
        self.low = np.full(len(ids), -int(bound) - 1, np.int64)
        self.width = 2 * int(bound) + 3
        self.step = -(-self.width // BINS)
        self.need = np.full(len(ids), k, np.int64)

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(candidate ids, whole scores, mask of the pairs that count), some candidates at a time."""
        dim = self.rows.shape[1]
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            ids = part.column(0).to_numpy()
            found = (self.rows @ matrix(part.column(1), dim, self.scale).astype(self.exact).T).astype(np.int64)
            yield ids, found, ids[None, :] != self.ids[:, None]

    def histograms(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(self.ids) * BINS, np.int64)
        first = np.arange(len(self.ids))[:, None] * BINS
        for batch in batches:
            for _, found, counts_in in self.scores(batch):
                above = found - self.low[:, None]
                inside = counts_in & (above >= 0) & (above < self.width)
                counts += np.bincount((above // self.step + first)[inside], minlength=len(counts))
        downward = counts.reshape(-1, BINS)[:, ::-1]
        before = np.cumsum(downward, axis=1) - downward
        query, place = np.nonzero((downward > 0) & (before < self.need[:, None]))
        columns = [pa.array(query), pa.array(BINS - 1 - place), pa.array(downward[query, place]), pa.array(self.need[query])]
        yield pa.RecordBatch.from_arrays(columns, names=["query", "bin", "n", "need"])

    def winners(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's own first k of what reaches the k-th score."""
        kept = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            for ids, found, counts_in in self.scores(batch):
                query, place = np.nonzero(counts_in & (found >= self.low[:, None]))
                if len(query):
                    new = (query, found[query, place], ids[place])
                    kept = self.first_k([np.concatenate(x) for x in zip(kept, new, strict=True)])
        query, score, ids = kept
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[query]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    def first_k(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        query, score, ids = rows
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        start = np.searchsorted(query, query, "left")
        keep = np.arange(len(query)) - start < self.k
        return [query[keep], score[keep], ids[keep]]


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by the inner product of floor(scale * x).

    Every row but those with the query's own id is a candidate; ties go to the smaller id. Rows take no part when the id
    or the vector is null or a component is null or not finite; a query meets only vectors of its own length. Candidate
    rows that repeat an id each count; of query rows that repeat an id, the smallest vector asks. No query, or no
    candidate, gives no rows. A score that does not fit a long raises.
    """
    spark = vectors.sparkSession
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    use = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad
    slim = vectors.where(use).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), is_query.alias("asks")
    )
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x.cast("double") * scale), F.lit(2)))
    facts = slim.groupBy(F.size("v").alias("dim")).agg(
        F.count_if("asks").alias("n"), F.max(length).alias("longest"), F.max(F.when(F.col("asks"), length)).alias("asked")
    )
    target = scratch_path(spark, "top-k")
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    spark.createDataFrame([], schema).write.parquet(target)
    for dim, n, longest, asked in sorted(map(tuple, facts.where("n > 0").collect())):
        bound = (longest * asked) ** 0.5 + 1
        if bound >= 2.0**62:
            raise ValueError("a score of these vectors does not fit a long")
        own = slim.where(F.size("v") == dim)
        size = max(1, min(block_queries, BLOCK_BYTES // (8 * max(dim, 1))))
        blocks = -(-n // size)
        queries = own.where("asks").groupBy("id").agg(F.min("v").alias("v"))
        for number in range(blocks):
            part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).orderBy("id").toArrow()
            if part.num_rows:
                rows = matrix(part.column("v").combine_chunks(), dim, scale)
                block = Block(part.column("id").to_numpy(), rows, k, bound, scale)
                searched(own.select("id", "v"), block, k).write.mode("append").parquet(target)
    return spark.read.schema(schema).parquet(target)


def searched(candidates: DataFrame, block: Block, k: int) -> DataFrame:
    spark = candidates.sparkSession
    while True:
        shared = spark.sparkContext.broadcast(block)
        parts = candidates.mapInArrow(lambda it, s=shared: s.value.histograms(it), "query bigint, bin bigint, n bigint, need bigint")
        summed = parts.groupBy("query", "bin", "need").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query").orderBy(F.desc("bin"))
        reached = summed.withColumn("upto", F.sum("n").over(down))
        held = reached.where("upto - n < need and upto >= need").select("query", "bin", F.expr("need - (upto - n)").alias("need"))
        rows = held.collect()  # a row per query of the block
        query, place, need = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        block.low[query] += place * block.step
        block.need[query] = need
        # A query with fewer than k candidates stays at its lower end: all of them win.
        if block.step == 1 or not rows:
            break
        block.width, block.step = block.step, -(-block.step // BINS)
    shared = spark.sparkContext.broadcast(block)
    best = candidates.mapInArrow(lambda it, s=shared: s.value.winners(it), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
