"""Importance resampling towards a target distribution of hashed word n-grams.

A document's weight is the mean gain of its features: how much likelier a feature's bucket is in the target texts than in
the raw ones. Adding Gumbel noise to the weights and keeping the highest scores draws documents without replacement in
proportion to their importance.

Features are found by batch concatenation: the texts of a batch are joined with separators, one regex pass finds all words,
and a binary search of the word starts in the texts' offsets tells whose they are, so that n-grams over a border are masked
out before the counting. What the driver holds is one number per bucket.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomprep.llm.common import scanned, written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # in lower-cased UTF-8: all but ASCII that is neither digit nor letter
IN_WORD = np.array([WORD.fullmatch(bytes([b])) is not None for b in range(256)])
SEPARATOR = b"\n"
JOINED_AT_ONCE = 1 << 22  # bytes of texts that are joined; a longer text goes through in runs of words
WORDS_AT_ONCE = 1 << 18
KNOWN = 1 << 18  # words whose checksum a task remembers


class Checksums(dict):
    """CRC-32 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        made = zlib.crc32(word)
        if len(word) <= 64:
            self[word] = made
        return made


def features(words: list[bytes], owner: np.ndarray, longest: int, buckets: int, known: Checksums) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, owners) of all runs of 1 to ``longest`` consecutive words of one owner; ``owner`` has one entry a word."""
    sums = list(map(known.__getitem__, words))
    for n in range(1, longest + 1):
        if n > 1:
            sums = [zlib.crc32(b" " + word, before) for before, word in zip(sums, words[n - 1 :], strict=False)]
        if not sums:
            return
        inside = owner[: len(sums)] == owner[n - 1 :]
        yield np.array(sums, np.int64)[inside] % buckets, owner[: len(sums)][inside]


def featured(texts: list[bytes], longest: int, buckets: int, known: Checksums) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(buckets, owners, owners of the words or None) of runs of the texts; an owner is a place in the list."""
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (size := size + len(texts[high]) + 1) <= JOINED_AT_ONCE:
            high += 1
        if high > low:
            joined = SEPARATOR.join(texts[low:high]).lower()
            offsets = np.cumsum([0, *(len(t) + 1 for t in texts[low : high - 1])])
            words = WORD.findall(joined)
            inside = IN_WORD[np.frombuffer(joined, np.uint8)]
            starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
            owner = np.searchsorted(offsets, starts, "right") - 1 + low
            for i, (codes, owners) in enumerate(features(words, owner, longest, buckets, known)):
                yield codes, owners, owners if i == 0 else None
            low = high
        else:
            found, last = (m.group() for m in WORD.finditer(texts[low].lower())), []
            while run := list(islice(found, WORDS_AT_ONCE)):
                # The words carried over start no new runs that end among themselves.
                words = last + run
                owner = np.full(len(words), low, np.int64)
                for i, (codes, owners) in enumerate(features(words, owner, longest, buckets, known)):
                    fresh = max(0, len(last) - i)
                    yield codes[fresh:], owners[fresh:], owners[fresh:] if i == 0 else None
                last = words[-(longest - 1) :] if longest > 1 else []
            low += 1


def bytes_of(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def bucket_counts(texts: DataFrame, text: Column, longest: int, buckets: int) -> DataFrame:
    """(bucket, n) over all texts, buckets without a feature left out; nulls count as texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), Checksums()
        for batch in batches:
            for codes, _, _ in featured(bytes_of(batch.column(0)), longest, buckets, known):
                total += np.bincount(codes, minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], names=["bucket", "n"])

    counted = texts.select(text.alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Per bucket floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), in doubles."""
    spark = raw.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket")
    for name, counts in (("s", raw), ("t", target)):
        both = both.join(counts.withColumnRenamed("n", name), "bucket", "left").fillna(0, [name])
    rows = both.select("bucket", "s", "t").collect()  # one row per bucket
    number = {c: F.col(c).cast("double") for c in ("s", "t")}
    for c in ("s", "t"):
        number[f"all_{c}"] = F.lit(float(sum(r[c] for r in rows)))
    ratio = (number["t"] + 1) * (number["all_s"] + buckets) / ((number["s"] + 1) * (number["all_t"] + buckets))
    gains = spark.createDataFrame(rows, "bucket bigint, s bigint, t bigint")
    return [r["gain"] for r in gains.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()]


def weights(docs: DataFrame, gains: list[int], id_col: str, text_col: str, longest: int) -> DataFrame:
    """(id, n_words, n_features, weight) for every row; weight is the floored mean gain, 0 without features."""
    buckets = len(gains)
    shared = docs.sparkSession.sparkContext.broadcast(np.array(gains, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gain = Checksums(), shared.value
        for batch in batches:
            rows = batch.num_rows
            n_words, n_features, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for codes, owners, first in featured(bytes_of(batch.column(1)), longest, buckets, known):
                if first is not None:
                    n_words += np.bincount(first, minlength=rows)
                n_features += np.bincount(owners, minlength=rows)
                if len(owners):
                    edges = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
                    total[owners[edges]] += np.add.reduceat(gain[codes], edges)  # owners ascend
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], names=["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    longest: int = 1,
    buckets: int = 10_000,
    per_cent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """(id, n_features, weight, score, rank) for every row of ``docs``; rank counts the drawn rows from 1, null: not drawn.

    Of the rows with at least ``least_words`` words, ``per_cent`` in a hundred (rounded down) with the highest scores are
    drawn, ties to the smaller id, nulls last. Texts that are null or have no word have weight 0. Repeated rows are rows of
    their own, with equal scores and ranks one after the other. A null id draws its noise as the empty string. An empty
    ``docs`` gives an empty table, an empty ``target`` gains that are all due to the smoothing. Other columns are left out.
    """
    raw = bucket_counts(docs, F.col(text_col), longest, buckets)
    wanted = bucket_counts(target, F.col(target_col), longest, buckets)
    rows = weights(docs, bucket_gains(raw, wanted, buckets), id_col, text_col, longest)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = written(rows.withColumn("score", F.col("weight") + noise), "resample-scores")
    long_enough = F.col("n_words") >= least_words
    drawn = rows.where(long_enough).count() * per_cent // 100
    placed = scanned(rows, [long_enough.desc(), F.desc("score"), F.asc_nulls_last("id")], label="resample-ranks")
    rank = F.when(F.col("number") <= drawn, F.col("number"))
    return placed.select("id", "n_features", "weight", "score", rank.alias("rank"))
