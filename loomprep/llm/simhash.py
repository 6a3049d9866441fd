"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits; bit i is set when it is set in more than half of the XXH64 hashes of the text's word shingles.
Two fingerprints that differ in at most k bits differ, in one of m segments, by at most a known radius. Each distinct
fingerprint therefore enters a table once per segment, looks up the small Hamming ball around its own segments there, and
every match is verified over all 64 bits. Links exist between distinct fingerprints only: copies share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loomprep.llm.common import components, written

SEED = 42  # of the shingle hash
BITS = 64
SHINGLES_AT_ONCE = 1 << 16  # bounds the unpacked bits of a very long text


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned 64-bit fingerprint of a text: A-Z lower-cased, words cut at ASCII white space; no word: zero."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]).tolist()
    starts = [0, *ends]
    last = max(1, len(found) - words + 1)
    hashed = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for low in range(0, last, SHINGLES_AT_ONCE):
        part = range(low, min(last, low + SHINGLES_AT_ONCE))
        values = [hashed(line[starts[i] : ends[min(i + words, len(found)) - 1] - 1], SEED) for i in part]
        octets = np.array(values, "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.add.reduce(np.unpackbits(octets, axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > last, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp) for every row: fp is the fingerprint as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            values = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {kind}, fp bigint")


def segments(distance: int, parts: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) per segment, so that a pair within ``distance`` agrees within the radius in one of them.

    distance = parts * q + r: were the first r + 1 segments over q and the others over q - 1, the sum would exceed it.
    """
    parts = min(parts, distance + 1)
    q, r = divmod(distance, parts)
    radii = [q] * (r + 1) + [q - 1] * (parts - r - 1)
    base, more = divmod(BITS, parts)
    widths = [base + (i < more) for i in range(parts)]
    return [(sum(widths[:i]), w, x) for i, (w, x) in enumerate(zip(widths, radii, strict=True))]


def signed(bits: int) -> int:
    """64 bits as Spark's long."""
    return bits - (1 << 64) if bits >> 63 else bits


def near_pairs(distinct: DataFrame, distance: int = 4, parts: int = 3) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct longs ``fp`` that differ in 1 to ``distance`` bits."""

    def slot(number: int, key: Column) -> Column:
        return F.struct(F.lit(number).alias("seg"), key.alias("key"))

    def ball(number: int, part: Column, width: int, radius: int) -> Column:
        flips = [signed(sum(1 << b for b in bits)) for n in range(radius + 1) for bits in combinations(range(width), n)]
        return F.transform(F.lit(flips).cast("array<bigint>"), lambda flip: slot(number, part.bitwiseXOR(flip)))

    entries, probes = [], []
    for number, (shift, width, radius) in enumerate(segments(distance, parts)):
        part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(signed((1 << width) - 1)).cast("bigint"))
        entries.append(slot(number, part))
        probes.append(ball(number, part, width, radius))
    index = distinct.select(F.explode(F.array(*entries)).alias("e"), F.col("fp").alias("b")).select("e.*", "b")
    asked = distinct.select(F.explode(F.flatten(F.array(*probes))).alias("e"), F.col("fp").alias("a")).select("e.*", "a")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return asked.join(index, ["seg", "key"]).where(close).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, parts: int = 3
) -> DataFrame:
    """(id, fp, component) for every row: component is the smallest id reachable over links, the own included.

    Rows with a null id get a fingerprint but a null component and link nothing. Repeated rows and equal texts share one
    fingerprint and so one component; texts without words share fingerprint zero. An empty table gives an empty table.
    """
    marked = written(fingerprints(docs, id_col, text_col, words), "simhash")
    classes = written(marked.where("id is not null").groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    links = near_pairs(classes.select("fp"), distance, parts)
    roots = components(links, "simhash-links")
    tops = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    tops = written(tops, "simhash-tops")
    least = tops.groupBy("root").agg(F.min("least").alias("component"))
    named = written(tops.join(least, "root").select("fp", "component"), "simhash-named")
    known = marked.join(named, "fp", "left")
    return known.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
