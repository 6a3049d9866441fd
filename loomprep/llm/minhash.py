"""Near copies by the Jaccard similarity of word shingles: SimHash fingerprints (as in op9) and MinHash bands propose pairs,
the whole shingle sets decide.

Fingerprints that are equal or differ in few bits propose one pair each, and every set one with the smallest of its
fingerprint. At 0.8 most pairs differ in more bits than that; those come through the bands.

A text's set holds the XXH64 hashes of its shingles. Texts with equal sets are one node. Every node enters BANDS buckets,
each keyed by ROWS minimum hashes: two sets of similarity s share one with chance 1 - (1 - s^ROWS)^BANDS, 0.99993 at 0.8.
A small bucket proposes all its pairs. In a larger one all are compared with one member, which joins a large group of near
copies without making its square; members left in different components are compared with other members in further rounds
until a round links no more than a hundredth of its pairs. What large buckets then still hold apart is settled by an exact join: two sets of the asked
similarity share one of their rarest shingles, and early enough in the order from rare to frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loomprep.llm.common import components, given_back, no_table, sieve, sifted, written
from loomprep.llm.simhash import fingerprint, near_pairs

SEED = 42
ROWS, BANDS = 5, 24
SMALL = 16  # nodes of a bucket whose pairs are all compared
AT_ONCE = 1 << 12  # bounds the hashes of a very long text
_draw = np.random.default_rng(SEED)
FACTORS = _draw.integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _draw.integers(0, 1 << 63, ROWS * BANDS, np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles: A-Z lower-cased, words cut at ASCII white space; no word: an empty set."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]).tolist()
    starts = [0, *ends]
    last = max(1, len(found) - words + 1)
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(line[starts[i] : ends[min(i + words, len(found)) - 1] - 1], SEED) for i in range(last)), np.uint64, last))


def bands(own: np.ndarray) -> np.ndarray:
    """Keys of the buckets of a set; an empty set has none."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(own), AT_ONCE):
        least = np.minimum(least, (own[low : low + AT_ONCE, None] * FACTORS + SHIFTS).min(axis=0))
    parts = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(parts)], np.uint64).view(np.int64)


def marked_rows(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """All columns but the text, with ``node``, the number of the set, ``fp``, the text's fingerprint, and ``keys`` of its
    buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table()
        for batch in batches:
            nodes, keys, prints = [], [], []
            for text in batch.column(text_col):
                own = shingles(text.as_py(), words)
                prints.append(fingerprint(text.as_py(), words))
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                keys.append(bands(own))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            rest = batch.drop_columns([text_col])
            made = [*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)), lists]
            yield pa.RecordBatch.from_arrays([*rest.columns, *made], names=[*rest.schema.names, "node", "fp", "keys"])
        given_back()

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col)
    return docs.mapInArrow(run, f"{rest}, node bigint, fp bigint, keys array<bigint>")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, own) of (node, text): the hashes themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sets = [shingles(t.as_py(), words).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "own"])
        given_back()

    return texts.select("node", "text").mapInArrow(run, "node bigint, own array<bigint>")


def row_keys(columns: list[str]) -> list[Column]:
    """128 bits of a row's whole content; a null differs from any value and from a null in another column."""
    content = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*content).alias("_k1"), F.xxhash64(F.lit("second"), *content).alias("_k2")]


def similar(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least ``tenths`` tenths."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b")
    small, large = F.least(F.size("own_a"), F.size("own_b")), F.greatest(F.size("own_a"), F.size("own_b"))
    both = both.where(10 * small >= tenths * large)
    shared = both.select("a", "b", F.size(F.array_intersect("own_a", "own_b")).alias("n"), (F.size("own_a") + F.size("own_b")).alias("total"))
    return shared.where(10 * F.col("n") >= tenths * (F.col("total") - F.col("n"))).select("a", "b")


def held(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """The sets of all nodes in ``asked`` (one or more columns of nodes), and few others."""
    nodes = asked.select(F.explode(F.array(*asked.columns)).alias("node"))
    return sifted(sets, "node", sieve(nodes, "minhash-sieve")).where("maybe").select("node", "own")


def early_matches(apart: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """The pairs (a, b) of nodes with different roots of ``apart`` (node, root) that may have a similarity of ``tenths``
    tenths; none that has is left out. A pair comes through a shingle that both hold, where so few stand before it in both
    orders that enough can still be shared. Only pairs close to the asked similarity pass, but those all do."""
    own = apart.join(sets, "node").select("node", "root", F.size("own").alias("n"), F.explode("own").alias("h"))
    often = own.groupBy("h").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    order = F.array_sort(F.collect_list(F.struct("often", "h"))).alias("order")
    listed = own.join(often, "h").groupBy("node", "root", "n").agg(order)
    # Shingles that only one set holds stand first.
    placed = listed.select("node", "root", "n", F.size("order").alias("shared"), F.posexplode("order").alias("place", "one"))
    placed = placed.select("node", "root", "n", (F.col("n") - F.col("shared") + F.col("place")).alias("before"), F.col("one.h").alias("h"))
    early = written(placed.where(10 * (F.col("n") - F.col("before")) >= tenths * F.col("n")), "minhash-early")
    sides = [early.select("h", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "n", "before")]) for side in "ab"]
    both = sides[0].join(sides[1], "h").where("node_a < node_b AND root_a != root_b")
    left = F.least(F.col("n_a") - F.col("before_a"), F.col("n_b") - F.col("before_b"))
    enough = both.where((10 + tenths) * left >= tenths * (F.col("n_a") + F.col("n_b")))
    return enough.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def close_prints(marked: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of nodes of ``marked`` (node, fp) that SimHash proposes; a row per node and per pair of prints."""
    nodes = marked.select("fp", "node").distinct()
    least = written(nodes.groupBy("fp").agg(F.min("node").alias("least")), "minhash-prints")
    same = nodes.join(least, "fp").select(F.col("node").alias("x"), F.col("least").alias("y"))
    sides = [least.select(F.col("fp").alias(p), F.col("least").alias(x)) for p, x in (("a", "x"), ("b", "y"))]
    close = near_pairs(least.select("fp")).join(sides[0], "a").join(sides[1], "b").select("x", "y")
    return same.unionByName(close).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def joined(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """(node, root) of all nodes with a link, from those before (none: no link yet) and the links ``found`` (a, b). Links are
    drawn between roots, so that a round works on what it has found and not on all links again."""
    if roots is None:
        return written(components(found, "minhash-components"), "minhash-roots")
    sides = [roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab"]
    ends = found.join(sides[0], "a", "left").join(sides[1], "b", "left")
    tops = components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")), "minhash-components")
    tops = written(tops, "minhash-tops")
    raised = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    fresh = tops.join(roots, "node", "left_anti").select("node", "root")
    return written(raised.select("node", F.coalesce("top", "root").alias("root")).unionByName(fresh), "minhash-roots")


def near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 5, tenths: int = 8) -> DataFrame:
    """(_k1, _k2, id, component) for every row; ``_k1`` and ``_k2`` are the row's ``row_keys``. Rows share a component when a
    chain of texts of similarity ``tenths`` tenths or more joins them, whatever their ids; texts without words are one."""
    keyed = docs.select(*row_keys(docs.columns), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = written(marked_rows(keyed, "text", words), "minhash")
    entries = written(marked.select("node", F.explode("keys").alias("key")).distinct(), "minhash-entries")
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = written(entries.join(sizes, "key"), "minhash-shared")
    proposed = written(close_prints(marked), "minhash-proposed")
    asked_for = shared.select("node").union(proposed.select("a")).union(proposed.select("b")).distinct()
    chosen = marked.join(asked_for, "node", "left_semi").groupBy("node").agg(F.min(F.struct("_k1", "_k2")).alias("row"))
    chosen = written(chosen.select("node", "row.*"), "minhash-chosen")
    picked = sifted(keyed.select("_k1", "_k2", "text"), "_k1", sieve(chosen.select("_k1"), "minhash-sieve")).where("maybe")
    texts = picked.join(chosen, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    sets = written(shingle_sets(texts, words), "minhash-sets")
    small, large = shared.where(f"size <= {SMALL}"), written(shared.where(f"size > {SMALL}"), "minhash-large")
    pairs = small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
    pairs = pairs.unionByName(proposed)
    some_large = not large.isEmpty()
    roots, tried, turn, n_asked, n_found = None, None, 0, 0, 0
    while turn == 0 or some_large:
        # One member of every large bucket that still holds several components is compared with those of the others.
        placed = large.select("key", "node", F.col("node").alias("root"))
        if roots is not None:
            placed = large.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
            placed = written(placed, "minhash-placed")
        heads = placed.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "root")).alias("head"), F.min("root").alias("low"), F.max("root").alias("high"))
        heads = heads.where("low < high").select("key", "head")
        if turn and 100 * n_found <= n_asked:
            break
        asked = placed.join(heads, "key").where(F.col("root") != F.col("head.root"))
        asked = asked.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"))
        asked = (asked.unionByName(pairs) if turn == 0 else asked).distinct()
        if tried is not None:
            asked = asked.join(tried, ["a", "b"], "left_anti")
        asked = written(asked, "minhash-asked")
        found = written(similar(asked, sets if turn == 0 else held(sets, asked), tenths), "minhash-links")
        n_asked, n_found = asked.count(), found.count()
        roots = joined(roots, found)
        tried = asked if tried is None else tried.unionByName(asked)
        turn += 1
    if some_large:
        apart = written(placed.join(heads.select("key"), "key", "left_semi").select("node", "root").distinct(), "minhash-apart")
        asked = written(early_matches(apart, held(sets, apart.select("node")), tenths).join(tried, ["a", "b"], "left_anti"), "minhash-asked")
        found = written(similar(asked, held(sets, asked), tenths), "minhash-links")
        if not found.isEmpty():
            roots = joined(roots, found)
    named = marked.select("_k1", "_k2", "id", "node").join(roots, "node", "left")
    return named.select("_k1", "_k2", "id", F.coalesce("root", "node").alias("component"))
