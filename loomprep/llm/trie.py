"""Prefix trie of conversations, its subtree figures by an Euler tour.

A node is a distinct sequence of first turns. Its key is the exclusive or of two 64-bit hashes of every turn together with
its place, so that keys come from one scan over all turns and no conversation is gathered. The trie is walked around by an
Euler tour: every node has an arc that enters it and one that exits it, and an arc's successor follows from its node's
first child, next sibling or parent. The tour is a linked list; ranking it distributedly gives the sums of the arcs'
weights before every arc, and a subtree's figures are the difference between the two arcs of its top.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomprep.llm.common import scanned, written

CORE = 4096  # arcs of the contracted list that the driver walks along
IDS_A_CHUNK = 1 << 14


def placed_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, role, text): the turns of a conversation numbered from 1 by turn (nulls first), then role and text. Null
    roles and texts are empty; rows without a conversation are left out."""
    named = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    ).where("conv is not null")
    rows = scanned(named, [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")], label="trie-turns")
    firsts = rows.groupBy("conv").agg((F.min("number") - 1).alias("before"))
    place = (F.col("number") - F.col("before")).alias("place")
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    return rows.join(firsts, "conv").select("conv", place, *empty)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, chars) of (conv, place, role, text): the keys of each turn's node and of its parent."""
    hashed = turns.select(
        "conv",
        F.col("place").cast("bigint").alias("place"),
        F.xxhash64("place", "role", "text").alias("h1"),
        F.xxhash64(F.lit("second"), "place", "role", "text").alias("h2"),
        F.char_length("text").cast("bigint").alias("chars"),
    )
    rows = scanned(hashed, [F.col("conv"), F.col("place")], ["h1", "h2"], "trie-keys")
    own = [F.col(f"h{i}_up_to").bitwiseXOR(F.col(f"h{i}")).alias(f"b{i}") for i in (1, 2)]
    firsts = rows.select("conv", "number", *own).groupBy("conv").agg(*(F.min_by(f"b{i}", "number").alias(f"b{i}") for i in (1, 2)))
    keys = [F.col(f"h{i}_up_to").bitwiseXOR(F.col(f"b{i}")).alias(f"k{i}") for i in (1, 2)]
    placed = rows.join(firsts, "conv").select("conv", F.col("place").alias("depth"), *keys, "h1", "h2", "chars")
    parents = [F.col(f"k{i}").bitwiseXOR(F.col(f"h{i}")).alias(f"p{i}") for i in (1, 2)]
    return placed.select("conv", "depth", "k1", "k2", *parents, "chars")


def list_sums(arcs: DataFrame, weights: Sequence[str], core: int = CORE) -> DataFrame:
    """(arc, <weights>) of the linked list ``arcs`` (arc, succ, <weights>): the sums over all arcs before each arc.

    In every round a coin per arc lets arcs with heads take over their successor if it shows tails; about a quarter of the
    list goes, in one exchange. When at most ``core`` arcs are left, they are walked along; the rounds are then undone from
    the last to the first, each giving the removed arcs their predecessor's sum and what lay between. The sizes fall
    geometrically, so that all rounds together cost a few times the first.
    """
    spark, rounds = arcs.sparkSession, []
    left = arcs.select("arc", "succ", *weights)
    rows = left.count()
    while rows > core:
        turn = len(rounds)

        def tails(arc: str, turn: int = turn) -> Column:
            return F.xxhash64(arc, F.lit(turn)).bitwiseAND(F.lit(1).cast("bigint")) == 1

        jumps = F.col("succ").isNotNull() & ~tails("arc") & tails("succ")
        none = F.lit(None).cast("bigint")
        own = left.select("arc", "succ", *weights, jumps.alias("jumps"), none.alias("u"), *(none.alias(f"u_{w}") for w in weights))
        taken = left.where(jumps).select(
            F.col("succ").alias("arc"), none.alias("succ"), *(none.alias(w) for w in weights), F.lit(False).alias("jumps"),
            F.col("arc").alias("u"), *(F.col(w).alias(f"u_{w}") for w in weights)
        )
        every = ["succ", *weights, "jumps", "u", *(f"u_{w}" for w in weights)]
        met = written(own.unionByName(taken).groupBy("arc").agg(*(F.max(c).alias(c) for c in every)), "trie-round")
        rounds.append(met.where("u is not null"))
        sums = [(F.col(w) + F.coalesce(F.col(f"u_{w}"), F.lit(0))).alias(w) for w in weights]
        left = met.where("u is not null or not jumps").select(F.coalesce("u", "arc").alias("arc"), "succ", *sums)
        rows = left.count()
    following = {r["arc"]: r for r in left.collect()}
    heads = following.keys() - {r["succ"] for r in following.values()}
    walked, sums = [], [0] * len(weights)
    at = min(heads, default=None)
    while at is not None:
        walked.append((at, *sums))
        sums = [s + following[at][w] for s, w in zip(sums, weights, strict=True)]
        at = following[at]["succ"]
    known = spark.createDataFrame(walked, ", ".join(f"{c} bigint" for c in ("arc", *weights)))
    for met in reversed(rounds):
        before = known.select(F.col("arc").alias("u"), *(F.col(w).alias(f"b_{w}") for w in weights))
        undone = met.join(before, "u").select("arc", *((F.col(f"b_{w}") + F.col(f"u_{w}")).alias(w) for w in weights))
        known = known.unionByName(written(undone, "trie-undone"))
    return known


def id_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, digest) of (conv, k1, k2): SHA-256 of the decimal ids of a node, ascending, joined by commas.

    Ids are put together by ranges first, so that a node of very many conversations sends a few strings and not as many rows;
    the digest then takes in one string after the other.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []

        def close() -> None:
            if ids:
                out.append((*key, ids[0], ",".join(map(str, ids))))
                ids.clear()

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "first", "ids"), r, strict=True)) for r in out], schema=chunk)
            out.clear()
            return batch

        for batch in batches:
            for k1, k2, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (k1, k2) or len(ids) >= IDS_A_CHUNK:
                    close()
                    key = (k1, k2)
                ids.append(conv)
            yield made()
        close()
        yield made()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        for batch in batches:
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if key != (k1, k2):
                    if key:
                        out.append({"k1": key[0], "k2": key[1], "digest": digest.hexdigest()})
                    key, digest = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist(out, schema=final)
            out.clear()
        if key:
            yield pa.RecordBatch.from_pylist([{"k1": key[0], "k2": key[1], "digest": digest.hexdigest()}], schema=final)

    longs = [("k1", pa.int64()), ("k2", pa.int64())]
    chunk = pa.schema([*longs, ("first", pa.int64()), ("ids", pa.string())])
    final = pa.schema([*longs, ("digest", pa.string())])
    ranged = ends.select("k1", "k2", F.col("conv").cast("bigint").alias("conv")).repartitionByRange("conv").sortWithinPartitions("k1", "k2", "conv")
    chunks = ranged.mapInArrow(joined, "k1 bigint, k2 bigint, first bigint, ids string")
    together = chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return together.mapInArrow(digested, "k1 bigint, k2 bigint, digest string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, core: int = CORE) -> DataFrame:
    """The trie's nodes, one row each: (node, parent, conv, depth, parent_conv, n_convs, n_children, n_leaves, saved, ends).

    ``turns`` is (conv, place, role, text) as ``placed_turns`` gives it: places from 1 without gaps, no nulls.
    ``conversations`` is (conv), the integral ids of all conversations, also of those without a turn, which belong to the root
    alone. node and parent number the nodes; conv is the smallest member; n_convs counts members, that is conversations that
    start with the node's turns; n_leaves counts childless nodes of the subtree; saved sums, over the subtree, a node's
    members but one times the code points of its last text; ends digests the members that have no further turn. Repeated
    conversations share their nodes, repeated ids in ``conversations`` count once, null ids not at all. Without a
    conversation there is no node, not even the root.
    """
    members = conversations.select("conv").where("conv is not null").distinct()
    none = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    roots = members.select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("chars"))
    rows = written(prefixes(turns).unionByName(roots), "trie-prefixes")
    ends = rows.groupBy("conv").agg(*(F.max_by(k, "depth").alias(k) for k in ("k1", "k2")))
    sizes = [F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")]
    facts = rows.groupBy("k1", "k2").agg(*sizes, *(F.max(c).alias(c) for c in ("depth", "p1", "p2", "chars")))
    # Siblings get consecutive numbers, the root number 1.
    nodes = scanned(facts, [F.col(c).asc_nulls_first() for c in ("p1", "p2", "k1", "k2")], label="trie-nodes")
    nodes = written(nodes.withColumnRenamed("number", "node"), "trie-numbered")
    sets = nodes.where("p1 is not null").groupBy("p1", "p2").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n_children"))
    sets = written(sets, "trie-siblings")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    above = sets.select("p1", "p2", "last").join(parents, ["p1", "p2"])
    below = sets.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "first", "n_children")
    linked = written(nodes.join(above, ["p1", "p2"], "left").join(below, ["k1", "k2"], "left"), "trie-links")
    enter, leave = 2 * F.col("node"), 2 * F.col("node") + 1
    onward = F.when(F.col("node") < F.col("last"), enter + 2).otherwise(2 * F.col("parent") + 1)
    saved = (F.col("n_convs") - 1) * F.col("chars")
    leaf = F.col("first").isNull().cast("bigint")
    entering = F.struct(enter.alias("arc"), F.coalesce(2 * F.col("first"), leave).alias("succ"), leaf.alias("leaves"), saved.alias("saved"))
    leaving = F.struct(leave.alias("arc"), onward.alias("succ"), zero.alias("leaves"), zero.alias("saved"))
    arcs = written(linked.select(F.explode(F.array(entering, leaving)).alias("a")).select("a.*"), "trie-arcs")
    sums = list_sums(arcs, ["leaves", "saved"], core)
    sign = F.when(F.col("arc") % 2 == 1, 1).otherwise(-1)
    figures = sums.groupBy(F.shiftright("arc", 1).alias("node")).agg(F.sum(sign * F.col("leaves")).alias("n_leaves"), F.sum(sign * F.col("saved")).alias("saved"))
    named = linked.join(figures, "node").join(id_digests(ends), ["k1", "k2"], "left")
    return named.select(
        "node", "parent", "conv", "depth", "parent_conv", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved",
        F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends"),
    )
