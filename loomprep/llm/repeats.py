"""Substrings of a given length that repeat across documents, by suffix sorting of shards.

All occurrences of a string of ``length`` bytes must meet in one shard. The string chooses it: the least hash of the
``GRAM``-byte grams inside it is the same wherever it stands. Neighbouring strings mostly have that least hash in common, so
a text falls into fragments, each of them a run of strings of one hash, and a fragment goes to the shard of its hash.

1. Texts are packed. Every pack sends its distinct hashes, four bytes each, to buckets of them and hears which occur in
   more than one document; only fragments with such a hash can hold anything that repeats.
2. Those fragments go to their shards, equal ones of a pack once, with the smallest document that has them.
3. A shard sorts the suffixes of its fragments (``suffixes``: external induced sorting). Neighbours with a common prefix of
   the length or more are the occurrences of one string; the smallest document among them is its first.
4. Every pack hears, per fragment it sent, the smallest document that has the fragment and the strings in it that start in a
   document smaller than that. A byte goes when it is covered by a string that starts in a smaller document than its own.

No hash decides on equality: grams only bring fragments together, fragments are compared as bytes and strings by the sort.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from loomprep.llm import suffixes
from loomprep.llm.common import bucketed, written

LENGTH = 50
GRAM = 20
PACK = 1 << 23  # bytes of text in a pack; a longer text is a pack of its own
SHARE = 23  # a bucket or shard for so many bits of text bytes
STRINGS_AT_ONCE = 1 << 20
MEMORY = 96 << 20  # bytes that an array or queue of a shard's sort may take before it goes to disk
TOGETHER = 64 << 20  # bytes of distinct fragments that a shard remembers to recognise equal ones

MOST_BUCKETS = 100_000  # files of a table that Spark deals by a key

_draw = np.random.default_rng(11)
LETTERS = _draw.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE, MIX = (int(x) | 1 for x in _draw.integers(1 << 62, 1 << 63, 2, np.uint64))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    return zstandard.ZstdCompressor(level=3).compress(b"".join(a.tobytes() for a in arrays))


def unpacked(value: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value)


def columns_packed(*columns: np.ndarray) -> bytes:
    """Whole numbers as one compressed value: all first bytes, all second bytes and so on."""
    octets = np.stack([np.asarray(c, np.int64) for c in columns]).view(np.uint8)
    return packed(np.ascontiguousarray(octets.reshape(len(columns), -1, 8).transpose(0, 2, 1)))


def columns_unpacked(value: bytes, columns: int) -> np.ndarray:
    octets = np.frombuffer(unpacked(value), np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(octets.transpose(0, 2, 1)).view(np.int64)[..., 0]


def mixed(values: np.ndarray) -> np.ndarray:
    """Values spread over all 64 bits, one to one."""
    values = (values ^ (values >> np.uint64(29))) * np.uint64(MIX)
    return values ^ (values >> np.uint64(32))


def gram_hashes(octets: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes from every place."""
    whole, have, part, size, power = None, 0, LETTERS[octets], 1, BASE
    left = gram
    while left:
        if left & 1:
            if whole is None:
                whole, have = part, size
            else:
                n = len(octets) - have - size + 1
                whole = whole[:n] * np.uint64(power) + part[have : have + n]
                have += size
        left >>= 1
        if left:
            n = len(octets) - 2 * size + 1
            part = part[:n] * np.uint64(power) + part[size : size + n]
            size, power = 2 * size, power * power % (1 << 64)
    return mixed(whole)


def least_of_runs(values: np.ndarray, run: int) -> np.ndarray:
    """Least of every ``run`` neighbouring values."""
    size = 1
    while 2 * size <= run:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (run - size)], values[run - size :]) if size < run else values


def fragments(octets: np.ndarray, sizes: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, strings, hash, text) of the fragments of a pack of texts with the given sizes, in order.

    A fragment of n strings is n + length - 1 bytes long. Texts that are not valid have none.
    """
    gram = min(GRAM, length)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    barred = np.zeros(len(octets) + 1, np.int32)  # places where no string starts
    np.add.at(barred, np.where(valid, np.maximum(starts, ends - (length - 1)), starts), 1)
    np.add.at(barred, ends, -1)
    open_at = np.cumsum(barred[:-1]) == 0
    found = []
    for low in range(0, max(0, len(octets) - length + 1), STRINGS_AT_ONCE):
        part = octets[low : low + STRINGS_AT_ONCE + length - 1]
        least = least_of_runs(gram_hashes(part, gram), length - gram + 1)
        inside = open_at[low : low + len(least)]
        same = (least[1:] == least[:-1]) & inside[1:] & inside[:-1]
        first = np.flatnonzero(inside & ~np.concatenate([[False], same]))
        last = np.flatnonzero(inside & ~np.append(same, False))
        found.append((first + low, last - first + 1, least[first]))
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    start, count, hashed = (np.concatenate(c) for c in zip(*found, strict=True))
    return start, count, mixed(hashed), np.searchsorted(ends, start, "right")  # the least of many hashes is small


def slots(hashed: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper half, the rest of the hash in the lower."""
    bucket = (hashed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return (bucket << np.uint64(32)) | (hashed & np.uint64(0xFFFFFFFF))


def distinct_slots(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values ascending, place of each value among them, order, first of each in that order)."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    edges = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(values) else np.zeros(0, bool)
    place = np.zeros(len(values), np.int64)
    place[order] = np.cumsum(edges) - 1
    return ordered[edges], place, order, np.flatnonzero(edges)


def by_bucket(distinct: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of ascending slots."""
    bucket = (distinct >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else [0]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[low]), int(low), int(high)


class Pack:
    """One row of the table of packs."""

    def __init__(self, facts: bytes, texts: bytes) -> None:
        n = len(facts) // 17
        self.ids, self.sizes = np.frombuffer(facts, np.int64, n), np.frombuffer(facts, np.int64, n, 8 * n)
        self.valid = np.frombuffer(facts, bool, n, 16 * n)
        self.octets = np.frombuffer(unpacked(texts), np.uint8)


def packs_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(pack, size, facts, texts): texts put together as they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def closed() -> pa.RecordBatch:
            nonlocal ids, texts, size, number
            known = np.array([i is not None for i in ids], bool)
            numbers, sizes = np.array([i or 0 for i in ids], np.int64), np.array([len(t) for t in texts], np.int64)
            row = [(part << 32) + number, size, b"".join(a.tobytes() for a in (numbers, sizes, known)), packed(np.frombuffer(b"".join(texts), np.uint8))]
            ids, texts, size, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["pack", "size", "facts", "texts"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                octets = text.as_py() or b""
                if ids and size + len(octets) > PACK:
                    yield closed()
                ids.append(i)
                texts.append(octets)
                size += len(octets)
        if ids:
            yield closed()

    slim = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary"))
    return slim.mapInArrow(run, "pack bigint, size bigint, facts binary, texts binary")


#: What packs, buckets and shards tell each other.
ITEM = "pack bigint, kind int, bucket int, a binary, b binary"


def items(*rows: tuple) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["pack", "kind", "bucket", "a", "b"])


def gathered(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows of each key after one another, as they come."""
    rows = (row for batch in batches for row in batch.to_pylist())
    row = next(rows, None)
    while row is not None:
        at, pending = row[key], [row]

        def own() -> Iterator[dict]:
            nonlocal row
            yield pending.pop()
            for row in rows:  # noqa: B020
                if row[key] != at:
                    return
                yield row
            row = None

        group = own()
        yield at, group
        for _ in group:
            pass


def sent_hashes(packs: DataFrame, length: int, buckets: int) -> DataFrame:
    """ITEM rows (kind 0): a pack's distinct hashes of a bucket and which of them several of its documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pack = Pack(row["facts"], row["texts"])
                _, _, hashed, text = fragments(pack.octets, pack.sizes, pack.valid, length)
                distinct, place, order, first = distinct_slots(slots(hashed, buckets))
                owner = pack.ids[text]
                several = np.zeros(len(distinct), bool)
                if len(distinct):
                    several = np.logical_or.reduceat(owner[order] != owner[order][first][place[order]], first)
                rest = (distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                yield items(*((row["pack"], 0, b, rest[low:high].tobytes(), np.packbits(several[low:high]).tobytes()) for b, low, high in by_bucket(distinct)))

    return packs.select("pack", "facts", "texts").mapInArrow(run, ITEM)


def repeated_hashes(sent: DataFrame, buckets: int) -> DataFrame:
    """ITEM rows (kind 0): for what each pack sent to a bucket, a bit a hash: it occurs in more than one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in gathered(batches, "bucket"):
            packs, hashes, several = [], [], []
            for row in rows:
                packs.append(row["pack"])
                hashes.append(np.frombuffer(row["a"], np.uint32))
                several.append(np.unpackbits(np.frombuffer(row["b"], np.uint8), count=len(hashes[-1])).astype(bool))
            values = np.concatenate(hashes)
            _, place, order, first = distinct_slots(values)
            often = np.diff(np.append(first, len(values))) > 1
            often |= np.logical_or.reduceat(np.concatenate(several)[order], first)
            found, low = often[place], 0
            for pack, own in zip(packs, hashes, strict=True):
                yield items((pack, 0, bucket, np.packbits(found[low : low + len(own)]).tobytes(), b""))
                low += len(own)

    together = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return together.mapInArrow(run, ITEM)


def with_packs(packs: DataFrame, told: DataFrame) -> DataFrame:
    """(pack, facts, texts, told) of every pack: what it was told, a list as long as what it sent."""
    lists = told.groupBy("pack").agg(F.collect_list(F.struct("kind", "bucket", "a", "b")).alias("told"))
    return packs.join(lists, "pack", "left").select("pack", "facts", "texts", "told")


def sent_fragments(packs: DataFrame, repeated: DataFrame, length: int, buckets: int) -> DataFrame:
    """ITEM rows: kind 1 the distinct fragments that a pack sends to a shard (sizes, smallest documents, bytes), kind 2 a note
    for the pack of where its fragments stand and which they are in which shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                number, pack = row["pack"], Pack(row["facts"], row["texts"])
                bits = {t["bucket"]: np.frombuffer(t["a"], np.uint8) for t in row["told"] or ()}
                start, count, hashed, text = fragments(pack.octets, pack.sizes, pack.valid, length)
                distinct, place, _, _ = distinct_slots(slots(hashed, buckets))
                often = [np.unpackbits(bits[b], count=high - low) for b, low, high in by_bucket(distinct)]
                chosen = np.flatnonzero(np.concatenate(often)[place]) if often else np.zeros(0, np.int64)
                start, count, text = start[chosen], count[chosen], text[chosen]
                shard = (slots(hashed[chosen], buckets) >> np.uint64(32)).astype(np.int64)
                whole, seen = pack.octets.tobytes(), {}
                which = np.fromiter((seen.setdefault(whole[s:e], len(seen)) for s, e in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)), np.int64, len(start))
                owner = np.full(len(seen), np.iinfo(np.int64).max, np.int64)
                np.minimum.at(owner, which, pack.ids[text])
                home = np.zeros(len(seen), np.int64)
                home[which] = shard
                order = np.argsort(home, kind="stable")
                inside, kept = np.zeros(len(seen), np.int64), list(seen)
                edges = np.flatnonzero(np.concatenate([[True], home[order][1:] != home[order][:-1], [True]])) if len(seen) else [0]
                for low, high in zip(edges[:-1], edges[1:], strict=True):
                    own = order[low:high]
                    inside[own] = np.arange(high - low)
                    texts = [kept[i] for i in own]
                    sizes = np.array([len(t) for t in texts], np.int64)
                    yield items((number, 1, int(home[own[0]]), columns_packed(sizes, owner[own]), packed(np.frombuffer(b"".join(texts), np.uint8))))
                yield items((number, 2, 0, columns_packed(np.diff(start, prepend=0), count, shard, inside[which]), b""))

    return with_packs(packs, repeated).mapInArrow(run, ITEM)


def first_documents(space: suffixes.Space, text: np.ndarray, want: np.ndarray, owner_of: np.ndarray, strings: int, length: int) -> np.ndarray:
    """For each wanted string of a shard whether it also starts in a smaller document than its fragment's."""
    order, opens = space.array(strings, np.int64), space.array(strings, bool)
    least: list[np.ndarray] = []
    at = 0
    for index, shared in suffixes.suffixes(space, text, length, want):
        new = shared < length
        order[at : at + len(index)], opens[at : at + len(index)] = index, new
        at += len(index)
        own = owner_of[index]
        first = np.flatnonzero(new)
        if not len(first) or first[0]:  # the block goes on with the last string of the one before
            high = first[0] if len(first) else len(own)
            least[-1][-1] = min(least[-1][-1], own[:high].min())
        if len(first):
            least.append(np.minimum.reduceat(own, first))
    smallest = np.concatenate(least) if least else np.zeros(0, np.int64)
    out, group = space.array(strings, bool), -1
    for low in range(0, strings, suffixes.BLOCK):
        index = order[low : low + suffixes.BLOCK]
        place = group + np.cumsum(opens[low : low + suffixes.BLOCK])
        out[index] = smallest[place] < owner_of[index]
        group = place[-1]
    return out


def sorted_shards(sent: DataFrame, length: int, buckets: int, memory: int) -> DataFrame:
    """ITEM rows (kind 1): for what each pack sent to a shard, the smallest documents of the fragments, and of their strings
    a bit each: it starts in a document smaller than that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in gathered(batches, "bucket"):
            with tempfile.TemporaryDirectory() as folder, open(f"{folder}/fragments", "w+b") as file:
                space, seen, held = suffixes.Space(folder, memory), {}, 0
                packs, asked, sizes, owners = [], [], [], []
                for row in rows:
                    own, owner = columns_unpacked(row["a"], 2)
                    whole, low, which = unpacked(row["b"]), 0, []
                    for size, smallest in zip(own.tolist(), owner.tolist(), strict=True):
                        fragment = whole[low : low + size]
                        low += size
                        i = seen.get(fragment)
                        if i is None:
                            if held > TOGETHER:  # equal fragments may stand twice from here on: the sort brings them together
                                seen, held = {}, 0
                            i = seen[fragment] = len(sizes)
                            held += size + 100
                            sizes.append(size)
                            owners.append(smallest)
                            file.write(fragment)
                        elif smallest < owners[i]:
                            owners[i] = smallest
                        which.append(i)
                    packs.append(row["pack"])
                    asked.append(np.array(which, np.int64))
                seen = None
                file.flush()
                size, owner = np.array(sizes, np.int64), np.array(owners, np.int64)
                octets = np.memmap(file, np.uint8, "r")
                # Symbol 0 ends a fragment; a byte is its value and one.
                n, strings = int(size.sum()) + len(size), int((size - (length - 1)).sum())
                ends = np.cumsum(size + 1) - 1
                text, want, of = space.array(n, np.uint16), space.array(n, bool), space.array(strings, np.int64)
                low = string = 0
                for first in range(0, len(size), 1 << 14):
                    some = size[first : first + (1 << 14)]
                    bytes_here = int(some.sum())
                    body = np.ones(bytes_here + len(some), bool)
                    stops = np.cumsum(some + 1) - 1
                    body[stops] = False
                    part = np.zeros(len(body), np.uint16)
                    part[body] = octets[low : low + bytes_here].astype(np.uint16) + 1
                    at = low + first
                    text[at : at + len(part)] = part
                    shut = np.zeros(len(body) + 1, np.int32)
                    np.add.at(shut, stops - (length - 1), 1)
                    np.add.at(shut, stops + 1, -1)
                    want[at : at + len(part)] = np.cumsum(shut[:-1]) == 0
                    here = np.repeat(owner[first : first + (1 << 14)], some - (length - 1))
                    of[string : string + len(here)] = here
                    low, string = low + bytes_here, string + len(here)
                smaller = first_documents(space, text, want, of, strings, length)
                before = np.concatenate([[0], np.cumsum(size - (length - 1))])
                touched = np.logical_or.reduceat(smaller, before[:-1])
                for pack, which in zip(packs, asked, strict=True):
                    marked = which[touched[which]]
                    bits = [smaller[before[i] : before[i + 1]] for i in marked]
                    facts = np.packbits(np.concatenate(bits)) if bits else np.zeros(0, np.uint8)
                    yield items((pack, 1, bucket, columns_packed(owner[which], touched[which]), packed(facts)))
                del octets, text, want, of, smaller, touched, ends

    together = sent.where("kind = 1").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return together.mapInArrow(run, ITEM)


def covered(start: np.ndarray, count: np.ndarray, whole: np.ndarray, partial: np.ndarray, bits: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of n bytes are covered: by all strings of the fragments ``whole``, by those marked in ``bits`` of ``partial``."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, start[whole], 1)
    np.add.at(edges, start[whole] + count[whole] + length - 1, -1)
    before = np.cumsum(count[partial]) - count[partial]
    places = (np.repeat(start[partial] - before, count[partial]) + np.arange(len(bits)))[bits]
    np.add.at(edges, places, 1)
    np.add.at(edges, places + length, -1)
    return np.cumsum(edges[:-1]) > 0


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, memory: int = MEMORY) -> DataFrame:
    """(id, n_bytes, spans, kept) for every row: the byte ranges [start, end) covered by a string of ``length`` bytes that also
    starts in a document with a smaller id, joined where they touch, and the bytes that remain.

    Ids are integral. Texts count as UTF-8 bytes, null texts as empty. Rows that share an id are parts of one document: none
    is smaller than the other, so a string they share stays in both. Rows with a null id lose nothing and make others lose
    nothing. Texts shorter than ``length`` lose nothing. Repeated rows give repeated rows; an empty table gives an empty
    table; other columns are left out.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError("ids must be integral")
    spark = docs.sparkSession
    octets = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), octets >> SHARE, 1)
    packs = bucketed(packs_of(docs, id_col, text_col), "repeats-packs", "pack", min(buckets, MOST_BUCKETS))
    repeated = written(repeated_hashes(sent_hashes(packs, length, buckets), buckets), "repeats-hashes")
    sent = written(sent_fragments(packs, repeated, length, buckets), "repeats-fragments")
    answers = written(sorted_shards(sent, length, buckets, memory), "repeats-found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                pack = Pack(row["facts"], row["texts"])
                told, note = {}, np.zeros((4, 0), np.int64)
                for t in row["told"] or ():
                    if t["kind"] == 1:
                        owner, touch = columns_unpacked(t["a"], 2)
                        told[t["bucket"]] = (owner, touch > 0, np.frombuffer(unpacked(t["b"]), np.uint8))
                    else:
                        note = columns_unpacked(t["a"], 4)
                step, count, shard, inside = note
                start = np.cumsum(step)
                text = np.searchsorted(np.cumsum(pack.sizes), start, "right")
                # One list of all fragments the pack sent: first document, whether bits follow, where they begin.
                base = np.zeros(buckets, np.int64)
                owners, touched, sizes, bits = [], [], [], []
                for b, (owner, touch, packed_bits) in sorted(told.items()):
                    base[b] = sum(map(len, owners))
                    size = np.zeros(len(owner), np.int64)
                    own = shard == b
                    size[inside[own]] = count[own]
                    size *= touch
                    owners.append(owner)
                    touched.append(touch)
                    sizes.append(size)
                    bits.append(np.unpackbits(packed_bits, count=int(size.sum())).astype(bool))
                gone = np.zeros(len(pack.octets), bool)
                if owners:
                    owner, touch, size, marks = (np.concatenate(c) for c in (owners, touched, sizes, bits))
                    which = base[shard] + inside
                    whole = pack.ids[text] > owner[which]
                    partial = ~whole & touch[which]
                    before = np.cumsum(size) - size
                    lengths = count[partial]
                    reach = np.repeat(before[which[partial]] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                    gone = covered(start, count, whole, partial, marks[reach], len(gone), length)
                ends = np.cumsum(pack.sizes)
                starts = ends - pack.sizes
                for first in range(0, len(ends), 1024):
                    spans, kept = [], []
                    for low, high in zip(starts[first : first + 1024], ends[first : first + 1024], strict=True):
                        own = gone[low:high]
                        turns = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                        spans.append(turns)
                        kept.append(pack.octets[low:high][~own].tobytes() if len(turns) else pack.octets[low:high].tobytes())
                    offsets = pa.array(np.cumsum([0, *(len(t) // 2 for t in spans)]), pa.int32())
                    flat = np.concatenate([np.zeros(0, np.int64), *spans])
                    listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([flat[::2], flat[1::2]], fields=list(span)))
                    some = slice(first, first + 1024)
                    ids = pa.array(pack.ids[some], mask=~pack.valid[some])
                    yield pa.RecordBatch.from_arrays([ids, pa.array(pack.sizes[some]), listed, pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    whole = answers.unionByName(sent.where("kind = 2"))
    schema = "id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    return with_packs(packs, whole).mapInArrow(run, schema)
