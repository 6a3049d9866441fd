"""Objects of JSON files that go over several lines, read by many tasks.

A line break cannot stand inside a JSON string, so how far a part of a file goes down into brackets does not depend on what
stands before it. The changes of depth of all parts, put one after the other, tell at which depth each part begins; a
second reading then cuts the parts into objects. Only an object that goes over the end of a part is put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomprep.sources.records import parts_of

ESCAPED = re.compile(rb"\\.", re.DOTALL)
STEP = np.zeros(256, np.int8)
STEP[list(b"[{")], STEP[list(b"]}")] = 1, -1
AT_ONCE = 1 << 20  # bytes looked at together
BETWEEN = b" ,[]\t\r\n\xef\xbb\xbf"


def steps(data: bytes) -> np.ndarray:
    """+1 where a bracket opens, -1 where one closes, 0 elsewhere and within strings."""
    bare = ESCAPED.sub(b"__", data) if b"\\" in data else data
    seen = np.frombuffer(bare, np.uint8)
    inside = np.cumsum(seen == ord('"'), dtype=np.int32) & 1
    return np.where(inside == 1, np.int8(0), STEP[seen])


def together(lines: pa.Array) -> Iterator[bytes]:
    """Whole lines, each followed by a blank, up to about AT_ONCE bytes."""
    ends = np.cumsum(pc.binary_length(lines).to_numpy().astype(np.int64) + 1)
    low = 0
    while low < len(lines):
        before = int(ends[low - 1]) if low else 0
        high = min(len(lines), int(np.searchsorted(ends, before + AT_ONCE)) + 1)
        some = lines.slice(low, high - low).cast(pa.binary())
        yield pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), b" ")[0].as_py() + b" "
        low = high


def split_elements(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(value): every object of the arrays in the files at ``path``, or the objects that stand there by themselves, as one
    line of text each. An element that is no object comes as it is. What a cut-off file leaves open comes as a broken
    object. The driver holds one row per part of a file, as many as tasks that read it."""
    lines = spark.read.text(path if isinstance(path, str) else list(path))
    # As in split_records, a file is told by the hash of its name.
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")

    def depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[int, int], list] = {}
        for part, some in parts_of(batches):
            state = rows.setdefault(part, [0, 0, None])
            for data in together(some):
                run = np.cumsum(steps(data), dtype=np.int64) + state[0]
                state[0], state[1] = int(run[-1]), min(state[1], int(run.min()))
                state[2] = state[2] or data.lstrip(b" \t\r\xef\xbb\xbf")[:1].decode("latin-1") or None
        columns = [[f for f, _ in rows], [s for _, s in rows], *([r[i] for r in rows.values()] for i in range(3))]
        kinds = [*[pa.int64()] * 4, pa.string()]
        names = ["file", "start", "change", "least", "first"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    kinds = "file bigint, start bigint, change bigint, least bigint, first string"
    told = sorted(lines.mapInArrow(depths, kinds).collect(), key=lambda r: (r["file"], r["start"]))
    begins: dict[tuple[int, int], tuple[int, int, int]] = {}  # depth, part that the open object began in, depth of the objects
    file, depth, origin, base = None, 0, 0, None
    for r in told:
        if r["file"] != file:
            file, depth, origin, base = r["file"], 0, 0, None
        if base is None and r["first"]:
            base = int(r["first"] == "[")
        begins[(r["file"], r["start"])] = (depth, origin, base or 0)
        if depth + r["least"] <= (base or 0):
            origin = r["start"]
        depth += r["change"]
    shared = spark.sparkContext.broadcast(begins)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(file, start, origin, whole, value): an object is not whole where it goes over an end of the part."""
        at, depth, origin, base, over, held = None, 0, 0, 0, False, []
        out: list[tuple[int, int, int, bool, str]] = []

        def made() -> pa.RecordBatch:
            kinds = {"file": pa.int64(), "start": pa.int64(), "origin": pa.int64(), "whole": pa.bool_(), "value": pa.string()}
            columns = list(zip(*out, strict=True)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

        def put(whole: bool, pieces: list[bytes]) -> None:
            out.append((*at, origin, whole, b"".join(pieces).decode("utf-8", "replace")))

        for part, some in parts_of(batches):
            if part != at:
                if held:
                    put(False, held)
                at, held = part, []
                depth, origin, base = shared.value[part]
                over = depth > base  # goes on with an object from before
                if not over:
                    origin = part[1]
            for data in together(some):
                step = steps(data)
                run = np.cumsum(step, dtype=np.int64) + depth
                opened = np.flatnonzero((step == 1) & (run == base + 1)).tolist()
                closed = (np.flatnonzero((step == -1) & (run == base)) + 1).tolist()
                if depth > base:
                    opened.insert(0, 0)
                for low, high in zip([0, *closed], [*opened, len(data)], strict=False):
                    between = data[low:high].strip(BETWEEN)
                    if between:
                        out.append((*at, at[1], True, between.decode("utf-8", "replace")))
                for low, high in zip(opened, closed, strict=False):
                    put(not over, [*held, data[low:high]])
                    held, over, origin = [], False, at[1]
                if len(opened) > len(closed):
                    held.append(data[opened[-1] :])
                depth = int(run[-1])
                yield made()
        if held:
            put(False, held)
        yield made()

    found = lines.mapInArrow(cut, "file bigint, start bigint, origin bigint, whole boolean, value string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda p: p["value"]), "")
    over = found.where("not whole").groupBy("file", "origin").agg(joined.alias("value"))
    return found.where("whole").select("value").unionByName(over.select("value"))
