"""Records of delimited files whose quoted fields cross lines, read by many tasks.

Whether a line break ends a record depends on all quotes before it. A task cannot know them, but for its part of a file it
can tell both cases: how the part ends when it begins inside a quoted field, and when it does not. Put one after the other,
these answers tell where every part really begins; a second reading then cuts each part into records. Only a record that
goes over the end of a part is put together from several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from loomprep.session import scratch_path

QUOTE = '"'


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a line that begins inside a quoted field, or does not, ends inside one.

    A quote opens a field only as its first character. Inside, two quotes stand for one; a single one closes the field,
    and what follows up to the separator belongs to it as it is.
    """
    at = 0
    while True:
        if inside:
            end = line.find(QUOTE, at)
            if end < 0:
                return True
            if line.startswith(QUOTE, end + 1):
                at = end + 2
                continue
            at, inside = end + 1, False
        elif line.startswith(QUOTE, at):
            at, inside = at + 1, True
            continue
        following = line.find(sep, at)
        if following < 0:
            return False
        at = following + len(sep)


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """(part, lines) in the order of reading; a part comes in several arrays where it is large."""
    for batch in batches:
        files, starts = (batch.column(i).to_numpy() for i in range(2))
        turns = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
        bounds = [0, *turns.tolist(), batch.num_rows]
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if high > low:
                yield (int(files[low]), int(starts[low])), batch.column(2).slice(low, high - low)


def runs_of(lines: pa.Array) -> Iterator[tuple[str | None, pa.Array]]:
    """The lines in order: a line with a quote as a text, those between two such lines as an array."""
    low = 0
    for place in np.flatnonzero(pc.match_substring(lines, QUOTE).to_numpy(zero_copy_only=False)).tolist():
        if place > low:
            yield None, lines.slice(low, place - low)
        yield lines[place].as_py(), lines.slice(place, 1)
        low = place + 1
    if low < len(lines):
        yield None, lines.slice(low)


def joined_lines(lines: pa.Array) -> str:
    """Lines with the line feeds between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0].as_py()


def split_records(spark: SparkSession, path: str, sep: str, encoding: str, columns: list[str]) -> DataFrame:
    """All fields as text, of the files at ``path`` with a header each. Lines end with a line feed, with or without a carriage
    return. The driver holds one row per part of a file, as many as tasks that read it. Two passes read the lines, the second
    writes the records to the shared folder."""
    lines = spark.read.option("encoding", encoding).option("lineSep", "\n").text(path)
    # A file is told by the hash of its name, so that a line does not carry the name.
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")

    def both_cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[int, int], list[bool]] = {}
        for part, some in parts_of(batches):
            # Now inside, any record begun: for a part that begins outside and for one that begins inside.
            state = rows.setdefault(part, [False, False, True, False])
            for line, _ in runs_of(some):
                for case in (0, 2):
                    state[case + 1] |= not state[case]
                    if line is not None:
                        state[case] = ends_inside(line, state[case], sep)
        columns = [[f for f, _ in rows], [s for _, s in rows], *([r[i] for r in rows.values()] for i in range(4))]
        kinds = [pa.int64(), pa.int64(), *[pa.bool_()] * 4]
        names = ["file", "start", "outside_ends", "outside_begins", "inside_ends", "inside_begins"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    flags = "outside_ends boolean, outside_begins boolean, inside_ends boolean, inside_begins boolean"
    told = sorted(lines.mapInArrow(both_cases, f"file bigint, start bigint, {flags}").collect(), key=lambda r: (r["file"], r["start"]))
    begins: dict[tuple[int, int], tuple[bool, int]] = {}  # inside a field, part that its record began in
    file, inside, origin = None, False, 0
    for r in told:
        if r["file"] != file:
            file, inside, origin = r["file"], False, 0
        begins[(r["file"], r["start"])] = (inside, origin)
        if r["inside_begins" if inside else "outside_begins"]:
            origin = r["start"]
        inside = r["inside_ends" if inside else "outside_ends"]
    shared = spark.sparkContext.broadcast(begins)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(file, origin, start, whole, record): a record is not whole where it goes over an end of the part."""
        at, inside, pieces, origin, headed, named = None, False, [], 0, False, False
        out: list[tuple[int, int, int, bool, str]] = []

        def closed(over: bool) -> None:
            nonlocal pieces, headed, named, origin
            record = "\n".join(pieces)
            if pieces and at[1] == 0 and not named and record.strip():  # the header
                named = True
                if over:
                    out.append((at[0], -1, origin, False, record))
            elif pieces and (over or headed or record.strip()):
                out.append((*at, origin, not over and not headed, record))
            pieces, headed, origin = [], False, at[1]

        def made() -> pa.RecordBatch:
            kinds = {"file": pa.int64(), "start": pa.int64(), "origin": pa.int64(), "whole": pa.bool_(), "record": pa.string()}
            columns = list(zip(*out, strict=True)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

        for part, some in parts_of(batches):
            if part != at:
                if at is not None:
                    closed(inside)
                at, named = part, False
                inside, origin = shared.value[part]
                headed = inside  # goes on with a record from before
                if not inside:
                    origin = part[1]
            for line, run in runs_of(some):
                if inside and line is None:
                    pieces.append(joined_lines(run))
                    continue
                for text in run.to_pylist() if line is None else (line,):
                    if not inside and pieces:
                        closed(False)
                    pieces.append(text)
                if line is not None:
                    inside = ends_inside(line, inside, sep)
            if out:
                yield made()
        if at is not None:
            closed(inside)
        yield made()

    # Written, as types and rows are found in several passes: the lines are cut once.
    place = scratch_path(spark, "csv-records")
    kinds = "file bigint, start bigint, origin bigint, whole boolean, record string"
    lines.mapInArrow(cut, kinds).write.parquet(place)
    found = spark.read.schema(kinds).parquet(place)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda p: p["record"]), "\n")
    over = found.where("not whole").groupBy("file", "origin").agg(joined.alias("record"), F.min("start").alias("least")).where("least >= 0")
    whole = found.where("whole").select("record").unionByName(over.select("record"))
    record = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))])
    parsed = F.from_csv(record, fields.simpleString()[7:-1].replace(":", " "), {"sep": sep, "quote": QUOTE, "escape": QUOTE, "multiLine": "true"})
    return whole.select(parsed.alias("r")).select([F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)])
