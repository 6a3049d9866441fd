"""SentencePiece encoding and decoding over a relational lattice of the distinct words.

The bounded-length substrings of every distinct word are exploded and joined to the piece table; the matches are the edges
of the word's lattice, one word's edges after the other. A fold over the edges then finds the word's pieces. For a unigram
file the fold is Viterbi's: the best path to every place. For a byte-pair file, whose scores are merge ranks and not
probabilities, no best path gives the library's pieces; there the fold replays the merges over the same lattice, each edge
removing the one boundary inside it. Both go over the edges of many words at a time.

Frequent words are encoded once, into a table of bounded size that every worker holds. The rare words of some texts go
through the lattice in the task that reads these texts, just before them, so that neither texts nor rare words are moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import sentencepiece
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomprep.llm.common import given_back, some_texts, worker_table, written
from loomprep.session import scratch_path

FREQUENT = 1 << 19  # words of the table that every worker holds
WIDE = 20  # bits of a piece number or rank
LONGEST = 60  # characters of a word in the lattice, whose boundaries are the bits of a long
BYTES_AT_ONCE = 1 << 23  # of texts that are cut into words, and share their rare words
WORDS_AT_ONCE = 1 << 18  # of texts that are put together
WORDS_HELD = 1 << 14  # that are strings of Python at a time
EDGES_AT_ONCE = 1 << 17
SPACE = "▁"
LETTER, STOPS = "[A-Za-zÀ-ÖØ-öø-ɏ]", ".,;:!?"
ENDS = f"[\n{STOPS}]"  # what may end a word inside a run without spaces
# A word ends before a space mark or line end, and between a Latin letter and a full stop or the like.
UNITS = re.compile(
    f"{SPACE}*(?:[^{SPACE}\n{STOPS}]+(?:(?<!{LETTER})[{STOPS}][^{SPACE}\n]*)?|[{STOPS}][^{SPACE}\n]*)|{SPACE}+|\n"
)


@dataclass(frozen=True)
class Pieces:
    """What a SentencePiece file says: text pieces with score, byte pieces, kind, white-space handling."""

    pieces: tuple[tuple[str, int, float], ...]
    first_byte: int
    unknown: int
    unigram: bool
    longest: int


@lru_cache(maxsize=2)
def library(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def pieces_of(path: str, unigram: bool = False) -> Pieces:
    """Raises where a file's pieces reach across the words that texts are cut into, or its texts are normalised."""
    model = library(path)
    ids = range(model.vocab_size())
    own = tuple((model.id_to_piece(i), i, model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    octets = [i for i in ids if model.is_byte(i)]
    over = re.compile(f"{LETTER}[{STOPS}]")
    if any("\n" in p and p != "\n" or SPACE in p.lstrip(SPACE) or over.search(p) for p, _, _ in own):
        raise ValueError(f"{path}: a piece reaches over the end of a word")
    if model.encode("  a  b ") != model.encode(model.decode(model.encode("  a  b "))) or model.decode(model.encode("  a  b ")) != "  a  b ":
        raise ValueError(f"{path}: texts are normalised before encoding")
    if model.vocab_size() >= (1 << WIDE) - 1:
        raise ValueError(f"{path}: more pieces than an edge has bits for")
    if octets and octets != list(range(octets[0], octets[0] + 256)):
        raise ValueError(f"{path}: byte pieces are not in order")
    return Pieces(own, octets[0] if octets else -1, model.unk_id(), unigram, max(len(p) for p, _, _ in own))


def piece_table(spark: SparkSession, table: Pieces) -> DataFrame:
    """(_piece, _id, _rank, score) per text piece: rank 0 is the best score."""
    ordered = sorted(table.pieces, key=lambda x: (-x[2], x[1]))
    rows = [(p, i, rank, s) for rank, (p, i, s) in enumerate(ordered)]
    return spark.createDataFrame(rows, "_piece string, _id int, _rank int, score double")


def units(text: str) -> list[str]:
    """The words of a text, each with the space marks before it; no piece reaches over their ends."""
    return UNITS.findall(SPACE + text.replace(" ", SPACE)) if text else []


def all_units(texts: pa.Array) -> tuple[list[pa.Array], list[int]]:
    """The words of the texts, one text after the other, and how many each has."""
    parts, held, sizes = [], [], []
    for text in texts:
        found = units(text.as_py())
        sizes.append(len(found))
        held += found
        if len(held) >= WORDS_HELD:
            parts.append(pa.array(held, pa.string()))
            held = []
    return [*parts, pa.array(held, pa.string())], sizes


def taken(offsets: np.ndarray, values: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of the lists named by ``index``, one after the other."""
    lengths = offsets[index + 1] - offsets[index]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[index] - ends + lengths, lengths)
    return np.concatenate([np.zeros(1, np.int64), ends]), values[at]


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, offsets, words): per text the numbers of its words, as ``units`` gives them.

    Runs between single spaces are told apart first and only the distinct ones are cut; a text with other spaces is cut as it
    is.
    """
    texts = pc.fill_null(texts, "")
    plain = pc.invert(pc.or_(pc.match_substring_regex(texts, f"  |^ |{SPACE}"), pc.equal(texts, "")))
    single = plain.to_numpy(zero_copy_only=False)
    runs = pc.split_pattern(texts.filter(plain), " ")
    of_run = runs.flatten().dictionary_encode()
    rows = runs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    del runs
    distinct = of_run.dictionary
    ended = pc.match_substring_regex(distinct, ENDS).to_numpy(zero_copy_only=False)
    whole = pc.binary_join_element_wise(pa.scalar(SPACE), distinct.filter(pa.array(~ended)), "")
    parted, parted_sizes = all_units(distinct.filter(pa.array(ended)))
    odd, odd_sizes = all_units(texts.filter(pa.array(~single)))
    words = pa.concat_arrays([whole, *parted, *odd]).dictionary_encode()
    del whole, parted, odd
    number = words.indices.to_numpy(zero_copy_only=False)
    # The words of every distinct run, then those of every odd text.
    sizes = np.ones(len(distinct) + len(odd_sizes), np.int64)
    sizes[np.concatenate([np.flatnonzero(ended), np.arange(len(distinct), len(sizes))])] = parted_sizes + odd_sizes
    order = np.concatenate([np.flatnonzero(~ended), np.flatnonzero(ended), np.arange(len(distinct), len(sizes))])
    starts = np.zeros(len(sizes), np.int64)
    starts[order] = np.cumsum(sizes[order]) - sizes[order]
    of_list = np.argsort(starts, kind="stable")  # lists in the order in which their words lie
    place = np.empty(len(sizes), np.int32)
    place[of_list] = np.arange(len(sizes))
    bounds = np.concatenate([[0], np.cumsum(sizes[of_list])])
    per_text = np.ones(len(texts), np.int64)
    per_text[single] = rows
    ends = np.cumsum(per_text)
    named = np.empty(ends[-1] if len(ends) else 0, np.int32)
    in_plain = np.repeat(single, per_text)
    named[in_plain] = place[of_run.indices.to_numpy(zero_copy_only=False)]
    named[~in_plain] = place[len(distinct) + np.arange(len(odd_sizes))]
    del of_run, distinct, in_plain
    parts = [taken(bounds, number, named[low : low + WORDS_AT_ONCE])[1] for low in range(0, len(named), WORDS_AT_ONCE)]
    at = np.concatenate([[0], np.cumsum(np.diff(bounds)[named])])
    return words.dictionary, at[np.concatenate([[0], ends])], np.concatenate([np.zeros(0, number.dtype), *parts])


def tallied(docs: DataFrame, text_col: str) -> DataFrame:
    """(unit, n) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in some_texts(batch.column(0), BYTES_AT_ONCE):
                words, _, found = cut(batch.column(0).slice(low, high - low))
                times = pa.array(np.bincount(found, minlength=len(words)))
                del found
                yield pa.RecordBatch.from_arrays([words, times], names=["unit", "n"])
                del words, times
                given_back()
            del batch
        given_back()

    return docs.select(text_col).mapInArrow(run, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))


def packed_edge(rank: Column, start: Column, end: Column, piece: Column) -> Column:
    """An edge in one long, in order of rank and start; piece -1 stands for a character without a piece."""
    fields = ((rank, WIDE), (start, 6), (end, 6), (piece + 1, WIDE))
    code = F.lit(0).cast("bigint")
    for value, width in fields:
        code = F.shiftleft(code, width).bitwiseOR(value.cast("bigint"))
    return code


def lattice(words: DataFrame, table: Pieces) -> DataFrame:
    """A row per edge of every ``unit``, in its place among the rows: the other columns, unit (only in its first row), edge, for
    a unigram file also score. Words over LONGEST characters have the one edge -1. Rows without a unit stay as they are.

    What is exploded and joined with a broadcast table is not moved, so a word's edges follow one another.
    """
    others = [c for c in words.columns if c != "unit"]
    length = F.char_length("unit")
    starts = F.when(length.between(1, LONGEST), F.sequence(F.lit(0), length - 1))
    begun = words.select(*others, "unit", F.explode_outer(starts).alias("_start"))
    ends = F.when(F.col("_start").isNotNull(), F.sequence(F.col("_start") + 1, F.least(F.col("_start") + table.longest, length)))
    parts = begun.select(*others, "unit", "_start", F.explode_outer(ends).alias("_end"))
    size = F.col("_end") - F.col("_start")
    parts = parts.withColumn("_piece", F.substr("unit", F.col("_start") + 1, size))
    # The piece table has the size of a vocabulary, whatever the corpus.
    matched = parts.join(F.broadcast(piece_table(words.sparkSession, table)), "_piece", "left")
    alone = F.col("_start").isNull()
    code = packed_edge(F.coalesce("_rank", F.lit((1 << WIDE) - 1)), F.col("_start"), F.col("_end"), F.coalesce("_id", F.lit(-1)))
    edge = F.when(alone, F.when(F.col("unit").isNotNull(), F.lit(-1).cast("bigint"))).otherwise(code)
    first = F.when(alone | (F.col("_end") == 1), F.col("unit"))  # a place is the end of its character, which is always there
    kept = matched.where(alone | F.col("_id").isNotNull() | (size == 1))
    return kept.select(*others, first.alias("unit"), edge.alias("edge"), *["score"] * table.unigram)


def merged(firsts: np.ndarray, word: np.ndarray, code: np.ndarray, start: np.ndarray, end: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places that are still boundaries, as bits, after all merges in order of rank, leftmost first. Every round makes the best
    merge that is possible in each word."""
    one = np.int64(1)
    masks = (one << (lengths + 1)) - 1
    left = np.flatnonzero(end - start > 1)
    word, code, start, end = word[left], code[left], start[left], end[left]
    ends, inner = (one << start) | (one << end), (one << end) - (one << (start + 1))
    never = np.iinfo(np.int64).max
    while len(word):
        mask = masks[word]
        inside = np.bitwise_count(mask & inner)
        # An end that is gone does not come back, nor does the last boundary inside.
        left = ((mask & ends) == ends) & (inside > 0)
        word, code, ends, inner, inside = word[left], code[left], ends[left], inner[left], inside[left]
        if not len(word):
            break
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.minimum.reduceat(np.where(inside == 1, code, never), begin)
        made = np.flatnonzero((code == np.repeat(best, np.diff(np.append(begin, len(word))))) & (inside == 1))
        masks[word[made]] &= ~inner[made]
        going = np.repeat(best < never, np.diff(np.append(begin, len(word))))
        word, code, ends, inner = word[going], code[going], ends[going], inner[going]
    return masks


def best_paths(firsts: np.ndarray, word: np.ndarray, score: np.ndarray, start: np.ndarray, end: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Viterbi: the boundaries of the path with the highest sum of scores, as bits. Of equal paths the one whose last piece is
    longer wins."""
    top = int(lengths.max(initial=0))
    best = np.zeros((len(lengths), top + 1))
    masks = np.ones((len(lengths), top + 1), np.int64)
    for place in range(1, top + 1):
        here = np.flatnonzero(end == place)
        sums = best[word[here], start[here]] + score[here]
        order = np.lexsort((-start[here], sums, word[here]))
        last = order[np.append(word[here][order][1:] != word[here][order][:-1], True)] if len(here) else order
        w = word[here][last]
        best[w, place] = sums[last]
        masks[w, place] = masks[w, start[here][last]] | (np.int64(1) << np.int64(place))
    return masks[np.arange(len(lengths)), lengths]


def folded(units_: pa.Array, firsts: np.ndarray, edges: np.ndarray, score: np.ndarray | None, table: Pieces, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, pieces) of words, from their edges: a word's begin at ``firsts``."""
    counts = np.diff(np.append(firsts, len(edges)))
    word = np.repeat(np.arange(len(firsts)), counts)
    lengths = pc.utf8_length(units_).to_numpy(zero_copy_only=False).astype(np.int64)
    alone = np.flatnonzero(edges[firsts] < 0)
    lengths[alone] = 0
    start, end = (edges >> (WIDE + 6)) & 63, (edges >> WIDE) & 63
    piece = (edges & ((1 << WIDE) - 1)) - 1
    if table.unigram:
        lone = min(s for _, _, s in table.pieces) - 10.0
        shown = edges >= 0
        masks = best_paths(firsts, word[shown], np.where(piece < 0, lone, score)[shown], start[shown], end[shown], lengths)
    else:
        shown = edges >= 0
        masks = merged(firsts, word[shown], edges[shown] >> (WIDE + 6), start[shown], end[shown], lengths)
    one = np.int64(1)
    mask, ends, inner = masks[word], (one << start) | (one << end), (one << end) - (one << (start + 1))
    left = np.flatnonzero((edges >= 0) & ((mask & ends) == ends) & ((mask & inner) == 0))
    left = left[np.lexsort((start[left], word[left]))]
    # In order of word and place: one piece an edge, the bytes of a character without a piece, the library's of a long word.
    at, sizes, values = word[left], np.ones(len(left), np.int64), piece[left]
    if len(alone) or (values < 0).any():
        more = {int(i): octets(units_[int(at[i])].as_py()[int(start[left[i]])], table) for i in np.flatnonzero(values < 0)}
        for i, ids in more.items():
            sizes[i] = len(ids)
        per_word = np.bincount(at, sizes, len(firsts)).astype(np.int64)
        long = {int(w): encode_alone(path, units_[int(w)].as_py()) for w in alone}
        parts: list[np.ndarray] = []
        done = 0
        for i, w, ids in sorted([(i, -1, ids) for i, ids in more.items()] + [(int(np.searchsorted(at, w)), w, ids) for w, ids in long.items()], key=lambda x: (x[0], x[1] < 0, x[1])):
            parts += [values[done:i], np.array(ids, np.int64)]
            done = i + (w < 0)
        values = np.concatenate([*parts, values[done:]])
        for w, ids in long.items():
            per_word[w] = len(ids)
    else:
        per_word = np.bincount(at, minlength=len(firsts))
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(per_word)]), values.astype(np.int32)


def octets(char: str, table: Pieces) -> list[int]:
    """Byte pieces of a character that has no piece, or the unknown piece where the file has none."""
    return [table.unknown] if table.first_byte < 0 else [table.first_byte + b for b in char.encode("utf-8", "surrogatepass")]


def read_lattice(batches: Iterator[pa.RecordBatch], table: Pieces, path: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray] | pa.RecordBatch]:
    """In the order of rows: (words, offsets, pieces) of whole words, and batches of rows without a word."""
    held: list[pa.RecordBatch] = []

    def made(all_: bool) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        rows = pa.Table.from_batches(held).combine_chunks() if held else None
        held.clear()
        if rows is None:
            return
        firsts = np.flatnonzero(rows["unit"].is_valid().to_numpy(zero_copy_only=False))
        whole = rows.num_rows if all_ else int(firsts[-1])  # of the last word there may be more
        if whole < rows.num_rows:
            held.extend(rows.slice(whole).to_batches())
            rows, firsts = rows.slice(0, whole), firsts[:-1]
        if len(firsts):
            words = rows["unit"].drop_null().combine_chunks()
            words = words if isinstance(words, pa.Array) and not isinstance(words, pa.ChunkedArray) else pa.concat_arrays(words.chunks)
            score = rows["score"].fill_null(0.0).to_numpy() if table.unigram else None
            yield words, *folded(words, firsts, rows["edge"].to_numpy(), score, table, path)

    for batch in batches:
        names = ["unit", "edge", *["score"] * table.unigram]
        without = batch.column("edge").is_null().to_numpy(zero_copy_only=False)
        turns = np.flatnonzero(without[1:] != without[:-1]) + 1
        for low, high in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows], strict=True):
            if low == high:
                continue
            if without[low]:
                yield from made(True)
                yield batch.slice(low, high - low)
            else:
                held.append(batch.select(names).slice(low, high - low))
                if sum(b.num_rows for b in held) >= EDGES_AT_ONCE:
                    yield from made(False)
    yield from made(True)


def dictionary(counts: DataFrame, path: str, table: Pieces) -> DataFrame:
    """(unit, ids): the pieces of every word, from its lattice. Words over LONGEST characters, which the boundary bits cannot
    hold, are encoded by the library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, offsets, ids in read_lattice(batches, table, path):
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([words, lists], names=["unit", "ids"])
        given_back()

    return lattice(counts.select("unit").where("unit <> ''"), table).mapInArrow(run, "unit string, ids array<int>")


def encode_alone(path: str, unit: str) -> list[int]:
    """The library's pieces of one word. It puts a space mark before every text; a word without one is encoded after a line end,
    over which no piece reaches."""
    model = library(path)
    if unit.startswith(SPACE):
        return model.encode(unit[1:])
    return model.encode("\n" + unit)[len(model.encode("\n")) :]


def frequent_words(place: str, column: str) -> pa.Array:
    """The words of the table of frequent words, or their pieces, in the order of the table."""

    def load() -> pa.Array:
        store, root = fs.FileSystem.from_uri(place)
        files = sorted(ds.dataset(root, filesystem=store, format="parquet").files)
        if not files:
            return pa.array([], pa.string() if column == "unit" else pa.list_(pa.int32()))
        found = ds.dataset(files, filesystem=store, format="parquet").to_table(columns=[column], use_threads=False)[column]
        return pa.concat_arrays(found.chunks) if found.num_chunks else pa.array([], found.type)

    return worker_table(f"{place} {column}", load)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", unigram: bool = False, frequent: int = FREQUENT, read_back: bool = False) -> DataFrame:
    """(id, ids), with ``read_back`` also the text that the numbers decode to, for every row: the piece numbers of the whole text, as the library gives them without begin or end.

    A null or empty text has no pieces. Repeated rows and null ids are rows like any other; other columns are left out.
    ``unigram`` takes the file's scores as probabilities whatever its kind.
    """
    spark = docs.sparkSession
    table = pieces_of(path, unigram)
    # A word that occurs once is encoded once with or without the table.
    several = (F.col("n") > 1) & (F.char_length("unit") <= LONGEST)
    counts = written(tallied(docs, text_col).where(several), "piece-counts")
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    room, least = frequent, None
    for n, size in sorted(map(tuple, sizes.collect()), reverse=True):
        if size > room:
            break
        room, least = room - size, n
    often = counts.where((F.col("n") >= (least or 0)) & F.lit(least is not None))
    place = scratch_path(spark, "piece-frequent")
    dictionary(often, path, table).write.parquet(place)
    kind = docs.schema[id_col].dataType.simpleString()

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rare words of some texts, then the texts: the numbers of their words, where the rare ones follow the frequent. They
        are bytes, as Spark's time to write null lists grows with the square of their number."""
        known = frequent_words(place, "unit")
        names = ["id", "words", "unit"]
        for batch in batches:
            for low, high in some_texts(batch.column(1), BYTES_AT_ONCE):
                ids = batch.column(0).slice(low, high - low)
                words, offsets, found = cut(batch.column(1).slice(low, high - low))
                number = pc.index_in(words, value_set=known)
                rare = number.is_null()
                number = number.fill_null(0).to_numpy().astype(np.int32)
                lone = np.flatnonzero(rare.to_numpy(zero_copy_only=False))
                number[lone] = len(known) + np.arange(len(lone))
                asked = words.filter(rare)
                bounds = pa.py_buffer((offsets * 4).astype(np.int32))
                listed = pa.Array.from_buffers(pa.binary(), len(ids), [None, bounds, pa.py_buffer(number[found])])
                del words, offsets, found, number, rare, lone
                given_back()
                yield pa.RecordBatch.from_arrays([pa.nulls(len(asked), ids.type), pa.nulls(len(asked), pa.binary()), asked], names=names)
                yield pa.RecordBatch.from_arrays([ids, listed, pa.nulls(len(ids), pa.string())], names=names)
                del asked, listed, bounds, ids
            del batch
        given_back()

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent_words(place, "ids")
        base = np.concatenate([[0], np.cumsum(known.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        offsets, values, after = base, known.flatten().to_numpy(), False
        rare: list[tuple[np.ndarray, np.ndarray]] = []
        for some in read_lattice(batches, table, path):
            if isinstance(some, tuple):
                if after:  # rare words of the next texts
                    rare, after = [], False
                rare.append(some[1:])
                continue
            if not after:
                after = True
                lengths = [np.diff(o) for o, _ in rare]
                offsets = np.concatenate([base, base[-1] + np.cumsum(np.concatenate(lengths))]) if rare else base
                values = np.concatenate([known.flatten().to_numpy(), *(v for _, v in rare)])
            listed = some.column("words")
            _, bounds, numbers = listed.buffers()
            first = np.frombuffer(bounds, np.int32)[listed.offset : listed.offset + len(listed) + 1] // 4
            number = np.frombuffer(numbers, np.int32, first[-1]) if first[-1] else np.zeros(0, np.int32)
            low = 0
            while low < len(listed):
                high = max(low + 1, int(np.searchsorted(first, first[low] + WORDS_AT_ONCE, "right")) - 1)
                at, ids = taken(offsets, values, number[first[low] : first[high]])
                bounds = at[first[low : high + 1] - first[low]]
                columns = [some.column("id").slice(low, high - low), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
                if read_back:
                    columns.append(pa.array([decoded(ids[a:b].tolist(), path) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "text"][: len(columns)])
                low = high
        given_back()

    rows = docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(numbered, f"id {kind}, words binary, unit string")
    return lattice(rows, table).mapInArrow(put_together, f"id {kind}, ids array<int>" + ", text string" * read_back)


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for every row: the library's text of the piece numbers. Null numbers give an empty text; a number that
    the file does not have raises."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decoded(row.as_py(), path) for row in batch.column(1)]  # one text's numbers at a time
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")


@lru_cache(maxsize=2)
def shown_pieces(path: str) -> list[bytes]:
    model = library(path)
    return [shown(model, i) for i in range(model.vocab_size())]


def decoded(ids: list[int] | None, path: str) -> str:
    """The text of one list of piece numbers, without the space that encoding puts first."""
    parts = shown_pieces(path)
    if ids and min(ids) < 0:
        raise IndexError("a piece number below zero")
    joined = b"".join([parts[i] for i in ids or ()])
    return (joined[1:] if joined.startswith(b" ") else joined).decode("utf-8", "replace")


def shown(model: sentencepiece.SentencePieceProcessor, piece: int) -> bytes:
    """The bytes of a piece in a text."""
    name = model.id_to_piece(piece)
    if model.is_byte(piece):
        return bytes([int(name[3:5], 16)])
    if model.is_control(piece):
        return b""
    return " ⁇ ".encode() if model.is_unknown(piece) else name.replace(SPACE, " ").encode()
