"""Token counts without shuffling words: a broadcast table of frequent pre-token lengths, worker caches for the rest.

Byte-level BPE cuts a text into pre-tokens and encodes each by itself, so a text's count is the sum over its pre-tokens.
The lengths of the most frequent ones (of a bounded sample; they only save time) are broadcast. A single space between two
other characters always begins a pre-token, so a text is cut there first: the number of tokens of a stretch between two such
spaces is kept in a cache of the worker. A stretch that is not there is cut into pre-tokens, and those that are not in the
broadcast table are encoded by the library. Both caches are bounded.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

FREQUENT = 1 << 16  # entries of the broadcast table
LONGEST_KEPT = 32  # characters; longer pre-tokens enter neither table, which bounds both
CACHED = 1 << 18  # entries of a worker's cache
SAMPLED = 4096  # documents that the table of frequent pre-tokens is drawn from
COUNTED_AT_ONCE = 1 << 20  # characters of a text cut up in one go

# White space to the library is white space here too.
SPACE = re.compile(r"(?<=\S) (?=\S)")

# Fixed value: the pattern by which byte-level BPE cuts text.
PRE_TOKENS = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)


@lru_cache(maxsize=2)
def loaded(path: str) -> tuple[Tokenizer, regex.Pattern | None]:
    """The library's tokenizer and the pattern of its special strings; raises where counts would not add up."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; handing words to threads costs more than it saves
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    cut = parts["pre_tokenizer"] or {}
    if parts["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError(f"{path}: only byte-level BPE without normalizer or prefix space is counted by pre-tokens")
    special = parts["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
        raise ValueError(f"{path}: special tokens that take in their surroundings are not handled")
    names = sorted((t["content"] for t in special), key=len, reverse=True)
    return tokenizer, regex.compile("|".join(map(regex.escape, names))) if names else None


def pieces_of(text: str) -> Iterator[str]:
    """Pre-tokens of a text without special strings, one after the other: a long text is never cut up at once."""
    if len(text) <= COUNTED_AT_ONCE:
        yield from PRE_TOKENS.findall(text)
    else:
        for found in PRE_TOKENS.finditer(text):
            yield found.group()


def stretches(text: str) -> Iterator[list[str]]:
    """The text cut at its single spaces, in lists of bounded length; every stretch but the very first lost a space."""
    low = 0
    while len(text) - low > COUNTED_AT_ONCE:
        cut = SPACE.search(text, low + COUNTED_AT_ONCE)
        if cut is None:
            break
        yield SPACE.split(text[low : cut.start()])
        low = cut.end()
    yield SPACE.split(text[low:] if low else text)


class Lengths:
    """Numbers of tokens: of pre-tokens by the broadcast table and a cache, of stretches by a cache of their own."""

    def __init__(self, path: str, frequent: dict[str, int]) -> None:
        self.tokenizer, self.special = loaded(path)
        self.frequent, self.pieces, self.known, self.passed = frequent, {}, {}, 0

    def encoded(self, pieces: list[str]) -> None:
        """Ask the library for pre-tokens that neither table has."""
        for piece, made in zip(pieces, self.tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True):
            self.pieces[piece] = len(made.ids)

    def learn(self, wanted: list[str]) -> list[int]:
        """Numbers of tokens of texts; those of their pre-tokens come from the table, the cache or the library."""
        if sum(map(len, wanted)) > COUNTED_AT_ONCE and len(wanted) > 1:
            return [self.learn([text])[0] for text in wanted]
        if len(wanted) == 1 and len(wanted[0]) > COUNTED_AT_ONCE:
            return [self.long(wanted[0])]
        frequent, pieces = self.frequent, self.pieces
        cut = list(map(PRE_TOKENS.findall, wanted))
        missing = {p for found in cut for p in found if p not in frequent and p not in pieces}
        if missing:
            if len(pieces) > CACHED:  # what was emptied is asked for again
                pieces.clear()
                missing = {p for found in cut for p in found if p not in frequent}
            self.encoded(list(missing))
        out = [sum([frequent.get(p) or pieces[p] for p in found]) for found in cut]
        for piece in missing:
            if len(piece) > LONGEST_KEPT:
                del pieces[piece]
        return out

    def long(self, text: str) -> int:
        total, found = 0, pieces_of(text)
        while some := list(islice(found, CACHED)):
            total += sum(len(made.ids) for made in self.tokenizer.encode_batch(some, add_special_tokens=False))
        return total

    def of(self, text: str) -> int:
        total, parts = 0, [text]
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            first = True
            for cut in stretches(part):
                if first and cut[0]:
                    total += self.learn([cut[0]])[0]
                rest = cut[1:] if first else cut
                first = False
                new = {s for s in rest if s not in self.known}
                if new:
                    if self.passed > CACHED:
                        self.known.clear()
                        self.passed, new = 0, set(rest)
                    asked = list(new)
                    self.known.update(zip(asked, self.learn([" " + s for s in asked]), strict=True))
                total += sum(map(self.known.__getitem__, rest))
                # A full cache keeps what it has, which is mostly what is frequent, until as many others have passed by.
                full = len(self.known) > CACHED
                self.passed += len(new) if full else 0
                for s in new:
                    if full or len(s) > LONGEST_KEPT:
                        del self.known[s]
        return total


def counted(path: str, texts: list[str], frequent: dict[str, int], cache: dict[str, int]) -> list[int]:
    """Number of tokens of each text, with a table of frequent pre-tokens and a cache of others."""
    lengths = Lengths(path, frequent)
    lengths.pieces = cache
    return [lengths.of(text) for text in texts]


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text", entries: int = FREQUENT, sampled: int = SAMPLED) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of at most about ``sampled`` documents, evenly drawn by a hash of the text.

    A pre-token of another text than these is found by the workers, so the sample changes the time only.
    """
    rows = docs.where(F.col(text_col).isNotNull()).count()
    if not rows:
        return {}
    share = min(1.0, sampled / rows)
    part = docs.where(F.col(text_col).isNotNull() & (F.pmod(F.xxhash64(text_col, F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(p for p in pieces_of(text.as_py()) if len(p) <= LONGEST_KEPT)
        top = found.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    tallied = part.select(text_col).mapInArrow(tally, "piece string, n bigint")
    top = tallied.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(entries)
    pieces = [r["piece"] for r in top.collect()]
    tokenizer, _ = loaded(path)
    return {p: len(e.ids) for p, e in zip(pieces, tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True)}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row, as the library counts the whole text.

    A null text counts as empty: no bytes, no tokens. Repeated rows give repeated rows, null ids stay null, other columns
    are left out. ``path`` must name the same tokenizer file on every executor.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_lengths(docs, path, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(path, shared.value)
        for batch in batches:
            n = [lengths.of(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    made = slim.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return made.withColumn("over_limit", F.col("n_tokens") > limit)
