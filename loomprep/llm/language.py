"""Language identification by unigrams that are summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. A word can be cut into pieces in many ways;
a forward pass sums the probabilities of all of them. The probabilities come from expectation-maximisation, which weighs
each piece by its share in all segmentations of the training words. A text's score is the posterior over its words.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from loomprep.llm.common import given_back, no_table, some_texts, worker_table, written

SAMPLED = 2048  # distinct training texts per language, drawn by a hash of the text
PLACES = 1 << 62  # range of that hash
ROUNDS = 2  # of expectation-maximisation
ADDED = 0.1  # count added to every piece
SHORT = 32  # characters of a word that is scored together with others
SPAN = 4096  # characters of a long word that train together
LIFT = 100.0  # per character; keeps products of a short word within the range of a double
COUNTED = 1 << 18  # words that a task counts before it passes the counts on
CACHED = 1 << 17  # words of a worker's cache
BYTES_AT_ONCE = 1 << 20  # of texts that are scored together
CHARS_AT_ONCE = 1 << 22
SPACE = "▁"
LETTER = regex.compile(r"\p{L}")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Pieces of a SentencePiece file that stand for text, numbered from 1; 0 is any character without a piece."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = (i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return {model.id_to_piece(i): n for n, i in enumerate(own, 1)}


@lru_cache(maxsize=2)
def tree(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces as a tree of characters: sorted keys (node, character), the node each leads to, the piece of a node."""
    steps: dict[tuple[int, str], int] = {}
    pieces = [0]
    for text, number in vocabulary(path).items():
        node = 0
        for char in text:
            node = steps.setdefault((node, char), len(pieces))
            if node == len(pieces):
                pieces.append(0)
        pieces[node] = number
    keys = np.array([(node << 21) | ord(char) for node, char in steps], np.int64)
    order = np.argsort(keys)
    return keys[order], np.fromiter(steps.values(), np.int64, len(steps))[order], np.array(pieces, np.int64)


def edges(words: list[str], path: str) -> tuple[np.ndarray, ...]:
    """(word, start, end, piece) of every piece at every place of the words, sorted by end. All places go down the tree of
    pieces together, one character at a time."""
    keys, nodes, pieces = tree(path)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    firsts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    ends = (firsts + lengths)[word]
    place, node, out, step = np.arange(len(codes)), np.zeros(len(codes), np.int64), [], 0
    while len(place):
        key = (node << 21) | codes[place + step]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        known = keys[at] == key
        piece = np.where(known, pieces[nodes[at]], 0)
        shown = (piece > 0) | (step == 0)  # a character without a piece is an edge too
        out.append(np.stack([word[place], place - firsts[word[place]], np.full(len(place), step + 1), piece])[:, shown])
        on = known & (place + step + 1 < ends[place])
        place, node, step = place[on], nodes[at[on]], step + 1
    found = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
    found[2] += found[1]
    return tuple(found[:, np.argsort(found[2], kind="stable")])


@dataclass
class Model:
    """Languages, and the probability of each piece (row) in each of them (column)."""

    path: str
    languages: list[str]
    chances: np.ndarray

    def forward(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
        """Sums up to every place of the words, edges and their lifted chances."""
        w, start, end, piece = edges(words, self.path)
        lifted = self.chances[piece] * (LIFT ** (end - start))[:, None]
        lengths = np.array([len(x) for x in words])
        upto = np.zeros((len(words), lengths.max(initial=0) + 1, len(self.languages)))
        upto[:, 0] = 1.0
        bounds = np.searchsorted(end, np.arange(upto.shape[1] + 1))
        for place in range(1, upto.shape[1]):
            part = slice(bounds[place], bounds[place + 1])
            np.add.at(upto[:, place], w[part], upto[w[part], start[part]] * lifted[part])
        return upto, lengths, (w, start, end, piece), lifted

    def logs(self, words: list[str]) -> np.ndarray:
        """Logarithm of each word's chance in each language, summed over its segmentations."""
        marked = [SPACE + x for x in words]
        out = np.empty((len(words), len(self.languages)))
        short = [i for i, x in enumerate(marked) if len(x) <= SHORT]
        if short:
            upto, lengths, _, _ = self.forward([marked[i] for i in short])
            total = upto[np.arange(len(short)), lengths]
            out[short] = np.log(np.maximum(total, 1e-300)) - (lengths * np.log(LIFT))[:, None]
        for i in set(range(len(words))).difference(short):
            out[i] = self.long_log(marked[i])
        return out

    def long_log(self, word: str) -> np.ndarray:
        """The same for a word of any length: only the last sums are kept, rescaled on the way."""
        pieces = vocabulary(self.path)
        longest = max(map(len, pieces))
        last, scale = [np.ones(len(self.languages))], np.zeros(len(self.languages))
        for place in range(1, len(word) + 1):
            total = np.zeros(len(self.languages))
            for back in range(1, min(longest, place, len(last)) + 1):
                piece = pieces.get(word[place - back : place], 0 if back == 1 else None)
                if piece is not None:
                    total = total + last[-back] * self.chances[piece]
            last = [*last[1 - longest :], total]
            if place % 8 == 0:
                top = np.maximum(total, 1e-200)
                last, scale = [x / top for x in last], scale + np.log(top)
        return np.log(np.maximum(last[-1], 1e-300)) + scale

    def expected(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Expected number of each piece in each language, for words that occur ``times`` in each."""
        upto, lengths, (w, start, end, piece), lifted = self.forward([SPACE + x for x in words])
        onward = np.zeros_like(upto)
        onward[np.arange(len(words)), lengths] = 1.0
        order = np.argsort(-start, kind="stable")
        bounds = np.searchsorted(-start[order], -np.arange(upto.shape[1])[::-1])
        bounds = np.append(bounds, len(order))
        for number, place in enumerate(range(upto.shape[1] - 1, -1, -1)):
            part = order[bounds[number] : bounds[number + 1]]
            np.add.at(onward[:, place], w[part], onward[w[part], end[part]] * lifted[part])
        total = upto[np.arange(len(words)), lengths]
        share = upto[w, start] * lifted * onward[w, end] * (times / np.maximum(total, 1e-300))[w]
        return np.stack([np.bincount(piece, share[:, i], len(self.chances)) for i in range(share.shape[1])], axis=1)


    def expected_long(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """The same for words of any length, from logarithms of the sums. Words over SPAN characters go span by span."""
        spans, owners = [], []
        for i, word in enumerate(words):
            marked = SPACE + word
            for low in range(0, len(marked), SPAN):
                spans.append(marked[low : low + SPAN])
                owners.append(i)
        total = np.zeros_like(self.chances)
        part: list[int] = []
        for i in sorted(range(len(spans)), key=lambda i: len(spans[i])):
            if part and (len(part) + 1) * len(spans[i]) * len(self.languages) > CHARS_AT_ONCE >> 3:
                total += self.log_shares([spans[j] for j in part], times[[owners[j] for j in part]])
                part = []
            part.append(i)
        return total + self.log_shares([spans[j] for j in part], times[[owners[j] for j in part]]) if part else total

    def log_shares(self, spans: list[str], times: np.ndarray) -> np.ndarray:
        """Expected number of each piece. A sum is kept as a logarithm and worked out against that of the place beside it,
        so that no product leaves the range of a double: every place is reached by one character at least."""
        w, start, end, piece = edges(spans, self.path)
        lengths = np.array([len(x) for x in spans])
        longest = int(lengths.max())
        logs = np.log(self.chances)
        upto = np.zeros((len(spans), longest + 1, len(self.languages)))
        bounds = np.searchsorted(end, np.arange(longest + 2))
        for place in range(1, longest + 1):
            part = slice(bounds[place], bounds[place + 1])
            beside = upto[:, place - 1]
            total = np.zeros_like(beside)
            np.add.at(total, w[part], np.exp(upto[w[part], start[part]] + logs[piece[part]] - beside[w[part]]))
            upto[:, place] = beside + np.log(np.where(total > 0, total, 1.0))
        onward = np.zeros_like(upto)
        order = np.argsort(start, kind="stable")
        bounds = np.searchsorted(start[order], np.arange(longest + 1))
        for place in range(longest - 1, -1, -1):
            part = order[bounds[place] : bounds[place + 1]]
            beside = onward[:, place + 1]
            total = np.zeros_like(beside)
            np.add.at(total, w[part], np.exp(onward[w[part], end[part]] + logs[piece[part]] - beside[w[part]]))
            onward[:, place] = beside + np.log(np.where(total > 0, total, 1.0))
        whole = upto[np.arange(len(spans)), lengths]
        share = np.exp(upto[w, start] + logs[piece] + onward[w, end] - whole[w]) * times[w]
        return np.stack([np.bincount(piece, share[:, i], len(self.chances)) for i in range(share.shape[1])], axis=1)


def folded(id_col: str) -> Column:
    """Remainder of the document number's checksum, which tells training from held-out documents."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def word_counts(labelled: DataFrame, languages: list[str]) -> DataFrame:
    """(word, lang, n) of the (text, lang) rows."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[str, int]] = Counter()

        def rows() -> pa.RecordBatch:
            keys = list(found)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["word", "lang", "n"])

        no_table()
        number = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in Counter(text.split()).items():
                    found[word, number[lang]] += n
                if len(found) > COUNTED:
                    yield rows()
                    found.clear()
        yield rows()
        found.clear()
        given_back()

    return labelled.mapInArrow(tally, "word string, lang int, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def below(limits: dict[str, int]) -> Column:
    """Whether the place of a row lies under the limit of its language."""
    limit = F.lit(0)
    for lang, most in limits.items():
        limit = F.when(F.col("lang") == lang, most).otherwise(limit)
    return F.col("place") < limit


def last_places(labelled: DataFrame, sizes: dict[str, int], sampled: int) -> dict[str, int]:
    """For each language the place under which its ``sampled`` first distinct texts lie. ``sizes`` are estimates; they only
    bound what is brought together, about twice the sample."""
    open_, out = {lang: int(min(1.0, 2 * sampled / max(n, 1)) * PLACES) for lang, n in sizes.items()}, {}
    while open_:
        found: dict[str, list[int]] = {lang: [] for lang in open_}
        for r in labelled.where(below(open_)).select("lang", "place").distinct().toLocalIterator():
            found[r["lang"]].append(r["place"])
        for lang, places in found.items():
            if len(places) >= sampled:
                out[lang] = sorted(places)[sampled - 1] + 1
            elif open_[lang] >= PLACES:
                out[lang] = PLACES
        open_ = {lang: min(PLACES, 2 * most) for lang, most in open_.items() if lang not in out}
    return out


def train(docs: DataFrame, path: str, use: Column, text_col: str = "text", lang_col: str = "lang", sampled: int = SAMPLED, rounds: int = ROUNDS) -> Model:
    """Model of the languages of the rows in ``use``, from the ``sampled`` distinct texts of each with the smallest hashes.

    Words of any length train; those over ``SPAN`` characters span by span. The driver holds a number per piece and
    language, and so do the workers.
    """
    labelled = docs.where(use & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = labelled.withColumn("place", F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(PLACES)))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("place").alias("n")).collect()}
    languages = sorted(sizes)
    pieces = vocabulary(path)
    model = Model(path, languages, np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1)))
    if not languages:
        return model
    last = last_places(labelled, sizes, sampled)
    drawn = labelled.where(below(last)).select("text", "lang").distinct()
    counts = written(word_counts(drawn, languages), "language-words")
    dealt = counts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            no_table()
            own: Model = shared.value
            total = np.zeros_like(own.chances)
            for batch in batches:
                for low in range(0, batch.num_rows, 4096):
                    part = batch.slice(low, 4096)
                    times = np.zeros((part.num_rows, len(own.languages)))
                    times[np.arange(part.num_rows), part.column(1).to_numpy()] = part.column(2).to_numpy()
                    words = part.column(0).to_pylist()
                    short = np.array([len(x) < SHORT for x in words])
                    for chosen, sums in ((short, own.expected), (~short, own.expected_long)):
                        if chosen.any():
                            total += sums([words[i] for i in np.flatnonzero(chosen)], times[chosen])
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], names=["piece", "lang", "n"])
            given_back()

        found = dealt.mapInArrow(expect, "piece bigint, lang bigint, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        total = np.full_like(model.chances, ADDED)
        total[found["piece"], found["lang"]] += np.round(found["n"], 6)
        model = Model(path, languages, total / total.sum(axis=0))
    return model


class Scorer:
    """A worker's model and the logarithms of words that it has met in several texts, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.known, self.rows = model, {}, np.zeros((0, len(model.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        counters = [Counter(t.split()) if t and LETTER.search(t) else None for t in texts]
        met = Counter(w for c in counters if c for w in c if w not in self.known) if self.model.languages else Counter()
        new = [w for w, n in met.items() if n > 1]
        room = min(len(new), CACHED - len(self.known))
        new += [w for w, n in met.items() if n == 1]
        place = {w: len(self.rows) + i for i, w in enumerate(new)}
        known = self.known.get
        rows = np.concatenate([self.rows, *(self.model.logs(new[i : i + 4096]) for i in range(0, len(new), 4096))])
        for counter in counters:
            if counter is None or not self.model.languages:
                names.append("und")
                scores.append(0.0)
                continue
            at = np.fromiter(map(known, counter, repeat(-1)), np.int64, len(counter))
            if len(missing := np.flatnonzero(at < 0)):
                words = list(counter)
                at[missing] = [place[words[i]] for i in missing]
            total = np.fromiter(counter.values(), np.float64, len(counter)) @ rows[at]
            chance = np.exp(total - total.max())
            best = int(total.argmax())
            names.append(self.model.languages[best])
            scores.append(float(chance[best] / chance.sum()))
        if room:
            self.known.update((w, place[w]) for w in new[:room])
            self.rows = rows[: len(self.known)].copy()
        return names, scores


def identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior; columns that have these names already are replaced.

    A text that is null or has no letter is ``und`` with score 0, as is every text when nothing was learned. Ties go to the
    language that is first by name.
    """
    kept = docs.select(*[c for c in docs.columns if c not in (lang_col, score_col)])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    number = uuid.uuid4().hex  # of this call, by which a worker knows its scorer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_table(number, lambda: Scorer(shared.value))
        for batch in batches:
            for low, high in some_texts(batch.column(text_col), BYTES_AT_ONCE):
                part = batch.slice(low, high - low)
                names, scores = scorer.predict(part.column(text_col).to_pylist())
                columns = [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, lang_col, score_col])
        given_back()

    schema = StructType([*kept.schema.fields, StructField(lang_col, StringType()), StructField(score_col, DoubleType())])
    return kept.mapInArrow(run, schema)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row, from the text alone. Repeated rows and null ids are rows like any other."""
    return identified(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
