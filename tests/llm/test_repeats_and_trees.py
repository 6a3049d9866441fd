"""Suffix sorting, repeated strings, the prefix trie and the target draw against brute force."""

import hashlib
import math
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomprep.llm import repeats, resample as draw, suffixes
from loomprep.llm.common import scanned
from loomprep.llm.queries import rebuilt
from loomprep.llm.repeats import repeated_bytes
from loomprep.llm.resample import resample
from loomprep.llm.trie import list_sums, placed_turns, prefix_trie


def sorted_suffixes(text, depth, memory=1 << 20, want=None):
    with tempfile.TemporaryDirectory() as folder:
        blocks = list(suffixes.suffixes(suffixes.Space(folder, memory), np.array(text), depth, want))
    return [np.concatenate(c).tolist() for c in zip(*blocks, strict=True)]


def shared(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize(("memory", "block"), [(1 << 20, 1 << 20), (200, 16)])
def test_suffixes_are_in_order_with_their_common_prefixes(memory, block, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    rng = np.random.default_rng(5)
    for turn in range(150):
        n, symbols, depth = int(rng.integers(1, 120)), int(rng.integers(1, 5)), int(rng.integers(1, 60))
        text = rng.integers(0, symbols, n).tolist()
        if turn % 3 == 0:
            text = (text[: max(1, n // 4)] * 8)[: n + 20]
        if turn % 7 == 0:
            text = [3] * n
        want = None if turn % 2 else rng.random(len(text)) < 0.4
        places = range(len(text)) if want is None else np.flatnonzero(want).tolist()
        if not len(places):
            continue
        index, common = sorted_suffixes(text, depth, memory, want)
        assert sorted(index) == list(range(len(places)))
        keys = [tuple(text[places[i] : places[i] + depth]) for i in index]
        assert keys == sorted(keys)
        assert common[1:] == [shared(a, b) for a, b in zip(keys, keys[1:], strict=False)]


def test_a_queue_merges_its_runs():
    rng = np.random.default_rng(1)
    with tempfile.TemporaryDirectory() as folder:
        queue = suffixes.Queue(suffixes.Space(folder, 5000))
        key, sub = rng.integers(0, 9, 30_000).astype(np.uint64), rng.integers(0, 99, 30_000).astype(np.uint64)
        for low in range(0, 30_000, 700):
            queue.push(key[low : low + 700], sub[low : low + 700], np.arange(low, min(low + 700, 30_000)))
        assert len(queue.runs) > 20
        rows = [np.concatenate(c) for c in zip(*queue.pop(), strict=True)]
    assert sorted(rows[2].tolist()) == list(range(30_000))
    assert list(zip(rows[0], rows[1], strict=True)) == sorted(zip(key, sub, strict=True))
    assert (key[rows[2]] == rows[0]).all() and (sub[rows[2]] == rows[1]).all()


def plain_repeats(rows, length):
    """Covered byte ranges of every row, by looking up all strings."""
    first, out = {}, []
    for i, text in rows:
        if i is not None:
            for at in range(len(text) - length + 1):
                s = text[at : at + length]
                first[s] = min(first.get(s, i), i)
    for i, text in rows:
        gone = [False] * len(text)
        for at in range(len(text) - length + 1):
            if i is not None and first[text[at : at + length]] < i:
                gone[at : at + length] = [True] * length
        edges = [k for k in range(len(text) + 1) if (k > 0 and gone[k - 1]) != (k < len(text) and gone[k])]
        out.append((i, len(text), list(zip(edges[::2], edges[1::2], strict=True)), bytes(b for b, g in zip(text, gone, strict=True) if not g)))
    return out


def found_repeats(df, **options):
    return [(r["id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in repeated_bytes(df, **options).collect()]


def by_text(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_repeated_bytes_are_those_of_brute_force(spark, small, monkeypatch):
    if small:  # several packs, parts, shards and runs on disk
        for name, value in {"PACK": 700, "STRINGS_AT_ONCE": 64, "SHARE": 9, "TOGETHER": 500}.items():
            monkeypatch.setattr(repeats, name, value)
        monkeypatch.setattr(suffixes, "BLOCK", 128)
    rng = np.random.default_rng(3)
    passages = ["".join(rng.choice(list("abcdefgh .é日"), 90)) for _ in range(6)]
    texts = [None, "", "short", "-" * 400, "=" * 49, "ab" * 120, passages[0], passages[0], passages[0][:60], "x" + passages[0][1:61] + "y"]
    texts += ["-" * 70 + passages[1], "ba" * 60, passages[2] * 3]
    for _ in range(40):
        picked = [passages[k][: int(rng.integers(45, 91))] for k in rng.integers(0, 6, 3)]
        texts.append("".join(rng.choice(list("xyz"), int(rng.integers(0, 80)))) + " ".join(picked))
    ids = [(7 * i) % 59 - 5 for i in range(len(texts))]
    ids[9], ids[12], ids[20], ids[21] = None, None, ids[13], ids[13]  # null ids, an id of three texts
    rows = [*zip(ids, texts, strict=True), (ids[13], texts[13]), (ids[6], texts[6])]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id bigint, text string, pack string, spans int").repartition(5)
    want = plain_repeats([(i, (t or "").encode()) for i, t in rows], 50)
    assert any(len(w[2]) > 1 for w in want)
    options = {"memory": 300} if small else {}
    assert by_text(found_repeats(df, **options)) == by_text(want)
    if not small:
        assert found_repeats(df.limit(0)) == []
        short = plain_repeats([(i, (t or "").encode()) for i, t in rows], 8)
        assert by_text(found_repeats(df, length=8)) == by_text(short)


def test_places_and_running_sums_over_all_rows(spark):
    rows = [(i % 7 if i % 5 else None, i * 977) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, h bigint").repartition(6)
    got = sorted(scanned(df, [F.col("k").asc_nulls_first()], ["h"]).collect(), key=lambda r: r["number"])
    assert [r["number"] for r in got] == list(range(1, 501))
    assert [r["k"] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    total = 0
    for r in got:
        total ^= r["h"]
        assert r["h_up_to"] == total
    assert scanned(df.limit(0), [F.col("k")], ["h"]).count() == 0


@pytest.mark.parametrize("core", [1, 5, 10_000])
def test_sums_before_every_arc_of_a_list(spark, core):
    rng = np.random.default_rng(2)
    order, weight = rng.permutation(60).tolist(), rng.integers(0, 9, 60).tolist()
    rows = [(a, b, weight[a], 1) for a, b in zip(order, [*order[1:], None], strict=True)]
    got = {r["arc"]: (r["w"], r["n"]) for r in list_sums(spark.createDataFrame(rows, "arc bigint, succ bigint, w bigint, n bigint"), ["w", "n"], core).collect()}
    total = 0
    for i, a in enumerate(order):
        assert got[a] == (total, i)
        total += weight[a]


def plain_trie(sequences):
    """Nodes of {conv: [(role, text), ...]} as the query returns them."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    kids = Counter(k[:-1] for k in members if k)
    out = []
    for key, own in members.items():
        below = [k for k in members if k[: len(key)] == key]
        digest = hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest()
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k)
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), kids[key], sum(not kids[k] for k in below), saved, digest))
    return sorted(out, key=repr)


def found_trie(df):
    names = ["conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, node string, conv int"


@pytest.mark.parametrize("core", [3, 4096])
def test_the_trie_is_that_of_brute_force(spark, core):
    rng = np.random.default_rng(4)
    rows = []
    for conv in [*range(95, 125), 300, 301, 405]:
        for turn in range(int(rng.integers(0, 6))):
            rows.append((conv, turn, ["user", "assistant", None][int(rng.integers(0, 3))] if turn > 2 else "user", ["hi", "", None, "日本"][int(rng.integers(0, 2 + turn % 3))]))
    rows += [(7, t, "user", "hi") for t in range(12)] + [(8, None, "user", "first"), (8, 0, "user", "second"), (8, 0, "user", "second"), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS).repartition(4)
    placed = placed_turns(df).cache()
    convs = spark.createDataFrame([(c,) for c in {r[0] for r in rows if r[0] is not None} | {999}] + [(999,), (None,)], "conv bigint")
    own = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        own[conv].append((role or "", text or ""))
    want = plain_trie({**own, 999: []})
    assert found_trie(prefix_trie(placed, convs, core)) == want
    if core == 3:
        return
    assert prefix_trie(placed.limit(0), convs.limit(0)).count() == 0
    assert found_trie(prefix_trie(placed.limit(0), convs.where("conv = 999"))) == plain_trie({999: []})
    made = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 6, own.get(c - c % 100, [])
        made[c] = base[:h] + own[c][h:]
    known = placed.select("conv").distinct()
    assert found_trie(prefix_trie(rebuilt(placed, known), known)) == plain_trie(made)


def plain_draw(docs, target, longest, buckets, per_cent, least_words):
    def features(text):
        words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
        return words, [zlib.crc32(b" ".join(words[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        words, own = features(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: len(able) * per_cent // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize(("longest", "at_once"), [(1, 1 << 22), (3, 1 << 22), (3, 40), (1, 3)])
def test_the_draw_is_that_of_brute_force(spark, longest, at_once, monkeypatch):
    monkeypatch.setattr(draw, "JOINED_AT_ONCE", at_once)
    monkeypatch.setattr(draw, "WORDS_AT_ONCE", max(2, at_once // 10))
    monkeypatch.setattr(draw, "KNOWN", 5)
    rng = np.random.default_rng(6)
    vocabulary = ["The", "ÄPFEL", "x_y", "日本語", "a1", "naïve", "\x00z", "don't", "--", "Q"]
    docs = [(None, "a b c"), (3, None), (4, ""), (5, "... !"), (6, "a b c d"), (6, "a b c d"), (2, "word " * 300)]
    docs += [(10 + i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 40))))) for i in range(40)]
    target = ["the äpfel don't", None, "Q Q Q a1"]
    frame = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id bigint, text string, rank int, score string").repartition(4)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    options = {"longest": longest, "buckets": 97, "per_cent": 30, "least_words": 3}
    got = sorted((tuple(r[c] for c in ("id", "n_features", "weight", "score", "rank")) for r in resample(frame, wanted, **options).collect()), key=repr)
    assert got == plain_draw(docs, target, **options)
    if longest == 1:
        assert resample(frame.limit(0), wanted).count() == 0
        none = resample(frame, wanted.limit(0), **options).collect()
        assert len(none) == len(docs)
