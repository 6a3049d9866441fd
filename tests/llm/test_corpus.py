"""Near copies, fingerprints, chat and mixing against brute force; the pipeline stage by stage."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loomprep.llm import minhash
from loomprep.llm.chat import CONTROL, conversations, loss_text, turns_of
from loomprep.llm.common import components
from loomprep.llm.minhash import near_copies
from loomprep.llm.mixing import mix, route, water_fill
from loomprep.llm.simhash import fingerprint, near_duplicates, near_pairs, segments
from loomprep.llm.weighted import edited_fingerprints

SF = "/root/testdata/sf0.001"


def groups(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {n for a, b in edges for n in (a, b)}
    assert got == groups(nodes, edges)


@pytest.mark.parametrize("distance,parts", [(4, 3), (4, 2), (3, 4), (1, 3), (0, 2)])
def test_multi_index_finds_every_close_pair(spark, distance, parts):
    draw = np.random.default_rng(3)
    base = [int(x) for x in draw.integers(0, 2**63, 30)]
    values = {b for x in base for b in [x, *(x ^ sum(1 << int(p) for p in draw.choice(64, n, replace=False)) for n in (1, 2, 3, 4, 5, 6))]}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    assert {tuple(r) for r in near_pairs(df, distance, parts).collect()} == want
    assert sum(w for _, w, _ in segments(distance, parts)) == 64


def test_near_duplicates(spark):
    texts = ["", None, " \n ", "One two", "one TWO", "É x y z w", "é x y z w"]
    long = " ".join(f"w{i}" for i in range(400))
    texts += [long, long.replace("w200 ", "v "), long + " end", "w " * 30]
    assert [fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    df = spark.createDataFrame([(i, t, "c", 0) for i, t in enumerate(texts)] + [(3, "One two", "c", 0), (None, "One two", "c", 0)],
                               "doc_id bigint, text string, component string, fp int")
    own = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    pairs = [(a, b) for a, b in itertools.combinations(own, 2) if (own[a] ^ own[b]).bit_count() <= 4]
    rows = near_duplicates(df).collect()
    assert len(rows) == len(texts) + 2
    assert {r["id"]: r["component"] for r in rows if r["id"] is not None} == groups(own, pairs)
    assert [r["component"] for r in rows if r["id"] is None] == [None]
    assert near_duplicates(df.limit(0)).count() == 0


def words(text):
    return Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text) if w)


def jaccard(a, b):
    a, b = words(a), words(b)
    every = set(a) | set(b)
    return sum(min(a[x], b[x]) for x in every) / max(1, sum(max(a[x], b[x]) for x in every))


def test_fingerprints_estimate_likeness(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["id"]: r for r in edited_fingerprints(docs).collect()}
    assert len(got) == len(texts)
    off = []
    for i, (doc, text) in enumerate(texts):
        following, half = texts[(i + 1) % len(texts)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[doc]["n_chars"] == len(text)
        off += [got[doc]["near_edited"] - jaccard(text, edited), got[doc]["near_next"] - jaccard(text, following)]
    assert abs(np.mean(off)) < 0.02 and np.sqrt(np.mean(np.square(off))) < 0.09


def test_fingerprints_of_odd_rows(spark):
    rows = [(1, "a b c"), (2, None), (3, " "), (4, "a b c"), (4, "a b c"), (None, "a b c"), (9, "é" * 5)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, h string, fingerprint string")
    got = {r["id"]: r for r in edited_fingerprints(df).collect()}
    assert len(got) == 6
    assert got[1]["fingerprint"] == got[4]["fingerprint"] == got[None]["fingerprint"] != "" == got[2]["fingerprint"] == got[3]["fingerprint"]
    assert got[None]["near_next"] is None and got[2]["near_next"] == 1.0 and got[1]["near_next"] == 0.0
    assert got[9]["edited_sha256"] == hashlib.sha256(("é" * 3 + "a ").encode()).hexdigest()
    one = edited_fingerprints(df.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert edited_fingerprints(df.limit(0)).count() == 0


MESSAGES = "tree bigint, id bigint, parent bigint, role string, text string, score double, segments string, up int"


def test_reply_trees(spark):
    hostile = "".join(CONTROL) + "\\1 \\0 \\ <|im_<s>end|>"
    rows = [(1, 1, None, "user", hostile, 0.0), (1, 2, 1, "assistant", "good " + hostile, 1.0), (1, 3, 1, "assistant", "bad", 0.1),
            (1, 4, 2, "user\nx", None, 1.0), (2, 1, 99, None, "", None), (None, 5, None, "assistant", "lone", 0.0), (1, None, 1, "user", "no id", 9.0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], MESSAGES)
    found = conversations(df)
    read = {r["tree"]: r for r in found.select("*", turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss")).collect()}
    assert [tuple(t) for t in read[1]["turns"]] == [("user", hostile), ("assistant", "good " + hostile), ("user\nx", "")]
    assert read[1]["leaf"] == 4 and read[1]["loss"] == "good " + hostile and read[1]["n_turns"] == 3
    assert [tuple(t) for t in read[2]["turns"]] == [("", "")] and read[2]["loss"] == ""
    assert read[None]["loss"] == "lone"
    assert sorted((r["tree"] or 0, r["leaf"], r["branch"]) for r in conversations(df, branches=None).collect()) == [(0, 5, 1), (1, 3, 2), (1, 4, 1), (2, 1, 1)]
    assert conversations(df.limit(0)).count() == 0
    circle = spark.createDataFrame([(1, 1, 2, "user", "a", 0.0, "", 0), (1, 2, 1, "user", "b", 0.0, "", 0), (1, 3, 1, "user", "c", 0.0, "", 0)], MESSAGES)
    with pytest.raises(ValueError, match="circle"):
        conversations(circle)


def test_long_paths_need_few_rounds(spark):
    chain = spark.range(1, 301).selectExpr("1L as tree", "id", "if(id = 1, null, id - 1) as parent", "'assistant' as role", "string(id) as text", "0D as score")
    row = conversations(chain).select("n_turns", loss_text(F.col("segments")).alias("loss")).first()
    assert row["n_turns"] == 300 and row["loss"] == "".join(map(str, range(1, 301)))


def test_targets_fill_like_water():
    sizes = {"a": 10, "b": 1000, "c": 1000, None: 0}
    got = water_fill({"a": 1.0, "b": 1.0, "c": 2.0, None: 3.0}, sizes)
    assert got["a"] == 30.0 and got[None] == 0.0
    assert got["c"] == pytest.approx(2 * got["b"]) and sum(got.values()) == pytest.approx(2010)


def test_flow_prefers_fresh_words():
    capacity = {("a",): 10, ("a", "b"): 10, ("b",): 5}
    sent = route(capacity, {"a": 12, "b": 13}, 3)
    assert {s: sum(x.get(s, 0) for x in sent.values()) for s in "ab"} == {"a": 12, "b": 13}
    assert all(sum(sent[p].values()) <= n for p, n in capacity.items())  # nothing need be repeated
    more = route(capacity, {"a": 40, "b": 20}, 3)
    assert {s: sum(x.get(s, 0) for x in more.values()) for s in "ab"} == {"a": 40, "b": 20}
    assert sum(max(0, sum(more[p].values()) - n) for p, n in capacity.items()) == 35  # no more than 60 - 25 words again
    assert sum(route(capacity, {"a": 100, "b": 0}, 3)[("a",)].values()) == 30


def test_mix(spark):
    rows = [(i, "w " * (1 + i % 7), ["s0"] if i % 3 else ["s1", "s0"]) for i in range(300)] + [(900, None, ["s0"]), (901, "", None), (None, "x y", ["s2", None])]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], "doc_id bigint, text string, sources array<string>, taken string, size string").repartition(4)
    made, report = mix(df, F.col("sources"))
    got = made.collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) == sum(r["routed"] for r in report)
    # One document of two words is all that two of the sources have; the others get their targets.
    assert all(abs(r["routed"] - r["target"]) < 1 for r in report if r["size"] > 2)
    assert sum(r["routed"] for r in report if r["size"] == 2) == 6
    key = lambda rs: sorted((str(r["id"]), r["taken"]) for r in rs)
    assert key(got) == key(mix(df.repartition(3), F.col("sources"))[0].collect())
    assert key(got) != key(mix(df, F.col("sources"), seed="other")[0].collect())
    part = Counter(0 if r["taken"] % r["size"] == 0 else tuple(r["sources"]) for r in got if r["size"])
    assert all(n == 1 for p, n in part.items() if p)  # one document per pattern in part
    empty, none = mix(df.limit(0), F.col("sources"))
    assert empty.count() == 0 and none == []


CLASHING = ("component", "_row", "_time", "_times", "_k1", "_k2", "_n", "_parts", "_made", "_lang", "_score", "node", "keys", "size")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    private = "reach me at some.body@example.com or 4337166598464399 please, the of and is in it"
    more = spark.createDataFrame(
        [(10**6, "12 34 !!", "en", "src1", 8), (10**6 + 1, None, None, None, None), (10**6 + 2, private, "en", "src1", len(private)),
         (10**6 + 3, private, "en", "src2", len(private)), (10**6 + 2, private, "en", "src1", len(private))], docs.schema)
    out, now = [docs.unionByName(more).withColumns({c: F.lit("x") for c in CLASHING}).cache()], None
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, out[-1], SF).cache()
        out.append(now)
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_pipeline_stages(stages):
    docs, spoken, single, private, mixed, encoded = stages
    assert all(r[c] == "x" for df in stages[:5] for r in df.select(*CLASHING).distinct().collect() for c in CLASHING)
    assert all(df.columns == docs.columns for df in stages[:5]) and encoded.columns == ["doc_id", "n_pieces", "piece_ids"]
    assert ids(docs) - ids(spoken) == Counter([10**6, 10**6 + 1])
    texts = {}
    for r in spoken.collect():
        texts.setdefault(r["doc_id"], r["text"])
    sets = {i: shingle_set(t) for i, t in texts.items()}
    close = [(a, b) for a, b in itertools.combinations(sets, 2) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    assert ids(single) == Counter(set(groups(sets, close).values()))
    assert ids(private) == ids(single)
    shown = {r["doc_id"]: r["text"] for r in private.collect()}
    assert "some.body@" not in shown[10**6 + 2] and "4337166598464399" not in shown[10**6 + 2]
    assert all(shown[r["doc_id"]] == r["text"] for r in single.collect() if not re.search(r"\d", r["text"]) and "password" not in r["text"])
    assert set(ids(mixed)) <= set(ids(private)) and max(ids(mixed).values()) <= 3
    assert ids(encoded) == ids(mixed)


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def shingle_set(text):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def alike(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return 10 * len(a & b) >= 8 * len(a | b)


def test_near_copies_from_four_fifths_on_are_found(spark):
    draw, texts, pairs = np.random.default_rng(5), [], []
    for n in range(300):
        own = [f"w{x}" for x in draw.integers(0, 5000, 300)]
        other = list(own)
        for place in draw.choice(300, n % 12, replace=False):
            other[place] = "new"
        texts += [" ".join(own), " ".join(other)]
        if alike(*texts[-2:]):
            pairs.append((2 * n, 2 * n + 1))
    # A group whose members differ from the first and more from one another, past what a bucket compares pair by pair.
    base = len(texts)
    group = [f"g{x}" for x in range(400)]
    for n in range(60):
        texts.append(" ".join("x%d" % n if i in (5 * n, 5 * n + 50) else w for i, w in enumerate(group)))
    every = range(base, len(texts))
    pairs += [(a, b) for a, b in itertools.combinations(every, 2) if alike(texts[a], texts[b])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["id"]: r["component"] for r in near_copies(df).collect()}
    assert len(pairs) > 200 and len(found) == len(texts)
    assert all(found[a] == found[b] for a, b in pairs)
    want = groups(range(len(texts)), pairs)
    assert len(set(found.values())) == len(set(want.values()))


def templates(seed, groups, members, words=120):
    """Texts of a group share most words in place; some of their pairs are near copies, some nearly so."""
    draw, texts = np.random.default_rng(seed), []
    for g in range(groups):
        base = [f"t{g}w{i}" for i in range(words)]
        for _ in range(members):
            own = list(base)
            at = int(draw.integers(0, words))
            for i in range(int(draw.integers(0, words // 4))):
                own[(at + i) % words] = f"z{draw.integers(0, 3)}"
            texts.append(" ".join(own))
    return texts


def test_large_buckets_lose_no_link(spark, monkeypatch):
    # Every bucket counts as large, so that links come from the rounds and the exact join alone.
    monkeypatch.setattr(minhash, "SMALL", 1)
    texts = [*templates(3, 6, 24), "", None, "one two", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if alike(texts[a] or "", texts[b] or "")]
    found = {r["id"]: r["component"] for r in near_copies(df).collect()}
    want = groups(range(len(texts)), pairs)
    assert len(set(want.values())) > 20 and groups_of(found) == groups_of(want)


def groups_of(components):
    out = {}
    for node, component in components.items():
        out.setdefault(component, set()).add(node)
    return sorted(map(sorted, out.values()))


def test_early_matches_leave_out_no_pair(spark):
    texts = sorted(set(templates(4, 5, 20)))
    nodes = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node bigint, text string")
    sets = minhash.shingle_sets(nodes, 5)
    every = list(itertools.combinations(range(len(texts)), 2))
    for own in (lambda i: i, lambda i: i % 7):
        apart = spark.createDataFrame([(i, own(i)) for i in range(len(texts))], "node bigint, root bigint")
        asked = {(r["a"], r["b"]) for r in minhash.early_matches(apart, sets, 8).collect()}
        near = {(a, b) for a, b in every if own(a) != own(b) and alike(texts[a], texts[b])}
        assert near <= asked and len(asked) < len(every) / 4 and all(own(a) != own(b) for a, b in asked)
    assert minhash.early_matches(apart.limit(0), sets, 8).count() == 0


def test_rows_are_kept_by_text_and_not_by_id(spark):
    common = " ".join(f"w{i}" for i in range(60))
    rows = [(3, common, "en"), (5, common, "en"), (5, "a text of its own that nobody else has", "en"), (7, "one more text that stands alone here", "en"),
            (7, "and another under the same number as that", "en"), (None, "no number but a copy of the same words", "en"),
            (None, "no number but a copy of the same words", "de"), (9, "twice the same row in every column", None), (9, "twice the same row in every column", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    got = corpus_pipeline.distinct_documents(spark, df, SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter({(i, t) for i, t, _ in rows} - {(5, common)})
    assert len(got) == len({t for _, t, _ in rows})


def test_repeated_documents_come_back_as_often_as_they_came(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "another text"), (2, None), (None, "x y"), (None, "x y")]
    got = edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r["id"], r["n_chars"]) for r in got) == Counter((i, len(t or "")) for i, t in rows)
