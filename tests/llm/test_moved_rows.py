"""The stages of the pipeline move keys and a few texts, not all texts; rounds work on what they have newly found."""

from collections import Counter

import corpus_pipeline
import loomprep.llm.minhash as minhash
from loomprep.llm.common import sieve, sifted
from tests.llm.test_corpus import groups, templates


def test_mix_does_not_move_texts(spark):
    rows = [(i, f"text {i} " + "w " * (i % 7), f"s{i % 3}") for i in range(300)] + [(300, None, "s1"), (None, "no number", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for a large table
    try:
        out = corpus_pipeline.mixed_documents(spark, docs, "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        got = Counter(map(tuple, out.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    taken, _ = corpus_pipeline.mix(docs.selectExpr("*", "xxhash64(doc_id, source, text) AS row"), corpus_pipeline.F.array("source"), id_col="row")
    often = {r["id"]: -(-r["taken"] // r["size"]) for r in taken.where("taken > 0").collect()}
    keys = {tuple(r)[:3]: r["row"] for r in docs.selectExpr("*", "xxhash64(doc_id, source, text) AS row").collect()}
    assert got == Counter({row: often[key] for row, key in keys.items() if key in often}) and max(got.values()) > 1


def test_sieve_lets_all_values_through_and_moves_no_row(spark):
    values = spark.range(0, 40_000, 100).selectExpr("id * 7919 AS v")
    rows = spark.range(40_000).selectExpr("id * 7919 AS v").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS v"))
    marked = sifted(rows, "v", sieve(values, "sieve"))
    passed = {r["v"] for r in marked.where("maybe").collect()}
    assert {r["v"] for r in values.collect()} <= passed and len(passed) < 440 and marked.count() == 40_001
    assert "Exchange hashpartitioning" not in marked._jdf.queryExecution().executedPlan().toString()
    assert sifted(rows, "v", sieve(values.limit(0), "sieve")).where("maybe").isEmpty()


def test_rounds_do_not_link_again_what_is_linked(spark, monkeypatch):
    edges, found = [], minhash.components

    def counted(links, label):
        edges.append(links.count())
        return found(links, label)

    monkeypatch.setattr(minhash, "SMALL", 1)
    monkeypatch.setattr(minhash, "components", counted)
    texts = templates(3, 6, 24)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = minhash.near_copies(df).count()
    assert got == len(texts) and len(edges) > 1 and sum(edges[1:]) < edges[0]


def test_links_of_rounds_join_roots(spark):
    first, second = [(1, 2), (3, 4), (5, 6), (9, 10)], [(2, 3), (6, 8), (20, 21)]
    frame = lambda pairs: spark.createDataFrame(pairs, "a bigint, b bigint")
    roots = minhash.joined(minhash.joined(None, frame(first)), frame(second))
    nodes = {x for pair in first + second for x in pair}
    want = groups(nodes, first + second)
    assert {r["node"]: r["root"] for r in roots.collect()} == want and roots.count() == len(nodes)
