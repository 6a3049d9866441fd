"""Exact top-k against all pairs; WARC records against their own bytes."""

import base64
import gzip
import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomprep.llm.topk import top_k
from loomprep.llm.warc import archives_of, page_record, read_archives, records, write_archives

VECTORS = "vec_id bigint, embedding array<float>, rank int, score string"


def brute(rows, k):
    own = {i: np.floor(np.array(v, np.float32).astype(float) * 1024) for i, v in rows}
    out = []
    for q, v in own.items():
        if q % 10 == 0:
            scored = sorted((-int(v @ w), i) for i, w in own.items() if i != q and len(w) == len(v))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(df, k=4, **more):
    return sorted(map(tuple, top_k(df, F.col("vec_id") % 10 == 0, k, **more).collect()))


def test_top_k_with_ties_blocks_and_hot_vectors(spark):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.normal(size=6)]) for i in range(90)]
    rows += [(i, rows[7][1]) for i in range(90, 140)]  # fifty copies of one vector
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], VECTORS).repartition(5)
    assert found(df) == brute(rows, 4)
    assert found(df, block_queries=3) == brute(rows, 4)


def test_top_k_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (10, [3.0])]
    odd = [(2, None), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 0.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame([(i, v, 1, None) for i, v in rows + odd], VECTORS)
    assert found(df) == [(0, 1, 1, 512 * 1024 + 512 * 2048)] == brute(rows, 4)
    repeated = spark.createDataFrame([(0, [1.0], 0, ""), (1, [2.0], 0, ""), (1, [2.0], 0, "")], VECTORS)
    assert found(repeated) == [(0, 1, 1, 2 * 1024 * 1024), (0, 2, 1, 2 * 1024 * 1024)]
    assert found(df.limit(0)) == []
    large = spark.createDataFrame([(0, [1e30], 0, ""), (1, [1e30], 0, "")], VECTORS)
    with pytest.raises(ValueError, match="long"):
        found(large)


PAGES = "page_id bigint, url string, html string, path string, digest string"


def test_archives_round_trip(spark, tmp_path):
    long = "<p>é</p>" * 400_000
    rows = [(3, "http://a/é", "same", "x", "y"), (1, None, "same", "x", "y"), (2, "u", None, None, None), (9, "u", "", "", ""),
            (5, "v\r\nX: y", long, "", ""), (7, "w", "short", "", ""), (None, "n", "same", "", "")]
    df = spark.createDataFrame(rows, PAGES)
    manifest = write_archives(df, str(tmp_path / "w"))
    got = {r["page_id"]: r for r in read_archives(manifest).collect()}
    text = {str(i): h or "" for i, _, h, *_ in rows if i}
    assert set(got) == {"1", "2", "3", "5", "7", "9", None}
    for page, html in text.items():
        r = got[page]
        assert r["payload_bytes"] == len(html.encode())
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert r["record_type"] == "revisit" or bytes(r["payload"]).decode() == html
    assert {p: r["refers_to"] for p, r in got.items() if r["record_type"] == "revisit"} == {"3": "1", "9": "2", None: "1"}
    assert got["3"]["url"] == "http://a/é" and got["1"]["url"] is None and got["5"]["url"] == "v\r\nX: y"
    assert read_archives(archives_of(spark, str(tmp_path / "w")), payloads=False).count() == 7
    larger = write_archives(df, str(tmp_path / "l"), least_bytes=1)
    assert {r["page_id"] for r in read_archives(larger).where("record_type = 'revisit'").collect()} == {"3", None}
    assert write_archives(df.limit(0), str(tmp_path / "e")).count() == 0


def test_damaged_archives_are_noticed():
    whole = page_record(1, "u", "hello", None)
    assert [r["payload"] for r in records(io.BytesIO(whole + whole))] == [b"hello", b"hello"]
    plain = gzip.decompress(whole)
    for bad in (plain.replace(b"hello", b"jello"), plain[:-8], plain.replace(b"WARC/1.1", b"ARC/1.1")):
        with pytest.raises(ValueError):
            list(records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(ValueError, match="ends within"):
        list(records(io.BytesIO(whole[:-12])))
