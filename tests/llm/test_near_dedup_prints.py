"""The near_dedup stage proposes pairs by fingerprints too, and the shingle sets still decide."""

import loomprep.llm.minhash as minhash
from loomprep.llm.minhash import near_copies


def test_fingerprints_propose_pairs(spark, monkeypatch):
    import numpy as np

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(reversed(words)), "", None, "w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    expected = {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5}

    def groups():
        rows = near_copies(docs).collect()
        least = {}
        for r in rows:
            least[r["component"]] = min(r["id"], least.get(r["component"], r["id"]))
        return {r["id"]: least[r["component"]] for r in rows}

    assert groups() == expected
    monkeypatch.setattr(minhash, "bands", lambda own: np.zeros(0, np.int64))  # fingerprints alone
    assert groups() == expected
