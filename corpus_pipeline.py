"""Corpus pipeline: documents in, tokenised training documents out, one written table per stage.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. What a stage gathers (the language model, groups of copies, sizes of sources, words) it gathers from its own
input. An empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomprep.llm.common import sieve, sifted, spare, table, written
from loomprep.llm.language import folded, identified, train
from loomprep.llm.minhash import near_copies, row_keys
from loomprep.llm.mixing import mix
from loomprep.llm.pieces import encode
from loomprep.llm.pii import pseudonymise
from loomprep.llm.queries import PSEUDONYM_KEY

PIECES = "piece_bpe_32k.model"
LEAST_SCORE = 0.5  # posterior of the predicted language, below which a document goes


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told from their text; those without letters, a text or a clear language go."""
    model = train(docs, public_tokenizers.path(PIECES), use=folded("doc_id") != 2)
    lang, score = spare("_lang", docs.columns), spare("_score", docs.columns)
    marked = identified(docs, model, lang_col=lang, score_col=score)
    if not model.languages:  # nothing labelled, nothing to reject by
        return docs
    return marked.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies, texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
    more: the one with the smallest doc_id (nulls last), then the smallest hash of the whole row. Rows that share a doc_id
    but not their text are rows of their own."""
    found = written(near_copies(docs), "pipeline-components")
    first = F.min(F.struct(F.col("id").isNull(), "id", "_k1", "_k2")).alias("first")
    kept = found.groupBy("component").agg(first).select("first._k1", "first._k2", F.lit(True).alias("keep"))
    equal = found.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n"))
    # Most rows are kept as they are; the others, and those that stand more than once, are named.
    named = equal.join(kept, ["_k1", "_k2"], "left").where("keep IS NULL OR n > 1")
    own = {c: spare(f"_{c.strip('_')}", docs.columns) for c in ("_k1", "_k2", "keep", "n")}
    named = written(named.withColumnsRenamed(own), "pipeline-named")
    k1, k2, keep, n = own.values()
    maybe = spare("_maybe", docs.columns)
    keys = [k.alias(name) for k, name in zip(row_keys(docs.columns), (k1, k2), strict=True)]
    rows = sifted(docs.select(*docs.columns, *keys), k1, sieve(named.select(k1), "pipeline-sieve"), maybe)
    told = rows.where(F.col(maybe)).join(named, [k1, k2], "left")
    once = told.where(F.col(keep)).dropDuplicates([k1, k2])
    left = rows.where(~F.col(maybe)).select(*docs.columns).unionByName(told.where(F.col(n).isNull()).select(*docs.columns))
    return left.unionByName(once.select(*docs.columns))


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    return pseudonymise(docs, PSEUDONYM_KEY).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes their words; a document of which it takes a part counts as taken."""
    row, sized, taken, time = (spare(c, docs.columns) for c in ("_row", "_size", "_taken", "_time"))
    own = docs.withColumn(row, F.xxhash64("doc_id", "source", "text"))
    rows, _ = mix(own, F.array("source"), id_col=row, carried={"size": sized, "taken": taken})
    often = F.ceil(F.col(taken) / F.col(sized)).cast("int")
    again = F.explode(F.sequence(F.lit(1), often)).alias(time)
    return rows.where(F.col(taken) > 0).select(*docs.columns, again).select(*docs.columns)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, piece_ids) of every document."""
    encoded = encode(docs, public_tokenizers.path(PIECES))
    return encoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_pieces"), F.col("ids").alias("piece_ids"))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", distinct_documents),
    ("pii", private_documents),
    ("source_mix", mixed_documents),
    ("sentencepiece", encoded_documents),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
