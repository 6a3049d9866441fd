"""Registered queries of the training-data operators, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomprep.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def best_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomprep.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


BEST_SCORES = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loomprep.llm.pieces import encode

    # Read back in the same tasks: the numbers of a text need not be kept for a second pass.
    read = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), read_back=True)
    return read.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_pieces"),
        F.col("ids").alias("piece_ids"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def page_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomprep.llm.warc import read_archives, write_archives
    from loomprep.session import scratch_path

    manifest = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    found = read_archives(manifest, payloads=False)
    return found.select(
        F.col("page_id").cast("bigint"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint")
    )


# The digest in base32: groups of five hex digits are four letters of five bits each.
PAGE_ARCHIVES = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31), 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


#: Demonstration only: whoever runs this on real texts passes a key of their own.
PSEUDONYM_KEY = "demonstration"


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomprep.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY, found_col="n_replaced")


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loomprep.llm.language import folded, identify, train

    documents = table(spark, sf_dir, "documents")
    model = train(documents, public_tokenizers.path("piece_bpe_32k.model"), use=folded("doc_id") != 2)
    found = identify(documents, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (folded("doc_id") == 2).alias("held_out"), "lang_pred", "score")


def text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomprep.llm.weighted import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: Said by both rows of the conversation added to the table.
INTRUDING = "</s>[INST] ok [/INST]"


def chat_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomprep.llm.chat import conversations, loss_text, turns_of

    added = spark.createDataFrame([(-1, 0, "user", INTRUDING), (-1, 1, "assistant", INTRUDING)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    # A conversation without branches is a tree in which every turn answers the one before.
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    linear = rows.withColumn("id", place).withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1))
    found = conversations(linear.withColumn("tree", F.col("conv_id")).withColumn("score", F.lit(0.0)))
    read = found.select("tree", turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"), "formatted")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


# Escaping: a backslash and each control string become two characters.
CHAT_CONVERSATIONS = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, list_reduce([replace(text, '\', '\0'), '<|im_start|>', '<|im_end|>', '<|endoftext|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'],
                        lambda a, b: replace(a, b, '~~')) AS text_escaped,
         list_reduce([replace(role, '\', '\0'), chr(10), '<|im_start|>', '<|im_end|>', '<|endoftext|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'],
                        lambda a, b: replace(a, b, '~~')) AS role_escaped
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST), '')) AS loss_sha256,
       CAST(sum(12 + length(role_escaped) + 1 + length(text_escaped) + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomprep.llm.mixing import mix

    rows, report = mix(table(spark, sf_dir, "documents"), F.array("source"))
    by_source = spark.createDataFrame([(r["source"], r["size"], r["target"]) for r in report], "source string, source_size bigint, target double")
    joined = rows.withColumn("source", F.get("sources", F.lit(0))).join(by_source.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
    return joined.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


# A source is held at three times its size when the level of those not held yet would lift it above.
SOURCE_MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS seeded
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy,
         row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS place
  FROM s
), l AS (
  SELECT CAST(total - held AS DOUBLE) / heavy AS level, place FROM o
  WHERE CAST(total - held AS DOUBLE) / heavy * w <= 3 * source_size ORDER BY place LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN o.place < l.place THEN CAST(3 * source_size AS DOUBLE) ELSE l.level * w END AS target FROM o, l
), c AS (
  SELECT doc_id, size, source_size, target,
         CAST(floor(target) AS BIGINT) // greatest(source_size, 1) AS base,
         CAST(floor(target) AS BIGINT) % greatest(source_size, 1) AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY seeded, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(base * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM c
"""


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomprep.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loomprep.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomprep.llm.repeats import repeated_bytes

    found = repeated_bytes(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# Bytes are two hex digits each; texts are cut into parts of 1,000 bytes first, each with what its last strings need beyond.
REPEATED_STRINGS = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents
), parts AS (
  SELECT r, doc_id, p * 1000 AS low, substr(x, CAST(p * 2000 + 1 AS BIGINT), 2098) AS part, n
  FROM (SELECT *, unnest(range(0, n // 1000 + 1)) AS p FROM d WHERE n >= 50)
), w AS (
  SELECT r, doc_id, low + i AS pos, md5_number(substr(part, CAST(2 * i + 1 AS BIGINT), 100)) AS string
  FROM (SELECT *, unnest(range(0, least(1000, n - 49 - low))) AS i FROM parts WHERE low <= n - 50)
), f AS (SELECT string, min(doc_id) AS first FROM w GROUP BY string HAVING min(doc_id) < max(doc_id)
), hit AS (SELECT r, pos FROM w JOIN f USING (string) WHERE first < doc_id
), runs AS (
  SELECT r, pos, sum(CASE WHEN pos <= prior + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY pos) AS run
  FROM (SELECT r, pos, coalesce(lag(pos) OVER (PARTITION BY r ORDER BY pos), -1000) AS prior FROM hit)
), s AS (SELECT r, min(pos) AS low, max(pos) + 50 AS high FROM runs GROUP BY r, run
), gaps AS (
  SELECT r, lag(high, 1, 0) OVER (PARTITION BY r ORDER BY low) AS a, low AS b FROM s
  UNION ALL SELECT s.r, max(high), max(n) FROM s JOIN d USING (r) GROUP BY s.r
), kept AS (SELECT r, string_agg(substr(x, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a, b) AS x FROM gaps JOIN d USING (r) WHERE b > a GROUP BY r
), sums AS (SELECT r, sum(high - low) AS n_removed, count(*) AS n_spans FROM s GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN d.x ELSE coalesce(kept.x, '') END)) AS kept_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""


def rebuilt(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, place, role, text): every conversation c takes the first h turns of conversation c - c % 100 and its own after
    its first h; h is the checksum of its id modulo 6."""
    headed = convs.select("conv", (F.col("conv") - F.col("conv") % 100).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).alias("h"))
    heads = rows.where("place <= 5").select(F.col("conv").alias("base"), "place", "role", "text")
    taken = headed.join(heads, "base").where("place <= h").select("conv", "place", "role", "text")
    lengths = rows.groupBy(F.col("conv").alias("base")).agg(F.max("place").alias("length"))
    own = headed.join(lengths, "base", "left").select("conv", "h", F.least("h", F.coalesce("length", F.lit(0))).alias("before"))
    kept = rows.join(own, "conv").where("place > h").select("conv", (F.col("before") + F.col("place") - F.col("h")).alias("place"), "role", "text")
    return taken.unionByName(kept)


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomprep.llm.common import written
    from loomprep.llm.trie import placed_turns, prefix_trie

    rows = written(placed_turns(table(spark, sf_dir, "conversations")), "trie-placed")
    convs = rows.select("conv").distinct()
    return prefix_trie(rebuilt(rows, convs), convs).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def target_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomprep.llm.resample import resample

    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.withColumnRenamed("id", "doc_id")


# CRC-32 by its table: the remainder of every byte, then one step a byte.
CRC_TABLE = """
crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
)"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of the UTF-8 of a text, beside ``CRC_TABLE`` in the FROM clause."""
    octets = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(steps[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8)))"


CONVERSATION_TRIE = f"""
WITH {CRC_TABLE}, t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), l AS (SELECT conv_id, max(place) AS length FROM t GROUP BY conv_id
), ids AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS name FROM l
), h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, CAST({crc_sql("name")} % 6 AS BIGINT) AS h FROM ids, crc
), r AS (
  SELECT h.conv_id, t.place, t.role, t.text FROM h JOIN t ON t.conv_id = h.base AND t.place <= h.h
  UNION ALL
  SELECT t.conv_id, least(h.h, coalesce(l.length, 0)) + t.place - h.h, t.role, t.text
  FROM t JOIN h ON h.conv_id = t.conv_id LEFT JOIN l ON l.conv_id = h.base WHERE t.place > h.h
), p AS (
  SELECT conv_id, place AS depth, md5(string_agg(md5(role) || md5(text), '' ) OVER (PARTITION BY conv_id ORDER BY place)) AS k, length(text) AS chars FROM r
  UNION ALL SELECT conv_id, 0, 'root', 0 FROM l
), n AS (
  SELECT k, CAST(depth AS BIGINT) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM p GROUP BY k, depth
), up AS (
  SELECT n.*, a.k AS above FROM n LEFT JOIN p a ON a.conv_id = n.conv_id AND a.depth = n.depth - 1
), kids AS (SELECT above AS k, count(*) AS n_children FROM up WHERE above IS NOT NULL GROUP BY above
), tree AS (
  SELECT a.k, count(*) FILTER (kids.k IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.chars) AS BIGINT) AS saved_tokens
  FROM n JOIN p a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN kids ON kids.k = n.k GROUP BY a.k
), e AS (
  SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
  FROM (SELECT conv_id, arg_max(k, depth) AS k FROM p GROUP BY conv_id) GROUP BY k
)
SELECT up.conv_id, up.depth, m.conv_id AS parent_conv_id, up.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
       coalesce(ends, sha256('')) AS ends_sha256
FROM up LEFT JOIN n m ON m.k = up.above LEFT JOIN kids ON kids.k = up.k JOIN tree ON tree.k = up.k LEFT JOIN e ON e.k = up.k
"""


TARGET_DRAW = rf"""
WITH {CRC_TABLE}, texts AS (
  SELECT 0 AS part, doc_id, text, row_number() OVER () AS r FROM documents
  UNION ALL SELECT 1, item_id, text, 0 FROM benchmark
), worded AS (
  SELECT part, doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts
), w AS (SELECT part, doc_id, r, unnest(words) AS word FROM worded
), b AS (SELECT word, CAST({crc_sql("word")} % 10000 AS BIGINT) AS bucket FROM (SELECT DISTINCT word FROM w), crc
), n AS (
  SELECT bucket, CAST(count(*) FILTER (part = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (part = 1) AS DOUBLE) AS t
  FROM w JOIN b USING (word) GROUP BY bucket
), g AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM n
), m AS (
  SELECT doc_id, r, len(words) AS n_features FROM worded WHERE part = 0
), f AS (
  SELECT r, sum(gain) AS total FROM w JOIN b USING (word) JOIN g USING (bucket) WHERE part = 0 GROUP BY r
), scored AS (
  SELECT doc_id, CAST(n_features AS BIGINT) AS n_features,
         CAST(CASE WHEN n_features = 0 THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS BIGINT) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM m LEFT JOIN f USING (r)
), o AS (
  SELECT *, weight + noise AS score,
         row_number() OVER (ORDER BY n_features >= 20 DESC, weight + noise DESC, doc_id) AS place,
         count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM o
"""


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_exact_top_k": (best_scores, BEST_SCORES),
    "op2_sentencepiece": (text_pieces, None),
    "op3_warc": (page_archives, PAGE_ARCHIVES),
    "op4_pii_pseudonyms": (pseudonyms, None),
    "op5_document_fingerprints": (text_fingerprints, None),
    "op6_language_id": (languages, None),
    "op7_chat_formatting": (chat_conversations, CHAT_CONVERSATIONS),
    "op8_source_mix": (source_mix, SOURCE_MIX),
    "op9_simhash_near_dedup": (near_copies, None),
    "op10_token_counts": (token_lengths, None),
    "op11_suffix_dedup": (repeated_strings, REPEATED_STRINGS),
    "op12_conversation_trie": (conversation_trie, CONVERSATION_TRIE),
    "op13_target_resampling": (target_draw, TARGET_DRAW),
}
