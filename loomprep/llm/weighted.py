"""Document fingerprints by consistent weighted sampling.

A text's terms are its words, weighted by their number of occurrences. For sample k every term draws two gamma variables
and a uniform one from its hash; the term with the smallest resulting value is the sample, together with the step of the
weight it stands for. Two texts draw the same sample with a probability equal to their generalised Jaccard similarity,
so the share of equal samples estimates it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

SAMPLES = 32
RANGES = 4  # ranges of ids per shuffle partition
WHITE = r"[\x20\x09-\x0D]+"
SHIFT, FINE = 100.0, float(1 << 24)  # order-keeping whole number for a logarithm between -100 and 27


def uniform(bits: Column, low: int, width: int) -> Column:
    """A number in (0, 1) from some bits of a hash."""
    part = F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
    return (part.cast("double") + 0.5) * (1.0 / (1 << width))


def sample(k: int) -> Column:
    """Sample k of one weighted term, as a long whose order is that of the drawn values: value above, identity below."""
    one, two = F.xxhash64("term", F.lit(2 * k)), F.xxhash64("term", F.lit(2 * k + 1))
    r = -F.log(uniform(one, 0, 32) * uniform(one, 32, 32))
    log_c = F.log(-F.log(uniform(two, 0, 26) * uniform(two, 26, 26)))
    b = uniform(two, 52, 12)
    t = F.floor(F.col("log_weight") / r + b)
    value = log_c - r * (t - b + 1.0)
    order = F.floor((value + SHIFT) * FINE).cast("bigint")
    identity = F.xxhash64("term", t).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return F.shiftleft(order, 32).bitwiseOR(identity)


def hashed_words(text: Column) -> Column:
    """The hashes of a text's words, equal ones next to each other."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def signatures(texts: DataFrame, keys: list[str], variants: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, variant, n, s0 ..): number of distinct words and the samples of each text column named in ``variants``.

    The rows of one key are aggregated where they are made, so only finished signatures are shuffled, and nothing is when
    ``texts`` is partitioned by the keys already.
    """
    each = F.array(*[F.struct(F.lit(i).alias("variant"), hashed_words(F.col(c)).alias("words")) for i, c in enumerate(variants)])
    per_text = texts.select(*keys, F.explode(each).alias("v")).select(*keys, "v.variant", "v.words")
    # A word's run starts where its neighbour differs and ends where the next run starts.
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1)))
    runs = per_text.withColumn("starts", F.when(F.size("words") > 0, starts).otherwise(F.array().cast("array<int>")))
    pairs = F.transform(
        "starts",
        lambda s, i: F.struct(
            F.get("words", s).alias("term"),
            F.log((F.coalesce(F.get("starts", i + 1), F.size("words")) - s).cast("double")).alias("log_weight"),
        ),
    )
    terms = runs.select(*keys, "variant", F.explode_outer(pairs).alias("p")).select(*keys, "variant", "p.term", "p.log_weight")
    return terms.groupBy(*keys, "variant").agg(F.count("term").alias("n"), *[F.min(sample(k)).alias(f"s{k}") for k in range(samples)])


def packed(samples: int) -> Column:
    """The identities of the samples, eight hex digits each; empty for a text without words."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    return F.when(F.col("n") == 0, "").otherwise(F.lower(F.concat(*[F.lpad(F.hex(F.col(f"s{k}").bitwiseAND(mask)), 8, "0") for k in range(samples)])))


def likeness(a: Column, b: Column, samples: int) -> Column:
    """Share of equal samples of two fingerprints: 1 for two texts without words, 0 for one of them."""
    parts = [(F.substr(a, F.lit(1 + 8 * k), F.lit(8)) == F.substr(b, F.lit(1 + 8 * k), F.lit(8))).cast("int") for k in range(samples)]
    return F.when((a == "") & (b == ""), 1.0).otherwise(reduce(Column.__add__, parts) / float(samples))


def range_starts(ids: DataFrame, id_col: str) -> list:
    """The smallest id of each of many ranges of about equal size; the driver holds one id per range."""
    ranges = RANGES * int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ids.select(id_col).where(F.col(id_col).isNotNull()).repartitionByRange(ranges, id_col)
    found = dealt.groupBy(F.spark_partition_id().alias("range")).agg(F.min(id_col).alias("first")).collect()
    return sorted(r["first"] for r in found)


def range_number(value: Column, starts: list, kind: str) -> Column:
    """Number of the range that holds the value, by halving."""
    cuts = F.lit(starts).cast(f"array<{kind}>")

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"] + 1) / 2).cast("int")
        above = F.get(cuts, middle) <= value
        return F.struct(F.when(above, middle).otherwise(state["low"]).alias("low"), F.when(above, state["high"]).otherwise(middle - 1).alias("high"))

    steps = F.array(*map(F.lit, range(max(1, len(starts).bit_length()))))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(starts) - 1).alias("high"))
    return F.aggregate(steps, start, halve, lambda s: s["low"])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness and that to the next document.

    The edited text replaces the last floor(n / 2) code points by the first as many, or all, of the next document by
    ascending id; the last is followed by the first. A null text is empty and has the empty fingerprint, as any text
    without words. Rows that share an id follow by the hash of the text; rows that also share the text are one document
    and come back as often as they came. A row with a null id has no next document: nothing is put in and ``near_next`` is null. Other columns
    are left out.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    starts = range_starts(own, "id")
    ranges = max(1, len(starts))
    # The first rows of a range also visit the range before it, where they follow its last row.
    place = range_number(F.col("id"), starts, kind) if starts else F.lit(0)
    first = F.array_contains(F.lit(starts).cast(f"array<{kind}>"), F.col("id")) if starts else F.lit(False)
    at = lambda number, visits: F.struct(number.cast("int").alias("range"), F.lit(visits).alias("visits"))
    home = F.when(F.col("id").isNull(), -1 - F.pmod("h", F.lit(ranges)).cast("int")).otherwise(place)
    back = F.pmod(place - 1, F.lit(ranges))
    stays = F.when(first & F.col("id").isNotNull(), F.array(at(home, 0), at(back, 1))).otherwise(F.array(at(home, 0)))
    dealt = own.select("id", "h", "text", F.explode(stays).alias("at")).select("at.range", "at.visits", "id", "h", "text")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "range")
    keys = ["range", "visits", "id", "h"]
    single = dealt.groupBy(*keys).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("range").orderBy("visits", "id", "h")
    n = F.char_length("text")
    half = F.expr("char_length(text) div 2").cast("int")
    head = F.when(F.col("id").isNull(), "").otherwise(F.substr(F.coalesce(F.lead("text").over(order), F.lit("")), F.lit(1), half))
    texts = single.select(*keys, "copies", "text", n.cast("bigint").alias("n_chars"), F.concat(F.substr("text", F.lit(1), n - half), head).alias("edited"))
    facts = texts.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    keys += ["copies", "n_chars", "edited_sha256"]
    made = signatures(facts, keys, ["text", "edited"], samples)
    both = made.groupBy(*keys).agg(
        F.max(F.when(F.col("variant") == 0, packed(samples))).alias("fingerprint"),
        F.max(F.when(F.col("variant") == 1, packed(samples))).alias("edited_fingerprint"),
    )
    following = F.when(F.col("id").isNotNull(), F.lead("fingerprint").over(order))
    named = both.withColumn("next_fingerprint", following).where("visits = 0")
    named = named.select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return named.select(
        "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )
