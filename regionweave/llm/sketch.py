"""Document fingerprints as threshold-scaled sketches, with DataFrame functions only.

A sketch keeps every hash of a text's five-word shingles that lies below a fixed fraction of the hash space. Sketches of any two texts are cut at the same threshold, so they can be merged by union and compared by containment however unequal the texts are.

A fingerprint is text: a digest of the whole text, a colon, and the kept hashes, sorted, twelve hexadecimal digits each. Equal texts have equal fingerprints. A text of one to four words has one shingle, all its words; null counts as empty and keeps no hash. Likeness is the share of the smaller sketch that lies in the other; where a sketch is empty (short texts may keep no hash), it is 1 for equal digests and else 0.

Rows with one doc_id, and those without any, which come last, are in order of their texts' hashes; rows equal in both are alike. A single row is its own next one. Very long texts have long fingerprints; an empty table gives no rows; other columns of any name are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, table

#: Shingle size in words; hashes kept are those whose top SCALE_BITS bits are zero: one in 2 ** SCALE_BITS.
WORDS, SCALE_BITS = 5, 2
#: A word: a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Neighbouring documents are ordered in this many groups per shuffle partition.
GROUPS = 4


def kept_hashes(text: Column) -> Column:
    """Sorted distinct shingle hashes of a text below the threshold, as array<bigint>."""
    # binding the words to a lambda's variable splits the text once, not once a shingle
    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), _kept), F.lit(0))


def _kept(words: Column) -> Column:
    last = F.greatest(F.size(words) - F.lit(WORDS - 1), F.lit(1))
    hashed = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, F.lit(WORDS))))
    low = F.filter(hashed, lambda h: (F.shiftrightunsigned(h, 64 - SCALE_BITS) == 0) & (F.size(words) > 0))
    return F.sort_array(F.array_distinct(low))


def fingerprint(text: Column, hashes: Column) -> Column:
    """The fingerprint of a text as a string, from its kept hashes."""
    digits = F.transform(hashes, lambda h: F.lpad(F.hex(F.shiftright(h, 14)), 12, "0"))
    return F.concat(F.md5(text), F.lit(":"), F.lower(F.array_join(digits, "")))


def hashes_of(mark: Column) -> Column:
    """The kept hashes of a fingerprint (their upper 48 bits), as array<string>."""
    return F.regexp_extract_all(F.substring(mark, 34, 2**31 - 1), F.lit("[0-9a-f]{12}"), F.lit(0))


def likeness(a: Column, b: Column, a_hashes: Column, b_hashes: Column) -> Column:
    """Containment of the smaller sketch in the other, 0 to 1."""
    least = F.least(F.size(a_hashes), F.size(b_hashes))
    return F.when(least == 0, F.when(a == b, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(a_hashes, b_hashes)) / least)


def merged(a_hashes: Column, b_hashes: Column) -> Column:
    """The sketch of two texts together."""
    return F.sort_array(F.array_union(a_hashes, b_hashes))


def _grouped(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, hash_) with `group_`, which follows the order of doc_id: bounds are quantiles, their number follows the session's partitions, and a binary search over them finds a row's group. Rows without doc_id come last, in as many groups again by their texts' hashes."""
    n = GROUPS * partitions(docs.sparkSession)
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    bounds = docs.agg(F.percentile_approx("doc_id", shares, F.lit(20 * n)).alias("bounds_")).withColumn("bounds_", F.coalesce(F.array_distinct("bounds_"), F.array().cast("array<bigint>")))
    halvings = F.sequence(F.lit(1), F.lit(max(1, n.bit_length())))
    # (low, high): the number of bounds that are at most doc_id lies between them
    start = F.struct(F.lit(0).alias("low"), F.size("bounds_").alias("high"))
    mid = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
    step = lambda s, _: F.when(s["low"] >= s["high"], s).when(F.get("bounds_", mid(s)) <= F.col("doc_id"), F.struct((mid(s) + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), mid(s).alias("high")))
    unnamed = -1 - F.floor((F.lit(32767) - F.shiftright("hash_", 48)) * n / 65536)  # the largest hashes come first
    place = F.when(F.col("doc_id").isNull(), unnamed).otherwise(F.aggregate(halvings, start, step)["low"])
    return docs.crossJoin(F.broadcast(bounds)).withColumn("group_", place).drop("bounds_")


def with_next(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with next_text: the text of the next row by descending doc_id (nulls last); after the last comes the first. One shuffle of the texts."""
    docs = docs.withColumn("hash_", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash_").desc()]
    rows = _grouped(docs)
    within = W.partitionBy("group_").orderBy(*order)
    rows = rows.withColumn("next_text", F.lead("text").over(within)).withColumn("last_", F.lead(F.lit(1)).over(within).isNull())
    # the first row of each group follows the last of the group above; one text per group travels
    tops = _grouped(docs.select("doc_id", "hash_")).groupBy("group_").agg(F.max(F.struct("doc_id", "hash_")).alias("top_"))  # a row per group, so its size is bounded
    firsts = docs.join(F.broadcast(tops), F.col("doc_id").eqNullSafe(F.col("top_.doc_id")) & (F.col("hash_") == F.col("top_.hash_"))).groupBy("group_").agg(F.max("text").alias("first_text"))
    chain = W.partitionBy(F.lit(0)).orderBy(F.desc("group_"))
    whole = chain.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = firsts.select(F.col("group_").alias("g_"), F.coalesce(F.lead("first_text").over(chain), F.first("first_text").over(whole)).alias("after_"))
    joined = rows.join(after, F.col("group_") == F.col("g_"), "left")
    return joined.select("doc_id", "text", F.when(F.col("last_"), F.col("after_")).otherwise(F.col("next_text")).alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    texts = texts.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", F.concat(F.substring("text", 1, n - cut), F.substring("next_text", 1, cut)).alias("edited"))
    texts = texts.select("*", *[kept_hashes(F.col(c)).alias(f"{c}_hashes") for c in ("text", "edited", "next_text")])
    marks = texts.select("*", *[fingerprint(F.col(c), F.col(f"{c}_hashes")).alias(f"{c}_mark") for c in ("text", "edited")], F.md5("next_text").alias("next_md5"), F.md5("text").alias("own_md5"))
    near_edited = likeness(F.col("text_mark"), F.col("edited_mark"), F.col("text_hashes"), F.col("edited_hashes"))
    near_next = likeness(F.col("own_md5"), F.col("next_md5"), F.col("text_hashes"), F.col("next_text_hashes"))
    return marks.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("text_mark").alias("fingerprint"), F.col("edited_mark").alias("edited_fingerprint"), near_edited.alias("near_edited"), near_next.alias("near_next"))


def op4_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))
