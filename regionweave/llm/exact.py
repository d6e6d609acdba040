"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Each partition fingerprints its own texts (SHA-256; 64 bits of it travel) and keeps a slim table of (partition, position, doc_id, fingerprint).
2. Each partition sends every owner of a fingerprint range the sorted distinct fingerprints of that range, Golomb-Rice coded. A fingerprint travels once per partition, however many copies lie there.
3. Owners answer each partition with a bitmap: which of its fingerprints occur elsewhere.
4. Only rows whose fingerprint recurs (there or at home) are suspects. A bounded Bloom filter of their ids keeps other texts out of the shuffle, and suspects' texts are compared byte for byte in groups split by their full digest.

Of equal texts the row with the largest doc_id stays; null texts count as empty; a null doc_id is the smallest. Among rows with equal text and doc_id one stays. No step needs all copies of a text in one task: groups are reduced by partial aggregates. Two different texts under one SHA-256 and one MD5 would stop the query rather than merge. Very long texts are hashed like others; an empty table gives no rows; other columns of any name are not read, or pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, partitions, spare_name, table

#: Bits a member of a Bloom filter, and its bits at most: a filter is broadcast, so it has a bound (16 MB). Fuller filters let more texts through and stay right.
BITS_EACH, BLOOM_MOST = 12, 1 << 27
_BLOOM_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct 64-bit integers as Golomb-Rice coded gaps: a header (count, shift, first value), unary quotients, then remainders."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values)
    mean = int(gaps.mean()) if n > 1 else 1
    shift = max(0, mean.bit_length() - 1)
    head = n.to_bytes(8, "little") + shift.to_bytes(1, "little") + int(values[0]).to_bytes(8, "little")
    if n == 1:
        return head
    quotients = (gaps >> np.uint64(shift)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    places = np.arange(shift, dtype=np.uint64)
    rest = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel() if shift else np.empty(0, np.uint8)
    return head + len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(blob: bytes) -> np.ndarray:
    """The integers that `golomb_encode` was given."""
    if not blob:
        return np.empty(0, np.uint64)
    n, shift, first = int.from_bytes(blob[:8], "little"), blob[8], int.from_bytes(blob[9:17], "little")
    if n == 1:
        return np.array([first], np.uint64)
    length = int.from_bytes(blob[17:25], "little")
    cut = 25 + (length + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob[25:cut], np.uint8), count=length))
    quotients = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    gaps = quotients << np.uint64(shift)
    if shift:
        bits = np.unpackbits(np.frombuffer(blob[cut:], np.uint8), count=(n - 1) * shift).reshape(n - 1, shift).astype(np.uint64)
        gaps += (bits << np.arange(shift, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.concatenate([[np.uint64(first)], np.uint64(first) + np.cumsum(gaps, dtype=np.uint64)])


def _unsigned(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _owner(h: np.ndarray, owners: int) -> np.ndarray:
    """The owner of a fingerprint: equal ranges of its top 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Slim table of all rows: part, pos, doc_id, text_sha256, body (its MD5), h (64 bits of the digest). Kept durably, so that part and pos stay fixed."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.md5(F.coalesce("text", F.lit(""))).alias("body"))
    # conv() gives an unsigned decimal string; two halves avoid the overflow of a signed cast
    high, low = (F.conv(F.substring("text_sha256", 1 + 8 * k, 8), 16, 10).cast("long") for k in (0, 1))
    slim = slim.withColumn("h", F.shiftleft(high, 32).bitwiseOR(low)).withColumn("part", F.spark_partition_id())
    return durable(slim.withColumn("pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))


def _send(owners: int):
    def send(batches):
        held, part = [], None
        for b in batches:
            if b.num_rows:
                part = b.column(0)[0].as_py()
                held.append(_unsigned(b.column(1)))
        if part is None:
            return
        values = np.unique(np.concatenate(held))
        to = _owner(values, owners)
        cuts = np.searchsorted(to, np.arange(owners + 1))
        sent = [(o, golomb_encode(values[cuts[o] : cuts[o + 1]])) for o in range(owners) if cuts[o] < cuts[o + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in sent], pa.int32()), pa.array([part] * len(sent), pa.int32()), pa.array([x for _, x in sent], pa.binary())], ["owner", "part", "coded"])

    return send


def _answer(key, group: pd.DataFrame) -> pd.DataFrame:
    lists = [golomb_decode(bytes(x)) for x in group["coded"]]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[counts > 1]
    bitmaps = [np.packbits(np.isin(v, shared, assume_unique=True)).tobytes() for v in lists]
    return pd.DataFrame({"owner": group["owner"], "part": group["part"], "bitmap": bitmaps})


def _flag(owners: int):
    def flag(key, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        h = rows["h"].to_numpy(np.int64).view(np.uint64)
        values, at, counts = np.unique(h, return_inverse=True, return_counts=True)
        cuts = np.searchsorted(_owner(values, owners), np.arange(owners + 1))
        shared = counts > 1
        for o, bitmap in zip(answers["owner"], answers["bitmap"], strict=True):
            a, b = cuts[o], cuts[o + 1]
            shared[a:b] |= np.unpackbits(np.frombuffer(bytes(bitmap), np.uint8), count=b - a).astype(bool)
        return rows.assign(suspect=shared[at])[["part", "pos", "doc_id", "text_sha256", "body", "suspect"]]

    return flag


def suspects(fp: DataFrame) -> DataFrame:
    """Rows of `fingerprints` with `suspect`: whether another row has the same 64-bit fingerprint."""
    owners = partitions(fp.sparkSession)
    coded = fp.select("part", "h").mapInArrow(_send(owners), "owner int, part int, coded binary")
    answers = coded.groupBy("owner").applyInPandas(_answer, "owner int, part int, bitmap binary")
    rows = fp.select("part", "pos", "doc_id", "text_sha256", "body", "h")
    return rows.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(_flag(owners), "part int, pos long, doc_id long, text_sha256 string, body string, suspect boolean")


def _bits(ids: np.ndarray, size: int) -> list[np.ndarray]:
    """The places of ids in a filter of `size` bits, a power of two."""
    shift = np.uint64(64 - (size.bit_length() - 1))
    return [((ids.view(np.uint64) * np.uint64(s)) >> shift).astype(np.int64) for s in _BLOOM_SEEDS]


def member(words: bytes, ids: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ids may be in a filter."""
    bits = np.frombuffer(words, np.uint8)
    hit = np.ones(len(ids), bool)
    for at in _bits(ids, 8 * len(bits)):
        hit &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return hit


def bloom(rows: DataFrame, column: str) -> bytes:
    """Bloom filter of a column of 64-bit ids (null counts as -1): as many bits as the rows need, BLOOM_MOST at most, OR-ed from the partitions."""
    size = min(BLOOM_MOST, max(1 << 16, 1 << (BITS_EACH * rows.count()).bit_length()))

    def local(batches):
        words = np.zeros(size // 8, np.uint8)
        for b in batches:
            for at in _bits(b.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), size):
                np.bitwise_or.at(words, at >> 3, (1 << (at & 7)).astype(np.uint8))
        full = np.flatnonzero(words.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(words.view(np.int64)[full])], ["word", "bits"])

    words = rows.select(column).mapInArrow(local, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(size // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.tobytes()


def _maybe(filter_bits) -> object:
    @F.pandas_udf("boolean")
    def maybe(ids: pd.Series) -> pd.Series:
        return pd.Series(member(filter_bits.value, ids.fillna(-1).to_numpy(np.int64)))

    return maybe


def duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (columns doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    marked = durable(suspects(fingerprints(docs)))
    one = F.lit(1).cast("long")
    alone = marked.filter(~F.col("suspect")).select("doc_id", F.col("doc_id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    told, group = marked.filter("suspect"), ["text_sha256", "body"]
    words = docs.sparkSession.sparkContext.broadcast(bloom(told, "doc_id"))
    # texts that may be suspects; a text let in by the filter's error has no partner below
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(_maybe(words)("doc_id"))
    # byte verification: the bytes themselves are the key, so that two texts under one digest would show as two variants
    bytes_ = texts.select(F.sha2("text", 256).alias("text_sha256"), F.md5("text").alias("body"), "text").distinct()
    variants = bytes_.groupBy(*group).agg(F.count(F.lit(1)).alias("variants"))
    # one row per partition and group from here on, so that no group's size meets in one task
    local = told.groupBy("part", *group).agg(F.max(F.struct("doc_id", "part", "pos")).alias("last"), F.count(F.lit(1)).alias("n"))
    reps = local.groupBy(*group).agg(F.max("last").alias("keep"), F.sum("n").alias("group_size")).join(variants, group)
    unsure = F.when(F.col("variants") > 1, F.raise_error(F.lit("two texts share one digest")).cast("long"))
    reps = reps.select(*group, "keep", F.coalesce(unsure, "group_size").alias("group_size"))
    verdict = local.select("part", *group).join(reps, group)
    back = told.join(verdict, ["part", *group])
    kept = (F.col("part") == F.col("keep.part")) & (F.col("pos") == F.col("keep.pos"))
    return alone.unionByName(back.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, all columns, whatever their names. Rows that share both doc_id and text are told apart only by their number; one of them stays."""
    stays, goes = F.count_if(F.col("kept")), F.count_if(~F.col("kept"))
    ours = spare_name(docs.columns, "verdict")
    slim = duplicates(docs).groupBy("doc_id", "text_sha256").agg(stays.alias("stays"), goes.alias("goes")).filter("goes > 0")
    slim = durable(slim.select(F.struct("doc_id", "text_sha256", "stays").alias(ours)))
    held = slim[ours]
    same = docs["doc_id"].cast("long").eqNullSafe(held["doc_id"]) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == held["text_sha256"])
    clean = docs.join(slim, same, "left_anti")
    ties = slim.filter(held["stays"] > 0)
    if ties.isEmpty():
        return clean
    # rows alike in id and text: any one of each group, by partial aggregates
    one = docs.join(ties, same).groupBy(ours).agg(F.any_value(F.struct(*[docs[c] for c in docs.columns])).alias("row"))
    return clean.unionByName(one.select("row.*"))


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    return duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
