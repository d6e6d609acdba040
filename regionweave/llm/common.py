"""Shared pieces of the training-data operators: table reading, durable cuts of lineage, and vectorised word shingles."""

from __future__ import annotations

import contextlib
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Multiplier of the rolling word-shingle hash (odd, so it permutes 64-bit integers).
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the cluster's shared checkpoint folder, so that a lost executor costs nothing.

    The folder is the session's spark.checkpoint.dir. Where that is unset, a local folder serves a local master; on a cluster executors could not share one, so the call fails.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def release(*frames: DataFrame | None) -> None:
    """Deletes what `durable` kept of frames that nothing reads any more. Frames that were not kept are left alone."""
    for df in frames:
        plan = df._jdf.queryExecution().logical() if df is not None else None
        if plan is None or plan.nodeName() != "LogicalRDD":
            continue
        kept = plan.rdd().getCheckpointFile()
        if kept.isDefined():
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(kept.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns memory that a finished task leaves unused to the system, since workers wait for their next task with what they hold."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def groups_of(batches, keys: int):
    """Runs of rows with equal values in the first `keys` columns, as one table each; the batches are sorted by these columns, and a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        changes = np.zeros(b.num_rows, bool)
        for c in columns:
            changes[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(changes).tolist(), b.num_rows]
        for a, e in zip(starts, starts[1:], strict=False):
            if a == e:
                continue
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, e - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
    give_back()


def spare_name(taken: list[str], name: str) -> str:
    """`name`, lengthened until it clashes with no column in `taken` (names are compared without case, as Spark does)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(lengths: np.ndarray, most: int = 2_000_000):
    """Row ranges (from, to) whose lengths sum to about `most` each, so that a batch's working arrays stay small."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every white-space word of every text, and each text's first index into them (one more than texts).

    Null texts count as empty. Each distinct word of the batch is hashed once.
    """
    import xxhash

    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(lists) else pa.array([], pa.string())
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(full)])
    coded = words.filter(pa.array(full)).dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    return own[coded.indices.to_numpy()] if len(own) else np.empty(0, np.uint64), kept[offsets]


def shingle_hashes(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `k` words of every text, and each text's offsets into them.

    A text of 1 to k-1 words has one shingle, all its words; a text without words has none. Shingles never cross texts.
    """
    words, at = word_hashes(texts)
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(count)])
    if not out[-1]:
        return np.empty(0, np.uint64), out
    first = np.repeat(at[:-1] - out[:-1], count) + np.arange(out[-1])
    size = np.repeat(np.minimum(n, k), count)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    total = np.zeros(out[-1], np.uint64)
    for j in range(k):
        total = total * _STEP + np.where(j < size, padded[first + j], np.uint64(0))
    return mix64(total + size.astype(np.uint64)), out


def portions(batches, column: int, most: int = 4_000_000):
    """Batches cut so that the texts of `column` take about `most` bytes each: Python copies of texts stay small however many rows a batch has. Memory that the cuts leave unused goes back when the task ends."""
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        for start, end in slices(lengths + 64, most):
            yield b.slice(start, end - start)
        if not b.num_rows:
            yield b
    give_back()
