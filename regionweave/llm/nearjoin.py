"""Similarity join on word shingles: MinHash candidates, Bayesian pruning, exact verification.

Two texts are linked when they share a MinHash band, survive the pruning, and the Jaccard similarity of their sets of five-word shingles is 0.8 or more. This holds alike for groups of every size.

1. Texts with equal shingle sets are one representative, so copies never meet in pairs. Sets are told apart by 128 bits of hash.
2. A representative has HASHES MinHash values. Pairs that agree on all values of one of BANDS bands are candidates (a pair at the threshold is missed with a chance of (1 - 0.8**4)**24, about 3 in a million).
3. Of a candidate pair the MinHash values are compared STEP at a time. After each step the pair is dropped when the posterior probability (uniform prior) that its similarity reaches the threshold is below TOLERANCE.
4. What is left is verified exactly on the sets of 64-bit shingle hashes.

No pairs are listed. Within a band the surviving candidates leave only a spanning forest, fewer rows than came in; the components of these forests are crowds (a band of more than HOT representatives puts all of them in one crowd unseen). All candidates of a representative that survive are in its crowd. A crowd's sets are dealt to tasks in blocks, two blocks a task, where candidates are found, pruned and verified again, tile by tile; only counts of links and a spanning forest leave a task. A large crowd has more blocks, never larger ones.

Per document: class_id (least doc_id among documents connected by links), n_links (documents other than itself that it is linked to). A text without words is linked to nothing. Null counts as empty. Rows are told apart by nothing but doc_id and text; equal rows are copies of each other. A null doc_id takes part and is never a class_id unless all of the class are null. Very long texts have long sets and are otherwise like others; empty tables give no rows; other columns of any name are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, give_back, groups_of, mix64, partitions, portions, release, shingle_hashes, slices, spare_name, table
from .components import components, spanning
from .exact import bloom, member

WORDS, THRESHOLD = 5, (4, 5)
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP, TOLERANCE = 16, 1e-6
#: Representatives of a band that are compared within it; a more common band makes a crowd of them, to be compared there.
HOT = 32
#: Bytes of a crowd's block, at most about; a crowd of more than SPREAD_ROWS representatives has up to SPREAD blocks even if they are small, so that several tasks share it.
BLOCK_BYTES, SPREAD, SPREAD_ROWS = 4 << 20, 8, 512
#: Representatives a side that are compared at once.
TILE = 256
_ODD = (mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (mix64(np.arange(1001, HASHES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def least_matches(n: int, threshold: float = THRESHOLD[0] / THRESHOLD[1], tolerance: float = TOLERANCE) -> int:
    """The fewest matches among n values with which a pair's posterior probability of reaching the threshold is not below the tolerance.

    With a uniform prior that probability, given m matches, is the chance of at most m successes in n + 1 draws of the threshold.
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


CUTS = [(n, least_matches(n)) for n in range(STEP, HASHES + 1, STEP)]


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values (one row of HASHES 16-bit values) of each non-empty run of shingle hashes."""
    out = np.empty((len(at) - 1, HASHES), np.uint16)
    if len(at) > 1:
        short = (h >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(short * _ODD[k] + _SHIFT[k], at[:-1]) >> np.uint32(16)
    return out


def _sets(texts: pa.Array):
    """For row ranges of a batch: first row, rows with words, and the sorted distinct shingle hashes of each."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for start, end in slices(lengths, 2_000_000):
        h, at = shingle_hashes(texts.slice(start, end - start), WORDS)
        rows = np.flatnonzero(np.diff(at))
        yield start, rows, [np.unique(h[at[i] : at[i + 1]]) for i in rows]


def _identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed integers."""
    import xxhash

    n = xxhash.xxh3_128_intdigest(s.tobytes())
    return (n >> 64) - (1 << 63), (n & ((1 << 64) - 1)) - (1 << 63)


def signed(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, rep and twin (the identity of its shingle set; null without words), n (the set's size), values (MinHash values as bytes)."""

    def sign(batches):
        for b in portions(batches, 1):
            ids, texts = b.column(0), b.column(1)
            names, sizes, values = [(None, None)] * b.num_rows, [0] * b.num_rows, [None] * b.num_rows
            for start, rows, sets in _sets(texts):
                if not sets:
                    continue
                sig = signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
                for i, s, v in zip(rows.tolist(), sets, sig, strict=True):
                    names[start + i], sizes[start + i], values[start + i] = _identity(s), len(s), v.tobytes()
            reps, twins = (pa.array([n[k] for n in names], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, reps, twins, pa.array(sizes, pa.int32()), pa.array(values, pa.binary())], ["doc_id", "rep", "twin", "n", "values"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, rep long, twin long, n int, values binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sets of the representatives in `wanted` (rep, twin, node): node, shingles (sorted 64-bit hashes as bytes), from one more scan in which a bounded Bloom filter holds back the others."""
    words = docs.sparkSession.sparkContext.broadcast(bloom(wanted, "rep"))

    def cut(batches):
        sent = set()  # what this task has sent: copies go out once
        for b in portions(batches, 0):
            names, shingles = [], []
            for _, _, sets in _sets(b.column(0)):
                own = [_identity(s) for s in sets]
                hit = member(words.value, np.array([n[0] for n in own], np.int64)) if own else ()
                for name, s, ok in zip(own, sets, hit, strict=True):
                    if ok and name not in sent:
                        sent.add(name)
                        names.append(name)
                        shingles.append(s.tobytes())
            reps, twins = (pa.array([n[k] for n in names], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([reps, twins, pa.array(shingles, pa.binary())], ["rep", "twin", "shingles"])

    found = docs.select("text").mapInArrow(cut, "rep long, twin long, shingles binary")
    return found.join(wanted, ["rep", "twin"]).groupBy("node").agg(F.any_value("shingles").alias("shingles"))


def _bands(batches):
    for b in batches:
        if not b.num_rows:
            continue
        values = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), values.shape[:2]).copy()
        for r in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
        nodes = np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(nodes)], ["band", "node"])


def survivors(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of two tables of MinHash values agree on a whole band and stay after comparing STEP values at a time."""
    alive = np.arange(len(x))
    matches, shared = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    for n, least in CUTS:
        same = x[alive, n - STEP : n] == y[alive, n - STEP : n]
        shared[alive] |= same.reshape(-1, STEP // ROWS, ROWS).all(2).any(1)
        matches[alive] += same.sum(1)
        alive = alive[matches[alive] >= least]
    return alive[shared[alive]]


def _values(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _forest(batches):
    """Of rows (band, node, values) sorted by band, a spanning forest (a, b) of the surviving candidates of each band."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        band, node, values = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), _values(b.column(2))
        if held is not None:  # the last band of the batch before may go on here
            band, node, values = (np.concatenate([h, v]) for h, v in zip(held, (band, node, values), strict=True))
        at_a, at_b = [], []
        for d in range(1, HOT):
            i = np.flatnonzero(band[d:] == band[:-d])
            if not len(i):
                break
            at_a.append(i)
            at_b.append(i + d)
        if at_a:
            i, j = np.concatenate(at_a), np.concatenate(at_b)
            alive = np.concatenate([k + survivors(values[i[k : k + 65536]], values[j[k : k + 65536]]) for k in range(0, len(i), 65536)])
            a, b_ = node[i[alive]], node[j[alive]]
            kept = spanning(a, b_)
            yield pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b_[kept])], ["a", "b"])
        last = band == band[-1]
        held = (band[last], node[last], values[last].copy())
    give_back()


def linked(common, n, m):
    """Whether sets of sizes n and m with so many common members reach the threshold, in whole numbers."""
    return common * THRESHOLD[1] >= (n + m - common) * THRESHOLD[0]


def common_counts(xs: list[np.ndarray], ys: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of incidence matrices, so many members at a time."""
    flat = np.concatenate([*xs, *ys])
    owner = np.repeat(np.arange(len(xs) + len(ys)), [len(s) for s in [*xs, *ys]])
    _, member, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    ok = times[member] > 1
    owner, member = owner[ok], shared[member[ok]]
    order = np.argsort(member, kind="stable")
    owner, member = owner[order], member[order]
    out = np.zeros((len(xs), len(ys)), np.float64)
    for start in range(0, int(member[-1]) + 1 if len(member) else 0, columns):
        a, b = np.searchsorted(member, [start, start + columns])
        grid = np.zeros((len(xs) + len(ys), columns), np.float32)
        grid[owner[a:b], member[a:b] - start] = 1
        out += grid[: len(xs)] @ grid[len(xs) :].T
    return out.astype(np.int64)


def tile_links(x: tuple, y: tuple, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked rows of two tiles (MinHash values, sets, sizes), or of pairs inside one."""
    values_x, sets_x, sizes_x = x
    values_y, sets_y, sizes_y = y
    i, j = np.triu_indices(len(sizes_x), 1) if inside else (v.ravel() for v in np.indices((len(sizes_x), len(sizes_y))))
    small, large = np.minimum(sizes_x[i], sizes_y[j]), np.maximum(sizes_x[i], sizes_y[j])
    near = np.flatnonzero(small * THRESHOLD[1] >= large * THRESHOLD[0])  # a similarity is at most the ratio of the sizes
    i, j = i[near], j[near]
    alive = survivors(values_x[i], values_y[j])
    i, j = i[alive], j[alive]
    if len(i) <= 4 * (len(sizes_x) + len(sizes_y)):
        common = np.array([len(np.intersect1d(sets_x[a], sets_y[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    else:
        common = common_counts(sets_x, sets_y)[i, j]
    ok = linked(common, sizes_x[i], sizes_y[j])
    return i[ok], j[ok]


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) among n nodes as stars: every node that has a link, beside the least node that it is connected to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return np.flatnonzero(label != np.arange(n)), label[label != np.arange(n)]
        label = new


def _blocks(batches):
    """Links of every group (crowd, i, j) of rows (crowd, i, j, side, node, copies, values, shingles): per representative the copies it is linked to (a = b), and a spanning forest (links 0)."""
    for group in groups_of(batches, 3):
        i, j = group.column(1)[0].as_py(), group.column(2)[0].as_py()
        side, node, copies = (group.column(k).to_numpy() for k in (3, 4, 5))
        sets = [np.frombuffer(s, np.uint64) for s in group.column(7).to_pylist()]
        sizes = np.array([len(s) for s in sets])
        values = _values(group.column(6))
        order = np.argsort(sizes, kind="stable")  # so that most far tiles differ too much in size
        own, other = order[side[order] == i], order[side[order] == j]
        inside = i == j
        gained, a, b = np.zeros(len(node), np.int64), [], []
        tiles = lambda rows: [rows[k : k + TILE] for k in range(0, len(rows), TILE)]
        for p, rows in enumerate(tiles(own)):
            x = values[rows], [sets[r] for r in rows], sizes[rows]
            for q, columns in enumerate(tiles(other)):
                if inside and q < p:
                    continue
                if sizes[rows[-1]] * THRESHOLD[1] < sizes[columns[0]] * THRESHOLD[0] or sizes[columns[-1]] * THRESHOLD[1] < sizes[rows[0]] * THRESHOLD[0]:
                    continue
                same = inside and p == q
                y = x if same else (values[columns], [sets[r] for r in columns], sizes[columns])
                at_x, at_y = tile_links(x, y, same)
                if not len(at_x):
                    continue
                rows_x, rows_y = rows[at_x], columns[at_y]
                gained += np.bincount(rows_x, copies[rows_y], len(node)).astype(np.int64) + np.bincount(rows_y, copies[rows_x], len(node)).astype(np.int64)
                both = rows if same else np.concatenate([rows, columns])
                leaf, root = _stars(at_x, at_y if same else at_y + len(rows), len(both))
                a.append(node[both[leaf]])
                b.append(node[both[root]])
        if not a:
            continue
        a, b = np.concatenate(a), np.concatenate(b)
        kept, has = spanning(a, b), np.flatnonzero(gained)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([node[has], a[kept]])), pa.array(np.concatenate([node[has], b[kept]])), pa.array(np.concatenate([gained[has], np.zeros(len(kept), np.int64)]))], ["a", "b", "links"]
        )


def _crowds(reps: DataFrame) -> DataFrame:
    """Components (node, label) over surviving candidates of the representatives `reps` (node, values); kept."""
    bands = durable(reps.select("node", "values").mapInArrow(_bands, "band long, node long"))
    shared = durable(bands.groupBy("band").agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("head")).filter("many > 1"))
    met = durable(bands.join(shared, "band"))
    release(bands, shared)
    few = met.filter(F.col("many") <= HOT).select("band", "node").join(reps.select("node", "values"), "node").select("band", "node", "values")
    seen = few.repartition(partitions(reps.sparkSession), "band").sortWithinPartitions("band").mapInArrow(_forest, "a long, b long")
    common = met.filter(F.col("many") > HOT).select(F.col("node").alias("a"), F.col("head").alias("b"))
    out = components(seen.unionByName(common))
    release(met)
    return out


def join(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (columns doc_id, text): doc_id, class_id, n_links."""
    rows = durable(signed(docs))
    named = rows.filter("rep is not null").groupBy("rep", "twin").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("values").alias("values"))
    reps = durable(named.withColumn("node", F.monotonically_increasing_id()))  # once kept, a number is fixed
    found = _crowds(reps)
    crowds = found.select("node", F.col("label").alias("crowd"))

    members = durable(crowds.join(reps, "node").select("node", "crowd", "rep", "twin", "n", "copies", "values"))
    release(found)
    sets = durable(shingle_sets(docs, members.select("rep", "twin", "node")))
    many = F.count(F.lit(1))
    blocks = F.greatest(F.ceil(F.sum(F.col("n") * 8 + 2 * HASHES) / BLOCK_BYTES), F.least(F.lit(SPREAD), F.ceil(many / SPREAD_ROWS))).cast("int")
    sized = durable(members.groupBy("crowd").agg(blocks.alias("blocks")))
    seated = members.join(sized, "crowd").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sets, "node")
    dealt = seated.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("crowd", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "copies", "values", "shingles")
    keys = ["crowd", "i", "j"]
    links = durable(dealt.repartition(partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(_blocks, "a long, b long, links long"))
    release(members, sets, sized)

    labels = components(links.select("a", "b"))
    gained = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    told = reps.select("node", "rep", "twin", "first_id", "copies").join(labels.select("node", F.col("label").alias("class")), "node", "left").join(gained, "node", "left")
    told = durable(told.withColumn("class", F.coalesce("class", "node")))
    release(labels, links, reps)
    classes = durable(told.groupBy("class").agg(F.min("first_id").alias("class_id")))
    final = durable(told.join(classes, "class").select("rep", "twin", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    release(told, classes)
    plain = rows.filter("rep is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.filter("rep is not null").select("doc_id", "rep", "twin").join(final, ["rep", "twin"]).select("doc_id", "class_id", "n_links").unionByName(plain)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with one document (the least doc_id) of each class, all columns. A doc_id on several rows stays where any of them stays."""
    own = spare_name(docs.columns, "gone_id")
    verdict = join(docs).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("class_id")))
    gone = durable(verdict.groupBy(F.col("doc_id").alias(own)).agg(F.max("stays").alias("stays")).filter("not stays").select(own))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[own]), "left_anti")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class and the number of its links."""
    return join(table(spark, sf_dir, "documents"))
