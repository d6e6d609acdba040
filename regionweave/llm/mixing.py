"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame operations only.

Every source's documents are put in a shuffled order and laid end to end, word by word; that line is cut into blocks of equal length. Slots of the mix are golden-ratio points; a point falls into one source's part of the cumulative target weights. The k-th slot of a source takes the source's k-th block, blocks being drawn in a permuted order, each once before any is drawn again and none a third time. So the schedule alone decides what is taken: `spans` lists it, `mix` sums it up by document, `apply_mix` puts documents in the schedule's order.

A source's share of the slots differs from its target by a few blocks at most, since the points are evenly spread; targets need not be whole blocks. Targets: the sources in code-point order, null last, weigh 3, 1, 2, repeating, and share 150% of all words; none exceeds twice its source's words, the excess being shared again by weight.

Null text counts as empty, size 0 takes 0. Rows without words still appear. Rows that are equal in all columns used share their takes between them in some order. A table without words has targets of 0 and no slots. A very long text spans many blocks. The order of documents depends on doc_id (on the text where that is null) and the seed alone, so reruns agree. Other columns of any name pass through `apply_mix` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, partitions, release, spare_name, table

#: A run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, REPEATS = (3.0, 1.0, 2.0), 1.5, 2
BLOCK_WORDS = 512
#: Documents, or slots, that one window orders; a source has as many groups of them as it needs.
GROUP_ROWS, RUN_SLOTS = 1024, 16384
#: Golden-ratio steps on a grid of 2 ** 30 points.
GRID, GOLDEN = 1 << 30, 663608941
#: Primes that step through a source's blocks; the second where the first divides their number.
STEPS = (1000003, 998244353)
#: Cells of the unit interval in which points and sources meet, at least.
CELLS = 1024


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Slim rows: doc_id, source, body (a hash of the text), size, place (the shuffled order), kept durably so that every later step sees the same ones."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return durable(docs.select("doc_id", "source", F.xxhash64("text").alias("body"), size.alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), own)).alias("place")))


def ordered(df: DataFrame, order: list[Column], value: str) -> DataFrame:
    """Rows with `nth` (their place in the order, from 0) and `upto` (the sum of `value` up to and with them): by ranges of the order, then over the ranges' totals, so no task holds all rows."""
    spark = df.sparkSession
    ranges = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id())
    held = durable(ranges)
    inner = W.partitionBy("part_").orderBy("at_")
    rows = held.withColumn("nth_", F.row_number().over(inner) - 1).withColumn("upto_", F.sum(value).over(inner.rowsBetween(W.unboundedPreceding, 0)))
    before = W.partitionBy(F.lit(0)).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    totals = held.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"), F.sum(value).alias("sum_"))
    totals = totals.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("rows_"), F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("base_"))
    out = durable(rows.join(totals, "part_").select(*df.columns, (F.col("nth_") + F.col("rows_")).alias("nth"), (F.col("upto_") + F.col("base_")).alias("upto")))
    release(held)
    return out


def targets(rows: DataFrame) -> DataFrame:
    """Per source, kept: source, source_size, target, low and high (the source's part of the cumulative targets, in whole words)."""
    per = durable(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    order = [F.col("source").asc_nulls_last()]
    listed = ordered(per, order, "source_size")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("nth") % len(WEIGHTS) + 1).cast("int"))
    caps = listed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(REPEATS))).alias("cap"))
    whole = SHARE * (caps.agg(F.sum("source_size")).first()[0] or 0)
    # the level rises as sources reach their caps; each round is one sum over the sources
    level, full = 0.0, -1
    while True:
        capped = F.col("cap") < F.lit(level) * F.col("weight")
        held, weights, n = caps.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight"))), F.count_if(capped)).first()
        if n == full or not weights:
            break
        full, level = n, (whole - (held or 0.0)) / weights
    target = F.least("cap", F.lit(level) * F.col("weight"))
    goals = durable(caps.select("source", "source_size", target.alias("target"), F.round(target).cast("long").alias("words")))
    out = durable(ordered(goals, order, "words").select("source", "source_size", "target", (F.col("upto") - F.col("words")).alias("low"), F.col("upto").alias("high")))
    release(per, listed, goals)
    return out


def lined(rows: DataFrame) -> DataFrame:
    """Rows with `start`, the words of their source before them in the shuffled order, and `nth`, which makes (source, group, nth) unique.

    A prefix of `place` splits a source into groups of about GROUP_ROWS documents: running sums within groups, then over groups' totals. A hot source has more groups, not a larger task.
    """
    groups = rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(GROUP_ROWS))).alias("groups"))
    rows = rows.crossJoin(F.broadcast(groups))  # one row
    rows = rows.withColumn("group", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.col("groups") / F.lit(1 << 32))).drop("groups")
    inner = W.partitionBy("source", "group").orderBy("place", "doc_id", "size", "body")
    rows = rows.withColumn("nth", F.row_number().over(inner)).withColumn("ahead", F.sum("size").over(inner.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    totals = rows.groupBy("source", "group").agg(F.sum("size").alias("total"))
    outer = W.partitionBy("source").orderBy("group").rowsBetween(W.unboundedPreceding, 0)
    bases = totals.select(F.col("source").alias("s_"), F.col("group").alias("g_"), (F.sum("total").over(outer) - F.col("total")).alias("base"))
    joined = rows.join(bases, F.col("source").eqNullSafe(F.col("s_")) & (F.col("group") == F.col("g_")))
    return joined.select("doc_id", "source", "body", "group", "nth", "size", (F.col("base") + F.col("ahead")).alias("start"))


def schedule(goals: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Slots of the mix: slot, source, block (its number in the source's line). A slot whose source has no block left is none.

    Points and sources meet in cells of the unit interval: a source lies in as many cells as it covers, and there are more cells than sources, so neither a large source nor many small ones crowd a task. Ranks are counted in runs of slots and then over the runs.
    """
    spark = goals.sparkSession
    sources, total = goals.agg(F.count(F.lit(1)), F.coalesce(F.max("high"), F.lit(0))).first()
    cells = max(CELLS, 1 << sources.bit_length())
    step = (F.col("id") % GRID) * F.lit(GOLDEN) % GRID
    slots = spark.range((total + block // 2) // block).select(F.col("id").alias("slot"), ((2 * step + 1) / F.lit(2.0 * GRID)).alias("point")).withColumn("cell", F.floor(F.col("point") * cells))
    part = goals.filter("high > low").select("source", "source_size", (F.col("low") / F.lit(float(total or 1))).alias("from_"), (F.col("high") / F.lit(float(total or 1))).alias("to_"))
    part = part.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from_") * cells), F.least(F.floor(F.col("to_") * cells), F.lit(cells - 1)))))
    hit = slots.join(part, "cell").filter("point >= from_ and point < to_").withColumn("run", F.floor(F.col("slot") / RUN_SLOTS)).select("slot", "source", "source_size", "run")
    hit = durable(hit)
    ranked = hit.withColumn("in_run", F.row_number().over(W.partitionBy("run", "source").orderBy("slot")))
    over = W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, 0)
    runs = hit.groupBy("run", "source").agg(F.count(F.lit(1)).alias("n"))
    runs = runs.select(F.col("run").alias("r_"), F.col("source").alias("s_"), (F.sum("n").over(over) - F.col("n")).alias("before"))
    ranked = ranked.join(runs, (F.col("run") == F.col("r_")) & F.col("source").eqNullSafe(F.col("s_"))).withColumn("k", F.col("before") + F.col("in_run") - 1)
    blocks = F.ceil(F.col("source_size") / block)
    stride = F.when(blocks % STEPS[0] == 0, STEPS[1]).otherwise(STEPS[0]) % blocks
    drawn = ((F.col("k") % blocks).cast("decimal(19,0)") * stride.cast("decimal(19,0)") + F.floor(blocks / 2).cast("decimal(19,0)")) % blocks.cast("decimal(19,0)")
    return ranked.filter(F.col("k") < blocks * REPEATS).select("slot", "source", drawn.cast("long").alias("block"))


def _met(rows: DataFrame, goals: DataFrame, block: int) -> DataFrame:
    """Rows in line with the slots that take a block they lie in: one row per document, block and slot; slot is null for a block that no slot takes and for rows without words."""
    touched = F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    line = lined(rows).withColumn("block", touched)
    slots = schedule(goals, block).select("slot", F.col("source").alias("s_"), F.col("block").alias("b_"))
    met = line.join(slots, F.col("source").eqNullSafe(F.col("s_")) & (F.col("block") == F.col("b_")), "left")
    begin = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    end = F.least("size", (F.col("block") + 1) * block - F.col("start"))
    return met.withColumn("begin", begin).withColumn("end", end).drop("s_", "b_")


def spans(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: slot, source, doc_id, start (the document's place in its source's line), begin and end (the words of the document that the slot's block holds)."""
    rows = sized(docs)
    return _met(rows, targets(rows), block).filter("slot is not null").select("slot", "source", "doc_id", "start", "begin", "end")


def mix(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Per row of `docs` (columns doc_id, source, text): doc_id, source, body (a hash of the text), size, source_size, target, taken (words of it that the slots' blocks hold)."""
    rows = sized(docs)
    goals = targets(rows)
    words = F.when(F.col("slot").isNotNull(), F.col("end") - F.col("begin"))
    taken = _met(rows, goals, block).groupBy("source", "group", "nth", "doc_id", "body", "size").agg(F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken"))
    per = goals.select(F.col("source").alias("t_"), "source_size", "target")
    return taken.join(per, F.col("source").eqNullSafe(F.col("t_"))).drop("t_", "group", "nth")


def apply_mix(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `docs` in the schedule's order, all columns: a document stands, whole, at every slot whose block holds its first word. Rows without words stay once, ahead of the others."""
    rows = sized(docs)
    first = _met(rows, targets(rows), block).filter("size = 0 or (begin = 0 and slot is not null)")
    at = F.struct(F.coalesce("slot", F.lit(-1)).alias("slot"), F.coalesce("start", F.lit(0)).alias("start"))
    takes = first.groupBy("doc_id", "source", "body").agg(F.array_sort(F.collect_list(at)).alias("takes"))  # two slots a row at most
    alike = rows.groupBy("doc_id", "source", "body").agg(F.count(F.lit(1)).alias("alike"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & a["source"].eqNullSafe(b["source"]) & (a["body"] == b["body"])
    verdict = takes.join(alike, same(takes, alike)).select(F.struct(takes["doc_id"], takes["source"], takes["body"], "takes", "alike").alias("mix"))
    # everything of ours is one column with a name that `docs` does not have
    ours = spare_name(docs.columns, "mix")
    verdict = verdict.withColumnRenamed("mix", ours)
    mine = verdict[ours]
    joined = docs.join(verdict, docs["doc_id"].eqNullSafe(mine["doc_id"]) & docs["source"].eqNullSafe(mine["source"]) & (F.xxhash64(docs["text"]) == mine["body"]))
    held = F.col(ours)
    # rows alike in id, source and text deal the takes among them; elsewhere there is one row
    single = joined.filter(held["alike"] == 1).withColumn(ours, held["takes"])
    number = spare_name([*docs.columns, ours], "nth")
    nth = F.row_number().over(W.partitionBy(held["doc_id"], held["source"], held["body"]).orderBy(F.lit(1)))
    ties = joined.filter(held["alike"] > 1).withColumn(number, nth)
    ties = ties.withColumn(ours, F.filter(held["takes"], lambda t, i: i % held["alike"] == F.col(number) - 1)).drop(number)
    both = single.unionByName(ties).withColumn(ours, F.explode(ours))
    order = [F.col(ours)["slot"], F.col(ours)["start"]]
    return both.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = rf"""
WITH rows_ AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS place
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM rows_ GROUP BY source),
caps AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM per),
step AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before_, 0.0::DOUBLE))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before_, 0.0::DOUBLE)) AS level
  FROM caps WINDOW before_ AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT min(level) FILTER (WHERE cap / weight = (SELECT min(cap / weight) FROM step WHERE level * weight <= cap)) AS level FROM step),
goal AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM water) * weight, cap)) AS target FROM caps),
part AS (
  SELECT *, CAST(sum(words) OVER (ORDER BY source NULLS LAST) AS BIGINT) AS high, CAST(sum(words) OVER () AS BIGINT) AS total,
         (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS blocks
  FROM (SELECT *, CAST(round(target) AS BIGINT) AS words FROM goal)),
slots AS (
  SELECT slot, (2 * ((slot % {GRID}) * {GOLDEN} % {GRID}) + 1) / {2 * GRID}.0::DOUBLE AS point
  FROM (SELECT unnest(range((SELECT (max(total) + {BLOCK_WORDS // 2}) // {BLOCK_WORDS} FROM part))) AS slot)),
ranked AS (
  SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k
  FROM slots JOIN part ON point >= (high - words) / total::DOUBLE AND point < high / total::DOUBLE),
taken_blocks AS (
  SELECT source, ((k % blocks)::HUGEINT * (CASE WHEN blocks % {STEPS[0]} = 0 THEN {STEPS[1]} ELSE {STEPS[0]} END % blocks) + blocks // 2) % blocks AS block, count(*) AS times
  FROM ranked WHERE k < blocks * {REPEATS} GROUP BY 1, 2),
line AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS a FROM rows_),
touched AS (SELECT r, source, size, a, unnest(range(a // {BLOCK_WORDS}, (a + size - 1) // {BLOCK_WORDS} + 1)) AS block FROM line WHERE size > 0),
sums AS (
  SELECT r, CAST(sum((least(a + size, (t.block + 1) * {BLOCK_WORDS}) - greatest(a, t.block * {BLOCK_WORDS})) * times) AS BIGINT) AS taken
  FROM touched t JOIN taken_blocks b ON t.block = b.block AND t.source IS NOT DISTINCT FROM b.source GROUP BY r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, coalesce(taken, 0) AS taken
FROM rows_ JOIN goal ON rows_.source IS NOT DISTINCT FROM goal.source LEFT JOIN sums USING (r)
"""
