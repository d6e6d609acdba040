"""Line deduplication by a log-template tree of fixed depth, with DataFrame functions only.

A line's leaf in the tree is its number of words and its first LEAD words; words that hold a digit, an at sign or a URL are variable fields from the start. The rest of a line is cut into PARTS runs of words. Lines of a leaf that agree on any two runs, place by place, are one template whose other runs are variable: fields may stand in any two runs, and at least about half of a template is constant. Lines under LEAST_WORDS words must agree on everything. A template found in MIN_DOCUMENTS documents or more is recurring, and its lines are dropped from all of them; so is a line of more than LONG_WORDS words that stands whole in LONG_DOCUMENTS documents.

Lines are parted by line feeds. Lines without words stay. Null text counts as empty and stays null in `clean`. Rows with equal doc_id and text are one document and get equal results. An empty table gives no rows; a very long text or line is treated like others; other columns of any name are not read. Templates are 64-bit hashes. Only lines whose leaf is met twice are compared at all; counts are partial sums before they are shuffled, so a line that a third of all documents share costs one row a task.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

LEAD, LEAST_WORDS, MIN_DOCUMENTS = 3, 8, 3
PARTS, LONG_WORDS, LONG_DOCUMENTS = 4, 50, 2
SPACES, GAP = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"
#: Words with a digit, an at sign or "://" are variable fields.
FIELD = r"[^\x20\x09-\x0D]*(?:[0-9@]|://)[^\x20\x09-\x0D]*"
MARK = "<*>"


def _words(line: Column) -> Column:
    """The words of a line, variable fields marked; a line without words gives one empty word. Few lines hold a field, so most are spared the replacement."""
    marked = F.when(F.rlike(line, F.lit("[0-9@]|://")), F.regexp_replace(line, FIELD, MARK)).otherwise(line)
    return F.split(F.btrim(marked, F.lit(SPACES)), GAP)


def _parsed(words: Column) -> Column:
    """A line's leaf, the hashes of its runs (none for a short line), and whether it is long; null without words."""
    n = F.size(words)
    rest = F.greatest(n - LEAD, F.lit(0))
    cut = lambda p: F.floor(rest * p / PARTS).cast("int")
    runs = F.array(*[F.xxhash64(F.slice(words, cut(p) + LEAD + 1, cut(p + 1) - cut(p))) for p in range(PARTS)])
    short = n < LEAST_WORDS
    line = F.struct(
        F.when(short, F.xxhash64(n, words)).otherwise(F.xxhash64(n, F.slice(words, 1, LEAD))).alias("leaf"),
        F.when(~short, runs).alias("runs"), (n > LONG_WORDS).alias("long"),
    )
    return F.when((n > 1) | (F.get(words, F.lit(0)) != ""), line)


def _keys(line: Column) -> Column:
    """The templates of a parsed line as array<struct<key, need>>: one for each two runs, one for the whole of a short or long line."""
    key = lambda k, need: F.struct(k.alias("key"), F.lit(need).alias("need"))
    pairs = [key(F.xxhash64(line["leaf"], F.lit(PARTS * a + b), F.get(line["runs"], F.lit(a)), F.get(line["runs"], F.lit(b))), MIN_DOCUMENTS) for a, b in combinations(range(PARTS), 2)]
    whole = key(F.xxhash64(line["leaf"], line["runs"]), LONG_DOCUMENTS)
    return F.when(line["runs"].isNull(), F.array(key(line["leaf"], MIN_DOCUMENTS))).when(line["long"], F.array(*pairs, whole)).otherwise(F.array(*pairs))


def parsed_lines(text: Column) -> Column:
    """Per line of a text, its place in the tree (null for a line without words)."""
    # a one-element array binds the words, so that they are split once
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.get(F.transform(F.array(_words(line)), _parsed), F.lit(0)))


def dropped(docs: DataFrame) -> DataFrame:
    """Rows of `docs` (doc_id, text) with `gone`: the positions (from 0) of lines whose template recurs."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("body_"))
    each = rows.select("doc_id", "body_", F.posexplode(parsed_lines(F.col("text"))).alias("at", "line")).filter("line is not null")
    each = durable(each.select("doc_id", "body_", "at", "line", F.col("line.leaf").alias("leaf")))  # slim, used twice
    met = each.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 1").select("leaf")
    keyed = each.join(met, "leaf", "left_semi").select("doc_id", "body_", "at", F.explode(_keys(F.col("line"))).alias("k"))
    keyed = durable(keyed.select("doc_id", "body_", "at", "k.key", "k.need"))
    recurring = keyed.select("doc_id", "body_", "key", "need").distinct().groupBy("key", "need").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") >= F.col("need")).select("key")
    hit = keyed.join(recurring, "key", "left_semi").groupBy("doc_id", "body_").agg(F.sort_array(F.collect_set("at")).alias("gone_"))
    hit = hit.withColumnsRenamed({"doc_id": "id_", "body_": "was_"})
    joined = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("body_") == F.col("was_")), "left")
    return joined.select("doc_id", "text", F.coalesce("gone_", F.array().cast("array<int>")).alias("gone"))


def clean(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, clean (the text without recurring lines; null stays null), n_lines, n_dropped."""
    lines = F.split("text", "\n")
    kept = F.filter(F.transform(lines, lambda line, i: F.struct(line.alias("line"), i.alias("i"))), lambda s: ~F.array_contains("gone", s["i"]))
    text = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s["line"]), "\n"))
    return dropped(docs).select("doc_id", text.alias("clean"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), F.array_join("gone", ",").alias("dropped_lines"))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines, as a digest."""
    return clean(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "dropped_lines", F.sha2(F.coalesce("clean", F.lit("")), 256).alias("clean_sha256"))


_RUN = "array_to_string(w[4 + (n - 3) * {p} // 4 : 3 + (n - 3) * ({p} + 1) // 4], ' ')"
_PAIRS = ", ".join(f"'p{a}{b} ' || lead || {_RUN.format(p=a)} || chr(10) || {_RUN.format(p=b)}" for a, b in combinations(range(PARTS), 2))
OP9_SQL = rf"""
WITH rows_ AS (SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY doc_id, md5(coalesce('t' || text, ''))) AS d, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines_ AS (SELECT r, d, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM rows_),
words_ AS (
  SELECT r, d, i, line, regexp_extract_all(regexp_replace(line, '[^\x20\x09-\x0D]*(?:[0-9@]|://)[^\x20\x09-\x0D]*', '<*>', 'g'), '[^\x20\x09-\x0D]+') AS w
  FROM lines_),
sized AS (SELECT *, len(w) AS n, len(w) || ' ' || array_to_string(w[1:3], ' ') || chr(10) AS lead FROM words_ WHERE len(w) > 0),
keyed AS (
  SELECT r, d, i, unnest(CASE WHEN n < 8 THEN ['s' || n || ' ' || array_to_string(w, ' ')]
    WHEN n > 50 THEN list_concat(['w' || array_to_string(w, ' ')], [{_PAIRS}]) ELSE [{_PAIRS}] END) AS key
  FROM sized),
recurring AS (SELECT key FROM keyed GROUP BY key HAVING count(DISTINCT d) >= CASE WHEN key LIKE 'w%' THEN 2 ELSE 3 END),
gone AS (SELECT DISTINCT r, i FROM keyed WHERE key IN (SELECT key FROM recurring)),
kept AS (
  SELECT r, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT g) AS clean, count(*) AS n_lines, count(*) FILTER (WHERE g) AS n_dropped,
         coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (WHERE g), '') AS dropped_lines
  FROM (SELECT l.r, l.i, l.line, g.i IS NOT NULL AS g FROM lines_ l LEFT JOIN gone g ON l.r = g.r AND l.i = g.i) GROUP BY r)
SELECT doc_id, n_lines, n_dropped, dropped_lines, sha256(coalesce(clean, '')) AS clean_sha256 FROM kept JOIN rows_ USING (r)
"""
