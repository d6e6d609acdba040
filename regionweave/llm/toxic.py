"""Toxicity by compression distance: how much shorter a window gets with a dictionary of toxic text than with one of ordinary text.

Two zstandard dictionaries are made: one is trained on ordinary text, the other holds the toxic passages of toxic documents (words that are, or hold a letter run that is, much commoner in toxic documents than in ordinary ones; the rest of a document is left out, since most of a toxic document is ordinary). Passages stand in order of how common they are, as many of the commonest as DICTIONARY_BYTES hold. A window is one word (a long word: overlapping runs of its characters) with its leading space. Its margin is the difference of its two compressed lengths; SPAN words in a row are compared by the sum of their margins, none below zero. Counts and shares of windows and spans whose margin reaches each threshold are calibrated to a probability on documents that the dictionaries did not see: the sample is cut in FOLDS parts by how texts begin, so that copies and most near copies are in one part, and each part is measured with dictionaries of the others.

Learning uses at most SAMPLE labelled documents of each class, none of them held out; labels, language, source and id are no inputs of a score. Null and empty texts have no window and get the score of none. Without toxic or without ordinary examples every score is the share of toxic ones. Very long texts are scored whole; equal texts get equal scores, so repeated rows and ties do too; an empty table gives no rows; other columns of any name are not read, or pass through `keep_clean`.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, table
from .learning import Logistic, held_out, labelled_sample

#: Labelled documents of each class to learn from, at most.
SAMPLE = 2000
#: Parts of the sample in calibration, and the ridge that keeps its weights small.
FOLDS, RIDGE = 2, 20.0
#: Bytes of a dictionary; how much commoner the words and runs that mark toxic passages must be (natural logarithm of the odds), and in how many documents.
DICTIONARY_BYTES, CONTRAST, LEAST_DOCUMENTS = 16384, 2.5, 4
#: Letters of the runs, spaces around a word included; words in a row that are compared together, and what they must save in bytes.
RUNS, SPAN, SPAN_THRESHOLDS = (5, 6, 7, 8), 8, (7, 14, 21, 28)
#: Margins in bytes that count; words longer than WINDOW characters are cut into runs that overlap by a quarter.
THRESHOLDS, WINDOW = (1, 2, 3, 4, 5, 6, 7), 64
#: Margins of at least WHOLE bytes also count by what share of the window they save: a word that a dictionary holds whole saves most of it.
SHARES, WHOLE = (0.5, 0.6, 0.7, 0.8), 3
CACHE_WORDS = 150_000
#: zstandard finds no match in the last bytes of its input, so every window ends with these.
_TAIL = b" " + b"\n" * 10


def windows(text: str | None) -> list[str]:
    """The windows of a text, in lower case."""
    words = (text or "").lower().split()
    if any(len(w) > WINDOW for w in words):
        step = WINDOW * 3 // 4
        words = [p for w in words for p in ([w] if len(w) <= WINDOW else [w[i : i + WINDOW] for i in range(0, len(w) - WINDOW // 4, step)])]
    return words


def _runs(word: str, n: int) -> set[str]:
    """The word's runs of `n` characters, with the space before it and the one after it."""
    word = f" {word} "
    return {word[i : i + n] for i in range(len(word) - n + 1)}


def _marks(toxic: list[set[str]], ordinary: list[set[str]]) -> set[str]:
    """Whole words and letter runs that are much commoner in toxic documents than in ordinary ones; documents are sets of words.

    Lengths are taken in turn: a run can only be in LEAST_DOCUMENTS documents if its beginning is, so few runs are held.
    """

    def marking(pieces, common: set[str] | None = None) -> tuple[set[str], set[str]]:
        counts: Counter = Counter()
        for words in toxic:
            counts.update({r for r in pieces(words) if common is None or r[:-1] in common})
        enough = {r for r, n in counts.items() if n >= LEAST_DOCUMENTS}
        other: Counter = Counter()
        for words in ordinary:
            other.update(enough.intersection(pieces(words)))
        # less one standard error, so that few documents need a clearer difference
        odds = lambda r: math.log((counts[r] + 0.5) / (len(toxic) + 1)) - math.log((other[r] + 0.5) / (len(ordinary) + 1)) - math.sqrt(1 / (counts[r] + 0.5) + 1 / (other[r] + 0.5))
        return {r for r in enough if odds(r) > CONTRAST}, enough

    marks, _ = marking(lambda words: {f" {w} " for w in words})
    common = None
    for n in RUNS:
        found, common = marking(lambda words, n=n: set().union(*(_runs(w, n) for w in words)), common)
        marks |= found
    return marks


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary."""
    import zstandard as z

    seen = [[set(windows(t)) for t in texts] for texts in (toxic, ordinary)]
    marks = _marks(*seen)
    passages = Counter(w for words in seen[0] for w in words if f" {w} " in marks or any(r in marks for n in RUNS for r in _runs(w, n)))
    plain = [f" {w}" for t in ordinary for w in windows(t)]
    lines = ["".join(plain[i : i + 12]) for i in range(0, len(plain), 12)]

    def trained(samples: list[str]) -> bytes:
        data = [s.encode("utf-8", "surrogatepass") for s in samples]
        try:
            return z.train_dictionary(DICTIONARY_BYTES, data, k=64, d=6).as_bytes()
        except z.ZstdError:
            if sum(map(len, data)) > 64 * DICTIONARY_BYTES:
                raise
            return b"".join(data).rjust(8, b" ")  # too little text to train on: the text itself, all of it, serves

    # every passage once and the commonest last: training would leave out those of the rarer languages
    held = "".join(f" {w}" for w, _ in sorted(passages.items(), key=lambda p: (p[1], p[0])))
    return (held.encode("utf-8", "surrogatepass") or b" ")[-DICTIONARY_BYTES:].rjust(8, b" "), trained(lines)


class Margins:
    """Margins of windows under two dictionaries, remembered for recent words."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as z

        made = z.ZstdCompressionParameters.from_level(3, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compressors = []
        for content in (ordinary, toxic):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=made)
            self.compressors.append(z.ZstdCompressor(dict_data=d, compression_params=made).compress)
        self.known: dict[str, int] = {}

    def margin(self, word: str) -> int:
        data = b" " + word.encode("utf-8", "surrogatepass") + _TAIL
        ordinary, toxic = (len(c(data)) for c in self.compressors)
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        saved = max(0, min(ordinary - toxic, THRESHOLDS[-1]))
        share = sum((ordinary - toxic) >= s * len(data) - s * len(_TAIL) - s for s in SHARES) if saved >= WHOLE else 0
        got = self.known[word] = saved * (len(SHARES) + 1) + share
        return got

    def features(self, text: str | None) -> list[float]:
        """For each threshold of the margin of a word, of its share of the word, and of the margin of SPAN words in a row, how many reach it, as a logarithm and as a share; and how many distinct words reach WHOLE."""
        words, known, margin = windows(text), self.known, self.margin
        kinds = len(SHARES) + 1
        codes = []
        for w in words:
            m = known.get(w)
            codes.append(margin(w) if m is None else m)
        found = np.array(codes, np.int64)
        held = np.bincount(found, minlength=(THRESHOLDS[-1] + 1) * kinds)
        counts = [int(held[t * kinds :].sum()) for t in THRESHOLDS]
        by_share = held.reshape(-1, kinds).sum(0)
        counts += [int(by_share[s:].sum()) for s in range(1, kinds)]
        saved = found // kinds
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(saved)])
        spans = total[SPAN:] - total[:-SPAN] if len(words) > SPAN else total[-1:]
        counts += [int((spans >= t).sum()) for t in SPAN_THRESHOLDS]
        distinct = len({words[i] for i in np.flatnonzero(saved >= WHOLE)})
        return [*(math.log1p(c) for c in counts), *(c / (len(words) + 5) for c in counts), math.log1p(distinct)]


def _folds(texts: list[str]) -> list[list[str]]:
    """The texts in FOLDS parts by a hash of their beginnings; where a part would be empty, they are dealt in turn."""
    from xxhash import xxh3_64_intdigest

    parts: list[list[str]] = [[] for _ in range(FOLDS)]
    for t in texts:
        parts[xxh3_64_intdigest(t[:48].encode("utf-8", "surrogatepass")) % FOLDS].append(t)
    return parts if all(parts) else [texts[k::FOLDS] for k in range(FOLDS)]


class Model:
    """Dictionaries and calibration; small enough to travel with each task."""

    def __init__(self, sample: list[tuple[str, int]]):
        toxic, ordinary = ([t for t, y in sample if y == k] for k in (1, 0))
        self.prior = len(toxic) / max(1, len(sample))
        self.logistic = None
        if len(toxic) < 2 or len(ordinary) < 2:
            return
        folds = [_folds(texts) for texts in (toxic, ordinary)]
        x, y = [], []
        for fold in range(FOLDS):  # features of each part under dictionaries of the others
            m = Margins(*train_dictionaries(*[[t for k, part in enumerate(f) if k != fold for t in part] for f in folds]))
            for f, label in zip(folds, (1, 0), strict=True):
                x += [m.features(t) for t in f[fold]]
                y += [label] * len(f[fold])
        self.logistic = Logistic(np.array(x), np.array(y, float), ridge=RIDGE)
        self.dictionaries = train_dictionaries(toxic, ordinary)

    def shift(self, toxic: int, ordinary: int) -> None:
        """Moves the calibration from the sample's share of toxic documents to that among all labelled ones."""
        if self.logistic is not None and toxic and ordinary:
            self.logistic.beta[0] += math.log(toxic / ordinary) - math.log(self.prior / (1 - self.prior))
        self.prior = toxic / max(1, toxic + ordinary)

    def scorer(self):
        """A function from a text to its probability."""
        if self.logistic is None:
            return lambda texts: np.full(len(texts), self.prior)
        m = Margins(*self.dictionaries)
        return lambda texts: self.logistic.predict(np.array([m.features(t) for t in texts]).reshape(len(texts), -1)) if len(texts) else np.empty(0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model learnt from labelled documents that are not held out."""
    model = Model(labelled_sample(docs, labels, "toxic", SAMPLE))
    counted = {r[0]: r[1] for r in labels.filter(~held_out(F.col("doc_id"))).groupBy(F.col("toxic").cast("int")).count().collect() if r[0] in (0, 1)}
    model.shift(counted.get(1, 0), counted.get(0, 0))
    return model


def score_frame(docs: DataFrame, model: Model, column: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of `docs`: `key` and score; only two columns are read."""

    def score(batches):
        scorer = model.scorer()
        for b in portions(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer(b.column(1).to_pylist()), pa.float64())], [key, "score"])

    return docs.select(key, column).mapInArrow(score, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score lies below the threshold, all columns."""
    schema, place = docs.schema, docs.columns.index("text")

    def keep(batches):
        scorer = model.scorer()
        for b in portions(batches, place):
            texts = b.column(place).to_pylist()
            yield b.filter(pa.array(scorer(texts) < threshold, pa.bool_()))

    return docs.mapInArrow(keep, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; the model is learnt first, then one scan, no shuffle."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_frame(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
