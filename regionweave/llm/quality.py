"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's state depends on its own features and on its neighbours' (shares of symbols, capitals, digits, bars and exclamation marks, repeated and distinct words, word length, a line equal to the one before) and on the states of the lines beside it. Forward-backward gives each line's probability of being good; their mean, weighted by the lines' lengths, is calibrated to the document's score.

Training: lines inherit their document's label; at most SAMPLE labelled documents of each class, none of them held out; labels, language, source and id are no inputs of a score. Null counts as empty, an empty text is one empty line. Without examples of both classes every score is the share of good ones. The lines of a document are worked on together, so memory follows the longest document of a batch. Equal texts get equal scores, so repeated rows and ties do too; an empty table gives no rows; other columns of any name are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, word_hashes
from .learning import Logistic, held_out, labelled_sample

#: Labelled documents of each class to learn from, at most; steps of the optimiser; documents longer than TRAIN_LINES lines are learnt from in pieces.
SAMPLE, STEPS, TRAIN_LINES = 1500, 200, 64
_CLASSES = np.zeros(256, np.uint8)  # 0 other, 1 capital, 2 digit, 3 bar, 4 exclamation mark, 5 other symbol, 6 full stop or comma
for _c in range(128):
    _s = chr(_c)
    _CLASSES[_c] = 1 if _s.isupper() else 2 if _s.isdigit() else 3 if _s == "|" else 4 if _s == "!" else 6 if _s in ".," else 5 if _s.isprintable() and not _s.isalnum() and not _s.isspace() else 0
BASE = 11


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of every text (own, previous, next line's), the lines' lengths in bytes, and each text's first line."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    lines = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    at = offsets - offsets[0]
    length = pc.binary_length(lines).to_numpy().astype(np.int64)
    n = len(lines)
    ends = np.concatenate([[0], np.cumsum(length)])
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8) if n and ends[-1] else np.empty(0, np.uint8)
    if len(data):
        first = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset]
        data = data[first : first + ends[-1]]
    kinds = _CLASSES[data]
    shares = []
    for k in range(1, 7):
        run = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)])
        shares.append((run[ends[1:]] - run[ends[:-1]]) / np.maximum(length, 1))
    words, word_at = word_hashes(lines)
    count = np.diff(word_at)
    line_of = np.repeat(np.arange(n), count)
    twice = np.zeros(len(words), bool)
    if len(words) > 1:
        twice[1:] = (words[1:] == words[:-1]) & (line_of[1:] == line_of[:-1])
    repeated = np.bincount(line_of, twice, n) / np.maximum(count, 1)
    order = np.lexsort((words, line_of))
    fresh = np.ones(len(words), bool)
    if len(words) > 1:
        w, o = words[order], line_of[order]
        fresh[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    distinct = np.where(count > 0, np.bincount(line_of[order], fresh, n) / np.maximum(count, 1), 1.0)
    code = lines.dictionary_encode().indices.to_numpy()
    starts = np.zeros(n + 1, bool)
    starts[at] = True
    same = np.zeros(n)
    if n > 1:
        same[1:] = (code[1:] == code[:-1]) & ~starts[1:n]
    own = np.column_stack([*shares, repeated, 1 - distinct, length / np.maximum(count, 1) / 20, same, np.log1p(count) / 8]).clip(0, 3)
    own = np.column_stack([own, np.sqrt(own)])
    before, after = np.zeros_like(own), np.zeros_like(own)
    if n > 1:
        before[1:] = np.where(starts[1:n, None], 0, own[:-1])
        after[:-1] = np.where(starts[1:n, None], 0, own[1:])
    return np.column_stack([np.ones(n), own, before, after]), length, at


def _padded(count: np.ndarray, at: np.ndarray):
    """Documents in order of falling length, and for each step the number of documents that have that many lines."""
    order = np.argsort(-count, kind="stable")
    reach = np.searchsorted(-count[order], -np.arange(int(count.max()) if len(count) else 0), side="left")
    return order, at[:-1][order], reach


def forward_backward(scores: np.ndarray, change: np.ndarray, at: np.ndarray):
    """Marginals of state 1 per line, expected transition counts, and the log-partition per document; two states, all documents at once."""
    count = np.diff(at)
    order, first, reach = _padded(count, at)
    n, steps = len(count), len(reach)
    e, t = np.exp(scores - scores.max(1, keepdims=True)), np.exp(change)
    alpha, norm = np.zeros_like(e), np.ones(len(e))
    for i in range(steps):
        rows = first[: reach[i]] + i
        a = e[rows] if i == 0 else (alpha[rows - 1] @ t) * e[rows]
        norm[rows] = a.sum(1)
        alpha[rows] = a / norm[rows, None]
    beta = np.ones_like(e)
    pairs = np.zeros((2, 2))
    for i in range(steps - 2, -1, -1):
        rows = first[: reach[i + 1]] + i
        nxt = e[rows + 1] * beta[rows + 1] / norm[rows + 1, None]
        beta[rows] = nxt @ t.T
        pairs += np.einsum("ni,nj->ij", alpha[rows], nxt) * t
    marginal = alpha * beta
    marginal /= marginal.sum(1, keepdims=True)
    logz = np.zeros(n)
    np.add.at(logz, np.repeat(np.arange(n), count), np.log(norm) + scores.max(1))
    return marginal[:, 1], pairs, logz


class Model:
    """Weights of the field and the calibration."""

    def __init__(self, sample: list[tuple[str, int]]):
        good = sum(y for _, y in sample)
        self.prior = good / max(1, len(sample))
        self.logistic = None
        if good < 2 or len(sample) - good < 2:
            return
        texts, labels = pa.array([t for t, _ in sample], pa.string()), np.array([y for _, y in sample])
        x, length, at = line_features(texts)
        state = np.repeat(labels, np.diff(at))
        # pieces of long documents are sequences of their own while learning
        cuts = np.unique(np.concatenate([at, *[np.arange(a, b, TRAIN_LINES) for a, b in zip(at[:-1], at[1:], strict=True)]]))
        self._learn(x, state, cuts)
        mean = self._mean(x, length, at)
        self.logistic = Logistic(self._inputs(mean), labels.astype(float), ridge=0.1)

    def _learn(self, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> None:
        self.scale = np.abs(x).max(0) + 1e-9
        x = x / self.scale
        weight, change = np.zeros(x.shape[1]), np.zeros((2, 2))
        inner = np.ones(len(y), bool)
        inner[at[:-1]] = False
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
        n = len(y)
        m = [np.zeros_like(weight), np.zeros_like(change)]
        v = [np.zeros_like(weight), np.zeros_like(change)]
        for step in range(1, STEPS + 1):
            s = np.column_stack([np.zeros(n), x @ weight])
            p, pairs, _ = forward_backward(s, change, at)
            gradient = [x.T @ (y - p) / n - 1e-4 * weight, (seen - pairs) / n - 1e-3 * change]
            for i, (g, held) in enumerate(zip(gradient, (weight, change), strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                held += 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        self.weight, self.change = weight / self.scale, change

    def _mean(self, x: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Per document, the marginals' mean weighted by the lines' lengths."""
        p, _, _ = forward_backward(np.column_stack([np.zeros(len(x)), x @ self.weight]), self.change, at)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        w = length + 1e-3
        return np.bincount(doc, p * w, len(at) - 1) / np.bincount(doc, w, len(at) - 1)

    @staticmethod
    def _inputs(mean: np.ndarray) -> np.ndarray:
        m = mean.clip(1e-4, 1 - 1e-4)
        return np.column_stack([m, np.log(m / (1 - m))])

    def shift(self, good: int, bad: int) -> None:
        """Moves the calibration from the sample's share of good documents to that among all labelled ones."""
        if self.logistic is not None and good and bad:
            self.logistic.beta[0] += math.log(good / bad) - math.log(self.prior / (1 - self.prior))
        self.prior = good / max(1, good + bad)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.logistic is None:
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for a, b in slices(lengths, 4_000_000):
            out[a:b] = self.logistic.predict(self._inputs(self._mean(*line_features(texts.slice(a, b - a)))))
        return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model learnt from labelled documents that are not held out."""
    model = Model(labelled_sample(docs, labels, "quality", SAMPLE))
    counted = {r[0]: r[1] for r in labels.filter(~held_out(F.col("doc_id"))).groupBy(F.col("quality").cast("int")).count().collect() if r[0] in (0, 1)}
    model.shift(counted.get(1, 0), counted.get(0, 0))
    return model


def score_frame(docs: DataFrame, model: Model, column: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of `docs`: `key` and score; only two columns are read."""

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1)), pa.float64())], [key, "score"])

    return docs.select(key, column).mapInArrow(score, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; the model is learnt first, then one scan, no shuffle."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_frame(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
