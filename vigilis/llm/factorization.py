"""Quality scores from a factorisation machine over hashed words, structure statistics and metadata.

The machine's pairwise term is low-rank: the weight of features i and j together is the dot product of two vectors of length
``rank``. By the sum-of-squares identity, all pairs of a document cost one pass over its features:
sum of v_i v_j x_i x_j over i < j is half of (sum of v_i x_i) squared less the sum of (v_i x_i) squared, by dimension.

It is fitted on at most ``fit_rows`` labelled rows, taken by a hash of their ids; every whole text is scored.

Defined results: null and empty texts are scored by their statistics; a null length counts as the text's; a null label is not
learned from; without labels of both kinds all scores are the share of label 1, (ones + 1) / (rows + 2); repeated rows get
equal scores; an empty table gives no rows; other columns are kept as they are, but one called like the score is replaced.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilis.llm.common import need
from vigilis.llm.held import hold
from vigilis.llm.sample import first_by_hash, texts_of

WORD_BUCKETS = 1 << 15
BINS = 8
SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MEMO = 100_000

STATISTICS = ["chars", "words", "word_length", "distinct", "top_word", "upper", "digits", "symbols", "bangs", "stops", "lines", "repeated_lines", "line_words", "common_line"]


def statistics(text: str, words: list[str], counts: Counter, n_chars: float) -> list[float]:
    """Values of STATISTICS; ``chars`` is the document's stated length (metadata)."""
    n, size = max(1, len(words)), max(1, len(text))
    raw = text.encode()
    lines = [x for x in text.split("\n") if x.strip()]
    seen = Counter(lines)
    return [
        math.log1p(n_chars),
        math.log1p(len(words)),
        sum(map(len, words)) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        (len(raw) - len(raw.translate(None, UPPER))) / size,
        (len(raw) - len(raw.translate(None, DIGITS))) / size,
        sum(map(text.count, SYMBOLS)) / n,
        text.count("!") / n,
        text.count(".") / n,
        math.log1p(len(lines)),
        1 - len(seen) / max(1, len(lines)),
        len(words) / max(1, len(lines)),
        max(seen.values(), default=0) / max(1, len(lines)),
    ]


class Buckets(dict):
    """Word -> bucket, kept while there is room."""

    def __missing__(self, word: str) -> int:
        k = zlib.crc32(word.encode()) % WORD_BUCKETS
        if len(self) < MEMO:
            self[word] = k
        return k


def featurize(text: str | None, n_chars) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word buckets, their values (square roots of counts, of length one together), and the statistics."""
    text = text or ""
    words = text.lower().split()
    counts = Counter(words)
    k = np.fromiter(map(hold("buckets", Buckets).__getitem__, counts), np.int32, len(counts))
    x = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
    if len(x):
        x /= np.sqrt((x * x).sum())
    known = len(text) if n_chars is None or n_chars != n_chars else max(0.0, float(n_chars))
    return k, x, statistics(text, words, counts, known)


@dataclass
class Machine:
    """Weights of word buckets, then of the statistics' bins; ``edges``: the bins' borders by statistic."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    edges: np.ndarray

    def rows(self, docs: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers, feature numbers and values of all features of ``docs``."""
        s = np.array([d[2] for d in docs], np.float64).reshape(len(docs), -1)
        bins = (s[:, :, None] >= self.edges[None]).sum(2) + np.arange(s.shape[1]) * BINS + WORD_BUCKETS
        row = np.concatenate([np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs]), np.repeat(np.arange(len(docs)), s.shape[1])])
        k = np.concatenate([*[d[0] for d in docs], bins.ravel().astype(np.int32)])
        x = np.concatenate([*[d[1] for d in docs], np.full(bins.size, 0.5, np.float32)])
        return row, k, x

    def logits(self, row: np.ndarray, k: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The machine's outputs, and the sums of v x by document that the gradient needs too."""
        vx = self.factors[k] * x[:, None]
        sums = np.stack([np.bincount(row, vx[:, f], n) for f in range(vx.shape[1])], 1)
        squares = np.bincount(row, (vx * vx).sum(1), n)
        return self.bias + np.bincount(row, self.linear[k] * x, n) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def scores(self, texts: list[str | None], lengths: list) -> np.ndarray:
        out = np.empty(len(texts))
        for at in range(0, len(texts), 256):
            docs = [featurize(t, n) for t, n in zip(texts[at : at + 256], lengths[at : at + 256], strict=True)]
            out[at : at + 256] = 1 / (1 + np.exp(-np.clip(self.logits(*self.rows(docs), len(docs))[0], -30, 30)))
        return out


def fit(texts: list[str | None], lengths: list, labels: list[int], rank: int = 8, epochs: int = 12, batch: int = 256, rate: float = 0.02, decay: float = 1e-4) -> Machine:
    """Logistic loss, by Adam over shuffled batches with a fixed seed."""
    y = np.array(labels, float)
    size = WORD_BUCKETS + len(STATISTICS) * BINS
    rng = np.random.default_rng(0)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Machine(math.log(share / (1 - share)), np.zeros(size), np.zeros((size, rank)), np.zeros((len(STATISTICS), BINS - 1)))
    if not 0 < y.sum() < len(y):
        return model
    docs = [featurize(t, n) for t, n in zip(texts, lengths, strict=True)]
    s = np.array([d[2] for d in docs])
    model.edges = np.quantile(s, np.arange(1, BINS) / BINS, axis=0).T + 1e-9
    model.factors = rng.normal(0, 0.05, (size, rank))
    theta = np.concatenate([model.linear[:, None], model.factors], 1)
    m, v, step, mb, vb = np.zeros_like(theta), np.zeros_like(theta), 0, 0.0, 0.0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            row, k, x = model.rows([docs[i] for i in own])
            out, sums = model.logits(row, k, x, len(own))
            error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[own]) / len(own)
            g = error[row] * x
            grad = np.empty_like(theta)
            grad[:, 0] = np.bincount(k, g, size)
            for f in range(rank):
                grad[:, f + 1] = np.bincount(k, g * (sums[row, f] - model.factors[k, f] * x), size)
            grad += decay * theta
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.999 * vb + 0.001 * error.sum() ** 2
            model.bias -= rate * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.999**step)) + 1e-8)
            model.linear, model.factors = theta[:, 0], theta[:, 1:]
    model.linear, model.factors = model.linear.astype(np.float32), np.ascontiguousarray(model.factors, np.float32)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", fit_rows: int = 4000) -> Machine:
    """A machine fitted on at most ``fit_rows`` rows of ``docs`` that have a label and satisfy ``learn`` (a condition on doc_id).

    Of an id with both labels the lower counts, of one with several texts the smallest.
    """
    need(docs, ["doc_id", "text"])
    own = labels.where(learn & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("label"))
    taken = first_by_hash(own, fit_rows)
    rows = docs.select("doc_id", "text", stated_length(docs).alias("n"))
    found = texts_of(rows, taken, "n")
    return fit([r.text for r in found], [r.n for r in found], [r.label for r in found])


def stated_length(docs: DataFrame) -> Column:
    """Metadata: n_chars where ``docs`` has it."""
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def score_quality(docs: DataFrame, model: Machine, column: str = "score") -> DataFrame:
    """``docs`` with ``column``: 0 to 1, higher where label 1 is likelier."""
    need(docs, ["doc_id", "text"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series, n_chars: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(text.tolist(), n_chars.tolist()))

    return docs.withColumn(column, score(F.col("text"), stated_length(docs)))
