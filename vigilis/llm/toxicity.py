"""Toxicity by a classifier chain: categories are predicted one after another, each by a linear model that also sees the
probabilities of the categories before it.

Labels say only whether a document is toxic. The earlier categories are learned from them, in whatever languages they are in:
the features that tell toxic rows from clean ones are grouped by the toxic rows they occur in together (k-means on the unit
sphere), and a toxic row is of a category if it has one of its features. The last category is "toxic" itself. In training,
the probabilities fed on are out-of-fold predictions, so that later models learn from inputs as good as those they will
meet. Features are the presence of words and of their beginnings. It is fitted on at most ``fit_rows`` labelled rows of each
class, taken by a hash of their ids; every whole text is scored.

Defined results: null and wordless texts have no features and get the models' base rates; null labels are not learned from,
of an id with both labels the lower counts; without toxic and clean labels nothing is flagged (probability 0); repeated rows
get equal results; an empty table gives no rows; other columns are kept, but one called ``toxicity`` is replaced.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilis.llm.common import need
from vigilis.llm.held import hold
from vigilis.llm.sample import first_by_hash, texts_of

TARGET = "toxic"
CATEGORIES = 4
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6, 7, 8)
MEMO = 500_000
LEAST_DOCS, TELLING, STRONG = 3, 5.0, 8.0


def features(word: str) -> list[int]:
    """32-bit numbers of the word and of its beginnings."""
    return [zlib.crc32(b"w" + word.encode()), *[zlib.crc32(b"p" + word[:n].encode()) for n in BEGINNINGS if len(word) > n]]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Rows:
    """Which of ``n`` documents have which features: entries (row, col), ``names`` of the columns."""

    n: int
    row: np.ndarray
    col: np.ndarray
    names: np.ndarray

    @staticmethod
    def of(texts: list[str | None]) -> Rows:
        memo: dict[str, list[int]] = {}
        docs = []
        for t in texts:
            own = set()
            for w in words_of(t):
                if w not in memo:
                    memo[w] = features(w)
                own.update(memo[w])
            docs.append(np.fromiter(own, np.uint32, len(own)))
        row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        names, col, count = np.unique(np.concatenate([*docs, np.empty(0, np.uint32)]), return_inverse=True, return_counts=True)
        place = np.cumsum(count >= LEAST_DOCS) - 1
        keep = (count >= LEAST_DOCS)[col]
        return Rows(len(docs), row[keep], place[col[keep]], names[count >= LEAST_DOCS])


@dataclass
class Linear:
    """A logistic model over chosen features (columns) and the chain's earlier probabilities."""

    bias: float
    chosen: np.ndarray
    weight: np.ndarray
    earlier: np.ndarray


def tells(x: Rows, y: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each feature, among the rows ``own`` (a mask), the signed root of the likelihood ratio of its shares in the two classes.

    Unlike a difference in standard errors it isn't large for features of a few rows.
    """
    used = own[x.row]
    ones = y[own].sum()
    sizes = np.array([ones, own.sum() - ones])
    with_ = np.bincount(x.col[used], y[x.row[used]], len(x.names))
    has = np.stack([with_, np.bincount(x.col[used], minlength=len(x.names)) - with_])
    share = has.sum(0) / sizes.sum()
    seen, want = np.stack([has, sizes[:, None] - has]), np.stack([sizes[:, None] * share, sizes[:, None] * (1 - share)])
    ratio = 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(want, 1e-12)), 0).sum((0, 1))
    return np.sqrt(np.maximum(ratio, 0)) * np.sign(has[0] * sizes[1] - has[1] * sizes[0])


def fit_linear(x: Rows, earlier: np.ndarray, y: np.ndarray, own: np.ndarray, most: int = 500, steps: int = 200, rate: float = 0.1, decay: float = 1.0) -> Linear:
    """Logistic loss over the rows ``own`` (a mask), on the ``most`` features that tell the classes apart best."""
    m, ones = int(own.sum()), int(y[own].sum())
    if not 0 < ones < m:
        return Linear(30.0 if ones else -30.0, np.empty(0, np.int64), np.empty(0), np.zeros(earlier.shape[1]))
    z = tells(x, y, own)
    chosen = np.argsort(-np.abs(z), kind="stable")[:most]
    chosen = chosen[np.abs(z[chosen]) > TELLING]
    place = np.full(len(x.names), -1)
    place[chosen] = np.arange(len(chosen))
    keep = own[x.row] & (place[x.col] >= 0)
    at = np.cumsum(own) - 1
    row, k = at[x.row[keep]], place[x.col[keep]]
    earlier, y, n = earlier[own], y[own], earlier.shape[1]
    theta = np.concatenate([[np.log(ones / (m - ones))], np.zeros(n + len(chosen))])
    g1, g2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        out = theta[0] + earlier @ theta[1 : n + 1] + np.bincount(row, theta[n + 1 :][k], m)
        error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / m
        grad = np.concatenate([[error.sum()], earlier.T @ error, np.bincount(k, error[row], len(chosen))])
        grad[1:] += decay / m * theta[1:]
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.999 * g2 + 0.001 * grad * grad
        theta = theta - rate * (g1 / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.999**step)) + 1e-9)
    return Linear(float(theta[0]), chosen, theta[n + 1 :], theta[1 : n + 1])


def predict(model: Linear, x: Rows, earlier: np.ndarray) -> np.ndarray:
    """Probabilities for all rows."""
    weight = np.zeros(len(x.names))
    weight[model.chosen] = model.weight
    out = model.bias + np.bincount(x.row, weight[x.col], x.n) + earlier @ model.earlier
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def out_of_fold(x: Rows, earlier: np.ndarray, truth: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Each row's probability from a model fitted on the rows of the other folds."""
    out = np.zeros(x.n)
    for k in np.unique(fold):
        if (fold != k).any():
            out[fold == k] = predict(fit_linear(x, earlier, truth, fold != k), x, earlier)[fold == k]
    return out


def categories(x: Rows, y: np.ndarray, most: int = CATEGORIES, rounds: int = 20) -> np.ndarray:
    """[row, category]: 1 for toxic rows with one of the category's features. Fewer than ``most`` where features are alike.

    The features that tell toxic rows best are grouped by the toxic rows they occur in; the first centre is the most
    telling feature, each next one the feature that is least like those before.
    """
    if not 0 < y.sum() < len(y):
        return np.zeros((x.n, 0))
    z = tells(x, y, np.ones(x.n, bool))
    strong = np.flatnonzero(z > STRONG)
    strong = strong[np.argsort(-z[strong], kind="stable")][:1000]
    toxic = np.flatnonzero(y)
    place, at = np.full(len(x.names), -1), np.full(x.n, -1)
    place[strong], at[toxic] = np.arange(len(strong)), np.arange(len(toxic))
    keep = (place[x.col] >= 0) & (at[x.row] >= 0)
    has = np.zeros((len(strong), len(toxic)))
    has[place[x.col[keep]], at[x.row[keep]]] = 1
    if not len(strong):
        return np.zeros((x.n, 0))
    unit = has / np.sqrt(has.sum(1, keepdims=True))
    centres = unit[:1]
    while len(centres) < min(most, len(strong)):
        near = (unit @ centres.T).max(1)
        if near.min() > 0.99:
            break
        centres = np.concatenate([centres, unit[[near.argmin()]]])
    for _ in range(rounds):
        group = (unit @ centres.T).argmax(1)
        sums = np.stack([unit[group == g].sum(0) if (group == g).any() else centres[g] for g in range(len(centres))])
        centres = sums / np.sqrt((sums * sums).sum(1, keepdims=True))
    out = np.zeros((x.n, len(centres)))
    for g in range(len(centres)):
        out[toxic, g] = has[group == g].max(0, initial=0)
    return out[:, np.argsort(-out.sum(0), kind="stable")]


@dataclass
class Chain:
    """``weights``: [feature, model], for the 32-bit numbers ``live``; ``biases`` and ``earlier`` (of the models before) by model."""

    names: list[str]
    live: np.ndarray
    weights: np.ndarray
    biases: list[float]
    earlier: list[np.ndarray]

    def __post_init__(self):
        self.place = {f: i for i, f in enumerate(self.live.tolist())}
        self.memo: dict[str, tuple[int, ...]] = {}

    def of(self, texts: list[str | None]) -> np.ndarray:
        """[text, category]: probabilities, in the chain's order."""
        memo, found, sizes = self.memo, [], []
        for t in texts:
            live = set()
            for w in words_of(t):
                own = memo.get(w)
                if own is None:
                    own = tuple(self.place[f] for f in features(w) if f in self.place)
                    if len(memo) < MEMO:
                        memo[w] = own
                if own:
                    live.update(own)
            found += sorted(live)
            sizes.append(len(live))
        row, k = np.repeat(np.arange(len(texts)), sizes), np.array(found, np.int64)
        p = np.zeros((len(texts), len(self.names)))
        for i in range(len(self.names)):
            out = self.biases[i] + np.bincount(row, self.weights[k, i], len(texts)) + p[:, :i] @ self.earlier[i]
            p[:, i] = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
        return p


def fit_chain(ids: list[int], texts: list[str | None], toxic: list[int], folds: int = 3, groups: int = CATEGORIES) -> Chain:
    x, y = Rows.of(texts), np.array(toxic, float)
    kinds = categories(x, y, groups)
    truths = [*kinds.T, y]
    fold = np.array([zlib.crc32(str(i).encode()) % folds for i in ids], np.int64)
    earlier, models = np.zeros((x.n, 0)), []
    for truth in truths:
        models.append(fit_linear(x, earlier, truth, np.ones(x.n, bool)))
        if len(models) < len(truths):
            earlier = np.concatenate([earlier, out_of_fold(x, earlier, truth, fold)[:, None]], 1)
    live = np.unique(np.concatenate([m.chosen for m in models]))
    weights = np.zeros((len(live), len(models)))
    for i, m in enumerate(models):
        weights[np.searchsorted(live, m.chosen), i] = m.weight
    names = [*[f"category_{g + 1}" for g in range(kinds.shape[1])], TARGET]
    return Chain(names, x.names[live] if len(live) else np.empty(0, np.uint32), weights, [m.bias for m in models], [m.earlier for m in models])


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 2000) -> Chain:
    """A chain fitted on labelled rows of ``docs``: at most ``fit_rows`` toxic ones and as many clean ones."""
    need(docs, ["doc_id", "text"])
    own = labels.where(F.col(TARGET).isin(0, 1)).groupBy("doc_id").agg(F.min(TARGET).alias("label"))
    found = texts_of(docs.select("doc_id", "text"), first_by_hash(own, fit_rows, "label"))
    return fit_chain([r.doc_id for r in found], [r.text for r in found], [r.label for r in found])


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float = 0.25) -> DataFrame:
    """``docs`` with a struct ``toxicity``: a probability for each category, and ``flagged`` where the last is over ``threshold``."""
    need(docs, ["doc_id", "text"])
    shared = docs.sparkSession.sparkContext.broadcast((chain.names, chain.live, chain.weights, chain.biases, chain.earlier))
    schema = ",".join([*[f"{n}:double" for n in chain.names], "flagged:boolean"])
    key = f"chain {uuid.uuid4().hex}"

    @F.pandas_udf(f"struct<{schema}>")
    def score(text: pd.Series) -> pd.DataFrame:
        own = hold(key, lambda: Chain(*shared.value))
        out = pd.DataFrame(own.of(text.tolist()), columns=own.names)
        return out.assign(flagged=out[own.names[-1]] >= threshold)

    return docs.withColumn("toxicity", score(F.col("text")))
