"""Language identification by unigrams marginalised over segmentations.

The vocabulary is a public tokenizer's fixed list of pieces. A language is a probability for each piece; a word's probability
is the sum, over all ways to cut it into pieces, of the products of their probabilities, which a forward pass adds up
without listing them. A text's is the product over its words. All pieces of any length take part, and words of any length are
passed whole; sums are scaled on the way, so that none becomes zero. The probabilities are learned by expectation
maximisation, with backward passes, on a bounded sample of each language's texts; every whole text is scored.

Defined results: null texts and texts without a letter are ``und`` with score 0; a null language is not learned from; without
languages to learn all are ``und``; repeated rows get equal results; an empty table gives no rows; other columns are kept, but
one called ``language`` is replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilis.llm.common import need
from vigilis.llm.held import hold
from vigilis.llm.sample import first_by_hash, texts_of

UNKNOWN = "und"
#: A word is marked by this character before it, as in the vocabulary.
MARK = "▁"
RESCALE = 16  # characters after which a forward pass scales its sums
MEMO = 500_000
TABLE = 20  # bits
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: ASCII characters but letters become spaces.
SPACES = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def vocabulary(path: str) -> list[str]:
    """The file's pieces that a marked lower-case word can hold: no control and byte pieces, no capitals, no inner mark or space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p for p in own if MARK not in p[1:] and p == p.lower() and b" " not in p.encode().translate(SPACES)]


def words_of(text: str | None) -> list[str]:
    """Lower-case words; ASCII digits, punctuation and white space divide them."""
    return (text or "").lower().encode("utf-8", "replace").translate(SPACES).decode().split()


class Pieces:
    """Piece numbers; one number after the last stands for any other single character, two after for no piece at all.

    Pieces are found by a 64-bit hash of their characters; a table of bits sorts out most strings that are none.
    """

    def __init__(self, pieces: list[str]):
        self.names = list(dict.fromkeys(pieces))
        self.longest = max(map(len, self.names), default=1)
        self.other, self.none = len(self.names), len(self.names) + 1
        codes = np.array([self.code(p) for p in self.names], np.uint64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.numbers = codes[order], order.astype(np.int32)
        self.table = np.zeros(1 << TABLE, bool)
        self.table[self.codes >> np.uint64(64 - TABLE)] = True

    @staticmethod
    def code(piece: str) -> int:
        h = 0
        for ch in piece:
            h = (h * BASE + (ord(ch) + 1) * MIX) % (1 << 64)
        return h

    def ends(self, words: list[str]) -> np.ndarray:
        """For words of one length n: the pieces of k characters that end after character j, as [word, j - 1, k - 1]."""
        n = len(words[0])
        width = min(n, self.longest)
        chars = (np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n).astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
        out = np.full((len(words), n, width), self.none, np.int32)
        h = chars
        for k in range(1, width + 1):
            if k > 1:
                h = h[:, :-1] * np.uint64(BASE) + chars[:, k - 1 :]
            own = out[:, k - 1 :, k - 1]
            if len(self.codes):
                at = np.nonzero(self.table[h >> np.uint64(64 - TABLE)])
                found = h[at]
                place = np.minimum(np.searchsorted(self.codes, found), len(self.codes) - 1)
                same = self.codes[place] == found
                own[at[0][same], at[1][same]] = self.numbers[place[same]]
            if k == 1:
                own[own == self.none] = self.other
        return out


def forward(ends: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums over segmentations of all prefixes, [word, length of prefix, language]; p: [piece, language], the last row zero."""
    words, n, width = ends.shape
    sums = np.zeros((words, n + 1, p.shape[1]))
    sums[:, 0] = 1
    for j in range(1, n + 1):
        k = min(j, width)
        sums[:, j] = (sums[:, j - k : j][:, ::-1] * p[ends[:, j - 1, :k]]).sum(1)
    return sums


def log_sums(ends: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over segmentations of whole words, [word, language], for words of any length.

    Only the sums that a piece can still reach are kept; they are scaled by their largest every few characters.
    """
    words, n, width = ends.shape
    recent, scale = np.zeros((words, width, p.shape[1])), np.zeros((words, p.shape[1]))
    recent[:, 0] = 1  # recent[:, k]: the sum of the prefix that lacks the last k characters
    for j in range(1, n + 1):
        new = np.einsum("wkl,wkl->wl", recent, p[ends[:, j - 1]])
        recent[:, 1:] = recent[:, :-1].copy()
        recent[:, 0] = new
        if j % RESCALE == 0:
            most = np.maximum(recent.max(1), 1e-300)
            recent /= most[:, None]
            scale += np.log(most)
    return scale + np.log(np.maximum(recent[:, 0], 1e-300))


def expectation(ends: np.ndarray, p: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected counts of all pieces for one language in words seen ``times``."""
    words, n, width = ends.shape
    ahead = forward(ends, p)[:, :, 0]
    back = np.zeros((words, n + 1))
    back[:, n] = 1
    scale = times / np.maximum(ahead[:, n], 1e-300)
    counts = np.zeros(len(p))
    for j in range(n, 0, -1):
        k = min(j, width)
        own = ends[:, j - 1, :k]
        on = p[own, 0] * back[:, j, None]
        back[:, j - k : j] += on[:, ::-1]
        counts += np.bincount(own.ravel(), (ahead[:, j - k : j][:, ::-1] * on * scale[:, None]).ravel(), len(p))
    return counts


def by_length(words: list[str], most: int = 4096, chars: int = 100_000) -> list[list[int]]:
    """Indices of words of equal length, in groups of at most ``most`` and of about ``chars`` characters."""
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    steps = {n: max(1, min(most, chars // n)) for n in groups}
    return [own[at : at + steps[n]] for n, own in groups.items() for at in range(0, len(own), steps[n])]


class Languages:
    def __init__(self, pieces: list[str], names: list[str], p: np.ndarray, prior: np.ndarray):
        """p: [piece, language], rows for any other character and for no piece at the end."""
        self.pieces, self.names, self.p, self.prior = Pieces(pieces), names, p, prior
        self.memo: dict[str, int] = {}
        self.logs = np.zeros((0, len(names)))

    def words(self, words: list[str]) -> np.ndarray:
        """Log probabilities [word, language] by the forward pass."""
        marked = [MARK + w for w in words]
        out = np.zeros((len(words), len(self.names)))
        for own in by_length(marked):
            out[own] = log_sums(self.pieces.ends([marked[i] for i in own]), self.p)
        return out

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and their posterior probabilities. Words are remembered while there is room."""
        known = [bool(t and self.names and any(map(str.isalpha, t))) for t in texts]
        split = [words_of(t) if k else [] for t, k in zip(texts, known, strict=True)]
        memo = self.memo
        new = list({w for s in split for w in s}.difference(memo)) if len(memo) else list({w for s in split for w in s})
        logs = self.logs
        if new:
            numbers = dict(zip(new, range(len(logs), len(logs) + len(new)), strict=True))
            logs = np.concatenate([logs, self.words(new)])
            if len(logs) <= MEMO:
                memo.update(numbers)
                self.logs = logs
            else:
                memo = Either(memo, numbers)
        get, names, scores = memo.__getitem__, [], np.zeros(len(texts))
        for i, s in enumerate(split):
            if not known[i]:
                names.append(UNKNOWN)
                continue
            sums = self.prior + logs[list(map(get, s))].sum(0)
            best = int(sums.argmax())
            names.append(self.names[best])
            scores[i] = 1 / np.exp(sums - sums[best]).sum()
        return names, scores


class Either:
    """Lookups in two dictionaries."""

    def __init__(self, first: dict, second: dict):
        self.first, self.second = first, second

    def __getitem__(self, key: str) -> int:
        found = self.first.get(key)
        return self.second[key] if found is None else found


def fit(rows: list[tuple[str, str]], pieces: list[str], rounds: int = 4, smooth: float = 0.05, longest_taught: int = 32) -> Languages:
    """``rows``: (text, language). Words of over ``longest_taught`` characters are scored like any, but not learned from."""
    own = defaultdict(Counter)
    docs = Counter(lang for _, lang in rows)
    for text, lang in rows:
        own[lang].update(MARK + w for w in words_of(text) if len(w) <= longest_taught)
    index, names = Pieces(pieces), sorted(own)
    p = np.zeros((index.none + 1, len(names)))
    for k, lang in enumerate(names):
        words = list(own[lang])
        times = np.array([own[lang][w] for w in words], float)
        groups = [(index.ends([words[i] for i in g]), times[g]) for g in by_length(words)]
        q = np.full((index.none + 1, 1), 1 / index.none)
        q[-1] = 0
        for _ in range(rounds):
            counts = sum((expectation(s, q, t) for s, t in groups), np.zeros(len(q))) + smooth
            counts[-1] = 0
            q = (counts / counts.sum())[:, None]
        p[:, k] = q[:, 0]
    prior = np.log(np.array([docs[x] for x in names], float) / max(1, len(rows))) if names else np.zeros(0)
    return Languages(pieces, names, p, prior)


def fit_languages(docs: DataFrame, learn: Column, vocabulary_file: str, fit_rows: int = 250) -> Languages:
    """Learned from at most ``fit_rows`` rows of each language, taken by a hash of doc_id, that satisfy ``learn``.

    One scan of ids ranks them within their languages, another fetches the texts; the driver holds ``fit_rows`` texts for each language.
    """
    need(docs, ["doc_id", "text", "lang"])
    rows = docs.where(learn & F.col("lang").isNotNull()).select("doc_id", "lang")
    found = texts_of(docs.select("doc_id", "text"), first_by_hash(rows, fit_rows, "lang"))
    return fit([(r.text, r.lang) for r in found if r.text is not None], vocabulary(vocabulary_file))


def predict_language(docs: DataFrame, model: Languages) -> DataFrame:
    """``docs`` with a struct ``language``: lang_pred, score."""
    need(docs, ["text"])
    parts = (model.pieces.names, model.names, model.p, model.prior)
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    key = f"languages {uuid.uuid4().hex}"

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(text: pd.Series) -> pd.DataFrame:
        own = hold(key, lambda: Languages(*shared.value))
        names, scores = [], []
        for at in range(0, len(text), 500):
            n, s = own.texts(text.iloc[at : at + 500].tolist())
            names += n
            scores.append(s)
        return pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores) if scores else np.zeros(0)})

    return docs.withColumn("language", predict(F.col("text")))
