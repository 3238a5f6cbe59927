"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lurelake.llm.common import shipped

#: Rows of the labelled sample that the driver trains on.
SAMPLE_ROWS = 4000
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32
#: The lexicon: words and word beginnings, at most so many of each, learned from the labels.
LEXICON_SIZE, BEGINNING = 1500, (4, 5, 6, 7)
#: Words between a lexicon word and a second person that count as near.
NEAR = 5

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset((
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer",
    "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "vosotros",
))
# Characters that stand for letters in disguised words.
DISGUISES = str.maketrans("0134578@$!", "oieastbasi")

FEATURES = ("word density", "word weight", "strongest word", "beginning density", "beginning weight",
            "distinct hits", "second person", "near second person", "capitals", "punctuation",
            "exclamation", "disguised", "disguised hits", "length")


@lru_cache(maxsize=100_000)
def shape(word: str) -> tuple[str, float, int, int, float]:
    """(letters in lower case, capitals' share, punctuation, exclamations, whether disguised)."""
    if word.isalpha():
        core = word.lower()
        return core, 0.0 if core == word or len(word) < 2 else sum(map(str.isupper, word)) / len(word), 0, 0, 0.0
    core = word.strip(".,;:!?\"'()[]")
    if core.isalpha():
        _, upper, _, _, _ = shape(core)
        return core.lower(), upper, len(word) - len(core), word.count("!"), 0.0
    letters = sum(map(str.isalpha, word))
    core = core.lower()
    odd = letters > 0
    if odd:
        core = "".join(filter(str.isalpha, core.translate(DISGUISES)))
    upper = sum(map(str.isupper, word)) / letters if letters > 1 else 0.0
    return core, upper, len(word) - letters, word.count("!"), float(odd)


@dataclass
class Lexicon:
    words: dict[str, float]
    beginnings: dict[str, float]

    @staticmethod
    def learn(texts: list[str], labels: np.ndarray) -> "Lexicon":
        """Words and word beginnings whose log-odds between the classes, by documents, are above 2."""
        toxic, clean = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
        found: dict[str, dict[str, float]] = {}
        for kind, parts in (("words", lambda w: (w,)), ("beginnings", lambda w: [w[:n] for n in BEGINNING if len(w) > n])):
            seen = (Counter(), Counter())
            for text, y in zip(texts, labels):
                cores = {shape(w)[0] for w in set(text.split())}
                seen[int(y)].update({p for w in cores if w for p in parts(w)})
            least = max(2, toxic // 100)
            odds = {p: math.log((n + 0.5) / (toxic + 1)) - math.log((seen[0][p] + 0.5) / (clean + 1))
                    for p, n in seen[1].items() if n >= least}
            best = sorted(((v * math.sqrt(seen[1][p]), p) for p, v in odds.items() if v > 2), reverse=True)
            found[kind] = {p: odds[p] for _, p in best[:LEXICON_SIZE]}
        return Lexicon(**found)


class WordRows(dict):
    """The place of each word's numbers in ``table``.  Words without a hit share the places of equal
    numbers, so the table stays small; words met last are kept."""

    LIMIT = 400_000

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.begin()

    def begin(self) -> None:
        self.clear()
        self.places: dict[tuple, int] = {}
        self.table = np.zeros((256, 9))

    def __missing__(self, word: str) -> int:
        core, upper, marks, exclaimed, odd = shape(word)
        weight = self.lexicon.words.get(core, 0.0)
        get = self.lexicon.beginnings.get
        beginning = max([get(core[:n], 0.0) for n in BEGINNING])
        numbers = (weight, beginning, core in SECOND_PERSON, upper, marks, exclaimed, odd, odd and weight > 0, len(word))
        same = (numbers, core if weight else "")
        at = self.places.get(same)
        if at is None:
            at = self.places[same] = len(self.places)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at] = numbers
        self[word] = at
        return at


def features(text: str, rows: WordRows) -> np.ndarray:
    words = text.split()
    if len(rows) > rows.LIMIT:
        rows.begin()
    if not words:
        return np.zeros(len(FEATURES))
    at = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
    x, n = rows.table[at], len(words)
    hit, person = x[:, 0] > 0, x[:, 2] > 0
    near = 0
    if hit.any() and person.any():
        places, persons = np.flatnonzero(hit), np.flatnonzero(person)
        after = np.searchsorted(persons, places)
        right = np.abs(persons[np.minimum(after, len(persons) - 1)] - places)
        left = np.abs(persons[np.maximum(after - 1, 0)] - places)
        near = int((np.minimum(left, right) <= NEAR).sum())
    chars = max(1.0, x[:, 8].sum())
    return np.array([
        hit.mean(), x[:, 0].mean(), x[:, 0].max(), (x[:, 1] > 0).mean(), x[:, 1].mean(),
        len(np.unique(at[hit])), person.mean(), near / n, x[:, 3].mean(), x[:, 4].sum() / chars,
        x[:, 5].sum() / chars, x[:, 6].mean(), x[:, 7].mean(), math.log1p(n)])


@dataclass
class Trees:
    """Complete trees: at node k of a level the split feature and bound, at the leaves the values."""

    base: float
    splits: list[tuple[np.ndarray, np.ndarray]]
    leaves: list[np.ndarray]

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> "Trees":
        """Newton boosting of the logistic loss on histograms of quantile bins."""
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        out = Trees(math.log(share / (1 - share)), [], [])
        if len(np.unique(y)) < 2:
            return out
        bounds = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(bounds, x.T)])
        f = np.full(len(y), out.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, bound = np.zeros(2 ** DEPTH - 1, np.int64), np.full(2 ** DEPTH - 1, np.inf)
            for level in range(DEPTH):
                first, width = 2 ** level - 1, 2 ** level
                best = np.full(width, 1e-6)
                chosen = np.full((width, 2), -1)
                for k, own in enumerate(bins):
                    cell = node * BINS + own
                    gs = np.bincount(cell, g, width * BINS).reshape(width, BINS).cumsum(1)
                    hs = np.bincount(cell, h, width * BINS).reshape(width, BINS).cumsum(1)
                    total_g, total_h = gs[:, -1:], hs[:, -1:]
                    gain = gs ** 2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g ** 2 / (total_h + 1)
                    gain[:, len(bounds[k]):] = 0
                    at = gain.argmax(1)
                    better = gain[np.arange(width), at] > best
                    best[better] = gain[better, at[better]]
                    chosen[better] = np.stack([np.full(width, k), at], 1)[better]
                right = np.zeros(len(y), np.int64)
                for w, (k, at) in enumerate(chosen):
                    if k >= 0:
                        feature[first + w], bound[first + w] = k, bounds[k][at]
                        right[(node == w) & (bins[k] > at)] = 1
                node = node * 2 + right
            gs, hs = np.bincount(node, g, 2 ** DEPTH), np.bincount(node, h, 2 ** DEPTH)
            leaf = RATE * gs / (hs + 1)
            f += leaf[node]
            out.splits.append((feature, bound))
            out.leaves.append(leaf)
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for (feature, bound), leaf in zip(self.splits, self.leaves):
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                k = node + 2 ** level - 1
                node = node * 2 + (x[np.arange(len(x)), feature[k]] > bound[k])
            f += leaf[node]
        return f


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (margins, probabilities), both rising, to interpolate between.  Each
    pool counts a half document of either class more, so no probability is 0 or 1."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # sum of labels, rows, least and greatest margin
    for m, v in zip(margin[order], y[order]):
        if pools and pools[-1][3] == m:
            pools[-1][0] += v
            pools[-1][1] += 1
        else:
            pools.append([float(v), 1.0, m, m])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, high = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = high
    if not pools:
        return np.array([0.0]), np.array([0.5])
    xs = np.array([m for p in pools for m in (p[2], p[3])])
    ys = np.maximum.accumulate(np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools for _ in range(2)]))
    return xs, ys


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    steps: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[str], rows: WordRows) -> np.ndarray:
        x = np.stack([features(t or "", rows) for t in texts]) if texts else np.zeros((0, len(FEATURES)))
        margin = self.trees.margin(x)
        # A small slope inside the pools keeps the trees' order.
        return np.clip(np.interp(margin, *self.steps) * 0.98 + 0.02 / (1 + np.exp(-margin)), 0.0, 1.0)


def train(texts: list[str], labels: np.ndarray) -> Model:
    """Two halves see each other's lexicons only, so the trees learn how much a lexicon hit tells about
    new documents, and the calibration learns from margins of trees that have not seen the document."""
    half = np.arange(len(texts)) % 2
    x = np.zeros((len(texts), len(FEATURES)))
    for k in (0, 1):
        own = np.flatnonzero(half == k)
        rows = WordRows(Lexicon.learn([texts[i] for i in np.flatnonzero(half != k)], labels[half != k]))
        for i in own:
            x[i] = features(texts[i], rows)
    margin = np.zeros(len(texts))
    for k in (0, 1):
        margin[half == k] = Trees.fit(x[half != k], labels[half != k]).margin(x[half == k])
    return Model(Lexicon.learn(texts, labels), Trees.fit(x, labels), isotonic(margin, labels))


def score_toxicity(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the calibrated probability of label 1, to every row; whole texts are read.  Null and
    empty texts have features of 0.  A column of that name is replaced."""
    df = df.drop(out)
    shared = shipped(df.sparkSession).sparkContext.broadcast(model)

    def score(parts):
        own = shared.value
        rows = WordRows(own.lexicon)
        for part in parts:
            yield pd.Series(own.score(part.tolist(), rows), dtype=float)

    score.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(score, "double")(F.col(text)))
