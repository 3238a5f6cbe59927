"""Quality classifier: averaged subword embeddings under a softmax, trained by stochastic gradient descent."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lurelake.llm.common import mixed, shipped, xxh3_64_intdigest

#: Rows of the labelled sample (fewest hashes of the id first): the bound of what the driver trains on.
SAMPLE_ROWS = 3000
BUCKETS, DIMENSION, EPOCHS, RATE, BATCH = 1 << 17, 8, 5, 1.5, 32
GRAMS = (2, 3, 4)
#: Word bigrams of one word twice share a vector of their own, behind the buckets.
TWICE = BUCKETS


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word's place) of each word and of the byte n-grams of <word>, all words at once."""
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    joined = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n) + 2
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(n), sizes)
    hashes, owners = [np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)], [np.arange(n)]
    for size in GRAMS:
        at = np.flatnonzero(np.arange(len(joined)) + size <= ends)
        h = np.full(len(at), size, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x100000001B3) + joined[at + k]
        hashes.append(h)
        owners.append(owner[at])
    buckets = (mixed(np.concatenate(hashes)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return buckets, np.concatenate(owners)


@dataclass
class Model:
    """vectors: one per bucket; weights: (DIMENSION, 2) of the softmax; bias: its two offsets."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def bucket_scores(self) -> np.ndarray:
        """Each bucket's share in the difference of the two logits: averaging and the softmax's
        logits are linear, so a document's logit is the mean of its features' scores."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0])

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Minibatch gradient descent on the cross-entropy, with a falling rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5, 0.5, (BUCKETS + 1, DIMENSION)).astype(np.float32) / DIMENSION
    weights = (rng.uniform(-0.5, 0.5, (DIMENSION, 2))).astype(np.float32)
    share = np.array([np.mean(labels == 0), np.mean(labels == 1)]) if len(labels) else np.array([0.5, 0.5])
    bias = np.log(np.clip(share, 1e-3, 1)).astype(np.float32)
    docs = []
    for text in texts:
        words = (text or "").encode().split()
        counts = Counter(words)
        buckets, owner = word_features(list(counts))
        times = np.fromiter(counts.values(), float, len(counts))
        total = np.bincount(buckets, times[owner], BUCKETS + 1)
        total[TWICE] = sum(map(eq, words, words[1:]))
        ids = np.flatnonzero(total)
        docs.append((ids.astype(np.int32), (total[ids] / max(1, total.sum())).astype(np.float32)))
    n, step, steps = len(docs), 0, max(1, EPOCHS * -(-len(docs) // BATCH))
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at:at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = np.stack([docs[i][1] @ vectors[docs[i][0]] for i in rows])
            logits = hidden @ weights + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            back = p @ weights.T
            weights -= rate / len(rows) * hidden.T @ p
            bias -= rate / len(rows) * p.sum(0)
            for j, i in enumerate(rows):  # a document's buckets are distinct
                vectors[docs[i][0]] -= rate * np.outer(docs[i][1] * len(docs[i][0]) ** 0.5, back[j])
    return Model(vectors, weights, bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, rows: int = SAMPLE_ROWS,
                    key: str = "doc_id") -> pd.DataFrame:
    """(text, y) of at most ``rows`` labelled documents, those whose ids have the least hashes.  The ids
    are bounded by ``rows``, so they are broadcast to the documents."""
    chosen = (labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & usable)
              .groupBy(key).agg(F.max(label).cast("int").alias("y"))
              .orderBy(F.xxhash64(key), key).limit(rows))
    # Equal ids of several documents: the one with the least text.
    found = docs.select(key, "text").join(F.broadcast(chosen), key).groupBy(key).agg(
        F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("y").alias("y"))
    return found.toPandas().sort_values(key, ignore_index=True)[["text", "y"]]


class WordScores(dict):
    """For each word the sum of its features' scores, and their number as the imaginary part."""

    LIMIT = 200_000

    def __init__(self, scores: np.ndarray):
        self.scores = scores

    def learn(self, words: set[bytes]) -> None:
        if len(self) + len(words) > self.LIMIT:
            self.clear()
        new = [w for w in words if w not in self]
        buckets, owner = word_features(new)
        sums = np.bincount(owner, self.scores[buckets], len(new)) + 1j * np.bincount(owner, minlength=len(new))
        self.update(zip(new, sums.tolist()))


def score_texts(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the softmax probability of label 1, to every row; whole texts are read.  Null and
    empty texts have the probability without features.  A column of that name is replaced."""
    df = df.drop(out)
    spark = shipped(df.sparkSession)
    shared = spark.sparkContext.broadcast((model.bucket_scores().astype(np.float32), model.offset()))

    def score(parts):
        scores, offset = shared.value
        known = WordScores(scores)
        for part in parts:
            out = np.empty(len(part))
            texts = part.tolist()
            for at in range(0, len(texts), 256):
                words = [(x or "").encode().split() for x in texts[at:at + 256]]
                known.learn(set().union(*words))
                get = known.__getitem__
                for j, w in enumerate(words):
                    s = sum(map(get, w), 0j)
                    twice = sum(map(eq, w, w[1:]))
                    n = s.imag + twice
                    out[at + j] = offset + ((s.real + twice * float(scores[TWICE])) / n if n else 0.0)
            yield pd.Series(1 / (1 + np.exp(-out)))

    score.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(score, "double")
    return df.withColumn(out, udf(F.col(text)))
