"""Benchmark decontamination by latent semantic retrieval and longest common subsequences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lurelake.llm.common import WordHashes, saved, shipped, xxh3_64_intdigest

#: Hashed vocabulary, latent dimensions and the randomised range finder's extra columns.
BUCKETS, RANK, EXTRA = 1 << 16, 64, 16
#: A passage is four strides of ten words; passages overlap by three.
STRIDE, STRIDES = 10, 4
#: Candidates have a cosine of at least COSINE; the common subsequence must cover LCS of the item, and below
#: VERBATIM of it also ANSWER of the item's answer.
COSINE, LCS, VERBATIM, ANSWER = 0.5, 0.7, 0.9, 0.6
#: Benchmark items that one pass over the documents searches for.
ITEM_BLOCK = 4096
#: Words of the texts that are searched together; a longer text is searched by itself.
BATCH_WORDS = 40_000
#: ASCII white space, as bytes.split() has it.
WHITE = " \t\n\r\x0b\f"
#: Words of the passages that are summed together, as one small dense matrix.
SUM_WORDS = 400


class TermHashes(WordHashes):
    """Numbers of words, which are in lower case, without marks at their ends."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word.strip(b".,;:!?\"'()[]"))
        return h


TERMS = TermHashes()


def forget_terms() -> None:
    TERMS.clear()


def terms(text: str | None) -> np.ndarray:
    return TERMS.of((text or "").lower().encode().split())


def answer_start(text: str) -> int:
    """The place of the first word of an item's answer: what follows "Answer:", or else its last sentence."""
    words = text.split()
    marked = [i + 1 for i, w in enumerate(words) if w.lower() in ("answer:", "a:")]
    if marked and marked[-1] < len(words):
        return marked[-1]
    ends = [i + 1 for i, w in enumerate(words[:-1]) if w[-1] in ".?!"]
    return ends[-1] if ends else 0


def bucketed(texts: DataFrame) -> DataFrame:
    """(words, parts, weight) of texts (text, weight): the bucket of each word (two bytes), and how many parts white
    space makes of the text (null: null)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at:at + 512]
                own = part["text"].tolist()
                words = [terms(t) for t in own]
                yield pd.DataFrame({
                    "words": [(w & np.uint64(BUCKETS - 1)).astype("<u2").tobytes() for w in words],
                    "parts": pd.array([None if t is None else max(1, len(w) + sum(c in WHITE for c in (t[:1], t[-1:]) if c))
                                       for t, w in zip(own, words)], "Int32"),
                    "weight": part["weight"].array})
        forget_terms()

    return texts.select("text", "weight").mapInPandas(run, "words binary, parts int, weight double")


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents with a word of each bucket, documents), over all documents' ``bucketed`` words; BUCKETS sums at
    most come to the driver."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for words in batch["words"].tolist():
                total[np.unique(np.frombuffer(words, "<u2"))] += 1
                n += 1
        total[BUCKETS] = n
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = docs.select("words").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS + 1, np.int64)
    total[rows["bucket"].to_numpy(dtype=int)] = rows["n"].to_numpy(dtype=int)
    return total[:BUCKETS], int(total[BUCKETS])


def orthonormal(z: np.ndarray) -> np.ndarray:
    """A basis of z's columns from their small Gram matrix; columns for directions that z lacks are zero."""
    gram = np.zeros((z.shape[1],) * 2)
    for at in range(0, len(z), 4096):
        part = z[at:at + 4096].astype(np.float64)
        gram += part.T @ part
    values, vectors = np.linalg.eigh(gram)
    scale = np.where(values > 1e-10 * max(values[-1], 1e-30), 1 / np.sqrt(np.maximum(values, 1e-30)), 0.0)
    return z @ (vectors * scale).astype(np.float32)


def latent_space(texts: DataFrame, idf: np.ndarray, rank: int = RANK, rounds: int = 2) -> np.ndarray:
    """(BUCKETS, rank): the leading right singular vectors of the TF-IDF matrix A of the texts' passages, scaled
    by idf.  ``texts`` is ``bucketed``: texts with a weight are one passage that counts so often, others one for
    each STRIDE * STRIDES words.

    Randomised range finder: Q starts as random columns; each round Spark sums a (a Q) over the passages' rows
    a, block of buckets by block, and Q becomes an orthonormal basis of the sum.  The last round's small
    matrix Q'A'AQ gives the singular vectors.  What comes to the driver has the size of Q, a part at a time; a
    round's sums come from as many tasks as there are cores, so what is shuffled does not grow with the texts.
    """
    width = rank + EXTRA
    q = orthonormal(np.random.default_rng(11).standard_normal((BUCKETS, width), np.float32))
    weights = idf.astype(np.float32)
    for _ in range(rounds + 1):
        shared = texts.sparkSession.sparkContext.broadcast((q, weights))

        def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, weights = shared.value
            z = np.zeros(own.shape, np.float32)
            for batch in batches:
                for words, sizes, often in passage_blocks(batch):
                    add_products(z, own, weights, words, sizes, often)
            used = np.flatnonzero(np.abs(z).sum(1))
            for k in np.unique(used >> 10):
                at = used[used >> 10 == k]
                yield pd.DataFrame({"part": [int(k)], "at": [at], "z": [z[at].ravel()]})

        def add(parts: pd.DataFrame) -> pd.DataFrame:
            z = np.zeros((1 << 10, width))
            for at, own in zip(parts["at"], parts["z"]):
                z[np.asarray(at) & 1023] += np.asarray(own).reshape(-1, width)
            return pd.DataFrame({"part": parts["part"][:1], "z": [z.astype("<f4").tobytes()]})

        sums = (texts.select("words", "weight").coalesce(texts.sparkSession.sparkContext.defaultParallelism)
                .mapInPandas(sketch, "part long, at array<long>, z array<float>")
                .groupBy("part").applyInPandas(add, "part long, z binary"))
        z = np.zeros((BUCKETS, width), np.float32)
        for row in sums.toLocalIterator():
            z[row["part"] << 10:(row["part"] + 1) << 10] = np.frombuffer(row["z"], "<f4").reshape(-1, width)
        shared.destroy()
        small = (q.T @ z).astype(np.float64)
        last, q = q, orthonormal(z)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return last @ vectors[:, ::-1][:, :rank].astype(np.float32) * weights[:, None]


def passages_of(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, float]]:
    """(the buckets of the words, how often it counts) of each passage."""
    for words, weight in zip(batch["words"].tolist(), batch["weight"].tolist()):
        own = np.frombuffer(words, "<u2").astype(np.int64)
        step = len(own) if weight > 0 else STRIDE * STRIDES
        for k in range(0, len(own), max(1, step)):
            yield own[k:k + step], weight or 1.0


def passage_blocks(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(the buckets of all words, the words of each, how often each counts) of passages that are summed together."""
    held, size = [], 0
    for passage in passages_of(batch):
        held.append(passage)
        size += len(passage[0])
        if size >= SUM_WORDS:
            yield _block(held)
            held, size = [], 0
    if held:
        yield _block(held)


def _block(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.concatenate([p for p, _ in held]), np.array([len(p) for p, _ in held]), np.array([o for _, o in held])


def add_products(z: np.ndarray, q: np.ndarray, weights: np.ndarray, words: np.ndarray, sizes: np.ndarray,
                 often: np.ndarray) -> None:
    """Add a (a Q), often times, to z for the TF-IDF row a, of length 1, of each passage (none is empty)."""
    used, place = np.unique(words, return_inverse=True)
    at = np.repeat(np.arange(len(sizes)) * len(used), sizes) + place
    a = np.bincount(at, minlength=len(sizes) * len(used)).reshape(len(sizes), len(used)).astype(np.float32) * weights[used]
    a /= np.maximum(1e-9, np.sqrt(np.einsum("ij,ij->i", a, a)))[:, None]
    z[used] += a.T @ ((a @ q[used]) * often.astype(np.float32)[:, None])


def common_subsequence(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence, a's places as bits of a whole number."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = masks.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@dataclass
class Items:
    """A block of benchmark items: ids, words, where the answers start, latent vectors of length 1, the words that
    any item has, for each of them (and one more, for all others) the items that have it, and each item's distinct
    words with their counts."""

    ids: list
    words: list[np.ndarray]
    answers: list[int]
    vectors: np.ndarray
    known: np.ndarray
    members: np.ndarray
    counted: list[tuple[np.ndarray, np.ndarray]]


def item_block(rows: pd.DataFrame, space: np.ndarray) -> Items:
    rows = rows.loc[[bool((t or "").split()) for t in rows["text"]]]
    words = [terms(t) for t in rows["text"]]
    vectors = np.stack([space[(w & np.uint64(BUCKETS - 1)).astype(np.int64)].sum(0) for w in words]) if words \
        else np.zeros((0, space.shape[1]), np.float32)
    vectors /= np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
    known = np.unique(np.concatenate(words)) if words else np.empty(0, np.uint64)
    members = np.zeros((len(known) + 1, len(words)), np.uint8)
    for i, w in enumerate(words):
        members[np.searchsorted(known, w), i] = 1
    return Items(rows["item_id"].tolist(), words, [answer_start(t) for t in rows["text"]], vectors.astype(np.float32),
                 known, members, [np.unique(w, return_counts=True) for w in words])


def shared_words(words: np.ndarray, own: np.ndarray, counts: np.ndarray) -> int:
    """How many of an item's words, each as often as it stands there, the words hold: no common subsequence is longer."""
    at = np.minimum(np.searchsorted(own, words), len(own) - 1)
    return int(np.minimum(np.bincount(at[own[at] == words], minlength=len(own)), counts).sum())


def confirmed(words: np.ndarray, items: Items, i: int) -> tuple[float, float] | None:
    """The shares of the item and of its answer in a common subsequence with the words, if enough."""
    item, answer = items.words[i], items.answers[i]
    if shared_words(words, *items.counted[i]) < LCS * len(item):
        return None
    words, item = words.tolist(), item.tolist()
    share = common_subsequence(item, words) / len(item)
    if share < LCS:
        return None
    own = common_subsequence(item[answer:], words) / len(item[answer:])
    return (share, own) if share >= VERBATIM or own >= ANSWER else None


def search(docs: list[np.ndarray], space: np.ndarray, items: Items) -> Iterator[tuple]:
    """(document's place, item's place, cosine, LCS share, answer share, first word, last word) of the best passage
    of each document for each item that it holds.

    A candidate needs the cosine and, in the window that its subsequence is sought in, as many words of the item as
    the subsequence must have; both are tested for all candidates at once, and only then is one looked at by itself.
    """
    strides = [-(-len(d) // STRIDE) + STRIDES - 1 if len(d) else 0 for d in docs]
    starts = np.cumsum([0, *strides])
    if not starts[-1] or not items.ids:
        return
    at = np.full(starts[-1] * STRIDE, BUCKETS, np.int64)
    word = np.full(starts[-1] * STRIDE, len(items.known), np.int64)
    for d, s in zip(docs, starts):
        at[s * STRIDE:s * STRIDE + len(d)] = (d & np.uint64(BUCKETS - 1)).astype(np.int64)
        place = np.minimum(np.searchsorted(items.known, d), len(items.known) - 1)
        word[s * STRIDE:s * STRIDE + len(d)] = np.where(items.known[place] == d, place, len(items.known))
    sums = space[at[::STRIDE]].copy()
    shared = items.members[word[::STRIDE]].copy()
    for k in range(1, STRIDE):
        sums += space[at[k::STRIDE]]
        shared += items.members[word[k::STRIDE]]
    n = len(sums) - STRIDES + 1
    passages = sum(sums[k:k + n] for k in range(STRIDES))
    cosines = passages @ items.vectors.T
    cosines /= np.maximum(1e-9, np.linalg.norm(passages, axis=1, keepdims=True))
    p, i = np.nonzero(cosines >= COSINE)
    owner = np.searchsorted(starts, p, side="right") - 1
    sizes = np.array([len(w) for w in items.words])
    lengths = np.array([len(d) for d in docs])
    first = np.maximum(0, (p - starts[owner]) * STRIDE - sizes[i])
    last = np.minimum(lengths[owner], (p - starts[owner] + STRIDES) * STRIDE + sizes[i])
    until = np.zeros((len(shared) + 1, shared.shape[1]), np.int32)
    np.cumsum(shared, axis=0, out=until[1:])
    most = until[starts[owner] + -(-last // STRIDE), i] - until[starts[owner] + first // STRIDE, i]
    kept = np.flatnonzero(most >= LCS * sizes[i])
    # Best first for each (document, item); passages across two documents belong to the first one's padding.
    order = kept[np.lexsort((-cosines[p[kept], i[kept]], i[kept], owner[kept]))]
    done = None
    for k in order:
        if done == (owner[k], i[k]):
            continue
        ok = confirmed(docs[owner[k]][first[k]:last[k]], items, i[k])
        if ok:
            done = (owner[k], i[k])
            yield int(owner[k]), int(i[k]), float(cosines[p[k], i[k]]), *ok, int(first[k]), int(last[k])


def _batches(texts: list) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(place of the first, words of each) of texts that are searched together."""
    held, size, first = [], 0, 0
    for k, text in enumerate(texts):
        own = terms(text)
        if held and size + len(own) > BATCH_WORDS:
            yield first, held
            held, size, first = [], 0, k
        held.append(own)
        size += len(own)
    if held:
        yield first, held


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, cosine, lcs, answer, first_word, last_word): documents that hold a benchmark item, word
    for word or paraphrased, one row for each such pair, with the words around its best passage.

    Document frequencies cover all documents; the latent space is that of all passages of all documents and, with as
    much weight, of all items.  Every passage of every document is compared with every item, ``ITEM_BLOCK`` items at a time (the query set in blocks: so much is broadcast, whatever the
    benchmark's size).

    Null and empty texts hold nothing; items without words are left out; repeated rows each give rows; an
    empty benchmark gives an empty result.  Other columns are left out.
    """
    spark = shipped(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    items = benchmark.select("item_id", "text").where("text is not null")
    n_items = items.count()
    words = saved(bucketed(rows.select("text", F.lit(0.0).alias("weight"))), "document-words")
    frequencies, n = document_frequencies(words)
    idf = np.log((n + 1) / (frequencies + 1)).astype(np.float64) + 0.05
    passages = words.agg(F.sum(F.ceil(F.col("parts") / (STRIDE * STRIDES)))).first()[0] or 0
    weight = max(1.0, passages / max(1, n_items))  # items and passages weigh alike
    space = latent_space(bucketed(items.select("text", F.lit(weight).alias("weight"))).union(words), idf)
    space = np.concatenate([space, np.zeros((1, space.shape[1]), np.float32)])  # of no word
    kind = {"key": docs.schema[key].dataType.simpleString(), "item_id": benchmark.schema["item_id"].dataType.simpleString()}
    schema = (f"key {kind['key']}, item_id {kind['item_id']}, cosine double, lcs double, answer double, "
              "first_word int, last_word int")
    shared_space = spark.sparkContext.broadcast(space)
    blocks = -(-n_items // ITEM_BLOCK)
    out = None
    for block in range(max(1, blocks)):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))) == block).toPandas()
        shared = spark.sparkContext.broadcast(item_block(part.sort_values("item_id"), space))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keys = batch["key"].array
                for at, own in _batches(batch["text"].tolist()):
                    hits = [(keys[at + d], shared.value.ids[i], *rest)
                            for d, i, *rest in search(own, shared_space.value, shared.value)]
                    yield pd.DataFrame(hits, columns=["key", "item_id", "cosine", "lcs", "answer", "first_word", "last_word"])
            forget_terms()

        found = rows.mapInPandas(run, schema)
        out = found if out is None else out.union(found)
    return out.withColumnRenamed("key", key)
