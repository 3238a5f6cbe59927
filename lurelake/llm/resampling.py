"""Importance resampling towards a target: hashed n-gram counts of batches of concatenated texts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lurelake.llm.common import numbered, saved, shipped

#: Hash buckets of the features.
BUCKETS = 10_000
#: Longest run of words that is a feature.
MOST_WORDS = 1
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
#: Percent of the documents that are drawn.
PERCENT = 10
SEED = 2024
#: Bytes of text that are joined to one batch; a longer text is a batch by itself.
BATCH_BYTES = 4 << 20

#: Words of lower-cased UTF-8: digits, a to z, and whatever is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Between two texts of a batch; no word holds it.
SENTINEL = b"\n"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Hashes(dict):
    """crc32 of the words met last."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = zlib.crc32(word)
        return h


CRC = _Hashes()


def batch_features(texts: list[bytes], buckets: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, owner, words): the bucket of every run of 1 to ``most`` words in the joined texts, the text
    that it stands in, ascending, and the words of each text.

    One pass of the pattern finds the words of all texts; their starts, searched among the offsets of the texts,
    tell whose they are, and runs whose ends belong to two texts are masked.
    """
    joined = SENTINEL.join(texts).translate(LOWER)
    offsets = np.cumsum([0] + [len(t) + len(SENTINEL) for t in texts[:-1]]) if texts else np.empty(0, np.int64)
    words, starts = [], []
    for m in WORD.finditer(joined):
        words.append(m[0])
        starts.append(m.start())
    owner = np.searchsorted(offsets, np.array(starts, np.int64), side="right") - 1
    per_text = np.bincount(owner, minlength=len(texts)) if len(texts) else np.empty(0, np.int64)
    hashes = np.fromiter(map(CRC.__getitem__, words), np.int64, len(words))
    found, owners = [hashes % buckets], [owner]
    for n in range(2, most + 1):
        within = np.flatnonzero(owner[:len(owner) - n + 1] == owner[n - 1:])
        runs = np.zeros(len(words), np.int64)
        for i in within.tolist():  # the crc of a run goes on from that of the run before its last word
            runs[i] = zlib.crc32(b" " + words[i + n - 1], int(hashes[i]))
        hashes = runs
        found.append(runs[within] % buckets)
        owners.append(owner[within])
    features, owner = np.concatenate(found), np.concatenate(owners)
    if most > 1:
        order = np.argsort(owner, kind="stable")
        features, owner = features[order], owner[order]
    return features, owner, per_text


def _batches(column: pa.Array) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in column:
        text = (text.as_py() or "").encode()
        if held and size + len(text) > BATCH_BYTES:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def hashed_features(df: DataFrame, text: str = "text", buckets: int = BUCKETS, most: int = MOST_WORDS, keys: tuple = ()) -> DataFrame:
    """(keys, n_words, features): the buckets of each row's n-grams as little-endian 32-bit numbers
    (16-bit ones where the buckets fit)."""
    shipped(df.sparkSession)
    kind = _kind(buckets)
    fields = df.select(*keys).schema

    def run(batches):
        for batch in batches:
            words, lists = [], []
            for texts in _batches(batch.column("_text")):
                features, owner, per_text = batch_features(texts, buckets, most)
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                packed = features.astype(kind)
                lists += [packed[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                words += per_text.tolist()
            columns = [batch.column(k) for k in keys] + [pa.array(words, pa.int64()), pa.array(lists, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "n_words", "features"])

    rows = df.select(*keys, F.col(text).alias("_text"))
    return rows.mapInArrow(run, fields.add("n_words", "long").add("features", "binary"))


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucket_counts(hashed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often the features of all rows fall into each bucket.  A task sends a row a bucket."""
    kind = _kind(buckets)

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            packed = b"".join(batch.column("features").to_pylist())
            counts += np.bincount(np.frombuffer(packed, kind), minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(counts[met], pa.int64())], names=["bucket", "n"])

    return hashed.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket floor(1000 ln of its smoothed share in the target over that in the source).  The counts
    are one number a bucket, so what reaches the driver is bounded by ``buckets``."""
    def counts(df):
        out = np.zeros(buckets)
        for row in bucket_counts(df, buckets).collect():
            out[row["bucket"]] = row["n"]
        return out

    s, t = counts(source), counts(target)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise of the key, in thousandths; rows without a key share one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             buckets: int = BUCKETS, most: int = MOST_WORDS, least_words: int = LEAST_WORDS, percent: int = PERCENT,
             seed: int = SEED) -> DataFrame:
    """(key, n_features, weight, score, rank): how much each row is like the target, and the rows drawn.

    weight is the floored mean of the gains of a row's features, score adds Gumbel noise, so the highest scores
    are a sample without replacement in proportion to exp(weight / 1000).  Of the N rows with ``least_words``
    words or more, floor(percent N / 100) are drawn, numbered by falling score, then by key; rank is null for
    all others.  Whole texts are read once; their features are kept as buckets.

    Null and empty texts have no features and weight 0.  Null keys share one noise and come first among equal
    scores.  Repeated rows are counted and drawn each.  An empty target smooths to equal shares; an empty table
    gives an empty result.  Other columns are left out, whatever their names.
    """
    spark = shipped(df.sparkSession)
    hashed = saved(hashed_features(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", buckets, most, ("key",)),
                   "resampling-features")
    wanted = hashed_features(target.select(F.col(target_text).alias("text")), "text", buckets, most)
    shared = spark.sparkContext.broadcast(gains(hashed, wanted, buckets))  # 8 bytes a bucket
    kind = _kind(buckets)

    def weigh(batches):
        for batch in batches:
            n, weight = [], []
            for packed in batch.column("features").to_pylist():
                own = np.frombuffer(packed, kind)
                n.append(len(own))
                weight.append(int(shared.value[own].sum()) // len(own) if len(own) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n_words"), pa.array(n, pa.int64()), pa.array(weight, pa.int64())],
                names=["key", "n_words", "n_features", "weight"])

    schema = hashed.drop("features").schema.add("n_features", "long").add("weight", "long")
    scored = hashed.mapInArrow(weigh, schema).withColumn("score", F.col("weight") + noise(F.col("key"), seed))
    scored = saved(scored.withColumn("_fit", (F.col("n_words") >= least_words).cast("int")), "resampling-scores")
    drawn = scored.agg(F.coalesce(F.sum("_fit"), F.lit(0))).first()[0] * percent // 100
    ranked = numbered(scored, "_fit", [F.col("score").desc(), F.col("key").asc_nulls_first()], "resampling-ranges")
    rank = F.when((F.col("_fit") == 1) & (F.col("place") < drawn), F.col("place") + 1).cast("long")
    return ranked.select(F.col("key").alias(key), "n_features", "weight", "score", rank.alias("rank"))
