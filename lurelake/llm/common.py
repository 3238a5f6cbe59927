"""What the corpus operators share: reading, scratch tables and word arrays."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from xxhash import xxh3_64_intdigest

from lurelake.session import shipped  # noqa: F401 - part of what the operators share

#: ASCII white space, as bytes.split() has it.
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="lurelake-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder in spark.checkpoint.dir; where that is unset (local
    sessions only), under a folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("name a shared folder in spark.checkpoint.dir")
        base = _own_folder()
    return f"{base.rstrip('/')}/lurelake/{name}-{uuid.uuid4().hex}"


#: Shuffle files of a finished write go at once, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it from there: cuts the lineage, and a lost
    executor takes nothing with it."""
    return saved_parts([df], name)


def saved_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """``saved`` for the union of tables with the same columns, written one after the other: the disk holds the
    shuffle files of one at a time."""
    path = None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or scratch(spark, name)
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete saved tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def part(df: DataFrame, key: str, parts: int, p: int) -> DataFrame:
    """The rows of the part ``p`` of ``parts`` that a numeric key falls into."""
    return df.where(F.pmod(F.col(key), F.lit(parts)) == p)


#: Rows of a range that one task numbers.
RANGE_ROWS = 20_000


def numbered(rows: DataFrame, group: str, order: list[Column | str], name: str, out: str = "place") -> DataFrame:
    """The rows with ``out``, their places from 0 in their group by ``order``, without gaps.

    The rows are dealt by ranges of (group, order), so no task holds a whole group; a place is the rank in the
    range plus the group's rows in the ranges before it.  Equal rows are parted by where they were read, so they
    may fill many ranges.  ``rows`` is a written table, its group column holds no null.
    """
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    cut = rows.withColumn("_tie", F.monotonically_increasing_id())
    cut = saved(cut.repartitionByRange(ranges, F.col(group).asc(), *order, F.col("_tie")).withColumn("_range", F.spark_partition_id()),
                name)
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(group, "_range").count().select(
        group, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_range").orderBy(*order, "_tie")
    return cut.join(starts, [group, "_range"]).withColumn(
        out, F.row_number().over(within) - 1 + F.col("_start")).drop("_range", "_start", "_tie")


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo ``modulus``: the fixed split of labelled rows."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def smallest_reachable(spark: SparkSession, edges: DataFrame, name: str) -> DataFrame:
    """(id, root) for every end of the edges (a, b): the least id that links reach.

    Large star and small star by turns.  A round joins or groups on one id, so no component is ever
    in one task; each round's edges are written to the shared folder.  Each large star links every
    neighbour above a vertex to its least neighbour; each small star those below it.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = saved(now.distinct(), name)
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("m", "u").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
            F.col("m").alias("v"))
        last, now = now, saved(small.where("u <> v").distinct(), name)
        dropped(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("id"), "root").distinct())


# ---- words as numbers, inside tasks -------------------------------------------------------------

MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class WordHashes(dict):
    """64-bit numbers of words (bytes), kept for the words met last; tasks clear them at their end, as Spark uses a
    Python worker again for other stages."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        get = self.__getitem__
        return np.fromiter(map(get, words), np.uint64, len(words))


HASHES = WordHashes()


def forget_words() -> None:
    """At a task's end.  A function, as what a task names itself is a copy of its own."""
    HASHES.clear()


def window_hashes(x: np.ndarray, size: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit number for each run of ``size`` consecutive entries."""
    n = len(x) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    step = np.uint64(seed | 1)
    for k in range(size):
        out = out * step + x[k:k + n]
    return mixed(out)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
