"""A table of the newest row per key that batches are merged into.

The rows lie in buckets by the key's hash.  A merge rewrites the buckets that its batch touches, under a new
version, then writes that version's manifest: which version of each bucket counts.  Readers take the newest
whole manifest, so they see all of a merge or nothing of it, and a merge that failed or ran twice leaves the
table as one run does.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lurelake.operators.urls import latest_per_key

BUCKETS = 64


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions with a whole manifest, ascending."""
    place, fs = _folder(spark, f"{path}/manifest")
    if not fs.exists(place):
        return []
    found = []
    for entry in fs.listStatus(place):
        done = spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if fs.exists(done):
            found.append(int(entry.getPath().getName()))
    return sorted(found)


def _manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    rows = spark.read.schema("bucket int, version long").parquet(f"{path}/manifest/{version:012d}")
    return {r["bucket"]: r["version"] for r in rows.collect()}  # a row a bucket


def _buckets(path: str, manifest: dict[int, int], only=None) -> list[str]:
    return [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(manifest.items()) if only is None or b in only]


def merge(batch: DataFrame, path: str, key: str, order: str, buckets: int = BUCKETS) -> None:
    """Put a batch into the table: the row with the greatest ``order`` of each key stays.  Null keys are left
    out.  Merging a batch again changes nothing."""
    spark = batch.sparkSession
    known = versions(spark, path)
    manifest = _manifest(spark, path, known[-1]) if known else {}
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
    newest = latest_per_key(batch.where(F.col(key).isNotNull()), key, order).withColumn("bucket", bucket).persist()
    try:
        _rewrite(newest, batch.schema, path, key, order, bucket, known[-1] + 1 if known else 0, manifest)
    finally:
        newest.unpersist()


def _rewrite(newest, schema, path, key, order, bucket, version, manifest) -> None:
    spark = newest.sparkSession
    touched = {r["bucket"] for r in newest.select("bucket").distinct().collect()}
    if not touched:
        return
    rows = newest
    held = _buckets(path, manifest, touched)
    if held:
        old = spark.read.schema(schema).parquet(*held).withColumn("bucket", bucket)
        rows = latest_per_key(old.unionByName(newest), key, order)
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    manifest |= dict.fromkeys(touched, version)
    spark.createDataFrame(sorted(manifest.items()), "bucket int, version long").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/manifest/{version:012d}")


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest row of every key: one scan, no shuffle."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*_buckets(path, _manifest(spark, path, known[-1])))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete what none of the last ``keep`` versions refers to; returns how many bucket folders went."""
    known = versions(spark, path)
    used = set()
    for v in known[-keep:]:
        used |= set(_buckets(path, _manifest(spark, path, v)))
    gone = 0
    for v in known[:-keep]:
        for folder in _buckets(path, dict.fromkeys(_manifest(spark, path, v), v)):
            place, fs = _folder(spark, folder)
            if folder not in used and fs.exists(place):
                fs.delete(place, True)
                gone += 1
        place, fs = _folder(spark, f"{path}/manifest/{v:012d}")
        fs.delete(place, True)
    return gone
