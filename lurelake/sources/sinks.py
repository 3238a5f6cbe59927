"""Writers.  All are plain distributed writes; a repeated run adds nothing twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lurelake.operators.urls import resume_pending


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder there")
    return f"{base.rstrip('/')}/lurelake/{name}-{uuid.uuid4().hex}"


def append_feature_sink(df: DataFrame, path: str, columns, key: str = "url") -> None:
    """Append in fixed column order the rows whose key is not yet written.

    The key anti-join makes a retried or resumed batch safe.
    """
    spark = df.sparkSession
    ordered = df.select(*columns)
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    rows = ordered if done is None else resume_pending(ordered, done, key).select(*columns)
    rows.write.mode("append").parquet(path)


def write_chat_jsonl(df: DataFrame, path: str) -> None:
    """One compact JSON chat record per line."""
    df.select(F.to_json(F.struct("messages")).alias("value")).write.mode("overwrite").text(path)


def write_debug_table(df: DataFrame, path: str) -> None:
    """CSV with array, map and struct columns as JSON text."""
    nested = [f.name for f in df.schema.fields
              if f.dataType.typeName() in ("array", "map", "struct")]
    flat = df.withColumns({c: F.to_json(c) for c in nested})
    flat.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def split_by_status_sink(df: DataFrame, path: str, col: str = "status") -> None:
    df.write.mode("overwrite").partitionBy(col).parquet(path)
