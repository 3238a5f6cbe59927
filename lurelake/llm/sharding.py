"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a shard that one task numbers.
SLOT_ROWS = 4096


def key_text(key: Column) -> Column:
    """A key's text; all rows without a key share one."""
    return F.coalesce(key.cast("string"), F.lit(""))


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that wins the key: the least -ln(u)/weight, where u in (0, 1) comes from
    52 bits of md5(key:shard).  A further shard only takes keys into itself; a shard's share of the
    keys follows its weight, and a weight of 0 takes none."""
    drawn = []
    for shard, weight in enumerate(weights):
        if weight <= 0:
            continue
        bits = F.conv(F.substring(F.md5(F.concat(key_text(key), F.lit(f":{shard}"))), 1, 13), 16, 10)
        u = (bits.cast("double") + 0.5) / float(1 << 52)
        drawn.append(F.struct((-F.log(u) / float(weight)).alias("draw"), F.lit(shard).alias("shard")))
    if not drawn:
        raise ValueError("no shard has a weight above 0")
    return F.array_min(F.array(*drawn))["shard"]


def shard_rows(df: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None,
               key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into a shard and number the rows of each shard without gaps.

    Returns the key, size (UTF-8 bytes + 8), text_crc32, shard, slot and, with ``grown`` weights,
    grown_shard.  Only narrow columns move.  Rows of a shard are cut by ranges of a second hash of the
    key, so a task numbers some ``SLOT_ROWS`` rows whatever the shard's size; the slot is the rank in
    the range plus the rows of the ranges before it.

    Null text: no bytes (size 8, crc 0).  Null key: one shared key.  Repeated keys go to one shard and
    take a slot each.  An empty table gives an empty result.  Other columns are left out.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    order = F.conv(F.substring(F.md5(key_text(F.col(key))), 25, 8), 16, 10).cast("long")
    ranges = max(1, df.count() // (len(weights) * SLOT_ROWS))
    placed = df.select(
        F.col(key), (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        rendezvous_shard(F.col(key), weights).alias("shard"),
        (rendezvous_shard(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        order.alias("_order"),
        F.floor(order * F.lit(ranges).cast("double") / float(1 << 32)).cast("long").alias("_range"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "_range").count().select(
        "shard", "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_range").orderBy("_order", key, "size", "text_crc32")
    return placed.join(starts, ["shard", "_range"]).select(
        key, "size", "text_crc32", "shard",
        (F.row_number().over(within) - 1 + F.col("_start")).alias("slot"), "grown_shard")
