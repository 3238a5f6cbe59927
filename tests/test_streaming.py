"""Streamed runs give the same rows as batch runs, whatever fails and comes late in between."""

import datetime

from pyspark.sql import functions as F

from lurelake.operators.rules import rule_layer
from lurelake.sources import upsert
from lurelake.sources.sinks import scratch_path
from lurelake.streaming import jobs as J


def test_stream_equals_batch(spark):
    rows = [(i, "email", f"u{i}@shop.top", "", f"verify http://10.0.0.{i}/login now", None)
            for i in range(20)]
    df = spark.createDataFrame(rows, "msg_id long, message_type string, sender string, "
                                     "subject string, body string, headers string")
    src, out, check = (scratch_path(spark, n) for n in ("in", "out", "check"))
    df.repartition(3).write.parquet(src)
    J.stream_score_messages(J.read_stream(spark, src, df.schema, 1), out, check).awaitTermination()
    cols = ["msg_id", "sender_domain", "score", "verdict", "reason"]
    streamed = {tuple(r) for r in spark.read.parquet(out).select(*cols).collect()}
    batch = {tuple(r) for r in rule_layer(df).select(*cols).collect()}
    assert streamed == batch and len(batch) == 20


FEED = "id long, url string, date timestamp"


def feed(spark, rows):
    day = datetime.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, u, day + datetime.timedelta(minutes=m)) for i, u, m in rows], FEED)


def table(spark, path):
    return sorted((r["url"], r["id"]) for r in upsert.read(spark, path, FEED).collect())


def test_feed_table_over_two_runs(spark):
    src, out, check = (scratch_path(spark, n) for n in ("feed", "latest", "check"))

    def run(rows):
        feed(spark, rows).coalesce(1).write.mode("append").parquet(src)
        schema = feed(spark, []).schema
        J.stream_feed_dedupe(J.read_stream(spark, src, schema, 1), out, check, "1 day", buckets=4).awaitTermination()
        return table(spark, out)

    assert run([(1, "a", 0), (2, "b", 1), (3, "a", 2), (3, "a", 2), (4, None, 3)]) == [("a", 3), ("b", 2)]
    before = upsert.versions(spark, out)
    # a late row with a smaller id does not replace a newer one; a repeated id inside the watermark is dropped
    assert run([(0, "b", 1), (5, "c", 4), (3, "a", 2)]) == [("a", 3), ("b", 2), ("c", 5)]
    assert run([(9, "a", 9)]) == [("a", 9), ("b", 2), ("c", 5)]
    assert len(upsert.versions(spark, out)) > len(before)


def test_a_retried_or_broken_merge_changes_nothing(spark):
    out = scratch_path(spark, "latest")
    assert upsert.read(spark, out, FEED).count() == 0
    first, second = feed(spark, [(1, "a", 0), (2, "b", 0)]), feed(spark, [(3, "a", 0), (1, "z", 0)])
    upsert.merge(first, out, "url", "id", 8)
    upsert.merge(second, out, "url", "id", 8)
    want = [("a", 3), ("b", 2), ("z", 1)]
    assert table(spark, out) == want
    upsert.merge(second, out, "url", "id", 8)  # retried after the commit
    assert table(spark, out) == want
    # a merge that died before its manifest leaves files that nobody reads; the next one replaces them
    version = upsert.versions(spark, out)[-1] + 1
    feed(spark, [(99, "a", 0)]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{out}/data/version={version}")
    assert table(spark, out) == want
    upsert.merge(feed(spark, [(4, "b", 0)]), out, "url", "id", 8)
    want = [("a", 3), ("b", 4), ("z", 1)]
    assert table(spark, out) == want
    upsert.merge(feed(spark, []), out, "url", "id", 8)
    assert upsert.vacuum(spark, out, keep=1) > 0 and table(spark, out) == want and len(upsert.versions(spark, out)) == 1


def test_only_touched_buckets_are_rewritten_and_reading_is_one_scan(spark):
    out = scratch_path(spark, "latest")
    upsert.merge(feed(spark, [(i, f"u{i}", 0) for i in range(200)]), out, "url", "id", 16)
    before = upsert._manifest(spark, out, upsert.versions(spark, out)[-1])
    upsert.merge(feed(spark, [(500, "u7", 0)]), out, "url", "id", 16)
    after = upsert._manifest(spark, out, upsert.versions(spark, out)[-1])
    assert sum(after[b] != before[b] for b in before) == 1 and len(after) == 16
    plan = upsert.read(spark, out, FEED)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
