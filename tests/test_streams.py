from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.sources.versioned import VersionedTable
from tarnwork.streaming import streams

SCHEMA = "id int, v string, op string, seq long"


def put(spark, at, n, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/{n}")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_stream_is_idempotent_and_ordered(spark, tmp_path):
    src, t = f"{tmp_path}/src", VersionedTable(spark, f"{tmp_path}/t")
    put(spark, src, 1, [(1, "a", "I", 1), (2, "b", "I", 1), (1, "c", "U", 5)])
    action = streams.merge_batches(t, ["id"], "op", ["v"], ["seq"])
    stream = lambda: streams.each_batch(streams.file_stream(spark, src, SCHEMA, recursiveFileLookup="true"), action, f"{tmp_path}/cp").awaitTermination()
    stream()
    assert rows(streams.live(t).select("id", "v")) == [(1, "c"), (2, "b")]
    put(spark, src, 2, [(1, "old", "U", 3), (2, None, "D", 2), (3, "x", "I", 1)])
    stream()
    want = [(1, "c"), (3, "x")]
    assert rows(streams.live(t).select("id", "v")) == want
    action(spark.createDataFrame([(2, "b", "I", 1), (1, "c", "U", 5), (3, "x", "I", 1)], SCHEMA), 1)
    assert rows(streams.live(t).select("id", "v")) == want


def test_router_and_append(spark, tmp_path):
    src = f"{tmp_path}/src"
    put(spark, src, 1, [("1", "a"), ("x", "b")], "n string, w string")
    s = streams.file_stream(spark, src, "n string, w string", recursiveFileLookup="true", max_files=1)
    streams.each_batch(s, streams.route(f"{tmp_path}/good", f"{tmp_path}/bad", {"n": "int"}), f"{tmp_path}/cp").awaitTermination()
    assert [(r.n, r["_batch_id"]) for r in spark.read.parquet(f"{tmp_path}/good").collect()] == [(1, 0)]
    bad = spark.read.json(f"{tmp_path}/bad").first()
    assert (bad.n, bad["_errors"], bad["_batch_id"]) == ("x", ["n"], 0)
    streams.append(s, f"{tmp_path}/all", f"{tmp_path}/cp2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/all").count() == 2


def test_event_time_windows(spark, tmp_path):
    src = f"{tmp_path}/src"
    put(spark, src, 1, [("a", "2026-01-01 00:00:10"), ("a", "2026-01-01 00:00:50"), ("a", "2026-01-01 00:03:00"), ("a", "2026-01-01 01:00:00")], "k string, t string")
    s = streams.file_stream(spark, src, "k string, t string", recursiveFileLookup="true").withColumn("t", F.to_timestamp("t"))
    n = [F.count(F.lit(1)).alias("n")]
    for name, df, want in (("w", streams.tumbling(s, "t", "1 minute", "1 minute", ["k"], n), [2, 1]), ("s", streams.sessions(s, "t", "5 minutes", "1 minute", ["k"], n), [3])):
        streams.append(df, f"{tmp_path}/{name}", f"{tmp_path}/cp{name}").awaitTermination()
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted((r.n for r in out.collect()), reverse=True) == want


def test_stored_schema(spark, tmp_path):
    at = f"{tmp_path}/schema"
    one = streams.stored_schema(spark, at, lambda: spark.range(1).schema)
    assert streams.stored_schema(spark, at, lambda: 1 / 0) == one
