"""Streams: file discovery, drains, idempotent micro-batch merges, routing of bad rows, event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tarnwork.functions.schema import cast_or_divert
from tarnwork.operators.dml import apply_changes
from tarnwork.sources.sink import write_errors
from tarnwork.sources.versioned import VersionedTable


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", glob: str | None = None, max_files: int | None = None, max_bytes: str | None = None, **options: str) -> DataFrame:
    """New files of a folder as they come. ``max_files`` and ``max_bytes`` bound a micro-batch."""
    r = spark.readStream.format(fmt).schema(schema).options(**options)
    for name, value in (("pathGlobFilter", glob), ("maxFilesPerTrigger", max_files), ("maxBytesPerTrigger", max_bytes)):
        if value is not None:
            r = r.option(name, str(value))
    return r.load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """(raw_value, kafka_ts); needs the connector's jar."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options)
    return r.load().select(F.col("value").cast("string").alias("raw_value"), F.col("timestamp").alias("kafka_ts"))


def stored_schema(spark: SparkSession, at: str, sample: Callable[[], T.StructType]) -> T.StructType:
    """The schema kept at ``at``, made by ``sample`` the first time: a restarted stream reads with the schema it began with."""
    try:
        return T.StructType.fromJson(__import__("json").loads("".join(r.value for r in spark.read.text(at).collect())))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    s = sample()
    spark.createDataFrame([(s.json(),)], "value string").coalesce(1).write.text(at)
    return s


def append(df: DataFrame, path: str, checkpoint: str, every: str | None = None, partition_by: list[str] | None = None) -> StreamingQuery:
    """Append to files; without ``every`` (a processing time) what is there is drained and the query ends."""
    w = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    w = w.partitionBy(*partition_by) if partition_by else w
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start(path)


def each_batch(df: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    w = df.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def merge_batches(table: VersionedTable, keys: list[str], op: str, order: list[Column | str], seq: list[str]) -> Callable[[DataFrame, int], None]:
    """A micro-batch action that applies changes to a versioned table and can be repeated.

    The table keeps each key's last applied sequence and its deletes as tombstones (``_deleted``), so a batch that comes
    twice, or changes older than what was applied, do nothing. Read it with ``live``.
    """

    def action(batch: DataFrame, batch_id: int) -> None:
        new = batch.withColumn("_deleted", F.col(op) == "D").drop(op)
        if table.version() is None:
            old = new.limit(0)
        else:
            old = table.read()
        both = old.withColumn("__op", F.lit("U")).unionByName(new.withColumn("__op", F.lit("U")))
        state = apply_changes(both.limit(0).drop("__op"), both, keys, "__op", [*(F.desc(s) for s in seq), *order])
        table.commit(state)

    return action


def live(table: VersionedTable) -> DataFrame:
    return table.read().where("NOT _deleted").drop("_deleted")


def route(good: str, bad: str, casts: dict[str, str], at: Callable[[], Column] = F.current_timestamp) -> Callable[[DataFrame, int], None]:
    """A micro-batch action: rows that take the types are appended to ``good``, the rest to ``bad`` with batch and time."""

    def action(batch: DataFrame, batch_id: int) -> None:
        ok, no = cast_or_divert(batch, casts)
        ok.withColumn("_batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(good)
        write_errors(no, bad, batch_id, at())

    return action


def tumbling(df: DataFrame, ts: str, size: str, late: str, keys: list[str], aggs: list[Column], slide: str | None = None) -> DataFrame:
    """Aggregates per window and key; rows later than ``late`` are dropped once their window is out."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.withWatermark(ts, late).groupBy(w, *keys).agg(*aggs).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *[F.col(a) for a in _names(aggs)])


def sessions(df: DataFrame, ts: str, gap: str, late: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(*aggs).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, *[F.col(a) for a in _names(aggs)])


def _names(aggs: list[Column]) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for a in aggs]


def dedup(df: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Repeats within the time ``late`` dropped; the state is bounded by it."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
