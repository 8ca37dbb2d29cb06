"""Writing: layouts, upserts on plain files, partition maintenance, file sizes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators.dml import keep_other_partitions, replace_window, upsert
from tarnwork.operators.shaping import dedup_latest
from tarnwork.sources.versioned import VersionedTable

MAX_RECORDS = 1_000_000


def write_files(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite", fmt: str = "parquet", **options: str) -> None:
    """Files by partition; ``overwrite`` replaces only the partitions that ``df`` has (dynamic), or all without partitions."""
    w = df.write.format(fmt).mode(mode).option("maxRecordsPerFile", MAX_RECORDS).options(**options)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.save(path)


def write_table(df: DataFrame, table: str, partition_by: list[str] | None = None, mode: str = "overwrite", fmt: str = "parquet", bucket_by: tuple[int, list[str]] | None = None) -> None:
    """A catalog table; an existing partitioned one is written by insert, so only the partitions at hand are replaced.
    ``bucket_by`` (buckets, keys) lets later joins on the keys do without a shuffle."""
    spark = df.sparkSession
    if spark.catalog.tableExists(table) and partition_by and not bucket_by:
        was = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            df.select(*spark.table(table).columns).write.insertInto(table, overwrite=mode == "overwrite")
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", was)
        return
    w = df.write.format(fmt).mode(mode).option("maxRecordsPerFile", MAX_RECORDS)
    w = w.partitionBy(*partition_by) if partition_by else w
    w = w.bucketBy(bucket_by[0], *bucket_by[1]).sortBy(*bucket_by[1]) if bucket_by else w
    w.saveAsTable(table)


def sync_catalog(spark: SparkSession, table: str, path: str, partitioned: bool = False, fmt: str = "parquet") -> None:
    """Register the files of ``path`` as a table and find its partitions."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} USING {fmt} LOCATION '{path}'")
    if partitioned:
        spark.sql(f"MSCK REPAIR TABLE {table}")
    spark.catalog.refreshTable(table)


def append_bronze(df: DataFrame, path: str) -> None:
    write_files(df, path, ["_ingest_date"], mode="append")


def full_load(df: DataFrame, path: str, partition_by: list[str] | None = None) -> bool:
    """Replace the target, or its partitions at hand; an empty source leaves it alone. Was anything written?"""
    if df.isEmpty():
        return False
    write_files(df, path, partition_by)
    return True


def merge_partitions(new: DataFrame, table: VersionedTable, column: str, affected: list) -> None:
    """Replace the affected partitions of a versioned table; only a table without any version counts as a first run."""
    table.commit(new if table.version() is None else keep_other_partitions(table.read(), new, column, affected))


def merge_upsert(source: DataFrame, table: VersionedTable, keys: list[str], order: list[Column | str] | None = None) -> None:
    """Upsert as one atomic step."""
    table.commit(upsert(source.limit(0) if table.version() is None else table.read(), source, keys, order))


def load_window(new: DataFrame, table: VersionedTable, column: str, low, high) -> None:
    """Delete a window and insert its new rows as one atomic step."""
    table.commit(replace_window(table.read(), new, column, low, high))


def refresh_view(spark: SparkSession, view: str, sql: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMP VIEW {view} AS {sql}")


def append_empty(df: DataFrame, path: str) -> None:
    """An empty target of the schema, for a first run."""
    df.limit(0).write.mode("ignore").parquet(path)


def output_files(rows: int, avg_row_bytes: float, target_bytes: int = 256 << 20) -> int:
    return max(1, math.ceil(rows * avg_row_bytes / target_bytes))


def right_size(df: DataFrame, avg_row_bytes: float | None = None, rows: int | None = None, target_bytes: int = 256 << 20, current: int | None = None) -> DataFrame:
    """``df`` in about as many partitions as target-sized files: coalesced from more than twice as many, repartitioned from
    fewer. Without a row count, AQE rebalances by the real sizes instead of guessing."""
    if rows is None or avg_row_bytes is None:
        return df.hint("rebalance")
    want = output_files(rows, avg_row_bytes, target_bytes)
    if current is None:
        return df.hint("rebalance", want)
    return df.coalesce(want) if current > 2 * want else df.repartition(want) if current < want else df


def cluster(df: DataFrame, cols: list[str], files: int | None = None) -> DataFrame:
    """Ranges of ``cols``, sorted within: files with narrow bounds, which scans can skip."""
    r = df.repartitionByRange(files, *cols) if files else df.repartitionByRange(*cols)
    return r.sortWithinPartitions(*cols)


def drop_partitions(spark: SparkSession, table: str, column: str, values: list) -> None:
    for v in values:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({column} = '{v}')")


def add_columns(spark: SparkSession, table: str, columns: dict[str, str]) -> None:
    have = {c.lower() for c in spark.table(table).columns}
    new = {c: t for c, t in columns.items() if c.lower() not in have}
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{c}` {t}' for c, t in new.items())})")


def write_errors(bad: DataFrame, path: str, batch: int | None = None, at: Column | None = None) -> None:
    """Rejected rows as JSON, with the batch and time."""
    extra = {"_batch_id": F.lit(batch).cast("long"), "_error_ts": at if at is not None else F.lit(None).cast("timestamp")}
    bad.withColumns(extra).write.mode("append").json(path)


class FeatureTable:
    """A table with a declared primary key: written by merge or anew, read, looked up at points in time, dropped."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], time: str | None = None):
        self.table, self.keys, self.time = VersionedTable(spark, path), keys, time

    def write(self, df: DataFrame, mode: str = "merge", order: list[Column | str] | None = None) -> None:
        """``order``: of rows with one key the first counts; by default that with the greatest values, so that a run that is
        repeated writes the same."""
        keys = [*self.keys, *([self.time] if self.time else [])]
        one = dedup_latest(df, keys, order or [F.desc_nulls_last(c) for c in df.columns if c not in keys] or keys)
        if mode == "overwrite":
            self.table.commit(one)
        else:
            merge_upsert(one, self.table, keys)

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def drop(self) -> None:
        self.table.drop()


_WRITERS: dict[str, Callable] = {"files": write_files, "table": write_table}


def _adapter(fmt: str, cls: str) -> Callable:
    """A table format whose jar may be missing; asked for only when used."""

    def write(df: DataFrame, target: str, partition_by: list[str] | None = None, mode: str = "overwrite", **options: str) -> None:
        try:
            df.sparkSession._jvm.java.lang.Class.forName(cls)
        except Exception:
            raise ValueError(f"{fmt} is not on the class path") from None
        w = df.write.format(fmt).mode(mode).options(**options)
        (w.partitionBy(*partition_by) if partition_by else w).save(target)

    return write


_WRITERS["delta"] = _adapter("delta", "io.delta.sql.DeltaSparkSessionExtension")
_WRITERS["iceberg"] = _adapter("iceberg", "org.apache.iceberg.spark.SparkCatalog")
_WRITERS["jdbc"] = lambda df, target, mode="append", **o: df.write.format("jdbc").mode(mode).options(dbtable=target, **o).save()
_WRITERS["versioned"] = lambda df, target, partition_by=None, **_: VersionedTable(df.sparkSession, target).commit(df, partition_by)


def writer(kind: str) -> Callable:
    """files, table, versioned, jdbc, delta or iceberg."""
    if kind not in _WRITERS:
        raise ValueError(f"unknown writer: {kind}")
    return _WRITERS[kind]
