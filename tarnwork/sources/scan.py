"""Reading: files, tables, look-backs, increments, partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_files(spark: SparkSession, path: str | list[str], fmt: str, schema: T.StructType | str | None = None, recursive: bool = False, mode: str | None = None, **options: str) -> DataFrame:
    """parquet, csv, json, avro, orc or text. ``recursive`` is off by default, since it turns partition discovery off. ``mode``:
    PERMISSIVE (keeps bad records in ``_corrupt_record``), DROPMALFORMED or FAILFAST."""
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", "true")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if schema is not None:
        s = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if mode == "PERMISSIVE" and CORRUPT not in s.names:
            s = T.StructType([*s.fields, T.StructField(CORRUPT, T.StringType())])
        r = r.schema(s)
    if mode:
        r = r.option("mode", mode)
        if mode == "PERMISSIVE":
            r = r.option("columnNameOfCorruptRecord", CORRUPT)
    return r.options(**options).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, lower: int | None = None, upper: int | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A database table, read in ``partitions`` ranges of ``column`` where one is given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        r = r.option("partitionColumn", column).option("lowerBound", str(lower)).option("upperBound", str(upper)).option("numPartitions", str(partitions))
    return r.load()


def read_table(spark: SparkSession, name: str, predicate: str | None = None) -> DataFrame:
    df = spark.table(name)
    return df.where(predicate) if predicate else df


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name; a column that a source lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_lineage(df: DataFrame, system: str, at: Column, file: Column | None = None) -> DataFrame:
    """The lineage columns; ``file`` is ``_metadata.file_path`` for file sources and null without."""
    return df.withColumns({"_ingest_ts": at, "_ingest_date": F.date_format(at, "yyyyMMdd"), "_source_system": F.lit(system), "_source_file": file if file is not None else F.lit(None).cast("string")})


def latest_of(df: DataFrame, period: str) -> DataFrame:
    """The rows of the greatest period; the period is found on its column alone."""
    top = df.agg(F.max(period).alias("__top"))
    return df.join(F.broadcast(top), F.col(period) == F.col("__top")).drop("__top")


def latest_dimension(df: DataFrame, period: str, key: str) -> DataFrame:
    """Distinct non-null keys of the latest period."""
    return latest_of(df, period).where(F.col(key).isNotNull()).select(key).distinct()


def day_back(day: int, days: int) -> int:
    import datetime as dt

    d = dt.datetime.strptime(str(day), "%Y%m%d") - dt.timedelta(days=days)
    return int(d.strftime("%Y%m%d"))


def month_back(month: int, months: int) -> int:
    y, m = divmod(month // 100 * 12 + month % 100 - 1 - months, 12)
    return y * 100 + m + 1


def look_back(df: DataFrame, period: str, until: int, n: int) -> DataFrame:
    """Rows from ``n`` days (yyyyMMdd) or months (yyyyMM) before ``until`` on; n = 0 reads all. A plain comparison, so it reaches the scan."""
    if not n:
        return df
    return df.where(F.col(period) >= F.lit(month_back(until, n) if until < 1_000_000 else day_back(until, n)))


def increment(df: DataFrame, column: str, watermark: str | None, overlap: str | None = None) -> DataFrame:
    """Rows beyond the watermark, compared in the column's own type; None reads all. ``overlap`` (an interval such as
    '1 hour') steps back for late rows; deduplicate afterwards."""
    if watermark is None:
        return df
    mark = F.lit(watermark).cast(df.schema[column].dataType)
    if overlap:
        mark = mark - F.expr(f"INTERVAL {overlap}")
    return df.where(F.col(column) > mark)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of a PERMISSIVE read."""
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT), df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def rescued_json(df: DataFrame, raw: str, schema: str) -> DataFrame:
    """JSON texts by ``schema``, with ``_rescued``: what the schema has no place for, as a JSON object, null if nothing. Texts
    that are no object have null fields and are rescued whole."""
    known = T.StructType.fromDDL(schema).names
    m = F.try_parse_json(raw).try_cast("map<string,variant>")
    rest = F.map_filter(F.col("__m"), lambda k, v: ~k.isin(known))
    d = df.withColumn("__m", m).withColumn("__r", F.from_json(raw, schema))
    whole = F.when(F.col("__m").isNull(), F.col(raw)).when(F.size(rest) > 0, F.to_json(rest))
    keep = [c for c in df.columns if c not in (raw, *known)]
    return d.select(*keep, *(F.when(F.col("__m").isNotNull(), F.col(f"__r.{c}")).alias(c) for c in known), whole.alias("_rescued"))


def partitions_of(spark: SparkSession, table: str, column: str, since: str | None = None) -> DataFrame:
    """(value) of a table's partitions in order, from the catalog where it has them, else by a distinct on the column."""
    try:
        v = spark.sql(f"SHOW PARTITIONS {table}").select(F.regexp_extract("partition", rf"(?:^|/){column}=([^/]*)", 1).alias("value"))
    except Exception as e:
        if "PARTITION" not in str(e).upper():
            raise
        v = spark.table(table).select(F.col(column).cast("string").alias("value"))
    v = v.where("value <> ''").distinct()
    return (v.where(F.col("value") >= since) if since else v).orderBy("value")


def new_partitions(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Period values of the source that the target lacks."""
    return source.select(column).distinct().join(target.select(column).distinct(), column, "left_anti")
