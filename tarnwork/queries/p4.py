"""Problem 4: files of JSON records whose fields drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators.drifting import canonical_names, columns_of_files, file_unions, first_deliveries, nested_alternatives, new_alternatives, one_table, placed_changes, rejected_records, rename_moves, schema_changes, valid_records
from tarnwork.session import cut
from tarnwork.sources.tables import table

KEEP = ["_source_system", "_source_file", "_ingest_ts", "_ingest_date"]


def _unions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    raw = table(spark, sf_dir, "bronze_sales")
    files = cut(first_deliveries(raw, "_source_system", "_source_file", "_ingest_ts"), "files")
    records = valid_records(raw, "raw_value", KEEP)
    return records, files, cut(file_unions(records, files, "_source_system", "_source_file", "_ingest_ts"), "unions")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files, unions = _unions(spark, sf_dir)
    return schema_changes(unions, files)


def p4_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of p4_found, and each type that single values of a field, or of a path in it, take on for the first time
    (``alternative``)."""
    records, files, unions = _unions(spark, sf_dir)
    alt = new_alternatives(unions).unionByName(nested_alternatives(records, files, "_source_system", "_source_file", "_ingest_ts")).select("source_file", F.lit("alternative").alias("change"), F.col("field").alias("field_from"), F.col("field").alias("field_to"), "type", "n")
    return schema_changes(unions, files).unionByName(alt, allowMissingColumns=True)


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid records of all deliveries in one table; ``redelivered`` marks those of a file's later deliveries."""
    records, files, unions = _unions(spark, sf_dir)
    changes = cut(placed_changes(unions, files), "changes")
    fields = canonical_names(changes, unions)
    to = columns_of_files(rename_moves(changes, unions), files)
    first = files.join(to, ["system", "file"], "left").select(F.col("system").alias("_source_system"), F.col("file").alias("_source_file"), F.col("ts").alias("__first"), F.col("to").alias("__to"))
    marked = records.join(first, ["_source_system", "_source_file"], "left").withColumn("redelivered", F.col("_ingest_ts") > F.col("__first"))
    return one_table(marked, fields, [*KEEP, "redelivered"], "__to")


def p4_certain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes that need no pairing by content: fields retyped, and those removed or added in files without the other."""
    c = p4_found(spark, sf_dir)
    sides = c.where("change <> 'retyped'").groupBy("source_file").agg(F.count_distinct("change").alias("n"), F.bool_or(F.col("change") == "renamed").alias("r"))
    return c.join(sides, "source_file", "left").where("change = 'retyped' OR (n = 1 AND NOT r)").select(*c.columns)


def p4_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are in no table, by file and reason."""
    return rejected_records(table(spark, sf_dir, "bronze_sales"), "raw_value", ["_source_file"]).groupBy("_source_file", "reason").agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {"p4_found": p4_found, "p4_changes": p4_changes, "p4_table": p4_table, "p4_certain": p4_certain, "p4_rejected": p4_rejected}
#: Pairing renamed fields by content has no SQL; tests hold it against planted drift.
ORACLE: dict[str, str] = {
    "p4_rejected": """
    SELECT _source_file, CASE WHEN coalesce(trim(raw_value), '') = '' THEN 'empty' ELSE 'no_object' END AS reason, CAST(count(*) AS BIGINT) AS rows
    FROM bronze_sales WHERE coalesce(trim(raw_value), '') = '' OR NOT json_valid(raw_value) OR json_type(CASE WHEN json_valid(raw_value) THEN raw_value END) <> 'OBJECT' GROUP BY ALL""",
    "p4_certain": """
    WITH f AS (SELECT _source_system AS sys, _source_file AS file, min(_ingest_ts) AS ts FROM bronze_sales WHERE _source_system IS NOT NULL AND _source_file IS NOT NULL GROUP BY ALL),
    o AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY sys) AS files FROM f WINDOW w AS (PARTITION BY sys ORDER BY ts, file)),
    r AS (SELECT o.sys, o.k, CAST(CASE WHEN json_valid(raw_value) THEN raw_value END AS JSON) AS j FROM bronze_sales b JOIN o ON b._source_system = o.sys AND b._source_file = o.file AND b._ingest_ts = o.ts),
    e AS (SELECT sys, k, t.key AS field, t.type AS jt FROM r, json_each(j) AS t WHERE json_type(j) = 'OBJECT' AND t.type <> 'NULL'),
    c AS (SELECT sys, k, field, CASE jt WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS type, count(*) AS n FROM e GROUP BY ALL),
    u AS (SELECT sys, k, field, arg_min(type, (-n, type)) AS type FROM c GROUP BY ALL),
    p AS (SELECT *, lag(k) OVER w AS pk, lag(type) OVER w AS pt, lead(k) OVER w AS nk FROM u WINDOW w AS (PARTITION BY sys, field ORDER BY k)),
    m AS (
      SELECT sys, k, 'added' AS change, '' AS field_from, field AS field_to FROM p WHERE k > 1 AND pk IS DISTINCT FROM k - 1
      UNION ALL SELECT p.sys, p.k + 1, 'removed', field, '' FROM p JOIN o USING (sys, k) WHERE p.k < o.files AND nk IS DISTINCT FROM p.k + 1),
    s AS (SELECT sys, k, count(DISTINCT change) AS sides FROM m GROUP BY ALL),
    x AS (
      SELECT m.* FROM m JOIN s USING (sys, k) WHERE sides = 1
      UNION ALL SELECT sys, k, 'retyped', field, field FROM p WHERE pk = k - 1 AND pt <> type)
    SELECT file AS source_file, change, field_from, field_to FROM x JOIN o USING (sys, k)""",
}
