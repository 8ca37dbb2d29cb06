"""Queries of the lakehouse operators, each with its SQL. Names begin with the operator's number in the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.clean import text
from tarnwork.functions.schema import align_to, cast_or_divert, composite_id, error_totals, round_floats
from tarnwork.operators import dml, features, joins, periods, quality, shaping, stats, table_profile
from tarnwork.operators.snapshots import clean_snapshots
from tarnwork.plans import serving
from tarnwork.session import new_dir
from tarnwork.sources import scan
from tarnwork.sources.tables import table
from tarnwork.streaming import streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with its order and the exact amount."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice", "l_discount", "l_quantity")
    amount = (F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(6,2)"))).cast("decimal(18,4)")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_date"), "o_orderpriority")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("*", amount.alias("amount"))


LINES = """
    WITH lines AS (
      SELECT *, CAST(o_orderdate AS DATE) AS order_date,
             CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(6,2))) AS DECIMAL(18,4)) AS amount
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def event_days(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "user_id", "event_id", F.to_date("ts").alias("day"), F.col("value").cast("decimal(18,6)").alias("v"))
    return e.groupBy("event_type", "day").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"))


EVENT_DAYS = """
    WITH days AS (
      SELECT event_type, CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(18,6))) AS total, CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT user_id) AS BIGINT) AS users
      FROM events GROUP BY 1, 2)
"""


# --- scans -----------------------------------------------------------------------------------------------------------


@query("s1_file_scan", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    return scan.read_files(spark, f"{d}/nation.parquet", "parquet").select("n_nationkey", "n_name")


@query("s2_predicate_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("s4_union_sources", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return scan.union_sources([c, s])


@query("s5_latest_dimension", "SELECT DISTINCT id FROM dim_customer_snapshot WHERE snapshot_dt = (SELECT max(snapshot_dt) FROM dim_customer_snapshot) AND id IS NOT NULL")
def _(spark, d):
    return scan.latest_dimension(table(spark, d, "dim_customer_snapshot"), "snapshot_dt", "id")


@query("s6_look_back_days", "SELECT site_code, product, data_dt, daily_amount FROM sales_mart WHERE data_dt >= 20260110")
def _(spark, d):
    return scan.look_back(table(spark, d, "sales_mart"), "data_dt", 20260209, 30).select("site_code", "product", "data_dt", "daily_amount")


@query("s6_look_back_months", "SELECT mnth_id, CAST(count(*) AS BIGINT) AS n FROM sales_mart WHERE mnth_id >= 202512 GROUP BY 1")
def _(spark, d):
    return scan.look_back(table(spark, d, "sales_mart"), "mnth_id", 202602, 2).groupBy("mnth_id").agg(F.count(F.lit(1)).alias("n"))


@query("s7_latest_period", "SELECT id, name FROM dim_customer_snapshot WHERE snapshot_dt = (SELECT max(snapshot_dt) FROM dim_customer_snapshot)")
def _(spark, d):
    return scan.latest_of(table(spark, d, "dim_customer_snapshot"), "snapshot_dt").select("id", "name")


@query("s8_increment", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-30 00:00:00'")
def _(spark, d):
    return scan.increment(table(spark, d, "orders"), "o_orderdate", "1995-06-30 00:00:00").select("o_orderkey", "o_orderdate")


_TWO = """
    WITH s AS (
      SELECT id, snapshot_dt, nullif(trim(name), '') AS name, nullif(trim(address), '') AS address, nullif(trim(tier), '') AS tier FROM dim_customer_snapshot WHERE id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY snapshot_dt, id ORDER BY updated_at DESC NULLS LAST, name DESC NULLS LAST) = 1),
    o AS (SELECT * FROM s WHERE snapshot_dt = (SELECT min(snapshot_dt) FROM s)),
    n AS (SELECT * FROM s WHERE snapshot_dt = (SELECT max(snapshot_dt) FROM s))
"""


def first_and_last(spark, d) -> tuple[DataFrame, DataFrame]:
    """The first and the last snapshot, cleaned; the two days come from one column, then only their rows are read."""
    raw = table(spark, d, "dim_customer_snapshot").where("id IS NOT NULL")
    days = raw.agg(F.min("snapshot_dt").alias("lo"), F.max("snapshot_dt").alias("hi")).first()
    clean = lambda day: clean_snapshots(raw.where(F.col("snapshot_dt") == F.lit(day)), "id", "snapshot_dt", "updated_at", ["name", "address", "tier"])
    return tuple(clean(x).select("id", "name", "address", "tier", "snapshot_dt") for x in days)


@query("s10_change_feed", _TWO + """
    SELECT id, name, address, tier, 'insert' AS _change_type, CAST(7 AS BIGINT) AS _commit_version FROM n WHERE id NOT IN (SELECT id FROM o)
    UNION ALL SELECT id, name, address, tier, 'delete', 7 FROM o WHERE id NOT IN (SELECT id FROM n)
    UNION ALL SELECT o.id, o.name, o.address, o.tier, 'update_preimage', 7 FROM o JOIN n USING (id) WHERE (o.name, o.address, o.tier) IS DISTINCT FROM (n.name, n.address, n.tier)
    UNION ALL SELECT n.id, n.name, n.address, n.tier, 'update_postimage', 7 FROM o JOIN n USING (id) WHERE (o.name, o.address, o.tier) IS DISTINCT FROM (n.name, n.address, n.tier)""")
def _(spark, d):
    o, n = first_and_last(spark, d)
    return dml.snapshot_changes_as_feed(o, n, ["id"], ["name", "address", "tier"], 7)


@query("s12_rescued_data")
def _(spark, d):
    b = table(spark, d, "bronze_sales").select("raw_value", "_source_file")
    return scan.rescued_json(b, "raw_value", "transaction_id string, site_code string, amount string")


@query("s15_cast_or_divert", "SELECT transaction_id, site_code, amount, load_id FROM sales WHERE amount IS NOT NULL AND try_cast(amount AS DECIMAL(18,2)) IS NULL")
def _(spark, d):
    return cast_or_divert(table(spark, d, "sales"), {"amount": "decimal(18,2)"})[1].select("transaction_id", "site_code", "amount", "load_id")


@query("s15_error_totals", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (amount IS NOT NULL AND try_cast(amount AS DECIMAL(18,2)) IS NULL) AS BIGINT) AS errors, count(*) FILTER (amount IS NOT NULL AND try_cast(amount AS DECIMAL(18,2)) IS NULL) <= 0.02 * count(*) AS within FROM sales")
def _(spark, d):
    return error_totals(table(spark, d, "sales"), {"amount": "decimal(18,2)"}, 0.02)


@query("s25_latest_not_deleted", """
    SELECT customer_id, name, _commit_version FROM (
      SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY _commit_version DESC, _commit_timestamp DESC, name, tier, address) AS rn FROM changes
      WHERE customer_id IS NOT NULL AND lower(trim(coalesce(_change_type, ''))) <> 'update_preimage')
    WHERE rn = 1 AND lower(trim(coalesce(Op, ''))) <> 'd' AND lower(trim(coalesce(_change_type, ''))) <> 'delete'""")
def _(spark, d):
    c = table(spark, d, "changes").where("customer_id IS NOT NULL AND lower(trim(coalesce(_change_type, ''))) <> 'update_preimage'")
    last = shaping.dedup_latest(c, ["customer_id"], [F.desc("_commit_version"), F.desc("_commit_timestamp"), F.asc_nulls_last("name"), F.asc_nulls_last("tier"), F.asc_nulls_last("address")])
    return last.where("lower(trim(coalesce(Op, ''))) <> 'd' AND lower(trim(coalesce(_change_type, ''))) <> 'delete'").select("customer_id", "name", "_commit_version")


# --- projections -----------------------------------------------------------------------------------------------------


@query("p_lineage_columns", "SELECT r_regionkey, r_name, TIMESTAMP '2026-01-05 02:00:00' AS _ingest_ts, '20260105' AS _ingest_date, 'erp' AS _source_system, NULL::VARCHAR AS _source_file FROM region")
def _(spark, d):
    return scan.with_lineage(table(spark, d, "region").select("r_regionkey", "r_name"), "erp", F.lit("2026-01-05 02:00:00").cast("timestamp"))


@query("p_cleanse", r"""
    SELECT DISTINCT transaction_id, CAST(try_cast(amount AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS amount, CAST(strftime(record_date, '%Y%m%d') AS INTEGER) AS data_dt, CAST(strftime(record_date, '%Y%m') AS INTEGER) AS mnth_id
    FROM sales WHERE transaction_id IS NOT NULL AND trim(transaction_id) <> '' AND record_date IS NOT NULL AND regexp_full_match(amount, '-?[0-9]+\.[0-9]{2}')""")
def _(spark, d):
    s = table(spark, d, "sales").where((F.trim("transaction_id") != "") & F.col("record_date").isNotNull() & F.col("amount").rlike(r"^-?[0-9]+\.[0-9]{2}\z"))
    day = F.year("record_date") * 10000 + F.month("record_date") * 100 + F.dayofmonth("record_date")
    return s.select("transaction_id", F.col("amount").try_cast("decimal(18,2)").alias("amount"), day.alias("data_dt"), F.floor(day / 100).cast("int").alias("mnth_id")).distinct()


@query("p_round_floats", "SELECT s_suppkey, CAST(round(CAST(s_acctbal AS DECIMAL(28,8)), 1) AS DOUBLE) AS s_acctbal FROM supplier")
def _(spark, d):
    return round_floats(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), 1)


@query("p_align_schema", "SELECT c_custkey AS id, c_name AS name, NULL::DATE AS since FROM customer")
def _(spark, d):
    src = table(spark, d, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("name"), "c_acctbal")
    return align_to(src, spark.createDataFrame([], "id long, name string, since date").schema)


@query("p_composite_id", r"SELECT customer_id, _commit_version, coalesce(CAST(customer_id AS VARCHAR), '\N') || '|' || coalesce(tier, '\N') AS record_id, CAST(epoch(_commit_timestamp) AS DOUBLE) AS event_time FROM changes")
def _(spark, d):
    seconds = F.floor(F.unix_micros(F.col("_commit_timestamp").cast("timestamp")) / 1)
    return table(spark, d, "changes").select("customer_id", "_commit_version", composite_id(["customer_id", "tier"]).alias("record_id"), (seconds / 1e6).alias("event_time"))


# --- joins -----------------------------------------------------------------------------------------------------------


@query("j1_restrict", "SELECT site_code, product, data_dt, daily_amount FROM sales_mart WHERE site_code IN (SELECT site_code FROM dim_site WHERE active)")
def _(spark, d):
    return shaping.restrict_to(table(spark, d, "sales_mart"), table(spark, d, "dim_site").where("active"), "site_code").select("site_code", "product", "data_dt", "daily_amount")


@query("j2_enrich", "SELECT s_suppkey, s_nationkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    return shaping.enrich(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name"), {"s_nationkey": "n_nationkey"})


@query("j3_zero_fill", EVENT_DAYS + """
    , t AS (SELECT DISTINCT event_type FROM events), p AS (SELECT DISTINCT day FROM days)
    SELECT t.event_type, p.day, coalesce(events, 0) AS events, coalesce(users, 0) AS users FROM t CROSS JOIN p LEFT JOIN days ON days.event_type = t.event_type AND days.day = p.day""")
def _(spark, d):
    f = event_days(spark, d).select("event_type", "day", "events", "users")
    return shaping.zero_fill(f, table(spark, d, "events"), "event_type", ["day"], ["events", "users"])


@query("j4_salted_join", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return joins.salted_join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), p, ["l_partkey"]).select("l_orderkey", "l_linenumber", "p_brand")


@query("j7_feature_lookup", """
    WITH f AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_orders, max(o_totalprice) AS max_price FROM orders GROUP BY 1)
    SELECT c_custkey, n_orders, max_price FROM customer LEFT JOIN f ON c_custkey = o_custkey""")
def _(spark, d):
    f = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("max_price"))
    return joins.lookup_features(table(spark, d, "customer").select("c_custkey"), f, ["c_custkey"], ["n_orders", "max_price"])


@query("j8_as_of", """
    WITH e AS (SELECT * FROM events), l AS (SELECT * FROM e WHERE event_type = (SELECT min(event_type) FROM e)), r AS (SELECT * FROM e WHERE event_type = (SELECT max(event_type) FROM e))
    SELECT l.event_id, l.user_id, l.ts, (SELECT arg_max(r.event_id, (r.ts, r.event_id)) FROM r WHERE r.user_id = l.user_id AND r.ts <= l.ts) AS event_id_right FROM l""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    lim = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    pick = lambda x: e.crossJoin(F.broadcast(lim)).where(f"event_type = {x}").select("event_id", "user_id", "ts")
    return joins.as_of(pick("lo"), pick("hi"), ["user_id"], "ts", "ts", ["event_id"], tie="event_id")


_VERSIONS = """
    v AS (
      SELECT id, tier, effective_start AS s, least(effective_end, lead(effective_start) OVER (PARTITION BY id ORDER BY effective_start, effective_end NULLS LAST)) AS e
      FROM (SELECT DISTINCT id, nullif(trim(tier), '') AS tier, effective_start, effective_end FROM dim_customer))
"""


@query("j9_valid_at", "WITH " + _VERSIONS + """
    SELECT c.id, c.at, v.tier FROM (SELECT DISTINCT id, DATE '2025-06-30' AS at FROM dim_customer) c LEFT JOIN v ON v.id = c.id AND v.s <= c.at AND (v.e IS NULL OR v.e > c.at)""")
def _(spark, d):
    from pyspark.sql import Window as W

    v = table(spark, d, "dim_customer").select("id", text("tier").alias("tier"), F.col("effective_start").alias("s"), "effective_end").distinct()
    v = v.withColumn("e", F.least("effective_end", F.lead("s").over(W.partitionBy("id").orderBy("s", F.col("effective_end").asc_nulls_last()))))
    ask = v.select("id").distinct().withColumn("at", F.lit("2025-06-30").cast("date"))
    return joins.valid_at(ask, v, "id", "at", "s", "e", ["tier"])


@query("j10_new_periods", "SELECT DISTINCT mnth_id FROM sales_mart EXCEPT SELECT DISTINCT CAST(strftime(make_date(snapshot_dt // 10000, snapshot_dt // 100 % 100, 1), '%Y%m') AS INTEGER) FROM dim_customer_snapshot")
def _(spark, d):
    t = table(spark, d, "dim_customer_snapshot").select(F.floor(F.col("snapshot_dt") / 100).cast("int").alias("mnth_id"))
    return scan.new_partitions(table(spark, d, "sales_mart"), t, "mnth_id")


# --- DML as next states ----------------------------------------------------------------------------------------------


@query("k8_upsert", _TWO + "SELECT id, name, address, tier, snapshot_dt FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, name, address, tier, snapshot_dt FROM n")
def _(spark, d):
    o, n = first_and_last(spark, d)
    return dml.upsert(o, n, ["id"])


_CHANGES = """
    WITH c AS (
      SELECT customer_id, name, address, tier, _commit_version, _commit_timestamp, upper(left(coalesce(nullif(trim(Op), ''), nullif(trim(_change_type), ''), 'I'), 1)) AS op
      FROM changes WHERE customer_id IS NOT NULL AND lower(trim(coalesce(_change_type, ''))) <> 'update_preimage'),
    t AS (SELECT customer_id, name, address, tier FROM c WHERE _commit_version = 0 QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY name, address, tier) = 1),
    l AS (SELECT * FROM c WHERE _commit_version > 0 QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY _commit_version DESC, _commit_timestamp DESC, op, name NULLS LAST, address NULLS LAST, tier NULLS LAST) = 1)
"""


@query("k9_apply_changes", _CHANGES + "SELECT * FROM t WHERE customer_id NOT IN (SELECT customer_id FROM l) UNION ALL SELECT customer_id, name, address, tier FROM l WHERE op <> 'D'")
def _(spark, d):
    op = F.upper(F.left(F.coalesce(text("Op"), text("_change_type"), F.lit("I")), F.lit(1)))
    c = table(spark, d, "changes").where("customer_id IS NOT NULL AND lower(trim(coalesce(_change_type, ''))) <> 'update_preimage'").withColumn("op", op)
    t = shaping.dedup_latest(c.where("_commit_version = 0"), ["customer_id"], ["name", "address", "tier"]).select("customer_id", "name", "address", "tier")
    last = [F.desc("_commit_version"), F.desc("_commit_timestamp"), F.col("op"), *(F.asc_nulls_last(x) for x in ("name", "address", "tier"))]
    return dml.apply_changes(t, c.where("_commit_version > 0"), ["customer_id"], "op", last)


@query("k10_scd2", _TWO + """
    , h AS (SELECT id, name, address, tier, DATE '2020-01-01' AS s FROM o), j AS (
      SELECT h.id AS hid, n.id AS nid, h.name AS hn, h.address AS ha, h.tier AS ht, n.name AS nn, n.address AS na, n.tier AS nt, (h.name, h.address, h.tier) IS DISTINCT FROM (n.name, n.address, n.tier) AS diff
      FROM h FULL JOIN n ON h.id = n.id)
    SELECT hid AS id, hn AS name, ha AS address, ht AS tier, NOT (nid IS NOT NULL AND diff) AS is_current, DATE '2020-01-01' AS effective_start, CASE WHEN nid IS NOT NULL AND diff THEN DATE '2026-06-01' END AS effective_end FROM j WHERE hid IS NOT NULL
    UNION ALL SELECT nid, nn, na, nt, true, DATE '2026-06-01', NULL FROM j WHERE nid IS NOT NULL AND (hid IS NULL OR diff)""")
def _(spark, d):
    o, n = first_and_last(spark, d)
    h = o.select("id", "name", "address", "tier", F.lit(True).alias("is_current"), F.lit("2020-01-01").cast("date").alias("effective_start"), F.lit(None).cast("date").alias("effective_end"))
    return dml.scd2(h, n, ["id"], ["name", "address", "tier"], F.lit("2026-06-01").cast("date"))


@query("k13_merge_partitions", "SELECT site_code, mnth_id, daily_txns FROM sales_mart WHERE mnth_id IS NULL OR mnth_id NOT IN (202601, 202602) UNION ALL SELECT site_code, mnth_id, 0 FROM sales_mart WHERE mnth_id = 202601")
def _(spark, d):
    m = table(spark, d, "sales_mart").select("site_code", "mnth_id", "daily_txns")
    return dml.keep_other_partitions(m, m.where("mnth_id = 202601").withColumn("daily_txns", F.lit(0)), "mnth_id", [202601, 202602])


@query("k14_replace_window", "SELECT site_code, data_dt, daily_txns FROM sales_mart WHERE data_dt NOT BETWEEN 20260110 AND 20260120 UNION ALL SELECT site_code, data_dt, 1 FROM sales_mart WHERE data_dt BETWEEN 20260110 AND 20260120")
def _(spark, d):
    m = table(spark, d, "sales_mart").select("site_code", "data_dt", "daily_txns")
    return dml.replace_window(m, m.withColumn("daily_txns", F.lit(1)), "data_dt", 20260110, 20260120)


# --- aggregates and windows ------------------------------------------------------------------------------------------


@query("a1_daily_mart", LINES + "SELECT l_returnflag, order_date, CAST(sum(amount) AS DECIMAL(28,4)) AS amount, CAST(count(l_linenumber) AS BIGINT) AS n_lines, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_orders FROM lines GROUP BY 1, 2")
def _(spark, d):
    return shaping.daily(lines(spark, d), ["l_returnflag", "order_date"], {"amount": "amount"}, {"n_lines": "l_linenumber"}, {"n_orders": "l_orderkey"})


@query("a2_bounds", "SELECT max(o_orderdate) AS last_order, min(o_orderdate) AS first_order FROM orders")
def _(spark, d):
    return table(spark, d, "orders").agg(F.max("o_orderdate").alias("last_order"), F.min("o_orderdate").alias("first_order"))


@query("a3_skew", """
    WITH p AS (SELECT site_code, count(*) AS n FROM sales GROUP BY 1)
    SELECT CAST(max(n) AS BIGINT) AS max_rows, avg(n) AS avg_rows, max(n) / avg(n) AS skew_ratio, coalesce(sum(n) FILTER (site_code IS NULL), 0) / sum(n) AS null_share, CASE WHEN max(n) / avg(n) > 3 THEN 'SKEWED' ELSE 'EVEN' END AS verdict FROM p""")
def _(spark, d):
    return table_profile.skew(table(spark, d, "sales"), ["site_code"])


@query("a4_salted_aggregate", "SELECT site_code, CAST(count(amount) AS BIGINT) AS count FROM sales GROUP BY 1")
def _(spark, d):
    return joins.salted_aggregate(table(spark, d, "sales").select("site_code", "amount", "transaction_id"), ["site_code"], "amount", "count")


@query("a5_volume", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT site_code) AS BIGINT) AS distinct_keys, CAST(count(DISTINCT mnth_id) AS BIGINT) AS periods, min(mnth_id) AS first_period, max(mnth_id) AS last_period FROM sales_mart")
def _(spark, d):
    return table_profile.volume(table(spark, d, "sales_mart"), "site_code", "mnth_id")


@query("a5_volume_estimate")
def _(spark, d):
    return table_profile.volume_estimate(table(spark, d, "sales_mart"), "site_code", "mnth_id")


@query("a6_distribution", "SELECT mnth_id, CAST(count(*) AS BIGINT) AS rows, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS share FROM sales_mart GROUP BY 1")
def _(spark, d):
    return table_profile.distribution(table(spark, d, "sales_mart"), "mnth_id").withColumn("share", F.col("share").cast("double"))


@query("a7_key_statistics", """
    WITH p AS (SELECT site_code, count(*) AS n FROM sales_mart GROUP BY 1)
    SELECT CAST(count(*) AS BIGINT) AS keys, avg(n) AS avg_rows, round(stddev_samp(n), 8) AS std_rows, CAST(min(n) AS BIGINT) AS min_rows, CAST(max(n) AS BIGINT) AS max_rows,
           CAST(quantile_disc(n, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(n, 0.9) AS DOUBLE) AS p90, CAST(quantile_disc(n, 0.95) AS DOUBLE) AS p95, CAST(quantile_disc(n, 0.99) AS DOUBLE) AS p99, round(stddev_samp(n) / avg(n), 8) AS cv FROM p""")
def _(spark, d):
    return table_profile.key_statistics(table(spark, d, "sales_mart"), ["site_code"]).withColumns({c: F.round(c, 8) for c in ("std_rows", "cv")})


@query("a8_duplicates", "WITH p AS (SELECT count(*) AS n FROM sales_mart GROUP BY site_code, product, data_dt) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS distinct_keys, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM p")
def _(spark, d):
    return table_profile.duplicates(table(spark, d, "sales_mart"), ["site_code", "product", "data_dt"])


@query("a9_null_shares", """
    WITH n AS (SELECT count(*) AS n, count(*) - count(customer_id) AS c, count(*) - count(name) AS na, count(*) - count(address) AS ad, count(*) - count(tier) AS ti FROM changes),
    l AS (SELECT n, unnest([{'k': 'customer_id', 'v': c}, {'k': 'name', 'v': na}, {'k': 'address', 'v': ad}, {'k': 'tier', 'v': ti}]) AS x FROM n)
    SELECT x.k AS column_name, CAST(x.v AS BIGINT) AS nulls, x.v * 100.0::DOUBLE / n AS null_pct, CASE WHEN x.v * 100.0 / n > 50 THEN 'CRITICAL' WHEN x.v * 100.0 / n > 10 THEN 'HIGH' ELSE 'OK' END AS severity FROM l""")
def _(spark, d):
    return table_profile.null_shares(table(spark, d, "changes").select("customer_id", "name", "address", "tier")).withColumn("null_pct", F.col("null_pct").cast("double"))


@query("a10_duplicate_keys", "SELECT transaction_id, CAST(count(*) AS BIGINT) AS rows FROM sales GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return table_profile.duplicate_keys(table(spark, d, "sales"), ["transaction_id"])


@query("a11_entity_features", "SELECT user_id, sum(CAST(value AS DECIMAL(18,6))) AS total, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(18,6)")).alias("total"), F.count(F.lit(1)).alias("n"))


@query("a12_row_bytes")
def _(spark, d):
    return table_profile.row_bytes(table(spark, d, "orders"))


@query("a14_months", "SELECT DISTINCT mnth_id FROM sales_mart WHERE mnth_id >= 202601")
def _(spark, d):
    from tarnwork.plans.runtime import months_to_process

    return months_to_process(table(spark, d, "sales_mart"), "mnth_id", 2, target=202603)


@query("a16_sum_once", "SELECT o_orderpriority, CAST(sum(p) AS DECIMAL(28,2)) AS total FROM (SELECT DISTINCT o_orderkey, o_orderpriority, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    j = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(o, "o_orderkey")
    return shaping.sum_once(j, ["o_orderkey"], ["o_orderpriority"], "p", "total")


@query("w1_dedup_latest", """
    SELECT site_code, product, data_dt, daily_amount, load_ts FROM sales_mart
    QUALIFY row_number() OVER (PARTITION BY site_code, product, data_dt ORDER BY load_ts DESC, daily_amount DESC NULLS LAST) = 1""")
def _(spark, d):
    m = table(spark, d, "sales_mart").select("site_code", "product", "data_dt", "daily_amount", "load_ts")
    return shaping.dedup_latest(m, ["site_code", "product", "data_dt"], [F.desc("load_ts"), F.desc_nulls_last("daily_amount")])


@query("w2_running_totals", EVENT_DAYS + """
    SELECT event_type, day, total, sum(total) OVER (PARTITION BY event_type, year(day), month(day) ORDER BY day ROWS UNBOUNDED PRECEDING) AS total_mtd,
           sum(total) OVER (PARTITION BY event_type, year(day) ORDER BY day ROWS UNBOUNDED PRECEDING) AS total_ytd FROM days""")
def _(spark, d):
    return periods.running_totals(event_days(spark, d).select("event_type", "day", "total"), ["total"], ["event_type"], "day", day_is_int=False)


@query("w3_rates", EVENT_DAYS + """
    , r AS (SELECT event_type, day, sum(events) OVER w AS e, sum(users) OVER w AS u FROM days WINDOW w AS (PARTITION BY event_type, year(day), month(day) ORDER BY day ROWS UNBOUNDED PRECEDING))
    SELECT event_type, day, CASE WHEN u <> 0 THEN CAST(e AS DOUBLE) / CAST(u AS DOUBLE) END AS events_per_user FROM r""")
def _(spark, d):
    r = periods.running_totals(event_days(spark, d), ["events", "users"], ["event_type"], "day", ("mtd",), day_is_int=False)
    return r.select("event_type", "day", periods.rate("events_mtd", "users_mtd").alias("events_per_user"))


@query("w4_week_to_date", EVENT_DAYS + "SELECT event_type, day, sum(total) OVER (PARTITION BY event_type, date_trunc('week', day) ORDER BY day ROWS UNBOUNDED PRECEDING) AS total_wtd FROM days")
def _(spark, d):
    return periods.running_totals(event_days(spark, d).select("event_type", "day", "total"), ["total"], ["event_type"], "day", ("wtd",), day_is_int=False).drop("total")


@query("w5_week_over_week", EVENT_DAYS + """
    SELECT a.event_type, a.day, a.events, b.events AS events_wow_prev, a.events - b.events AS events_wow_delta, CASE WHEN b.events <> 0 THEN (a.events - b.events) * 100.0::DOUBLE / b.events END AS events_wow_pct
    FROM days a LEFT JOIN days b ON a.event_type = b.event_type AND b.day = a.day - 7""")
def _(spark, d):
    c = periods.compare(event_days(spark, d).select("event_type", "day", "events"), "events", ["event_type"], "day", "wow")
    return c.withColumn("events_wow_pct", F.col("events_wow_pct").cast("double"))


@query("w5_month_over_month", EVENT_DAYS + """
    SELECT a.event_type, a.day, a.users, b.users AS users_mom_prev, a.users - b.users AS users_mom_delta, CASE WHEN b.users <> 0 THEN (a.users - b.users) * 100.0::DOUBLE / b.users END AS users_mom_pct
    FROM days a LEFT JOIN days b ON a.event_type = b.event_type AND b.day = a.day - INTERVAL 1 MONTH AND day(b.day) = day(a.day)""")
def _(spark, d):
    c = periods.compare(event_days(spark, d).select("event_type", "day", "users"), "users", ["event_type"], "day", "mom")
    return c.withColumn("users_mom_pct", F.col("users_mom_pct").cast("double"))


@query("w6_lags", "SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 7) OVER w AS value_lag_7, lag(value, 30) OVER w AS value_lag_30 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(spark, d):
    return features.lags(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], ["value"]).select("event_id", "value_lag_1", "value_lag_7", "value_lag_30")


@query("w7_rolling", """
    SELECT event_id, round(avg(value) OVER w, 6) AS value_avg_7, round(stddev_samp(value) OVER w, 4) AS value_std_7, round(stddev_samp(value) OVER w / nullif(avg(value) OVER w, 0), 4) AS value_cv_7
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 6 PRECEDING)""")
def _(spark, d):
    r = features.rolling(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], ["value"], (7,))
    return r.select("event_id", F.round("value_avg_7", 6).alias("value_avg_7"), F.round("value_std_7", 4).alias("value_std_7"), F.round("value_cv_7", 4).alias("value_cv_7"))


@query("w9_z_scores", """
    WITH z AS (SELECT event_id, round((value - avg(value) OVER w) / greatest(coalesce(stddev_samp(value) OVER w, 0), 1e-6), 4) AS z FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 6 PRECEDING))
    SELECT event_id, CASE WHEN z = 0 THEN 0::DOUBLE ELSE z END AS z_score FROM z""")
def _(spark, d):
    z = features.z_scores(table(spark, d, "events").select("event_id", "event_type", "ts", "value"), ["event_type"], ["ts", "event_id"], "value")
    return z.select("event_id", F.round("z_score", 4).alias("z_score"))


# --- top-k, paging, sets ---------------------------------------------------------------------------------------------


@query("l1_top_keys", "SELECT site_code, CAST(count(*) AS BIGINT) AS rows, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM sales) AS share FROM sales GROUP BY 1 ORDER BY rows DESC, site_code NULLS FIRST LIMIT 10")
def _(spark, d):
    return table_profile.top_keys(table(spark, d, "sales"), "site_code").withColumn("share", F.col("share").cast("double"))


@query("l2_latest_row", "SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders")
def _(spark, d):
    return table(spark, d, "orders").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("l4_page", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return serving.page(spark, "orders", {"orders"}, ["o_orderdate DESC", "o_orderkey"], 50, 100)


@query("u3_distinct", "SELECT DISTINCT product, ch_area FROM sales_mart")
def _(spark, d):
    return table(spark, d, "sales_mart").select("product", "ch_area").distinct()


@query("u4_except", "SELECT site_code FROM dim_site EXCEPT SELECT site_code FROM sales_mart")
def _(spark, d):
    return table(spark, d, "dim_site").select("site_code").subtract(table(spark, d, "sales_mart").select("site_code"))


# --- quality ---------------------------------------------------------------------------------------------------------


@query("q8_suite", """
    WITH n AS (SELECT count(*) AS n, count(*) FILTER (site_code IS NULL OR trim(site_code) = '') AS miss, count(*) FILTER (NOT coalesce(daily_amount >= 0, false)) AS neg FROM sales_mart),
    d AS (SELECT sum(c - 1) AS dup FROM (SELECT count(*) AS c FROM sales_mart GROUP BY site_code, product, data_dt))
    SELECT 'rows' AS check_name, 'row_count' AS kind, 'CRITICAL' AS severity, 'PASS' AS status, CAST(n AS DOUBLE) AS metric FROM n
    UNION ALL SELECT 'site_filled', 'completeness', 'CRITICAL', CASE WHEN miss = 0 THEN 'PASS' ELSE 'FAIL' END, miss / n FROM n
    UNION ALL SELECT 'not_negative', 'rule', 'WARNING', CASE WHEN neg = 0 THEN 'PASS' ELSE 'FAIL' END, neg FROM n
    UNION ALL SELECT 'unique', 'unique', 'CRITICAL', CASE WHEN dup = 0 THEN 'PASS' ELSE 'FAIL' END, CAST(dup AS DOUBLE) FROM d
    UNION ALL SELECT 'schema', 'schema', 'CRITICAL', 'FAIL', 1.0
    UNION ALL SELECT 'broken', 'rule', 'CRITICAL', 'ERROR', NULL""")
def _(spark, d):
    c, s = quality.Check, quality.Severity
    checks = [
        c("rows", "row_count", params={"min": 1}),
        c("site_filled", "completeness", params={"column": "site_code", "max": 0.0}),
        c("not_negative", "rule", s.WARNING, {"condition": "daily_amount >= 0"}),
        c("unique", "unique", params={"columns": ["site_code", "product", "data_dt"]}),
        c("schema", "schema", params={"columns": ["site_code", "absent"]}),
        c("broken", "rule", params={"condition": "no_such_column > 0"}),
    ]
    return quality.run_checks(table(spark, d, "sales_mart"), checks).select("check_name", "kind", "severity", "status", "metric")


# --- statistics ------------------------------------------------------------------------------------------------------


def halves(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select("ts", "value")
    mid = e.agg(F.timestamp_micros(F.floor((F.min(F.unix_micros(F.col("ts").cast("timestamp"))) + F.max(F.unix_micros(F.col("ts").cast("timestamp")))) / 2)).alias("mid"))
    j = e.crossJoin(F.broadcast(mid))
    return j.where(F.col("ts").cast("timestamp") < F.col("mid")).select("value"), j.where(F.col("ts").cast("timestamp") >= F.col("mid")).select("value")


_HALVES = """
    WITH m AS (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 AS mid FROM events),
    b AS (SELECT value AS v FROM events, m WHERE epoch_us(ts) < mid AND value IS NOT NULL), c AS (SELECT value AS v FROM events, m WHERE epoch_us(ts) >= mid AND value IS NOT NULL)
"""


@query("x1_psi", _HALVES + """
    , lim AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 10 AS w FROM b),
    bb AS (SELECT least(floor((v - lo) / w), 9) AS bin, count(*) AS n FROM b, lim GROUP BY 1),
    cb AS (SELECT least(floor((v - lo) / w), 9) AS bin, count(*) AS n FROM c, lim WHERE v BETWEEN lo AND hi GROUP BY 1),
    s AS (SELECT coalesce(bb.n, 0) / (SELECT count(*) FROM b) + 1e-6 AS p, coalesce(cb.n, 0) / (SELECT count(*) FROM c) + 1e-6 AS q FROM bb FULL JOIN cb USING (bin))
    SELECT round(sum((q - p) * ln(q / p)), 8) AS psi FROM s""")
def _(spark, d):
    return stats.psi(*halves(spark, d), "value").select(F.round("psi", 8).alias("psi"))


@query("x2_ks", _HALVES + """
    , u AS (SELECT v, sum(a) AS a, sum(z) AS z FROM (SELECT v, 1 AS a, 0 AS z FROM b UNION ALL SELECT v, 0, 1 FROM c) GROUP BY 1),
    k AS (SELECT abs(sum(a) OVER (ORDER BY v) / (SELECT count(*) FROM b) - sum(z) OVER (ORDER BY v) / (SELECT count(*) FROM c)) AS g FROM u)
    SELECT round(max(g), 8) AS d, CAST((SELECT count(*) FROM b) AS BIGINT) AS n1, CAST((SELECT count(*) FROM c) AS BIGINT) AS n2 FROM k""")
def _(spark, d):
    return stats.ks(*halves(spark, d), "value").withColumn("d", F.round("d", 8))


@query("x3_drift_report")
def _(spark, d):
    return stats.drift_report(*halves(spark, d), ["value"])


@query("x4_normalise", """
    WITH l AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
    SELECT event_id, round(greatest(0, least(1, CASE WHEN hi > lo THEN (hi - value) / (hi - lo) ELSE 0 END)), 8) AS norm_score FROM events JOIN l USING (event_type)""")
def _(spark, d):
    n = stats.normalise(table(spark, d, "events").select("event_id", "event_type", "value"), "value", ["event_type"])
    return n.select("event_id", F.round("norm_score", 8).alias("norm_score"))


@query("x6_severity", """
    WITH n AS (SELECT event_id, (max(value) OVER () - value) / (max(value) OVER () - min(value) OVER ()) AS s FROM events),
    v AS (SELECT event_id, s, CASE WHEN s >= 0.95 THEN 'CRITICAL' WHEN s >= 0.85 THEN 'HIGH' WHEN s >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS severity, s > 0.9 AS is_anomaly FROM n)
    SELECT event_id, severity, is_anomaly, CASE WHEN is_anomaly THEN CASE WHEN s >= (SELECT avg(s) FROM v WHERE is_anomaly) THEN 'HIGH' ELSE 'LOW' END END AS level FROM v""")
def _(spark, d):
    n = stats.severity(stats.normalise(table(spark, d, "events").select("event_id", "value"), "value"), "norm_score")
    return stats.two_levels(n, "is_anomaly", "norm_score").select("event_id", "severity", "is_anomaly", "level")


@query("x8_calendar", """
    SELECT o_orderkey, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS day_of_week, CAST(day(o_orderdate) AS INTEGER) AS day_of_month, CAST(month(o_orderdate) AS INTEGER) AS month,
           CAST(dayofweek(o_orderdate) IN (0, 6) AS INTEGER) AS is_weekend,
           CASE WHEN dayofweek(o_orderdate) = 6 THEN 0::DOUBLE ELSE round(sin((dayofweek(o_orderdate) + 1) * 2 * pi() / 7), 8) END AS dow_sin,
           CASE WHEN month(o_orderdate) IN (3, 9) THEN 0::DOUBLE ELSE round(cos(month(o_orderdate) * 2 * pi() / 12), 8) END AS month_cos FROM orders""")
def _(spark, d):
    c = features.calendar(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")
    return c.select("o_orderkey", "day_of_week", "day_of_month", "month", "is_weekend", F.round("dow_sin", 8).alias("dow_sin"), F.round("month_cos", 8).alias("month_cos"))


@query("x9_category_index", "SELECT p_brand, CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS INTEGER) AS p_brand_index FROM part GROUP BY 1")
def _(spark, d):
    return features.category_index(table(spark, d, "part"), "p_brand")


@query("x10_temporal_split", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) > (SELECT CAST(max(o_orderdate) AS DATE) - 90 FROM orders) THEN 'test' ELSE 'train' END AS split FROM orders")
def _(spark, d):
    return features.temporal_split(table(spark, d, "orders"), "o_orderdate", 90).select("o_orderkey", "split")


@query("x11_stratified_split")
def _(spark, d):
    return features.stratified_split(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"])


_PRED = "(SELECT l_extendedprice AS t, l_quantity * 1000.0 AS f FROM lineitem)"


def predictions(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1000.0).alias("f"))


@query("x12_forecast_metrics", f"SELECT round(avg(CASE WHEN t <> 0 THEN abs((t - f) / t) END) * 100, 6) AS mape, round(avg(2 * abs(f - t) / (abs(t) + abs(f) + 1e-8)) * 100, 6) AS smape, round(sqrt(avg((t - f) * (t - f))), 4) AS rmse FROM {_PRED}")
def _(spark, d):
    return stats.forecast_metrics(predictions(spark, d), "t", "f").select(F.round("mape", 6).alias("mape"), F.round("smape", 6).alias("smape"), F.round("rmse", 4).alias("rmse"))


@query("x13_regression_metrics", f"SELECT round(sqrt(avg((t - f) * (t - f))), 4) AS rmse, round(avg(abs(t - f)), 4) AS mae, round(1 - sum((t - f) * (t - f)) / (var_pop(t) * count(t)), 6) AS r2 FROM {_PRED}")
def _(spark, d):
    return stats.regression_metrics(predictions(spark, d), "t", "f").select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@query("x14_classification_metrics", """
    WITH x AS (SELECT l_returnflag AS t, CASE WHEN l_quantity < 20 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS p FROM lineitem),
    k AS (SELECT k, (SELECT count(*) FROM x WHERE t = k) AS truth, (SELECT count(*) FROM x WHERE p = k) AS said, (SELECT count(*) FROM x WHERE t = k AND p = k) AS hit FROM (SELECT DISTINCT t AS k FROM x UNION SELECT DISTINCT p FROM x)),
    m AS (SELECT truth, hit, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(truth, 0), 0) AS r FROM k)
    SELECT round(sum(hit) / sum(truth), 8) AS accuracy, round(sum(truth * p) / sum(truth), 8) AS precision, round(sum(truth * r) / sum(truth), 8) AS recall, round(sum(truth * coalesce(2 * p * r / nullif(p + r, 0), 0)) / sum(truth), 8) AS f1 FROM m""")
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("t"), F.when(F.col("l_quantity") < 20, "A").when(F.col("l_quantity") < 35, "N").otherwise("R").alias("p"))
    return stats.classification_metrics(x, "t", "p").select(*(F.round(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query("x14_roc_auc", """
    WITH x AS (SELECT (l_returnflag = 'R')::INT AS t, l_quantity AS s FROM lineitem), g AS (SELECT s, sum(t) AS a, count(*) - sum(t) AS b FROM x GROUP BY 1),
    c AS (SELECT a, b, sum(b) OVER (ORDER BY s) - b AS below FROM g)
    SELECT round(sum(a * (below + b / 2)) / (sum(a)::DOUBLE * sum(b)), 8) AS auc FROM c""")
def _(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("t"), F.col("l_quantity").alias("s"))
    return stats.roc_auc(x, "t", "s").select(F.round("auc", 8).alias("auc"))


@query("x5_two_levels", """
    WITH z AS (SELECT event_id, value AS s, value > (SELECT avg(value) FROM events) AS a FROM events)
    SELECT event_id, CASE WHEN a THEN CASE WHEN s >= (SELECT avg(s) FROM z WHERE a) THEN 'HIGH' ELSE 'LOW' END END AS level FROM z""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    z = e.crossJoin(F.broadcast(e.agg(F.avg("value").alias("m")))).withColumn("a", F.col("value") > F.col("m"))
    return stats.two_levels(z, "a", "value").select("event_id", "level")


@query("x7_z_score_anomalies", """
    WITH z AS (SELECT event_id, abs((value - avg(value) OVER w) / greatest(coalesce(stddev_samp(value) OVER w, 0), 1e-6)) AS z FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 29 PRECEDING))
    SELECT event_id, round(z, 4) AS z FROM z WHERE z > 2.5""")
def _(spark, d):
    z = features.z_scores(table(spark, d, "events").select("event_id", "event_type", "ts", "value"), ["event_type"], ["ts", "event_id"], "value", 30)
    return z.withColumn("z", F.abs("z_score")).where("z > 2.5").select("event_id", F.round("z", 4).alias("z"))


def segment_errors(spark, d) -> DataFrame:
    """A model per order priority: mean price of the others as forecast."""
    o = table(spark, d, "orders").select("o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("p"))
    return o.groupBy(F.col("o_orderpriority").alias("model")).agg(F.round(F.stddev_pop("p"), 4).alias("rmse"))


@query("l7_leaderboard", "WITH m AS (SELECT o_orderpriority AS model, round(stddev_pop(o_totalprice), 4) AS rmse FROM orders GROUP BY 1) SELECT model, rmse, CAST(row_number() OVER (ORDER BY rmse, model) AS INTEGER) AS rank FROM m")
def _(spark, d):
    return stats.leaderboard(segment_errors(spark, d), "rmse")


@query("l8_best_run", "WITH m AS (SELECT o_orderpriority AS model, round(stddev_pop(o_totalprice), 4) AS rmse FROM orders GROUP BY 1) SELECT arg_min(model, rmse) AS model, min(rmse) AS rmse FROM m")
def _(spark, d):
    return stats.best(segment_errors(spark, d), "rmse", "model", ascending=True)


@query("q10_feature_suite", """
    WITH f AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1)
    SELECT unnest(['rows', 'o_custkey_filled', 'unique', 'fresh', 'schema', 'n_orders_filled']) AS check_name, 'PASS' AS status""")
def _(spark, d):
    f = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderdate").alias("last"))
    return quality.run_checks(f, quality.feature_suite(["o_custkey"], ["n_orders"], "last")).select("check_name", "status")


@query("a15_union_groups", """
    WITH p AS (SELECT 'fact' AS g, count(*) AS n FROM sales UNION ALL SELECT 'fact', count(*) FROM sales_mart UNION ALL SELECT 'dim', count(*) FROM dim_customer)
    SELECT g AS union_group, CAST(count(*) AS BIGINT) AS sources, CAST(sum(n) AS DOUBLE) / 1000 AS size_gb, CAST(sum(n) AS BIGINT) AS rows, 1.5::DOUBLE AS skew_ratio FROM p GROUP BY 1""")
def _(spark, d):
    one = lambda t, g: table(spark, d, t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(g).alias("union_group"), (F.col("rows") / 1000).alias("size_gb"), "rows", F.lit(1.5).cast("double").alias("skew_ratio"))
    return table_profile.union_groups(scan.union_sources([one("sales", "fact"), one("sales_mart", "fact"), one("dim_customer", "dim")]))


# --- serving and streams ---------------------------------------------------------------------------------------------


@query("r2_safe_select", "WITH t AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) SELECT r_name, CAST(n AS BIGINT) AS n FROM region JOIN t ON r_regionkey = n_regionkey")
def _(spark, d):
    for t in ("nation", "region"):
        table(spark, d, t).createOrReplaceTempView(t)
    return serving.safe_select(spark, "WITH t AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) SELECT r_name, n FROM region JOIN t ON r_regionkey = n_regionkey", {"nation", "region"})


@query("r1_table_stats", "SELECT CAST(count(*) AS BIGINT) AS rows, min(data_dt) AS first_period, max(data_dt) AS last_period FROM sales_mart")
def _(spark, d):
    table(spark, d, "sales_mart").createOrReplaceTempView("sales_mart")
    return serving.table_stats(spark, "sales_mart", "data_dt")


def drained(spark: SparkSession, df: DataFrame) -> DataFrame:
    """What a stream writes until its source is drained."""
    at = new_dir(spark, "drain")
    streams.append(df, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def event_stream(spark, d) -> DataFrame:
    return streams.file_stream(spark, d, table(spark, d, "events").schema, glob="events.parquet")


@query("t2_drain", "SELECT event_id, event_type, value FROM events")
def _(spark, d):
    return drained(spark, event_stream(spark, d).select("event_id", "event_type", "value"))


@query("t8_tumbling_windows", "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    e = event_stream(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    w = streams.tumbling(e, "ts", "1 day", "0 seconds", ["event_type"], [F.count(F.lit(1)).alias("n")])
    at = new_dir(spark, "windows")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    q = w.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(w.schema).parquet(f"{at}/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("t7_distinct_stream", "SELECT DISTINCT event_id FROM events")
def _(spark, d):
    return drained(spark, streams.dedup(event_stream(spark, d).select("event_id", F.col("ts").cast("timestamp").alias("ts")), ["event_id"], "ts", "1 day").select("event_id"))
