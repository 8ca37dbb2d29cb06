"""Problem 9: documents mixed to the target shares of mix_targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm.mixing import mix_sources, source_quotas, tokenized
from tarnwork.llm.tokens import VOCABULARY
from tarnwork.sources.tables import table


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(tokenized(table(spark, sf_dir, "documents"), VOCABULARY), table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


CHARS = 4096


def p9_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The apportionment alone, with code points in place of tokens, so that SQL can follow it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").alias("n_tokens"))
    rows = source_quotas(docs, table(spark, sf_dir, "mix_targets"), block_tokens=CHARS)
    return spark.createDataFrame([(s, c, a, b * CHARS) for s, _, c, a, b in rows], "source string, max_repeats int, available long, quota long")


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p9_quotas": p9_quotas}
#: Token counts have no SQL; tests hold the mixture against its targets and the apportionment against brute force.
ORACLE: dict[str, str] = {
    "p9_quotas": f"""
    WITH t AS (
      SELECT m.source, coalesce(target_share, 0) AS w, coalesce(max_repeats, 1) AS c, CAST(coalesce(sum(n_chars) FILTER (n_chars > 0), 0) AS BIGINT) AS a
      FROM mix_targets m LEFT JOIN documents d ON d.source = m.source WHERE m.source IS NOT NULL GROUP BY ALL),
    q AS (
      SELECT source, w / (2 * k + 1) AS quotient FROM t, LATERAL (SELECT unnest(generate_series(0, CAST(ceil(a * c / {CHARS}.0) AS BIGINT) - 1)) AS k) WHERE a > 0 AND w > 0 AND c > 0),
    r AS (SELECT source FROM q QUALIFY row_number() OVER (ORDER BY quotient DESC, source) <= (SELECT sum(a) // {CHARS} FROM t))
    SELECT source, CAST(c AS INTEGER) AS max_repeats, a AS available, CAST({CHARS} * (SELECT count(*) FROM r WHERE r.source = t.source) AS BIGINT) AS quota FROM t"""
}
