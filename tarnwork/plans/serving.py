"""Read-only SQL serving: table listing, pages, statistics, and guarded SELECTs, all checked on Spark's own parse tree."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS = 10_000


class UnsafeQueryError(ValueError):
    pass


#: Nodes of Spark's parse trees that an ad-hoc query may hold. Whatever is not listed (commands, inserts, DDL,
#: time travel, IDENTIFIER clauses, transforms) is refused.
_NODES = frozenset(
    "Project Filter Aggregate Join LateralJoin AsOfJoin Sort GlobalLimit LocalLimit Offset Distinct SubqueryAlias UnresolvedSubqueryColumnAliases "
    "UnresolvedWith UnresolvedRelation UnresolvedInlineTable ResolvedInlineTable LocalRelation OneRowRelation Union Intersect Except "
    "UnresolvedHaving WithWindowDefinition Window Generate Pivot Unpivot Sample Expand UnresolvedHint UnresolvedTableValuedFunction UnresolvedOrdinal".split()
)
#: Table functions that read nothing.
_TABLE_FUNCTIONS = frozenset({"range", "explode"})
#: Functions that reach beyond the tables.
_FUNCTIONS = frozenset({"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "read_files"})
_SUBQUERIES = frozenset({"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"})
_ORDER = re.compile(r"\s+(ASC|DESC)(?=\s+NULLS\s|\s*\Z)|\s+NULLS\s+(FIRST|LAST)\s*\Z", re.IGNORECASE)


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _kind(x) -> str:
    return x.getClass().getSimpleName().rstrip("$")


class _Guard:
    """Walks a parsed plan with the names of the common table expressions that are visible at each place."""

    def __init__(self, spark: SparkSession, sub_queries: bool = True):
        self.same = (lambda x: x) if spark.conf.get("spark.sql.caseSensitive") == "true" else str.lower
        self.sub_queries = sub_queries
        self.tables: set[str] = set()

    def plan(self, p, visible: frozenset[str] = frozenset()) -> None:
        kind = _kind(p)
        if kind not in _NODES:
            raise UnsafeQueryError(f"only SELECT over tables is served, not {kind}")
        if kind == "UnresolvedTableValuedFunction" and p.name().mkString(".").lower() not in _TABLE_FUNCTIONS:
            raise UnsafeQueryError("table functions are not served")
        if kind == "UnresolvedRelation":
            parts = [self.same(x) for x in _seq(p.multipartIdentifier())]
            if len(parts) > 1 or parts[0] not in visible:
                self.tables.add(".".join(parts))
        if kind == "UnresolvedWith":
            if p.allowRecursion():
                raise UnsafeQueryError("recursive queries are not served")
            for c in _seq(p.cteRelations()):  # each sees those before it, not itself
                self.plan(c._2(), visible)
                visible = visible | {self.same(c._1())}
        for c in _seq(p.children()):
            self.plan(c, visible)
        for e in _seq(p.expressions()):
            self.expression(e, visible)

    def expression(self, e, visible: frozenset[str] = frozenset()) -> None:
        kind = _kind(e)
        if kind == "UnresolvedFunction" and e.nameParts().mkString(".").lower() in _FUNCTIONS:
            raise UnsafeQueryError(f"function {e.nameParts().mkString('.')} is not served")
        if kind in _SUBQUERIES:
            if not self.sub_queries:
                raise UnsafeQueryError("no sub-query is served here")
            self.plan(e.plan(), visible)
        elif ("Subquery" in kind and kind != "InSubquery") or "UnresolvedIdentifier" in kind:
            raise UnsafeQueryError(f"{kind} is not served")
        for c in _seq(e.children()):
            self.expression(c, visible)


def _parse(spark: SparkSession, text: str, how: str):
    try:
        return getattr(spark._jsparkSession.sessionState().sqlParser(), how)(text)
    except Exception as e:
        raise UnsafeQueryError(f"not one {'statement' if how == 'parsePlan' else 'expression'}: {str(e).splitlines()[0][:200]}") from None


def safe_select(spark: SparkSession, sql: str, allowed: set[str], limit: int = 1000) -> DataFrame:
    """Run one SELECT over allowed tables; never more than ``limit`` (at most 10,000) rows come back. Statements, other tables,
    several statements and path tables are refused before anything is resolved. The name of a common table expression stands
    for it only where Spark would take it so: behind its definition and within the query it belongs to."""
    guard = _Guard(spark)
    guard.plan(_parse(spark, sql, "parsePlan"))
    other = guard.tables - {guard.same(a) for a in allowed}
    if other:
        raise UnsafeQueryError(f"tables not served: {', '.join(sorted(other))}")
    return spark.sql(sql).limit(min(max(limit, 1), MAX_ROWS))


def _served(spark: SparkSession, text: str) -> Column:
    """``text`` as one expression of its own, which cannot leave its place in the query; it may hold no sub-query."""
    _Guard(spark, sub_queries=False).expression(_parse(spark, text, "parseExpression"))
    return F.expr(text)


def _order(spark: SparkSession, item: str) -> Column:
    marks = {g.upper() for m in _ORDER.finditer(item) for g in m.groups() if g}
    c = _served(spark, _ORDER.sub("", item))
    if "DESC" in marks:
        return c.desc_nulls_first() if "FIRST" in marks else c.desc_nulls_last()
    return c.asc_nulls_last() if "LAST" in marks else c.asc_nulls_first()


def page(spark: SparkSession, table: str, allowed: set[str], order: list[str], limit: int = 100, offset: int = 0, where: str | None = None) -> DataFrame:
    """A page of a table in a total order (mandatory: pages of an unordered table are not stable). ``where`` and the items of
    ``order`` (an expression, ASC or DESC, NULLS FIRST or LAST) are parsed each on its own and may hold no sub-query."""
    if not 1 <= limit <= MAX_ROWS or offset < 0:
        raise UnsafeQueryError("limit is 1 to 10000, offset not negative")
    if not order:
        raise UnsafeQueryError("a page needs an order")
    if table.lower() not in {a.lower() for a in allowed}:
        raise UnsafeQueryError(f"table not served: {table}")
    by = [_order(spark, o) for o in order]
    df = spark.table(table)
    if where:
        df = df.where(_served(spark, where))
    return df.orderBy(*by).offset(offset).limit(limit)


def list_tables(spark: SparkSession, allowed: set[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in sorted(allowed)], "table_name string")


def table_schema(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(spark.table(table).schema)], "position int, column_name string, type string, nullable boolean")


def table_stats(spark: SparkSession, table: str, period: str | None = None) -> DataFrame:
    """rows, and the bounds of a period column."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if period:
        aggs += [F.min(period).alias("first_period"), F.max(period).alias("last_period")]
    return spark.table(table).agg(*aggs)
