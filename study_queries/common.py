"""What the queries share: tables, a swept table, and the SQL for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe import Plot, SeriesQuery, Space
from sweepframe.operators.context import contexts
from sweepframe.operators.sweep import sweep

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


FLAGS, STATUSES, YEARS = ["A", "N", "R"], ["F", "O"], [1995, 1996, 1997, 1998, 1999, 2000, 2001]
CELLS = Space({"flag": FLAGS, "status": STATUSES, "year": YEARS})
RAGGED = "flag <> 'N' OR year < 2000"


def cells(spark: SparkSession, sf: str, where: str | None = RAGGED) -> DataFrame:
    """``lineitem`` swept over return flag, line status and ship year."""
    grid = contexts(spark, CELLS, conditions=where)
    table = load(spark, sf, "lineitem")
    on = [("l_returnflag", "=", "flag"), ("l_linestatus", "=", "status"), ("year(l_shipdate)", "=", "year")]
    aggs = {"n": ("count", None), "qty": ("sum", "l_quantity"), "disc": ("mean", "l_discount")}
    return sweep(grid, table, on, aggs, CELLS.full_size())


def list_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with a list: the quantity sums by line number."""
    table = load(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate").cast("long"))
    sums = table.groupBy("l_returnflag", "l_linestatus", "year", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    lists = sums.groupBy(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "year"
    ).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "q"))).alias("s"))
    grid = contexts(spark, CELLS)
    joined = grid.join(lists, ["flag", "status", "year"])
    return joined.select(
        "g_index", "flag", "status", "year", F.col("s.q").alias("qs"), F.col("s.l_linenumber").alias("ns")
    )


def series(table: DataFrame, yaxis="qty", axes=None, **options) -> SeriesQuery:
    return SeriesQuery(Plot(options.pop("filename", "plot"), yaxis, axes or {}, **options), CELLS, table)


def values(name: str, items) -> str:
    """A one-column SQL relation ``name(v, i)`` of literals with their positions."""
    rows = ", ".join(f"({'%r' % v}, {i})" for i, v in enumerate(items))
    return f"(VALUES {rows}) AS {name}(v, i)"


AXES_SQL = f"""axes AS (
    SELECT f.v AS flag, s.v AS status, CAST(y.v AS BIGINT) AS year, f.i * 14 + s.i * 7 + y.i AS ordinal
    FROM {values("f", FLAGS)}, {values("s", STATUSES)}, {values("y", YEARS)}
)"""


def cells_sql(where: str | None = RAGGED) -> str:
    """``WITH`` clause giving ``cells``, the same table as :func:`cells`."""
    return f"""WITH {AXES_SQL},
grid AS (
    SELECT CAST(row_number() OVER (ORDER BY ordinal) - 1 AS BIGINT) AS g_index, flag, status, year
    FROM axes WHERE {where or 'true'}
),
cells AS (
    SELECT g.g_index, g.flag, g.status, g.year, count(l.l_orderkey) AS n, sum(l.l_quantity) AS qty,
           avg(l.l_discount) AS disc
    FROM grid g LEFT JOIN lineitem l
      ON l.l_returnflag = g.flag AND l.l_linestatus = g.status AND year(l.l_shipdate) = g.year
    GROUP BY ALL
)"""


LIST_CELLS_SQL = f"""WITH {AXES_SQL},
sums AS (
    SELECT l_returnflag AS flag, l_linestatus AS status, CAST(year(l_shipdate) AS BIGINT) AS year,
           l_linenumber AS num, sum(l_quantity) AS q
    FROM lineitem GROUP BY ALL
),
list_cells AS (
    SELECT a.ordinal AS g_index, a.flag, a.status, a.year, s.num, s.q,
           row_number() OVER (PARTITION BY a.ordinal ORDER BY s.num) AS place
    FROM axes a JOIN sums s USING (flag, status, year)
)"""
