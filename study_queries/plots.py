"""Series queries over swept tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweepframe import Plot, SeriesQuery, Space, Study
from sweepframe.operators.context import contexts
from sweepframe.operators.sweep import sweep
from sweepframe.plans.series import all_points
from sweepframe.session import fresh_path

from .common import CELLS, LIST_CELLS_SQL, RAGGED, Registry, cells, cells_sql, list_cells, load, series, values

registry = Registry()
add = registry.add

LINE = {"flag": "category", "status": "category", "year": "variate"}


def numbered(keys: str, order: str, source: str = "cells", y: str = "qty", digits: int = 4) -> str:
    """SQL for the points of one y column of a relation."""
    over = f"OVER ({f'PARTITION BY {keys} ' if keys else ''}ORDER BY {order})"
    return f"""SELECT {keys + ', ' if keys else ''}'{y}' AS yaxis, row_number() {over} AS pos, row_number() {over} AS x,
        round({y}, {digits}) AS y FROM {source}"""


def rounded(points, digits=4):
    return points.withColumn("y", F.round("y", digits))


@add("P1_fixed", cells_sql() + numbered("flag", "g_index"))
def fixed(spark, sf):
    return rounded(series(cells(spark, sf), "qty", {"flag": "fixed", "status": "variate", "year": "variate"}).points())


@add("P2_category", cells_sql() + numbered("flag, status", "g_index"))
def category(spark, sf):
    return rounded(series(cells(spark, sf), "qty", {**LINE, "flag": "fixed"}).points())


GAP = "NOT (flag = 'N' AND status = 'O')"


@add("P3_complete_series", cells_sql(GAP) + f"""
SELECT CAST(0 AS BIGINT) AS plot_no, CAST(f.i * 2 + s.i AS BIGINT) AS series_no, f.v AS flag, s.v AS status, 'qty' AS yaxis,
       'flag=''' || f.v || ''', status=''' || s.v || ''' (qty)' AS legend, count(c.g_index) AS n_points
FROM {values("f", ["A", "N", "R"])} CROSS JOIN {values("s", ["F", "O"])}
LEFT JOIN cells c ON c.flag = f.v AND c.status = s.v GROUP BY ALL""")
def complete(spark, sf):
    return series(cells(spark, sf, GAP), "qty", LINE).series_sizes()


HOLES = "CASE WHEN status = 'F' AND year % 2 = 0 THEN NULL ELSE qty END"


@add("P4_ignore", cells_sql() + f"""
, c AS (SELECT flag, year, any_value({HOLES} ORDER BY g_index) AS qty FROM cells GROUP BY flag, year)""" + numbered("flag", "year", "c"))
def ignore(spark, sf):
    table = cells(spark, sf).withColumn("qty", F.expr(HOLES))
    return rounded(series(table, "qty", {"flag": "category", "year": "variate"}).points())


@add("P5_ignore_with_value", cells_sql() + """
SELECT flag, count(*) AS n, 'status O in 1995' AS title FROM cells GROUP BY flag""")
def ignore_value(spark, sf):
    query = series(
        cells(spark, sf), "qty", {"flag": "fixed", "year": "variate", "status": ("ignore", "O")}, title="status ${status} in ${year}"
    )
    return query.points().groupBy("flag").agg(F.count(F.lit(1)).alias("n")).join(query.plots(), "flag").select("flag", "n", "title")


@add("P6_mean", cells_sql() + """
, c AS (SELECT flag, year, avg(qty) AS qty FROM cells GROUP BY flag, year)""" + numbered("flag", "year", "c"))
def mean(spark, sf):
    return rounded(series(cells(spark, sf), "qty", {"flag": "category", "year": "variate", "status": "mean"}).points())


@add("P6_mean_of_lists", LIST_CELLS_SQL + """
, c AS (SELECT flag, num, avg(q) AS y, row_number() OVER (PARTITION BY flag ORDER BY num) AS pos
        FROM (SELECT flag, year, num, avg(q) AS q FROM list_cells GROUP BY ALL) GROUP BY flag, num)
SELECT flag, 'qs' AS yaxis, pos, pos AS x, round(y, 4) AS y FROM c""")
def mean_of_lists(spark, sf):
    return rounded(series(list_cells(spark, sf), "qs", {"flag": "category", "year": "mean", "status": "mean"}).points())


TRIANGLE = Space({"line": list(range(1, 8)), "k": [4, 3, 2, 1, 0], "status": ["F", "O"]})
TRIANGLE_WHERE = "line + k < 9 AND NOT (status = 'F' AND line = 2)"
TRIANGLE_SQL = f"""WITH points AS (
    SELECT CAST(row_number() OVER (ORDER BY n.i, k.i, s.i) - 1 AS BIGINT) AS g_index, n.v AS line, k.v AS k, s.v AS status
    FROM {values("n", range(1, 8))}, {values("k", [4, 3, 2, 1, 0])}, {values("s", ["F", "O"])}
    WHERE n.v + k.v < 9 AND NOT (s.v = 'F' AND n.v = 2)
), cells AS (
    SELECT g_index, line, k, status, sum(l_quantity) AS qty, count(l_orderkey) AS n FROM points
    LEFT JOIN lineitem ON l_linenumber = line AND CAST(l_quantity AS BIGINT) % 5 = k AND l_linestatus = status GROUP BY ALL
)"""


def triangle(spark, sf):
    grid = contexts(spark, TRIANGLE, conditions=TRIANGLE_WHERE)
    on = [("l_linenumber", "=", "line"), ("cast(l_quantity as bigint) % 5", "=", "k"), ("l_linestatus", "=", "status")]
    aggs = {"qty": ("sum", "l_quantity"), "n": ("count", None)}
    return sweep(grid, load(spark, sf, "lineitem"), on, aggs, TRIANGLE.full_size())


@add("P7_ignore_then_means", TRIANGLE_SQL + """
, a AS (SELECT line, k, any_value(status ORDER BY g_index) AS status, any_value(qty ORDER BY g_index) AS qty FROM cells GROUP BY line, k),
b AS (SELECT avg(line) AS line, k, status, avg(qty) AS qty FROM a GROUP BY k, status),
c AS (SELECT line, avg(k) AS k, status, avg(qty) AS qty FROM b GROUP BY line, status)""" + numbered("", "line, status", "c"))
def chain(spark, sf):
    plot = Plot("chain", "qty", {"line": "mean", "k": "mean"})
    return rounded(SeriesQuery(plot, TRIANGLE, triangle(spark, sf)).points())


@add("P7_pooled_mean", TRIANGLE_SQL + """
, a AS (SELECT line, k, any_value(qty ORDER BY g_index) AS qty FROM cells GROUP BY line, k)
SELECT 'qty' AS yaxis, i.s AS pos, i.s AS x, m.y FROM (SELECT status, round(avg(qty), 4) AS y, row_number() OVER (ORDER BY status) AS s
FROM (SELECT line, k, any_value(status ORDER BY g_index) AS status, any_value(qty ORDER BY g_index) AS qty FROM cells GROUP BY line, k)
GROUP BY status) m, LATERAL (SELECT m.s AS s) i""")
def pooled(spark, sf):
    plot = Plot("pooled", "qty", {"line": "mean", "k": "mean"}, pooled=True)
    return rounded(SeriesQuery(plot, TRIANGLE, triangle(spark, sf)).points())


@add("P7_several_ignores", cells_sql() + """
, o AS (SELECT status, year, arg_min(qty, g_index) FILTER (qty IS NOT NULL) AS qty FROM cells GROUP BY status, year),
t AS (SELECT year, arg_min(qty, status) FILTER (qty IS NOT NULL) AS qty FROM o GROUP BY year) """ + numbered("", "year", "t"))
def several_ignores(spark, sf):
    return rounded(series(cells(spark, sf).repartition(7, "n"), "qty", {"year": "variate"}).points())


@add("P8_variate", TRIANGLE_SQL + numbered("", "g_index"))
def variate(spark, sf):
    plot = Plot("scatter", "qty", dict.fromkeys(TRIANGLE, "variate"))
    return rounded(SeriesQuery(plot, TRIANGLE, triangle(spark, sf)).points())


@add("P9_x_axis", cells_sql() + """
SELECT flag, 'qty' AS yaxis, row_number() OVER (PARTITION BY flag ORDER BY year) AS pos, round(avg(disc), 6) AS x, round(avg(qty), 4) AS y
FROM cells GROUP BY flag, year""")
def x_axis(spark, sf):
    query = series(cells(spark, sf), "qty", {"flag": "category", "status": "mean", "year": "variate"}, xaxis="disc")
    return rounded(query.points()).withColumn("x", F.round("x", 6))


@add("P10_list_axes", LIST_CELLS_SQL + """
SELECT flag, status, year, 'qs' AS yaxis, place AS pos, num AS x, q AS y FROM list_cells""")
def list_axes(spark, sf):
    return series(list_cells(spark, sf), "qs", dict.fromkeys(LINE, "category"), xaxis="ns").points()


@add("P10_lists_in_sequence", LIST_CELLS_SQL + """
SELECT flag, 'qs' AS yaxis, row_number() OVER w AS pos, row_number() OVER w AS x, q AS y FROM list_cells
WINDOW w AS (PARTITION BY flag ORDER BY g_index, place)""")
def lists_in_sequence(spark, sf):
    return series(list_cells(spark, sf), "qs", {"flag": "category", "status": "variate", "year": "variate"}).points()


@add("P11_several_y", cells_sql() + " UNION ALL ".join(numbered("flag, status", "g_index", y=y) for y in ("qty", "n", "disc")))
def several_y(spark, sf):
    return rounded(series(cells(spark, sf), ["qty", "n", "disc"], LINE).points())


UNSORTED = Space({"year": [2001, 1995, 1998, 1996, 2000, 1997, 1999], "flag": ["R", "A", "N"], "status": ["O", "F"]})


@add("P12_point_order", f"""
WITH c AS (SELECT y.v AS year, f.v AS flag, s.v AS status, sum(l_quantity) AS qty
FROM {values("y", UNSORTED["year"])} CROSS JOIN {values("f", UNSORTED["flag"])} CROSS JOIN {values("s", UNSORTED["status"])}
LEFT JOIN lineitem ON year(l_shipdate) = y.v AND l_returnflag = f.v AND l_linestatus = s.v GROUP BY ALL),
cells AS (SELECT year, flag, avg(qty) AS qty FROM c GROUP BY year, flag) """ + numbered("", "year, flag"))
def point_order(spark, sf):
    on = [("year(l_shipdate)", "=", "year"), ("l_returnflag", "=", "flag"), ("l_linestatus", "=", "status")]
    table = sweep(contexts(spark, UNSORTED), load(spark, sf, "lineitem"), on, {"qty": ("sum", "l_quantity")}, 42)
    plot = Plot("order", "qty", {"year": "variate", "flag": "variate", "status": "mean"})
    return rounded(SeriesQuery(plot, UNSORTED, table).points())


@add("P13_kind", cells_sql() + """
SELECT kind, CAST(points AS BIGINT) AS points FROM (
    SELECT 'line' AS kind, count(*) AS points FROM cells UNION ALL SELECT 'scatter', count(*) FROM cells)""")
def kind(spark, sf):
    table = cells(spark, sf)
    forced = series(table, "qty", LINE, kind="scatter")
    free = series(table, "qty", dict.fromkeys(LINE, "variate"), kind="line")
    counted = [q.points().agg(F.count(F.lit(1)).alias("points")).select(F.lit(q.kind).alias("kind"), "points") for q in (forced, free)]
    return counted[0].unionByName(counted[1])


@add("P14_legend", cells_sql() + """
SELECT CAST(0 AS BIGINT) AS plot_no, flag, yaxis, CAST(dense_rank() OVER (ORDER BY flag) * 2 - CASE yaxis WHEN 'qty' THEN 2 ELSE 1 END AS BIGINT) AS series_no,
       flag || ' of 1995: ' || yaxis AS legend, n_points FROM (
    SELECT flag, yaxis, count(*) AS n_points FROM cells, (VALUES ('qty'), ('n')) y(yaxis) GROUP BY ALL)""")
def legend(spark, sf):
    query = series(cells(spark, sf), ["qty", "n"], {"flag": "category", "status": "variate", "year": "variate"}, legend="${flag} of ${year}: ${yaxis}")
    return query.series_sizes()


@add("P15_titles", cells_sql() + """
SELECT CAST(dense_rank() OVER (ORDER BY flag) - 1 AS BIGINT) AS plot_no, flag, 'plot-' || flag AS filename, flag || ' up to ' || 'O' AS title,
       'year' AS xlabel, CAST(NULL AS VARCHAR) AS ylabel, 'line' AS kind, 'linear' AS xmode, 'log' AS ymode, false AS grid, count(*) AS points
FROM cells GROUP BY flag""")
def titles(spark, sf):
    query = series(
        cells(spark, sf), "qty", {**LINE, "flag": "fixed"}, filename="plot-${flag}", title="${flag} up to ${status}",
        xlabel="year", ymode="log", grid=False,
    )
    points = query.points().groupBy("flag").agg(F.count(F.lit(1)).alias("points"))
    return query.plots().join(points, "flag")


@add("P16_all_plots", cells_sql() + """
, a AS (SELECT flag, year, avg(qty) AS qty FROM cells GROUP BY flag, year)
SELECT 0 AS plot, '{"flag":"' || flag || '"}' AS series, 'qty' AS yaxis, row_number() OVER (PARTITION BY flag ORDER BY year) AS pos,
       row_number() OVER (PARTITION BY flag ORDER BY year) AS x, round(qty, 4) AS y FROM a
UNION ALL SELECT 1, '{}', 'n', row_number() OVER (ORDER BY g_index), row_number() OVER (ORDER BY g_index), n FROM cells""")
def all_plots(spark, sf):
    table = cells(spark, sf)
    queries = [
        series(table, "qty", {"flag": "category", "status": "mean", "year": "variate"}),
        series(table, "n", dict.fromkeys(LINE, "variate")),
    ]
    return rounded(all_points(queries)).withColumn("x", F.col("x").cast("long"))


@add("S11_wide_csv", cells_sql() + """
, p AS (SELECT flag, year, avg(qty) AS y, row_number() OVER (PARTITION BY flag ORDER BY year) AS pos FROM cells GROUP BY flag, year)
SELECT pos, max(pos) FILTER (flag = 'A') AS "A (x-axis)", round(max(y) FILTER (flag = 'A'), 4) AS "A",
       max(pos) FILTER (flag = 'N') AS "N (x-axis)", round(max(y) FILTER (flag = 'N'), 4) AS "N",
       max(pos) FILTER (flag = 'R') AS "R (x-axis)", round(max(y) FILTER (flag = 'R'), 4) AS "R"
FROM p GROUP BY pos""")
def wide(spark, sf):
    query = series(cells(spark, sf), "qty", {"flag": "category", "status": "mean", "year": "variate"}, legend="${flag}")
    found = query.wide()
    return found.withColumns({name: F.round(name, 4) for name in ("A", "N", "R")})


@add("S11_written_plots", cells_sql() + """
, p AS (SELECT flag, status, year, qty AS y, row_number() OVER (PARTITION BY flag, status ORDER BY year) AS pos FROM cells)
SELECT 'qty-' || flag AS plot, max(pos) FILTER (status = 'F') AS xf, round(max(y) FILTER (status = 'F'), 4) AS f,
       max(pos) FILTER (status = 'O') AS xo, round(max(y) FILTER (status = 'O'), 4) AS o FROM p GROUP BY flag, pos""")
def written_plots(spark, sf):
    plot = Plot("qty-${flag}", "qty", {**LINE, "flag": "fixed"}, legend="${status}")
    study = Study(spark, dict(CELLS), where=RAGGED, plots=[plot], root=fresh_path(spark, "study"), sourcedir="/")
    on = [("l_returnflag", "=", "flag"), ("l_linestatus", "=", "status"), ("year(l_shipdate)", "=", "year")]
    study.run_sweep(load(spark, sf, "lineitem"), on, {"qty": ("sum", "l_quantity")})
    study.collect()
    files = study.write_plots(fresh_path(spark, "plots"))
    read = spark.read.schema("xf long, f double, xo long, o double").option("header", True).csv(files)
    name = F.regexp_extract(F.input_file_name(), "(qty-.)[.]csv", 1)
    return read.select(name.alias("plot"), "xf", F.round("f", 4).alias("f"), "xo", F.round("o", 4).alias("o"))
