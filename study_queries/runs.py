"""Sweeps, user functions at grid points, and what they record."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweepframe import Space, Step, StepFailed, UniformAxis, sweep
from sweepframe.operators import steps as running
from sweepframe.operators.context import contexts
from sweepframe.plans.series import Plot, SeriesQuery

from .common import Registry, load, values

registry = Registry()
add = registry.add

BANDS = Space({"dmin": UniformAxis(0.005, 0.085, 5), "flag": ["A", "N", "R"]})
BANDS_SQL = f"""
points AS (SELECT CASE WHEN t.i = 4 THEN 0.085 ELSE 0.005 + t.i * ((0.085 - 0.005) / 4) END AS dmin, f.v AS flag, t.i * 3 + f.i AS o
           FROM generate_series(0, 4) t(i), {values("f", ["A", "N", "R"])}),
bands AS (SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS BIGINT) AS g_index, dmin, flag, dmin + 0.03 AS dmax
          FROM points WHERE dmin + 0.03 < 0.1),
swept AS (SELECT g_index, dmin, flag, dmax, count(l_orderkey) AS n, sum(l_quantity) AS qty FROM bands
          LEFT JOIN lineitem ON l_returnflag = flag AND l_discount >= dmin AND l_discount < dmax GROUP BY ALL)"""


def bands(spark):
    return contexts(spark, BANDS, None, {}, {"dmax": "dmin + 0.03"}, "dmax < 0.1")


def sweep_bands(spark, sf):
    on = [("l_returnflag", "=", "flag"), ("l_discount", ">=", "dmin"), ("l_discount", "<", "dmax")]
    aggs = {"n": ("count", None), "qty": ("sum", "l_quantity")}
    return sweep(bands(spark), load(spark, sf, "lineitem"), on, aggs, BANDS.full_size())


@add("X1_flagship", f"WITH {BANDS_SQL} SELECT round(dmin, 6) AS dmin, round(avg(qty), 4) AS qty FROM swept GROUP BY dmin")
def flagship(spark, sf):
    plot = Plot("flagship", "qty", {"dmin": "variate", "flag": "mean"}, xaxis="dmin")
    points = SeriesQuery(plot, BANDS, sweep_bands(spark, sf)).points()
    return points.select(F.round("x", 6).alias("dmin"), F.round("y", 4).alias("qty"))


@add("X1_sweep", f"WITH {BANDS_SQL} SELECT g_index, round(dmin, 6) AS dmin, flag, round(dmax, 6) AS dmax, n, qty FROM swept")
def swept(spark, sf):
    return sweep_bands(spark, sf).withColumns({"dmin": F.round("dmin", 6), "dmax": F.round("dmax", 6)})


@add("X1_range_sweep", """
WITH points AS (SELECT i, 1000.5 + i * ((400000.5 - 1000.5) / 399) AS lo FROM generate_series(0, 398) t(i))
SELECT CAST(i AS BIGINT) AS g_index, count(o_orderkey) AS n, max(o_totalprice) AS top, round(avg(o_custkey), 4) AS cust
FROM points LEFT JOIN orders ON o_totalprice > lo AND o_totalprice <= lo * 1.25 GROUP BY i""")
def range_sweep(spark, sf):
    space = Space({"lo": UniformAxis(1000.5, 400000.5, 400)})
    grid = contexts(spark, space, evaluables={"hi": "lo * 1.25"}, conditions="lo < 400000")
    aggs = {"n": ("count", None), "top": ("max", "o_totalprice"), "cust": ("mean", "o_custkey")}
    on = [("o_totalprice", ">", "lo"), ("o_totalprice", "<=", "hi")]
    return sweep(grid, load(spark, sf, "orders"), on, aggs, 400).select("g_index", "n", "top", F.round("cust", 4).alias("cust"))


@add("X1_two_ranges", """
WITH points AS (SELECT q.i * 6 + d.i AS i, 5 + q.i * 9.0 AS q, DATE '1996-01-01' + INTERVAL (d.i * 300) DAY AS d
                FROM generate_series(0, 4) q(i), generate_series(0, 5) d(i))
SELECT CAST(i AS BIGINT) AS g_index, count(l_orderkey) AS n, min(l_extendedprice) AS least
FROM points LEFT JOIN lineitem ON l_quantity >= q AND l_quantity < q + 9 AND l_shipdate >= d AND l_shipdate < d + INTERVAL 300 DAY GROUP BY i""")
def two_ranges(spark, sf):
    space = Space({"q": [5 + i * 9.0 for i in range(5)], "d": [i * 300 for i in range(6)]})
    dates = {"start": "timestamp_ntz'1996-01-01' + make_dt_interval(d)", "stop": "start + interval 300 days"}
    on = [("l_quantity", ">=", "q"), ("l_quantity", "<", "q + 9"), ("l_shipdate", ">=", "start"), ("l_shipdate", "<", "stop")]
    aggs = {"n": ("count", None), "least": ("min", "l_extendedprice")}
    table = load(spark, sf, "lineitem")
    return sweep(contexts(spark, space, evaluables=dates), table, on, aggs, 30).select("g_index", "n", "least")


@add("X1_two_wide_ranges", """
SELECT i AS g_index, count(o_orderkey) AS n, max(o_orderkey) AS last FROM generate_series(0, 1199) t(i)
LEFT JOIN orders ON o_totalprice > 900.5 + i * 350 AND o_totalprice <= 900.5 + i * 350 + 90000
     AND o_orderdate >= TIMESTAMP '1992-01-01' + INTERVAL (i * 40) HOUR AND o_orderdate < TIMESTAMP '1992-01-01' + INTERVAL (i * 40 + 8000) HOUR GROUP BY i""")
def two_wide_ranges(spark, sf):
    space = Space({"i": list(range(1200))})
    ends = {
        "low": "900.5D + i * 350", "high": "low + 90000",
        "start": "timestamp_ntz'1992-01-01' + make_dt_interval(0, i * 40)", "stop": "start + make_dt_interval(0, 8000)",
    }
    on = [("o_totalprice", ">", "low"), ("o_totalprice", "<=", "high"), ("o_orderdate", ">=", "start"), ("o_orderdate", "<", "stop")]
    aggs = {"n": ("count", None), "last": ("max", "o_orderkey")}
    return sweep(contexts(spark, space, evaluables=ends), load(spark, sf, "orders"), on, aggs, 1200).select("g_index", "n", "last")


def _parts(spark, sf):
    parts = load(spark, sf, "part").withColumnRenamed("p_partkey", "g_index")
    return parts.withColumns({"size": F.expr("if(p_size % 3 = 0, null, p_size)"), "sizes": F.expr("array(p_size, null)")})


@add("X2_map_instances", """
SELECT p_partkey AS g_index, 0 AS step_no, 'size' AS command,
       'size=' || CASE WHEN p_size % 3 = 0 THEN 'None' ELSE p_size::VARCHAR END || ' list=[' || p_size || ', None]' AS text, true AS ok FROM part
UNION ALL SELECT p_partkey, 1, 'name', upper(p_name), true FROM part""")
def map_instances(spark, sf):
    steps = [Step("size", lambda c: f"size={c['size']} list={c['sizes']}"), Step("name", lambda c: c["p_name"].upper())]
    return running.map_instances(_parts(spark, sf), steps).select("g_index", "step_no", "command", "text", "ok")


@add("X3_failing_steps", """
SELECT p_partkey AS g_index, 0 AS step_no, 'odd' AS command, CASE WHEN p_size % 2 = 1 THEN 'odd' ELSE 'even' END AS text, p_size % 2 = 1 AS ok FROM part
UNION ALL SELECT p_partkey, 1, 'big', '', p_size > 10 FROM part
UNION ALL SELECT p_partkey, 2, 'end', 'done', true FROM part WHERE p_size > 10""")
def failing_steps(spark, sf):
    def odd(c):
        if c["p_size"] % 2 == 0:
            raise StepFailed("even")
        return "odd"

    def big(c):
        assert c["p_size"] > 10
        return ""

    steps = [Step("odd", odd, allow_failure=True), Step("big", big), Step("end", lambda c: "done")]
    return running.map_instances(_parts(spark, sf), steps).select("g_index", "step_no", "command", "text", "ok")


@add("X3_fail_fast", """
WITH e AS (SELECT *, min(event_id) FILTER (event_type = 'error' AND value <= 20) OVER (PARTITION BY user_id) AS stop FROM events)
SELECT user_id AS g_index, event_id AS step_no, event_type AS command FROM e WHERE stop IS NULL OR event_id <= stop""")
def fail_fast(spark, sf):
    return running.fail_fast(_steps(spark, sf)).select("g_index", "step_no", "command")


def _steps(spark, sf):
    return load(spark, sf, "events").select(
        F.col("user_id").alias("g_index"), F.col("event_id").alias("step_no"), F.col("event_type").alias("command"),
        (F.col("event_type") != "error").alias("ok"), (F.col("value") > 20).alias("allow_failure"),
        F.col("ts").alias("started"), (F.col("ts") + F.make_dt_interval(secs=F.lit(60))).alias("finished"),
        F.col("value").alias("walltime"),
    )


@add("X4_retry", """
SELECT p_partkey AS g_index, 0 AS step_no, CASE WHEN p_size % 5 < 3 THEN 'attempt ' || (p_size % 5 + 1) ELSE '' END AS text, p_size % 5 < 3 AS ok FROM part
UNION ALL SELECT p_partkey, 1, 'after', true FROM part WHERE p_size % 5 < 3""")
def retry(spark, sf):
    def steps(context):
        attempts = []

        def flaky(c):
            attempts.append(1)
            assert len(attempts) > c["p_size"] % 5
            return f"attempt {len(attempts)}"

        return [Step("flaky", flaky, retry_on_fail=True, max_attempts=3), Step("after", lambda c: "after")]

    return running.map_instances(_parts(spark, sf), steps).select("g_index", "step_no", "text", "ok")


@add("X5_run_metadata", """
SELECT user_id AS g_index, min(ts) AS g_started, max(ts) + INTERVAL 60 SECOND AS g_finished,
       bool_and(event_type <> 'error' OR value > 20) AS g_success,
       max_by(value, event_id) FILTER (event_type = 'click') AS g_walltime_click,
       max_by(value, event_id) FILTER (event_type = 'view') AS g_walltime_view
FROM events GROUP BY user_id""")
def run_metadata(spark, sf):
    return running.run_metadata(_steps(spark, sf), ["click", "view"])


@add("X6_assemble", """
WITH o AS (SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS label FROM orders WHERE o_totalprice > 250000 GROUP BY o_custkey),
f AS (SELECT o_custkey, max(o_totalprice) AS top, min(o_orderstatus) AS label FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c_custkey AS g_index, coalesce(f.label, o.label, c_mktsegment) AS label, o.n, f.top FROM customer
LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN f ON f.o_custkey = c_custkey""")
def assemble(spark, sf):
    orders = load(spark, sf, "orders").withColumnRenamed("o_custkey", "g_index")
    context = load(spark, sf, "customer").select(F.col("c_custkey").alias("g_index"), F.col("c_mktsegment").alias("label"))
    meta = orders.where("o_totalprice > 250000").groupBy("g_index").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderpriority").alias("label")
    )
    found = orders.where("o_orderstatus = 'F'").groupBy("g_index").agg(
        F.max("o_totalprice").alias("top"), F.min("o_orderstatus").alias("label")
    )
    return running.assemble(context, meta, found)


@add("V4_steps_function", """
SELECT p_partkey AS g_index, 0 AS step_no, 'none' AS command, p_brand AS text FROM part WHERE p_size % 3 = 0
UNION ALL SELECT p_partkey, 0, 'size', p_type FROM part WHERE p_size % 3 <> 0
UNION ALL SELECT p_partkey, 1, 'again', CAST(p_size AS VARCHAR) FROM part WHERE p_size % 3 <> 0""")
def steps_function(spark, sf):
    def steps(context):
        if context["size"] is None:
            return [Step("none", lambda c: c["p_brand"])]
        return [Step("size", lambda c: c["p_type"]), Step("again", lambda c: str(c["size"]))]

    return running.map_instances(_parts(spark, sf), steps).select("g_index", "step_no", "command", "text")
