"""Axes, grids, contexts and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweepframe import GradedAxis, Space, UniformAxis, sweep
from sweepframe.functions.arrays import flatten_rows, flexible_mean
from sweepframe.functions.scalar import rnd, sci
from sweepframe.functions.template import render, render_files
from sweepframe.operators import context as ctx
from sweepframe.operators.grid import ORDINAL

from .common import CELLS, FLAGS, STATUSES, Registry, cells, cells_sql, load, series, values

registry = Registry()
add = registry.add

COUNT = {"n": ("count", None)}


@add("G1_listed_axis", f"""
SELECT CAST(f.i AS BIGINT) AS g_index, f.v AS flag, count(l_orderkey) AS n, sum(l_quantity) AS qty
FROM {values("f", FLAGS + ["X"])} LEFT JOIN lineitem ON l_returnflag = f.v GROUP BY ALL""")
def listed(spark, sf):
    space = Space({"flag": [*FLAGS, "X"]})
    aggs = {**COUNT, "qty": ("sum", "l_quantity")}
    return sweep(ctx.contexts(spark, space), load(spark, sf, "lineitem"), [("l_returnflag", "=", "flag")], aggs, 4)


@add("G2_uniform_axis", """
WITH points AS (SELECT i, CASE WHEN i = 8 THEN 0.095 ELSE 0.015 + i * ((0.095 - 0.015) / 8) END AS dmin
                FROM generate_series(0, 8) t(i))
SELECT CAST(i AS BIGINT) AS g_index, round(dmin, 9) AS dmin, count(l_orderkey) AS n
FROM points LEFT JOIN lineitem ON l_discount >= dmin GROUP BY ALL""")
def uniform(spark, sf):
    space = Space({"dmin": UniformAxis(0.015, 0.095, 9)})
    found = sweep(ctx.contexts(spark, space), load(spark, sf, "lineitem"), [("l_discount", ">=", "dmin")], COUNT, 9)
    return found.withColumn("dmin", F.round("dmin", 9))


@add("G3_graded_axis", """
WITH points AS (SELECT i, 1000 + (500000 - 1000) * (1 - pow(1.5, i)) / (1 - pow(1.5, 7)) AS least
                FROM generate_series(0, 7) t(i))
SELECT CAST(i AS BIGINT) AS g_index, round(least, 4) AS least, count(o_orderkey) AS n
FROM points LEFT JOIN orders ON o_totalprice >= least GROUP BY ALL""")
def graded(spark, sf):
    space = Space({"least": GradedAxis(1000, 500000, 8, 1.5)})
    found = sweep(ctx.contexts(spark, space), load(spark, sf, "orders"), [("o_totalprice", ">=", "least")], COUNT, 8)
    return found.withColumn("least", F.round("least", 4))


LINES = Space({"flag": FLAGS, "status": STATUSES, "line": list(range(1, 8))})
ON_LINES = [("l_returnflag", "=", "flag"), ("l_linestatus", "=", "status"), ("l_linenumber", "=", "line")]


@add("G4_full_product", f"""
SELECT CAST(f.i * 14 + s.i * 7 + k.i AS BIGINT) AS g_index, f.v AS flag, s.v AS status, CAST(k.i + 1 AS BIGINT) AS line,
       count(l_orderkey) AS n
FROM {values("f", FLAGS)} CROSS JOIN {values("s", STATUSES)} CROSS JOIN generate_series(0, 6) k(i)
LEFT JOIN lineitem ON l_returnflag = f.v AND l_linestatus = s.v AND l_linenumber = k.i + 1 GROUP BY ALL""")
def full_product(spark, sf):
    grid = LINES.full(spark).withColumnRenamed(ORDINAL, "g_index")
    return sweep(grid, load(spark, sf, "lineitem"), ON_LINES, COUNT, LINES.full_size())


@add("G5_subspace", f"""
SELECT CAST(k.i * 2 + s.i AS BIGINT) AS g_index, CAST(k.i + 1 AS BIGINT) AS line, s.v AS status, count(l_orderkey) AS n
FROM generate_series(0, 6) k(i) CROSS JOIN {values("s", STATUSES)}
LEFT JOIN lineitem ON l_linestatus = s.v AND l_linenumber = k.i + 1 GROUP BY ALL""")
def subspace(spark, sf):
    grid = ctx.contexts(spark, LINES, ["line", "status"])
    return sweep(grid, load(spark, sf, "lineitem"), ON_LINES[:0:-1], COUNT, LINES.size("line", "status"))


@add("G6_space_size", f"""{cells_sql(None)}
SELECT count(*) AS size, count(*) FILTER (n > 0) AS occupied, CAST(sum(n) AS BIGINT) AS n FROM cells""")
def space_size(spark, sf):
    on = [("l_returnflag", "=", "flag"), ("l_linestatus", "=", "status"), ("year(l_shipdate)", "=", "year")]
    found = sweep(ctx.contexts(spark, CELLS), load(spark, sf, "lineitem"), on, COUNT, CELLS.full_size())
    return found.agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("n") > 0).alias("occupied"), F.sum("n").alias("n"))


@add("G7_background_point", """
SELECT CAST(0 AS BIGINT) AS g_index, 'A' AS flag, 'F' AS status, CAST(1 AS BIGINT) AS line, count(*) AS n FROM lineitem
WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 1""")
def background(spark, sf):
    point = ctx.single_context(spark, LINES.background()).select("g_index", *LINES)
    return sweep(point, load(spark, sf, "lineitem"), ON_LINES, COUNT, 1)


@add("E1_constants", "SELECT p_partkey, p_size, 'EUR' AS currency, 1.25::DOUBLE AS rate, 3::BIGINT AS k FROM part")
def constants(spark, sf):
    made = ctx.add_constants(load(spark, sf, "part"), {"currency": "EUR", "rate": 1.25, "p_size": 0, "k": 3})
    return made.select("p_partkey", "p_size", "currency", "rate", "k")


@add("E2_evaluate", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net,
       round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross, l_tax + 1 AS l_tax, 7::BIGINT AS k
FROM lineitem""")
def evaluated(spark, sf):
    rows = ctx.evaluate(
        load(spark, sf, "lineitem"),
        {"net": "l_extendedprice * (1 - l_discount)", "gross": "round(net * (1 + l_tax), 6)", "l_tax": "l_tax + 1", "k": 7},
    )
    return rows.select("l_orderkey", "l_linenumber", F.round("net", 6).alias("net"), "gross", "l_tax", "k")


@add("E3_where", """
SELECT o_orderkey FROM orders
WHERE o_totalprice > 100000 AND o_custkey % 5 <> 0 AND 1 / (o_custkey % 5) > 0.3 AND o_custkey % 3 <> 0
  AND length(o_orderstatus) > 0""")
def where(spark, sf):
    conditions = ["o_totalprice > 100000", "1 / (o_custkey % 5) > 0.3", "o_custkey % 3", "o_orderstatus"]
    return ctx.where(load(spark, sf, "orders"), conditions).select("o_orderkey")


@add("E4_dense_index", f"""{cells_sql()} SELECT g_index, flag, status, year, n FROM cells""")
def dense(spark, sf):
    grid = ctx.contexts(spark, CELLS, conditions=["flag <> 'N' OR year < 2000"])
    on = [("l_returnflag", "=", "flag"), ("l_linestatus", "=", "status"), ("year(l_shipdate)", "=", "year")]
    return sweep(grid, load(spark, sf, "lineitem"), on, COUNT, CELLS.full_size())


@add("E5_logdir", """
SELECT s_suppkey AS g_index, 'nation-' || s_nationkey || '/' || s_suppkey || '-' || s_acctbal AS g_logdir FROM supplier""")
def logdir(spark, sf):
    rows = load(spark, sf, "supplier").withColumnRenamed("s_suppkey", "g_index")
    return rows.select("g_index", ctx.logdir_column(rows, "nation-${s_nationkey}/${g_index}-${s_acctbal}").alias("g_logdir"))


@add("E6_explicit_contexts", """
SELECT c_custkey AS g_index, c_acctbal, 1.5::DOUBLE AS factor, round(c_acctbal * 1.5, 6) AS scaled,
       CAST(c_custkey AS VARCHAR) AS g_logdir FROM customer""")
def explicit(spark, sf):
    given = load(spark, sf, "customer").select(F.col("c_custkey").alias("g_index"), "c_acctbal")
    return ctx.override_contexts(given, {"factor": 1.5}, {"scaled": "round(c_acctbal * factor, 6)"})


@add("E7_create_instances", """
SELECT c_custkey AS g_index, c_mktsegment || '/' || c_custkey AS logdir, 'created' AS status, c_nationkey + 1 AS nation
FROM customer""")
def create_instances(spark, sf):
    given = load(spark, sf, "customer").withColumnRenamed("c_custkey", "g_index")
    made = ctx.instances(ctx.override_contexts(given, {}, {"nation": "c_nationkey + 1"}, "${c_mktsegment}/${g_index}"))
    return made.select("g_index", "logdir", "status", "context.nation")


@add("E8_pruned_columns", f"{cells_sql()} SELECT g_index, flag, status, year, qty FROM cells")
def pruned(spark, sf):
    found = series(cells(spark, sf), "qty", {"flag": "category", "status": "category", "year": "variate"})
    return found.collapsed()[0]


@add("E9_equal_slice", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 3")
def equal_slice(spark, sf):
    rows = ctx.equal_slice(load(spark, sf, "lineitem"), {"l_returnflag": "R", "l_linestatus": "F", "l_linenumber": 3})
    return rows.select("l_orderkey", "l_linenumber")


@add("F1_legendre", """
WITH u AS (SELECT l_returnflag AS flag, l_linenumber, -1 + 2 * l_discount / 0.1 AS u FROM lineitem)
SELECT flag, round(sum((5 * u * u * u - 3 * u) / 2), 4) AS p3,
       round(sum(CASE l_linenumber WHEN 1 THEN u WHEN 2 THEN (3 * u * u - 1) / 2 WHEN 3 THEN (5 * u * u * u - 3 * u) / 2 ELSE 1 END), 4) AS pn
FROM u GROUP BY flag""")
def legendre(spark, sf):
    degree = "CASE WHEN l_linenumber <= 3 THEN l_linenumber ELSE 0 END"
    rows = ctx.evaluate(
        load(spark, sf, "lineitem"), {"p": "legendre(3, 0, 0.1, l_discount)", "q": f"legendre({degree}, 0, 0.1, l_discount)"}
    )
    return rows.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.round(F.sum("p"), 4).alias("p3"), F.round(F.sum("q"), 4).alias("pn")
    )


@add("F2_render", """
SELECT p_partkey, 'part ' || p_partkey || ': ' || upper(p_name) || ' {' || (p_size + 1) || '} at ' || p_retailprice AS text,
       p_brand || '/' || p_type AS label FROM part""")
def rendered(spark, sf):
    rows = load(spark, sf, "part")
    texts = render(rows, {"text": "part ${p_partkey}: ${upper(p_name)} {${p_size + 1}} at ${p_retailprice}", "label": "${p_brand}/${p_type}"})
    return rows.select("p_partkey", *(text.alias(name) for name, text in texts.items()))


@add("F3_render_files", """
SELECT item_id AS g_index, 'in/' || item_id || '.txt' AS target, 'item=' || item_id || chr(10) || text AS text FROM benchmark
UNION ALL SELECT item_id, 'raw.txt', 'item=${g_index}' FROM benchmark""")
def rendered_files(spark, sf):
    rows = load(spark, sf, "benchmark").withColumnRenamed("item_id", "g_index")
    return render_files(rows, [("in/${g_index}.txt", "item=${g_index}\n${text}", True), ("raw.txt", "item=${g_index}", False)])


@add("F4_fixed_decimals", """
SELECT l_orderkey, l_linenumber, printf('%.3f', l_extendedprice / 7) AS fixed, printf('%.1f', l_extendedprice / 7) AS short FROM lineitem""")
def fixed_decimals(spark, sf):
    x = F.col("l_extendedprice") / 7
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rnd(x, 3).alias("fixed"), rnd(x, 1).alias("short"))


@add("F5_scientific", """
SELECT l_orderkey, l_linenumber, printf('%.4e', l_extendedprice / 7) AS sci, printf('%.2e', l_extendedprice / 7) AS short FROM lineitem""")
def scientific(spark, sf):
    x = F.col("l_extendedprice") / 7
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", sci(x, 4).alias("sci"), sci(x, 2).alias("short"))


@add("F6_math", """
SELECT o_orderkey, round(ln(o_totalprice), 6) AS l, ascii(o_orderpriority) AS o, round(sin(o_custkey) + cos(o_custkey), 6) AS t,
       round(pow(o_custkey, 1.5), 3) AS p FROM orders""")
def math(spark, sf):
    made = ctx.evaluate(load(spark, sf, "orders"), {
        "l": "round(log(o_totalprice), 6)", "o": "ord(o_orderpriority)", "t": "round(sin(o_custkey) + cos(o_custkey), 6)",
        "p": "round(pow(o_custkey, 1.5), 3)",
    })
    return made.select("o_orderkey", "l", "o", "t", "p")


@add("F7_flatten", """
SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings""")
def flattened(spark, sf):
    rows = flatten_rows(load(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    return rows.withColumn("value", F.col("value").cast("double"))


@add("F8_flexible_mean", """
WITH cells AS (SELECT label, vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(v), 6) AS value, round(avg(vec_id), 6) AS id FROM cells GROUP BY label, pos""")
def means(spark, sf):
    found = flexible_mean(load(spark, sf, "embeddings"), ["label"], ["embedding", "vec_id"])
    rows = flatten_rows(found, "embedding")
    return rows.select("label", "pos", F.round("value", 6).alias("value"), F.round("vec_id", 6).alias("id"))


@add("V1_evaluate_function", "SELECT p_partkey, p_size * 2 AS twice, round(p_retailprice / 10, 4) AS tenth FROM part")
def evaluate_function(spark, sf):
    made = ctx.evaluate(
        load(spark, sf, "part"), lambda c: {"twice": c["p_size"] * 2, "tenth": F.round(c["p_retailprice"] / 10, 4)}
    )
    return made.select("p_partkey", "twice", "tenth")


@add("V2_where_function", "SELECT p_partkey FROM part WHERE p_size > 25 AND p_brand LIKE '%1'")
def where_function(spark, sf):
    rows = ctx.where(load(spark, sf, "part"), lambda c: (c["p_size"] > 25) & c["p_brand"].endswith("1"))
    return rows.select("p_partkey")


@add("V3_logdir_function", "SELECT p_partkey AS g_index, p_type || '/' || p_partkey AS g_logdir FROM part")
def logdir_function(spark, sf):
    rows = load(spark, sf, "part").withColumnRenamed("p_partkey", "g_index")
    made = ctx.logdir_column(rows, lambda c: F.concat_ws("/", c["p_type"], c["g_index"].cast("string")))
    return rows.select("g_index", made.alias("g_logdir"))
