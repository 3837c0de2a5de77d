"""Collected tables, instances, state and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweepframe import Plot, Study
from sweepframe.operators import collect as col
from sweepframe.session import fresh_path
from sweepframe.sources.export import captured_records, dump_records, write_captured
from sweepframe.sources.store import StudyStore, load_table, save_table
from sweepframe.sources.text import parse_records

from .common import CELLS, RAGGED, Registry, cells, cells_sql, load

registry = Registry()
add = registry.add

#: Indices of a part of the stored tables, few so that small tables have several parts.
PART = 1 << 12

STATUS = "CASE event_type WHEN 'error' THEN 'started' WHEN 'click' THEN 'prepared' WHEN 'signup' THEN 'created' ELSE 'downloaded' END"


def _instances(spark, sf):
    """Events as instances: status by type, a captured record once downloaded."""
    rows = load(spark, sf, "events").withColumn("status", F.expr(STATUS))
    record = F.struct(F.col("event_id").alias("g_index"), "user_id", "value")
    return rows.select(
        F.col("event_id").alias("g_index"), F.concat(F.lit("u"), "user_id").alias("logdir"), "status",
        F.when(F.col("status") == "downloaded", record).alias("captured"),
    )


@add("S1_load_table", """
SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS cust FROM orders GROUP BY o_orderstatus""")
def load_collected(spark, sf):
    rows = load(spark, sf, "orders").withColumnRenamed("o_orderkey", "g_index")
    path = fresh_path(spark, "table")
    save_table(rows, path)
    # What has not been collected adds no rows, only the same columns.
    both = load_table(spark, path).unionByName(load_table(spark, None, rows.schema))
    return both.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("cust"))


@add("S2_save_table", "SELECT p_partkey AS g_index, p_name, p_size, p_retailprice FROM part")
def save_collected(spark, sf):
    path = fresh_path(spark, "table")
    rows = load(spark, sf, "part").withColumnRenamed("p_partkey", "g_index")
    save_table(rows.select("g_index", "p_name", "p_size", "p_retailprice"), path)
    return load_table(spark, path)


@add("S3_instances_by_status", f"SELECT event_id AS g_index, {STATUS} AS status FROM events WHERE {STATUS} IN ('started', 'prepared')")
def by_status(spark, sf):
    return col.with_status(_instances(spark, sf), ("started", "prepared")).select("g_index", "status")


@add("S4_instance_by_index", f"SELECT event_id AS g_index, 'u' || user_id AS logdir, {STATUS} AS status FROM events WHERE event_id = 42")
def by_index(spark, sf):
    study = Study(spark, root=fresh_path(spark, "study"), width=PART)
    study.adopt(_instances(spark, sf))
    return study.instance(42).select("g_index", "logdir", "status")


@add("S9_captured_records", """
SELECT c_custkey AS g_index, '{"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || ',"g_index":' || c_custkey
       || ',"owed":' || coalesce(CAST(CASE WHEN c_acctbal < 0 THEN c_nationkey END AS VARCHAR), 'null') || '}' AS record FROM customer""")
def records(spark, sf):
    rows = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("g_index"), "c_mktsegment", "c_nationkey", F.expr("CASE WHEN c_acctbal < 0 THEN c_nationkey END AS owed")
    )
    path = fresh_path(spark, "captured")
    write_captured(rows, path)
    return captured_records(spark.read.schema(rows.schema).json(path))


@add("S10_dump_records", f"""{cells_sql()}
SELECT flag, n, status, year, round(qty, 4) AS qty, round(disc, 6) AS disc FROM cells""")
def dumped(spark, sf):
    rows = cells(spark, sf)
    texts = dump_records(rows)
    (column,) = texts.columns
    read = parse_records(texts, column, rows.drop("g_index").schema, "_row").select("_row.*")
    return read.withColumns({"qty": F.round("qty", 4), "disc": F.round("disc", 6)})


@add("U1_upsert", """
WITH fresh AS (SELECT doc_id AS g_index, CAST(n_chars AS DOUBLE) / 2 AS quality, lang FROM documents WHERE doc_id % 3 = 0)
SELECT g_index, quality, NULL AS toxic, lang FROM fresh
UNION ALL SELECT doc_id, CAST(quality AS DOUBLE), toxic, NULL FROM labels WHERE doc_id NOT IN (SELECT g_index FROM fresh)""")
def upsert(spark, sf):
    old = load(spark, sf, "labels").withColumnRenamed("doc_id", "g_index")
    new = load(spark, sf, "documents").where("doc_id % 3 = 0").select(
        F.col("doc_id").alias("g_index"), (F.col("n_chars") / 2).alias("quality"), "lang"
    )
    return col.upsert(old, new)


@add("U2_collect", f"""
WITH done AS (SELECT event_id AS g_index, user_id, value FROM events WHERE {STATUS} = 'downloaded')
SELECT * FROM done UNION ALL SELECT o_orderkey, o_custkey, round(o_totalprice, 2) FROM orders WHERE o_orderkey NOT IN (SELECT g_index FROM done)""")
def collect(spark, sf):
    old = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("g_index"), F.col("o_custkey").alias("user_id"), F.round("o_totalprice", 2).alias("value")
    )
    return col.collect(old, _instances(spark, sf))


@add("U1_partial_upsert", """
SELECT o_orderkey AS g_index, CASE WHEN o_orderkey % 1000 BETWEEN 100 AND 119 THEN 'new' ELSE o_orderstatus END AS status,
       CASE WHEN o_orderkey % 1000 BETWEEN 100 AND 119 THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders
UNION ALL SELECT -1 - c_custkey, 'none', c_acctbal FROM customer""")
def partial_upsert(spark, sf):
    store = StudyStore(spark, fresh_path(spark, "study"), PART)
    old = load(spark, sf, "orders").select(F.col("o_orderkey").alias("g_index"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    store.commit(table=store.write("table", old))
    changed = old.where("g_index % 1000 between 100 and 119").withColumns({"status": F.lit("new"), "price": F.col("price") * 2})
    added = load(spark, sf, "customer").select((-1 - F.col("c_custkey")).alias("g_index"), F.lit("none").alias("status"), F.col("c_acctbal").alias("price"))
    for new in (changed, added):
        store.commit(table=store.upsert("table", new))
    return store.read("table")


@add("U2_partial_collect", f"""
SELECT event_id AS g_index, user_id, CASE WHEN event_id BETWEEN 50 AND 300 THEN value * 10 ELSE value END AS value
FROM events WHERE {STATUS} = 'downloaded' OR event_id BETWEEN 50 AND 300""")
def partial_collect(spark, sf):
    study = Study(spark, root=fresh_path(spark, "study"), width=PART)
    study.adopt(_instances(spark, sf))
    study.collect()
    again = load(spark, sf, "events").where("event_id between 50 and 300").select(
        F.col("event_id").alias("g_index"), F.concat(F.lit("u"), "user_id").alias("logdir"), F.lit("downloaded").alias("status"),
        F.struct(F.col("event_id").alias("g_index"), "user_id", (F.col("value") * 10).alias("value")).alias("captured"),
    )
    study.adopt(again)
    return study.collect()


@add("U3_status_counts", f"SELECT {STATUS} AS status, count(*) AS n FROM events GROUP BY ALL")
def status_counts(spark, sf):
    return col.status_counts(_instances(spark, sf))


@add("U4_state_flags", f"""
SELECT bool_or({STATUS} IN ('started', 'prepared')) AS is_running, bool_or({STATUS} = 'downloaded') AS has_data,
       bool_and({STATUS} = 'downloaded') AS has_captured FROM events""")
def flags(spark, sf):
    return col.state_flags(_instances(spark, sf))


def _study(spark):
    plot = Plot("plot", "qty", {"year": "variate", "flag": "category", "status": "mean"})
    return Study(spark, dict(CELLS), where=RAGGED, plots=[plot], root=fresh_path(spark, "study"), sourcedir="/")


def _run(study, spark, sf):
    on = [("l_returnflag", "=", "flag"), ("l_linestatus", "=", "status"), ("year(l_shipdate)", "=", "year")]
    study.run_sweep(load(spark, sf, "lineitem"), on, {"n": ("count", None), "qty": ("sum", "l_quantity")})


def _stages(spark, stages):
    """The flags and the table's row count and total after every stage."""
    names = ("stage", "has_data", "has_captured", "has_collected", "has_plotted", "points", "n")
    rows = [tuple(stage[name] for name in names) for stage in stages]
    columns = "stage string, has_data boolean, has_captured boolean, has_collected boolean, has_plotted boolean, points long, n long"
    return spark.createDataFrame(rows, columns)


def _stage(study, name):
    totals = study.load_table().agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    return {"stage": name, **study.flags(), **totals.asDict()}


@add("U5_staleness", f"""{cells_sql()}, t AS (SELECT count(*) AS points, CAST(sum(n) AS BIGINT) AS n FROM cells)
SELECT s.*, CASE WHEN has_collected THEN points ELSE 0 END AS points, CASE WHEN has_collected THEN n ELSE 0 END AS n
FROM (VALUES ('run', true, true, false, false), ('collect', true, true, true, false), ('plot', true, true, true, true),
             ('again', true, true, false, false)) s(stage, has_data, has_captured, has_collected, has_plotted), t""")
def staleness(spark, sf):
    study, stages = _study(spark), []
    for name, action in (("run", None), ("collect", study.collect), ("plot", study.plot), ("again", None)):
        _run(study, spark, sf) if action is None else action()
        stages.append(_stage(study, name))
    return _stages(spark, stages)


@add("U6_reset", f"""{cells_sql()}, t AS (SELECT count(*) AS points, CAST(sum(n) AS BIGINT) AS n FROM cells)
SELECT s.*, CASE WHEN has_collected THEN points ELSE 0 END AS points, CASE WHEN has_collected THEN n ELSE 0 END AS n
FROM (VALUES ('collected', true, true, true, false), ('table reset', true, true, false, false),
             ('reset', false, true, false, false)) s(stage, has_data, has_captured, has_collected, has_plotted), t""")
def reset(spark, sf):
    study, stages = _study(spark), []
    _run(study, spark, sf)
    study.collect()
    stages.append(_stage(study, "collected"))
    study.clear_table()
    stages.append(_stage(study, "table reset"))
    study.clear()
    empty = {"points": 0, "n": 0} if study.load_table().count() == 0 else {}
    stages.append({"stage": "reset", **study.flags(), **empty})
    return _stages(spark, stages)
