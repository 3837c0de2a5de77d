from __future__ import annotations

import bisect
import random
from decimal import Decimal

import pytest
from compare import rows
from pyspark.sql import functions as F

from sweepframe import Space, StudyError, sweep
from sweepframe.operators import sweep as sweep_module
from sweepframe.operators.context import contexts
from sweepframe.operators.ranking import merged_places

OPS = {
    "=": lambda a, b: a == b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}
AGGS = {"n": ("count", None), "nv": ("count", "v"), "s": ("sum", "v"), "least": ("min", "v"), "most": ("max", "v"), "m": ("mean", "v")}


def brute(points, table, on):
    result = {}
    for p in points:
        rows = [
            r for r in table
            if all(r[a] is not None and p[b] is not None and OPS[op](r[a], p[b]) for a, op, b in on)
        ]
        values = [r["v"] for r in rows if r["v"] is not None]
        result[p["g_index"]] = (
            len(rows), len(values), sum(values) if values else None, min(values, default=None),
            max(values, default=None), sum(values) / len(values) if values else None,
        )
    return result


CASES = [
    [("k", "=", "flag")],
    [("x", ">=", "lo"), ("x", "<", "hi")],
    [("x", ">", "lo"), ("x", "<=", "hi")],
    [("k", "=", "flag"), ("x", ">=", "lo"), ("y", "<=", "hi"), ("y", ">", "lo")],
    [("x", "<", "lo")],
    [("x", ">", "lo"), ("x", ">", "hi"), ("x", "<=", "hi")],
]


# Settings: places listed one by one, thresholds in one array, broadcast points, literal thresholds.
SMALL, LARGE, MERGED, BLOCKS = (256, 2**20, 10**5, 1000), (0, 2**20, 0, 2), (0, 6, 0, 2), (0, 2**20, 10**5, 1000)


@pytest.mark.parametrize(
    "case,few,limit,broadcast,literals",
    [(case, *s) for s in (SMALL, LARGE) for case in range(len(CASES))]
    + [(case, *s) for s in (MERGED, BLOCKS) for case in (1, 3)],
)
def test_same_as_brute_force(spark, monkeypatch, case, few, limit, broadcast, literals):
    monkeypatch.setattr(sweep_module, "FEW_PLACES", few)
    monkeypatch.setattr(sweep_module, "MAX_THRESHOLDS", limit)
    monkeypatch.setattr(sweep_module, "MAX_LITERALS", literals)
    monkeypatch.setattr(sweep_module, "FEW_KEYS", 200 if few else 1)
    monkeypatch.setattr(sweep_module, "MAX_BROADCAST_POINTS", broadcast)
    rng = random.Random(case)
    table = [
        {"k": rng.choice("ABC"), "x": rng.choice([None, *range(12)]), "y": rng.randrange(12) / 2.0, "v": rng.choice([None, 1, 2, 5])}
        for _ in range(300)
    ]
    frame = spark.createDataFrame([tuple(r.values()) for r in table], "k string, x int, y double, v long")
    space = Space({"lo": [0, 2, 3, 5.5, 7], "flag": ["A", "B", "Z"], "w": [1, 4]})
    grid = contexts(spark, space, evaluables={"hi": "lo + w"}, conditions="lo + w < 11")
    points = [r.asDict() for r in grid.collect()]
    found = sweep(grid, frame, CASES[case], AGGS, grid_size=space.full_size())
    assert {r["g_index"]: tuple(r)[-6:] for r in found.collect()} == brute(points, table, CASES[case])


def test_bad_sweeps(spark):
    grid, table = spark.range(2).withColumnRenamed("id", "g_index"), spark.range(3)
    for on, aggs in [([], AGGS), ([("id", "!=", "g_index")], {}), ([("id", "=", "g_index")], {"m": ("median", "id")})]:
        with pytest.raises(StudyError):
            sweep(grid, table, on, aggs, 2)
    with pytest.raises(StudyError, match="compare"):
        sweep(grid.withColumn("s", F.lit("a")), table, [("id", "<", "s")], {"n": ("count", None)}, 2)


def test_plan_shuffles_no_rows(spark, tables):
    """The table is joined with nothing but a checked broadcast before it is aggregated."""
    table = spark.read.parquet(f"{tables}/lineitem.parquet")
    space = Space({"dmin": {"type": "uniform", "interval": [0.005, 0.085], "num": 5}, "flag": ["A", "N", "R"]})
    grid = contexts(spark, space, evaluables={"dmax": "dmin + 0.03"}, conditions="dmax < 0.1")
    on = [("l_returnflag", "=", "flag"), ("l_discount", ">=", "dmin"), ("l_discount", "<", "dmax")]
    found = sweep(grid, table, on, {"n": ("count", None)}, space.full_size())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" not in plan.split("partial_count")[-1]
    assert found.count() == 12


@pytest.mark.parametrize("literals", [0, 1000])
def test_repeated_hours_and_signed_zeros(spark, monkeypatch, literals):
    """Literal and stored thresholds agree where texts of values do not tell them apart, or too well."""
    monkeypatch.setattr("sweepframe.operators.sweep.MAX_LITERALS", literals)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        # 2024-10-27 02:30 local time comes twice, an hour apart.
        first = 1729989000
        grid = spark.createDataFrame([(0, first), (1, first + 3600)], "g_index long, s long").selectExpr("g_index", "timestamp_seconds(s) AS t")
        table = spark.range(6).selectExpr(f"timestamp_seconds({first} - 3600 + id * 1800) AS t")
        found = sweep(grid, table, [("t", "<=", "t")], {"n": ("count", None)})
        assert rows(found.select("g_index", "n"), "g_index") == [(0, 3), (1, 5)]
        found = sweep(grid, table, [("t", "=", "t")], {"n": ("count", None)})
        assert rows(found.select("g_index", "n"), "g_index") == [(0, 1), (1, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    grid = spark.createDataFrame([(0, 0.0), (1, -0.0)], "g_index long, lo double")
    table = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "x double")
    for op, n in ((">", 1), (">=", 3), ("=", 2)):
        found = sweep(grid, table, [("x", op, "lo")], {"n": ("count", None)})
        assert rows(found.select("g_index", "n"), "g_index") == [(0, n), (1, n)]


@pytest.mark.parametrize("per_block", [1, 3, 1000])
@pytest.mark.parametrize("kind", ["double", "string", "decimal(20,3)", "timestamp"])
def test_merged_places(spark, per_block, kind):
    rng = random.Random(per_block)
    values = spark.createDataFrame([(i, rng.randrange(40)) for i in range(300)] + [(400, 5)] * 50, "i long, v int")
    values = values.withColumn("v", F.col("v").cast("long").cast(kind))
    thresholds = values.sparkSession.createDataFrame([(t,) for t in (0, 3, 5, 11, 12, 30, 55)], "t int").select(F.col("t").cast("long").cast(kind).alias("t"))
    placed, numbered = merged_places(values, "v", thresholds, "t", "place", per_block)
    known = sorted(r["t"] for r in thresholds.collect())
    assert rows(numbered, "place") == [(t, k) for k, t in enumerate(known, 1)]
    for row in placed.collect():
        k = bisect.bisect_right(known, row["v"])
        assert row["place"] == 2 * k - (k > 0 and known[k - 1] == row["v"])
    assert placed.count() == values.count()
    empty, all_of = merged_places(values.where("false"), "v", thresholds, "t", "place", per_block)
    assert empty.count() == 0 and all_of.count() == 7


def test_one_scan_for_millions_of_thresholds(spark, tables):
    n = 5_000_000
    table = spark.read.parquet(f"{tables}/lineitem.parquet").select((F.col("l_extendedprice") * 100 % n).alias("x"), "l_quantity")
    scanned = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        scanned.add(1)
        return x

    rows_of = table.count()
    grid = spark.range(n).select(F.col("id").alias("g_index"), F.col("id").cast("double").alias("lo"))
    found = sweep(grid, table.withColumn("x", seen.asNondeterministic()("x")), [("x", ">=", "lo"), ("x", "<", "lo + 1")], {"n": ("count", None), "q": ("sum", "l_quantity")}, n)
    assert scanned.value == rows_of
    totals = found.agg(F.count("*"), F.sum("n"), F.sum("q"), F.sum(F.when(F.col("n") > 0, 1))).first()
    wanted = table.agg(F.count("*"), F.sum("l_quantity"), F.countDistinct(F.floor("x"))).first()
    assert totals == (n, *wanted) and scanned.value == rows_of


def test_decimals_are_compared_exactly(spark):
    grid = spark.createDataFrame([(0, Decimal("0.10000000000000000001")), (1, Decimal("0.1"))], "g_index long, lo decimal(30,20)")
    table = spark.createDataFrame([(Decimal("0.1"),), (Decimal("123456789012345.1"),)], "x decimal(18,1)")
    for limit, literals in ((2**20, 1000), (2**20, 0), (0, 0)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(sweep_module, "MAX_THRESHOLDS", limit)
            patch.setattr(sweep_module, "MAX_LITERALS", literals)
            found = sweep(grid, table, [("x", ">=", "lo")], {"n": ("count", None)})
            assert rows(found.select("g_index", "n"), "g_index") == [(0, 1), (1, 2)]
            found = sweep(grid, table, [("x", "=", "lo")], {"n": ("count", None)})
            assert rows(found.select("g_index", "n"), "g_index") == [(0, 0), (1, 1)]
