"""Plots written by one job, and running totals without a bound."""

from __future__ import annotations

import csv
import random
from pathlib import Path

import pytest
from compare import rows
from pyspark.sql import functions as F

from sweepframe import Plot, Space, StudyError
from sweepframe.operators import ranking
from sweepframe.operators.context import contexts
from sweepframe.plans import written
from sweepframe.plans.series import SeriesQuery


def query(spark, space, table=None, **options):
    table = contexts(spark, space, evaluables={"y": "a * 10 + b"}) if table is None else table
    return SeriesQuery(Plot(**options), space, table)


def read(path):
    """Header and lines of a plot, its parts one after the other."""
    parts = [list(csv.reader(p.open(), escapechar="\\")) for p in sorted(Path(path).glob("part-*"))]
    assert all(part[0] == parts[0][0] for part in parts)
    return parts[0][0], [line for part in parts for line in part[1:]]


def test_wide_and_long(spark, tmp_path, monkeypatch):
    space = Space({"a": [1, 2, 3], "b": list(range(7)), "c": ['x,y "q"', "é"]})
    axes = {"a": "fixed", "b": "variate", "c": "category"}
    first = query(spark, space, filename="p-${a}", yaxis=["y", "b"], axes=axes, xaxis="b", legend="${c}/${yaxis}")
    second = query(spark, space, filename="deep/all", yaxis="y", axes={"b": "variate"})
    monkeypatch.setattr(written, "LINES", 3)
    paths = written.write_plots(spark, [first, second], str(tmp_path))
    assert paths == [f"{tmp_path}/{name}.csv" for name in ("p-1", "p-2", "p-3", "deep/all")]
    for a in (1, 2, 3):
        header, lines = read(tmp_path / f"p-{a}.csv")
        wide = first.wide(a=a).orderBy("pos")
        assert header == wide.columns[1:]
        assert [[float(x) for x in line] for line in lines] == [[float(x) for x in r[1:]] for r in wide.collect()]
        assert len(list((tmp_path / f"p-{a}.csv").glob("part-*"))) == 3 and not list((tmp_path / f"p-{a}.csv").glob(".part*"))
    monkeypatch.setattr(written, "MAX_SERIES", 3)
    monkeypatch.setattr(written, "SERIES", 2)
    written.write_plots(spark, [first], str(tmp_path / "long"))
    header, lines = read(tmp_path / "long/p-2.csv")
    assert header == ["series", "pos", "x", "y"]
    points = first.points().where("a = 2").join(first.series().where("a = 2"), ["a", "c", "yaxis"]).orderBy("series_no", "pos")
    assert sorted(map(tuple, lines)) == sorted((r["legend"], str(r["pos"]), str(r["x"]), str(r["y"])) for r in points.collect())


def test_short_series_and_plots_without_points(spark, tmp_path):
    space = Space({"a": [1, 2], "b": [1, 2, 3]})
    table = contexts(spark, space, conditions="a = 1 and b > 1", evaluables={"y": "if(b = 3, null, a + b)"})
    one = query(spark, space, table, filename="s-${a}", yaxis="y", axes={"a": "fixed", "b": "variate"})
    written.write_plots(spark, [one], str(tmp_path))
    assert read(tmp_path / "s-1.csv") == (["y (x-axis)", "y"], [["1", "3"], ["2", ""]])
    assert read(tmp_path / "s-2.csv") == (["y (x-axis)", "y"], [])
    with pytest.raises(StudyError, match="named"):
        written.write_plots(spark, [query(spark, space, table, filename="same", yaxis="y", axes={"a": "fixed", "b": "variate"})], str(tmp_path / "t"))
    assert written.write_plots(spark, [], str(tmp_path)) == []


def test_jobs_do_not_depend_on_the_number_of_plots(spark, tmp_path):
    jobs = []
    for n in (2, 40):
        space = Space({"a": list(range(n)), "b": [1, 2, 3]})
        spark.sparkContext.setJobGroup(f"plots {n}", "")
        written.write_plots(spark, [query(spark, space, filename="p${a}", yaxis="y", axes={"a": "fixed", "b": "variate"})], str(tmp_path / str(n)))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"plots {n}")))
        assert len(list((tmp_path / str(n)).iterdir())) == n
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]


@pytest.mark.parametrize("block,order", [(20, [("m", None)]), (5, [("p", 6), ("m", None), ("q", 2)]), (2**16, [("m", None), ("q", None)])])
def test_running_total_without_a_bound(spark, monkeypatch, block, order):
    monkeypatch.setattr(ranking, "BLOCK", block)
    rng = random.Random(block)
    # A third of all rows share one mean; there are nulls and a null key, too.
    data = [(rng.choice(["k", None, "l"]), rng.choice([7.5, None, *[i / 7 for i in range(40)]] + [7.5] * 20), rng.choice([1.0, 2.0]), rng.randrange(6), i, rng.randrange(5)) for i in range(400)]
    frame = spark.createDataFrame(data, "key string, m double, q double, p int, tie long, w long")
    found = ranking.running_total(frame, ["key"], order, "w", "before", ["tie"], 400 if block > 400 else None)
    names = [name for name, _ in order] + ["tie"]
    place = {"m": 1, "q": 2, "p": 3, "tie": 4}
    wanted, sums = [], {}
    for row in sorted(data, key=lambda r: [(r[place[n]] is not None, r[place[n]] or 0) for n in names]):
        wanted.append((row[4], sums.get(row[0], 0)))
        sums[row[0]] = sums.get(row[0], 0) + row[5]
    assert rows(found.select("tie", "before"), "tie") == sorted(wanted)


def test_no_window_holds_a_series(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 100)
    frame = spark.range(20_000).select(F.lit(1).alias("key"), F.lit(2.5).alias("m"), F.col("id").alias("tie"), F.lit(1).cast("long").alias("w"))
    found = ranking.running_total(frame, ["key"], [("m", None)], "w", "before", ["tie"])
    sizes = found.withColumn("part", F.spark_partition_id()).where("before <> tie")
    assert sizes.count() == 0 and found.count() == 20_000
    blocks = [w for w in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in w or "windowspecdefinition" in w]
    assert blocks and all("before_block" in line for line in blocks if "key" in line)
