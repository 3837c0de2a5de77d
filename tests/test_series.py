from __future__ import annotations

import itertools
import math
import random
from statistics import fmean

import pytest
from compare import rows
from pyspark.sql import functions as F

from sweepframe import Plot, SeriesQuery, Space, StudyError
from sweepframe.operators import ranking
from sweepframe.operators.context import contexts
from sweepframe.operators.ranking import running_total
from sweepframe.plans.series import all_points

SPACE = Space({"i": [1, 2, 3, 4, 5], "j": [1, 2, 4, 8, 16], "k": ["a", "b", "c"]})
EVALUATE = {"isq": "i * i", "jlog": "ln(j)", "misc": "i + j + ord(k)"}
CONSTANTS = {"pi": 3.1415, "e": 2.7182}


@pytest.fixture(scope="module")
def table(spark):
    made = contexts(spark, SPACE, None, CONSTANTS, EVALUATE)
    return made.withColumns({"vresult": F.sequence(F.lit(1).cast("long"), "i"), "fresult": F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))})


def query(table, **plot):
    return SeriesQuery(Plot(filename=plot.pop("filename", "f"), **plot), SPACE, table, CONSTANTS, EVALUATE)


def test_variate_with_ignores(table):
    found = query(table, yaxis="isq", axes={"i": "variate"})
    assert found.kind == "line"
    assert rows(found.points(), "pos") == [("isq", n, n, n * n) for n in range(1, 6)]
    assert rows(found.series()) == [(0, 0, "isq", "isq")]


def test_several_ignored_axes(spark):
    space = Space({"i": [1, 2, 3], "j": [7, 8, 9], "k": ["k", "l", "m"]})
    made = contexts(spark, space, None, {}, {"y": "1000 * i + 10 * j + ord(k)"})
    for parts in (1, 7):
        found = SeriesQuery(Plot("f", "y", {"i": "variate"}), space, made.repartition(parts), {}, {})
        assert [r["y"] for r in found.points().orderBy("pos").collect()] == [1000 * i + 70 + ord("k") for i in (1, 2, 3)]


def test_blocks_keep_null_keys(spark, monkeypatch):
    frame = spark.createDataFrame([(c, n, 1.0) for c in ("a", None) for n in range(6)], "c string, n long, w double")
    whole = rows(running_total(frame, ["c"], [("n", 6)], "w", "t"), "c", "n")
    monkeypatch.setattr(ranking, "BLOCK", 2)
    assert rows(running_total(frame, ["c"], [("n", 6)], "w", "t").select("c", "n", "w", "t"), "c", "n") == whole


def test_fixed_and_mean(table):
    found = query(
        table, yaxis="misc", axes={"i": "variate", "j": "mean", "k": "fixed"}, filename="misc-vs-i-${k}",
        title="This is a plot for k=${k}", xlabel="x (${k})", ylabel="y (${k})", xmode="log",
    )
    expected = [(k, "misc", n, n, n + ord(k) + 31 / 5) for k in "abc" for n in range(1, 6)]
    assert [tuple(r) for r in found.points().orderBy("k", "pos").collect()] == [
        (k, y, p, x, pytest.approx(v)) for k, y, p, x, v in expected
    ]
    plots = rows(found.plots(), "plot_no")
    assert plots[1] == (1, "b", "misc-vs-i-b", "This is a plot for k=b", "x (b)", "y (b)", "line", "log", "linear", True)


def test_list_y(table):
    expected = [("fresult", n, n, float(n)) for n in range(1, 11)]
    assert rows(query(table, yaxis="fresult").points(), "pos") == expected
    for modes in ({"i": "mean", "j": "mean", "k": "ignore"}, {"i": "mean", "j": "mean"}):
        assert rows(query(table, yaxis="fresult", axes=modes).points(), "pos") == expected


def test_ragged_lists_have_no_mean(table):
    with pytest.raises(Exception, match="unequal length"):
        query(table, yaxis="vresult", axes={"i": "mean"}).points().collect()


def test_category_lists(table):
    found = query(table, yaxis="vresult", axes={"i": ("category", "color")}, legend="i is ${i} - ${yaxis}")
    assert found.kind == "line"
    assert rows(found.points(), "i", "pos") == [(i, "vresult", n, n, n) for i in range(1, 6) for n in range(1, i + 1)]
    assert [r["legend"] for r in found.series().orderBy("series_no").collect()] == [f"i is {i} - vresult" for i in range(1, 6)]
    wide = found.wide().orderBy("pos")
    assert wide.columns[:3] == ["pos", "i is 1 - vresult (x-axis)", "i is 1 - vresult"]
    assert [r[-1] for r in wide.collect()] == [1, 2, 3, 4, 5]
    assert [r[2] for r in wide.collect()] == [1, None, None, None, None]


def test_scatter(table):
    found = query(table, yaxis=["misc"], xaxis="j", axes={"i": "variate", "j": "variate", "k": "variate"}, kind="line")
    assert found.kind == "scatter"
    expected = [(j, i + j + ord(k)) for i, j, k in itertools.product(*SPACE.values())]
    assert [tuple(r) for r in found.points().orderBy("pos").select("x", "y").collect()] == expected


def test_several_y_and_default_legend(table):
    found = query(table, yaxis=["isq", "misc"], axes={"i": "variate", "k": "category", "j": ("ignore", 4)})
    legends = [r["legend"] for r in found.series().orderBy("series_no").collect()]
    assert legends[:3] == ["k='a' (isq)", "k='a' (misc)", "k='b' (isq)"]
    # An ignored axis with a value is not collapsed.
    assert {r["n_points"] for r in found.series_sizes().collect()} == {25}
    texts = query(table, yaxis="isq", axes={"i": "variate", "j": ("ignore", 4), "k": "category"}, title="${j} ${k} ${misc}")
    assert texts.plots().first()["title"] == f"4 c {1 + 4 + 99}"


def test_no_variate_gives_no_plot(table):
    assert query(table, yaxis="isq").kind is None


def test_auto_x(table):
    found = query(table, yaxis="isq", axes={"j": "variate"}, auto_x=True)
    assert [r["x"] for r in found.points().orderBy("pos").collect()] == [1, 2, 4, 8, 16]


def test_bad_plots(table):
    for bad in ({"yaxis": "nope"}, {"yaxis": "isq", "axes": {"z": "mean"}}, {"yaxis": ["isq", "fresult"]}, {"yaxis": "isq", "axes": {"i": "median"}}):
        with pytest.raises(StudyError):
            query(table, **bad)
    with pytest.raises(StudyError, match="no mean"):
        query(table.withColumn("s", F.col("k")), yaxis="s", axes={"i": "mean"}).points()


def collapse(data, axes, name, values, combine):
    """Plain definition of collapsing one axis: group by the others, sorted."""
    others = [a for a in axes if a != name]
    groups = {}
    for row in data:
        if all(row[a] is not None for a in others):
            groups.setdefault(tuple(row[a] for a in others), []).append(row)
    out = []
    for key in sorted(groups):
        row = dict(zip(others, key))
        for column in [name, *values]:
            present = [r[column] for r in groups[key] if r[column] is not None]
            row[column] = combine(present) if present else None
        out.append(row)
    return out


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("block", [2**16, 2])
def test_collapse_chains_on_ragged_grids(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ranking, "BLOCK", block)
    rng = random.Random(seed)
    axes = {"a": [3, 1, 2], "b": [0.5, 0.25], "c": [10, 30, 20], "d": [1, 2]}
    space = Space(axes)
    data = [
        {**dict(zip(axes, combo)), "g_index": n, "y": rng.choice([None, 1.0, 2.0, 7.0])}
        for n, combo in enumerate(c for c in itertools.product(*axes.values()) if rng.random() < 0.6)
    ]
    modes = {name: rng.choice(["variate", "category", "fixed", "mean", "ignore", "mean"]) for name in axes}
    frame = spark.createDataFrame(
        [tuple(r[c] for c in ("g_index", *axes, "y")) for r in data], "g_index long, a long, b double, c long, d long, y double"
    )
    found = SeriesQuery(Plot("f", "y", modes), space, frame)
    expected = data
    for name, mode in modes.items():
        if mode == "ignore":
            expected = collapse(expected, axes, name, ["y"], lambda v: v[0])
    for name, mode in modes.items():
        if mode == "mean":
            expected = collapse(expected, axes, name, ["y"], fmean)
    counts, want = {}, []
    for row in expected:
        key = tuple(row[k] for k in found.keys)
        counts[key] = counts.get(key, 0) + 1
        want.append((*key, "y", counts[key], counts[key], row["y"]))
    got = [tuple(r) for r in found.points().collect()]
    assert len(got) == len(want)
    for left, right in zip(sorted(got, key=str), sorted(want, key=str)):
        assert left[:-1] == right[:-1]
        assert (left[-1] is None and right[-1] is None) or math.isclose(left[-1], right[-1])


def test_pooled_mean(spark):
    data = [(0, 1, 1, 1.0), (1, 1, 2, 2.0), (2, 2, 1, 6.0)]
    frame = spark.createDataFrame(data, "g_index long, a long, b long, y double")
    space = Space({"a": [1, 2], "b": [1, 2]})
    pooled = SeriesQuery(Plot("f", "y", {"a": "mean", "b": "mean"}, pooled=True), space, frame)
    assert rows(pooled.points()) == [("y", 1, 1, 3.0)]


def test_mean_over_text_axis_and_only_axis(spark):
    frame = spark.createDataFrame([(0, "u", 1, 1.0), (1, "v", 1, 3.0), (2, "u", 2, 5.0)], "g_index long, s string, b long, y double")
    space = Space({"s": ["u", "v"], "b": [1, 2]})
    found = SeriesQuery(Plot("f", "y", {"s": "mean", "b": "variate"}), space, frame)
    assert rows(found.points(), "pos") == [("y", 1, 1, 2.0), ("y", 2, 2, 5.0)]
    alone = SeriesQuery(Plot("f", "y", {"b": "mean"}), Space({"b": [1, 2]}), frame)
    assert rows(alone.points()) == [("y", 1, 1, 3.0)]
    first = SeriesQuery(Plot("f", "y", {"b": "ignore"}), Space({"b": [1, 2]}), frame)
    assert rows(first.points()) == [("y", 1, 1, 1.0)]


def test_empty_series_are_kept(spark):
    space = Space({"a": [1, 2, 3], "k": ["x", "y"]})
    frame = contexts(spark, space, conditions="k = 'x' or a > 5").withColumn("y", F.col("a"))
    found = SeriesQuery(Plot("f", "y", {"a": "variate", "k": "category"}), space, frame)
    assert [(r["k"], r["n_points"]) for r in found.series_sizes().orderBy("series_no").collect()] == [("x", 3), ("y", 0)]


def test_x_and_y_lists(table):
    data = table.withColumns({"xs": F.transform("vresult", lambda v: v * 10)})
    found = query(data, yaxis="vresult", xaxis="xs", axes={"i": "category"})
    assert rows(found.points().where("i = 3"), "pos") == [(3, "vresult", n, 10 * n, n) for n in (1, 2, 3)]


def test_running_total_levels(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 4)
    rng = random.Random(1)
    ids = rng.sample(range(1000), 300)
    data = [(rng.choice("pq"), n, rng.randrange(3)) for n in ids]
    frame = spark.createDataFrame(data, "k string, n long, w long")
    found = running_total(frame, ["k"], [("n", 1000)], "w", "before")
    for row in found.collect():
        assert row["before"] == sum(w for k, n, w in data if k == row["k"] and n < row["n"])
    assert found.count() == 300


def test_long_axes_are_ranked(spark):
    space = Space({"u": {"type": "uniform", "interval": [5, -5], "num": 400}, "s": [f"n{n}" for n in range(70)]})
    frame = contexts(spark, space).withColumn("y", F.col("u"))
    found = SeriesQuery(Plot("f", "y", {"u": "variate", "s": "mean"}), space, frame)
    assert [r["y"] for r in found.points().orderBy("pos").collect()] == pytest.approx(sorted(space["u"]))
    both = all_points([found, SeriesQuery(Plot("f", "y", {"u": "mean", "s": "variate"}), space, frame)])
    assert both.groupBy("plot").count().orderBy("plot").collect() == [(0, 400), (1, 70)]


def test_values_off_the_axes(spark):
    """Plots and series are those of the axes; values off a variate lie between those on it, on long axes too."""
    data = [(0, 1, 0.0, 1.0), (1, 1, 0.5, 2.0), (2, 1, 1.0, 3.0), (3, 7, 0.0, 4.0), (4, None, 0.0, 5.0)]
    table = spark.createDataFrame(data, "g_index long, a long, b double, y double").withColumn("m", F.lit(0.0))
    for many in (2, 200):
        space = Space({"a": [1, 2], "b": [float(i) for i in range(many)], "m": [0.0]})
        plot = Plot("p", "y", {"a": "category", "b": "variate", "m": "mean"})
        found = SeriesQuery(plot, space, table).points()
        assert rows(found.select("a", "pos", "y"), "a", "pos") == [(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0)]
