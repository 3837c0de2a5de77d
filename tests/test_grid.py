from __future__ import annotations

import pytest
from compare import rows
from pyspark.sql import functions as F

from sweepframe import Axis, GradedAxis, Space, StudyError, UniformAxis
from sweepframe.operators import grid as grid_module
from sweepframe.operators.context import contexts, single_context, where


def test_axes():
    assert list(UniformAxis(0, 1, 5)) == [0, 0.25, 0.5, 0.75, 1.0]
    assert list(UniformAxis(2, 5, 1)) == [2.0]
    assert list(GradedAxis(0, 1, 5, 1.2)) == pytest.approx([0, 0.186289, 0.409836, 0.678092, 1.0], abs=1e-6)
    assert list(GradedAxis(0, 1, 3, 1)) == [0, 0.5, 1]
    assert list(GradedAxis(3, 4, 1, 2.0)) == [3]
    assert list(Axis([3, 4.5])) == [3.0, 4.5]
    assert list(Axis([True, False])) == [True, False]


@pytest.mark.parametrize("ratio", [0.4, 0.95, 1.5])
def test_graded_gaps_keep_their_ratio(ratio):
    values = list(GradedAxis(-4, 6, 12, ratio))
    gaps = [b - a for a, b in zip(values, values[1:])]
    assert len(values) == 12 and values[0] == -4 and values[-1] == pytest.approx(6)
    assert [b / a for a, b in zip(gaps, gaps[1:])] == pytest.approx([ratio] * 10)


@pytest.mark.parametrize("bad", [1, "abc", [1, "a"], {"c": 1}, {"type": "uniform", "num": 3}, [[1]], [True, 1]])
def test_bad_axes(bad):
    with pytest.raises(StudyError):
        Space({"a": bad})
    with pytest.raises(StudyError):
        Space(["a"])


def test_uniform_column_equals_list(spark):
    axis = UniformAxis(0.1, 0.7, 13)
    found = spark.range(13).select(axis.at(F.col("id"))).collect()
    assert [r[0] for r in found] == list(axis)


def test_product(spark):
    space = Space({"a": [1, 2], "b": ["x", "y", "z"], "c": {"type": "uniform", "interval": [0, 1], "num": 2}})
    assert space.full_size() == 12
    expected = [(a, b, c) for a in (1, 2) for b in "xyz" for c in (0.0, 1.0)]
    assert [tuple(r)[1:] for r in space.full(spark).orderBy("g_ordinal").collect()] == expected
    assert rows(space.product(spark)) == [(0,)]
    assert space.background() == {"a": 1, "b": "x", "c": 0.0}
    assert space.product(spark, "c", "a").drop("g_ordinal").columns == ["c", "a"]
    assert Space({"a": []}).full(spark).count() == 0


@pytest.mark.parametrize("per_partition", [10**6, 3])
def test_dense_index(spark, monkeypatch, per_partition):
    monkeypatch.setattr(grid_module, "POINTS_PER_PARTITION", per_partition)
    space = Space({"a": [1, 2, 3, 4], "b": [1, 2, 3, 4]})
    found = rows(contexts(spark, space, conditions="a < b"), "g_index")
    assert found == [(0, 1, 2), (1, 1, 3), (2, 1, 4), (3, 2, 3), (4, 2, 4), (5, 3, 4)]


def test_dense_index_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(grid_module, "POINTS_PER_PARTITION", 1000)
    space = Space({"a": list(range(100)), "b": list(range(100))})
    kept = contexts(spark, space, conditions="(a * 100 + b) % 7 in (1, 3)")
    expected = [i for i in range(10000) if i % 7 in (1, 3)]
    assert rows(kept, "g_index") == [(k, i // 100, i % 100) for k, i in enumerate(expected)]
    # A frame built on top must not disturb the numbering.
    assert kept.repartition(3).where("g_index = 17").count() == 1


def test_evaluate_order_and_constants(spark):
    space = Space({"alpha": [1, 2, 3], "bravo": ["a", "b", "c"]})
    made = contexts(
        spark, space, None, {"k": 10, "alpha": 99}, {"charlie": "2*alpha - 1", "d": "charlie + k", "bravo": "upper(bravo)"},
        logdir="${alpha}-${bravo}", with_logdir=True,
    )
    found = rows(made.select("alpha", "bravo", "charlie", "d", "g_logdir"), "g_index")
    assert found[0] == (1, "A", 1, 11, "1-A")
    assert [r[2] for r in found] == [1, 1, 1, 3, 3, 3, 5, 5, 5]


def test_evaluate_errors_abort(spark):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        contexts(spark, Space({"a": [0, 1]}), evaluables={"b": "1 / a"}).collect()
    with pytest.raises(StudyError):
        contexts(spark, Space({"a": [0]}), evaluables={"kek": [1, 2]})
    with pytest.raises(StudyError):
        contexts(spark, Space({"a": [0]}), evaluables=[1])


def test_where_truthiness(spark):
    df = spark.createDataFrame([(0, "x"), (1, ""), (2, None), (3, "y")], "a long, s string")
    assert rows(where(df, "1 / a > 0.4").select("a"), "a") == [(1,), (2,)]
    assert rows(where(df, ["a", "s"]).select("a"), "a") == [(3,)]
    assert where(df, []).count() == 4
    assert rows(where(df, lambda c: c["a"] > 1).select("a"), "a") == [(2,), (3,)]
    assert where(df, "cast(s as int) = 1").count() == 0
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_function_forms(spark):
    made = contexts(
        spark, Space({"a": [1, 2]}), evaluables=lambda c: {"b": c["a"] * 2, "c": 7},
        conditions=lambda c: c["b"] > 2, logdir=lambda c: F.concat(F.lit("p"), c["b"].cast("string")), with_logdir=True,
    )
    assert rows(made) == [(0, 2, 4, 7, "p4")]


def test_single_context(spark):
    made = single_context(spark, {"a": 3}, {"k": 1}, {"b": "a + k"}, index=5)
    assert made.first().asDict() == {"a": 3, "g_index": 5, "k": 1, "b": 4, "g_logdir": "5"}
