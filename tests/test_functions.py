from __future__ import annotations

import random

import numpy as np
import pytest
from compare import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sweepframe import StudyError
from sweepframe.functions.arrays import flatten_rows, flexible_mean
from sweepframe.functions.scalar import legendre, register_functions, rnd, sci
from sweepframe.functions.template import render, split_template
from sweepframe.operators.context import evaluate
from sweepframe.types import (
    ANY, BOOLEAN, DATETIME, FLOATING, INTEGER, STRING, apply_schema, declared_types, infer_schema, merge_all,
    merge_types, record_types, system_type, type_from_name, type_name, type_of_value,
)


@pytest.mark.parametrize("degree", range(12))
def test_legendre(spark, degree):
    a, b = -1.5, 4.0
    xs = [float(x) for x in np.linspace(a, b, 41)]
    df = spark.createDataFrame([(degree, x) for x in xs], "n int, x double")
    register_functions(spark)
    found = df.select(legendre(degree, a, b, F.col("x")), F.expr(f"legendre(n, {a}, {b}, x)")).collect()
    expected = np.polynomial.Legendre([0] * degree + [1], [a, b])(np.array(xs))
    assert np.allclose([r[0] for r in found], expected, atol=1e-12)
    assert np.allclose([r[1] for r in found], expected, atol=1e-12)


def test_fixed_and_scientific(spark):
    rng = random.Random(11)
    values = [0.125, 2.675, 2.5, 0.5, 1.5, -0.5, -1.005, 0.005, 0.015, 1e-7, 12345.678, 0.0, -0.001, 1024.35, 5e-5, 1e22,
              2.5e-7, 1.5e15, 45.0, 35.0, 1.25e10, 123456789012345.5, 1e16 + 2, 4.35e17, float("inf"), float("nan")]
    values += [rng.choice([1, -1]) * rng.randrange(10**6) * 10.0 ** -rng.randrange(8) for _ in range(200)]
    values += [rng.choice([1, -1]) * (rng.randrange(10 ** rng.randrange(1, 9)) * 10 + 5) / 10.0 ** rng.randrange(12) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    digits = range(7)
    found = df.select("x", *(f(F.col("x"), n) for f in (rnd, sci) for n in digits)).collect()
    for row in found:
        if np.isfinite(row[0]):
            assert list(row)[1:] == [format(row[0], f".{n}{kind}") for kind in "fe" for n in digits], row[0]
    assert rows(spark.sql("select rnd(1.23456D, 3), sci(12345.678D, 2), ord('a')")) == [("1.235", "1.23e+04", 97)]


def test_float_text_is_as_python(spark):
    rng = random.Random(5)
    values = [0.0, -0.0, 1.0, 0.001, 0.0001, 0.00012, 0.00001, 1e7, 1.5e10, 123456789.125, 1e15, 1e16, 1e22, 1.5e-300,
              float("inf"), float("-inf"), float("nan"), 9999999.0, 1e-4, -2.5e-4, -1e7, 12345678912345.678]
    values += [rng.choice([-1, 1]) * round(rng.random() * 10.0 ** rng.randrange(-8, 20), 5) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = df.select("x", render(df, "${x}").alias("t")).collect()
    assert [r["t"] for r in found] == [str(v) for v in values]


def test_render(spark):
    df = spark.createDataFrame([(1, "it's", True, [1.5, 2.0], None)], "i long, s string, b boolean, l array<double>, n string")
    cases = {
        "plain": "plain", "": "", "${i}-${s}": "1-it's", "${i + 1}/${concat(s, '}')}": "2/it's}", "${b} ${l} ${n}": "True [1.5, 2.0] None",
        "${rnd(i / 3, 2)}|${upper(s)}": "0.33|IT'S", "$i {i} $${i}": "$i {i} $1",
    }
    for template, expected in cases.items():
        assert df.select(render(df, template)).first()[0] == expected, template
    assert df.select(render(df, None)).first()[0] is None
    assert rows(df.select(*render(df, ["a${i}", "b"]), render(df, {"k": "${s}"})["k"])) == [("a1", "b", "it's")]
    assert df.select(render(df.select(F.array(F.lit("a"), F.lit("b'c")).alias("v")), "${array('a', 'b')}")).first()[0] == "['a', 'b']"
    for bad in ("${i", "% if x:\n", "<% y %>", 5):
        with pytest.raises(StudyError):
            render(df, bad)
    assert split_template("a${b['}']}c") == [(False, "a"), (True, "b['}']"), (False, "c")]


def test_math_in_expressions(spark):
    df = spark.createDataFrame([(2, "b")], "j long, k string")
    made = evaluate(df, {"a": "log(j)", "o": "ord(k)", "p": "pow(j, 3)", "s": "sin(j) + cos(j)", "c": 3})
    found = made.first()
    assert found["a"] == pytest.approx(np.log(2)) and (found["o"], found["p"], found["c"]) == (98, 8.0, 3)


def test_flatten_and_means(spark):
    df = spark.createDataFrame([(0, "x", [1, 2], 1), (1, "x", [3, 5], None), (2, "y", [7], 4)], "n long, k string, l array<long>, v long")
    assert rows(flatten_rows(df.select("n", "l"), "l"), "n", "pos") == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 5), (2, 0, 7)]
    assert rows(flatten_rows(df.select("n", "v"), "v"), "n") == [(0, 0, 1), (1, 0, None), (2, 0, 4)]
    assert rows(flexible_mean(df, ["k"], ["l", "v"]), "k") == [("x", [2.0, 3.5], 1.0), ("y", [7.0], 4.0)]
    with pytest.raises(Exception, match="unequal length"):
        flexible_mean(df, [], ["l"]).collect()
    with pytest.raises(StudyError):
        flexible_mean(df, [], ["k"])
    nan = spark.createDataFrame([(float("nan"),), (2.0,)], "x double")
    assert rows(flexible_mean(nan, [], ["x"])) == [(2.0,)]


def test_types_of_values():
    from datetime import datetime

    cases = [(True, BOOLEAN), ("a", STRING), (1, INTEGER), (1.0, FLOATING), (datetime.now(), DATETIME), ([1, "a"], T.ArrayType(INTEGER)), ([], T.ArrayType(ANY)), (None, ANY)]
    for value, tp in cases:
        assert type_of_value(value) == tp
        assert type_from_name(type_name(tp)) == tp
    with pytest.raises(StudyError):
        type_of_value(object())


def test_merging():
    listed = T.ArrayType
    good = [
        (INTEGER, FLOATING, FLOATING), (ANY, STRING, STRING), (STRING, ANY, STRING), (STRING, DATETIME, DATETIME),
        (BOOLEAN, STRING, BOOLEAN), (listed(INTEGER), listed(FLOATING), listed(FLOATING)), (ANY, listed(STRING), listed(STRING)),
        (listed(ANY), listed(INTEGER), listed(INTEGER)),
    ]
    for left, right, expected in good:
        assert merge_types(left, right) == expected
    for left, right in [(INTEGER, STRING), (BOOLEAN, INTEGER), (listed(INTEGER), INTEGER), (listed(INTEGER), ANY), (DATETIME, FLOATING)]:
        with pytest.raises(StudyError):
            merge_types(left, right)
    assert merge_all([INTEGER, INTEGER, FLOATING, ANY]) == FLOATING
    nested = [listed(listed(INTEGER)), listed(ANY), ANY, listed(listed(ANY))]
    for start in range(4):
        assert merge_all(nested[start:] + nested[:start]) == listed(listed(INTEGER))


def test_inference(spark):
    records = spark.createDataFrame(
        [('{"a": 1, "b": "x", "l": [1, 2.5], "n": null, "g_walltime_x": "0.5"}',), ('{"a": 2.0, "b": true, "l": [], "c": [[1]]}',), ("{}",)],
        "r string",
    )
    assert (("a", "integer") in rows(record_types(records, "r"))) and ("l", "list(any)") in rows(record_types(records, "r"))
    found = {f.name: f.dataType for f in infer_schema(records, "r")}
    assert found == {"a": FLOATING, "b": BOOLEAN, "l": T.ArrayType(INTEGER), "n": ANY, "g_walltime_x": FLOATING, "c": T.ArrayType(ANY)}
    bad = spark.createDataFrame([('{"a": 1}',), ('{"a": "x"}',)], "r string")
    with pytest.raises(StudyError):
        infer_schema(bad, "r")


def test_declared_and_applied(spark):
    assert declared_types({"a": "int", "b": "double", "c": "str"}) == {"a": INTEGER, "b": FLOATING, "c": STRING}
    with pytest.raises(StudyError):
        declared_types({"a": "date"})
    assert system_type("g_walltime_sh") == FLOATING and system_type("g_success") == BOOLEAN and system_type("x") is None
    schema = T.StructType([T.StructField("b", FLOATING), T.StructField("a", STRING), T.StructField("c", ANY)])
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert rows(apply_schema(df, schema)) == [(2.0, "1", None)]
    assert apply_schema(df.limit(0), schema).dtypes == [("b", "double"), ("a", "string"), ("c", "string")]


def test_lists_of_different_lengths_are_averaged_together(spark):
    data = [("x", [1, 2, 3], [0.5], None), ("x", [3, 4, None], None, None), ("y", [], [1.0, 2.0], None), (None, None, [4.0], None)]
    df = spark.createDataFrame(data, "k string, a array<int>, b array<double>, c array<int>")
    want = [(None, None, [4.0], None), ("x", [2.0, 3.0, 3.0], [0.5], None), ("y", [], [1.0, 2.0], None)]
    found = [tuple(r) for r in flexible_mean(df, ["k"], ["a", "b", "c"]).collect()]
    assert sorted(found, key=lambda r: r[0] or "") == want
