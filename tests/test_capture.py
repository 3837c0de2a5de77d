from __future__ import annotations

import random
import re

import pytest
from compare import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sweepframe import Capture, StudyError
from sweepframe.functions.regex import to_java
from sweepframe.operators import capture as cap
from sweepframe.operators.capture import as_captures, capture_instances, capture_long, capture_text
from sweepframe.types import declared_types

def solver_log(residuals, cells):
    """A solver's output: one line per step, with a residual and a number of cells."""
    steps = zip(residuals, cells)
    return "start\n" + "".join(f"step {n}: residual= {r!r}, {c} cells\n" for n, (r, c) in enumerate(steps)) + "done\n"


def test_modes_and_types(spark):
    runs = {10: ([0.5, 0.125, 3e-3], [40, 44, 52]), 11: ([2.0], [7]), 12: ([], [])}
    df = spark.createDataFrame([(i, solver_log(*run)) for i, run in runs.items()], "g_index long, text string")
    captures = [Capture.simple("float", f"res_{mode}", "residual=", mode=mode) for mode in ("first", "last", "all")]
    captures += [Capture.simple("integer", f"step_{mode}", "step", mode=mode) for mode in ("first", "last", "all")]
    found = capture_text(df, "text", captures).drop("text").orderBy("g_index")
    kinds = [f.dataType.simpleString() for f in found.schema][1:]
    assert kinds == ["double", "double", "array<double>", "bigint", "bigint", "array<bigint>"]
    many, one, empty = found.collect()
    assert (many["res_first"], many["res_last"], many["res_all"]) == (0.5, 0.003, [0.5, 0.125, 0.003])
    assert (many["step_first"], many["step_last"], many["step_all"]) == (0, 2, [0, 1, 2])
    assert (one["res_all"], one["step_last"]) == ([2.0], 0)
    assert empty["res_first"] is None and empty["step_last"] is None


def test_regex_capture_with_declared_types(spark):
    df = spark.createDataFrame([(0, "a=1 b=x c=2.5"), (1, "nothing")], "g_index long, text string")
    found = capture_text(
        df, "text", as_captures(r"a=(?P<a>\S+) b=(?P<b>\S+) c=(?P<c>\S+)"),
        declared_types({"a": "int", "b": "str", "c": "float"}),
    )
    assert rows(found.drop("text"), "g_index") == [(0, 1, "x", 2.5), (1, None, None, None)]


def test_skip_words_and_flexible_prefix(spark):
    df = spark.createDataFrame([("total  run   time =  of  the 42 and total run time of the 7",)], "text string")
    one = Capture.simple("integer", "n", "total run time", skip_words=2, flexible_prefix=True, mode="all")
    two = Capture.simple("integer", "m", "total run time", skip_words=2, mode="all")
    assert rows(capture_text(df, "text", [one, two]).drop("text")) == [([42, 7], [7])]


def test_strict_and_lenient(spark):
    df = spark.createDataFrame([("v=abc",)], "text string")
    capture = [Capture(r"v=(?P<v>\w+)", kind="int")]
    assert rows(capture_text(df, "text", capture, strict=False).select("v")) == [(None,)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        capture_text(df, "text", capture).collect()


def test_instances(spark):
    texts = spark.createDataFrame(
        [(0, 1, "n=2 n=3 s=a"), (0, 0, "n=1 s=b"), (1, 0, "s=c"), (1, 1, "none"), (2, 0, "")],
        "g_index long, cmd_no int, text string",
    )
    captures = [Capture.simple("integer", "n", "n", mode="all"), Capture(r"s=(?P<s>\w)")]
    assert rows(capture_instances(texts, captures), "g_index") == [
        (0, [1, 2, 3], "a"), (1, None, "c"), (2, None, None),
    ]
    long = capture_long(texts, captures).select("g_index", "cmd_no", "name", "pos", "value")
    assert rows(long, "g_index", "cmd_no", "name", "pos") == [
        (0, 0, "n", 0, "1"), (0, 0, "s", 0, "b"), (0, 1, "n", 0, "2"), (0, 1, "n", 1, "3"), (0, 1, "s", 0, "a"),
        (1, 0, "s", 0, "c"),
    ]


def test_commands_and_repeated_names(spark):
    texts = spark.createDataFrame(
        [(0, 0, "one", "v=1"), (0, 1, "two", "v=2 w=5")], "g_index long, cmd_no int, command string, text string"
    )
    captures = as_captures([
        {"type": "integer", "name": "v", "prefix": "v", "command": "one"},
        {"type": "integer", "name": "w", "prefix": "v", "command": "two"},
        {"type": "integer", "name": "w", "prefix": "w", "command": "two"},
    ])
    assert rows(capture_instances(texts, captures)) == [(0, 1, 5)]


def test_legacy_untyped_all(spark):
    df = spark.createDataFrame([("a=1 a=2",)], "text string")
    both = [Capture(r"a=(?P<x>\d)", "all"), Capture(r"a=(?P<y>\d)", "all", legacy_untyped_all=True)]
    assert rows(capture_text(df, "text", both).drop("text")) == [(["1", "2"], "2")]


@pytest.mark.parametrize(
    "make",
    [
        lambda: Capture("(?P<a>x", "last"),
        lambda: Capture("(?P<a>x)", "middle"),
        lambda: Capture("(?P<a>x)(?(a)y|z)"),
        lambda: Capture("(?P<a>x)", kind="date"),
        lambda: Capture.simple("text", "a", "b"),
        lambda: as_captures([{"type": "integer", "name": "a"}]),
    ],
)
def test_bad_captures(make):
    with pytest.raises(StudyError):
        make()


TEXTS = [
    "", "a", "b", "ab", "aab\n", "x[1]&&y", "x=1\r\nx=2\r\n", "Àé é z", "٣ 4", "a{2}", "{,3}", "]^-[",
    "tab\there\x0bv", "abcabc abab", "line sep\u0085nel\nlast\n", "\x1c \x1f", "1. .5 2e3 -7E-2 +8", "ſK",
]
PATTERNS = [
    r"(?P<g>a)?(b)", r"(?P<g>a*)b", r"(?P<g>.+)$", r"(?P<g>\w+)", r"(?P<g>\d+)", r"(?P<g>\s)", r"(?P<g>[[\]&^]+)",
    r"(?P<g>[&&a-b]+)", r"(?P<g>x{,2}=\d)", r"(?P<g>a{2}|a\{2})", r"(?P<g>{,|{x}|\{,3\})", r"(?P<g>a|b)(?P=g)?", r"(?P<g>\Bb)|(c)",
    r"(?i)(?P<g>K|S)", r"(?m)^(?P<g>x=\d)", r"(?s)(?P<g>a.*)\Z", r"(?P<g>(?:abc)+|(?:ab)\b)", r"(?#note)(?P<g>[^\s]\S*)",
    r"(?P<g>\x41|\141|é)", r"(?P<g>[\s\d]+)", r"(?P<g>\v|\t)", r"(?a:(?P<g>\w+))", r"(ab)(?P<g>c)\1", r"(?P<g>(?<=x)=(?=\d))",
    r"(?P<g>[-+]?(?:(?:\d*\.\d+)|(?:\d+\.?))(?:[Ee][+-]?\d+)?)", r"(?P<g>\b\w)", r"(?P<g>[^\n]*)",
]


def expected(pattern, mode, text):
    found = [m.group("g") for m in re.finditer(pattern, text)]
    if mode == "all":
        return found or None
    return None if not found else found[0 if mode == "first" else -1]


@pytest.mark.parametrize("mode", ["first", "last", "all"])
def test_same_as_python_patterns(spark, mode):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "n int, text string")
    found = df
    for number, pattern in enumerate(PATTERNS):
        found = capture_text(found, "text", [Capture(pattern.replace("(?P<g>", f"(?P<g{number}>").replace("(?P=g)", f"(?P=g{number})"), mode)])
    for row in found.collect():
        for number, pattern in enumerate(PATTERNS):
            assert row[f"g{number}"] == expected(pattern, mode, row["text"]), (pattern, row["text"])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab 12.:=+-eE\n", max_size=30), min_size=10, max_size=80))
def test_same_as_python_numbers(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    captures = {
        name: Capture.simple(kind, name, "a", skip_words=skip, mode=mode)
        for name, kind, skip, mode in (("x", "integer", 0, "last"), ("y", "float", 1, "all"), ("z", "float", 0, "first"))
    }
    plain = {"x": r"a\s*[:=]?\s*([-+]?[0-9]+)"}
    number = r"([-+]?(?:(?:\d*\.\d+)|(?:\d+\.?))(?:[Ee][+-]?\d+)?)"
    plain |= {"y": r"a\s*[:=]?\s*(?:\S+\s+){1}" + number, "z": r"a\s*[:=]?\s*" + number}
    found = {r["n"]: r for r in capture_text(df, "text", list(captures.values())).collect()}
    for number, text in enumerate(texts):
        for name, capture in captures.items():
            convert = int if name == "x" else float
            values = [convert(m.group(1)) for m in re.finditer(plain[name], text)]
            want = (values or None) if capture.mode == "all" else None if not values else values[0 if capture.mode == "first" else -1]
            assert found[number][name] == want, (text, capture.pattern)


def test_group_facts():
    java = to_java(r"(?P<a>x)?(?P<b>y*)(?P<c>z)(?:(?P<d>q)|r)")
    assert java.groups == {"a": 1, "b": 2, "c": 3, "d": 4}
    assert java.nonempty == {"a", "c", "d"} and java.optional == {"a", "d"}


@pytest.mark.parametrize("length", [1, 7, 1000])
def test_segments_are_the_lists(spark, monkeypatch, length):
    monkeypatch.setattr("sweepframe.operators.ranking.BLOCK", 10)
    rng = random.Random(length)
    data = [(i % 4 if i % 4 else None, i, " ".join(rng.choice(["a=1", "a=-2.5", "b=x", "b=", "c 7", "none"]) for _ in range(rng.randrange(9)))) for i in range(60)]
    texts = spark.createDataFrame(data, "g_index long, cmd_no long, text string")
    captures = [Capture(r"a=(?P<a>[-.0-9]+)", "all", "float"), Capture(r"b=(?P<b>x)?", "all"), Capture(r"c (?P<c>[0-9])", "last", "int"), Capture(r"a=(?P<first>[-.0-9]+)", "first")]
    whole = {r["g_index"]: r for r in cap.capture_instances(texts, captures).collect()}
    single, lists = cap.capture_segments(texts, captures, length=length)
    assert {r["g_index"]: (r["c"], r["first"]) for r in single.collect()} == {k: (r["c"], r["first"]) for k, r in whole.items()}
    found: dict = {}
    for r in sorted(lists.collect(), key=lambda r: r["segment"]):
        for name in ("a", "b"):
            assert r[name] is None or 0 < len(r[name]) <= length
            found.setdefault((r["g_index"], name), []).extend(r[name] or [])
    assert found == {(k, n): r[n] or [] for k, r in whole.items() for n in ("a", "b")}
    single, lists = cap.capture_segments(texts, captures[2:], length=length)
    assert lists.count() == 0 and single.count() == 4


def test_one_instance_with_millions_of_matches(spark):
    texts = spark.range(0, 2000, 1, 16).select(F.lit(1).cast("long").alias("g_index"), F.col("id").alias("cmd_no"), F.repeat(F.concat(F.lit("v="), "id", F.lit(" ")), 1500).alias("text"))
    _, lists = cap.capture_segments(texts, [Capture("v=(?P<v>[0-9]+)", "all", "int")], length=50_000)
    sizes = lists.select("segment", F.size("v").alias("n"), F.array_min("v").alias("low"), F.array_max("v").alias("high")).orderBy("segment").collect()
    assert len(sizes) == 60 and all(r["n"] == 50_000 for r in sizes)
    assert [(r["low"], r["high"]) for r in sizes[:2]] == [(0, 33), (33, 66)] and sizes[-1]["high"] == 1999
