from __future__ import annotations

import json
import random

import pytest
from compare import rows
from pyspark.sql import functions as F

from sweepframe import Capture, Plot, Step, StepFailed, Study, StudyError
from sweepframe.operators.collect import collect, state_flags, status_counts, upsert, with_status
from sweepframe.operators.steps import assemble, fail_fast, run_metadata


def echo_study(spark, root):
    def echo(context):
        return f"a={context['alpha']} b={context['bravo']} c={context['charlie']}\n"

    return Study(
        spark,
        {"alpha": [1, 2, 3], "bravo": ["a", "b", "c"]},
        evaluate={"charlie": "2 * alpha - 1"},
        logdir="${alpha}-${bravo}",
        steps=[Step("echo", echo)],
        captures=[r"a=(?P<a>\S+) b=(?P<b>\S+) c=(?P<c>\S+)", {"type": "integer", "name": "a_auto", "prefix": "a="}],
        types={"a": "int", "b": "str", "c": "float"},
        plots=[Plot("plot", "charlie", {"alpha": "variate", "bravo": "category"})],
        root=str(root),
        sourcedir="/src",
    )


def expected_flags(**true):
    names = ("is_running", "has_data", "has_captured", "has_collected", "has_plotted")
    return {name: true.get(name, False) for name in names}


def test_whole_life(spark, tmp_path):
    study = echo_study(spark, tmp_path / "s")
    assert study.flags() == expected_flags(has_captured=True)
    empty = study.load_table()
    assert empty.count() == 0 and dict(empty.dtypes)["a"] == "bigint" and dict(empty.dtypes)["c"] == "double"

    created = study.create_instances()
    assert {r["status"] for r in created.collect()} == {"created"} and created.count() == 9
    assert study.flags() == expected_flags()

    study.run()
    assert study.flags() == expected_flags(has_data=True, has_captured=True)
    assert study.instances("downloaded").count() == 9 and study.instances("created").count() == 0
    assert study.instance(4).first()["logdir"] == "2-b"

    before = study.instances().select("g_index", "captured").orderBy("g_index").collect()
    study.capture()
    assert study.instances().select("g_index", "captured").orderBy("g_index").collect() == before

    table = study.collect()
    assert study.flags() == expected_flags(has_data=True, has_captured=True, has_collected=True)
    wanted = ["g_index", "alpha", "bravo", "charlie", "a", "b", "c", "a_auto", "g_success", "g_logdir", "g_sourcedir"]
    assert rows(table.select(*wanted), "g_index") == [
        (3 * (a - 1) + n, a, b, 2 * a - 1, a, b, 2.0 * a - 1, a, True, f"{a}-{b}", "/src")
        for a in (1, 2, 3) for n, b in enumerate("abc")
    ]
    assert set(table.columns) == {*wanted, "g_started", "g_finished", "g_walltime_echo"}
    assert dict(study.load_table().dtypes) == dict(empty.dtypes)

    (found,) = study.plot()
    assert study.flags()["has_plotted"]
    assert [r["y"] for r in found.points().where("bravo = 'b'").orderBy("pos").collect()] == [1, 3, 5]
    assert found.wide().orderBy("pos").columns[1:] == [
        f"bravo='{b}' (charlie){x}" for b in "abc" for x in (" (x-axis)", "")
    ]

    study.dump(str(tmp_path / "dump"))
    dumped = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "dump")).collect()]
    assert len(dumped) == 9 and list(dumped[0]) == sorted(dumped[0]) and "g_index" not in dumped[0]

    study.run()
    assert study.flags() == expected_flags(has_data=True, has_captured=True)
    study.collect()
    study.clear_table()
    assert not study.flags()["has_collected"] and study.load_table().count() == 0
    study.clear()
    assert study.flags() == expected_flags(has_captured=True)


def test_points_fail_on_their_own(spark, tmp_path):
    def solve(context):
        if context["load"] > 2:
            raise StepFailed(f"load {context['load']} is too much\niterations= 99\n")
        return f"iterations= {3 * context['load']}\n"

    study = Study(
        spark, {"load": [1, 2, 3]}, root=str(tmp_path / "f"),
        steps=[Step("mesh", lambda c: "nodes= 64"), Step("solve", solve), Step("report", lambda c: "pages= 5")],
        captures=[Capture.simple("integer", name, f"{name}=", mode="first", command=step)
                  for name, step in (("nodes", "mesh"), ("iterations", "solve"), ("pages", "report"))],
    )
    study.run()
    found = study.collect().select("load", "nodes", "iterations", "pages", "g_success")
    assert rows(found, "load") == [(1, 64, 3, 5, True), (2, 64, 6, 5, True), (3, 64, 99, None, False)]
    times = study.load_table().orderBy("g_index").select("g_walltime_report").collect()
    assert [t[0] is None for t in times] == [False, False, True]


def test_capture_leaves_swept_instances(spark, tmp_path, tables):
    orders = spark.read.parquet(f"{tables}/orders.parquet")
    study = Study(spark, {"status": ["F", "O"]}, root=str(tmp_path / "w"))
    study.run_sweep(orders, on=[("o_orderstatus", "=", "status")], aggs={"n": ("count", None)})
    before = study.instances().select("g_index", "captured").orderBy("g_index").collect()
    study.capture()
    assert study.instances().select("g_index", "captured").orderBy("g_index").collect() == before


def test_retry_allow_failure_and_context_steps(spark, tmp_path):
    class Flaky:
        def __init__(self):
            self.calls = 0

        def __call__(self, context):
            self.calls += 1
            if self.calls % 3:
                raise ValueError("not yet")
            return f"calls={self.calls}"

    def steps(context):
        chosen = [Step("flaky", Flaky(), retry_on_fail=True), Step("bad", lambda c: 1 / 0, allow_failure=True)]
        return [*chosen, Step("odd", lambda c: "n=1")] if context["a"] % 2 else chosen

    study = Study(spark, {"a": [1, 2]}, steps=steps, captures=[{"type": "integer", "name": "calls", "prefix": "calls"}], root=str(tmp_path / "r"))
    study.run()
    found = study.collect().select("calls", "g_success", F.col("g_walltime_odd").isNotNull())
    assert rows(found, "calls", F.col("g_walltime_odd").isNotNull().desc()) == [(3, True, True), (3, True, False)]
    study.run_single(index=9, a=4)
    assert study.collect().where("g_index = 9").select("a", "calls").first() == (4, 3)
    assert study.load_table().count() == 3


def test_study_errors(spark):
    with pytest.raises(StudyError, match="unique"):
        Study(spark, {}, steps=[Step("a", str), Step("a", str)])
    with pytest.raises(StudyError, match="root"):
        Study(spark, {"a": [1]}).flags()
    with pytest.raises(StudyError):
        Study(spark, ["a"])
    with pytest.raises(StudyError):
        with_status(spark.range(1), ["lost"])


def test_upsert(spark):
    old = spark.createDataFrame([(0, 1, "x"), (1, 2, "y"), (2, 3, "z")], "g_index long, a int, s string")
    new = spark.createDataFrame([(1, 2.5, True), (5, 7.0, None)], "g_index long, a double, b boolean")
    assert rows(upsert(old, new), "g_index") == [
        (0, 1.0, "x", None), (1, 2.5, None, True), (2, 3.0, "z", None), (5, 7.0, None, None),
    ]
    with pytest.raises(StudyError, match="merge"):
        upsert(old, new.withColumn("s", F.lit(1)))


def test_collect_and_flags(spark):
    made = spark.createDataFrame(
        [(1, "downloaded", (1, float("nan"))), (0, "downloaded", (0, 2.0)), (2, "started", None)],
        "g_index long, status string, captured struct<g_index: long, v: double>",
    )
    old = spark.createDataFrame([(0, 1.0), (3, 4.0)], "g_index long, v double")
    assert rows(collect(old, made)) == [(0, 2.0), (1, None), (3, 4.0)]
    assert rows(status_counts(made), "status") == [("downloaded", 2), ("started", 1)]
    assert rows(state_flags(made)) == [(True, True, False)]
    assert rows(state_flags(made.limit(0))) == [(False, False, True)]


def test_fail_fast_and_metadata(spark):
    rng = random.Random(3)
    data = [
        (g, n, rng.choice("pqr"), rng.random() < 0.7, rng.random() < 0.3, rng.random())
        for g in range(30) for n in range(rng.randrange(1, 6))
    ]
    columns = "g_index long, step_no int, command string, ok boolean, allow_failure boolean, walltime double"
    records = spark.createDataFrame(data, columns).withColumns({"started": F.current_timestamp(), "finished": F.current_timestamp()})
    kept = []
    for g in range(30):
        for row in (r for r in data if r[0] == g):
            kept.append(row)
            if not row[3] and not row[4]:
                break
    found = fail_fast(records)
    assert rows(found.select(*records.columns[:6]), "g_index", "step_no") == kept
    meta = run_metadata(found, ["p", "q", "r"])
    for row in meta.collect():
        mine = [r for r in kept if r[0] == row["g_index"]]
        assert row["g_success"] == all(r[3] or r[4] for r in mine)
        for name in "pqr":
            assert row[f"g_walltime_{name}"] == next((r[5] for r in reversed(mine) if r[2] == name), None)


def test_assemble(spark):
    left = spark.createDataFrame([(0, 1, "a"), (1, 2, "b")], "g_index long, x long, s string")
    right = spark.createDataFrame([(0, 9, True)], "g_index long, x long, t boolean")
    assert rows(assemble(left, right).select("g_index", "x", "s", "t"), "g_index") == [(0, 9, "a", True), (1, 2, "b", None)]


def test_life_cycle(spark, tmp_path, monkeypatch):
    study = Study(spark, {"a": [1, 2]}, evaluate={"home": "concat(g_sourcedir, '/', a)"}, steps=[Step("say", lambda c: c["home"])],
                  captures=[Capture("(?P<said>.+)")], root=str(tmp_path / "l"), sourcedir="/src", logdir="${home}")
    seen = []

    def note():
        seen.append({r["status"] for r in study.instances().collect()})
        assert study.flags()["is_running"] == (seen[-1] <= {"prepared", "started"})

    def noting(function):
        def run(*args, **kwargs):
            if args[:1] == ("logs",) or "phase" in kwargs:
                note()
            return function(*args, **kwargs)
        return run

    monkeypatch.setattr(study.store, "write", noting(study.store.write))
    monkeypatch.setattr(study.store, "commit", noting(study.store.commit))
    study.run()
    note()
    order = [s for s, before in zip(seen, [None, *seen]) if s != before and s]
    assert order == [{"created"}, {"prepared"}, {"started"}, {"finished"}, {"downloaded"}]
    assert rows(study.collect().select("a", "said", "g_logdir"), "a") == [(1, "/src/1", "/src/1"), (2, "/src/2", "/src/2")]
