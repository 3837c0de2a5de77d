"""Stored tables in parts: what is written, what is read, what is removed."""

from __future__ import annotations

from pathlib import Path

import pytest
from compare import rows
from pyspark.sql import functions as F

from sweepframe import Capture, Step, Study
from sweepframe.operators.collect import captured_rows, upsert
from sweepframe.sources.store import StudyStore


def size(folder) -> int:
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def numbers(spark, start, end, **columns):
    return spark.range(start, end).toDF("g_index").withColumns({"x": F.col("g_index") * 3, **columns})


def test_upsert_writes_only_touched_parts(spark, tmp_path):
    store = StudyStore(spark, str(tmp_path / "s"), width=1000)
    store.commit(table=store.write("table", numbers(spark, -1500, 20_000)))
    before, old = store.parts("table").paths, store.read("table")
    assert sorted(before) == list(range(-2, 20)) and store.read("table").count() == 21_500
    whole = size(tmp_path)
    changed = numbers(spark, 2500, 2510).unionByName(numbers(spark, -3, 2)).withColumn("x", F.lit(-1).cast("long"))
    added = numbers(spark, 50_000, 50_700)
    wanted = upsert(upsert(old, changed), added)
    store.commit(table=store.upsert("table", changed))
    assert size(tmp_path) - whole < 0.3 * whole
    after = store.parts("table").paths
    assert {k for k in after if after[k] != before.get(k)} == {-1, 0, 2}
    # What fills a part alone is written once.
    versions = len(list((tmp_path / "s/table").iterdir()))
    store.commit(table=store.upsert("table", added))
    assert len(list((tmp_path / "s/table").iterdir())) == versions + 1
    assert rows(store.read("table"), "g_index") == rows(wanted, "g_index")
    assert rows(store.read("table", [2]), "g_index") == rows(wanted.where("g_index between 2000 and 2999"), "g_index")
    # Another object at the same place, spelled otherwise, sees the same table.
    again = StudyStore(spark, f"file://{tmp_path}/s/", width=1000)
    assert rows(again.read("table"), "g_index") == rows(wanted, "g_index")


def test_upsert_of_many_rows_an_index(spark, tmp_path):
    store = StudyStore(spark, str(tmp_path / "s"), width=10)
    logs = spark.createDataFrame([(i, n, f"{i}-{n}") for i in range(40) for n in range(i % 4 + 1)], "g_index long, n int, text string")
    store.commit(logs=store.write("logs", logs))
    new = spark.createDataFrame([(i, n, "new") for i in (3, 17, 99) for n in range(6)], "g_index long, n int, text string")
    store.commit(logs=store.upsert("logs", new))
    assert rows(store.read("logs"), "g_index", "n") == rows(upsert(logs, new), "g_index", "n")
    store.commit(logs=store.upsert("logs", new.where("false")))
    assert rows(store.read("logs"), "g_index", "n") == rows(upsert(logs, new), "g_index", "n")


def test_types_that_grow_rewrite_the_table(spark, tmp_path):
    store = StudyStore(spark, str(tmp_path / "s"), width=5)
    old = spark.createDataFrame([(i, i, {"a": i}) for i in range(12)], "g_index long, v int, c struct<a: int>")
    new = spark.createDataFrame([(3, 2.5, {"a": 1, "b": "z"}, True)], "g_index long, v double, c struct<a: int, b: string>, t boolean")
    store.commit(table=store.write("table", old))
    store.commit(table=store.upsert("table", new))
    assert rows(store.read("table"), "g_index") == rows(upsert(old, new), "g_index")
    # A narrower table fits the types that are known.
    paths = store.parts("table").paths
    store.commit(table=store.upsert("table", old.where("g_index = 11")))
    assert {k for k, path in store.parts("table").paths.items() if path != paths[k]} == {2}
    assert store.read("table").where("g_index = 11").first()["v"] == 11.0


def test_empty_tables(spark, tmp_path):
    store = StudyStore(spark, str(tmp_path / "s"))
    store.commit(table=store.write("table", numbers(spark, 0, 0)))
    assert store.read("table").columns == ["g_index", "x"] and store.read("table").count() == 0
    assert store.lookup("table", 3).count() == 0 and store.lookup("logs", 3) is None
    store.commit(table=store.upsert("table", numbers(spark, 0, 2)))
    assert store.read("table").count() == 2


def scanned(df):
    """Files and rows that the scans of ``df`` read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    found = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return tuple(sum(m.apply(name).value() for m in found) for name in ("numFiles", "numOutputRows"))


def test_lookup_skips_files_and_row_groups(spark, tmp_path):
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    configuration.setInt("parquet.block.size", 16 << 10)
    try:
        store = StudyStore(spark, str(tmp_path / "s"), width=50_000)
        wide = numbers(spark, 0, 200_000, text=F.sha2(F.col("g_index").cast("string"), 256))
        store.commit(instances=store.write("instances", wide.orderBy(F.xxhash64("g_index"))))
    finally:
        configuration.unset("parquet.block.size")
    files, read = scanned(store.read("instances"))
    some, few = scanned(store.lookup("instances", 123_456))
    assert read == 200_000 and some <= files // 4 + 1 and few < 5_000
    assert store.lookup("instances", 123_456).first()["x"] == 3 * 123_456
    # An index that is missing within the bounds of the files is known by their Bloom filters.
    gaps = StudyStore(spark, str(tmp_path / "g"), width=50_000)
    gaps.commit(table=gaps.write("table", numbers(spark, 0, 100_000).where("g_index % 7 <> 0")))
    assert scanned(gaps.lookup("table", 7 * 5000))[1] == 0


def study(spark, root, **options):
    return Study(spark, {"a": list(range(12))}, steps=[Step("say", lambda c: f"n={c['a'] * 2}")],
                 captures=[Capture("n=(?P<n>[0-9]+)")], types={"n": "int"}, root=root, **options)


def test_collect_rewrites_parts_that_ran(spark, tmp_path):
    made = study(spark, str(tmp_path / "c"), width=4)
    made.run()
    made.collect()
    before = {kind: made.store.parts(kind).paths for kind in ("instances", "logs", "table")}
    assert all(sorted(paths) == [0, 1, 2] for paths in before.values())
    made.run_single(index=5, a=50)
    made.collect()
    for kind, paths in before.items():
        now = made.store.parts(kind).paths
        assert {k for k in now if now[k] != paths[k]} == {1}, kind
    assert rows(made.load_table().select("g_index", "n"), "g_index") == [(i, 100 if i == 5 else 2 * i) for i in range(12)]
    # Nothing has changed, so nothing is written.
    version = made.store.state()["version"]
    made.collect()
    assert made.store.state()["version"] == version
    # Points that are made again, but have not run, leave the table of the next collection.
    made.create_instances()
    made.adopt(made.instances("created").where("g_index < 6"))
    assert made.collect().count() == 0
    # Captured again, a part is collected over what it held.
    other = study(spark, str(tmp_path / "d"), width=4)
    other.run()
    other.collect()
    other.capture()
    assert rows(other.collect(), "g_index") == rows(captured_rows(other.instances()).select(*other.load_table().columns), "g_index")


def test_folder_stays_bounded(spark, tmp_path):
    store = StudyStore(spark, str(tmp_path / "k"), width=100, keep=4)
    store.commit(table=store.write("table", numbers(spark, 0, 300)))
    sizes = []
    for i in range(20):
        store.commit(table=store.upsert("table", numbers(spark, 10 * i, 10 * i + 5)))
        sizes.append((size(tmp_path), len(list((tmp_path / "k").rglob("*")))))
    assert max(s for s, _ in sizes[10:]) <= 1.2 * max(s for s, _ in sizes[:10])
    assert max(n for _, n in sizes[10:]) <= 1.2 * max(n for _, n in sizes[:10])
    assert StudyStore(spark, str(tmp_path / "k")).read("table").count() == 300


def test_clean_and_clear(spark, tmp_path):
    made = study(spark, str(tmp_path / "k"))
    made.run()
    made.collect()
    made.run_single(index=3, a=5)
    made.collect()
    assert len(list((tmp_path / "k/table").iterdir())) > 1
    made.clean()
    assert made.load_table().count() == 12 and len(list((tmp_path / "k/table").iterdir())) == 1
    made.clear()
    assert size(tmp_path) == 0 and not any(made.flags()[name] for name in ("has_data", "has_collected", "is_running"))


@pytest.mark.parametrize("index", [0, 7, -3])
def test_instance_reads_its_part(spark, tmp_path, index):
    made = study(spark, str(tmp_path / "i"), width=4)
    made.run()
    made.run_single(index=-3, a=1)
    assert rows(made.instance(index).select("g_index", "status")) == [(index, "downloaded")]
    assert made.instance(1000).count() == 0
    assert made.store.read("instances", [index // 4]).count() <= 4
