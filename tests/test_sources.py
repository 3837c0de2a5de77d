from __future__ import annotations

import json
from pathlib import Path

import pytest
from compare import rows
from pyspark.sql import functions as F

from sweepframe import Capture, Study, StudyError
from sweepframe.operators.capture import capture_instances, capture_text
from sweepframe.session import fresh_path, released, shared_dir
from sweepframe.sources.export import dump_records, write_captured, write_csv
from sweepframe.sources.files import read_files
from sweepframe.sources.store import Parts, StudyStore, load_table, save_table
from sweepframe.sources.text import INFER, list_files, parse_info, parse_records, read_info, read_stdout, rebuild_instances


def make_tree(root, book_name):
    for index, name in enumerate(["a b", "deep/x+y", "é%20", "nostatus"]):
        book = root / name / book_name
        book.mkdir(parents=True)
        (book / "context.json").write_text(json.dumps({"g_index": index, "g_logdir": name, "alpha": index * 1.5}))
        (book / "captured.json").write_text(json.dumps({"v": index}))
        (book / "sh.stdout").write_text(f"v={index}\nv={index + 1}\n")
        (book / "info.txt").write_text(f"g_walltime_sh={index}.5\nk=a=b\nk={index}=last\n")
        if name != "nostatus":
            (book / "status.txt").write_text("Downloaded" if index else "created\n")
    (root / "a b" / book_name / "other.stdout").write_text("w=7")
    (root / "a b" / "loose.stdout").write_text("not in the book")


@pytest.mark.parametrize("book", ["records", ".hidden"])
def test_tree(spark, tmp_path, book):
    assert read_stdout(spark, str(tmp_path), book=book).count() == 0
    make_tree(tmp_path, book)
    root = str(tmp_path)
    texts = read_stdout(spark, root, book=book)
    assert rows(texts.select("logdir", "command"), "logdir", "command") == [
        ("a b", "other"), ("a b", "sh"), ("deep/x+y", "sh"), ("nostatus", "sh"), ("é%20", "sh"),
    ]
    captured = capture_instances(texts, [Capture.simple("integer", "v", "v", mode="all")], key="logdir", order="command")
    assert rows(captured, "logdir") == [("a b", [0, 1]), ("deep/x+y", [1, 2]), ("nostatus", [3, 4]), ("é%20", [2, 3])]
    info = read_info(spark, root, book=book).where("logdir = 'deep/x+y'")
    assert rows(info, "key") == [("deep/x+y", "g_walltime_sh", "1.5"), ("deep/x+y", "k", "1=last")]
    built = rebuild_instances(spark, root, "g_index long, g_logdir string, alpha double", "v long", book)
    assert rows(built.select("g_index", "logdir", "context.alpha", "captured.v", "status"), "g_index") == [
        (0, "a b", 0.0, 0, "created"), (1, "deep/x+y", 1.5, 1, "downloaded"), (2, "é%20", 3.0, 2, "downloaded"),
    ]
    plain = rebuild_instances(spark, root, "g_index long, g_logdir string, alpha double", book=book)
    assert plain.where("captured is null").count() == 3


def test_listing(spark, tmp_path):
    for name in ("top.txt", "sub/one.txt", "sub/deep/two.txt", "sub2/[x].dat"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    root = str(tmp_path)

    def paths(**how):
        return [r["path"] for r in list_files(spark, root, **how).orderBy("path").collect()]

    assert paths() == ["sub/deep/two.txt", "sub/one.txt", "sub2/[x].dat", "top.txt"]
    assert paths(folder="sub") == ["sub/deep/two.txt", "sub/one.txt"]
    assert paths(folder="top.txt") == ["top.txt"]
    assert paths(pattern="*.txt") == ["sub/deep/two.txt", "sub/one.txt", "top.txt"]
    assert paths(pattern="sub/*.txt") == ["sub/deep/two.txt", "sub/one.txt"]
    assert paths(pattern="sub?/[[]x].d[!b]t") == ["sub2/[x].dat"]
    assert "content" not in list_files(spark, root)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_info_lines_and_records(spark):
    lines = spark.createDataFrame([(0, 1, "a=1=2"), (0, 2, "a=3"), (0, 3, " b = x ")], "g long, n int, line string")
    assert rows(parse_info(lines, ["g"], "n"), "key") == [(0, "a", "3"), (0, "b ", " x")]
    records = spark.createDataFrame([('{"a": 1, "b": [1.5]}',)], "j string")
    assert rows(parse_records(records, "j", "a long, b array<double>").select("record.*")) == [(1, [1.5])]


def test_tables_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None), (0, "y", 2.5)], "g_index long, s string, a double")
    path = str(tmp_path / "t")
    save_table(df, path)
    assert rows(load_table(spark, path, df.schema), "g_index") == rows(df, "g_index")
    assert load_table(spark, None, df.schema).schema == df.schema
    assert [r[0] for r in dump_records(df).collect()] == ['{"a":null,"s":"x"}', '{"a":2.5,"s":"y"}']
    write_captured(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 2
    wide = spark.createDataFrame([(2, 2.0, None), (1, 1.0, 5)], "pos long, `a (x-axis)` double, a long")
    write_csv(wide, str(tmp_path / "csv"))
    texts = [p.read_text() for p in sorted((tmp_path / "csv").glob("*.csv"))]
    assert "".join(t.split("\n", 1)[1] for t in texts) == "1.0,5\n2.0,\n" and all(t.startswith("a (x-axis),a\n") for t in texts)


def test_store_versions(spark, tmp_path):
    store = StudyStore(spark, str(tmp_path / "s"))
    assert store.read("table") is None and store.state()["version"] == 0
    first = store.write("table", spark.range(3).toDF("g_index"))
    assert store.read("table") is None
    store.commit(table=first)
    second = store.write("table", store.read("table").withColumn("x", F.lit(1)))
    store.commit(table=second, has_collected=True)
    assert store.read("table").columns == ["g_index", "x"] and store.state()["has_collected"]
    assert Parts.of(first).schema.names == ["g_index"] and all((tmp_path / "s" / path).is_dir() for path in Parts.of(first).paths.values())
    again = StudyStore(spark, str(tmp_path / "s"))
    assert again.state() == store.state() and again.read("table").count() == 3


def test_large_files_are_refused(spark, tmp_path, monkeypatch):
    (tmp_path / "large.txt").write_text("x" * 100)
    (tmp_path / "small.txt").write_text("y")
    monkeypatch.setattr("sweepframe.sources.files.MAX_FILE", 50)
    found = read_files(list_files(spark, str(tmp_path)), str(tmp_path))
    with pytest.raises(Exception, match="too large for one text: large.txt"):
        found.collect()
    assert rows(read_files(list_files(spark, str(tmp_path), "small*"), str(tmp_path))) == [("small.txt", "y")]


def test_captures_on_a_stream(spark, tmp_path, tables):
    """Capture columns are plain expressions, so a stream takes them unchanged."""
    source = tmp_path / "in"
    spark.read.parquet(f"{tables}/events.parquet").select("event_id", "props").write.parquet(str(source))
    capture = [Capture.simple("integer", "k", '"k"')]
    stream = spark.readStream.schema("event_id long, props string").parquet(str(source))
    running = (
        capture_text(stream, "props", capture).writeStream.format("memory").queryName("captured")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    running.awaitTermination(120)
    batch = capture_text(spark.read.parquet(str(source)), "props", capture)
    assert rows(spark.table("captured"), "event_id") == rows(batch, "event_id")


def test_any_root_depth_and_name(spark, tmp_path):
    root = tmp_path / "a b%20+"
    for name in ("d1/d2/d3/d4/d5/d6", "_u/.h", "plain"):
        book = root / name / ".book"
        book.mkdir(parents=True)
        (book / "_cmd.stdout").write_text(name)
    for spelled in (str(root), f"{root}/"):
        texts = read_stdout(spark, spelled, book=".book")
        assert rows(texts.select("logdir", "command", "text"), "logdir") == [
            (n, "_cmd", n) for n in ("_u/.h", "d1/d2/d3/d4/d5/d6", "plain")
        ]
    plain = tmp_path / "p"
    (plain / "x").mkdir(parents=True)
    (plain / "x" / "_f").write_text("12")
    assert rows(list_files(spark, f"file://{plain}")) == [("x/_f", 2)]
    with pytest.raises(Exception, match="nowhere"):
        list_files(spark, str(tmp_path / "nowhere"))


def test_undeclared_keys(spark):
    records = spark.createDataFrame([(1, '{"a": 1, "b": {"c": [1]}}'), (2, '{"a": 2}'), (3, None)], "i long, j string")
    with pytest.raises(Exception, match="undeclared keys in a record: b"):
        parse_records(records, "j", "a long").collect()
    kept = parse_records(records, "j", "a long", undeclared="keep").select("i", "record.a", "record_undeclared")
    assert rows(kept, "i") == [(1, 1, {"b": '{"c":[1]}'}), (2, 2, {}), (3, None, None)]
    assert rows(parse_records(records, "j", "a long", undeclared="drop").select("i", "record.a"), "i") == [(1, 1), (2, 2), (3, None)]
    with pytest.raises(StudyError, match="treatment"):
        parse_records(records, "j", "a long", undeclared="lose")


def test_records_without_a_schema(spark, tmp_path):
    records = spark.createDataFrame([('{"n": 1, "l": [1], "s": "x"}',), ('{"n": 2.5, "l": [1.5], "t": true}',), ('{"n": null, "l": []}',)], "j string")
    parsed = parse_records(records, "j")
    assert parsed.schema["record"].dataType.simpleString() == "struct<l:array<double>,n:double,s:string,t:boolean>"
    assert sorted(rows(parsed.select("record.*")), key=str) == sorted([([1.0], 1.0, "x", None), ([1.5], 2.5, None, True), ([], None, None, None)], key=str)
    assert parse_records(records.where("false"), "j").count() == 0
    with pytest.raises(StudyError, match="merge"):
        parse_records(spark.createDataFrame([('{"n": 1}',), ('{"n": "x"}',)], "j string"), "j")
    make_tree(tmp_path, "records")
    given = rebuild_instances(spark, str(tmp_path), "alpha double, g_index long, g_logdir string", "v long")
    inferred = rebuild_instances(spark, str(tmp_path), INFER, INFER)
    assert rows(inferred, "g_index") == rows(given, "g_index") and inferred.schema.simpleString() == given.schema.simpleString()


def test_study_from_a_tree(spark, tmp_path):
    make_tree(tmp_path / "t", "records")
    study = Study(spark, types={"k": "str", "v": "float"}, root=str(tmp_path / "study"))
    study.rebuild(str(tmp_path / "t"))
    assert rows(study.instances().select("g_index", "logdir", "status"), "g_index") == [(0, "a b", "created"), (1, "deep/x+y", "downloaded"), (2, "é%20", "downloaded")]
    table = study.collect()
    assert rows(table.select("g_index", "alpha", "v", "k", "g_walltime_sh"), "g_index") == [(1, 1.5, 1.0, "1=last", 1.5), (2, 3.0, 2.0, "2=last", 2.5)]
    # Scratch tables are gone once their result is stored.
    with released(spark):
        spark.range(3).write.parquet(fresh_path(spark, "kept"))
        before = set(Path(shared_dir(spark)).iterdir())
        study.rebuild(str(tmp_path / "t"))
        assert set(Path(shared_dir(spark)).iterdir()) == before
    assert len(set(Path(shared_dir(spark)).iterdir())) == len(before) - 1
