"""Reading and writing many small files from tasks, on any file system."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, ship_package

#: Names that are handed on at once, and bytes of text.
_NAMES = 10_000
_BYTES = 8 << 20
#: Most bytes of a file, as a text is one value.
MAX_FILE = (1 << 31) - (1 << 20)
#: Bytes of files that one task reads.
_TASK_BYTES = 64 << 20


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as Spark's file systems spell it; local ones with three slashes."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = name.getFileSystem(spark._jsc.hadoopConfiguration())
    full = system.makeQualified(name).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def file_system(root: str):
    """The Arrow file system of a qualified path, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(quote("s3" + root[3:] if root.startswith("s3a:") else root, safe="/:@"))


def _list(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = file_system(root)
        base = base.rstrip("/")
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                here = f"{base}/{folder}" if folder else base or "/"
                itself = system.get_file_info(here)
                if itself.type == fs.FileType.NotFound and not folder:
                    raise FileNotFoundError(root)
                listed = fs.FileSelector(here, allow_not_found=True)
                found = [itself] if itself.is_file else system.get_file_info(listed)
                for i in range(0, len(found), _NAMES):
                    part = found[i : i + _NAMES]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([x.path[len(base) + 1 :] for x in part], pa.string()),
                            pa.array([x.size if x.is_file else None for x in part], pa.int64()),
                            pa.array([x.type == fs.FileType.Directory for x in part], pa.bool_()),
                        ],
                        ["path", "length", "folder"],
                    )

    return run


def walk(spark: SparkSession, root: str, start: str = "") -> DataFrame:
    """``(path, length)`` of every file below ``root``, or below ``start`` in it, hidden ones too.

    Paths are relative to ``root``. Folders are listed in parallel, one job per level of the tree;
    a level is written before the next is listed, so a lost executor repeats one level at most.
    """
    root = qualified(spark, root)
    ship_package(spark)
    schema = "path string, length long, folder boolean"
    folders, levels = spark.createDataFrame([(start.strip("/"),)], "path string"), []
    while not levels or not folders.isEmpty():
        path = fresh_path(spark, "listing")
        folders.mapInArrow(_list(root), schema).write.parquet(path)
        level = spark.read.schema(schema).parquet(path)
        levels.append(level.where("not folder").select("path", "length"))
        folders = level.where("folder").select("path").repartition(spark.sparkContext.defaultParallelism, "path")
    return reduce(DataFrame.unionByName, levels)


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        paths, texts, held = [], [], 0

        def put() -> pa.RecordBatch:
            columns = [pa.array(paths, pa.string()), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["path", "text"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{base.rstrip('/')}/{path}") as stream:
                    data = stream.read()
                paths.append(path)
                texts.append(data.decode("utf-8", "replace"))
                held += len(data)
                if held >= _BYTES or len(paths) >= _NAMES:
                    yield put()
                    paths, texts, held = [], [], 0
        if paths:
            yield put()

    return run


def read_files(files: DataFrame, root: str) -> DataFrame:
    """``(path, text)`` of files given as ``(path, length)`` below ``root``, spread by their total length."""
    spark = files.sparkSession
    ship_package(spark)
    size = files.agg(F.sum("length")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // _TASK_BYTES))
    too_large = F.raise_error(F.concat(F.lit("a file is too large for one text: "), "path"))
    paths = files.select(F.when(F.col("length") > MAX_FILE, too_large).otherwise(F.col("path")).alias("path"))
    dealt = paths.repartition(parts, "path")
    return dealt.mapInArrow(_read(qualified(spark, root)), "path string, text string")


def write_files(files: DataFrame, root: str, path: str = "path", text: str = "text") -> None:
    """Write every row's text to the file it names below ``root``.

    Tasks write where the rows are, to any file system Arrow reaches. A task that
    runs again writes the same files again.
    """
    root = qualified(files.sparkSession, root)

    def write(rows: Iterator[Row]) -> None:
        system, base = file_system(root)
        made = set()
        for row in rows:
            target = f"{base.rstrip('/')}/{row[0]}"
            folder = target.rsplit("/", 1)[0]
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(target) as stream:
                stream.write((row[1] or "").encode())

    files.select(path, text).foreachPartition(write)
