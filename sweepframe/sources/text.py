"""Reading what runs leave behind: logs, info lines, JSON records, file trees."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StudyError
from ..functions.regex import to_java
from ..session import fresh_path
from ..types import infer_schema, writable
from .files import read_files, walk

# Defaults for the folder a run keeps its records in, and the key=value file in it.
BOOK = "records"
INFO_FILE = "info.txt"


def _in_book(book: str, name: str) -> str:
    return rf"^(.*)/{re.escape(book)}/{name}$"


def read_stdout(
    spark: SparkSession, root: str, stream: str = "stdout", book: str = BOOK
) -> DataFrame:
    """One row per instance and command: ``(logdir, command, text)``.

    Reads ``<root>/<logdir>/<book>/<command>.<stream>``, at any depth. Missing files give no row.
    """
    path = _in_book(book, rf"([^/]+)[.]{re.escape(stream)}")
    return read_files(walk(spark, root).where(F.col("path").rlike(path)), root).select(
        F.regexp_extract("path", path, 1).alias("logdir"), F.regexp_extract("path", path, 2).alias("command"), "text"
    )


def parse_info(lines: DataFrame, keys: Sequence[str], order: str, line: str = "line") -> DataFrame:
    """Long ``(keys, key, value)`` rows of key=value lines.

    A line splits at its first ``=``; a repeated key keeps its last value.
    """
    parts = F.split(F.trim(line), "=", 2)
    pairs = lines.select(*keys, F.col(order).alias("_order"), parts[0].alias("key"), F.get(parts, F.lit(1)).alias("value"))
    return pairs.groupBy(*keys, "key").agg(F.max_by("value", "_order").alias("value"))


def read_info(
    spark: SparkSession, root: str, filename: str = INFO_FILE, book: str = BOOK
) -> DataFrame:
    """Key=value records of every instance below ``root``, as ``(logdir, key, value)``."""
    lines = read_records(spark, root, filename, book).select(
        "logdir", F.posexplode(F.split(F.rtrim("record"), "\n")).alias("line_no", "line")
    )
    return parse_info(lines.where(F.length("line") > 0), ["logdir"], "line_no")


#: What becomes of keys of records that the schema does not name.
UNDECLARED = ("refuse", "keep", "drop")
#: In place of a schema: the types of all records, merged.
INFER = "infer"


def parse_records(df: DataFrame, column: str, schema: T.StructType | str = INFER, out: str = "record", undeclared: str = "refuse") -> DataFrame:
    """Parse a column of JSON records into a struct; its types are given or merged over all records.

    A key that the schema does not name stops the job, or is kept as text in the map ``<out>_undeclared``, or dropped.
    """
    if undeclared not in UNDECLARED:
        raise StudyError(f"unknown treatment of keys {undeclared!r}, expected one of {UNDECLARED}")
    if isinstance(schema, str) and schema == INFER:
        schema = infer_schema(df, column)
        schema = T.StructType([T.StructField(f.name, writable(f.dataType)) for f in schema])
        if not len(schema):
            return df.withColumn(out, F.lit(None).cast(schema))
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    parsed = F.from_json(column, schema, {"mode": "FAILFAST"})
    others = F.array_except(F.json_object_keys(column), F.array(*map(F.lit, schema.names)).cast("array<string>"))
    if undeclared == "refuse":
        message = F.concat(F.lit("undeclared keys in a record: "), F.array_join(others, ", "))
        parsed = F.when(F.size(others) > 0, F.raise_error(message).cast(schema)).otherwise(parsed)
    elif undeclared == "keep":
        whole = F.from_json(column, "map<string,string>", {"mode": "FAILFAST"})
        df = df.withColumn(f"{out}_undeclared", F.map_filter(whole, lambda key, _: F.array_contains(others, key)))
    return df.withColumn(out, parsed)


def read_records(
    spark: SparkSession, root: str, filename: str, book: str = BOOK
) -> DataFrame:
    """A file kept per instance, as ``(logdir, record)``."""
    return _records(walk(spark, root), root, filename, book)


def _records(files: DataFrame, root: str, filename: str, book: str) -> DataFrame:
    path = _in_book(book, re.escape(filename))
    return read_files(files.where(F.col("path").rlike(path)), root).select(
        F.regexp_extract("path", path, 1).alias("logdir"), F.col("text").alias("record")
    )


def rebuild_instances(
    spark: SparkSession,
    root: str,
    context_schema: T.StructType | str = INFER,
    captured_schema: T.StructType | str | None = None,
    book: str = BOOK,
) -> DataFrame:
    """Instance table from a storage tree; folders without a status are left out.

    ``captured_schema`` is given when the tree is known to hold captured records. Either schema may be ``INFER``:
    then the files are kept as they are read, and their types are merged over the tree before they are parsed.
    """
    files = walk(spark, root)

    def records(filename: str, name: str) -> DataFrame:
        return _records(files, root, filename, book).withColumnRenamed("record", name)

    rows = records("status.txt", "status").join(records("context.json", "context_json"), "logdir")
    if captured_schema is not None:
        rows = rows.join(records("captured.json", "captured_json"), "logdir", "left")
    if INFER in (context_schema, captured_schema):
        path = fresh_path(spark, "records")
        rows.write.parquet(path)
        rows = spark.read.schema(rows.schema).parquet(path)
    rows = parse_records(rows, "context_json", context_schema, "context")
    if captured_schema is None:
        rows = rows.withColumn("captured", F.lit(None).cast("string"))
    else:
        rows = parse_records(rows, "captured_json", captured_schema, "captured")
    return rows.select(
        F.col("context.g_index").alias("g_index"),
        F.col("context.g_logdir").alias("logdir"),
        "context",
        "captured",
        F.lower(F.regexp_replace("status", r"\s+", "")).alias("status"),
    )


def glob_regex(pattern: str) -> str:
    """Glob over a whole relative path, where ``*`` also crosses folders."""
    return to_java(fnmatch.translate(pattern)).pattern


def list_files(spark: SparkSession, root: str, pattern: str | None = None, folder: str | None = None) -> DataFrame:
    """Files below ``root`` as ``(path, length)``: one file, a folder walked, or a glob.

    Only names and sizes are read, not contents.
    """
    if folder is not None:
        return walk(spark, root, folder)
    files = walk(spark, root)
    return files if pattern is None else files.where(F.col("path").rlike(glob_regex(pattern)))
