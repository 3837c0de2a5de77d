"""Writing records, dumps and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Nulls are part of a record, so that every record has the same keys.
# Times keep their microseconds.
_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def record_json(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """A row as JSON with its keys sorted."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns) if c not in without)), _JSON)


def captured_records(captured: DataFrame) -> DataFrame:
    """``(g_index, record)`` with the whole captured row as JSON."""
    return captured.select("g_index", record_json(captured).alias("record"))


def write_captured(captured: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write one JSON record per instance, in files of bounded size."""
    rows = captured.select("g_index", record_json(captured).alias("value"))
    rows.select("value").write.option("maxRecordsPerFile", rows_per_file).text(path)


def dump_records(table: DataFrame) -> DataFrame:
    """The collected table as JSON records, without the index column."""
    return table.select(record_json(table, ("g_index",)).alias("record"))


def write_dump(table: DataFrame, path: str) -> None:
    """Write the dump in index order, one record per line."""
    ordered = table.orderBy("g_index")
    ordered.select(record_json(table, ("g_index",)).alias("value")).write.text(path)


def write_csv(wide: DataFrame, path: str) -> None:
    """Write a wide series table in point order; every part file has the header.

    Parts follow one another in point order, so long series need no single task.
    """
    wide.orderBy("pos").drop("pos").write.option("header", True).option("emptyValue", "").csv(path)
