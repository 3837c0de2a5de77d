"""Points of many plots written as CSV by one job."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StudyError
from ..session import fresh_path, ship_package
from ..sources.files import file_system, qualified
from .series import CATEGORY, FIXED, MAX_SERIES, SeriesQuery

#: Lines of one part file, and series of one in the long form.
LINES = 100_000
SERIES = 256
#: Most series that are sent to every task.
MAX_BROADCAST = 100_000

_CSV = {"emptyValue": ""}


def _cell(*values: Column) -> Column:
    return F.to_csv(F.struct(*(v.alias(f"_{i}") for i, v in enumerate(values))), _CSV)


def _lines(query: SeriesQuery) -> tuple[DataFrame, DataFrame]:
    """Lines ``(plot_no, a, b, first, second, line)`` and headers ``(plot_no, header)`` of one plot's files.

    ``a`` and ``b`` number the parts of a file, ``first`` and ``second`` order its lines.
    """
    space, on = query.space, [*query.keys, "yaxis"]
    size = max(1, space.size(*query.of_kind(CATEGORY))) * len(query.plot.ycolumns)
    series = query.series()
    count = max(1, space.size(*query.keys)) * len(query.plot.ycolumns)
    side = series.select("plot_no", "series_no", "legend", *on)
    points = query.points().join(F.broadcast(side) if count <= MAX_BROADCAST else side, on)
    point = _cell(F.col("x"), F.col("y"))
    if size > MAX_SERIES:
        line = F.concat_ws(",", _cell(F.col("legend")), F.col("pos").cast("string"), point)
        part = (F.col("series_no") / SERIES).cast("long"), F.expr(f"(pos - 1) div {LINES}")
        order = F.col("series_no").cast("long"), F.col("pos").cast("long")
        lines = points.select("plot_no", part[0].alias("a"), part[1].alias("b"), order[0].alias("first"), order[1].alias("second"), line.alias("line"))
        return lines, series.select("plot_no").distinct().withColumn("header", F.lit("series,pos,x,y"))
    cells = points.groupBy("plot_no", "pos").agg(F.map_from_entries(F.collect_list(F.struct(F.col("series_no").cast("int"), point))).alias("cells"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda n: F.coalesce(F.element_at("cells", n), F.lit(",")))
    lines = cells.select(
        "plot_no", F.lit(0).cast("long").alias("a"), F.expr(f"(pos - 1) div {LINES}").alias("b"),
        F.lit(0).cast("long").alias("first"), F.col("pos").cast("long").alias("second"), F.array_join(whole, ",").alias("line"),
    )
    named = F.concat_ws(",", _cell(F.concat("legend", F.lit(" (x-axis)"))), _cell(F.col("legend")))
    legends = F.array_sort(F.collect_list(F.struct("series_no", named.alias("named"))))
    headers = series.groupBy("plot_no").agg(F.array_join(F.transform(legends, lambda s: s["named"]), ",").alias("header"))
    return lines, headers


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        attempt = TaskContext.get().taskAttemptId()
        now, stream, part, final = None, None, "", ""

        def close() -> None:
            if stream is not None:
                stream.close()
                system.move(part, final)

        for batch in batches:
            for file, a, b, line in zip(*(batch.column(n).to_pylist() for n in ("file", "a", "b", "line"))):
                if (file, a, b) != now:
                    close()
                    now, folder = (file, a, b), f"{base}/{file}.csv"
                    final = f"{folder}/part-{a:06d}-{b:06d}.csv"
                    part = f"{folder}/.part-{a:06d}-{b:06d}.{attempt}"
                    system.create_dir(folder, recursive=True)
                    stream = system.open_output_stream(part)
                stream.write(line.encode() + b"\n")
            yield batch.select(["file"]).slice(0, 1)
        close()

    return run


def write_plots(spark: SparkSession, queries: Sequence[SeriesQuery], folder: str) -> list[str]:
    """Write every plot of every query to a CSV folder named by its rendered file name; returns their paths.

    Points are computed once. A part file has the header and at most ``LINES`` lines of one plot (in the long form of
    some series), so neither a long series nor many plots are one task's work; parts follow one another in point order.
    """
    if not queries:
        return []
    ship_package(spark)
    frames, headers, files = [], [], []
    for number, query in enumerate(queries):
        lines, header = _lines(query)
        names = query.plots().select("plot_no", F.col("filename").alias("file"))
        frames.append(lines.select(F.lit(number).alias("query"), "*"))
        headers.append(header.select(F.lit(number).alias("query"), "*"))
        files.append(names.select(F.lit(number).alias("query"), "*"))
    path = fresh_path(spark, "lines")
    lines = reduce(DataFrame.unionByName, frames)
    lines.write.parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    named = reduce(DataFrame.unionByName, files)
    known = sorted(named.collect())
    if twice := [name for name, n in Counter(row["file"] for row in known).items() if n > 1]:
        raise StudyError(f"several plots are named {sorted(twice)[:5]}")
    # Every part begins with the header, and a plot without points has one part.
    first = named.select("query", "plot_no", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    parts = lines.select("query", "plot_no", "a", "b").unionByName(first).distinct()
    heads = parts.join(reduce(DataFrame.unionByName, headers), ["query", "plot_no"]).select(
        "query", "plot_no", "a", "b", F.lit(-1).cast("long").alias("first"), F.lit(-1).cast("long").alias("second"), F.col("header").alias("line")
    )
    whole = lines.unionByName(heads).join(named, ["query", "plot_no"])
    dealt = whole.repartition("file", "a", "b").sortWithinPartitions("file", "a", "b", "first", "second")
    dealt.select("file", "a", "b", "line").mapInArrow(_write(qualified(spark, folder)), "file string").count()
    return [f"{folder.rstrip('/')}/{row['file']}.csv" for row in known]
