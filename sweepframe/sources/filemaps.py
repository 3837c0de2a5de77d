"""Files of a study: which of them every grid point gets, under what name, and with what text.

Source and target names are templates over the context. A source is a file, a folder (all files below it), or a
pattern. Names are matched to the files of a tree by joins; every distinct file that some point asks for is read
once, and a template is split once, into pieces of text and expressions. The expressions of all templates are evaluated
per context, those of other templates left out, and a text is put together from the pieces and the row's values. So
templates are data: thousands of them make the plan no larger than their distinct expressions do.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import StudyError
from ..functions.regex import to_java
from ..functions.scalar import register_functions
from ..functions.template import as_text, expression_types, render, split_template
from ..session import fresh_path, ship_package
from .files import read_files, walk

#: Most distinct expressions in all templates of a study, as each is part of the plan.
MAX_EXPRESSIONS = 1000
#: Most rows of a side that is sent to every task.
MAX_BROADCAST = 50_000

_MODES = ("simple", "glob")


@dataclass(frozen=True)
class FileMap:
    """One entry: ``source`` and ``target`` are templates of names; without a target files keep their names.

    With ``mode="glob"`` the source is a pattern over whole relative paths, where ``*`` also crosses folders, and
    ``target`` a folder. A ``template`` is always ``simple``, its texts are rendered too.
    """

    source: str
    target: str | None = None
    template: bool = False
    mode: str = "simple"

    def __post_init__(self) -> None:
        if self.mode not in _MODES:
            raise StudyError(f"unknown mode {self.mode!r} of files, expected one of {_MODES}")
        simple = self.template or self.mode == "simple"
        if self.target is None:
            object.__setattr__(self, "target", self.source if simple else ".")
        object.__setattr__(self, "mode", "simple" if simple else "glob")


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def _normal(path: Column) -> Column:
    """A relative path without empty and ``.`` parts; the root itself is empty."""
    return F.array_join(F.filter(F.split(path, "/"), lambda part: ~part.isin("", ".")), "/")


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every distinct pattern its regular expression, and the folder its first part without wildcards names."""
    for batch in batches:
        sources = batch.column(1).to_pylist()
        folders = [posixpath.dirname(re.split(r"[*?\[]", s, maxsplit=1)[0]) for s in sources]
        expressions = [to_java(fnmatch.translate(s)).pattern for s in sources]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(folders, pa.string()), pa.array(expressions, pa.string())],
            ["entry", "source", "folder", "regex"],
        )


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("is_expression", pa.bool_()), ("text", pa.string())]))
    for batch in batches:
        pieces = [[{"is_expression": e, "text": t} for e, t in split_template(text)] for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, kind)], ["_path", "_pieces"])


def asked_files(contexts: DataFrame, root: str, maps: Sequence[FileMap], ignore_missing: bool = False) -> DataFrame:
    """The context columns with ``_entry, _target, _path, _length``: a row for every file that a point gets.

    A simple source that names neither file nor folder stops the job, unless ``ignore_missing``; a pattern may match nothing.
    """
    spark = contexts.sparkSession
    ship_package(spark)
    # One row per level of a path, from the root to the file itself.
    parts = F.split("path", "/")
    upper = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    below = walk(spark, root).select("path", "length", F.explode(upper).alias("folder"))
    names = [
        F.struct(F.lit(i).alias("_entry"), _normal(render(contexts, m.source)).alias("_source"), render(contexts, m.target).alias("_target"))
        for i, m in enumerate(maps)
    ]
    asked = contexts.select("*", F.inline(F.array(*names)))
    distinct = _stored(asked.select(F.col("_entry").alias("entry"), F.col("_source").alias("source")).distinct(), "sources")
    is_simple = F.col("entry").isin([i for i, m in enumerate(maps) if m.mode == "simple"])
    rest = "if(path = source, '', substring(path, length(source) + if(source = '', 1, 2)))"
    by_name = distinct.where(is_simple).join(below, F.col("source") == F.col("folder")).select("entry", "source", "path", "length", F.expr(rest).alias("rest"))
    patterns = distinct.where(~is_simple).mapInArrow(_patterns, "entry int, source string, folder string, regex string")
    matching = patterns.join(below, "folder").where("path rlike regex")
    found = by_name.unionByName(matching.select("entry", "source", "path", "length", F.col("path").alias("rest")))
    found = _stored(found.withColumnsRenamed({c: f"_{c}" for c in found.columns}), "matches")
    if not ignore_missing:
        known = found.select(F.col("_entry").alias("entry"), F.col("_source").alias("source"))
        missing = distinct.where(is_simple).join(known, ["entry", "source"], "left_anti").limit(10).collect()
        if missing:
            raise StudyError(f"missing files: {sorted(row['source'] for row in missing)}")
    target = F.when(F.col("_rest") == "", _normal(F.col("_target"))).otherwise(_normal(F.concat_ws("/", "_target", "_rest")))
    joined = asked.join(_small(found), ["_entry", "_source"])
    return joined.withColumn("_target", target).select(*contexts.columns, "_entry", "_target", "_path", "_length")


def mapped_files(contexts: DataFrame, root: str, maps: Sequence[FileMap], ignore_missing: bool = False) -> DataFrame:
    """``(g_index, target, text)``: every file of every point, templates rendered with its context."""
    spark = contexts.sparkSession
    register_functions(spark)
    asked = asked_files(contexts, root, maps, ignore_missing)
    is_template = F.col("_entry").isin([i for i, m in enumerate(maps) if m.template])
    named = ["g_index", F.col("_target").alias("target")]
    wanted = asked.groupBy(F.col("_path").alias("path")).agg(F.max("_length").alias("length"), F.bool_or(is_template).alias("template"))
    wanted = _stored(wanted, "wanted")
    texts = _stored(read_files(wanted.select("path", "length"), root).withColumnsRenamed({"path": "_path", "text": "_text"}), "texts")
    raw = asked.where(~is_template).join(texts, "_path").select(*named, F.col("_text").alias("text"))
    if not any(m.template for m in maps):
        return raw
    sources = texts.join(wanted.where("template").select(F.col("path").alias("_path")), "_path", "left_semi")
    split = sources.mapInArrow(_split, "_path string, _pieces array<struct<is_expression: boolean, text: string>>")
    used = F.array_distinct(F.transform(F.filter("_pieces", lambda p: p["is_expression"]), lambda p: p["text"]))
    split = _stored(split.withColumn("_used", used), "pieces")
    found = split.select(F.explode("_used").alias("e")).distinct().limit(MAX_EXPRESSIONS + 1).collect()
    if len(found) > MAX_EXPRESSIONS:
        raise StudyError(f"templates with more than {MAX_EXPRESSIONS} distinct expressions")
    expressions = sorted(row["e"] for row in found)
    columns = [F.expr(e) for e in expressions]
    rows = asked.where(is_template).join(split, "_path")
    if expressions:
        # Only what a row's own template asks for is evaluated: elsewhere it may fail.
        types = expression_types(contexts, columns)
        values = [F.when(F.array_contains("_used", e), as_text(c, tp)) for e, c, tp in zip(expressions, columns, types)]
        rows = rows.withColumn("_known", F.map_from_arrays(F.array(*map(F.lit, expressions)), F.array(*values)))
        pieces = F.transform("_pieces", lambda p: F.when(p["is_expression"], F.element_at("_known", p["text"])).otherwise(p["text"]))
    else:
        pieces = F.transform("_pieces", lambda p: p["text"])
    return rows.select(*named, F.array_join(pieces, "").alias("text")).unionByName(raw)
