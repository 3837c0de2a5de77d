"""Versioned tables of one study on a shared file system.

A table is a list of parts, each a folder with the rows of one range of ``g_index``. Every write goes to a path of its
own, and a small append-only state table says which path holds which part. So no part is overwritten while it is read, a
job that dies leaves the last version in place, and an upsert writes the parts that it touches and no others. Files are
sorted by the index and carry its bounds and a Bloom filter, so a lookup opens one part and skips what cannot hold it.
One study has one writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from ..types import apply_schema, merged_schema, writable
from .files import file_system, qualified

#: Indices of one part, and the slices in which tasks write it.
WIDTH = 1 << 18
SLICES = 16
#: States that stay readable when older ones are removed.
KEEP = 16

KINDS = ("instances", "logs", "table", "running")

_STATE = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("instances", T.StringType()),
        T.StructField("logs", T.StringType()),
        T.StructField("table", T.StringType()),
        # Points that are being run, and how far they are.
        T.StructField("running", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("has_collected", T.BooleanType()),
        T.StructField("has_plotted", T.BooleanType()),
    ]
)
_EMPTY = {name: None for name in _STATE.names} | {"version": 0, "has_collected": False, "has_plotted": False}
_PART = "__part"
_FOLDER = re.compile(rf"{_PART}=(-?\d+)")


@dataclass
class Parts:
    """What the state keeps of a table: its types, the range of a part, and the folder of every part below the root.

    ``sources`` are the folders of another table that the parts were made from.
    """

    schema: T.StructType
    width: int
    paths: dict[int, str]
    sources: dict[int, str] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"schema": self.schema.jsonValue(), "width": self.width, "paths": self.paths, "sources": self.sources})

    @staticmethod
    def of(text: str) -> Parts:
        known = json.loads(text)
        paths, sources = ({int(k): path for k, path in known[name].items()} for name in ("paths", "sources"))
        return Parts(T.StructType.fromJson(known["schema"]), known["width"], paths, sources)


def _part(width: int) -> Column:
    # Rounded down for negative indices too, and exact for large ones.
    return F.expr(f"(g_index - pmod(g_index, {width}L)) div {width}L")


def _plain(schema: T.StructType) -> T.StructType:
    """Types as files give them back: everything may be null."""
    return T.StructType([T.StructField(f.name, _loose(writable(f.dataType))) for f in schema])


def _loose(tp: T.DataType) -> T.DataType:
    if isinstance(tp, T.StructType):
        return _plain(tp)
    if isinstance(tp, T.ArrayType):
        return T.ArrayType(_loose(tp.elementType))
    if isinstance(tp, T.MapType):
        return T.MapType(_loose(tp.keyType), _loose(tp.valueType))
    return tp


def write_clustered(df: DataFrame, path: str, width: int = WIDTH) -> None:
    """Write ``df`` to a folder per range of ``g_index``, sorted by it, with its bounds and Bloom filters in the files.

    Tasks are dealt by slices of a range, not by its sampled quantiles, so ``df`` is computed once.
    """
    slice_of = F.expr(f"pmod(g_index, {width}L) div {-(-width // SLICES)}L")
    dealt = df.withColumn(_PART, _part(width)).repartition(F.col(_PART), slice_of)
    writer = dealt.sortWithinPartitions(_PART, "g_index").write.partitionBy(_PART)
    # Adaptive filters are as large as the indices of a file need.
    writer.option("parquet.bloom.filter.enabled#g_index", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


class StudyStore:
    """Tables of a study below ``root``, in parts of ``width`` indices; all but the last ``keep`` states are removed."""

    def __init__(self, spark: SparkSession, root: str, width: int = WIDTH, keep: int | None = KEEP):
        self.spark, self.root = spark, root.rstrip("/")
        self.width, self.keep = width, keep
        self._known: dict[str, Any] | None = None

    # --- state -----------------------------------------------------------------------------

    def state(self) -> dict[str, Any]:
        """The current state; that of a study nothing was written for if there is none.

        Read once: from then on this object is the study's one writer.
        """
        if self._known is None:
            self._known = self._read_state()
        return dict(self._known)

    def _states(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_STATE).json(f"{self.root}/state")
        except AnalysisException as error:
            # Only a missing folder is a new study; any other fault must not restart its versions.
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _read_state(self) -> dict[str, Any]:
        rows = self._states()
        last = None if rows is None else rows.agg(F.max_by(F.struct(*_STATE.names), "version").alias("last")).first()["last"]
        return dict(_EMPTY) if last is None else last.asDict()

    def commit(self, **changes: Any) -> None:
        """Append a new state with the given changes; tables are given as :meth:`write` returns them."""
        state = {**self.state(), **changes}
        state["version"] += 1
        row = tuple(state[name] for name in _STATE.names)
        self.spark.createDataFrame([row], _STATE).coalesce(1).write.mode("append").json(f"{self.root}/state")
        self._known = state
        if self.keep and state["version"] % self.keep == 0:
            self.clean(self.keep)

    # --- tables ----------------------------------------------------------------------------

    def parts(self, kind: str) -> Parts | None:
        text = self.state()[kind]
        return None if text is None else Parts.of(text)

    def _write_parts(self, kind: str, df: DataFrame) -> dict[int, str]:
        path = f"{kind}/{uuid.uuid4().hex}"
        write_clustered(df, f"{self.root}/{path}", self.width)
        # As many names as parts.
        names = (_FOLDER.fullmatch(found.base_name) for found in self._listed(path))
        return {int(name[1]): f"{path}/{name[0]}" for name in names if name}

    def _listed(self, path: str) -> list:
        from pyarrow import fs

        system, base = file_system(qualified(self.spark, self.root))
        return system.get_file_info(fs.FileSelector(f"{base}/{path}", allow_not_found=True))

    def _frame(self, schema: T.StructType, paths: Iterable[str]) -> DataFrame:
        paths = [f"{self.root}/{path}" for path in paths]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, kind: str, df: DataFrame) -> str:
        """Write a new version of a whole table and describe it; it is not current yet."""
        schema = _plain(df.schema)
        return Parts(schema, self.width, self._write_parts(kind, apply_schema(df, schema))).text()

    def upsert(self, kind: str, new: DataFrame, fresh_parts: Iterable[int] = (), sources: dict[int, str] | None = None) -> str:
        """Like :meth:`write` for the table in which ``new`` replaces all rows of its indices.

        Only the parts that ``new`` touches are written: those that it fills alone once, others with what stays of
        them. ``fresh_parts`` are emptied first. New columns or wider types rewrite the table.
        """
        old = self.parts(kind)
        if old is None:
            old = Parts(_plain(new.schema), self.width, {})
        kept = {k: path for k, path in old.paths.items() if k not in set(fresh_parts)}
        schema = _plain(merged_schema(old.schema, new.schema))
        if schema != old.schema or old.width != self.width:
            whole = apply_schema(self._frame(old.schema, kept.values()), schema)
            new = apply_schema(new, schema)
            whole = whole.join(new.select("g_index"), "g_index", "left_anti").unionByName(new)
            return Parts(schema, self.width, self._write_parts(kind, whole), sources or {}).text()
        written = self._write_parts(kind, apply_schema(new, schema))
        shared = {k: kept[k] for k in written if k in kept}
        if shared:
            added = self._frame(schema, [written[k] for k in shared])
            stays = self._frame(schema, shared.values()).join(added.select("g_index"), "g_index", "left_anti")
            written |= self._write_parts(kind, stays.unionByName(added))
        return Parts(schema, self.width, {**kept, **written}, sources or {}).text()

    def read(self, kind: str, parts: Iterable[int] | None = None) -> DataFrame | None:
        """The current table, or some of its parts; None if there is none."""
        known = self.parts(kind)
        if known is None:
            return None
        wanted = known.paths if parts is None else {k: known.paths[k] for k in parts if k in known.paths}
        return self._frame(known.schema, wanted.values())

    def lookup(self, kind: str, index: int) -> DataFrame | None:
        """The rows of one index: only the part that can hold it is opened."""
        known = self.parts(kind)
        return None if known is None else self.read(kind, [index // known.width]).where(F.col("g_index") == index)

    # --- removal ---------------------------------------------------------------------------

    def clean(self, keep: int = 1) -> None:
        """Delete what none of the last ``keep`` states refers to, and the older states.

        Frames of older versions cannot be read after it. Data goes first, so that a job that dies leaves no state
        without its data among those that are kept. Tasks delete, each some folders.
        """
        states = self._states()
        if states is None:
            return
        found = sorted(states.select("*", F.input_file_name().alias("file")).collect(), key=lambda r: -r["version"])
        last, older = found[:keep], found[keep:]
        needed = {path for state in last for kind in KINDS if state[kind] for path in Parts.of(state[kind]).paths.values()}
        needed |= {path.rsplit("/", 1)[0] for path in needed}
        gone = []
        for kind in KINDS:
            for version in (f"{kind}/{found.base_name}" for found in self._listed(kind)):
                if version not in needed:
                    gone.append(version)
                else:
                    folders = (f"{version}/{found.base_name}" for found in self._listed(version) if _FOLDER.fullmatch(found.base_name))
                    gone += [folder for folder in folders if folder not in needed]
        delete_folders(self.spark, self.root, gone)
        names = [row["file"].rsplit("/", 1)[-1] for row in older]
        # Local file systems keep a checksum beside every file.
        delete_folders(self.spark, self.root, [f"state/{name}" for n in names for name in (n, f".{n}.crc")])


def delete_folders(spark: SparkSession, root: str, names: list[str]) -> None:
    """Delete folders and files below ``root`` by tasks; what is gone already is no fault."""
    if not names:
        return
    ship_package(spark)
    root = qualified(spark, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = file_system(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                path = f"{base}/{name}"
                kind = system.get_file_info(path).type
                if kind == fs.FileType.Directory:
                    system.delete_dir(path)
                elif kind == fs.FileType.File:
                    system.delete_file(path)
            yield batch

    listed = spark.createDataFrame([(name,) for name in names], "name string")
    listed.mapInArrow(run, "name string").count()


def save_table(df: DataFrame, path: str) -> None:
    """Write a collected table with its index as a column, to a path of its own."""
    df.write.parquet(path)


def load_table(spark: SparkSession, path: str | None, schema: T.StructType | None = None) -> DataFrame:
    """Read a collected table; without one, a table of 0 rows with the given types."""
    if path is not None:
        return spark.read.parquet(path)
    return spark.createDataFrame([], schema or T.StructType())
