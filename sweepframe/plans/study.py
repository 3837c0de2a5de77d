"""A parameter study: definition, execution, collection and series queries."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StudyError
from ..operators import capture as captures_of
from ..operators import collect as collecting
from ..operators import steps as running
from ..operators.context import (
    Conditions,
    Evaluables,
    Label,
    check_evaluables,
    contexts,
    instances,
    override_contexts,
    single_context,
)
from ..operators.grid import Space
from ..operators.sweep import Aggregate, Condition, sweep
from ..session import released
from ..sources import export, text
from ..sources.filemaps import FileMap, mapped_files
from ..sources.files import write_files
from ..sources.store import KEEP, WIDTH, StudyStore, load_table
from ..types import declared_types, system_type, writable
from . import written
from .series import Plot, SeriesQuery

#: Most distinct keys of info files, as each is a column.
MAX_INFO_KEYS = 2000
#: Most distinct names of steps.
MAX_COMMANDS = 2000


class Study:
    """Axes, what is derived from them, what to run, what to capture, what to plot.

    ``root`` is a folder all executors reach; only the methods that store results
    need it. Its tables are kept in parts of ``width`` indices, and the last ``keep``
    states of the study stay readable (all of them if None).
    """

    def __init__(
        self,
        spark: SparkSession,
        axes: Mapping[str, Any] | None = None,
        *,
        constants: Mapping[str, Any] | None = None,
        evaluate: Evaluables = None,
        where: Conditions = None,
        logdir: Label = None,
        steps: running.Steps = (),
        captures: Sequence[Any] | Any = (),
        types: Mapping[str, str] | None = None,
        plots: Sequence[Plot] = (),
        root: str | None = None,
        sourcedir: str | None = None,
        width: int = WIDTH,
        keep: int | None = KEEP,
    ):
        self.spark = spark
        self.space = Space(axes)
        self.constants = dict(constants or {})
        check_evaluables(evaluate)
        self.evaluables, self.conditions, self.logdir = evaluate, where, logdir
        if not callable(steps):
            running.check_steps(steps)
        self.steps = steps
        self.captures = captures_of.as_captures(captures)
        captures_of.captured_names(self.captures)
        self.types = declared_types(types or {})
        self.plots = list(plots)
        self.sourcedir = sourcedir if sourcedir is not None else os.getcwd()
        self._store = StudyStore(spark, root, width, keep) if root is not None else None

    # --- grid ------------------------------------------------------------------------------

    def contexts(self) -> DataFrame:
        """Surviving grid points with index, label, constants and derived columns."""
        given = self._given()
        return self._ordered(
            contexts(self.spark, self.space, None, given, self.evaluables, self.conditions, self.logdir, True)
        )

    def _given(self) -> dict[str, Any]:
        """What every expression and label may use besides the axes."""
        return {**self.constants, "g_sourcedir": self.sourcedir}

    @staticmethod
    def _ordered(rows: DataFrame) -> DataFrame:
        return rows.select(*(c for c in rows.columns if c != "g_sourcedir"), "g_sourcedir")

    def context(self, index: int = 0, **values: Any) -> DataFrame:
        """The context of one explicitly given point; axes and conditions play no part."""
        return self._ordered(single_context(self.spark, values, self._given(), self.evaluables, self.logdir, index))

    def contexts_of(self, overrides: DataFrame) -> DataFrame:
        """Contexts of explicitly given points, one per row."""
        return self._ordered(override_contexts(overrides, self._given(), self.evaluables, self.logdir))

    def sweep(self, table: DataFrame, on: Sequence[Condition], aggs: Mapping[str, Aggregate]) -> DataFrame:
        """Aggregate the matching rows of a table for every grid point."""
        return sweep(self.contexts(), table, on, aggs, grid_size=self.space.full_size())

    # --- execution -------------------------------------------------------------------------

    @property
    def store(self) -> StudyStore:
        if self._store is None:
            raise StudyError("this study has no root folder to store results in")
        return self._store

    def commands(self, logs: DataFrame) -> list[str]:
        """Names of the steps; looked up in the logs if they depend on the context."""
        if not callable(self.steps):
            return [step.name for step in self.steps]
        found = logs.select("command").distinct().limit(MAX_COMMANDS + 1).collect()
        if len(found) > MAX_COMMANDS:
            raise StudyError(f"more than {MAX_COMMANDS} distinct commands, each of which would be a column")
        return sorted(row[0] for row in found)

    def captured(self, context_rows: DataFrame, logs: DataFrame) -> DataFrame:
        """Whole result rows: context, then run metadata, then captures over them."""
        texts = logs.select("g_index", "command", F.col("step_no").alias("cmd_no"), "text")
        results = [running.run_metadata(logs, self.commands(logs))]
        if self.captures:
            results.append(captures_of.capture_instances(texts, self.captures, self.types))
        return running.assemble(context_rows, *results)

    def create_instances(self) -> DataFrame:
        """Store an instance per grid point, replacing those with the same index."""
        return self._put_instances(self._created(self.contexts()))

    def _created(self, context_rows: DataFrame) -> DataFrame:
        captured = self.result_schema()
        return instances(context_rows).withColumn("captured", F.lit(None).cast(captured))

    def adopt(self, rows: DataFrame) -> DataFrame:
        """Store instances that were made elsewhere, such as those of a rebuilt tree; equal indices are replaced."""
        return self._put_instances(rows, has_collected=False, has_plotted=False)

    def rebuild(self, folder: str, book: str = text.BOOK, info: str | None = text.INFO_FILE) -> DataFrame:
        """Store the instances of a storage tree: contexts, captured records and info lines, typed by what they hold.

        The study's declared types come first, then those of system columns, then those merged over the tree; info lines
        that are neither declared nor system columns stay text. Records are whole, so info lines go over captured
        values, and those over the context. Points without a captured record have none.
        """
        with released(self.spark):
            rows = text.rebuild_instances(self.spark, folder, text.INFER, text.INFER, book)
            parts = [("context", rows.schema["context"].dataType), ("captured", rows.schema["captured"].dataType)]
            if info is not None:
                lines = text.read_info(self.spark, folder, info, book)
                keys = sorted(row[0] for row in lines.select("key").distinct().limit(MAX_INFO_KEYS + 1).collect())
                if len(keys) > MAX_INFO_KEYS:
                    raise StudyError(f"info files with more than {MAX_INFO_KEYS} keys")
                values = [F.max(F.when(F.col("key") == k, F.col("value"))).cast(self.types.get(k) or system_type(k) or "string").alias(k) for k in keys]
                if values:
                    told = lines.groupBy("logdir").agg(*values).select("logdir", F.struct(*keys).alias("_info"))
                    rows = rows.join(told, "logdir", "left")
                    parts.append(("_info", rows.schema["_info"].dataType))
            fields: dict[str, tuple[Any, Any]] = {}
            for column, struct in parts:
                for field in struct:
                    value = F.col(column)[field.name]
                    earlier = fields.get(field.name)
                    if earlier is not None and earlier[1] == field.dataType:
                        value = F.coalesce(value, earlier[0])
                    fields[field.name] = value, field.dataType
            whole = F.struct(*(value.cast(self.types.get(k, tp)).alias(k) for k, (value, tp) in fields.items()))
            return self.adopt(rows.withColumn("captured", F.when(F.col("captured").isNotNull(), whole)).drop("_info"))

    def _put_instances(self, rows: DataFrame, **changes: Any) -> DataFrame:
        self.store.commit(instances=self.store.upsert("instances", rows), **changes)
        return self.store.read("instances")

    def run(self) -> DataFrame:
        """Run the steps at every grid point and store what they wrote and captured.

        A failing point is data, not an error.
        """
        self.create_instances()
        return self._run(self.contexts())

    def run_sweep(self, table: DataFrame, on: Sequence[Condition], aggs: Mapping[str, Aggregate]) -> DataFrame:
        """Sweep a table and store the result of every grid point as a finished instance."""
        context_rows = self.contexts()
        with released(self.spark):
            rows = sweep(context_rows, table, on, aggs, grid_size=self.space.full_size())
            done = rows.select(
                "g_index",
                F.col("g_logdir").alias("logdir"),
                F.struct(*context_rows.columns).alias("context"),
                F.struct(*rows.columns).alias("captured"),
                F.lit("downloaded").alias("status"),
            )
            return self.adopt(done)

    def run_single(self, index: int = 0, **values: Any) -> DataFrame:
        """Run the steps at one explicitly given point."""
        return self._run(self.context(index, **values))

    def _run(self, context_rows: DataFrame) -> DataFrame:
        # Points that run are listed beside the instances, so that no phase rewrites those.
        points = self.store.write("running", context_rows.select("g_index"))
        self.store.commit(running=points, phase="prepared")
        self.store.commit(phase="started")
        # Steps may be slow or unrepeatable: their records are written before use.
        new_logs = running.map_instances(context_rows, self.steps)
        self.store.commit(logs=self.store.upsert("logs", new_logs), phase="finished")
        return self._capture(context_rows)

    def _capture(self, context_rows: DataFrame) -> DataFrame:
        logs = self.store.read("logs")
        rows = self.captured(context_rows, logs.join(context_rows.select("g_index"), "g_index", "left_semi"))
        done = (
            instances(context_rows)
            .join(rows.select("g_index", F.struct(*rows.columns).alias("captured")), "g_index")
            .withColumn("status", F.lit("downloaded"))
        )
        return self._put_instances(done, running=None, phase=None, has_collected=False, has_plotted=False)

    def capture(self) -> DataFrame:
        """Capture again from the stored texts; the same however often it is done.

        Instances without stored texts, such as swept ones, stay as they are.
        """
        logs = self.store.read("logs")
        if logs is None:
            return self.instances()
        done = self.instances("downloaded").select("context.*").join(logs.select("g_index"), "g_index", "left_semi")
        rows = self.captured(done, logs)
        merged = self.instances("downloaded").drop("captured").join(
            rows.select("g_index", F.struct(*rows.columns).alias("captured")), "g_index"
        )
        return self._put_instances(merged)

    # --- collection ------------------------------------------------------------------------

    def result_schema(self) -> T.StructType:
        """Types of a result row, known without running anything."""
        logs = self.spark.createDataFrame([], running.STEP_SCHEMA)
        schema = self.captured(self.contexts(), logs).schema
        return T.StructType([T.StructField(f.name, writable(f.dataType)) for f in schema])

    def instances(self, *statuses: str) -> DataFrame:
        rows = self.store.read("instances")
        if rows is None:
            rows = self._created(self.contexts()).limit(0)
        return collecting.with_status(self._as_far_as_run(rows), statuses)

    def _as_far_as_run(self, rows: DataFrame) -> DataFrame:
        points = self.store.read("running")
        if points is not None:
            # A run that has not ended, or died: its points are as far as it came.
            at = points.select("g_index", F.lit(self.store.state()["phase"]).alias("_phase"))
            rows = rows.join(at, "g_index", "left")
            rows = rows.withColumn("status", F.coalesce("_phase", "status")).drop("_phase")
        return rows

    def instance(self, index: int) -> DataFrame:
        """One instance; only the part of the table that can hold it is read."""
        rows = self.store.lookup("instances", index)
        return collecting.by_index(self.instances(), index) if rows is None else self._as_far_as_run(rows)

    def load_table(self) -> DataFrame:
        """The collected table; before collecting, 0 rows of the types it will have."""
        if self.store.state()["has_collected"]:
            return self.store.read("table")
        known = self.store.read("instances")
        schema = self.result_schema() if known is None else known.schema["captured"].dataType
        return load_table(self.spark, None, schema)

    def collect(self) -> DataFrame:
        """Upsert all finished instances into the collected table, each part in index order.

        Parts whose instances are those of the last time are left as they are.
        """
        stored = self.store.parts("instances")
        sources = {} if stored is None else stored.paths
        table = self.store.parts("table")
        known = {} if table is None else table.sources
        changed = [k for k, path in sources.items() if known.get(k) != path]
        if changed or table is None:
            # What was collected before a new run does not count: the parts that it changed are made anew.
            fresh = [] if self.store.state()["has_collected"] else changed
            rows = None if stored is None else self.store.read("instances", changed)
            rows = self.load_table() if rows is None else collecting.captured_rows(self._as_far_as_run(rows))
            self.store.commit(table=self.store.upsert("table", rows, fresh, sources), has_collected=True)
        elif not self.store.state()["has_collected"]:
            self.store.commit(has_collected=True)
        return self.store.read("table")

    def series(self, plot: Plot) -> SeriesQuery:
        return SeriesQuery(plot, self.space, self.load_table(), self.constants, self.evaluables)

    def plot(self) -> list[SeriesQuery]:
        """A series query for every plot; those without a variate have nothing to show."""
        queries = [query for query in map(self.series, self.plots) if query.kind is not None]
        self.store.commit(has_plotted=True)
        return queries

    def write_plots(self, folder: str) -> list[str]:
        """Write the points of every plot and combination of its fixed axes; returns their paths.

        Each goes to a CSV folder named by the plot's rendered file name, wide where it has at most ``MAX_SERIES``
        series, else one line per point. All of them are written by one job, in parts of bounded length.
        """
        queries = self.plot()
        with released(self.spark):
            return written.write_plots(self.spark, queries, folder)

    def documents(self, files: Sequence[FileMap], ignore_missing: bool = False) -> DataFrame:
        """``(g_index, target, text)`` of the files that every grid point gets from the source folder."""
        return mapped_files(self.contexts(), self.sourcedir, files, ignore_missing)

    def write_documents(self, files: Sequence[FileMap], folder: str, ignore_missing: bool = False) -> None:
        """Write them to ``folder/<logdir>/<target>``."""
        with released(self.spark):
            logdirs = self.contexts().select("g_index", "g_logdir")
            found = self.documents(files, ignore_missing).join(logdirs, "g_index")
            write_files(found.select(F.concat_ws("/", "g_logdir", "target").alias("path"), "text"), folder)

    def dump(self, path: str) -> None:
        export.write_dump(self.load_table(), path)

    # --- state -----------------------------------------------------------------------------

    def flags(self) -> dict[str, bool]:
        """What has been done, as five yes-or-no answers."""
        state = self.store.state()
        found = collecting.state_flags(self.instances()).first().asDict()
        return {**found, "has_collected": state["has_collected"], "has_plotted": state["has_plotted"]}

    def clear(self) -> None:
        """Forget instances and collected table, and delete all that was stored of them."""
        self.store.commit(instances=None, logs=None, table=None, running=None, phase=None, has_collected=False, has_plotted=False)
        self.store.clean(1)

    def clean(self, keep: int = 1) -> None:
        """Delete what none of the last ``keep`` states of the study needs."""
        self.store.clean(keep)

    def clear_table(self) -> None:
        self.store.commit(table=None, has_collected=False)
