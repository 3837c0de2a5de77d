"""Running user functions at every grid point, and the records they leave."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import StudyError
from ..session import ship_package
from ..types import WALLTIME_PREFIX

DEFAULT_ATTEMPTS = 3

# The columns of a step record.
STEP_SCHEMA = (
    "g_index long, step_no int, command string, text string, error string, ok boolean, "
    "allow_failure boolean, started timestamp_ntz, finished timestamp_ntz, walltime double"
)

#: Records, and characters of their texts, that a task hands on at once.
_RECORDS, _CHARACTERS = 1000, 4 << 20


class StepFailed(Exception):
    """Raised by a step to fail while keeping the text it has written."""

    def __init__(self, text: str = "", error: str = ""):
        super().__init__(error)
        self.text, self.error = text, error


@dataclass(frozen=True)
class Step:
    """A named function from a context to text, with what to do when it fails."""

    name: str
    function: Callable[[Mapping[str, Any]], str]
    allow_failure: bool = False
    retry_on_fail: bool = False
    max_attempts: int = DEFAULT_ATTEMPTS


Steps = Sequence[Step] | Callable[[Mapping[str, Any]], Sequence[Step]]


def check_steps(steps: Sequence[Step]) -> None:
    names = [step.name for step in steps]
    if len(set(names)) != len(names):
        raise StudyError(f"step names must be unique: {names}")


def run_step(step: Step, context: Mapping[str, Any]) -> tuple[str, str | None, bool]:
    text, error = "", None
    for _ in range(step.max_attempts if step.retry_on_fail else 1):
        try:
            return str(step.function(context)), None, True
        except StepFailed as failure:
            text, error = failure.text, failure.error
        except Exception:
            text, error = "", traceback.format_exc()
    return text, error, False


def run_point(steps: Steps, context: Mapping[str, Any]) -> Iterator[dict[str, Any]]:
    """Records of one point, up to and including the first failure that counts."""
    chosen = steps(context) if callable(steps) else steps
    check_steps(chosen)
    for number, step in enumerate(chosen):
        started, clock = datetime.now(), time.perf_counter()
        text, error, ok = run_step(step, context)
        yield {
            "g_index": context["g_index"],
            "step_no": number,
            "command": step.name,
            "text": text,
            "error": error,
            "ok": ok,
            "allow_failure": step.allow_failure,
            "started": started,
            "finished": datetime.now(),
            "walltime": time.perf_counter() - clock,
        }
        if not ok and not step.allow_failure:
            return


def map_instances(contexts: DataFrame, steps: Steps, partitions: int | None = None) -> DataFrame:
    """Run the steps for every context row; one record per step that ran.

    Points are spread by index, so slow functions keep all executors busy. A
    failure is recorded and never stops other points. Steps are run again if the
    result is used again, so callers store it once. A step sees the values of the
    context as they are: integers stay integers next to nulls, lists are lists.
    """
    if not callable(steps):
        check_steps(steps)
    ship_package(contexts.sparkSession)
    count = partitions or contexts.sparkSession.sparkContext.defaultParallelism * 4
    schema = to_arrow_schema(T.StructType.fromDDL(STEP_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, held = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                (context,) = batch.slice(row, 1).to_pylist()
                for record in run_point(steps, context):
                    records.append(record)
                    held += len(record["text"]) + len(record["error"] or "")
                    if len(records) >= _RECORDS or held >= _CHARACTERS:
                        yield pa.RecordBatch.from_pylist(records, schema)
                        records, held = [], 0
        if records:
            yield pa.RecordBatch.from_pylist(records, schema)

    return contexts.repartition(count, "g_index").mapInArrow(run, STEP_SCHEMA)


def fail_fast(records: DataFrame) -> DataFrame:
    """Drop what was recorded after a point's first failure that counts.

    One small aggregate joined back, so a point with very many records is
    neither sorted nor gathered.
    """
    stops = (~F.col("ok")) & (~F.col("allow_failure"))
    first = (
        records.where(stops)
        .groupBy(F.col("g_index").alias("_point"))
        .agg(F.min("step_no").alias("_stop"))
    )
    return (
        records.join(first, F.col("g_index") == F.col("_point"), "left")
        .where(F.col("_stop").isNull() | (F.col("step_no") <= F.col("_stop")))
        .drop("_point", "_stop")
    )


def run_metadata(records: DataFrame, commands: Sequence[str]) -> DataFrame:
    """One row per point: start, end, success and the wall time of each command.

    A command recorded twice keeps the later time.
    """
    times = [
        F.max_by(
            F.when(F.col("command") == name, F.col("walltime")),
            F.when(F.col("command") == name, F.col("step_no")),
        ).alias(f"{WALLTIME_PREFIX}_{name}")
        for name in commands
    ]
    return records.groupBy("g_index").agg(
        F.min("started").alias("g_started"),
        F.max("finished").alias("g_finished"),
        F.bool_and(F.col("ok") | F.col("allow_failure")).alias("g_success"),
        *times,
    )


def assemble(contexts: DataFrame, *results: DataFrame) -> DataFrame:
    """Contexts joined with result tables by index; later values win over earlier.

    A value that is missing from a later table leaves the earlier one.
    """
    for result in results:
        clashing = [c for c in result.columns if c in contexts.columns and c != "g_index"]
        later = result.withColumnsRenamed({c: f"_later_{c}" for c in clashing})
        joined = contexts.join(later, "g_index", "left")
        joined = joined.withColumns({c: F.coalesce(f"_later_{c}", c) for c in clashing})
        contexts = joined.drop(*(f"_later_{c}" for c in clashing))
    return contexts
