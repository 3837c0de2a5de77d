"""Session helpers: the shared scratch folder, and the ANSI setting of a plan."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .errors import StudyError

CHECKPOINT_KEY = "spark.checkpoint.dir"
ANSI_KEY = "spark.sql.ansi.enabled"

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()
#: Scratch paths to be deleted, one list for every open :func:`released`.
_held: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session (tests) may fall back to a temporary folder.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise StudyError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="sweepframe-")
    return _local_dirs[context.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has been written to."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    if _held:
        _held[-1].append(path)
    return path


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables that are made inside, at its end; what is kept must be stored elsewhere by then."""
    _held.append([])
    try:
        yield
    finally:
        for path in _held.pop():
            name = spark._jvm.org.apache.hadoop.fs.Path(path)
            name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)


@contextmanager
def ansi_mode(spark: SparkSession, enabled: bool) -> Iterator[None]:
    """Resolve expressions with the given error behaviour.

    Spark fixes error behaviour when an expression is resolved, so a plan keeps
    the setting that was active while it was built.
    """
    before = spark.conf.get(ANSI_KEY)
    spark.conf.set(ANSI_KEY, str(enabled).lower())
    try:
        yield
    finally:
        spark.conf.set(ANSI_KEY, before)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable where Python functions run, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="sweepframe-package-")
    archive = shutil.make_archive(
        os.path.join(folder, "sweepframe"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
