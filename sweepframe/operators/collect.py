"""Collecting instances into one table, and the state of a set of instances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StudyError
from ..types import apply_schema, merged_schema

# The life cycle of an instance.
STATUSES = ("created", "prepared", "started", "finished", "downloaded")


def upsert(old: DataFrame, new: DataFrame, key: str = "g_index") -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key, whole rows at a time.

    New columns appear, missing ones become null, types are widened to hold both.
    """
    schema = merged_schema(old.schema, new.schema)
    kept = old.join(new.select(key), key, "left_anti")
    return apply_schema(kept, schema).unionByName(apply_schema(new, schema))


def nan_to_null(df: DataFrame) -> DataFrame:
    """A missing number is null, so that means and first values skip it."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def captured_rows(instances: DataFrame) -> DataFrame:
    """Flat rows of the instances that are done: the context with captures over it.

    ``captured`` is the whole record of a point, so it already holds the context.
    """
    done = instances.where(F.col("status") == "downloaded")
    return nan_to_null(done.select("captured.*"))


def collect(old: DataFrame, instances: DataFrame) -> DataFrame:
    """Upsert every finished instance into the collected table, sorted by index."""
    return upsert(old, captured_rows(instances)).orderBy("g_index")


def with_status(instances: DataFrame, statuses: Sequence[str] = ()) -> DataFrame:
    """Instances in one of the given statuses; all of them when none is given."""
    unknown = set(statuses) - set(STATUSES)
    if unknown:
        raise StudyError(f"unknown status {sorted(unknown)}")
    return instances.where(F.col("status").isin(*statuses)) if statuses else instances


def by_index(instances: DataFrame, index: int) -> DataFrame:
    return instances.where(F.col("g_index") == index)


def status_counts(instances: DataFrame) -> DataFrame:
    return instances.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def state_flags(instances: DataFrame) -> DataFrame:
    """One row: is anything running, is there data, has everything been captured."""
    status = F.col("status")
    return instances.agg(
        F.coalesce(F.bool_or(status.isin("prepared", "started")), F.lit(False)).alias("is_running"),
        F.coalesce(F.bool_or(status == "downloaded"), F.lit(False)).alias("has_data"),
        F.coalesce(F.bool_and(F.col("captured").isNotNull()), F.lit(True)).alias("has_captured"),
    )
