"""Grids: products of axes, and dense numbering of their points."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import StudyError
from .axes import Axis, as_axis

ORDINAL = "g_ordinal"
POINTS_PER_PARTITION = 1_000_000
MAX_GRID_PARTITIONS = 10_000
# A place within a partition has 33 bits.
MAX_POINTS = MAX_GRID_PARTITIONS * 2**33


class Space(Mapping):
    """Ordered axes by name. The last axis varies fastest."""

    def __init__(self, axes: Mapping[str, Any] | None = None):
        if axes is not None and not isinstance(axes, Mapping):
            raise StudyError("axes must map names to values")
        self.axes: dict[str, Axis] = {name: as_axis(spec) for name, spec in (axes or {}).items()}

    def __getitem__(self, name: str) -> Axis:
        return self.axes[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.axes)

    def __len__(self) -> int:
        return len(self.axes)

    def size(self, *names: str) -> int:
        """Number of points in the product of the named axes (1 for none)."""
        return math.prod(len(self.axes[name]) for name in names)

    def full_size(self) -> int:
        return self.size(*self.axes)

    def background(self) -> dict[str, Any]:
        """First value of every axis."""
        return {name: axis[0] for name, axis in self.axes.items()}

    def product(self, spark: SparkSession, *names: str) -> DataFrame:
        """Every combination of the named axes, with its ordinal in product order.

        A range decoded digit by digit: no join, no shuffle, and as parallel as
        the range is. No names give one point without columns.
        """
        total = self.size(*names)
        if total > MAX_POINTS:
            raise StudyError(f"a product of {total} points cannot be numbered")
        points = spark.range(0, total, 1, partitions_for(total)).withColumnRenamed("id", ORDINAL)
        stride, digits = total, []
        for name in names:
            length = len(self.axes[name])
            stride = stride // length if length else 1
            digits.append(self.axes[name].at(digit(stride, length)).alias(name))
        return points.select(ORDINAL, *digits)

    def full(self, spark: SparkSession) -> DataFrame:
        return self.product(spark, *self.axes)


def partitions_for(total: int) -> int:
    """Partitions of a range of ``total`` points; never above the broadcast bound."""
    return min(MAX_GRID_PARTITIONS, max(1, math.ceil(total / POINTS_PER_PARTITION)))


def digit(stride: int, length: int) -> Column:
    """Mixed-radix digit of the ordinal column."""
    return F.expr(f"`{ORDINAL}` div {max(stride, 1)}L % {max(length, 1)}L")


def dense_index(points: DataFrame, parts: int, out: str = "g_index") -> DataFrame:
    """Number the surviving rows of a range-based frame 0, 1, 2, .. in order.

    ``points`` is a product followed by projections and filters only, so both
    passes below see the same rows in the same partitions, also when a lost
    partition is recomputed. A row's place in its partition comes for free; what
    the earlier partitions hold is a prefix sum over at most
    ``MAX_GRID_PARTITIONS`` counts, which is what gets broadcast.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    if parts == 1:
        return points.withColumn(out, place)
    counts = points.groupBy(F.spark_partition_id().alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        points.withColumns({"_place": place, "_part": F.spark_partition_id()})
        .join(F.broadcast(starts), "_part")
        .withColumn(out, F.col("_start") + F.col("_place"))
        .drop("_part", "_place", "_start")
    )
