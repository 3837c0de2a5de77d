"""Functions over list columns, and means that also work on lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StudyError


def is_list(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.ArrayType)


def flatten_rows(df: DataFrame, column: str, out: str = "value", pos: str = "pos") -> DataFrame:
    """One row per list element with its place in the list; scalars pass through."""
    rest = [c for c in df.columns if c != column]
    if not is_list(df, column):
        return df.select(*rest, F.lit(0).alias(pos), F.col(column).alias(out))
    return df.select(*rest, F.posexplode(column).alias(pos, out))


def mean_of(value: Column, tp: T.DataType, name: str) -> Column:
    """Mean of a scalar column; texts have none."""
    if isinstance(tp, T.BooleanType):
        return F.avg(value.cast("double"))
    if isinstance(tp, T.NumericType):
        # A NaN counts as missing, as it does in a data frame.
        plain = value.cast("double")
        return F.avg(F.when(~F.isnan(plain), plain))
    raise StudyError(f"column {name!r} of type {tp.simpleString()} has no mean")


def list_means(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Element-wise means of list columns within each group.

    All lists of a row are taken apart together and averaged by position, partially
    before the shuffle, so a hot group costs no more than its longest list per task.
    Lists of unequal length in one group are an error; a group without any is null.
    """
    numbers = range(len(columns))
    # Zipping needs lists; a missing one counts as empty and has no size.
    lists = [F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>")).alias(f"_v{i}") for i, c in enumerate(columns)]
    sizes = [F.when(F.col(c).isNotNull(), F.size(c)).alias(f"_n{i}") for i, c in enumerate(columns)]
    zipped = F.arrays_zip(*(f"_v{i}" for i in numbers))
    cells = df.select(*keys, *sizes, *lists).select(
        *keys, *(f"_n{i}" for i in numbers), F.posexplode_outer(zipped).alias("_pos", "_at")
    )
    means = cells.groupBy(*keys, "_pos").agg(
        *(F.avg(f"_at._v{i}").alias(f"_mean{i}") for i in numbers),
        *(F.min(f"_n{i}").alias(f"_shortest{i}") for i in numbers),
        *(F.max(f"_n{i}").alias(f"_longest{i}") for i in numbers),
    )
    entry = F.when(F.col("_pos").isNotNull(), F.struct("_pos", *(f"_mean{i}" for i in numbers)))
    grouped = means.groupBy(*keys).agg(
        F.sort_array(F.collect_list(entry)).alias("_entries"),
        *(F.min(f"_shortest{i}").alias(f"_shortest{i}") for i in numbers),
        *(F.max(f"_longest{i}").alias(f"_longest{i}") for i in numbers),
    )

    def checked(i: int) -> Column:
        longest = F.col(f"_longest{i}")
        own = F.transform(F.slice("_entries", F.lit(1), longest), lambda e: e[f"_mean{i}"])
        fault = F.raise_error(F.lit(f"lists of unequal length in {columns[i]}")).cast("array<double>")
        return F.when(F.col(f"_shortest{i}") != longest, fault).when(longest.isNotNull(), own)

    return grouped.select(*keys, *(checked(i).alias(columns[i]) for i in numbers))


def flexible_mean(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Group by ``keys`` and average every column, element-wise where it is a list."""
    lists = [c for c in columns if is_list(df, c)]
    scalars = [mean_of(F.col(c), df.schema[c].dataType, c).alias(c) for c in columns if c not in lists]
    groups = df.groupBy(*keys).agg(*scalars) if scalars else df.select(*keys).distinct()
    if lists:
        groups = null_safe_join(groups, list_means(df, keys, lists), keys)
    return groups.select(*keys, *columns)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys`` where null equals null, keeping one copy of the keys."""
    if not keys:
        marked = null_safe_join(left.withColumn("_one", F.lit(1)), right.withColumn("_one", F.lit(1)), ["_one"])
        return marked.drop("_one")
    renamed = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, condition, "left").drop(*(f"_r_{k}" for k in keys))
