"""Contexts: grid points with constants, derived columns, conditions and labels."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StudyError
from ..functions.scalar import register_functions
from ..functions.template import expression_types, render
from ..session import ansi_mode
from .grid import ORDINAL, Space, dense_index, partitions_for

Evaluables = Mapping[str, Any] | Callable[[dict[str, Column]], Mapping[str, Any]] | None
Conditions = str | Column | Sequence[str | Column] | Callable[[dict[str, Column]], Column] | None
Label = str | Callable[[dict[str, Column]], Column] | None

DEFAULT_LOGDIR = "${g_index}"


def columns_of(df: DataFrame) -> dict[str, Column]:
    """The columns of a frame by name, as handed to user functions."""
    return {name: F.col(f"`{name}`") for name in df.columns if not name.startswith("g_")}


def constant(value: Any) -> Column:
    if isinstance(value, Column):
        return value
    if value is None or isinstance(value, (str, bool, int, float)):
        return F.lit(value) if not isinstance(value, int) or isinstance(value, bool) else F.lit(value).cast("long")
    raise StudyError(f"a constant must be text, a number, a boolean or None, not {value!r}")


def check_evaluables(evaluables: Evaluables) -> None:
    if evaluables is None or callable(evaluables):
        return
    if not isinstance(evaluables, Mapping):
        raise StudyError("evaluate must map names to expressions")
    for value in evaluables.values():
        constant(value)


def add_constants(df: DataFrame, constants: Mapping[str, Any] | None) -> DataFrame:
    """Add constant columns; a column that is already there wins."""
    new = {name: constant(value) for name, value in (constants or {}).items() if name not in df.columns}
    return df.withColumns(new) if new else df


def evaluate(df: DataFrame, evaluables: Evaluables) -> DataFrame:
    """Add derived columns in order; each sees the earlier ones and may overwrite.

    Texts are Spark SQL expressions, other values are constants. An expression
    that fails stops the job. The chain collapses into one projection.
    """
    check_evaluables(evaluables)
    spark = df.sparkSession
    register_functions(spark)
    with ansi_mode(spark, True):
        if callable(evaluables):
            made = evaluables(columns_of(df))
            check_evaluables(made)
            return df.withColumns({n: constant(v) for n, v in made.items()}) if made else df
        for name, value in (evaluables or {}).items():
            df = df.withColumn(name, F.expr(value) if isinstance(value, str) else constant(value))
    return df


def truthy(value: Column, tp: T.DataType) -> Column:
    """Whether a value counts as true: not zero, not empty, not null."""
    if isinstance(tp, T.BooleanType):
        test = value
    elif isinstance(tp, T.NumericType):
        test = value != 0
    elif isinstance(tp, T.StringType):
        test = F.length(value) > 0
    elif isinstance(tp, (T.ArrayType, T.MapType)):
        test = F.size(value) > 0
    else:
        test = value.isNotNull()
    return F.coalesce(test, F.lit(False))


def where(df: DataFrame, conditions: Conditions) -> DataFrame:
    """Keep the rows for which every condition holds.

    A condition that fails (say a division by zero) counts as false, so it is
    resolved without ANSI errors.
    """
    if conditions is None:
        return df
    spark = df.sparkSession
    register_functions(spark)
    if callable(conditions) and not isinstance(conditions, Column):
        parts: list[Any] = [conditions(columns_of(df))]
    elif isinstance(conditions, (str, Column)):
        parts = [conditions]
    elif isinstance(conditions, Sequence):
        parts = list(conditions)
    else:
        raise StudyError(f"where must be an expression, a list of them or a function, not {conditions!r}")
    if not all(isinstance(p, (str, Column)) for p in parts):
        raise StudyError("every condition must be an expression")
    if not parts:
        return df
    with ansi_mode(spark, False):
        tests = [F.expr(p) if isinstance(p, str) else p for p in parts]
        for test, tp in zip(tests, expression_types(df, tests)):
            df = df.where(truthy(test, tp))
    return df


def logdir_column(df: DataFrame, logdir: Label = None) -> Column:
    if callable(logdir):
        return logdir({**columns_of(df), **{c: F.col(c) for c in df.columns if c.startswith("g_")}}).cast("string")
    return render(df, DEFAULT_LOGDIR if logdir is None else logdir)


def contexts(
    spark: SparkSession,
    space: Space,
    names: Sequence[str] | None = None,
    constants: Mapping[str, Any] | None = None,
    evaluables: Evaluables = None,
    conditions: Conditions = None,
    logdir: Label = None,
    with_logdir: bool = False,
) -> DataFrame:
    """Grid points that survive the conditions, densely numbered in product order.

    Expressions must depend on the values of their own row only: numbering relies on
    the partitions of the range, which a window function would change.
    """
    axes = list(space) if names is None else list(names)
    points = space.product(spark, *axes)
    derived = evaluate(add_constants(points, constants), evaluables)
    kept = where(derived, conditions)
    if conditions is None or (isinstance(conditions, (list, tuple)) and not conditions):
        numbered = kept.withColumnRenamed(ORDINAL, "g_index")
    else:
        numbered = dense_index(kept, partitions_for(space.size(*axes))).drop(ORDINAL)
    if with_logdir:
        numbered = numbered.withColumn("g_logdir", logdir_column(numbered, logdir))
    rest = [c for c in numbered.columns if c != "g_index"]
    return numbered.select("g_index", *rest)


def override_contexts(
    overrides: DataFrame,
    constants: Mapping[str, Any] | None = None,
    evaluables: Evaluables = None,
    logdir: Label = None,
    index: int = 0,
) -> DataFrame:
    """Contexts from explicit values, one per row; axes and conditions play no part.

    Rows may bring their own ``g_index``; otherwise all get ``index``.
    """
    if "g_index" not in overrides.columns:
        overrides = overrides.withColumn("g_index", F.lit(index).cast("long"))
    made = evaluate(add_constants(overrides, constants), evaluables)
    return made.withColumn("g_logdir", logdir_column(made, logdir))


def single_context(
    spark: SparkSession,
    values: Mapping[str, Any],
    constants: Mapping[str, Any] | None = None,
    evaluables: Evaluables = None,
    logdir: Label = None,
    index: int = 0,
) -> DataFrame:
    """The context of one explicitly given point."""
    point = spark.range(1).select(*(constant(v).alias(k) for k, v in values.items()))
    return override_contexts(point, constants, evaluables, logdir, index)


def equal_slice(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    """Rows with the given value in every named column."""
    for name, value in values.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def instances(context_rows: DataFrame) -> DataFrame:
    """Instance rows for contexts: status created, nothing captured yet."""
    rest = [c for c in context_rows.columns if c not in ("g_index", "g_logdir")]
    return context_rows.select(
        "g_index",
        F.col("g_logdir").alias("logdir"),
        F.struct("g_index", "g_logdir", *rest).alias("context"),
        F.lit("created").alias("status"),
    )
