"""Series queries: how each axis of a collected table becomes part of a plot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StudyError
from ..functions.arrays import flexible_mean
from ..functions.template import quoted, render
from ..operators.axes import Axis, UniformAxis
from ..operators.context import Evaluables, add_constants, constant, evaluate
from ..operators.grid import ORDINAL, Space
from ..operators.ranking import count_not_above, running_total

FIXED, CATEGORY, VARIATE, MEAN, IGNORE = "fixed", "category", "variate", "mean", "ignore"
MODES = (FIXED, CATEGORY, VARIATE, MEAN, IGNORE)
#: Most series of a wide table, which has two columns for each.
MAX_SERIES = 5_000


@dataclass(frozen=True)
class Mode:
    """How an axis takes part; ``value`` of an ignored axis is for texts only."""

    kind: str
    value: Any = None

    @classmethod
    def of(cls, spec: Any) -> Mode:
        if isinstance(spec, Mode):
            mode = spec
        elif isinstance(spec, str):
            mode = cls(spec)
        elif isinstance(spec, (tuple, list)) and len(spec) == 2:
            mode = cls(*spec)
        elif isinstance(spec, Mapping):
            mode = cls(spec.get("mode", ""), spec.get("value"))
        else:
            raise StudyError(f"bad axis mode {spec!r}")
        if mode.kind not in MODES:
            raise StudyError(f"unknown axis mode {mode.kind!r}, expected one of {MODES}")
        return mode


@dataclass(frozen=True)
class Plot:
    """What to plot. Axes that are not mentioned are ignored.

    ``auto_x`` uses a single variate as x. ``pooled`` averages all mean axes at
    once instead of one after the other.
    """

    filename: str
    yaxis: Sequence[str] | str
    axes: Mapping[str, Any] = field(default_factory=dict)
    xaxis: str | None = None
    kind: str | None = None
    legend: str | None = None
    title: str | None = None
    xlabel: str | None = None
    ylabel: str | None = None
    xmode: str = "linear"
    ymode: str = "linear"
    grid: bool = True
    auto_x: bool = False
    pooled: bool = False

    def __post_init__(self) -> None:
        for mode in self.axes.values():
            Mode.of(mode)
        if self.kind not in (None, "line", "scatter"):
            raise StudyError(f"unknown plot kind {self.kind!r}")
        if not {self.xmode, self.ymode} <= {"linear", "log"}:
            raise StudyError("axis scales are linear or log")

    @property
    def ycolumns(self) -> list[str]:
        return [self.yaxis] if isinstance(self.yaxis, str) else list(self.yaxis)


class SeriesQuery:
    """One plot over one collected table.

    ``points`` are the data, ``series`` has a row per series even if it is empty,
    ``plots`` a row per plot with its texts, ``wide`` the two-column-per-series form.
    """

    def __init__(
        self,
        plot: Plot,
        space: Space,
        table: DataFrame,
        constants: Mapping[str, Any] | None = None,
        evaluables: Evaluables = None,
    ):
        unknown = set(plot.axes) - set(space)
        if unknown:
            raise StudyError(f"plot mentions unknown axes {sorted(unknown)}")
        self.plot, self.space, self.table = plot, space, table
        self.constants, self.evaluables = constants, evaluables
        self.modes = {name: Mode.of(plot.axes.get(name, IGNORE)) for name in space}
        self.xaxis = plot.xaxis
        variates = self.of_kind(VARIATE)
        if plot.auto_x and self.xaxis is None and len(variates) == 1:
            self.xaxis = variates[0]
        missing = [c for c in [*plot.ycolumns, *([self.xaxis] if self.xaxis else [])] if c not in table.columns]
        if missing:
            raise StudyError(f"the table has no column {missing}")
        lists = {self._is_list(c) for c in [*plot.ycolumns, *([self.xaxis] if self.xaxis else [])]}
        if len(lists) > 1:
            raise StudyError("x and y columns must be all lists or all single values")
        self.lists = lists.pop()
        effective = len(variates) + self.lists
        # One effective variate is always a line, more are always a scatter.
        self.kind = {0: None, 1: "line"}.get(effective, "scatter")

    def of_kind(self, kind: str) -> list[str]:
        return [name for name, mode in self.modes.items() if mode.kind == kind]

    def _is_list(self, column: str) -> bool:
        return isinstance(self.table.schema[column].dataType, T.ArrayType)

    @property
    def keys(self) -> list[str]:
        return [*self.of_kind(FIXED), *self.of_kind(CATEGORY)]

    # --- data ------------------------------------------------------------------------------

    def collapsed(self) -> tuple[DataFrame, list[tuple[str, Axis | None]]]:
        """The table with ignored and averaged axes collapsed, and its row order.

        Axes are collapsed one after the other, ignored ones first, always grouping by
        all the other axes. The order lists columns with the axis whose values they
        hold; a column of means has none.
        """
        axes = list(self.space)
        values = list(dict.fromkeys([*self.plot.ycolumns, *([self.xaxis] if self.xaxis else [])]))
        extra = [c for c in values if c not in axes]
        data = self.table.select("g_index", *axes, *extra)
        # Plots and series are those of the axes, so rows with other values belong to none.
        for key in self.keys:
            data, place = place_of(data, key, self.space[key], "_key")
            data = data.where(place % 2 == 1).drop("_key")
        order: list[tuple[str, Axis | None]] | None = None
        constant_axes: set[str] = set()

        for name in self.of_kind(IGNORE):
            if self.modes[name].value is not None:
                continue
            others = [a for a in axes if a != name]
            # Once an axis is collapsed there is no index; rows of a group differ in the axis being collapsed.
            rank = "g_index" if order is None else name
            data = data.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in others), F.lit(True)))
            first = {
                c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(rank))) for c in [name, *extra]
            }
            data = data.groupBy(*others).agg(*(column.alias(c) for c, column in first.items()))
            data = data.select(*axes, *extra)
            order = [(a, self.space[a]) for a in others]

        means = self.of_kind(MEAN)
        data = data.select(*(["g_index"] if order is None else []), *axes, *extra)
        for group in [means] if self.plot.pooled and means else [[m] for m in means]:
            others = [a for a in axes if a not in group]
            data = data.where(
                reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in others if c not in constant_axes), F.lit(True))
            )
            texts = [a for a in group if isinstance(data.schema[a].dataType, T.StringType)]
            averaged = [c for c in [*group, *extra] if c not in texts]
            data = flexible_mean(data, others, averaged).withColumns(
                {a: F.lit(None).cast("string") for a in texts}
            )
            data = data.select(*axes, *extra)
            constant_axes.update(texts)
            done = {a for m in means[: means.index(group[-1]) + 1] for a in [m]}
            order = [(a, None if a in done else self.space[a]) for a in others if a not in constant_axes]
        return data, order if order is not None else [("g_index", None)]

    def points(self) -> DataFrame:
        """Points of every series: plot and series keys, ``yaxis``, ``pos``, ``x``, ``y``.

        ``pos`` counts from 1 within a series. No window holds a whole series unless
        the axes bound it to a block.
        """
        data, order = self.collapsed()
        data, ranks = self._ranked(data, order)
        entries = [
            F.struct(
                F.lit(number).alias("_series"),
                F.lit(name).alias("yaxis"),
                F.col(name).cast(self._ytype()).alias("_y"),
                *([F.col(self.xaxis).alias("_x")] if self.xaxis else []),
            )
            for number, name in enumerate(self.plot.ycolumns)
        ]
        keys = self.keys
        key_columns = [F.col(k).alias(f"_key_{k}") for k in keys]
        ties = [F.col(a).alias(f"_tie_{a}") for a, axis in order if axis is not None and a not in keys]
        rows = data.select(*key_columns, *(r for r, _ in ranks), *ties, F.inline(F.array(*entries)))
        if self.lists:
            rows = rows.withColumn("_n", F.coalesce(F.size("_y"), F.lit(0)).cast("long"))
        else:
            rows = rows.withColumn("_n", F.lit(1).cast("long"))
        ties = [c for c in rows.columns if c.startswith("_tie_")]
        most = self.space.size(*(a for a in self.space if a not in keys))
        rows = running_total(rows, [*(f"_key_{k}" for k in keys), "yaxis"], ranks, "_n", "_before", ties, most)
        if self.lists:
            zipped = F.arrays_zip("_y", "_x") if self.xaxis else F.arrays_zip("_y")
            rows = rows.select("*", F.posexplode(zipped).alias("_at", "_point"))
            rows = rows.withColumn("_before", F.col("_before") + F.col("_at"))
            y, x = F.col("_point._y"), F.col("_point._x") if self.xaxis else None
        else:
            y, x = F.col("_y"), F.col("_x") if self.xaxis else None
        pos = F.col("_before") + 1
        return rows.select(
            *(F.col(f"_key_{k}").alias(k) for k in keys),
            "yaxis",
            pos.alias("pos"),
            (pos if x is None else x).alias("x"),
            y.alias("y"),
        )

    def _ytype(self) -> T.DataType:
        """Common type of the y columns after averaging."""
        types = {self.table.schema[c].dataType.simpleString() for c in self.plot.ycolumns}
        averaged = bool(self.of_kind(MEAN))
        if len(types) == 1 and not averaged:
            return self.table.schema[self.plot.ycolumns[0]].dataType
        return T.ArrayType(T.DoubleType()) if self.lists else T.DoubleType()

    def _ranked(self, data: DataFrame, order: list[tuple[str, Axis | None]]) -> tuple[DataFrame, list[tuple[str, int | None]]]:
        """Add the order as columns of known bound, each axis by the place of its values."""
        if order and order[0] == ("g_index", None):
            return data.withColumn("_rank_index", F.col("g_index")), [("_rank_index", max(1, self.space.full_size()))]
        ranks: list[tuple[str, int | None]] = []
        merged: tuple[Column, int] | None = None

        def flush() -> None:
            nonlocal data, merged
            if merged is not None:
                name = f"_rank_{len(ranks)}"
                data = data.withColumn(name, merged[0])
                ranks.append((name, merged[1]))
                merged = None

        for number, (name, axis) in enumerate(order):
            if name in self.keys:
                continue  # constant within a series
            if axis is None:
                flush()
                data = data.withColumn(f"_rank_{len(ranks)}", F.col(name))
                # Means differ only where conditions left an axis with different values.
                ranks.append((f"_rank_{len(ranks)}", None))
                continue
            data, rank = place_of(data, name, axis, f"_place_{number}")
            size = 2 * len(axis) + 1
            if merged is not None and merged[1] * size < 2**62:
                merged = (merged[0] * size + rank, merged[1] * size)
            else:
                flush()
                merged = (rank, size)
        flush()
        return data, ranks

    # --- texts -----------------------------------------------------------------------------

    def _combinations(self, spark: SparkSession) -> DataFrame:
        """Context of every fixed and category combination, conditions not applied.

        Axes that are neither take the value given for them or their first one.
        """
        axes = self.keys
        rows = self.space.product(spark, *axes)
        categories = self.space.size(*self.of_kind(CATEGORY))
        rows = rows.withColumns(
            {
                "_plot_no": F.expr(f"`{ORDINAL}` div {max(categories, 1)}L"),
                "_series_no": F.expr(f"`{ORDINAL}` % {max(categories, 1)}L"),
                **{f"_key_{a}": F.col(a) for a in axes},
            }
        )
        rest = {}
        for name, first in self.space.background().items():
            if name not in axes:
                given = self.modes[name].value if self.modes[name].kind == IGNORE else None
                rest[name] = constant(first if given is None else given)
        rows = rows.withColumns(rest) if rest else rows
        return evaluate(add_constants(rows, self.constants), self.evaluables)

    def series(self) -> DataFrame:
        """One row per plot, category combination and y column, with its legend."""
        rows = self._combinations(self.table.sparkSession)
        names = F.posexplode(F.array(*map(F.lit, self.plot.ycolumns))).alias("_y_no", "yaxis")
        rows = rows.select("*", names)
        categories = self.of_kind(CATEGORY)
        if self.plot.legend is not None:
            legend = render(rows, self.plot.legend)
        elif categories:
            parts = [F.concat(F.lit(f"{c}="), quoted(F.col(c), rows.schema[c].dataType)) for c in categories]
            legend = F.concat(F.concat_ws(", ", *parts), F.lit(" ("), F.col("yaxis"), F.lit(")"))
        else:
            legend = F.col("yaxis")
        return rows.select(
            F.col("_plot_no").alias("plot_no"),
            (F.col("_series_no") * len(self.plot.ycolumns) + F.col("_y_no")).alias("series_no"),
            *(F.col(f"_key_{k}").alias(k) for k in self.keys),
            "yaxis",
            legend.alias("legend"),
        )

    def series_sizes(self) -> DataFrame:
        """Every series with its number of points, 0 where no row belongs to it."""
        on = [*self.keys, "yaxis"]
        counts = self.points().groupBy(*on).agg(F.count(F.lit(1)).alias("n_points"))
        return self.series().join(counts, on, "left").fillna(0, ["n_points"])

    def plots(self) -> DataFrame:
        """One row per plot with its rendered texts and settings.

        Texts see the last category combination of the plot, in product order.
        """
        rows = self._combinations(self.table.sparkSession)
        last = max(self.space.size(*self.of_kind(CATEGORY)) - 1, 0)
        rows = rows.where(F.col("_series_no") == last)
        texts = {n: render(rows, getattr(self.plot, n)) for n in ("filename", "title", "xlabel", "ylabel")}
        return rows.select(
            F.col("_plot_no").alias("plot_no"),
            *(F.col(f"_key_{k}").alias(k) for k in self.of_kind(FIXED)),
            *(text.alias(name) for name, text in texts.items()),
            F.lit(self.kind).cast("string").alias("kind"),
            F.lit(self.plot.xmode).alias("xmode"),
            F.lit(self.plot.ymode).alias("ymode"),
            F.lit(self.plot.grid).alias("grid"),
        )

    def wide(self, **fixed: Any) -> DataFrame:
        """Two columns per series for one plot, named by the legends; short series end in nulls.

        ``fixed`` gives the value of every fixed axis. The series are known from the
        axes, so nothing is looked up in the data to name the columns. More than
        ``MAX_SERIES`` of them are an error, as a table cannot be that wide.
        """
        if set(fixed) != set(self.of_kind(FIXED)):
            raise StudyError(f"give a value for each of {self.of_kind(FIXED)}")
        points, series = self.points(), self.series()
        for name, value in fixed.items():
            points, series = points.where(F.col(name) == value), series.where(F.col(name) == value)
        known = series.orderBy("series_no").limit(MAX_SERIES + 1).collect()
        if len(known) > MAX_SERIES:
            raise StudyError(f"a plot of more than {MAX_SERIES} series has no wide form")
        on = [*self.of_kind(CATEGORY), "yaxis"]
        numbered = points.join(F.broadcast(series.select(*on, "series_no")), on)
        numbers = [row["series_no"] for row in known]
        cells = numbered.groupBy("pos").pivot("series_no", numbers).agg(F.max("x").alias("x"), F.max("y").alias("y"))
        named = [(f"{n}_{c}", row["legend"] + end) for n, row in zip(numbers, known) for c, end in (("x", " (x-axis)"), ("y", ""))]
        return cells.select("pos", *(F.col(cell).alias(name) for cell, name in named))


def place_of(df: DataFrame, name: str, axis: Axis, out: str) -> tuple[DataFrame, Column]:
    """Place of a column's value among the sorted values of its axis, whatever their number.

    The k-th value (from 0) has place 2k + 1, what lies between two values the even place there,
    null place 0. The column ``out`` is added to the data.
    """
    literal = Axis(sorted(set(axis))).literal()
    value = F.col(name).cast(axis.element_type)
    df = count_not_above(df, value, literal, len(axis), out)
    found = F.coalesce(F.get(literal, F.col(out) - 1) == value, F.lit(False))
    return df, (F.col(out) * 2 - found.cast("int")).cast("long")


def all_points(queries: Sequence[SeriesQuery]) -> DataFrame:
    """Points of several plots in one frame, with keys as one text column."""
    frames = []
    for number, query in enumerate(queries):
        points = query.points()
        keys = F.to_json(F.struct(*query.keys)) if query.keys else F.lit("{}")
        frames.append(
            points.select(
                F.lit(number).alias("plot"),
                keys.alias("series"),
                "yaxis",
                "pos",
                F.col("x").cast("double").alias("x"),
                F.col("y").cast("double").alias("y"),
            )
        )
    return reduce(DataFrame.unionByName, frames)
