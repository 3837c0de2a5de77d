"""Sweep: aggregate a table once for every grid point, in one pass over it.

A condition compares an expression over the table with one over the grid. Rows
are never paired with grid points. Instead the table is reduced, before any
shuffle that grows with it, to one partial aggregate per *cell*: a combination
of the compared values (for equalities) and of the gaps between the grid's sorted
thresholds (for ranges). A grid point then covers a run of cells, which is split
into at most two blocks per power of two, and picks its blocks up by an equality
join against cells that were added up the same way.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StudyError
from ..functions.template import expression_types
from ..session import fresh_path
from .ranking import count_not_above, merged_places

MAX_BROADCAST_POINTS = 200_000
MAX_THRESHOLDS = 2**20
MAX_LITERALS = 1000
FEW_PLACES = 256
FEW_KEYS = 200

Condition = tuple[str | Column, str, str | Column]
Aggregate = tuple[str, str | Column | None]

#: Digits of the whole numbers.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
_RANGE_OPERATORS = (">=", ">", "<", "<=")
_FUNCTIONS = ("count", "sum", "min", "max", "mean")


def _column(value: str | Column) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def _common_type(left: T.DataType, right: T.DataType) -> T.DataType:
    if left == right:
        return left
    exact = [_DIGITS.get(type(tp), getattr(tp, "precision", None)) for tp in (left, right)]
    if None not in exact and T.DecimalType in (type(left), type(right)):
        scales = [getattr(tp, "scale", 0) for tp in (left, right)]
        whole = max(digits - scale for digits, scale in zip(exact, scales))
        if whole + max(scales) <= 38:
            return T.DecimalType(whole + max(scales), max(scales))
    if isinstance(left, T.NumericType) and isinstance(right, T.NumericType):
        fractional = (T.DoubleType, T.FloatType, T.DecimalType)
        return T.DoubleType() if isinstance(left, fractional) or isinstance(right, fractional) else T.LongType()
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(left, times) and isinstance(right, times):
        return T.TimestampType() if T.TimestampType() in (left, right) else T.TimestampNTZType()
    raise StudyError(f"cannot compare {left.simpleString()} with {right.simpleString()}")


class _Partials:
    """The partial form of the requested aggregates: how to start, add up, finish."""

    def __init__(self, aggs: Mapping[str, Aggregate]):
        self.first: dict[str, Column] = {}
        self.again: dict[str, Column] = {}
        self.final: dict[str, Column] = {}
        for name, (function, value) in aggs.items():
            if function not in _FUNCTIONS:
                raise StudyError(f"unknown aggregate {function!r}, expected one of {_FUNCTIONS}")
            if function != "count" and value is None:
                raise StudyError(f"{function} needs an expression")
            column = F.lit(1) if value is None else _column(value)
            if function == "count":
                self._add(f"_n_{name}", F.count(column), F.sum)
                self.final[name] = F.coalesce(F.col(f"_n_{name}"), F.lit(0))
            elif function == "mean":
                self._add(f"_s_{name}", F.sum(column.cast("double")), F.sum)
                self._add(f"_n_{name}", F.count(column), F.sum)
                self.final[name] = F.when(F.col(f"_n_{name}") > 0, F.col(f"_s_{name}") / F.col(f"_n_{name}"))
            else:
                combine = {"sum": F.sum, "min": F.min, "max": F.max}[function]
                self._add(f"_v_{name}", combine(column), combine)
                self.final[name] = F.col(f"_v_{name}")

    def _add(self, name: str, start: Column, combine) -> None:
        self.first[name] = start.alias(name)
        self.again[name] = combine(name).alias(name)


def sweep(
    grid: DataFrame,
    table: DataFrame,
    on: Sequence[Condition],
    aggs: Mapping[str, Aggregate],
    grid_size: int | None = None,
) -> DataFrame:
    """Every column of ``grid`` plus the aggregates over its matching table rows.

    ``on`` lists ``(table expression, operator, grid expression)``, all of which
    must hold; operators are ``=``, ``<``, ``<=``, ``>`` and ``>=``. ``aggs`` maps
    names to ``(function, table expression)`` with count, sum, min, max or mean.
    Points nothing matches keep a row, with count 0 and null otherwise.
    ``grid_size`` is a known bound on the grid's rows; without it they are counted.
    """
    if not on:
        raise StudyError("a sweep needs at least one condition")
    if clashing := sorted(set(aggs) & set(grid.columns)):
        raise StudyError(f"aggregates named as grid columns: {clashing}")
    partials = _Partials(aggs)
    equal = [(_column(left), _column(right)) for left, op, right in on if op in ("=", "==")]
    ranged: dict[str, list[tuple[Column, str, Column]]] = {}
    for left, op, right in on:
        if op in _RANGE_OPERATORS:
            ranged.setdefault(str(left), []).append((_column(left), op, _column(right)))
        elif op not in ("=", "=="):
            raise StudyError(f"unknown operator {op!r}")
    if grid_size is None:
        grid_size = grid.count()

    conditions = [c for group in ranged.values() for c in group]
    table_types = iter(expression_types(table, [left for left, _ in equal] + [left for left, _, _ in conditions]))
    grid_types = iter(expression_types(grid, [right for _, right in equal] + [right for _, _, right in conditions]))
    keys = [f"_k{i}" for i in range(len(equal))]
    types = [_common_type(next(table_types), next(grid_types)) for _ in equal]
    rows = table.withColumns({k: left.cast(tp) for k, (left, _), tp in zip(keys, equal, types)})
    points = grid.select(
        "g_index",
        *(right.cast(tp).alias(k) for k, (_, right), tp in zip(keys, equal, types)),
        *(
            right.alias(f"_t{i}_{j}")
            for i, conditions in enumerate(ranged.values())
            for j, (_, _, right) in enumerate(conditions)
        ),
    )
    dimensions = [
        _Dimension(i, group, [_common_type(next(table_types), next(grid_types)) for _ in group])
        for i, group in enumerate(ranged.values())
    ]
    compared = [([key], tp) for key, tp in zip(keys, types)] + [(d.names, d.type) for d in dimensions]
    found = _few_values(points, compared, grid_size)
    # Rows no point asks for never reach an aggregation buffer.
    for key, (left, _), tp, few in zip(keys, equal, types, found):
        if few is not None and len(few) <= FEW_KEYS:
            rows = rows.where(left.cast(tp).isin([_from_text(F.lit(text), tp) for text in few]))
        elif grid_size <= MAX_BROADCAST_POINTS:
            rows = rows.join(F.broadcast(points.select(key).distinct()), key, "left_semi")
    for dimension, few in zip(dimensions, found[len(keys) :]):
        dimension.read_thresholds(points, few)
    wide = [d for d in dimensions if d.limit > MAX_THRESHOLDS]
    narrow = [d for d in dimensions if d not in wide]
    for dimension in narrow:
        rows = dimension.place_rows(rows)
    cells = [*keys, *(d.cell for d in narrow)]
    if wide:
        # Equal rows become one before they are merged with the thresholds; the table is scanned here and not again.
        rows = reduce(lambda df, d: d.within_bounds(df), wide, rows)
        cells = rows.groupBy(*cells, *(d.value.cast(d.type).alias(f"{d.cell}_value") for d in wide)).agg(*partials.first.values())
        for dimension in wide:
            cells = dimension.merge_rows(cells)
        cells = cells.groupBy(*keys, *(d.cell for d in dimensions)).agg(*partials.again.values())
    else:
        cells = rows.groupBy(*cells).agg(*partials.first.values())
    for dimension in dimensions:
        points = dimension.place_points(points)
    for number, dimension in enumerate(dimensions, 1):
        points = dimension.split_points(points)
        asked = points.select(*keys, *(d.cell for d in dimensions[:number])).distinct()
        cells = dimension.add_up(cells, [*keys, *(d.cell for d in dimensions)], partials, asked)

    block_keys = [*keys, *(d.cell for d in dimensions)]
    matched = points.select("g_index", *block_keys).join(cells, block_keys)
    if dimensions:
        matched = matched.groupBy("g_index").agg(*partials.again.values())
    matched = matched.select("g_index", *partials.first)
    if grid_size <= MAX_BROADCAST_POINTS:
        matched = F.broadcast(matched)
    return grid.join(matched, "g_index", "left").select(
        *grid.columns, *(final.alias(name) for name, final in partials.final.items())
    )


def _as_text(value: Column, tp: T.DataType) -> Column:
    """An exact text: instants as seconds since 1970 (local times repeat), both zeros as one."""
    if isinstance(tp, T.TimestampType):
        return (F.unix_micros(value).cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(6,6)")).cast("string")
    if isinstance(tp, (T.DoubleType, T.FloatType)):
        return F.when(value == 0, F.lit(0.0)).otherwise(value).cast("string")
    return value.cast("string")


def _from_text(text: Column, tp: T.DataType) -> Column:
    """What ``_as_text`` was made from; ``text`` may be an array."""
    if isinstance(tp, T.ArrayType):
        steps = [T.ArrayType(T.DecimalType(26, 6))] if isinstance(tp.elementType, T.TimestampType) else []
    else:
        steps = [T.DecimalType(26, 6)] if isinstance(tp, T.TimestampType) else []
    return reduce(lambda column, step: column.cast(step), [*steps, tp], text)


def _few_values(
    points: DataFrame, compared: Sequence[tuple[Sequence[str], T.DataType]], grid_size: int
) -> list[list[str] | None]:
    """Distinct values of groups of columns of the grid as text, or None for too many.

    What reaches the driver is bounded: by the size of the grid, or by counts taken first.
    """
    entries = [
        F.struct(F.lit(number).alias("number"), _as_text(F.col(name).cast(tp), tp).alias("text"))
        for number, (names, tp) in enumerate(compared)
        for name in names
    ]
    distinct = points.select(F.inline(F.array(*entries))).where(F.col("text").isNotNull()).distinct()
    wanted = set(range(len(compared)))
    if grid_size * len(entries) > MAX_BROADCAST_POINTS:
        counts = distinct.groupBy("number").count().where(F.col("count") <= MAX_LITERALS).collect()
        wanted = {row["number"] for row in counts}
        distinct = distinct.where(F.col("number").isin(*wanted)) if wanted else distinct.limit(0)
    found: list[list[str]] = [[] for _ in compared]
    for row in distinct.collect():
        found[row["number"]].append(row["text"])
    return [texts if n in wanted and len(texts) <= MAX_LITERALS else None for n, texts in enumerate(found)]


class _Dimension:
    """One table expression compared by range with thresholds of the grid.

    With the distinct thresholds sorted, place 2k is the gap above the k-th of
    them and place 2k - 1 the k-th itself, so open and closed ends differ by one.
    The thresholds depend on the grid alone; few of them become literals, so that
    the scan can skip what lies outside all ranges.
    """

    def __init__(self, number: int, conditions: list, types: list[T.DataType]):
        self.cell = f"_c{number}"
        self.ends = f"_from{number}", f"_to{number}"
        self.conditions = conditions
        self.value = conditions[0][0]
        self.names = [f"_t{number}_{j}" for j in range(len(conditions))]
        self.type = reduce(_common_type, types)

    def read_thresholds(self, points: DataFrame, few: list[str] | None) -> None:
        self.few = few
        self.distinct = points.select(
            F.explode(F.array(*(F.col(n).cast(self.type) for n in self.names))).alias("_t")
        ).where(F.col("_t").isNotNull()).distinct()
        self.numbered = None
        self.limit = self.distinct.count() if few is None else len(few)
        self.places = 2 * self.limit + 1
        self.levels = self.places.bit_length()

    def _literals(self) -> Column:
        # One text, so that the plan stays small until it is folded to an array.
        return F.sort_array(_from_text(F.from_json(F.lit(json.dumps(self.few)), "array<string>"), T.ArrayType(self.type)))

    def place_rows(self, rows: DataFrame) -> DataFrame:
        """Add the place of every row's value, dropping rows outside all ranges."""
        value = self.value.cast(self.type)
        rows = rows.where(value.isNotNull())
        if self.few:
            operators = {op for _, op, _ in self.conditions}
            if operators & {">", ">="}:
                rows = rows.where(value >= F.array_min(self._literals()))
            if operators & {"<", "<="}:
                rows = rows.where(value <= F.array_max(self._literals()))
        if self.few is None:
            rows = rows.withColumn("_sorted", self.distinct.agg(F.array_sort(F.collect_list("_t")).alias("_a")).scalar())
        thresholds = F.col("_sorted") if self.few is None else self._literals()
        placed = count_not_above(rows, value, thresholds, self.limit, "_below")
        on_threshold = F.get(thresholds, F.col("_below") - 1) == value
        place = F.col("_below") * 2 - F.when((F.col("_below") > 0) & on_threshold, 1).otherwise(0)
        return placed.withColumn(self.cell, place).drop("_sorted", "_below")

    def within_bounds(self, rows: DataFrame) -> DataFrame:
        """Rows between the outer thresholds, which become literals, so that the scan can skip the others."""
        value = self.value.cast(self.type)
        self.distinct = _stored(self.distinct, "thresholds")
        ends = self.distinct.agg(*(_as_text(end("_t"), self.type).alias(name) for name, end in (("low", F.min), ("high", F.max)))).first()
        operators = {op for _, op, _ in self.conditions}
        rows = rows.where(value.isNotNull())
        if operators & {">", ">="}:
            rows = rows.where(value >= _from_text(F.lit(ends["low"]), self.type))
        if operators & {"<", "<="}:
            rows = rows.where(value <= _from_text(F.lit(ends["high"]), self.type))
        return rows

    def merge_rows(self, cells: DataFrame) -> DataFrame:
        """Replace values by their places among more thresholds than one array holds."""
        placed, self.numbered = merged_places(_stored(cells, "values"), f"{self.cell}_value", self.distinct, "_t", self.cell)
        return placed.drop(f"{self.cell}_value")

    def place_points(self, points: DataFrame) -> DataFrame:
        """Turn the thresholds of every point into a run ``[from, to)`` of places."""
        lows, highs = [F.lit(0)], [F.lit(self.places)]
        for name, (_, op, _) in zip(self.names, self.conditions):
            threshold = F.col(name).cast(self.type)
            if self.few is not None:
                rank = F.array_position(self._literals(), threshold).cast("int" if self.numbered is None else "long")
            else:
                if self.numbered is None:
                    ranks = self.distinct.select("_t", F.row_number().over(Window.orderBy("_t")).alias(f"_r{name}"))
                else:
                    ranks = self.numbered.select("_t", F.col(self.cell).alias(f"_r{name}"))  # long, like the rows' places
                points = points.join(ranks, threshold == F.col("_t"), "left").drop("_t")
                rank = F.col(f"_r{name}")
            place = rank * 2 - (1 if op in (">=", "<") else 0)
            (lows if op in (">=", ">") else highs).append(place)
        # A missing threshold matches nothing: with a null end there are no tiles.
        ends = [
            reduce(lambda a, b: F.when(a.isNotNull() & b.isNotNull(), combine(a, b)), places)
            for combine, places in ((F.greatest, lows), (F.least, highs))
        ]
        return points.withColumns(dict(zip(self.ends, ends))).drop(*self.names, *(f"_r{n}" for n in self.names))

    def add_up(self, cells: DataFrame, keys: Sequence[str], partials: _Partials, asked: DataFrame) -> DataFrame:
        """Replace places by the blocks of 1, 2, 4, .. places they belong to, as far as a point asks for them."""
        if self.places <= FEW_PLACES:
            return cells
        place = F.col(self.cell)
        blocks = F.array(
            *(F.struct(F.lit(level).alias("level"), F.shiftright(place, level).alias("block"))
              for level in range(self.levels))
        )
        blocks = cells.withColumn(self.cell, F.explode(blocks)).join(asked, asked.columns, "left_semi")
        return blocks.groupBy(*keys).agg(*partials.again.values())

    def split_points(self, points: DataFrame) -> DataFrame:
        """Replace a run of places by the largest blocks that tile it exactly."""
        low, high = map(F.col, self.ends)
        if self.places <= FEW_PLACES:
            tiles = F.sequence(low, high - 1)
        else:
            blocks = []
            for level in range(self.levels):
                first = F.shiftright(low + (2**level - 1), level)
                last = F.shiftright(high, level)
                for taken, block in ((first % 2 == 1, first), (last % 2 == 1, last - 1)):
                    tile = F.struct(F.lit(level).alias("level"), block.alias("block"))
                    blocks.append(F.when((first < last) & taken, tile))
            tiles = F.filter(F.array(*blocks), lambda b: b.isNotNull())
        return points.withColumn(self.cell, F.explode(F.when(low < high, tiles))).drop(*self.ends)


def _stored(df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder, as it is read more than once."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
