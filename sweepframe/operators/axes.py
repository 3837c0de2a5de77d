"""Axes of a study: a named axis is an ordered list of values."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StudyError
from ..types import FLOATING, STRING, type_of_value

_FEW_LITERALS = 64


class Axis(Sequence):
    """Listed axis: the values as given, all numbers, all texts or all booleans."""

    def __init__(self, values: Sequence[Any]):
        if isinstance(values, (str, bytes)) or not isinstance(values, Sequence):
            raise StudyError(f"an axis needs a list of values, not {values!r}")
        kinds = {type_of_value(v).typeName() for v in values}
        if kinds == {"long", "double"}:
            kinds = {"double"}
        if len(kinds) > 1 or not kinds <= {"long", "double", "string", "boolean"}:
            raise StudyError(f"an axis mixes or misuses value types: {sorted(kinds)}")
        kind = next(iter(kinds), "string")
        convert = {"long": int, "double": float, "string": str, "boolean": bool}[kind]
        self.values: Sequence[Any] = [convert(v) for v in values]

    def __len__(self) -> int:
        return len(self.values)

    def __getitem__(self, index: Any) -> Any:
        return self.values[index]

    def __iter__(self) -> Iterator[Any]:
        return iter(self.values)

    @property
    def element_type(self) -> T.DataType:
        return type_of_value(self.values[0]) if len(self) else STRING

    def literal(self) -> Column:
        """The values as one array literal; many of them as one text, which the optimizer turns into an array."""
        if len(self) > _FEW_LITERALS:
            return F.from_json(F.lit(json.dumps(list(self.values))), T.ArrayType(self.element_type))
        return F.array(*(F.lit(v) for v in self.values)).cast(T.ArrayType(self.element_type))

    def at(self, position: Column) -> Column:
        """Value at a 0-based position column."""
        if len(self) == 1:
            return F.lit(self.values[0]).cast(self.element_type)
        return F.get(self.literal(), position.cast("int"))


class UniformAxis(Axis):
    """Evenly spaced values with both ends included; one value is the lower end."""

    def __init__(self, lo: float, hi: float, num: int):
        if num < 0:
            raise StudyError("a uniform axis needs num >= 0")
        self.lo, self.hi, self.num = float(lo), float(hi), int(num)
        self._values: list[float] | None = None

    @property
    def values(self) -> list[float]:  # type: ignore[override]
        if self._values is None:
            self._values = [float(v) for v in np.linspace(self.lo, self.hi, num=self.num)]
        return self._values

    def __len__(self) -> int:
        return self.num

    @property
    def element_type(self) -> T.DataType:
        return FLOATING

    def at(self, position: Column) -> Column:
        # Same arithmetic as the list form, so long axes need no array literal.
        if self.num <= 1:
            return F.lit(self.lo)
        step = (self.hi - self.lo) / (self.num - 1)
        return F.when(position == self.num - 1, F.lit(self.hi)).otherwise(
            position.cast("double") * F.lit(step) + F.lit(self.lo)
        )


class GradedAxis(Axis):
    """``num`` points where every gap is ``grading`` times the one before it."""

    def __init__(self, lo: float, hi: float, num: int, grading: float = 1.0):
        if num < 1:
            raise StudyError("a graded axis needs num >= 1")
        if num == 1 or grading == 1:
            super().__init__(list(UniformAxis(lo, hi, num)))
            return
        first_gap = (hi - lo) * (1 - grading) / (1 - grading ** (num - 1))
        gaps = np.cumprod([first_gap, *[float(grading)] * (num - 2)])
        super().__init__([float(v) for v in np.cumsum([float(lo), *gaps])])


def as_axis(spec: Any) -> Axis:
    """Axis from an ``Axis``, a list of values, or a mapping with a ``type``."""
    if isinstance(spec, Axis):
        return spec
    if isinstance(spec, Mapping):
        options = dict(spec)
        kind = options.pop("type", None)
        builder = {"uniform": UniformAxis, "graded": GradedAxis}.get(kind)
        if builder is None or "interval" not in options or "num" not in options:
            raise StudyError(f"an axis mapping needs a type, an interval and num: {spec!r}")
        lo, hi = options.pop("interval")
        try:
            return builder(lo, hi, **options)
        except TypeError as error:
            raise StudyError(f"bad axis {spec!r}: {error}") from None
    return Axis(spec)
