"""Captures: typed values pulled out of text with regular expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StudyError
from ..functions.regex import JavaPattern, to_java
from ..types import STRING, declared_type
from .ranking import running_total

MODES = ("first", "last", "all")

# The texts a simple capture accepts as a number.
NUMBER_PATTERNS = {
    "integer": r"[-+]?[0-9]+",
    "float": r"[-+]?(?:(?:\d*\.\d+)|(?:\d+\.?))(?:[Ee][+-]?\d+)?",
}


@dataclass(frozen=True)
class Capture:
    """A pattern in Python syntax. Every named group becomes a column.

    ``mode`` keeps the first, the last or all matches of a text. ``kind`` is a
    declarable type name; without one the type declared for the column applies,
    and text if there is none. ``command`` restricts it to the texts of one step.
    """

    pattern: str
    mode: str = "last"
    kind: str | None = None
    command: str | None = None
    legacy_untyped_all: bool = False

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise StudyError(f"unknown capture mode {self.mode!r}, expected one of {MODES}")
        if self.kind is not None:
            declared_type(self.kind)
        self.java  # noqa: B018 - reject a bad pattern while the study is defined

    @classmethod
    def simple(
        cls,
        kind: str,
        name: str,
        prefix: str,
        skip_words: int = 0,
        flexible_prefix: bool = False,
        mode: str = "last",
        command: str | None = None,
    ) -> Capture:
        """A number after a fixed prefix, an optional ``:`` or ``=`` and some words."""
        if kind not in NUMBER_PATTERNS:
            raise StudyError(f"unknown capture kind {kind!r}, expected one of {sorted(NUMBER_PATTERNS)}")
        words = prefix.split() if flexible_prefix else [prefix]
        start = r"\s+".join(map(re.escape, words))
        # Spaces are never given back, nor is the sign unless a skipped word may begin
        # with it: whatever follows cannot match them, so this only saves retries.
        sign, skipped = "[:=]?+", ""
        if skip_words:
            sign, skipped = "[:=]?", rf"(?:\S+\s+){{{skip_words}}}"
        return cls(rf"{start}\s*+{sign}\s*+{skipped}(?P<{name}>{NUMBER_PATTERNS[kind]})", mode, kind, command)

    @cached_property
    def java(self) -> JavaPattern:
        return to_java(self.pattern)

    @property
    def names(self) -> list[str]:
        return list(self.java.groups)

    def element_type(self, name: str, declared: Mapping[str, T.DataType]) -> T.DataType:
        return declared_type(self.kind) if self.kind else declared.get(name, STRING)

    def keeps_list(self) -> bool:
        return self.mode == "all" and not (self.legacy_untyped_all and self.kind is None)

    def columns(
        self, text: Column, declared: Mapping[str, T.DataType] | None = None, strict: bool = True
    ) -> dict[str, Column]:
        """One column per named group; null where the text has no match.

        ``strict`` makes text that does not convert stop the job.
        """
        result = {}
        for name, group in self.java.groups.items():
            tp = self.element_type(name, declared or {})
            pattern = F.lit(self.java.pattern)

            def convert(value: Column, tp: T.DataType = tp) -> Column:
                if tp == STRING:
                    return value
                return value.cast(tp) if strict else value.try_cast(tp)

            # Spark reports a group that took no part as empty text.
            absent_is_empty = name in self.java.optional
            if self.mode == "first" and name in self.java.nonempty:
                value = convert(F.nullif(F.regexp_extract(text, self.java.pattern, group), F.lit("")))
            else:
                found = F.regexp_extract_all(text, pattern, F.lit(group))
                if self.keeps_list():
                    # nullif looks for matches once; a test with size would do it twice.
                    value = F.nullif(found, F.array().cast("array<string>"))
                    if absent_is_empty:
                        value = F.transform(value, lambda v: convert(F.nullif(v, F.lit(""))))
                    elif tp != STRING:
                        value = F.transform(value, lambda v: convert(v))
                else:
                    value = F.try_element_at(found, F.lit(1 if self.mode == "first" else -1))
                    value = convert(F.nullif(value, F.lit("")) if absent_is_empty else value)
            if self.command is not None:
                value = F.when(F.col("command") == self.command, value)
            result[name] = value
        return result


def captured_names(captures: Sequence[Capture]) -> dict[str, bool]:
    """Names in order of appearance, with whether each is a list."""
    lists: dict[str, bool] = {}
    for capture in captures:
        for name in capture.names:
            if lists.setdefault(name, capture.keeps_list()) != capture.keeps_list():
                raise StudyError(f"capture {name!r} is a list in one pattern and a single value in another")
    return lists


def as_captures(specs: Sequence[str | Mapping | Capture] | str | Mapping | Capture) -> list[Capture]:
    """Captures from patterns, option mappings or ready captures."""
    if isinstance(specs, (str, Mapping, Capture)):
        specs = [specs]
    captures = []
    for spec in specs:
        if isinstance(spec, Capture):
            captures.append(spec)
        elif isinstance(spec, str):
            captures.append(Capture(spec))
        else:
            options = dict(spec)
            kind = options.pop("type", None)
            try:
                captures.append(Capture.simple(kind, **options) if kind else Capture(**options))
            except TypeError as error:
                raise StudyError(f"bad capture {spec!r}: {error}") from None
    return captures


def capture_text(
    df: DataFrame,
    text: str | Column,
    captures: Sequence[Capture],
    declared: Mapping[str, T.DataType] | None = None,
    strict: bool = True,
) -> DataFrame:
    """Add the captured columns of every row's text; no shuffle, no Python.

    A name captured twice keeps the later value, a list grows.
    """
    column = F.col(text) if isinstance(text, str) else text
    lists = captured_names(captures)
    found: dict[str, Column] = {}
    for capture in captures:
        for name, value in capture.columns(column, declared, strict).items():
            if name not in found:
                found[name] = value
            elif lists[name]:
                old = found[name]
                found[name] = F.when(old.isNull(), value).when(value.isNull(), old).otherwise(F.concat(old, value))
            else:
                found[name] = F.coalesce(value, found[name])
    return df.withColumns(found)


def capture_instances(
    texts: DataFrame,
    captures: Sequence[Capture],
    declared: Mapping[str, T.DataType] | None = None,
    key: str = "g_index",
    order: str = "cmd_no",
    text: str = "text",
    strict: bool = True,
) -> DataFrame:
    """Captures over all texts of an instance, one row per instance.

    Texts count in ``order``: a later single value replaces an earlier one, a
    list grows. Single values are reduced before the shuffle.
    """
    lists = captured_names(captures)
    rows = capture_text(texts, text, captures, declared, strict)
    aggs = []
    for name, is_list in lists.items():
        value = F.col(name)
        if is_list:
            parts = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v")))))
            whole = F.flatten(F.transform(parts, lambda p: p["v"]))
            aggs.append(F.when(F.size(whole) > 0, whole).alias(name))
        else:
            aggs.append(F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(name))
    return rows.groupBy(key).agg(*aggs)


def capture_long(
    texts: DataFrame,
    captures: Sequence[Capture],
    key: str = "g_index",
    order: str = "cmd_no",
    text: str = "text",
) -> DataFrame:
    """Every match as a row ``(key, order, name, pos, value)``, values as text.

    For instances whose lists are too long to be one cell.
    """
    entries = []
    for number, capture in enumerate(captures):
        for name, group in capture.java.groups.items():
            found = F.regexp_extract_all(F.col(text), F.lit(capture.java.pattern), F.lit(group))
            if not capture.keeps_list():
                kept = F.try_element_at(found, F.lit(1 if capture.mode == "first" else -1))
                found = F.when(kept.isNotNull(), F.array(kept))
            if capture.command is not None:
                found = F.when(F.col("command") == capture.command, found)
            entries.append(F.struct(F.lit(number).alias("capture"), F.lit(name).alias("name"), found.alias("found")))
    rows = texts.select(key, order, F.inline(F.array(*entries)))
    return rows.select(key, order, "capture", "name", F.posexplode("found").alias("pos", "value"))



def capture_segments(
    texts: DataFrame,
    captures: Sequence[Capture],
    declared: Mapping[str, T.DataType] | None = None,
    key: str = "g_index",
    order: str = "cmd_no",
    text: str = "text",
    strict: bool = True,
    length: int = 100_000,
) -> tuple[DataFrame, DataFrame]:
    """What :func:`capture_instances` gives, for lists too long to be one cell: single values, and lists in segments.

    The first frame has a row per instance with its single values, reduced before the shuffle. The second has a row per
    ``(key, segment)`` with a typed list of at most ``length`` values per list column, null where a list is shorter; the
    segments one after the other are the whole lists. Matches are numbered by running totals of their counts, so an
    instance is no task's work as a whole; ``order`` tells the texts of an instance apart. The matches are stored for it.
    """
    lists = captured_names(captures)
    rows = capture_text(texts, text, captures, declared, strict)
    singles = [F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias(name) for name, is_list in lists.items() if not is_list]
    single = rows.groupBy(key).agg(*singles) if singles else rows.select(key).distinct()
    names = [name for name, is_list in lists.items() if is_list]
    types = {name: rows.schema[name].dataType for name in names}
    # Values travel as text next to null, in one column, and get their type back in the end.
    entries = [F.struct(F.lit(name).alias("_name"), F.col(name).cast("array<string>").alias("_values")) for name in names]
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("segment", T.LongType()), *(T.StructField(n, types[n]) for n in names)])
    if not names:
        return single, texts.sparkSession.createDataFrame([], schema)
    found = rows.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.inline(F.array(*entries))).where("size(_values) > 0")
    found = found.withColumn("_n", F.size("_values").cast("long"))
    numbered = running_total(found, ["_key", "_name"], [("_order", None)], "_n", "_before", ["_values"])
    # A text's matches are cut where segments begin.
    covered = F.sequence(F.expr(f"_before div {length}"), F.expr(f"(_before + _n - 1) div {length}"))
    cut = numbered.withColumn("segment", F.explode(covered))
    start = F.greatest(F.col("_before"), F.col("segment") * length)
    stop = F.least(F.col("_before") + F.col("_n"), (F.col("segment") + 1) * length)
    part = F.slice("_values", (start - F.col("_before") + 1).cast("int"), (stop - start).cast("int"))
    pieces = cut.select("_key", "_name", "segment", F.struct(start.alias("at"), part.alias("v")).alias("_piece"))
    joined = []
    for name in names:
        own = F.sort_array(F.collect_list(F.when(F.col("_name") == name, F.col("_piece"))))
        values = F.flatten(F.transform(own, lambda p: p["v"]))
        joined.append(F.when(F.size(values) > 0, values.cast(types[name])).alias(name))
    return single, pieces.groupBy(F.col("_key").alias(key), "segment").agg(*joined)
