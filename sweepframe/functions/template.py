"""Text templates: literal text with ``${expression}`` holes filled per row."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StudyError
from .scalar import register_functions

_CONTROL_LINE = re.compile(r"^[ \t]*%(?!%)|<%", re.MULTILINE)
_OPENERS = {"(": ")", "[": "]", "{": "}"}


def split_template(text: str) -> list[tuple[bool, str]]:
    """Pieces of a template as ``(is_expression, text)``."""
    if not isinstance(text, str):
        raise StudyError(f"a template must be text, not {text!r}")
    if _CONTROL_LINE.search(text):
        raise StudyError("template control lines and code blocks are not supported")
    pieces: list[tuple[bool, str]] = []
    start = 0
    while (hole := text.find("${", start)) >= 0:
        if hole > start:
            pieces.append((False, text[start:hole]))
        end = _closing_brace(text, hole + 2)
        pieces.append((True, text[hole + 2 : end].strip()))
        start = end + 1
    if start < len(text):
        pieces.append((False, text[start:]))
    return pieces


def _closing_brace(text: str, start: int) -> int:
    expected, quote = ["}"], None
    position = start
    while position < len(text):
        char = text[position]
        if quote:
            if char == "\\":
                position += 1
            elif char == quote:
                quote = None
        elif char in "'\"`":
            quote = char
        elif char in _OPENERS:
            expected.append(_OPENERS[char])
        elif char == expected[-1]:
            expected.pop()
            if not expected:
                return position
        position += 1
    raise StudyError(f"unclosed expression in template {text!r}")


def as_text(value: Column, tp: T.DataType) -> Column:
    """A value as a study writes it: ``0.0001``, ``1e+16``, ``True``, ``None``."""
    if isinstance(tp, T.BooleanType):
        text = F.when(value, "True").otherwise("False")
    elif isinstance(tp, (T.DoubleType, T.FloatType)):
        text = _float_text(value)
    elif isinstance(tp, T.ArrayType):
        inner = F.transform(value, lambda v: quoted(v, tp.elementType))
        text = F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]"))
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "None").otherwise(text)


def quoted(value: Column, tp: T.DataType) -> Column:
    """Like :func:`as_text`, with quotes around texts."""
    if isinstance(tp, T.StringType):
        escaped = F.regexp_replace(value, r"([\\'])", r"\\$1")
        return F.when(value.isNull(), "None").otherwise(F.concat(F.lit("'"), escaped, F.lit("'")))
    return as_text(value, tp)


def _float_text(value: Column) -> Column:
    """Shortest decimal text, with an exponent below 1e-4 and from 1e16 on.

    Spark writes an exponent below 1e-3 and from 1e7 on, so only those texts are
    taken apart and put together again. Older Java versions may give a 17th or 18th
    digit that is not needed; fewer are taken if they stand for the same number.
    """
    text = value.cast("string")
    count = F.length(F.regexp_replace(F.regexp_replace(text, "E.*$", ""), "[^0-9]", ""))
    shorter = [F.format_string(f"%.{digits - 1}e", value) for digits in (16, 17)]
    text = (
        F.when((count > 16) & (shorter[0].try_cast("double") == value), F.upper(shorter[0]))
        .when((count > 17) & (shorter[1].try_cast("double") == value), F.upper(shorter[1]))
        .otherwise(text)
    )
    sign = F.when(text.startswith("-"), "-").otherwise("")
    digits = F.replace(F.regexp_extract(text, r"^-?([0-9]\.[0-9]+)E", 1), F.lit("."))
    digits = F.regexp_replace(digits, r"(?<=[0-9])0+$", "")
    exponent = F.regexp_extract(text, r"E([+-]?[0-9]+)$", 1).try_cast("int")
    fraction = F.substring(digits, 2, 40)
    mantissa = F.concat(F.substring(digits, 1, 1), F.when(F.length(fraction) > 0, F.concat(F.lit("."), fraction)).otherwise(""))
    with_exponent = F.concat(
        sign, mantissa, F.lit("e"),
        F.when(exponent < 0, "-").otherwise("+"),
        F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")),
    )
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    padded = F.rpad(digits, F.greatest(exponent + 1, F.length(digits)), F.lit("0"))
    rest = F.substr(padded, exponent + 2)
    large = F.concat(
        sign, F.substr(padded, F.lit(1), exponent + 1), F.lit("."),
        F.when(F.length(rest) > 0, rest).otherwise("0"),
    )
    return (
        F.when(F.isnan(value), "nan")
        .when(text.endswith("Infinity"), F.concat(sign, F.lit("inf")))
        .when(~text.contains("E"), text)
        .when((exponent >= -4) & (exponent < 0), small)
        .when((exponent >= 0) & (exponent < 16), large)
        .otherwise(with_exponent)
    )


def expression_types(df: DataFrame, expressions: Sequence[Column]) -> list[T.DataType]:
    """Types the expressions have over ``df``; resolves a plan, runs nothing."""
    if not expressions:
        return []
    probe = df.select(*(e.alias(f"_e{i}") for i, e in enumerate(expressions)))
    return [field.dataType for field in probe.schema]


def render(df: DataFrame, template: Any) -> Any:
    """Column (or list or map of columns) with the template rendered for each row.

    Holes hold Spark SQL expressions over the columns of ``df``. The template is
    split once here; rows only see a concatenation.
    """
    if template is None:
        return F.lit(None).cast("string")
    if isinstance(template, Mapping):
        return {key: render(df, text) for key, text in template.items()}
    if isinstance(template, (list, tuple)):
        return [render(df, text) for text in template]
    pieces = split_template(template)
    register_functions(df.sparkSession)
    holes = [F.expr(text) for is_expression, text in pieces if is_expression]
    types = iter(expression_types(df, holes))
    filled = iter(holes)
    parts = [as_text(next(filled), next(types)) if is_expr else F.lit(text) for is_expr, text in pieces]
    return F.concat(F.lit(""), *parts) if parts else F.lit("")


def render_files(contexts: DataFrame, files: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """One document per context and file: ``(g_index, target, text)``.

    ``files`` lists ``(target, text, is template)``. Targets are always templates,
    texts only if they say so. The files belong to the study, so each row lists
    its documents itself; nothing is joined.
    """
    documents = [
        F.struct(
            render(contexts, target).alias("target"),
            (render(contexts, text) if is_template else F.lit(text)).alias("text"),
        )
        for target, text, is_template in files
    ]
    return contexts.select("g_index", F.inline(F.array(*documents)))
