"""Column types of a study: inference, merging, declaration, application."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import StudyError

ANY = T.NullType()
STRING = T.StringType()
INTEGER = T.LongType()
FLOATING = T.DoubleType()
BOOLEAN = T.BooleanType()
DATETIME = T.TimestampNTZType()

# The type names a study may declare.
DECLARABLE: dict[str, T.DataType] = {
    "int": INTEGER,
    "integer": INTEGER,
    "float": FLOATING,
    "floating": FLOATING,
    "double": FLOATING,
    "str": STRING,
    "string": STRING,
}

# The columns every collected table may hold, and their types.
SYSTEM_COLUMNS: dict[str, T.DataType] = {
    "g_index": INTEGER,
    "g_logdir": STRING,
    "g_sourcedir": STRING,
    "g_started": DATETIME,
    "g_finished": DATETIME,
    "g_success": BOOLEAN,
}
WALLTIME_PREFIX = "g_walltime"

# The pairs of different types that merge, and what they give.
_MERGES: dict[frozenset[T.DataType], T.DataType] = {
    frozenset((INTEGER, FLOATING)): FLOATING,
    frozenset((STRING, DATETIME)): DATETIME,
    frozenset((STRING, BOOLEAN)): BOOLEAN,
}


def declared_type(name: str) -> T.DataType:
    try:
        return DECLARABLE[name]
    except KeyError:
        raise StudyError(f"unknown type name {name!r}, expected one of {sorted(DECLARABLE)}") from None


def declared_types(names: Mapping[str, str]) -> dict[str, T.DataType]:
    return {column: declared_type(name) for column, name in names.items()}


def system_type(column: str) -> T.DataType | None:
    if column.startswith(WALLTIME_PREFIX):
        return FLOATING
    return SYSTEM_COLUMNS.get(column)


def type_of_value(value: Any) -> T.DataType:
    """Type of one Python value; a list takes the type of its first element."""
    if value is None:
        return ANY
    if isinstance(value, (bool, np.bool_)):
        return BOOLEAN
    if isinstance(value, str):
        return STRING
    if isinstance(value, (int, np.integer)):
        return INTEGER
    if isinstance(value, (float, np.floating)):
        return FLOATING
    if isinstance(value, datetime):
        return DATETIME
    if isinstance(value, Sequence):
        return T.ArrayType(type_of_value(value[0]) if value else ANY)
    raise StudyError(f"no column type for a value of {type(value).__name__}")


def merge_types(left: T.DataType, right: T.DataType) -> T.DataType:
    """Least type that holds both, or an error if there is none.

    The order matters for a list and an unknown type only: the list cannot come first.
    """
    if left == ANY:
        return right
    if isinstance(left, T.ArrayType) and isinstance(right, T.ArrayType):
        return T.ArrayType(merge_types(left.elementType, right.elementType))
    if isinstance(left, T.ArrayType) or isinstance(right, T.ArrayType):
        raise StudyError(f"cannot merge {left.simpleString()} with {right.simpleString()}")
    if right == ANY or left == right:
        return left
    merged = _MERGES.get(frozenset((left, right)))
    if merged is None:
        raise StudyError(f"cannot merge {left.simpleString()} with {right.simpleString()}")
    return merged


def _known(tp: T.DataType) -> tuple[bool, int]:
    depth = 0
    while isinstance(tp, T.ArrayType):
        tp, depth = tp.elementType, depth + 1
    return tp != ANY, depth


def merge_all(types: Iterable[T.DataType]) -> T.DataType:
    """Least type that holds a set of types, which has no order: unknown ones come first, the shallowest before deeper ones."""
    return reduce(merge_types, sorted(types, key=_known), ANY)


# --- inference over JSON records -------------------------------------------------------------

# Names used in the long type table, so that it stays an ordinary string column.
_NAME_OF = {ANY: "any", STRING: "string", INTEGER: "integer", FLOATING: "floating", BOOLEAN: "boolean"}
_TYPE_OF = {name: tp for tp, name in _NAME_OF.items()}


def type_name(tp: T.DataType) -> str:
    if isinstance(tp, T.ArrayType):
        return f"list({type_name(tp.elementType)})"
    return "datetime" if tp == DATETIME else _NAME_OF[tp]


def type_from_name(name: str) -> T.DataType:
    if name.startswith("list(") and name.endswith(")"):
        return T.ArrayType(type_from_name(name[5:-1]))
    return DATETIME if name == "datetime" else _TYPE_OF[name]


def _scalar_name(schema: Column) -> Column:
    return (
        F.when(schema == "BOOLEAN", "boolean")
        .when(schema == "STRING", "string")
        .when(schema == "BIGINT", "integer")
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "floating")
        .otherwise("any")
    )


def record_types(records: DataFrame, json_column: str) -> DataFrame:
    """Distinct ``(key, type)`` pairs over a column of JSON objects.

    The shuffle carries one row per pair and task, however many records there are.
    """
    entries = records.select(F.parse_json(json_column).alias("_record")).lateralJoin(
        records.sparkSession.tvf.variant_explode(F.col("_record").outer())
    )
    schema = F.schema_of_variant("value")
    first = F.coalesce(
        F.schema_of_variant(F.try_variant_get("value", "$[0]", "variant")), F.lit("VOID")
    )
    named = F.when(
        schema.startswith("ARRAY"), F.concat(F.lit("list("), _scalar_name(first), F.lit(")"))
    ).otherwise(_scalar_name(schema))
    return entries.select("key", named.alias("type")).distinct()


def infer_schema(records: DataFrame, json_column: str) -> T.StructType:
    """Merged type of every key; only the table of distinct pairs reaches the driver."""
    found: dict[str, list[T.DataType]] = {}
    for row in record_types(records, json_column).collect():
        found.setdefault(row["key"], []).append(type_from_name(row["type"]))
    fields = []
    for key in sorted(found):
        fields.append(T.StructField(key, system_type(key) or merge_all(found[key])))
    return T.StructType(fields)


# --- application ---------------------------------------------------------------------------


def writable(tp: T.DataType) -> T.DataType:
    """Type as stored: an unknown type is kept as text."""
    if tp == ANY:
        return STRING
    if isinstance(tp, T.ArrayType):
        return T.ArrayType(writable(tp.elementType))
    if isinstance(tp, T.StructType):
        return T.StructType([T.StructField(f.name, writable(f.dataType)) for f in tp])
    return tp


def apply_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to ``schema``, adding missing columns as null; works on 0 rows too."""
    present = {f.name: f.dataType for f in df.schema}
    return df.select(
        *(
            _fit(F.col(f"`{f.name}`") if f.name in present else None, present.get(f.name), f.dataType).alias(f.name)
            for f in schema
        )
    )


def _fit(value: Column | None, old: T.DataType | None, new: T.DataType) -> Column:
    """A value as type ``new``; the fields of a struct are matched by name."""
    if value is None:
        return F.lit(None).cast(writable(new))
    if not isinstance(new, T.StructType) or old == new:
        return value.cast(writable(new))
    known = {f.name: f.dataType for f in old}
    fields = (
        _fit(value[f.name] if f.name in known else None, known.get(f.name), f.dataType).alias(f.name) for f in new
    )
    return F.when(value.isNotNull(), F.struct(*fields))


def merged_schema(left: T.StructType, right: T.StructType) -> T.StructType:
    """Union of the columns of two tables, with the types merged by name."""
    types: dict[str, T.DataType] = {}
    for field in [*left.fields, *right.fields]:
        old = types.get(field.name, ANY)
        types[field.name] = old if old == field.dataType else _merge_stored(old, field.dataType)
    return T.StructType([T.StructField(name, tp) for name, tp in types.items()])


def _merge_stored(left: T.DataType, right: T.DataType) -> T.DataType:
    if isinstance(left, T.StructType) and isinstance(right, T.StructType):
        return merged_schema(left, right)
    return merge_types(_widened(left), _widened(right))


def _widened(tp: T.DataType) -> T.DataType:
    if isinstance(tp, (T.ByteType, T.ShortType, T.IntegerType)):
        return INTEGER
    if isinstance(tp, (T.FloatType, T.DecimalType)):
        return FLOATING
    if isinstance(tp, T.TimestampType):
        return DATETIME
    if isinstance(tp, T.ArrayType):
        return T.ArrayType(_widened(tp.elementType))
    return tp
