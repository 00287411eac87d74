"""Inspection and conversion of types. A column's type is fixed, so tests fold to constants; of a VARIANT column each value is tested."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col, saturated

INTS, FLOATS = ("tinyint", "smallint", "int", "bigint"), ("float", "double")


def type_of(x, variant: bool = False) -> Column:
    return F.lower(F.schema_of_variant(col(x))) if variant else F.typeof(col(x))


def is_array(x, variant: bool = False) -> Column:
    return type_of(x, variant).startswith("array")


def is_object(x, variant: bool = False) -> Column:
    t = type_of(x, variant)
    return t.startswith("map") | t.startswith("struct") | t.startswith("object")


def is_boolean(x, variant: bool = False) -> Column:
    return type_of(x, variant) == "boolean"


def is_int(x, variant: bool = False) -> Column:
    return type_of(x, variant).isin(*INTS)


def is_float(x, variant: bool = False) -> Column:
    t = type_of(x, variant)
    return t.isin(*FLOATS) | (t.startswith("decimal") if variant else F.lit(False))


def is_number(x, variant: bool = False) -> Column:
    return is_int(x, variant) | is_float(x, variant)


def is_string(x, variant: bool = False) -> Column:
    return type_of(x, variant) == "string"


def is_null(x, variant: bool = False) -> Column:
    return F.is_variant_null(col(x)) | col(x).isNull() if variant else col(x).isNull()


def to_array(x, kind: str) -> Column:
    """kind: the column's type. Strings give characters, maps values, others an array of one."""
    x = col(x)
    if kind.startswith("array"):
        return x
    if kind == "string":
        return F.filter(F.split(x, ""), lambda c: c != "")
    return F.map_values(x) if kind.startswith("map") else F.array(x)


def to_boolean(x, kind: str) -> Column:
    """Numbers that aren't zero; strings (whatever they say), arrays and maps that aren't empty."""
    x = col(x)
    if kind == "boolean":
        return x
    if kind == "string":
        return x != ""
    return F.size(x) > 0 if kind.startswith(("array", "map")) else x != 0


def to_int(x, kind: str) -> Column:
    """Floats towards zero, held to the type's ends; strings must be plain integers."""
    x = col(x)
    if kind == "string":
        return F.when(x.rlike(r"^[+-]?[0-9]+\z"), x.try_cast("bigint"))
    return saturated(x) if kind in FLOATS else x.cast("bigint")


def to_number(x, kind: str) -> Column:
    x = col(x)
    if kind == "boolean":
        return F.when(x, 1.0).when(~x, 0.0)
    return F.when(x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), x.try_cast("double")) if kind == "string" else x.cast("double")


def to_float(x, kind: str) -> Column:
    return to_number(x, kind).cast("float")


def to_string(x, kind: str) -> Column:
    """Whole floats without a fraction; arrays as ["a", "b"], maps as {"k": "v"}, every element in quotes."""
    x = col(x)
    if kind in FLOATS:
        return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.floor(x).cast("string")).otherwise(x.cast("string"))
    if kind.startswith("array"):
        return F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: F.concat(F.lit('"'), v.cast("string"), F.lit('"'))), ", "), F.lit("]"))
    if kind.startswith("map"):
        pair = lambda e: F.concat(F.lit('"'), e["key"].cast("string"), F.lit('": "'), e["value"].cast("string"), F.lit('"'))
        return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(x)), pair), ", "), F.lit("}"))
    return x.cast("string")
