"""Functions on array and map columns. Positions count from 0; what is out of range is NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import EPSILON64, col

# arrays


def array_concat(a, b) -> Column:
    return F.concat(col(a), col(b))


def array_contains(a, value, floats: bool = False) -> Column:
    value = col(value)
    return F.exists(col(a), lambda x: F.abs(x - value) < EPSILON64) if floats else F.array_contains(col(a), value)


def array_filter(a, keep: Callable[[Column], Column]) -> Column:
    return F.filter(col(a), lambda x: keep(x))


def array_map(a, f: Callable[[Column], Column]) -> Column:
    return F.transform(col(a), lambda x: f(x))


def array_flatten(a) -> Column:
    """One level."""
    return F.flatten(col(a))


def array_index(a, i) -> Column:
    i = col(i).cast("int")
    return F.when(i >= 0, F.get(col(a), i))


def array_index_of(a, value) -> Column:
    """-1 without one."""
    return (F.array_position(col(a), col(value)) - 1).cast("int")


def array_join(a, delimiter: str) -> Column:
    return F.array_join(F.transform(col(a), lambda x: x.cast("string")), delimiter)


def array_length(a) -> Column:
    return F.size(col(a)).cast("long")


def array_reverse(a) -> Column:
    return F.reverse(col(a))


def array_slice(a, start, end) -> Column:
    """Up to end, both held to the array; NULL if out of order."""
    a, s, e = col(a), col(start).cast("int"), col(end).cast("int")
    n = F.size(a)
    s_, e_ = F.least(F.greatest(s, F.lit(0)), n), F.least(F.greatest(e, F.lit(0)), n)
    return F.when(s <= e, F.slice(a, s_ + 1, e_ - s_))


def array_sort(a, descending: bool = False) -> Column:
    a = F.array_sort(col(a))
    return F.reverse(a) if descending else a


def array_split(a, n: int) -> Column:
    """Parts of n, the last one shorter."""
    if n <= 0:
        raise ValueError("chunk size must be above 0")
    a = col(a)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / n).cast("int")), lambda i: F.slice(a, i * n + 1, F.lit(n)))
    return F.when(F.size(a) > 0, parts).when(F.size(a) == 0, F.slice(F.array(a), 1, 0))


def array_unique(a) -> Column:
    """First occurrences, in order."""
    return F.array_distinct(col(a))


# maps


def object_keys(m) -> Column:
    return F.map_keys(col(m))


def object_values(m) -> Column:
    return F.map_values(col(m))


def object_entries(m) -> Column:
    """Array of structs key, value."""
    return F.map_entries(col(m))


def object_property(m, key) -> Column:
    return F.try_element_at(col(m), key if isinstance(key, Column) else F.lit(key))


def object_has_property(m, key) -> Column:
    return F.map_contains_key(col(m), key)


def object_size(m) -> Column:
    return F.size(col(m)).cast("long")


def object_delete_property(m, key) -> Column:
    return F.map_filter(col(m), lambda k, _: k != key)


def object_merge(a, b) -> Column:
    """Of a key in both, b's value. Needs no session setting: a loses such keys first."""
    a, b = col(a), col(b)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def object_set_property(m, key: str, value) -> Column:
    return object_merge(m, F.create_map(F.lit(key), col(value)))
