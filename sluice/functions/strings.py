"""String functions on columns. Lengths and offsets that are named so are in bytes; positions and slices in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col


def text(x) -> Column:
    """A Column as it is, a plain string as a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def append(s, suffix) -> Column:
    return F.concat(col(s), text(suffix))


def prepend(s, prefix) -> Column:
    return F.concat(text(prefix), col(s))


def concat(a, b) -> Column:
    return F.concat(col(a), col(b))


def capitalize(s) -> Column:
    """The first character in upper case, the others as they are."""
    s = col(s)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))


def uppercase(s) -> Column:
    return F.upper(col(s))


def lowercase(s) -> Column:
    return F.lower(col(s))


def case(s, kind: str) -> Column:
    """upper, lower or title, with or without "case"; title case leaves one space between words."""
    kind = kind.lower().removesuffix("case")
    if kind == "title":
        words = F.filter(F.split(col(s), r"(?U)\s+"), lambda x: x != "")
        return F.array_join(F.transform(words, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), " ")
    if kind not in ("upper", "lower"):
        raise ValueError(f"case: {kind}")
    return uppercase(s) if kind == "upper" else lowercase(s)


def char_at(s, index) -> Column:
    """From 0; NULL out of range."""
    s, i = col(s), col(index)
    return F.when((i >= 0) & (i < F.length(s)), F.substr(s, (i + 1).cast("int"), F.lit(1)))


def contains(s, part) -> Column:
    return F.contains(col(s), text(part))


def starts_with(s, prefix) -> Column:
    return F.startswith(col(s), text(prefix))


def ends_with(s, suffix) -> Column:
    return F.endswith(col(s), text(suffix))


def equal(a, b) -> Column:
    return col(a) == col(b)


def format(template, value) -> Column:  # noqa: A001
    """Every {} of the template replaced by the value."""
    return F.replace(text(template), F.lit("{}"), col(value).cast("string"))


def index_of(s, part) -> Column:
    """Byte offset of the first occurrence, -1 without one."""
    s, part = col(s), text(part)
    at = F.position(part, s)
    return F.when(at == 0, -1).otherwise(F.octet_length(F.left(s, at - 1))).cast("long")


def last_index_of(s, part) -> Column:
    """Byte offset of the last occurrence, -1 without one."""
    s, part = col(s), text(part)
    back = F.position(F.reverse(part), F.reverse(s))
    before = F.length(s) - (back - 1) - F.length(part)
    return F.when(part == "", F.octet_length(s)).when(back == 0, -1).otherwise(F.octet_length(F.left(s, before))).cast("long")


def join(parts, delimiter) -> Column:
    return F.call_function("array_join", col(parts), text(delimiter))


def length(s) -> Column:
    """In bytes."""
    return F.octet_length(col(s)).cast("long")


def match(s, pattern: str) -> Column:
    """Whether the pattern occurs anywhere. Patterns that RE2 knows too give the same here."""
    return col(s).rlike(pattern)


def pad(s, n: int, padding: str = " ", side: str = "right") -> Column:
    """To n code points, by the first character of padding; longer texts stay. Of both sides, the right gets the odd one."""
    s, p = col(s), (padding or " ")[0]
    if side not in ("left", "right", "center"):
        raise ValueError(f"side: {side}")
    if side == "center":
        left = F.length(s) + F.floor((n - F.length(s)) / 2).cast("int")
        full = F.rpad(F.lpad(s, left, F.lit(p)), n, p)
    else:
        full = (F.lpad if side == "left" else F.rpad)(s, n, p)
    return F.when(F.length(s) >= n, s).otherwise(full)


def replace(s, part: str, by: str) -> Column:
    """All occurrences, literally; an empty part stands before, between and after all characters."""
    s = col(s)
    if part:
        return F.replace(s, F.lit(part), F.lit(by))
    return F.when(s == "", F.lit(by)).otherwise(F.concat(F.lit(by), F.array_join(F.split(s, ""), by), F.lit(by)))


def reverse(s) -> Column:
    return F.reverse(col(s))


def slice(s, start, end) -> Column:  # noqa: A001
    """Code points from start up to end; NULL if they are out of range or out of order."""
    s, a, b = col(s), col(start), col(end)
    return F.when((a >= 0) & (a <= b) & (b <= F.length(s)), F.substr(s, (a + 1).cast("int"), (b - a).cast("int")))


def split(s, delimiter: str) -> Column:
    """Literally, with empty parts; an empty delimiter gives the characters between two empty parts."""
    s = col(s)
    if delimiter:
        return F.split(s, r"\Q" + delimiter.replace(r"\E", r"\E\\E\Q") + r"\E", -1)
    return F.concat(F.array(F.lit("")), F.filter(F.split(s, ""), lambda x: x != ""), F.array(F.lit("")))


def trim(s) -> Column:
    """Unicode white space, both ends."""
    return F.regexp_replace(col(s), r"^(?U)\s+|(?U)\s+$", "")
