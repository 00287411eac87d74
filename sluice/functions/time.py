"""Times as milliseconds since 1970 in UTC. The session's time zone must be UTC for texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import col

#: strftime's codes and the letters of Spark's patterns (fixed values of both).
CODES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "j": "DDD", "p": "a", "b": "MMM", "B": "MMMM",
    "a": "EEE", "A": "EEEE", "3f": "SSS", "6f": "SSSSSS", "f": "SSSSSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "z": "xx", "Z": "'UTC'",
}
DEFAULT = "%Y-%m-%dT%H:%M:%S%.3fZ"
#: Tried in this order where no format is given (fixed values); dates alone mean midnight, times alone have no value.
FORMATS = ("%Y-%m-%dT%H:%M:%S%.3fZ", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%Y-%m-%d")


def pattern(strftime: str) -> str:
    """strftime as a Spark pattern; letters that aren't codes are quoted."""
    out, literal, i = "", "", 0

    def closed() -> str:
        if not literal:
            return ""
        return f"'{literal.replace(chr(39), chr(39) * 2)}'" if any(c.isalpha() or c in "[]{}#'" for c in literal) else literal

    while i < len(strftime):
        c = strftime[i]
        if c == "%" and i + 1 < len(strftime):
            if strftime[i + 1] == "%":
                literal, i = literal + "%", i + 2
                continue
            dot = strftime.startswith("%.3f", i) or strftime.startswith("%.6f", i)
            code = strftime[i + 2 : i + 4] if dot else strftime[i + 1 : i + 3] if strftime[i + 1 : i + 3] in CODES else strftime[i + 1]
            if code not in CODES:
                raise ValueError(f"format code %{code}")
            literal += "." * dot
            out, literal, i = out + closed() + CODES[code], "", i + 1 + dot + len(code)
        else:
            literal, i = literal + c, i + 1
    return out + closed()


def now() -> Column:
    """The same for a whole query."""
    return F.unix_millis(F.current_timestamp())


def format_time(ms, strftime: str = DEFAULT) -> Column:
    return F.date_format(F.timestamp_millis(col(ms)), pattern(strftime))


def parse_time(s, strftime: str | None = None) -> Column:
    """Milliseconds, NULL where no format fits."""
    return F.coalesce(*[F.unix_millis(F.try_to_timestamp(col(s), F.lit(pattern(f)))) for f in ([strftime] if strftime else FORMATS)])


def timestamped(df: DataFrame, name: str = "timestamp") -> DataFrame:
    """df with the processing time."""
    return df.withColumn(name, now())


def event_timed(df: DataFrame, time, name: str = "event_timestamp") -> DataFrame:
    """df with its event time, 0 where it has none."""
    return df.withColumn(name, F.coalesce(col(time).cast("long"), F.lit(0)))


def delayed(df: DataFrame, column: str, ms: int) -> DataFrame:
    """Times put off by `ms`; values stay. A live stream is slowed by its trigger's interval."""
    return df.withColumn(column, col(column) + ms)
