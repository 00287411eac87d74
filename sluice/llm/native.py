"""Column helpers for operators made of built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body refers to it, also from within a lambda."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


#: Matches whose places are summed up at once, so that lists stay short while they grow.
CHUNK = 128


def chunks(values: Column) -> Column:
    """The array cut into arrays of CHUNK elements."""
    return F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / CHUNK).cast("int")), lambda k: F.slice(values, k * CHUNK + 1, CHUNK))


def matches(text: Column, pattern: str, value_group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches of `pattern` as structs start, end in code points, those whose value_group has `least` characters.

    Positions come from the lengths of the matches and of what the same pattern splits the text into, summed up within
    chunks of matches and then over chunks, so that time grows with the matches and not with their square.
    """
    p, spans = F.lit(pattern), "array<struct<start:int,end:int>>"

    def within(chunk: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + x["found"]
            return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(chunk, F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans")), step)

    def moved(parts: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

        starts = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), step, lambda acc: acc["starts"])
        shift = lambda x, by: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"))
        return let(starts, lambda at: F.flatten(F.transform(parts, lambda part, i: let(F.get(at, i), lambda by: F.transform(part["spans"], lambda x: shift(x, by))))))

    def place(found: Column, gaps: Column, values: Column) -> Column:
        rows = F.transform(found, lambda x, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(x).alias("found"), (F.length(F.get(values, i)) >= least).alias("ok")))
        return let(rows, lambda all_: let(F.transform(chunks(all_), within), moved))

    def of(found: Column) -> Column:
        values = lambda f: f(found) if not value_group else let(F.regexp_extract_all(text, p, F.lit(value_group)), f)
        return F.when(F.size(found) == 0, F.array().cast(spans)).otherwise(let(F.split(text, pattern, -1), lambda gaps: values(lambda v: place(found, gaps, v))))

    return let(F.regexp_extract_all(text, p, F.lit(0)), of)
