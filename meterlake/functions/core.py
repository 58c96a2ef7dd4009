"""Building blocks for column functions: naming a value, places of a pattern, cells of a layout line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = "struct<start:int,end:int,text:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def places(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with their offsets: array of (start, end, text).

    Spark has no function for offsets; they are the running lengths of the gaps between the matches and of the matches.
    """
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{PLACE}>)").alias("found"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.length(x["match"])
        here = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("text"))
        return F.when(x["match"].isNull(), a).otherwise(F.struct(end.alias("at"), F.concat(a["found"], F.array(here)).alias("found")))

    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))
    return F.aggregate(pieces, zero, step, lambda a: a["found"])


def cells(line: Column) -> Column:
    """Cells of a layout line: maximal runs without two spaces, as (start, end, text)."""
    return places(line, r"(?U)\S+(?: \S+)*")


def count_of(text: Column, pattern: str) -> Column:
    """Number of characters that the one-character pattern matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)
