"""Values as people read them: Indian grouping of digits, amounts, dates, periods, sizes, sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let

# What the kinds of source and the types of file are called.
KINDS = {"inferred": "Inferred", "derived": "Calculated"}
TYPES = {"pdf": "PDF", "png": "PNG", "jpeg": "JPG", "jpg": "JPG"}


def indian_grouping(value: Column, least: int = 0, most: int = 3) -> Column:
    """The last three digits of the whole part, then pairs; decimals between ``least`` and ``most``."""
    text = F.round(F.abs(value.cast("decimal(28,6)")), most).cast(f"decimal(28,{most})").cast("string")

    def grouped(t: Column) -> Column:
        whole = F.substring_index(t, ".", 1)
        decimals = F.when(t.contains("."), F.substring_index(t, ".", -1)).otherwise("")
        kept = F.rpad(F.regexp_replace(decimals, "0+$", ""), least, "0") if least else F.regexp_replace(decimals, "0+$", "")
        kept = F.when(F.length(F.regexp_replace(decimals, "0+$", "")) >= least, F.regexp_replace(decimals, "0+$", "")).otherwise(kept)
        pairs = F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{2})*\d{3}$)", ",")
        return F.concat(F.when(value < 0, "-").otherwise(""), pairs, F.when(kept != "", F.concat(F.lit("."), kept)).otherwise(""))

    return F.when(value.isNotNull(), let(text, grouped))


def rupees(value: Column) -> Column:
    return F.concat(F.lit("₹"), indian_grouping(value, 2, 2))


def short_date(day: Column, form: str = "dd MMM yyyy") -> Column:
    return F.date_format(day, form)


def period(text: Column, short: bool = False) -> Column:
    """A range of dates without the year twice; a whole month by its name where ``short``; other texts as they are."""
    pattern = r"^(\d{4}-\d{2}-\d{2}) to (\d{4}-\d{2}-\d{2})$"
    start, end = (F.regexp_extract(text, pattern, k).try_cast("date") for k in (1, 2))
    first = F.when(F.year(start) == F.year(end), F.date_format(start, "dd MMM")).otherwise(F.date_format(start, "dd MMM yyyy"))
    ranged = F.concat(first, F.lit(" – "), F.date_format(end, "dd MMM yyyy"))
    whole = (start == F.trunc(start, "month")) & (end == F.last_day(start))
    return F.when(~text.rlike(pattern), text).when(whole & F.lit(short), F.date_format(start, "MMM yyyy")).otherwise(ranged)


def file_size(size: Column) -> Column:
    small = F.concat(F.greatest(F.lit(1), F.round(size / 1024)).cast("bigint").cast("string"), F.lit(" KB"))
    return F.when(size < 1024 * 1024, small).otherwise(F.concat(F.format_string("%.1f", size / 1024 / 1024), F.lit(" MB")))


def file_type(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in TYPES.items() for x in p]), kind), F.upper(F.coalesce(kind, F.lit(""))))


def ago(time: Column, now: Column) -> Column:
    """How long ago, up to a week; then the date."""
    s = F.unix_timestamp(now) - F.unix_timestamp(time)
    since = lambda unit, name: F.concat(F.round(s / unit).cast("bigint").cast("string"), F.lit(f" {name} ago"))
    return F.when(s < 45, "just now").when(s < 3600, since(60, "min")).when(s < 86400, since(3600, "h")).when(s < 7 * 86400, since(86400, "d")).otherwise(F.date_format(time, "dd MMM yyyy"))


def source(text: Column) -> Column:
    """Where a field was read: its label, its table column, by form, by calculation, or by which provider's layout."""
    kind, detail = F.substring_index(text, ":", 1), F.when(text.contains(":"), F.expr("null")).otherwise(F.lit(""))
    detail = F.coalesce(detail, F.regexp_replace(text, "^[^:]*:", ""))
    quoted = F.when(detail != "", F.concat(F.lit(" “"), detail, F.lit("”"))).otherwise("")
    named = F.initcap(kind)
    return (
        F.when(kind == "key_value", F.concat(F.lit("Label"), quoted)).when(kind == "table", F.concat(F.lit("Table"), quoted))
        .when(kind == "inferred", KINDS["inferred"]).when(kind == "derived", KINDS["derived"])
        .otherwise(F.when(detail != "", F.concat(named, F.lit(" · "), detail)).otherwise(named))
    )
