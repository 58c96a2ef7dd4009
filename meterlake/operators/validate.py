"""Derived units and the rules by which a bill is VALID, WARNING or INVALID. One expression per rule, no branches on rows.

Rows have the required fields, the period's dates, ``multiplying_factor``, ``open_access_units``, ``ocr_confidence``,
``units_source`` and ``notes``; readings carry their printed decimals in ``previous_scale`` and ``current_scale`` (taken
as 0 where the columns are absent), as the tolerance depends on them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.core import let
from ..functions.numbers import DECIMAL, plain_number
from ..schemas import LABELS, REQUIRED

DERIVED = "derived:(current - previous) x MF - open access"
NUMERIC = ["previous_reading", "current_reading", "units_consumed", "net_amount_due"]


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def factor() -> Column:
    return F.when(F.col("multiplying_factor") > 0, F.col("multiplying_factor")).otherwise(F.lit(1)).cast(DECIMAL)


def _product() -> Column:
    """(current - previous) times the factor, less open-access units."""
    units = (F.col("current_reading") - F.col("previous_reading")).cast(DECIMAL) * factor()
    return (units.cast("decimal(28,8)") - F.coalesce("open_access_units", F.lit(0)).cast("decimal(20,6)")).cast("decimal(28,8)")


def derive_units(bills: DataFrame) -> DataFrame:
    """Units from the readings where the bill prints none, to three decimals, half to even."""
    if "units_source" not in bills.columns:
        bills = bills.withColumn("units_source", F.lit(None).cast("string"))
    possible = F.col("units_consumed").isNull() & (F.col("current_reading") >= F.col("previous_reading")) & (_product() >= 0)
    kind = bills.schema["units_consumed"].dataType
    return bills.withColumn("_derived", possible).withColumns(
        {
            "units_consumed": F.when(F.col("_derived"), F.bround(_product(), 3).cast(kind)).otherwise(F.col("units_consumed")),
            "units_source": F.when(F.col("_derived"), DERIVED).otherwise(F.col("units_source")),
        }
    ).drop("_derived")


def is_missing(field: str) -> Column:
    return F.coalesce(F.trim(F.col(field).cast("string")) == "", F.lit(True))


def missing_fields() -> Column:
    return F.filter(F.array(*[F.when(is_missing(f), f) for f in REQUIRED]), lambda x: x.isNotNull())


def _printed(name: str, scale: str) -> Column:
    """A number with the decimals that the bill prints."""
    return let(F.abs(F.col(name)).cast(DECIMAL), lambda v: F.concat(F.when(F.col(name) < 0, "-").otherwise(""), F.when(F.col(scale) > 0, F.substring_index(v.cast("string"), ".", 1)).otherwise(F.regexp_replace(v.cast("string"), r"\..*", "")), F.when(F.col(scale) > 0, F.concat(F.lit("."), F.left(F.substring_index(v.cast("string"), ".", -1), F.col(scale)))).otherwise("")))


def validate(bills: DataFrame, settings: Settings = Settings(), as_of: Column | None = None) -> DataFrame:
    """Add ``validation_status``, ``meter_reading_check``, ``calculated_units``, ``difference``, ``calculation``,
    ``missing_fields``, ``warnings``, ``errors``, ``notes`` and ``field_checks``."""
    scales = {s: F.coalesce(_column(bills, s, "int"), F.lit(0)) for s in ("previous_scale", "current_scale")}
    for name, kind in (("open_access_units", DECIMAL), ("ocr_confidence", "double"), ("units_source", "string"), ("multiplying_factor", DECIMAL)):
        if name not in bills.columns:
            scales[name] = F.lit(None).cast(kind)
    scales["notes"] = F.coalesce(_column(bills, "notes", "array<string>"), F.array().cast("array<string>"))
    df = bills.withColumns(scales)
    previous, current, units = F.col("previous_reading"), F.col("current_reading"), F.col("units_consumed")
    both = previous.isNotNull() & current.isNotNull()
    reversed_ = F.coalesce(current < previous, F.lit(False))
    open_access = F.coalesce(F.col("open_access_units") != 0, F.lit(False))
    raw_difference = (current - previous).cast("decimal(28,8)")
    df = df.withColumns(
        {
            "missing_fields": missing_fields(),
            "_reversed": reversed_,
            "_derived": F.coalesce(F.col("units_source") == DERIVED, F.lit(False)),
            "_open": open_access,
            "_factor": factor(),
            "calculated_units": F.when(reversed_, raw_difference).when(both, _product()),
        }
    )
    text = plain_number
    formula = F.concat(
        F.lit("("), text(current.cast(DECIMAL)), F.lit(" - "), text(previous.cast(DECIMAL)), F.lit(")"),
        F.when(F.col("_factor") != 1, F.concat(F.lit(" x "), text(F.col("_factor")))).otherwise(""),
        F.when(F.col("_open"), F.concat(F.lit(" - "), text(F.col("open_access_units").cast(DECIMAL)), F.lit(" open-access units"))).otherwise(""),
        F.lit(" = "), text(F.col("calculated_units")),
    )
    checked = both & ~F.col("_reversed") & units.isNotNull() & ~F.col("_derived")
    step = F.element_at(F.array(*[F.lit(s).cast("decimal(20,6)") for s in ("1", "0.1", "0.01", "0.001", "0.0001", "0.00001", "0.000001")]), F.least(F.greatest("previous_scale", "current_scale"), F.lit(6)) + 1)
    tolerance = F.greatest(F.lit(settings.meter_tolerance).cast("decimal(28,8)"), (F.col("_factor") * step).cast("decimal(28,8)"))
    df = df.withColumns({"calculation": F.when(both & ~F.col("_reversed"), formula), "difference": F.when(checked, (units.cast("decimal(28,8)") - F.col("calculated_units")).cast("decimal(28,8)"))})
    df = df.withColumn("meter_reading_check", F.when(F.col("_reversed"), F.lit(False)).when(checked, F.abs(F.col("difference")) <= tolerance))
    mismatch = checked & ~F.coalesce("meter_reading_check", F.lit(True))
    agrees = checked & F.coalesce("meter_reading_check", F.lit(False))
    start, end, due = F.col("billing_period_start"), F.col("billing_period_end"), F.col("due_date")
    bad_period = F.coalesce(end < start, F.lit(False))
    today = as_of if as_of is not None else F.current_date()

    def listed(rules: list[tuple[Column, Column | str]]) -> Column:
        return F.filter(F.array(*[F.when(when, message) for when, message in rules]), lambda x: x.isNotNull())

    def broken(rules: list[tuple[Column, Column | str]]) -> Column:
        """Whether some rule is broken: from the flags alone, so a query that only asks for the status makes no message."""
        return reduce(or_, [F.coalesce(when, F.lit(False)) for when, _ in rules])

    scale = {"previous_reading": "previous_scale", "current_reading": "current_scale"}
    negative = {f: F.coalesce(F.col(f) < 0, F.lit(False)) for f in NUMERIC}
    negative_text = {f: F.concat(F.lit(f"{LABELS[f]} cannot be negative ("), _printed(f, scale[f]) if f in scale else text(F.col(f).cast(DECIMAL)), F.lit(")")) for f in NUMERIC}
    reversed_text = F.concat(F.lit("Current reading ("), _printed("current_reading", "current_scale"), F.lit(") is lower than previous reading ("), _printed("previous_reading", "previous_scale"), F.lit(")"))
    period_text = F.lit("Billing period end date is before its start date")
    nothing = F.size("missing_fields") == len(REQUIRED)
    errors = [
        *[(negative[f], negative_text[f]) for f in NUMERIC],
        (F.col("_reversed"), reversed_text),
        (bad_period, period_text),
        (nothing, "No bill fields could be extracted from the document."),
    ]
    warnings = [
        *[(is_missing(f), f"{LABELS[f]} could not be confidently extracted") for f in REQUIRED],
        (~both & units.isNotNull(), "Meter readings incomplete; units consumed could not be cross-checked"),
        (both & ~F.col("_reversed") & F.col("_derived") & F.col("multiplying_factor").isNull(), "Units consumed was calculated without a multiplying factor (none found on the bill); please verify"),
        (mismatch, F.concat(F.lit("Meter readings do not reconcile with reported units: "), F.col("calculation"), F.lit(", but the bill reports "), text(units.cast(DECIMAL)), F.lit(" (difference "), text(F.col("difference")), F.lit(")"))),
        (due < end, "Due date is before the end of the billing period"),
        (F.year(due) > F.year(today) + 1, "Due date is unusually far in the future; please verify"),
        (F.col("ocr_confidence") < settings.low_confidence, F.concat(F.lit("Low OCR confidence ("), F.bround(F.col("ocr_confidence"), 0).cast("int").cast("string"), F.lit("%). Please verify the extracted values."))),
    ]
    notes = F.concat(
        F.col("notes"),
        listed([
            (both & ~F.col("_reversed") & F.col("_derived"), F.concat(F.lit("Units consumed is not printed on the bill; calculated from the meter readings: "), F.col("calculation"))),
            (agrees & (F.col("_factor") != 1), F.concat(F.lit("Units include the meter multiplying factor "), text(F.col("_factor")))),
            (agrees & F.col("_open"), F.concat(text(F.col("open_access_units").cast(DECIMAL)), F.lit(" open-access units are excluded from billed consumption"))),
        ]),
    )

    def check(f: str) -> Column:
        """The last rule that says something about the field decides."""
        status, message = F.when(is_missing(f), "missing").otherwise("ok"), F.lit(None).cast("string")
        rules = [(negative[f], "invalid", negative_text[f])] if f in NUMERIC else []
        rules += [(F.col("_reversed"), "invalid", reversed_text)] if f == "current_reading" else []
        rules += [(mismatch, "mismatch", F.lit("Does not equal (current - previous) x MF - open-access units"))] if f == "units_consumed" else []
        rules += [(bad_period, "invalid", period_text)] if f == "billing_period" else []
        for when, s, m in rules:
            status, message = F.when(when, s).otherwise(status), F.when(when, m).otherwise(message)
        return F.struct(F.lit(f).alias("field"), status.alias("status"), message.alias("message"))

    status = F.when(broken(errors), "INVALID").when(broken(warnings), "WARNING").otherwise("VALID")
    df = df.withColumns({"validation_status": status, "errors": listed(errors), "warnings": listed(warnings), "notes": notes, "field_checks": F.array(*map(check, REQUIRED))})
    return df.drop("_reversed", "_derived", "_open", "_factor")
