"""Listing, search and projections over the bills table. A filter that isn't given adds nothing to the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..schemas import SUMMARY

STATUSES = ("VALID", "WARNING", "INVALID")


def check_request(limit: int, offset: int, status: str | None, account_number: str | None, search: str | None, settings: Settings = Settings()) -> None:
    """Raises ValueError for arguments outside their domain."""
    if not 1 <= limit <= settings.largest_page or offset < 0:
        raise ValueError("limit or offset is out of range")
    if status and status not in STATUSES:
        raise ValueError("no such status")
    if len(account_number or "") > 64 or len(search or "") > 100:
        raise ValueError("the text is too long")


def matching(bills: DataFrame, status: str | None = None, account_number: str | None = None, search: str | None = None) -> DataFrame:
    """Bills with the status, the account and the text in name, account or file name; case and wildcards don't matter."""
    if status:
        bills = bills.filter(F.col("validation_status") == status)
    if account_number:
        bills = bills.filter(F.col("account_number") == account_number)
    if search and search.strip():
        term = F.lower(F.lit(search.strip()))
        bills = bills.filter(F.contains(F.lower("consumer_name"), term) | F.contains(F.lower("account_number"), term) | F.contains(F.lower("original_filename"), term))
    return bills


def total(bills: DataFrame, **filters: str | None) -> DataFrame:
    check_request(1, 0, **{k: filters.get(k) for k in ("status", "account_number", "search")})
    return matching(bills, **filters).agg(F.count(F.lit(1)).alias("total"))


def page(bills: DataFrame, limit: int = 20, offset: int = 0, **filters: str | None) -> DataFrame:
    """The newest bills first. Only the summary's columns are read."""
    check_request(limit, offset, **{k: filters.get(k) for k in ("status", "account_number", "search")})
    return matching(bills, **filters).select(*SUMMARY).orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(offset).limit(limit)


def pager(rows: DataFrame, total: str = "total", offset: str = "offset", size: int = 10) -> DataFrame:
    """What a pager shows for a total and an offset: ``first`` and ``last`` row, whether there is a page before and after.

    An offset behind the last row (it was deleted) is a page too far: the pager steps back to the last page with rows.
    """
    n, at = F.col(total), F.col(offset)
    back = F.ceil((at - n + 1) / F.lit(size)).cast("long") * size
    start = F.when(at >= n, F.greatest(F.lit(0), at - back)).otherwise(at)
    shown = rows.withColumn("_start", start.cast("long"))
    last = F.least(F.col("_start") + size, n)
    return shown.withColumns({"first": F.when(n > 0, F.col("_start") + 1), "last": last, "has_previous": F.col("_start") > 0, "has_next": last < n}).drop("_start")


def by_id(bills: DataFrame, bill_id: int) -> DataFrame:
    return bills.filter(F.col("id") == bill_id)


def by_hash(bills: DataFrame, file_hash: str) -> DataFrame:
    return bills.filter(F.col("file_hash") == file_hash)


def raw_text(bills: DataFrame) -> DataFrame:
    return bills.select("id", "raw_ocr_text", "extraction_method", "ocr_confidence")


def tariff_input(bills: DataFrame) -> DataFrame:
    """What a tariff calculation needs; JSON numbers, not decimals."""
    number = [F.col(c).cast("double").alias(c) for c in ("units_consumed", "net_amount_due")]
    return bills.select(F.col("id").alias("bill_id"), "consumer_name", "account_number", "billing_period", "billing_period_start", "billing_period_end", *number, "validation_status")


def responses(bills: DataFrame, with_text: bool = False) -> DataFrame:
    """The full answer: errors before warnings, text only if asked for."""
    d = F.col("validation_details")
    text = F.col("raw_ocr_text") if with_text else F.lit(None).cast("string")
    found = F.concat(F.coalesce(d["errors"], F.array()), F.coalesce(d["warnings"], F.array())).cast("array<string>")
    return bills.withColumns({"warnings": found, "raw_ocr_text": text, "field_sources": F.coalesce("field_sources", F.create_map().cast("map<string,string>"))})


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def exported(bills: DataFrame) -> DataFrame:
    """What a client exports as JSON: one value per bill, nulls included."""
    d = F.col("validation_details")
    rows = bills.select(
        "id", F.col("original_filename").alias("file"), "consumer_name", "account_number", "billing_period", "billing_period_start", "billing_period_end", "due_date", "previous_reading", "current_reading",
        d["multiplying_factor"].alias("multiplying_factor"), "units_consumed", "net_amount_due", "validation_status", d["meter_reading_check"].alias("meter_reading_check"),
        F.concat(F.coalesce(d["errors"], F.array()), F.coalesce(d["warnings"], F.array())).cast("array<string>").alias("warnings"), F.coalesce("field_sources", F.create_map().cast("map<string,string>")).alias("field_sources"),
    )
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
