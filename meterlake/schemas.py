"""Schemas of the tables, as DDL strings. Decimals at rest follow the store; in flight they keep their printed scale."""

from __future__ import annotations

REQUIRED = ["consumer_name", "account_number", "billing_period", "due_date", "previous_reading", "current_reading", "units_consumed", "net_amount_due"]

LABELS = {
    "consumer_name": "Consumer name",
    "account_number": "Account number",
    "billing_period": "Billing period",
    "due_date": "Due date",
    "previous_reading": "Previous meter reading",
    "current_reading": "Current meter reading",
    "units_consumed": "Units consumed",
    "net_amount_due": "Net amount due",
}

DETAILS = (
    "struct<status:string,meter_reading_check:boolean,calculated_units:double,reported_units:double,difference:double,multiplying_factor:double,"
    "open_access_units:double,calculation:string,notes:array<string>,field_checks:array<struct<field:string,status:string,message:string>>,"
    "missing_fields:array<string>,warnings:array<string>,errors:array<string>,possible_duplicate_of:array<bigint>>"
)

BILLS = (
    "id bigint, original_filename string, stored_filename string, file_type string, file_hash string, consumer_name string, account_number string, "
    "billing_period string, billing_period_start date, billing_period_end date, due_date date, previous_reading decimal(14,3), "
    "current_reading decimal(14,3), units_consumed decimal(14,3), net_amount_due decimal(12,2), raw_ocr_text string, extraction_method string, "
    f"page_count int, ocr_confidence double, processing_time_ms int, parser_name string, validation_status string, validation_details {DETAILS}, "
    "field_sources map<string,string>, created_at timestamp, updated_at timestamp"
)

BILLS_V1 = BILLS.replace("file_hash string, ", "")  # before files had a hash

SUMMARY = ["id", "original_filename", "consumer_name", "account_number", "billing_period", "due_date", "units_consumed", "net_amount_due", "validation_status", "extraction_method", "created_at"]

WORDS = "doc_id bigint, page int, text string, x0 double, y0 double, x1 double, y1 double, conf double"
UPLOADS = "filename string, content_type string, content binary, replace boolean"
EVENTS = f"seq bigint, kind string, {BILLS}"
TRUTH = (
    "consumer_name string, account_number string, billing_period string, billing_period_start date, billing_period_end date, due_date date, "
    "previous_reading decimal(14,3), current_reading decimal(14,3), units_consumed decimal(14,3), net_amount_due decimal(12,2), validation_status string, extraction_method string"
)
