"""Queries over the bills table: listing, rules, duplicates, the store's log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedupe, listing, rollup, store, uploads, validate
from ..schemas import BILLS
from ..sources.bills import FROM_ORDERS_SQL, from_orders
from .registry import query

AS_OF = "1999-06-30"

JUDGED = f"WITH {FROM_ORDERS_SQL}, verdict AS (" + """
  SELECT *, CASE WHEN k10 = 3 THEN product ELSE units_consumed END AS units,
    CASE WHEN net_amount_due < 0 OR coalesce(reversed, false) OR coalesce(billing_period_end < billing_period_start, false) THEN 'INVALID'
         WHEN consumer_name IS NULL OR trim(account_number) = '' OR previous_reading IS NULL
              OR (k10 = 3 AND multiplying_factor IS NULL)
              OR coalesce(k10 <> 3 AND abs(units_consumed - product) > tolerance, false)
              OR coalesce(due_date < billing_period_end, false) OR coalesce(year(due_date) > 2000, false) OR coalesce(ocr_confidence < 60, false) THEN 'WARNING'
         ELSE 'VALID' END AS status
  FROM (SELECT *, id % 10 AS k10 FROM judged)
)
"""  # fmt: skip
ROWS = f"WITH {FROM_ORDERS_SQL} "


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(validate.derive_units(from_orders(spark, sf_dir)), as_of=F.lit(AS_OF).cast("date"))


def double(*names: str) -> list:
    return [F.col(n).cast("double").alias(n) for n in names]


def _summary(df: DataFrame) -> DataFrame:
    return df.select("id", "original_filename", "consumer_name", "account_number", "billing_period", F.col("due_date").cast("string").alias("due_date"), *double("units_consumed", "net_amount_due"), "validation_status", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))


SUMMARY_SQL = """id, original_filename, consumer_name, account_number, billing_period, CAST(due_date AS VARCHAR) AS due_date,
  CAST(units AS DOUBLE) AS units_consumed, CAST(net_amount_due AS DOUBLE) AS net_amount_due, status AS validation_status, strftime(created_at, '%Y-%m-%d') AS created_at"""


@query(f"{JUDGED} SELECT {SUMMARY_SQL} FROM verdict ORDER BY verdict.created_at DESC, id DESC LIMIT 20 OFFSET 40")
def list_page(spark, sf_dir):
    return _summary(listing.page(judged(spark, sf_dir), limit=20, offset=40))


@query(f"{JUDGED} SELECT count(*) AS total FROM verdict WHERE status = 'WARNING' AND contains(lower(consumer_name), 'plant c')")
def list_count(spark, sf_dir):
    return listing.total(judged(spark, sf_dir), status="WARNING", search=" Plant C ")


@query(f"{JUDGED} SELECT {SUMMARY_SQL} FROM verdict WHERE status = 'INVALID'")
def list_by_status(spark, sf_dir):
    return _summary(listing.matching(judged(spark, sf_dir), status="INVALID"))


@query(f"{ROWS} SELECT id, account_number, billing_period FROM bills WHERE account_number = '0000000042'")
def list_by_account(spark, sf_dir):
    return listing.matching(from_orders(spark, sf_dir), account_number="0000000042").select("id", "account_number", "billing_period")


@query(f"{ROWS} SELECT id, original_filename FROM bills WHERE contains(lower(consumer_name), '_50%') OR contains(account_number, '_50%') OR contains(lower(original_filename), '_50%')")
def search_literal_wildcards(spark, sf_dir):
    return listing.matching(from_orders(spark, sf_dir), search="_50%").select("id", "original_filename")


@query(f"{ROWS} SELECT id, consumer_name, billing_period FROM bills WHERE id = 77")
def get_by_id(spark, sf_dir):
    return listing.by_id(from_orders(spark, sf_dir), 77).select("id", "consumer_name", "billing_period")


@query(f"{ROWS} SELECT id, file_hash FROM bills WHERE file_hash = sha256('77|file')")
def find_by_hash(spark, sf_dir):
    import hashlib

    return listing.by_hash(from_orders(spark, sf_dir), hashlib.sha256(b"77|file").hexdigest()).select("id", "file_hash")


@query(f"{JUDGED} SELECT {SUMMARY_SQL} FROM verdict")
def summary_projection(spark, sf_dir):
    return _summary(judged(spark, sf_dir))


@query(f"{JUDGED} SELECT id AS bill_id, consumer_name, account_number, CAST(units AS DOUBLE) AS units_consumed, CAST(net_amount_due AS DOUBLE) AS net_amount_due, status AS validation_status FROM verdict")
def tariff_input(spark, sf_dir):
    return listing.tariff_input(judged(spark, sf_dir)).drop("billing_period", "billing_period_start", "billing_period_end")


@query(
    f"""{JUDGED} SELECT id, CASE WHEN net_amount_due < 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(reversed, false) THEN 1 ELSE 0 END
      + CASE WHEN coalesce(billing_period_end < billing_period_start, false) THEN 1 ELSE 0 END AS n_errors,
      CASE WHEN net_amount_due < 0 THEN 'Net amount due cannot be negative (' || CASE WHEN net_amount_due = trunc(net_amount_due) THEN CAST(CAST(net_amount_due AS BIGINT) AS VARCHAR) ELSE rtrim(CAST(net_amount_due AS VARCHAR), '0') END || ')' END AS first_negative
    FROM verdict"""
)
def response_warnings(spark, sf_dir):
    details = judged(spark, sf_dir).withColumn("validation_details", F.struct("errors", "warnings"))
    found = listing.responses(details.withColumns({"field_sources": F.lit(None).cast("map<string,string>"), "raw_ocr_text": F.lit("")}))
    n = F.size("validation_details.errors")
    first = F.try_element_at(F.filter("warnings", lambda w: F.startswith(w, F.lit("Net amount due cannot"))), F.lit(1))
    return found.filter(F.size("warnings") == n + F.size("validation_details.warnings")).select("id", n.alias("n_errors"), first.alias("first_negative"))


@query(f"{ROWS} SELECT id, CAST(CASE WHEN id % 10 = 3 THEN (current_reading - previous_reading) * coalesce(multiplying_factor, 1) ELSE units_consumed END AS DOUBLE) AS units_consumed, id % 10 = 3 AS derived FROM bills")
def derive_units(spark, sf_dir):
    df = validate.derive_units(from_orders(spark, sf_dir))
    return df.select("id", *double("units_consumed"), F.col("units_source").isNotNull().alias("derived"))


@query(
    f"""{ROWS} SELECT id, concat_ws(',', CASE WHEN consumer_name IS NULL THEN 'consumer_name' END, CASE WHEN trim(account_number) = '' THEN 'account_number' END,
      CASE WHEN previous_reading IS NULL THEN 'previous_reading' END, CASE WHEN units_consumed IS NULL THEN 'units_consumed' END) AS missing FROM bills"""
)
def missing_fields(spark, sf_dir):
    return from_orders(spark, sf_dir).select("id", F.array_join(validate.missing_fields(), ",").alias("missing"))


@query(f"{JUDGED} SELECT id, status FROM verdict WHERE net_amount_due < 0")
def negative_values(spark, sf_dir):
    df = judged(spark, sf_dir).filter(F.exists("field_checks", lambda c: (c["field"] == "net_amount_due") & (c["status"] == "invalid")))
    return df.select("id", F.col("validation_status").alias("status"))


@query(
    f"""{JUDGED} SELECT id, CASE WHEN coalesce(reversed, false) THEN false WHEN previous_reading IS NOT NULL AND k10 <> 3 THEN abs(units_consumed - product) <= tolerance END AS meter_reading_check,
      CAST(CASE WHEN coalesce(reversed, false) THEN current_reading - previous_reading ELSE product END AS DOUBLE) AS calculated_units,
      CAST(CASE WHEN NOT coalesce(reversed, true) AND k10 <> 3 THEN units_consumed - product END AS DOUBLE) AS difference FROM verdict"""
)
def meter_check(spark, sf_dir):
    return judged(spark, sf_dir).select("id", "meter_reading_check", *double("calculated_units", "difference"))


@query(
    f"""{ROWS} SELECT id, scale, abs(CAST(8 AS DECIMAL(20,6))) <= greatest(1.0, coalesce(multiplying_factor, 1) * CASE WHEN scale = 3 THEN 0.001 ELSE 1 END) AS within
      FROM bills WHERE previous_reading IS NOT NULL AND current_reading >= previous_reading"""
)
def meter_tolerance_scale(spark, sf_dir):
    """Units eight off the product: within the tolerance only where the factor times the printed step allows it."""
    df = from_orders(spark, sf_dir).filter("previous_reading is not null and current_reading >= previous_reading")
    product = (F.col("current_reading") - F.col("previous_reading")).cast("decimal(20,6)") * validate.factor()
    df = validate.validate(df.withColumn("units_consumed", (product + 8).cast("decimal(20,6)")).withColumn("open_access_units", F.lit(None).cast("decimal(20,6)")))
    return df.select("id", F.col("previous_scale").alias("scale"), F.col("meter_reading_check").alias("within"))


@query(
    f"""{JUDGED} SELECT id, coalesce(billing_period_end < billing_period_start, false) AS bad_period, coalesce(due_date < billing_period_end, false) AS early, year(due_date) > 2000 AS late FROM verdict"""
)
def date_checks(spark, sf_dir):
    has = lambda column, text: F.exists(column, lambda x: F.startswith(x, F.lit(text)))
    return judged(spark, sf_dir).select("id", has("errors", "Billing period end").alias("bad_period"), has("warnings", "Due date is before").alias("early"), has("warnings", "Due date is unusually").alias("late"))


@query(f"{JUDGED} SELECT id, 'Low OCR confidence (' || CAST(CAST(round_even(ocr_confidence, 0) AS BIGINT) AS VARCHAR) || '%). Please verify the extracted values.' AS warning FROM verdict WHERE ocr_confidence < 60")
def low_confidence(spark, sf_dir):
    low = F.try_element_at(F.filter("warnings", lambda w: F.startswith(w, F.lit("Low OCR"))), F.lit(1))
    return judged(spark, sf_dir).select("id", low.alias("warning")).filter("warning is not null")


@query(f"{JUDGED} SELECT status AS validation_status, extraction_method, count(*) AS n, CAST(sum(CAST(net_amount_due AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM verdict GROUP BY ALL")
def status_rollup(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("validation_status", "extraction_method").agg(F.count(F.lit(1)).alias("n"), F.sum("net_amount_due").cast("double").alias("amount"))


@query(f"{JUDGED} SELECT id, calculation FROM (SELECT id, '(' || c || ' - ' || p || ')' || CASE WHEN coalesce(multiplying_factor, 1) <> 1 THEN ' x ' || CAST(CAST(multiplying_factor AS BIGINT) AS VARCHAR) ELSE '' END || ' = ' || q AS calculation FROM (SELECT *, " + ", ".join(f"CASE WHEN {e} = trunc({e}) THEN CAST(CAST({e} AS BIGINT) AS VARCHAR) ELSE rtrim(CAST(CAST({e} AS DECIMAL(20,6)) AS VARCHAR), '0') END AS {a}" for e, a in (("current_reading", "c"), ("previous_reading", "p"), ("product", "q"))) + " FROM verdict WHERE current_reading >= previous_reading))")
def calculation_text(spark, sf_dir):
    return judged(spark, sf_dir).filter("calculation is not null").select("id", "calculation")


@query(f"{ROWS} SELECT b.id, array_to_string(list_sort(list(a.id)), ',') AS earlier FROM bills b JOIN bills a ON a.account_number = b.account_number AND a.billing_period = b.billing_period AND a.id < b.id GROUP BY b.id")
def possible_duplicates(spark, sf_dir):
    df = dedupe.possible_duplicates(from_orders(spark, sf_dir))
    return df.filter(F.size("possible_duplicate_of") > 0).select("id", F.array_join("possible_duplicate_of", ",").alias("earlier"))


@query(
    f"""{JUDGED}, dup AS (SELECT DISTINCT b.id FROM bills b JOIN bills a ON a.account_number = b.account_number AND a.billing_period = b.billing_period AND a.id < b.id)
      SELECT CASE WHEN status = 'VALID' AND dup.id IS NOT NULL THEN 'WARNING' ELSE status END AS validation_status, dup.id IS NOT NULL AS duplicate, count(*) AS n FROM verdict LEFT JOIN dup USING (id) GROUP BY ALL"""
)
def duplicate_flags(spark, sf_dir):
    df = dedupe.flag(dedupe.possible_duplicates(judged(spark, sf_dir)))
    return df.groupBy("validation_status", (F.size("possible_duplicate_of") > 0).alias("duplicate")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""{ROWS} SELECT n.id, array_to_string(list_sort(list(s.id)), ',') AS others FROM bills n JOIN bills s ON s.account_number = n.account_number AND s.billing_period = n.billing_period AND s.id <> n.id
      WHERE n.id % 3 = 0 AND s.id % 2 = 0 GROUP BY n.id"""
)
def replace_excludes_self(spark, sf_dir):
    """New bills (every third) against a store that has every second one, itself among them."""
    bills = from_orders(spark, sf_dir)
    df = dedupe.against_store(bills.filter("id % 3 = 0"), bills.filter("id % 2 = 0"))
    return df.filter(F.size("possible_duplicate_of") > 0).select("id", F.array_join("possible_duplicate_of", ",").alias("others"))


@query(f"{ROWS} SELECT file_hash, min(id) AS id FROM bills WHERE file_hash NOT IN (SELECT file_hash FROM bills WHERE id % 10 = 0) GROUP BY file_hash")
def exact_duplicates_rejected(spark, sf_dir):
    bills = from_orders(spark, sf_dir).select("id", "file_hash")
    return dedupe.new_files(bills, bills.filter("id % 10 = 0"), "id").select("file_hash", "id")


@query("SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def document_fingerprints(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"))
    return docs.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(f"{ROWS} SELECT a.id, b.id AS existing_id FROM bills a JOIN bills b USING (file_hash) WHERE a.id >= 7000 AND b.id < 7000")
def hash_conflicts(spark, sf_dir):
    bills = from_orders(spark, sf_dir).select("id", "file_hash")
    return dedupe.conflicts(bills.filter("id >= 7000"), bills.filter("id < 7000")).select("id", "existing_id")


@query(
    """SELECT o_custkey AS id, max(o_orderkey) AS seq, arg_max(o_totalprice, o_orderkey) AS net_amount_due FROM orders
      GROUP BY o_custkey HAVING arg_max(o_orderkey % 7, o_orderkey) <> 0"""
)
def event_log_current_state(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.when(k % 7 == 0, "DELETE").when(k % 2 == 0, "REPLACE").otherwise("CREATE")
    events = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("id"), k.alias("seq"), kind.alias("kind"), F.col("o_totalprice").alias("net_amount_due"))
    return store.current(events).select("id", "seq", "net_amount_due")


@query(f"{JUDGED} SELECT status <> 'INVALID' AS admitted, count(*) AS n FROM verdict GROUP BY 1")
def admission_split(spark, sf_dir):
    good, bad = store.admit(judged(spark, sf_dir))
    both = good.select(F.lit(True).alias("admitted")).unionByName(bad.select(F.lit(False).alias("admitted")))
    return both.groupBy("admitted").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS id, CAST(NULL AS VARCHAR) AS file_hash, 'bill_' || o_orderkey AS original_filename FROM orders")
def schema_upgrade(spark, sf_dir):
    """Rows of the first version, which had no hash, in today's schema."""
    old = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("bill_"), F.col("o_orderkey").cast("string")).alias("original_filename"))
    return store.upgrade(old, spark.createDataFrame([], BILLS)).select("id", "file_hash", "original_filename")


@query(
    """SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN 201 WHEN 1 THEN 415 WHEN 2 THEN 400 WHEN 3 THEN 413 WHEN 4 THEN 415 WHEN 5 THEN 415 WHEN 6 THEN 400 ELSE 201 END AS http_status,
      CASE o_orderkey % 8 WHEN 1 THEN 'unsupported_file_type' WHEN 2 THEN 'empty_file' WHEN 3 THEN 'file_too_large' WHEN 4 THEN 'unsupported_file_type' WHEN 5 THEN 'unsupported_file_type' WHEN 6 THEN 'invalid_upload' END AS error_code,
      CASE o_orderkey % 8 WHEN 0 THEN 'pdf' WHEN 7 THEN 'jpeg' END AS file_type, o_orderkey || CASE o_orderkey % 8 WHEN 1 THEN '.exe' WHEN 6 THEN '.png' WHEN 7 THEN '.JPG' ELSE '.pdf' END AS original_filename FROM orders"""
)
def upload_validation_codes(spark, sf_dir):
    from ..config import Settings

    k = F.pmod("o_orderkey", F.lit(8))
    suffix = F.when(k == 1, ".exe").when(k == 6, ".png").when(k == 7, ".JPG").otherwise(".pdf")
    media = F.when(k == 4, "image/png").when(k == 7, "application/octet-stream").when(k == 6, "image/png; q=1").otherwise("application/pdf")
    pdf, jpeg = F.lit("garbage%PDF-1.7 ...").cast("binary"), F.unhex(F.lit("FFD8FFE000"))
    content = F.when(k == 2, F.lit("").cast("binary")).when(k == 3, F.repeat(F.lit("%PDF-"), 10).cast("binary")).when(k == 5, F.lit("plain").cast("binary")).when(k == 7, jpeg).otherwise(pdf)
    files = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("C:\\scans\\"), F.col("o_orderkey").cast("string"), suffix).alias("filename"), media.alias("content_type"), content.alias("content"))
    return uploads.check(files, Settings(max_upload_bytes=40)).select("k", "http_status", F.when(F.col("error_code") != "", F.col("error_code")).alias("error_code"), "file_type", "original_filename")


@query(
    f"""{ROWS} SELECT field, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS matched, count(*) AS checked FROM (
      SELECT 'consumer_name' AS field, true AS ok FROM bills UNION ALL SELECT 'due_date', id % 11 <> 0 FROM bills UNION ALL SELECT 'units_consumed', id % 13 <> 0 OR units_consumed IS NULL FROM bills) GROUP BY field"""
)
def accuracy_report(spark, sf_dir):
    truth = from_orders(spark, sf_dir).select("id", "consumer_name", "due_date", "units_consumed")
    units = F.col("units_consumed") + F.when(F.col("id") % 13 == 0, 1).otherwise(0)
    actual = truth.withColumns({"due_date": F.date_add("due_date", F.when(F.col("id") % 11 == 0, 1).otherwise(0)), "units_consumed": units.cast("decimal(20,6)")})
    return rollup.accuracy(actual, truth, "id", ["consumer_name", "due_date", "units_consumed"])


@query("SELECT 1 AS alive")
def liveness(spark, sf_dir):
    return spark.sql("SELECT 1 AS alive")


