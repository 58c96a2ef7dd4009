"""Queries over bills of utilities with layouts of their own, the whole parse, exclusions of extraction, and answers as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import extract, listing, providers
from ..sources.bills import spread
from .bills_queries import JUDGED, ROWS, double, judged
from .registry import query
from .text_queries import read

def _orders(spark, sf_dir, for_texts=False):
    """Orders with a key, a letter, the name of a month, and a consumption; for texts they are spread."""
    orders = read(spark, sf_dir, "orders")
    return (spread(orders, "o_orderkey") if for_texts else orders).selectExpr("*", "o_orderkey AS k", "char(65 + o_orderkey % 26) AS name", "date_format(o_orderdate, 'MMMM yyyy') AS month_name", "o_custkey % 500 AS used")


def _text(c) -> F.Column:
    return c.cast("string")


def _rajasthan(orders):
    wide = lambda c, n: F.rpad(c, n, " ")
    start = 1000 + F.col("o_custkey")
    head = F.concat(wide(F.lit("Consumer Name"), 30), wide(F.lit("Billing Month"), 24), wide(F.lit("Due Date"), 20), F.lit("Test/Open access"))
    row = F.concat(wide(F.concat(F.lit("M/S Mill "), F.col("name"), F.lit(" null,")), 30), wide(F.col("month_name"), 24), wide(F.date_format(F.date_add("o_orderdate", 20), "dd-MM-yyyy"), 20), _text(F.col("k") % 3))
    meter = F.when(F.col("k") % 7 != 0, F.concat_ws("  ", F.lit("Q1 KWH"), _text(start + F.col("used")), _text(start), _text(F.col("used")), F.lit("2"), _text(2 * F.col("used"))))
    account = F.concat(F.lit("K No. : "), F.lpad(_text(F.col("k")), 10, "0"))
    return orders.select(F.col("k").alias("doc_id"), F.concat_ws("\n", F.lit("Jodhpur Vidyut Vitran Nigam"), account, head, row, meter).alias("text"))


def _karnataka(orders):
    start = 1000 + F.col("o_custkey")
    order = F.when(F.col("k") % 2 == 1, "              Initial   Final").otherwise("              Final   Initial")
    first, second = F.when(F.col("k") % 2 == 1, start).otherwise(start + F.col("used")), F.when(F.col("k") % 2 == 1, start + F.col("used")).otherwise(start)
    meter = F.when(F.col("k") % 7 != 0, F.concat_ws("  ", F.lit("Main M.R."), _text(first), _text(second), _text(F.col("used")), F.lit("2"), _text(2 * F.col("used"))))
    amount = F.when(F.col("k") % 3 == 0, F.concat(F.lit("Grand Total   "), F.format_number("o_totalprice", 2))).otherwise(F.concat(F.lit("Say Rs. "), _text(F.col("k"))))
    account = F.concat(F.lit("R.R. No: HT "), F.translate(_text(F.col("k") % 1000 + 1), "5", "S"))
    due = F.concat(F.lit("Last Date of Payment: 16th "), F.date_format("o_orderdate", "MMM"))
    return orders.select(
        F.col("k").alias("doc_id"),
        F.concat_ws("\n", F.lit("GESCOM"), account, F.concat(F.lit("Name of the Firm : Works "), F.col("name")), F.concat(F.lit("for the Month of : "), F.col("month_name")), due, order, meter, amount).alias("text"),
    )


RAJASTHAN_SQL = """SELECT o_orderkey AS doc_id, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS account_number, 'M/S Mill ' || chr(CAST(65 + o_orderkey % 26 AS INT)) AS consumer_name, strftime(o_orderdate, '%B %Y') AS billing_period,
  strftime(o_orderdate + INTERVAL 20 DAY, '%Y-%m-%d') AS due_date, CASE WHEN m THEN CAST(1000 + o_custkey AS DOUBLE) END AS previous_reading, CASE WHEN m THEN CAST(1000 + o_custkey + o_custkey % 500 AS DOUBLE) END AS current_reading,
  CASE WHEN m THEN CAST(2 * (o_custkey % 500) AS DOUBLE) END AS units_consumed, CASE WHEN m THEN 2.0::DOUBLE END AS multiplying_factor, CASE WHEN m AND o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 3 AS DOUBLE) END AS open_access_units
  FROM (SELECT *, o_orderkey % 7 <> 0 AS m FROM orders)"""
METER = ("previous_reading", "current_reading", "units_consumed", "multiplying_factor")


@query(RAJASTHAN_SQL)
def rajasthan_columns(spark, sf_dir):
    """Values below headers, the meter's row, and open access that counts only beside such a row."""
    found = providers.rajasthan(_rajasthan(_orders(spark, sf_dir, for_texts=True)))
    return found.select("doc_id", "account_number", "consumer_name", F.col("period.display").alias("billing_period"), F.col("due_date").cast("string").alias("due_date"), *double(*METER, "open_access_units"))


@query(
    """SELECT o_orderkey AS doc_id, 'HT ' || (o_orderkey % 1000 + 1) AS account_number, 'Works ' || chr(CAST(65 + o_orderkey % 26 AS INT)) AS consumer_name, strftime(o_orderdate, '%B %Y') AS billing_period, '16' AS day, CAST(month(o_orderdate) AS INT) AS month,
      CASE WHEN m THEN CAST(1000 + o_custkey AS DOUBLE) END AS previous_reading, CASE WHEN m THEN CAST(1000 + o_custkey + o_custkey % 500 AS DOUBLE) END AS current_reading, CASE WHEN m THEN CAST(2 * (o_custkey % 500) AS DOUBLE) END AS units_consumed,
      CASE WHEN m THEN 2.0::DOUBLE END AS multiplying_factor, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE o_orderkey END AS DOUBLE) AS net_amount_due FROM (SELECT *, o_orderkey % 7 <> 0 AS m FROM orders)"""
)
def karnataka_main_meter(spark, sf_dir):
    """The main meter's row, whose columns are in the order of its headers; a misread number; either amount."""
    found = providers.karnataka(_karnataka(_orders(spark, sf_dir)))
    return found.select("doc_id", "account_number", "consumer_name", F.col("period.display").alias("billing_period"), "day", F.col("month").cast("int").alias("month"), *double(*METER, "net_amount_due"))


@query(
    """SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'rajasthan_discom' WHEN 1 THEN 'karnataka_escom' ELSE 'generic' END AS parser_name,
      CASE WHEN o_orderkey % 3 = 1 THEN 'HT ' || (o_orderkey % 1000 + 1) ELSE lpad(CAST(o_orderkey AS VARCHAR), 10, '0') END AS account_number,
      CASE WHEN o_orderkey % 3 = 2 OR o_orderkey % 7 <> 0 THEN CAST(1000 + o_custkey + o_custkey % 500 AS DOUBLE) END AS current_reading,
      CASE WHEN o_orderkey % 3 <> 1 THEN strftime(o_orderdate + INTERVAL 20 DAY, '%Y-%m-%d') ELSE strftime(make_date(year(o_orderdate), month(o_orderdate), 16), '%Y-%m-%d') END AS due_date,
      CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS n_notes FROM orders"""
)
def whole_parse(spark, sf_dir):
    """Bills of three kinds in one table: provider, general result, what the provider knows better, notes."""
    orders = _orders(spark, sf_dir)
    plain = F.concat(F.lit("Consumer No.: "), F.lpad(_text(F.col("k")), 10, "0"), F.lit("\nCurrent Reading: "), _text(1000 + F.col("o_custkey") + F.col("used")), F.lit("\nDue Date: "), F.date_format(F.date_add("o_orderdate", 20), "dd-MM-yyyy"))
    docs = _rajasthan(orders.filter(F.col("k") % 3 == 0)).unionByName(_karnataka(orders.filter(F.col("k") % 3 == 1))).unionByName(orders.filter(F.col("k") % 3 == 2).select(F.col("k").alias("doc_id"), plain.alias("text")))
    out = providers.parse(docs)
    return out.select("doc_id", "parser_name", "account_number", *double("current_reading"), F.col("due_date").cast("string").alias("due_date"), F.size("notes").alias("n_notes"))


@query(
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 6 = 5 THEN lpad(CAST(o_orderkey AS VARCHAR), 10, '0') END AS account_number, CASE WHEN o_orderkey % 6 = 3 THEN CAST(700 + o_orderkey AS DOUBLE) END AS previous_reading,
      CASE WHEN o_orderkey % 6 = 3 THEN CAST(950 + o_orderkey AS DOUBLE) END AS current_reading, CAST(NULL AS VARCHAR) AS billing_period, CAST(NULL AS VARCHAR) AS consumer_name FROM orders"""
)
def label_exclusions(spark, sf_dir):
    """Labels that announce nothing: an account beside a bank's name, two labels in one cell, a row of values, a row of dates, a label without a separator."""
    k = _text(F.col("k"))
    texts = [
        F.concat(F.lit("Bank of Hills RTGS\nAccount No.: 123456"), k),
        F.concat(F.lit("Previous/Current Reading: "), k),
        F.lit("Bill Month  202311  202310  202309"),
        F.concat(F.lit("Reading type    Previous    Present\nDate    01-10-2023    01-11-2023\nReading    "), _text(700 + F.col("k")), F.lit("    "), _text(950 + F.col("k"))),
        F.lit("Customer Care 1800"),
        F.concat(F.lit("Consumer No.: "), F.lpad(k, 10, "0")),
    ]
    found = extract.extract(_orders(spark, sf_dir).select(F.col("k").alias("doc_id"), F.element_at(F.array(*texts), (F.col("k") % 6 + 1).cast("int")).alias("text")))
    return found.select("doc_id", "account_number", *double("previous_reading", "current_reading"), "billing_period", "consumer_name")


@query("SELECT o_orderkey AS k, CASE WHEN 1900 + o_orderkey % 300 BETWEEN 1990 AND 2100 THEN CAST(make_date(CAST(1900 + o_orderkey % 300 AS INT), 6, 15) AS VARCHAR) END AS day, '2023-11-01 to 2023-11-30' AS period FROM orders")
def years_and_ranges(spark, sf_dir):
    """Years outside the plausible ones are no dates; ranges with each of the words and marks between their dates."""
    between = F.element_at(F.array(*map(F.lit, [*dates.RANGE_WORDS, *dates.RANGE_MARKS])), (F.col("k") % (len(dates.RANGE_WORDS) + len(dates.RANGE_MARKS)) + 1).cast("int"))
    period = dates.parse_billing_period(F.concat(F.lit("01-11-2023 "), between, F.lit(" 30.11.2023")))
    return _orders(spark, sf_dir).select(F.col("k").alias("k"), dates.parse_date(F.concat(F.lit("15/06/"), _text(1900 + F.col("k") % 300))).cast("string").alias("day"), period["display"].alias("period"))


def _stored(spark, sf_dir):
    """Judged bills as they are stored."""
    details = F.struct("errors", "warnings", "multiplying_factor", "meter_reading_check").alias("details")
    df = judged(spark, sf_dir).withColumn("validation_details", details).drop("errors", "warnings", "multiplying_factor", "meter_reading_check")
    return df.withColumns({"field_sources": F.lit(None).cast("map<string,string>"), "raw_ocr_text": F.concat(F.lit("Bill\n"), F.col("id").cast("string"))})


@query(f"{JUDGED} SELECT id, original_filename AS file, consumer_name, strftime(due_date, '%Y-%m-%d') AS due_date, CAST(net_amount_due AS DOUBLE) AS net_amount_due, status, 17 AS n_keys FROM verdict")
def exported_json(spark, sf_dir):
    """Each bill as one JSON value, nulls included, read back."""
    out = listing.exported(_stored(spark, sf_dir))
    get = lambda k: F.get_json_object("value", f"$.{k}")
    keys = F.size(F.json_object_keys("value")).alias("n_keys")
    return out.select(get("id").cast("long").alias("id"), get("file").alias("file"), get("consumer_name").alias("consumer_name"), get("due_date").alias("due_date"), get("net_amount_due").cast("double").alias("net_amount_due"), get("validation_status").alias("status"), keys)


@query(f"{JUDGED} SELECT id, status AS validation_status, account_number, CAST(5 + length(CAST(id AS VARCHAR)) AS INT) AS n_text FROM verdict")
def full_answer(spark, sf_dir):
    """The full answer with its text, as JSON and back."""
    out = listing.as_json(listing.responses(_stored(spark, sf_dir), with_text=True))
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return out.select(get("id").cast("long").alias("id"), get("validation_status").alias("validation_status"), get("account_number").alias("account_number"), F.length(get("raw_ocr_text")).alias("n_text"))


@query(f"{ROWS} SELECT id, 'Bill' || chr(10) || id AS raw_ocr_text, extraction_method, CAST(ocr_confidence AS DOUBLE) AS ocr_confidence FROM bills")
def raw_text(spark, sf_dir):
    return listing.raw_text(_stored(spark, sf_dir)).withColumn("ocr_confidence", F.col("ocr_confidence").cast("double"))
