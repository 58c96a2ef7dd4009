"""Queries over text: parsers, extraction from rendered bills, providers, layout, documents from pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import core, dates, display, ids, numbers, text
from ..operators import align, extract, layout, providers, rollup, validate
from ..sources import synth
from ..sources.bills import FROM_ORDERS_SQL, from_orders
from .bills_queries import double
from .registry import query

ROWS = f"WITH {FROM_ORDERS_SQL} "


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 OR (length(regexp_replace(n, '[^0-9]', '', 'g')) > 0 AND 2 * length(regexp_replace(n, '[^0-9]', '', 'g')) >= length(replace(replace(n, ',', ''), '.', '')))
      THEN CAST(o_totalprice AS DOUBLE) END AS value, CASE WHEN o_orderkey % 5 <> 0 OR (length(regexp_replace(n, '[^0-9]', '', 'g')) > 0 AND 2 * length(regexp_replace(n, '[^0-9]', '', 'g')) >= length(replace(replace(n, ',', ''), '.', ''))) THEN 2 END AS scale
      FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN translate(s, '0158', 'OISB') ELSE s END AS n FROM (SELECT *, format('{:,.2f}', o_totalprice) AS s FROM orders))"""
)
def parse_number_roundtrip(spark, sf_dir):
    printed = F.format_number("o_totalprice", 2)
    noisy = F.concat(F.when(F.col("o_orderkey") % 5 == 0, F.translate(printed, "0158", "OISB")).otherwise(printed), F.lit(" kWh"))
    n = numbers.parse_number(noisy)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), n.alias("n")).select("k", F.col("n.value").cast("double").alias("value"), F.col("n.scale").alias("scale"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END AS amount FROM orders")
def parse_amount_roundtrip(spark, sf_dir):
    """Marks of currency before the amount; a third decimal is no amount."""
    marks = F.element_at(F.array(*map(F.lit, ("Rs. ", "₹", "= Rs.", "INR ", "", "Rs "))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    more = F.when(F.col("o_orderkey") % 6 == 5, "5").otherwise("")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), numbers.parse_amount(F.concat(marks, F.format_number("o_totalprice", 2), more)).cast("double").alias("amount"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 <> 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS found FROM orders")
def parse_date_formats(spark, sf_dir):
    """Five ways to print a date, and a date that doesn't exist."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    shape = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "dd/MM/yyyy")).when(k == 2, F.date_format(day, "d MMM yyyy")).when(k == 3, F.date_format(day, "MMMM d, yyyy"))
    shape = shape.when(k == 4, F.concat(F.translate(F.date_format(day, "dd.MM."), "0", "O"), F.year(day).cast("string"))).otherwise(F.concat(F.lit("31-02-"), F.year(day).cast("string")))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), dates.parse_date(F.concat(F.lit("on "), shape)).cast("string").alias("found"))


@query(
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 3 THEN strftime(o_orderdate, '%Y-%m-%d') || ' to ' || strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') WHEN o_orderkey % 4 = 2 THEN strftime(make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), 1), '%B %Y') ELSE strftime(o_orderdate, '%B %Y') END AS display,
      CASE WHEN o_orderkey % 4 = 3 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS last FROM orders"""
)
def parse_period_formats(spark, sf_dir):
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    shape = F.when(k == 0, F.upper(F.date_format(day, "MMM-yyyy"))).when(k == 1, F.date_format(day, "MM/yyyy")).when(k == 2, F.date_format(day, "MMMM yy"))
    shape = shape.otherwise(F.concat(F.date_format(day, "dd-MM-yyyy"), F.lit(" to "), F.date_format(F.date_add(day, 30), "dd MMM yyyy")))
    found = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), dates.parse_billing_period(shape).alias("p"))
    return found.select("k", F.col("p.display").alias("display"), F.col("p.end").cast("string").alias("last"))


@query(
    """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN lpad(CAST(c_custkey AS VARCHAR), 10, '0') WHEN 1 THEN lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 2 THEN 'HT/IND/' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS account FROM customer"""
)
def parse_account_ids(spark, sf_dir):
    """Leading zeros, groups of four, structured ids; words are none."""
    k, digits = F.col("c_custkey") % 4, F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    shape = F.when(k == 0, F.lpad(F.col("c_custkey").cast("string"), 10, "0")).when(k == 1, F.concat_ws(" ", F.left(digits, F.lit(4)), F.right(digits, F.lit(4))))
    shape = shape.when(k == 2, F.concat(F.lit("ht/ind/"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))).otherwise("not-a-number")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), ids.parse_account_number(shape).alias("account"))


@query(
    """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'M/S ' || c_mktsegment || ' TRADERS' WHEN 1 THEN upper(c_mktsegment) || ' (INDIA) PVT. LTD' WHEN 2 THEN 'Mr. A. ' || c_mktsegment END AS name FROM customer"""
)
def parse_name_rules(spark, sf_dir):
    s, k = F.col("c_mktsegment"), F.col("c_custkey") % 4
    shape = F.when(k == 0, F.concat(F.lit("M/S "), s, F.lit(" TRADERS 12"))).when(k == 1, F.concat(F.lower(s), F.lit(" (india)  pvt. ltd."))).when(k == 2, F.concat(F.lit("Mr. A. "), s)).otherwise(F.concat(F.lit("Mobile "), s))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), ids.parse_name(shape).alias("name"))


@query("""SELECT doc_id, length(regexp_replace(text, '[\\s|]+', '', 'g')) AS visible, len(string_split(text, chr(10))) AS n_lines FROM documents""")
def normalize_text(spark, sf_dir):
    """What normalising keeps: all visible characters and the lines of these documents."""
    noisy = F.concat(F.lit("\n\n"), F.regexp_replace("text", "\n", "  \r\n"), F.lit("\t\n\n"))
    t = read(spark, sf_dir, "documents").select("doc_id", text.normalize_text(noisy).alias("t"))
    return t.select("doc_id", F.length(F.regexp_replace("t", r"\s+", "")).alias("visible"), F.size(F.split("t", "\n")).cast("long").alias("n_lines"))


@query("SELECT o_orderkey AS k, 3 AS n, length('A' || o_orderkey) + 3 AS second, 'B ' || o_custkey AS second_text, length('A' || o_orderkey || 'B ' || o_custkey) + 7 AS third FROM orders")
def split_cells(spark, sf_dir):
    line = F.concat(F.lit("A"), F.col("o_orderkey").cast("string"), F.lit("   B "), F.col("o_custkey").cast("string"), F.lit("    "), F.col("o_orderstatus"), F.lit("  "))
    c = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), core.cells(line).alias("c"))
    return c.select("k", F.size("c").alias("n"), F.col("c")[1]["start"].alias("second"), F.col("c")[1]["text"].alias("second_text"), F.col("c")[2]["start"].alias("third"))


@query("""SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) >= 400 AND 2 * length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) >= length(regexp_replace(text, '\\s+', '', 'g')) AS useful FROM documents""")
def useful_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.is_useful_text(F.col("text"), 400).alias("useful"))


@query(f"{ROWS} SELECT id AS doc_id, consumer_name, CASE WHEN trim(account_number) <> '' THEN account_number END AS account_number, billing_period, CAST(due_date AS VARCHAR) AS due_date, CAST(previous_reading AS DOUBLE) AS previous_reading, CAST(current_reading AS DOUBLE) AS current_reading, CAST(units_consumed AS DOUBLE) AS units_consumed, CAST(net_amount_due AS DOUBLE) AS net_amount_due, CAST(multiplying_factor AS DOUBLE) AS multiplying_factor FROM bills")
def text_roundtrip(spark, sf_dir):
    """Every bill as text in one of three layouts, read back: the fields are those of the bill."""
    found = extract.extract(synth.render(from_orders(spark, sf_dir)))
    return found.select("doc_id", "consumer_name", "account_number", "billing_period", F.col("due_date").cast("string").alias("due_date"), *double("previous_reading", "current_reading", "units_consumed", "net_amount_due", "multiplying_factor"))


@query(
    f"""{ROWS}, r AS (SELECT *, id % 10 = 3 AND (current_reading - previous_reading) IS NOT NULL AS derived, (current_reading - previous_reading) * coalesce(multiplying_factor, 1) AS product,
      greatest(1.0, coalesce(multiplying_factor, 1) * CASE WHEN scale = 3 THEN 0.001 ELSE 1 END) AS tolerance FROM bills)
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN net_amount_due < 0 OR current_reading < previous_reading THEN 'INVALID'
      WHEN consumer_name IS NULL OR trim(account_number) = '' OR previous_reading IS NULL OR (derived AND multiplying_factor IS NULL) OR (NOT derived AND abs(units_consumed - product) > tolerance)
      OR coalesce(due_date < CASE WHEN id % 2 = 0 THEN last_day(billing_period_start) END, false) OR year(due_date) > 2000 THEN 'WARNING' ELSE 'VALID' END AS status FROM r) GROUP BY status"""
)
def text_to_status(spark, sf_dir):
    """The whole way: text, fields, derived units, rules, number of bills by status."""
    found = extract.extract(synth.render(from_orders(spark, sf_dir, for_texts=True))).withColumn("units_source", F.try_element_at("sources", F.lit("units_consumed")))
    done = validate.validate(validate.derive_units(found), as_of=F.lit("1999-06-30").cast("date"))
    return done.groupBy(F.col("validation_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""{ROWS} SELECT field, source, count(*) AS n FROM (
      SELECT id, unnest([{{'field': 'units_consumed', 'source': CASE WHEN units_consumed IS NOT NULL THEN CASE id % 3 WHEN 0 THEN 'key_value:Units Consumed' WHEN 1 THEN 'table:Units Consumed' ELSE 'key_value:Total Units' END END}},
        {{'field': 'current_reading', 'source': CASE id % 3 WHEN 0 THEN 'key_value:Current Reading' WHEN 1 THEN 'table:Current Reading' ELSE 'table:Present' END}}], recursive := true) FROM bills) WHERE source IS NOT NULL GROUP BY ALL"""
)
def field_source_counts(spark, sf_dir):
    found = extract.extract(synth.render(from_orders(spark, sf_dir, for_texts=True))).select(F.explode("sources").alias("field", "source"))
    return found.filter(F.col("field").isin("units_consumed", "current_reading")).groupBy("field", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN '0,1,2' ELSE '0,-1,1' END AS places FROM orders")
def align_columns(spark, sf_dir):
    """Values that drift under their headers, with an empty column."""
    k = F.col("o_orderkey")
    cell = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit("").alias("text"))
    heads = F.array(*[cell(F.lit(a), F.lit(a + 8)) for a in (0, 20, 40)])
    values = F.filter(F.array(cell(k % 7, k % 7 + 4), F.when(k % 2 == 0, cell(24 + k % 5, 30 + k % 5)), cell(44 - k % 3, 50 - k % 3)), lambda c: c.isNotNull())
    return read(spark, sf_dir, "orders").select(k.alias("k"), F.array_join(align.assigned(values, heads).cast("array<string>"), ",").alias("places"))


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'apdcl' WHEN 1 THEN 'rajasthan_discom' WHEN 2 THEN 'karnataka_escom' WHEN 3 THEN CASE WHEN regexp_matches(text, '(?i)R\\.?\\s*R\\.?\\s*No\\b') THEN 'karnataka_escom' ELSE 'generic' END ELSE 'generic' END AS provider FROM documents"""
)
def provider_detect(spark, sf_dir):
    marks = ("Assam  Power Distribution", "Jaipur Vidyut Vitran Nigam", "GESCOM\nR.R. No 12", "BESCOM without a number", "")
    mark = F.element_at(F.array(*map(F.lit, marks)), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", providers.detect(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), mark)).alias("provider"))


REGISTERS_SQL = """SELECT l_orderkey AS doc_id, CASE WHEN l_orderkey % 9 = 0 AND bool_or(l_linenumber = 1) THEN NULL ELSE CAST(sum(l_partkey) AS DOUBLE) END AS previous_reading,
  CASE WHEN l_orderkey % 9 = 0 AND bool_or(l_linenumber = 1) THEN NULL ELSE CAST(sum(l_partkey + l_quantity) AS DOUBLE) END AS current_reading,
  CASE WHEN l_orderkey % 9 = 0 AND bool_or(l_linenumber = 1) THEN NULL ELSE CAST(sum(l_linenumber) AS DOUBLE) END AS open_access_units"""


def _registers(spark, sf_dir):
    return providers.apdcl(synth.time_of_day(read(spark, sf_dir, "lineitem")))


@query(f"{REGISTERS_SQL} FROM lineitem GROUP BY l_orderkey")
def tod_register_sum(spark, sf_dir):
    return _registers(spark, sf_dir).select("doc_id", *double("previous_reading", "current_reading", "open_access_units"))


@query("SELECT l_orderkey AS doc_id FROM lineitem WHERE l_orderkey % 9 = 0 GROUP BY l_orderkey HAVING bool_or(l_linenumber = 1)")
def register_consistency(spark, sf_dir):
    """Documents whose registers contradict themselves: no readings at all, and a note that says so."""
    df = _registers(spark, sf_dir).filter("previous_reading is null and current_reading is null")
    return df.filter(F.exists("notes", lambda n: n.contains("don't add up"))).select("doc_id")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity) AS place FROM lineitem),
      z AS (SELECT *, min(place) OVER w AS first_place, 2 * arg_min(l_quantity, place) OVER w AS first_units FROM r WINDOW w AS (PARTITION BY l_orderkey, l_linenumber))
      SELECT l_orderkey AS doc_id, CASE WHEN NOT (l_orderkey % 9 = 0 AND bool_or(l_linenumber = 1)) AND max(first_place) <= 11 THEN CAST(sum(first_units) AS DOUBLE) END AS units_consumed FROM z GROUP BY l_orderkey"""
)
def zone_units_sum(spark, sf_dir):
    """Units of all zones together; a zone is looked for in eleven lines, a repeated one counts as its first line each time."""
    return _registers(spark, sf_dir).select("doc_id", *double("units_consumed"))


@query(
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(make_date(year(o_orderdate) + CASE WHEN o_orderkey % 4 <> 0 AND month(d) < month(o_orderdate) THEN 1 WHEN o_orderkey % 4 = 0 THEN year(d) - year(o_orderdate) ELSE 0 END, month(d), 16), '%Y-%m-%d') END AS due_date,
      CASE WHEN o_orderkey % 4 = 2 THEN 2 WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS n_notes FROM (SELECT *, o_orderdate + INTERVAL 20 DAY AS d FROM orders)"""
)
def due_date_year_inference(spark, sf_dir):
    """Day and month with a year, without one, with a misread day, and without any period to take the year from."""
    k, d = F.col("o_orderkey") % 4, F.date_add(F.col("o_orderdate").cast("date"), 20)
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.when(k == 2, "46").otherwise("16").alias("day"), F.month(d).alias("month"), F.when(k == 0, F.year(d).cast("string")).alias("year"),
        F.when(k != 3, F.date_format("o_orderdate", "MMMM yyyy")).alias("period_text"),
    )
    out = providers.due_date_without_year(rows)
    return out.select("k", F.col("due_date").cast("string").alias("due_date"), F.size("due_notes").alias("n_notes"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'M/S ' || c_mktsegment || ' Pvt. Ltd' ELSE 'M/S ' || c_mktsegment || ' Pvt' END AS name FROM customer")
def wrapped_name(spark, sf_dir):
    """A company's suffix on the next line belongs to the name if it stands below it."""
    second = F.when(F.col("c_custkey") % 2 == 0, "               Ltd.").otherwise("                              Ltd.")
    doc = F.concat(F.lit("Consumer Name: M/S "), F.col("c_mktsegment"), F.lit(" Pvt.\n"), second)
    found = extract.extract(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), doc.alias("text")))
    return found.select(F.col("doc_id").alias("k"), F.col("consumer_name").alias("name"))


@query("SELECT o_orderkey AS doc_id, rpad('A' || o_orderkey, 20, ' ') || 'B' || o_custkey || chr(10) || 'total  ' || o_orderstatus AS text FROM orders")
def layout_rows(spark, sf_dir):
    """Words with jittered boxes back to lines: two rows, columns by position."""
    k = F.col("o_orderkey")
    jitter = (k % 3).cast("double") / 10

    def word(t, x, y):
        return F.struct(t.alias("text"), F.lit(float(x)).alias("x0"), (F.lit(float(y)) + jitter).alias("y0"), (F.lit(float(x)) + 5.0 * F.length(t)).alias("x1"), (F.lit(y + 10.0) + jitter).alias("y1"))

    words = F.array(word(F.concat(F.lit("B"), F.col("o_custkey").cast("string")), 100, 0.5), word(F.concat(F.lit("A"), k.cast("string")), 0, 0), word(F.lit("total"), 0, 20), word(F.col("o_orderstatus"), 35, 20.4), word(F.lit("  "), 50, 3))
    df = read(spark, sf_dir, "orders").select(k.alias("doc_id"), F.lit(1).alias("page"), F.explode(words).alias("w")).select("doc_id", "page", "w.*")
    return layout.to_text(df).select("doc_id", "text")


@query(
    """SELECT conv_id AS doc_id, CASE WHEN count(DISTINCT role) = 1 THEN min(CASE role WHEN 'user' THEN 'text' ELSE 'ocr' END) ELSE 'mixed' END AS extraction_method, CAST(count(*) AS INT) AS page_count,
      round_even(avg(CASE WHEN role <> 'user' THEN (turn * 7 + conv_id) % 64 + 0.5 END), 2) AS ocr_confidence,
      CASE WHEN count(*) = 1 THEN min(text) ELSE string_agg('----- Page ' || turn || ' -----' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) END AS text FROM conversations GROUP BY conv_id"""
)
def document_rollup(spark, sf_dir):
    ocr = F.col("role") != "user"
    pages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text", F.when(ocr, "ocr").otherwise("text").alias("method"), F.when(ocr, ((F.col("turn") * 7 + F.col("conv_id")) % 64).cast("double") + 0.5).alias("confidence"))
    return rollup.documents(pages)


@query(
    """WITH p AS (SELECT l_orderkey AS doc_id, 1 + l_linenumber % 2 AS pass_no, round_even(avg(l_quantity * 2), 2) AS mean_conf, sum(CASE WHEN l_quantity * 2 >= 30 THEN l_quantity * 2 ELSE 0 END) AS score FROM lineitem GROUP BY ALL),
      f AS (SELECT doc_id, mean_conf FROM p WHERE pass_no = 1), u AS (SELECT p.* FROM p JOIN f USING (doc_id) WHERE pass_no = 1 OR f.mean_conf < 80)
      SELECT doc_id, pass_no, mean_conf, score FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pass_no) = 1"""
)
def ocr_variant_pick(spark, sf_dir):
    """Line items as OCR words of two passes: the second counts where the first is unsure, the better one stays."""
    no = (1 + F.col("l_linenumber") % 2).cast("int")
    words = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.when(no == 1, "light").otherwise("binary").alias("variant"), F.col("l_returnflag").alias("text"), (F.col("l_quantity") * 2).alias("conf"))
    passes = rollup.page_confidence(words).withColumn("pass_no", F.when(F.col("variant") == "light", 1).otherwise(2))
    return rollup.best_pass(rollup.needed_passes(passes)).select("doc_id", "pass_no", "mean_conf", "score")


@query("SELECT l_orderkey AS doc_id, CASE WHEN 2 * count(*) FILTER (WHERE l_linenumber % 3 <> 0) < count(*) THEN count(*) ELSE count(*) FILTER (WHERE l_linenumber % 3 <> 0) END AS n FROM lineitem GROUP BY l_orderkey HAVING n > 0")
def angled_words(spark, sf_dir):
    """Every third word stands at an angle and goes, unless most of its page does."""
    angled = F.col("l_linenumber") % 3 == 0
    words = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.when(angled, 0.7).otherwise(1.0).alias("dx"), F.when(angled, 0.7).otherwise(0.0).alias("dy"))
    return rollup.upright(words).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT o_orderkey AS k, '₹' || CASE WHEN v < 100000 THEN format('{:,.2f}', o_totalprice * 1.0) ELSE CAST(v // 100000 AS VARCHAR) || ',' || lpad(CAST((v // 1000) % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST(v % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') END AS amount,
      strftime(o_orderdate, '%d %b %Y') AS day FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)"""
)
def indian_amounts(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), display.rupees(F.col("o_totalprice")).alias("amount"), display.short_date(F.col("o_orderdate")).alias("day"))


@query(f"{ROWS} SELECT id, CASE WHEN id % 2 = 0 THEN strftime(billing_period_start, '%b %Y') ELSE billing_period END AS short, CASE WHEN id % 2 = 0 THEN strftime(billing_period_start, '%d %b') || ' – ' || strftime(last_day(billing_period_start), '%d %b %Y') ELSE billing_period END AS long FROM bills")
def display_periods(spark, sf_dir):
    p = F.col("billing_period")
    return from_orders(spark, sf_dir).select("id", display.period(p, short=True).alias("short"), display.period(p).alias("long"))
