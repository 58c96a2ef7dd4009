import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from meterlake.functions import core, dates, display, ids, numbers, text


def table(spark, f, cases):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    assert [r.r for r in rows] == [c[1] for c in cases]


def test_numbers(spark):
    cases = [("7,412", 7412), ("318.25 kWh", Decimal("318.25")), ("4O81", 4081), ("5S00", 5500), ("9,8,7", None), ("44.", 44), ("-17", -17), ("12,34,567.5", Decimal("1234567.5")), ("", None), (None, None), ("meter", None), ("Bill", None)]
    table(spark, lambda v: numbers.parse_number(v)["value"], [(a, None if b is None else Decimal(b)) for a, b in cases])


def test_printed_decimals_are_kept(spark):
    table(spark, lambda v: numbers.parse_number(v)["scale"], [("10.500", 3), ("10", 0), ("1,000.5", 1)])


def test_amounts(spark):
    cases = [("Rs. 812.50", "812.50"), ("₹3,100", "3100.00"), ("= 77.10", "77.10"), ("= Rs. 5", "5.00"), ("9.125", None), ("R 4,18,020.00", "418020.00"), ("X99", None), ("-40", "-40.00"), (None, None)]
    table(spark, numbers.parse_amount, [(a, None if b is None else Decimal(b)) for a, b in cases])


def test_dates(spark):
    d = datetime.date
    cases = [("2023-11-05", d(2023, 11, 5)), ("05/11/23", d(2023, 11, 5)), ("5th Nov, 2023", d(2023, 11, 5)), ("November 5, 2023", d(2023, 11, 5)), ("O5-1l-2023", d(2023, 11, 5)), ("30-02-2023", None), ("31-02-2023 or 01-03-2023", d(2023, 3, 1)), ("05-11-1980", None), ("", None), (None, None)]
    table(spark, dates.parse_date, cases)


def test_periods(spark):
    cases = [("05-11-2023 to 04-12-2023", "2023-11-05 to 2023-12-04"), ("5 Nov 2023 - 4 Dec 2023", "2023-11-05 to 2023-12-04"), ("NOV-2023", "November 2023"), ("11/2023", "November 2023"), ("202311", "November 2023"), ("04-12-2023 to 05-11-2023", None), ("soon", None)]
    table(spark, lambda v: dates.parse_billing_period(v)["display"], cases)


def test_accounts(spark):
    table(spark, ids.parse_account_number, [("0012345", "0012345"), ("1200 3400 56", "1200340056"), ("ht/x/552190", "HT/X/552190"), ("12B45", "12845"), ("abc", None), ("123", None), (" ", None), (None, None)])


def test_names(spark):
    table(spark, ids.parse_name, [("asha rani", "ASHA RANI"), ("M/S Hill Mills Ltd.", "M/S Hill Mills Ltd"), ("Name of", None), ("Mob No 5", None), ("Q", None), (None, None)])
    table(spark, ids.parse_unlabelled_name, [("Tariff Category", None), ("Hill Mills", "Hill Mills"), ("M/S Meter Works", "M/S Meter Works")])


def test_rr_numbers(spark):
    table(spark, ids.parse_rr_number, [("EHTS", "EHT 5"), ("lt 4S1", "LT 451"), ("ab 77", "AB 77"), ("98765", "98765"), ("? ?", None)])


def test_text(spark):
    table(spark, text.normalize_text, [("a — b  \r\n\n\n\nc\td|", "a - b\n\nc    d"), ("\n\nﬁne\n", "fine"), ("", ""), (None, "")])
    table(spark, text.display_name, [("C:\\x\\bill.PDF", "bill.PDF"), ("../a/b.png", "b.png"), ("", "upload"), (None, "upload")])
    table(spark, text.extension, [("bill.PDF", ".pdf"), ("bill", ""), (".pdf", ""), ("a.b.png", ".png")])


def test_cells(spark):
    table(spark, lambda v: F.transform(core.cells(v), lambda c: F.concat_ws(":", c["start"], c["end"], c["text"])), [("Due Date   5 May    7", ["0:8:Due Date", "11:16:5 May", "20:21:7"]), ("", []), ("x x  x x", ["0:3:x x", "5:8:x x"])])


def test_plain_numbers(spark):
    table(spark, lambda v: numbers.plain_number(v.cast("decimal(20,6)")), [("10.500", "10.5"), ("100", "100"), ("0", "0"), ("-2.25", "-2.25")])


@pytest.mark.parametrize("kind", ["number", "amount", "date", "account", "name"])
def test_values_that_were_cut_are_never_guessed(spark, kind):
    f = {"number": lambda v: numbers.parse_number(v)["value"], "amount": numbers.parse_amount, "date": dates.parse_date, "account": ids.parse_account_number, "name": ids.parse_name}[kind]
    table(spark, f, [("", None), ("   ", None), ("-", None), ("?", None), ("::", None)])


ODD = [
    "", " ", None, "7,412", "4O81", "5S00", "9,8,7", "44.", "-17", "+.5", "1234567890123456", "99999999999999.9999999", "Rs. 812.50", "₹3,100", "= Rs. 5", "9.125", "R 4,18,020.00", "-40", "INR - 5", "12345678901.5", "2023-11-05", "05/11/23", "5th Nov, 2023",
    "November 5, 2023", "O5-1l-2023", "31-02-2023 or 01-03-2023", "05-11-1980", "05-11-2023 to 04-12-2023", "5 Nov 2023 - 4 Dec 2023", "NOV-2023", "13/2023", "202311", "11/0099", "1200 3400 56", "ht/x/552190", "12B45", "abc", "asha rani", "M/S Hill Mills Ltd.", "Mob No 5", "Tariff Category",
    "Name of", "EHTS", "lt 4S1", "ab 77", "?", "a\u2003b 12", "x\u00857", "\u0663\u0664", "a — b  \r\n\n\n\nc\td|", "ﬁne \u200b\n\n", "Ärger & Söhne",
]


def test_plain_parsers_agree_with_the_column_functions(spark):
    from meterlake.functions import plain

    period = lambda p: p and (p["display"], p["start"], p["end"])
    number = lambda n: n and (n["value"], n["scale"])
    same = lambda x: x
    pairs = [
        (numbers.parse_number, plain.parse_number, number), (numbers.parse_amount, plain.parse_amount, same), (dates.parse_date, plain.parse_date, same), (dates.parse_billing_period, plain.parse_billing_period, period), (ids.parse_account_number, plain.parse_account_number, same),
        (ids.parse_name, plain.parse_name, same), (ids.parse_unlabelled_name, plain.parse_unlabelled_name, same), (ids.parse_rr_number, plain.parse_rr_number, same), (text.normalize_text, plain.normalize_text, same), (core.cells, plain.cells, lambda c: c and [tuple(x) for x in c]),
    ]
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, v string").select("i", *[f(F.col("v")).alias(str(k)) for k, (f, _, _) in enumerate(pairs)]).orderBy("i").collect()
    for k, (f, twin, read) in enumerate(pairs):
        cases = [(v, read(r[str(k)])) for v, r in zip(ODD, rows) if v is not None or f is not core.cells]
        assert [(v, twin(v)) for v, _ in cases] == cases


def test_display(spark):
    grouped = lambda v: display.indian_grouping(v.cast("decimal(20,6)"))
    table(spark, grouped, [("1234567.5", "12,34,567.5"), ("999", "999"), ("1000", "1,000"), ("-100000.125", "-1,00,000.125"), (None, None)])
    table(spark, lambda v: display.rupees(v.cast("decimal(20,6)")), [("1234567.5", "₹12,34,567.50"), ("7", "₹7.00")])
    table(spark, display.period, [("2023-11-01 to 2023-11-30", "01 Nov – 30 Nov 2023"), ("2022-12-15 to 2023-01-14", "15 Dec 2022 – 14 Jan 2023"), ("May 2023", "May 2023"), (None, None)])
    table(spark, lambda v: display.file_size(v.cast("bigint")), [("10", "1 KB"), ("2048", "2 KB"), ("3145728", "3.0 MB")])
    table(spark, display.source, [("key_value:Due Date", "Label “Due Date”"), ("table:MF", "Table “MF”"), ("derived:x", "Calculated"), ("inferred:y", "Inferred"), ("apdcl:MF column", "Apdcl · MF column")])
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    table(spark, lambda v: display.ago(v.cast("timestamp"), now), [("2024-01-10 11:59:30", "just now"), ("2024-01-10 11:30:00", "30 min ago"), ("2024-01-10 09:00:00", "3 h ago"), ("2024-01-08 12:00:00", "2 d ago"), ("2023-12-01 00:00:00", "01 Dec 2023")])


def test_readers_are_plug_ins(spark):
    from meterlake.sources import pages

    files = spark.createDataFrame([(1, "pdf", b"x")], "doc_id long, file_type string, content binary")
    with pytest.raises(NotImplementedError):
        pages.words(files, "pdf")
    pages.register("test", lambda batches: (b.assign(page=1, text="w", x0=0.0, y0=0.0, x1=1.0, y1=1.0, conf=-1.0)[["doc_id", "page", "text", "x0", "y0", "x1", "y1", "conf"]] for b in batches))
    assert pages.words(files, "test").first().text == "w"
