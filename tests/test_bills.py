import datetime
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterlake.config import Settings
from meterlake.operators import align, dedupe, extract, layout, listing, providers, rollup, store, uploads, validate

BASE = {
    "id": 1, "consumer_name": "Hill Mills", "account_number": "0099", "billing_period": "2023-11-01 to 2023-11-30", "billing_period_start": datetime.date(2023, 11, 1), "billing_period_end": datetime.date(2023, 11, 30),
    "due_date": datetime.date(2023, 12, 15), "previous_reading": Decimal(100), "current_reading": Decimal(150), "units_consumed": Decimal(50), "net_amount_due": Decimal("410.00"), "multiplying_factor": None,
    "open_access_units": None, "previous_scale": 0, "current_scale": 0, "ocr_confidence": None,
}
SCHEMA = (
    "id long, consumer_name string, account_number string, billing_period string, billing_period_start date, billing_period_end date, due_date date, previous_reading decimal(20,6), current_reading decimal(20,6), "
    "units_consumed decimal(20,6), net_amount_due decimal(12,2), multiplying_factor decimal(20,6), open_access_units decimal(20,6), previous_scale int, current_scale int, ocr_confidence double"
)


def judge(spark, derive=False, **changes):
    df = spark.createDataFrame([tuple((BASE | changes).values())], SCHEMA)
    return validate.validate(validate.derive_units(df) if derive else df, as_of=F.lit("2023-12-01").cast("date")).first()


@pytest.mark.parametrize(
    ("changes", "status", "check"),
    [
        ({}, "VALID", True),
        ({"units_consumed": Decimal(70)}, "WARNING", False),
        ({"units_consumed": Decimal(51)}, "VALID", True),
        ({"units_consumed": Decimal(100), "multiplying_factor": Decimal(2)}, "VALID", True),
        ({"units_consumed": Decimal(50), "multiplying_factor": Decimal(2)}, "WARNING", False),
        ({"units_consumed": Decimal(1015), "multiplying_factor": Decimal(20)}, "VALID", True),  # readings without decimals times 20
        ({"units_consumed": Decimal(1015), "multiplying_factor": Decimal(20), "previous_scale": 1}, "WARNING", False),
        ({"units_consumed": Decimal(40), "open_access_units": Decimal(10)}, "VALID", True),
        ({"current_reading": Decimal(90)}, "INVALID", False),
        ({"net_amount_due": Decimal("-1.00")}, "INVALID", True),
        ({"account_number": "  "}, "WARNING", True),
        ({"previous_reading": None}, "WARNING", None),
        ({"ocr_confidence": 58.5}, "WARNING", True),
        ({"billing_period_end": datetime.date(2023, 10, 1)}, "INVALID", True),
        ({"due_date": datetime.date(2023, 11, 20)}, "WARNING", True),
        ({"due_date": datetime.date(2026, 1, 1)}, "WARNING", True),
    ],
)
def test_rules(spark, changes, status, check):
    row = judge(spark, **changes)
    assert (row.validation_status, row.meter_reading_check) == (status, check)


def test_messages(spark):
    assert "58%" in judge(spark, ocr_confidence=58.5).warnings[0]  # half to even
    row = judge(spark, current_reading=Decimal("90.5"), current_scale=2)
    assert row.errors == ["Current reading (90.50) is lower than previous reading (100)"] and row.calculation is None
    row = judge(spark, units_consumed=Decimal(100), multiplying_factor=Decimal(2))
    assert row.calculation == "(150 - 100) x 2 = 100" and row.notes == ["Units include the meter multiplying factor 2"]
    assert judge(spark, units_consumed=Decimal(70)).field_checks[6].status == "mismatch"


def test_nothing_found(spark):
    nothing = dict.fromkeys([k for k in BASE if k not in ("id", "previous_scale", "current_scale")])
    row = judge(spark, **nothing)
    assert row.validation_status == "INVALID" and len(row.missing_fields) == 8 and row.errors[-1].startswith("No bill fields")


def test_derived_units(spark):
    row = judge(spark, derive=True, units_consumed=None, previous_reading=Decimal("1.0005"), current_reading=Decimal("2"))
    assert row.units_consumed == Decimal("1.000000")  # 0.9995, half to even at three decimals
    assert row.meter_reading_check is None and any("without a multiplying factor" in w for w in row.warnings)
    assert judge(spark, derive=True, units_consumed=None, current_reading=Decimal(1)).units_consumed is None


def texts(spark, *docs):
    found = extract.extract(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    return [r.asDict() for r in found.orderBy("doc_id").collect()]


def test_extraction(spark):
    pairs, turned, empty, none, bank = texts(
        spark,
        "Consumer Name: Asha Rani      Consumer No.: 0071\nAccount / Consumer No.: 00712233   Due Date:\n15-12-2023\nPrevious/Current Reading: 9\nBill Month  202311  202310  202309",
        "Reading type    Previous    Present\nDate    01-10-2023    01-11-2023\nReading    700    950",
        "",
        None,
        "Bank of Hills RTGS\nAccount No.: 123456789",
    )
    assert pairs["account_number"] == "0071" and pairs["consumer_name"] == "Asha Rani" and pairs["due_date"] == datetime.date(2023, 12, 15)
    assert pairs["previous_reading"] is None and pairs["billing_period"] is None
    assert (turned["previous_reading"], turned["current_reading"]) == (700, 950) and turned["sources"]["current_reading"] == "table:Present"
    assert empty["sources"] == none["sources"] == {} and bank["account_number"] is None


def test_alignment():
    heads = [(0, 8), (20, 28), (40, 48)]
    assert align.assign([(4, 8), (24, 28), (44, 48)], heads) == [0, 1, 2]
    assert align.assign([(4, 8), (46, 50)], heads) == [0, -1, 1]
    assert align.assign([(200, 210)], heads) == [-1, -1, -1]
    assert align.assign([], heads) == [-1, -1, -1] and align.assign([(0, 1)], []) == []


def test_providers(spark):
    docs = spark.createDataFrame(
        [
            (1, "Assam Power Distribution\nKWH(Day)  Q1  1.000  100.000  0  160.000  0  60.000\nKWH(Night)  Q1  1.000  200.000  0  230,000  0  30.000\nUnit Consumed\nDay  40.000\nNight\n20.000"),
            (2, "Assam Power Distribution\nKWH(Day)  Q1  1.000  100.000  0  160.000  0  61.000"),
            (3, "GESCOM\nR.R. No: HT 1S\nfor the Month of : Dec 2023\nLast Date of Payment: 46th Jan\nSay Rs. 500"),
        ],
        "doc_id long, text string",
    )
    one, two, three = providers.override(extract.extract(docs), docs).orderBy("doc_id").collect()
    assert (one.previous_reading, one.current_reading, one.units_consumed) == (300, 390, 60) and one.parser_name == "apdcl"
    assert two.previous_reading is None and "don't add up" in two.notes[0]
    assert (three.account_number, three.due_date, three.net_amount_due) == ("HT 15", datetime.date(2024, 1, 16), 500) and len(three.notes) == 2


def test_provider_marks_end_at_ascii_words(spark):
    texts = ["Rr noñgagaó\nBESCOM", "R.R. No 7 BESCOM", "R.R. Note BESCOM", "R.R. No_ BESCOM", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", providers.detect(F.col("t")).alias("p")).orderBy("i")
    assert [r.p for r in df.collect()] == ["karnataka_escom", "karnataka_escom", "generic", "generic", "generic"]


def test_providers_of_documents_without_text(spark, tmp_path):
    from meterlake.plans import QUERIES

    spark.createDataFrame([(5, None), (8, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.provider for r in QUERIES["provider_detect"](spark, str(tmp_path)).collect()} == {5: "apdcl", 8: "generic"}


@pytest.mark.parametrize(("name", "most"), [("karnataka_main_meter", 0), ("text_roundtrip", 2), ("whole_parse", 0), ("zone_units_sum", 1), ("tod_register_sum", 1), ("rajasthan_columns", 0), ("text_to_status", 2), ("field_source_counts", 2)])
def test_documents_are_read_without_a_shuffle(spark, name, most):
    """What is left are the exchanges of the tables that the texts are made of, and of groups."""
    from meterlake.plans import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= most


@pytest.fixture(scope="module")
def one_row_group(tmp_path_factory):
    """Tables whose orders are in one row group, which only one task of a scan can read."""
    import pyarrow.parquet as pq

    out = tmp_path_factory.mktemp("large")
    for name, n in (("orders", 3), ("customer", 1)):
        table = pq.read_table(f"/root/testdata/sf0.01/{name}.parquet")
        pq.write_table(pa.concat_tables([table] * n).combine_chunks(), out / f"{name}.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["field_source_counts", "text_to_status", "rajasthan_columns"])
def test_orders_of_one_row_group_are_read_by_several_tasks(spark, one_row_group, name):
    from meterlake.plans import QUERIES

    plan = QUERIES[name](spark, one_row_group)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan.split("MapInArrow")[-1]
    assert "REPARTITION_BY_NUM" not in QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()


def test_documents_that_share_an_id_keep_their_own_values(spark):
    docs = spark.createDataFrame([(1, "Consumer No.: 00712233\nDue Date: 15-12-2023"), (1, "GESCOM\nR.R. No: HT 1S"), (None, "Account No.: 00712244")], "doc_id long, text string")
    found = {(r.doc_id, r.account_number, str(r.due_date)) for r in extract.extract(docs).collect()}
    assert found == {(1, "00712233", "2023-12-15"), (1, None, "None"), (None, "00712244", "None")}
    assert sorted(str(r.account_number) for r in providers.parse(docs).collect()) == ["00712233", "00712244", "HT 15"]


def test_lines_that_differ_in_digits_only_are_told_apart(spark):
    head = "Account No.   Units   Due Date\n"
    rows = [head + f"{k:08d}      {k}   {k % 28 + 1:02d}-01-2023" for k in range(4321, 4421)] + [head + "00004321      " + "9" * 400]
    found = {r.doc_id: r for r in extract.extract(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all((found[i].account_number, found[i].units_consumed, found[i].due_date.day) == (f"{k:08d}", k, k % 28 + 1) for i, k in enumerate(range(4321, 4421)))
    assert found[100].units_consumed is None


def test_lines_that_look_alike_are_searched_once(monkeypatch):
    """Where registers, meters' rows and account numbers stand is kept; only the values are read anew."""
    registers = lambda k: providers.read_apdcl(extract.to_lines(f"KWH(Day)  Q1  1.000  {k}.000  0  {k + 60}.000  0  60.000\nOpen Access Units Day  4.000\nUnit Consumed\nDay | {k}.000"))
    row = lambda k: providers.read_rajasthan(extract.to_lines(f"K No. : 0000000{k}\nQ1 KWH  {k + 60}  {k}  60  2  120"))
    registers(100), row(100)
    searched, compiled = [], providers.compiled
    monkeypatch.setattr(providers, "compiled", lambda pattern: searched.append(pattern) or compiled(pattern))
    for k in range(101, 200):
        one, two = registers(k), row(k)
        assert (one["previous_reading"], one["current_reading"], one["units_consumed"], one["open_access_units"]) == (k, k + 60, k, 4)
        assert (two["account_number"], two["previous_reading"], two["current_reading"], two["units_consumed"]) == (f"0000000{k}", k, k + 60, 120)
    assert not searched


def test_layout_does_not_depend_on_the_order_of_words(spark):
    words = [("Due", 0.0, 0.0, 15.0, 10.0), ("Date", 20.0, 1.0, 40.0, 11.0), ("5", 200.0, 0.4, 205.0, 10.4), ("Units", 0.0, 30.0, 25.0, 40.0), (" ", 1.0, 1.0, 2.0, 2.0)]
    for order in (words, words[::-1]):
        df = spark.createDataFrame([(1, 1, *w, 90.0) for w in order], "doc_id long, page int, text string, x0 double, y0 double, x1 double, y1 double, conf double")
        assert [r.text for r in layout.to_text(df).collect()] == ["Due Date" + " " * 32 + "5\nUnits"]


def test_uploads(spark):
    pdf = b"junk%PDF-1.4"
    cases = [("a.pdf", "application/pdf", pdf, 201, ""), ("a.exe", "", pdf, 415, "unsupported_file_type"), ("a.pdf", "", b"", 400, "empty_file"), ("a.pdf", "", b"%PDF-" * 40, 413, "file_too_large"), ("a.pdf", "image/png", pdf, 415, "unsupported_file_type"), ("a.png", "", pdf, 400, "invalid_upload"), ("a.jpg", None, b"hello", 415, "unsupported_file_type")]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, filename string, content_type string, content binary")
    rows = uploads.check(df, Settings(max_upload_bytes=100)).orderBy("i").collect()
    assert [(r.http_status, r.error_code or "") for r in rows] == [c[3:] for c in cases]


def test_store_and_duplicates(spark):
    events = spark.createDataFrame([(1, "CREATE", 7, 1.0), (2, "REPLACE", 7, 2.0), (3, "CREATE", 8, 5.0), (4, "DELETE", 8, None)], "seq long, kind string, id long, amount double")
    assert [(r.id, r.amount) for r in store.current(events).collect()] == [(7, 2.0)]
    files = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id long, file_hash string")
    assert sorted(r.id for r in dedupe.new_files(files, files.filter("id = 3"), "id").collect()) == [1, 4, 5]
    bills = spark.createDataFrame([(1, "x", "p"), (2, "x", "p"), (3, "x", "p"), (4, "", "p"), (5, None, "p")], "id long, account_number string, billing_period string")
    assert {r.id: r.possible_duplicate_of for r in dedupe.possible_duplicates(bills).collect()} == {1: [], 2: [1], 3: [1, 2], 4: [], 5: []}


def test_listing_checks_its_arguments(spark):
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            listing.page(spark.range(1), **bad)


def test_documents(spark):
    pages = spark.createDataFrame([(1, 2, "b", "ocr", 81.0), (1, 1, "a", "text", None), (2, 1, "c", "text", None)], "doc_id long, page int, text string, method string, confidence double")
    one, two = rollup.documents(pages).orderBy("doc_id").collect()
    assert one.text == "----- Page 1 -----\na\n\n----- Page 2 -----\nb" and one.extraction_method == "mixed" and one.ocr_confidence == 81.0
    assert two.text == "c" and two.ocr_confidence is None and two.page_count == 1
