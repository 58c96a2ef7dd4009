"""Bills as the text that a bill would print: key/value lines, a table, or a transposed table, by the key modulo 3."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _line(*parts: tuple[str, Column]) -> Column:
    """ "Label: value" parts with a column gap; those without a value are left out."""
    return F.concat_ws("    ", *[F.when(v.isNotNull(), F.concat(F.lit(f"{name}: "), v)) for name, v in parts])


def _row(*values: Column) -> Column:
    return F.concat(*[F.rpad(F.coalesce(v, F.lit("")), 26, " ") for v in values])


def render(bills: DataFrame) -> DataFrame:
    """doc_id and text of each bill."""
    printed = lambda c: F.when(F.col("previous_scale") == 3, F.col(c).cast("decimal(20,3)").cast("string")).otherwise(F.col(c).cast("bigint").cast("string"))
    name, account = F.col("consumer_name"), F.when(F.trim("account_number") != "", F.col("account_number"))
    previous, current, units = printed("previous_reading"), printed("current_reading"), F.col("units_consumed").cast("decimal(20,3)").cast("string")
    amount, due = F.format_number("net_amount_due", 2), F.date_format("due_date", "dd-MM-yyyy")
    factor = F.col("multiplying_factor").cast("bigint").cast("string")
    title = F.lit("STATE POWER UTILITY\nElectricity Bill\n")
    lines = F.concat_ws(
        "\n", title, _line(("Consumer Name", name), ("Consumer No.", account)), _line(("Billing Period", F.col("billing_period")), ("Due Date", due)),
        _line(("Previous Reading", previous), ("Current Reading", current)), _line(("Units Consumed", units), ("Net Amount Due", F.concat(F.lit("Rs. "), amount))), _line(("Multiplying Factor", factor)),
    )
    head = lambda *names: _row(*map(F.lit, names))
    table = F.concat_ws(
        "\n", title, _line(("Consumer Name", name)), head("Account No.", "Bill Period", "Due Date"), _row(account, F.col("billing_period"), due), F.lit(""),
        head("Previous Reading", "Current Reading", "Units Consumed", "Multiplier"), _row(previous, current, units, factor), F.lit(""), _line(("Amount Payable", amount)),
    )
    turned = F.concat_ws(
        "\n", title, _line(("Name of Consumer", name), ("K No.", account)), _line(("Bill Cycle", F.col("billing_period")), ("Last Date of Payment", due)), _row(F.lit(""), F.lit("Previous"), F.lit("Present")),
        _row(F.lit("Date"), F.lit("01-01-2001"), F.lit("02-02-2001")), _row(F.lit("Reading"), previous, current), F.lit(""), _line(("Total Units", units), ("Meter Multiplier", factor)), _line(("Bill Amount", amount)),
    )
    k = F.pmod("id", F.lit(3))
    return bills.select(F.col("id").alias("doc_id"), F.when(k == 0, lines).when(k == 1, table).otherwise(turned).alias("text"))


def time_of_day(lineitems: DataFrame) -> DataFrame:
    """Orders as bills with one register for each line item; every ninth order has one that doesn't add up."""
    k = F.col("l_orderkey")
    number = lambda c: F.coalesce(c.cast("double").cast("decimal(20,3)").cast("string"), F.lit("null"))
    zone = lambda x: F.concat(F.lit("Z"), F.chr(F.lit(64) + x["n"]))
    wrong = lambda x: F.when((F.pmod(F.col("doc_id"), F.lit(9)) == 0) & (x["n"] == 1), 1.0).otherwise(0.0)
    row = lambda x: F.concat(F.lit("KWH("), zone(x), F.lit(")    Q1    1.000    "), number(x["p"]), F.lit("    0    "), number(x["p"] + x["q"]), F.lit("    0    "), number(x["q"] + wrong(x)))
    access = lambda x: F.concat(F.lit("Open Access Units "), zone(x), F.lit("    "), number(x["n"]))
    units = lambda x: F.concat(zone(x), F.lit(" | "), number(x["q"] * 2))
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q")).alias("item")
    spread = int(lineitems.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # texts are far larger than items: as many tasks read them as there may be
    items = lineitems.select(k.alias("doc_id"), item).repartition(spread, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    part = lambda f: F.array_join(F.transform("items", f), "\n")
    return items.select("doc_id", F.concat_ws("\n", F.lit("Assam Power Distribution Company"), part(row), part(access), F.lit("Unit Consumed"), part(units)).alias("text"))
