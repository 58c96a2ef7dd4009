"""Where bills come from: the store's Parquet, files, known values, or, for tests and benchmarks, other tables made into bills."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BILLS, TRUTH


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BILLS).parquet(path)


def over_jdbc(spark: SparkSession, url: str, table: str = "bills", **options: str) -> DataFrame:
    """Bills in a database; the driver's jar is the deployment's."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def files(spark: SparkSession, folder: str, largest: int, pattern: str = "*.{pdf,png,jpg,jpeg}") -> DataFrame:
    """Files of a folder and those below it; larger ones are dropped before their content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.filter(F.col("length") <= largest)


def listed(found: DataFrame) -> DataFrame:
    """Paths of files in their order, without their content."""
    return found.select("path", "length").orderBy("path")


def stored_files(bills: DataFrame, found: DataFrame, name: str = "stored_filename") -> DataFrame:
    """Bills with the ``path`` of their file and a ``file_status``: stored, missing (no such file any more), or refused (a
    name that would lead out of the folder). ``found`` has the paths of the folder's files; of equal names the first path counts.

    The join is by name, which is unique among bills and files: no hot key. Null names are refused.
    """
    own = found.withColumn("_name", F.element_at(F.split("path", "/"), -1)).groupBy("_name").agg(F.min("path").alias("path"))
    safe = F.coalesce(~F.col(name).rlike(r"[/\\\x00]") & ~F.col(name).isin("", ".", ".."), F.lit(False))
    rows = bills.withColumn("_name", F.when(safe, F.col(name))).join(own, "_name", "left")
    return rows.withColumn("file_status", F.when(F.col("_name").isNull(), "refused").when(F.col("path").isNull(), "missing").otherwise("stored")).drop("_name")


def stem(path: str) -> F.Column:
    """A path's last part without its suffixes: what a document and its known values have in common."""
    return F.regexp_extract(F.col(path), r"([^/\\.]+)(?:\.[^/\\]*)?$", 1)


def known_values(spark: SparkSession, folder: str) -> DataFrame:
    """One row per JSON file of known values, with the stem of its path."""
    found = spark.read.schema(TRUTH).option("multiLine", "true").option("pathGlobFilter", "*.expected.json").json(folder)
    return found.withColumn("stem", stem("_metadata.file_path"))


#: Rows that one task makes texts of and reads; more are dealt out.
LARGEST_TASK = 40_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A stored table's rows, of which many small ones may be in one file or row group, dealt over tasks of at most about
    ``LARGEST_TASK`` rows where the scan's own are larger. The numbers come from the files' footers."""
    by_task = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    return rows.repartition(math.ceil(sum(by_task) / LARGEST_TASK), key) if max(by_task, default=0) > LARGEST_TASK else rows


def from_orders(spark: SparkSession, sf_dir: str, for_texts: bool = False) -> DataFrame:
    """Orders as bills, a function of their columns alone: readings by arithmetic on the keys, every rule broken by some.

    For texts the orders are spread, as a text takes far longer to read than its order. The key modulo 10 says what is wrong with the readings: 0 units that don't add up, 1 readings the wrong way round, 2 a
    negative amount, 3 no units, 4 no previous reading; the key modulo 50 may clear the name or the account.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders, customers = read("orders"), read("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    orders = spread(orders, "o_orderkey") if for_texts else orders
    df = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    part = lambda n: F.pmod(k, F.lit(n))
    decimals = F.when(part(3) == 0, F.lit("0.125")).otherwise(F.lit("0")).cast("decimal(20,6)")
    factor = F.when(part(4) == 1, 1).when(part(4) == 2, 2).when(part(4) == 3, 20).cast("decimal(20,6)")
    used = F.pmod(F.col("o_custkey"), F.lit(500)).cast("decimal(20,6)")
    previous = (F.pmod(k, F.lit(9000)) + 100).cast("decimal(20,6)") + decimals
    current = F.when(part(10) == 1, previous - 5).otherwise(previous + used)
    units = used * F.coalesce(factor, F.lit(1).cast("decimal(20,6)"))
    day_range = part(2) == 0
    month_start, month_end = F.trunc(day, "month"), F.last_day(day)
    suffix = F.element_at(F.array(*map(F.lit, (".pdf", "_50%.png", ".jpg", ".pdf"))), (part(4) + 1).cast("int"))
    return df.select(
        k.alias("id"),
        F.concat(F.lit("bill_"), k.cast("string"), suffix).alias("original_filename"),
        F.sha2(F.concat_ws("|", F.pmod(k, F.lit(7000)).cast("string"), F.lit("file")).cast("binary"), 256).alias("file_hash"),
        F.when(part(50) != 7, F.concat(F.initcap("c_mktsegment"), F.lit(" Works Plant "), F.chr(F.lit(65) + F.pmod("c_nationkey", F.lit(26))), F.lit(" Ltd"))).alias("consumer_name"),
        F.when(part(50) == 8, "  ").otherwise(F.lpad(F.col("o_custkey").cast("string"), 10, "0")).alias("account_number"),
        F.when(day_range, F.concat(month_start.cast("string"), F.lit(" to "), month_end.cast("string"))).otherwise(F.date_format(day, "MMMM yyyy")).alias("billing_period"),
        F.when(day_range, month_start).alias("billing_period_start"),
        F.when(day_range, F.when(part(40) == 6, F.date_sub(month_start, 3)).otherwise(month_end)).alias("billing_period_end"),
        F.date_add(day, 15).alias("due_date"),
        F.when(part(10) != 4, previous).alias("previous_reading"),
        current.cast("decimal(20,6)").alias("current_reading"),
        F.when(part(10) == 0, units + 50).when(part(10) != 3, units).cast("decimal(20,6)").alias("units_consumed"),
        F.when(part(10) == 2, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).cast("decimal(12,2)").alias("net_amount_due"),
        factor.alias("multiplying_factor"),
        F.when(part(5) == 0, F.lit("0.000000")).cast("decimal(20,6)").alias("open_access_units"),
        F.when(part(3) == 0, 3).otherwise(0).alias("previous_scale"),
        F.when(part(3) == 0, 3).otherwise(0).alias("current_scale"),
        F.when(part(6) == 0, (part(100)).cast("double") + F.lit(0.25)).alias("ocr_confidence"),
        F.when(part(6) == 0, "ocr").otherwise("text").alias("extraction_method"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


#: The same bills in DuckDB's SQL.
FROM_ORDERS_SQL = """
raw AS (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS day, o_orderdate, o_totalprice, c_mktsegment, c_nationkey,
         CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0.125 ELSE 0 END AS DECIMAL(20,6)) AS dec,
         CAST(CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 20 END AS DECIMAL(20,6)) AS mf,
         CAST(o_custkey % 500 AS DECIMAL(20,6)) AS used
  FROM orders JOIN customer ON o_custkey = c_custkey
),
bills AS (
  SELECT k AS id, 'bill_' || k || (CASE k % 4 WHEN 1 THEN '_50%.png' WHEN 2 THEN '.jpg' ELSE '.pdf' END) AS original_filename,
         sha256((k % 7000) || '|file') AS file_hash,
         CASE WHEN k % 50 <> 7 THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Works Plant ' || chr(CAST(65 + c_nationkey % 26 AS INT)) || ' Ltd' END AS consumer_name,
         CASE WHEN k % 50 = 8 THEN '  ' ELSE lpad(CAST(c AS VARCHAR), 10, '0') END AS account_number,
         CASE WHEN k % 2 = 0 THEN CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) || ' to ' || CAST(last_day(day) AS VARCHAR) ELSE strftime(day, '%B %Y') END AS billing_period,
         CASE WHEN k % 2 = 0 THEN CAST(date_trunc('month', day) AS DATE) END AS billing_period_start,
         CASE WHEN k % 2 = 0 THEN CASE WHEN k % 40 = 6 THEN CAST(date_trunc('month', day) - INTERVAL 3 DAY AS DATE) ELSE last_day(day) END END AS billing_period_end,
         day + 15 AS due_date,
         CASE WHEN k % 10 <> 4 THEN CAST(k % 9000 + 100 AS DECIMAL(20,6)) + dec END AS previous_reading,
         CASE WHEN k % 10 = 1 THEN CAST(k % 9000 + 95 AS DECIMAL(20,6)) + dec ELSE CAST(k % 9000 + 100 AS DECIMAL(20,6)) + dec + used END AS current_reading,
         CAST(CASE WHEN k % 10 = 0 THEN used * coalesce(mf, 1) + 50 WHEN k % 10 <> 3 THEN used * coalesce(mf, 1) END AS DECIMAL(20,6)) AS units_consumed,
         CAST(CASE WHEN k % 10 = 2 THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(12,2)) AS net_amount_due,
         mf AS multiplying_factor, CASE WHEN k % 3 = 0 THEN 3 ELSE 0 END AS scale,
         CASE WHEN k % 6 = 0 THEN k % 100 + 0.25 END AS ocr_confidence, CASE WHEN k % 6 = 0 THEN 'ocr' ELSE 'text' END AS extraction_method,
         CAST(o_orderdate AS TIMESTAMP) AS created_at
  FROM raw
),
judged AS (
  SELECT *, greatest(1.0, coalesce(multiplying_factor, 1) * CASE WHEN scale = 3 THEN 0.001 ELSE 1 END) AS tolerance,
         current_reading < previous_reading AS reversed, (current_reading - previous_reading) * coalesce(multiplying_factor, 1) AS product,
         (CASE WHEN consumer_name IS NULL THEN 1 ELSE 0 END + CASE WHEN trim(account_number) = '' THEN 1 ELSE 0 END
          + CASE WHEN previous_reading IS NULL THEN 1 ELSE 0 END + CASE WHEN units_consumed IS NULL THEN 1 ELSE 0 END) AS n_missing
  FROM bills
)
"""
