"""Exact duplicates by the file's hash, and bills that share account and period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("file_hash", F.sha2(F.col(content).cast("binary"), 256))


def first_of_each(files: DataFrame, order: str) -> DataFrame:
    """The first file of each hash in a batch. Combined before the shuffle: copies of one file are no hot key."""
    first = files.groupBy("file_hash").agg(F.min(order).alias(order))
    return files.join(first, ["file_hash", order], "left_semi")


def new_files(files: DataFrame, store: DataFrame, order: str) -> DataFrame:
    """Files that neither the store nor an earlier row of the batch has. A null hash never conflicts."""
    known = files.filter(F.col("file_hash").isNotNull())
    fresh = known.join(store.select("file_hash"), "file_hash", "left_anti")
    return first_of_each(fresh, order).unionByName(files.filter(F.col("file_hash").isNull()))


def conflicts(files: DataFrame, store: DataFrame) -> DataFrame:
    """Files that the store has, with the least id of the stored bills: one row per file, however many copies are stored."""
    first = store.filter(F.col("file_hash").isNotNull()).groupBy("file_hash").agg(F.min("id").alias("existing_id"))
    return files.join(first, "file_hash")


def possible_duplicates(bills: DataFrame) -> DataFrame:
    """Add ``possible_duplicate_of``: earlier ids with the same account and period, in order. Blank keys match nothing."""
    keyed = (F.col("account_number") != "") & (F.col("billing_period") != "")
    w = W.partitionBy("account_number", "billing_period").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    with_key = bills.filter(keyed).withColumn("possible_duplicate_of", F.collect_list("id").over(w))
    return with_key.unionByName(bills.filter(~F.coalesce(keyed, F.lit(False))).withColumn("possible_duplicate_of", F.array().cast("array<bigint>")))


def against_store(new: DataFrame, store: DataFrame) -> DataFrame:
    """``possible_duplicate_of`` of new bills among stored ones, without the bill that is being replaced."""
    other = store.select(F.col("id").alias("_other"), "account_number", "billing_period").filter("account_number <> '' and billing_period <> ''")
    pairs = new.select("id", "account_number", "billing_period").join(other, ["account_number", "billing_period"]).filter("id <> _other")
    found = pairs.groupBy("id").agg(F.array_sort(F.collect_list("_other")).alias("possible_duplicate_of"))
    return new.join(found, "id", "left").withColumn("possible_duplicate_of", F.coalesce("possible_duplicate_of", F.array().cast("array<bigint>")))


def flag(bills: DataFrame) -> DataFrame:
    """Duplicates need a review: a warning, and WARNING instead of VALID."""
    some = F.size("possible_duplicate_of") > 0
    names = F.array_join(F.transform("possible_duplicate_of", lambda i: F.concat(F.lit("#"), i.cast("string"))), ", ")
    text = F.concat(F.lit("Possible duplicate of bill "), names, F.lit(": same account number and billing period"))
    return bills.withColumns(
        {
            "warnings": F.when(some, F.concat("warnings", F.array(text))).otherwise(F.col("warnings")),
            "validation_status": F.when(some & (F.col("validation_status") == "VALID"), "WARNING").otherwise(F.col("validation_status")),
        }
    )
