"""The bills store as a log of events: appended in batches, read as the latest event of each id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current(events: DataFrame) -> DataFrame:
    """The state after all events (seq, kind CREATE / REPLACE / DELETE, id, ...): an id's last event, unless a delete."""
    values = [c for c in events.columns if c != "id"]
    last = events.groupBy("id").agg(F.max_by(F.struct(*values), "seq").alias("e"))
    return last.filter("e.kind <> 'DELETE'").select("id", *[F.col(f"e.{c}").alias(c) for c in values])


def admit(bills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bills to store, and INVALID ones, which are returned to the caller but never stored."""
    bad = F.col("validation_status") == "INVALID"
    return bills.filter(~bad), bills.filter(bad)


def upgrade(bills: DataFrame, schema: DataFrame) -> DataFrame:
    """Rows written before a column existed, with nulls in it, in the order of today's columns."""
    return schema.limit(0).unionByName(bills, allowMissingColumns=True)


def append(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)
