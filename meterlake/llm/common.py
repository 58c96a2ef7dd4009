"""Helpers shared by the operators of this subpackage: staging tables and input columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs in one process (a ``local`` master, as in tests) a temporary folder is made and
    kept in the session's settings under a name of our own. On a cluster its absence is an error: files in a machine's own
    folder would be lost to the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("meterlake.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="meterlake-")
        spark.conf.set("meterlake.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/meterlake/{uuid.uuid4().hex}/{name}"


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stage(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the written table.

    This cuts lineage: a lost executor costs the running tasks, never the finished stages. ``batch_rows`` bounds the rows
    that Spark hands to Python at a time while this is written, for rows that may be large.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(BATCH)
    if batch_rows:
        spark.conf.set(BATCH, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_ids(docs: DataFrame, ids: DataFrame, doc_id: str) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids`` (one column), null among them, whatever the names of their columns."""
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"))
    ids = ids.toDF("kept").distinct()
    return rows.join(ids, F.col("id").eqNullSafe(F.col("kept")), "left_semi").select("row.*")


MOST_HOT, GROUP_A_TASK = 50_000, 1_000_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, copies: str) -> DataFrame:
    """Inner join of ``rows`` with their group's row, when a few groups may have a large part of all rows.

    ``groups`` has one row per key, with the number of its rows in ``copies``. Groups with more than a thousandth of all
    rows, or more than ``GROUP_A_TASK`` of them, are broadcast: the bound is raised so that these are fewer than
    ``MOST_HOT``. All others are joined by sort-merge, so that no task gets a large group's rows.
    """
    total = groups.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]
    large = F.col(copies) > F.lit(max(16, min(total // 1000, GROUP_A_TASK), total // MOST_HOT))
    hot, rest = groups.filter(large), groups.filter(~large)
    marked = F.broadcast(hot.select(key))
    by_map = rows.join(F.broadcast(hot), key)
    return rows.join(marked, key, "left_anti").join(rest.hint("merge"), key).unionByName(by_map)


def first_by_hash(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, the first in the order of a hash of their key.

    Rows far behind in that order are dropped beforehand by their hash alone, so that all tasks together pass on about 2n
    rows, however many tasks and rows there are.
    """
    place = F.shiftrightunsigned(F.xxhash64(key), 11)
    share = min(1.0, (2 * n + 1000) / max(1, rows.count()))
    return rows.filter(place <= F.lit(int(share * (1 << 53)))).orderBy(place, key).limit(n)
