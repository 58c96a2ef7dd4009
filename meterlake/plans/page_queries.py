"""Queries over scanned pages, stored files and pagers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import listing
from ..sources import bills, images
from .registry import query


def drawn(height: int, width: int, degrees: float, step: int) -> np.ndarray:
    """A page of blocks in lines, as tall as ``step`` is wide apart by three, turned by an angle."""
    y, x = np.mgrid[:height, :width]
    angle = np.deg2rad(degrees)
    along, across = x * np.cos(angle) + y * np.sin(angle), y * np.cos(angle) - x * np.sin(angle)
    ink = (across % step < step // 3) & (along % 18 < 9) & (abs(x - width / 2) < width * 0.42) & (abs(y - height / 2) < height * 0.42)
    return np.where(ink, np.uint8(30), np.uint8(240))


def _draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for k in part["n_nationkey"]:
            pixels = drawn(600, 900, (k - 12) / 2, 36).tobytes()
            yield pd.DataFrame({"doc_id": [k], "page": [1], "height": [600], "width": [900], "channels": [1], "pixels": [pixels]})


@query("SELECT n_nationkey AS doc_id, (n_nationkey - 12) / 2.0 AS skew, true AS level_after, CAST(0 AS DOUBLE) AS light_spread, abs(n_nationkey - 12) < 25 AS letters_seen FROM nation")
def page_skew(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").mapInPandas(_draw, images.PIXELS)
    after = images.statistics(images.prepared(pages)).select("doc_id", (F.abs("skew") < 0.3).alias("level_after"))
    before = images.statistics(pages).select("doc_id", "skew", "light_spread", F.col("text_height").between(11, 15).alias("letters_seen"))
    return before.join(after, "doc_id")


@query("SELECT p_partkey AS id, p_partkey * 7 AS width, p_size * 1000 AS height, p_partkey * 7 * p_size * 1000 <= 1000000 AS decoded FROM part")
def image_size_guard(spark, sf_dir):
    number = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    header = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(F.col("p_partkey") * 7), number(F.col("p_size") * 1000))
    files = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.unhex(header).alias("content"))
    width, height = images.png_size(F.col("content"))
    size = lambda df, ok: df.select("id", width.alias("width"), height.alias("height"), F.lit(ok).alias("decoded"))
    good, huge = images.within_pixels(files, most=1_000_000)
    return size(good, True).unionByName(size(huge, False))


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 3 <> 0 THEN 'file:/store/' || c_custkey || '.pdf' END AS path,
       CASE WHEN c_custkey % 11 = 0 THEN 'refused' WHEN c_custkey % 3 = 0 THEN 'missing' ELSE 'stored' END AS file_status FROM customer
""")
def stored_files(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    name = F.concat(F.col("id").cast("string"), F.lit(".pdf"))
    own = keys.withColumn("stored_filename", F.when(F.col("id") % 11 == 0, F.concat(F.lit("../"), name)).otherwise(name))
    found = keys.filter("id % 3 <> 0").select(F.concat(F.lit("file:/store/"), name).alias("path"))
    return bills.stored_files(own, found).select("id", "path", "file_status")


@query("""
WITH t AS (SELECT c_custkey AS id, c_custkey % 37 AS total, c_custkey % 5 * 10 AS off FROM customer),
     s AS (SELECT id, total, CASE WHEN off < total OR total = 0 THEN CASE WHEN total = 0 THEN 0 ELSE off END ELSE (total - 1) // 10 * 10 END AS start FROM t)
SELECT id, CASE WHEN total > 0 THEN start + 1 END AS first, least(start + 10, total) AS last, start > 0 AS has_previous, start + 10 < total AS has_next FROM s
""")
def pages_shown(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 37).alias("total"), (F.col("c_custkey") % 5 * 10).alias("offset"))
    return listing.pager(rows).select("id", "first", "last", "has_previous", "has_next")
