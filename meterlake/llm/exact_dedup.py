"""Exact dedup against a persistent digest index, with DataFrame operations only.

The index is a Parquet table of one row per distinct text, bucketed and sorted by the text's SHA-256. A batch of new
rows is reduced to its distinct digests (partial aggregation first, so that a text with millions of copies costs one
row per task), the digests that the index has from other batches are taken out by a sort-merge anti-join that leaves the
index where it lies, and the rest is appended. Each append adds a file to each bucket; ``compact`` joins them.

A batch has a name, by default made from its ids and texts. What the index has under the batch's own name doesn't count as
seen, and isn't appended again: a batch whose result was lost, or whose append failed half-way, can be run again with the
same result. The number of buckets is kept beside the files.

A digest with a large part of the batch's rows is answered from a broadcast table, whose size is bounded; all the others are answered by a sort-merge join. So no task gets the copies of one text.

Defined results: null counts as the empty text; repeated rows are copies as any others, and all rows with the id that stays
stay; a null id is less than any other; an empty batch gives no rows;
further columns of the input are ignored (``dedup``) or passed through (``keep_rows``).
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, new_path, stage, with_ids

BUCKETS = 32


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the unchanged text in UTF-8."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class DigestIndex:
    """Digests of all texts seen so far: ``text_sha256``, ``keep_id``, ``copies``, ``batch``, bucketed and sorted by digest.

    ``path`` keeps the index over sessions; opening a path that has an index continues it with its number of buckets
    (another number is an error). In a ``with`` statement the table's name is forgotten at the end; the files stay.

    Files: ``settings`` has a row per generation; the last one's files are the index.
    """

    COLUMNS = "text_sha256 STRING, keep_id BIGINT, copies BIGINT, batch STRING"
    SETTINGS = "generation INT, buckets INT"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path or new_path(spark, "digests")
        found = self._settings()
        if found and buckets not in (None, found.buckets):
            raise ValueError(f"the index has {found.buckets} buckets, not {buckets}")
        self.generation, self.buckets = (found.generation, found.buckets) if found else (0, buckets or BUCKETS)
        if not found:
            self._note()
        self._open()

    def _settings(self) -> Row | None:
        try:
            return self.spark.read.schema(self.SETTINGS).parquet(f"{self.path}/settings").orderBy(F.desc("generation")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _note(self) -> None:
        self.spark.createDataFrame([(self.generation, self.buckets)], self.SETTINGS).coalesce(1).write.mode("append").parquet(f"{self.path}/settings")

    def _open(self) -> None:
        self.name, self.files = f"digests_{uuid.uuid4().hex}", f"{self.path}/generation_{self.generation}"
        self.spark.sql(
            f"CREATE TABLE {self.name} ({self.COLUMNS}) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{self.files}'"
        )

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame, batch: str = "") -> DataFrame:
        """The rows of ``groups`` whose digest the index lacks, or has from this batch."""
        seen = self.table().filter(F.col("batch") != F.lit(batch)).select("text_sha256")
        return groups.join(seen.hint("merge"), "text_sha256", "left_anti")

    def append(self, groups: DataFrame, batch: str = "") -> None:
        """Add the rows of ``groups``, but for those that this batch has added before."""
        own = self.table().filter(F.col("batch") == F.lit(batch)).select("text_sha256")
        new = groups.join(own.hint("merge"), "text_sha256", "left_anti") if not own.isEmpty() else groups
        self._write(new.select("text_sha256", "keep_id", "copies", F.lit(batch).alias("batch")))

    def _write(self, rows: DataFrame, mode: str = "append") -> None:
        (
            rows.repartition(self.buckets, "text_sha256")
            .write.mode(mode).format("parquet").option("path", self.files)
            .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256")
            .saveAsTable(self.name)
        )

    def compact(self) -> None:
        """Write the index anew with one file for each bucket. The new files count once they are complete."""
        old, name = self.table(), self.name
        self.generation += 1
        self._open()
        self._write(old, "overwrite")  # what a failed attempt may have left
        self._note()
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Forget the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _name(digests: DataFrame) -> str:
    """A name for a batch that follows from its ids and texts, in any order."""
    n, total = digests.agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "text_sha256").cast("decimal(20,0)"))).first()
    return f"{n}:{total or 0}"


def dedup(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: which row stands for its text, and whether it stays.

    Of equal new texts the row with the largest id stays, unless an earlier batch has the text already: then none of
    them stays and ``keep_id`` is the earlier row. ``group_size`` counts the copies of this batch and, for a text of an
    earlier batch, those that were appended then. The index has the new texts afterwards. The same ``batch`` (or without a
    name, the same rows) again gets the same answer.
    """
    digests = stage(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_digest(F.col(text)).alias("text_sha256")), "digests")
    groups = stage(digests.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies")), "groups")
    batch = batch or _name(digests)
    fresh = stage(index.unseen(groups, batch), "fresh")
    known = groups.join(fresh.select("text_sha256"), "text_sha256", "left_anti").select("text_sha256", F.col("copies").alias("now"))
    known = known.join(index.table().hint("merge"), "text_sha256").select("text_sha256", "keep_id", (F.col("copies") + F.col("now")).alias("group_size"), F.lit(True).alias("old"), F.col("now").alias("copies"))
    answers = stage(fresh.select("text_sha256", "keep_id", F.col("copies").alias("group_size"), F.lit(False).alias("old"), "copies").unionByName(known), "answers")
    index.append(fresh, batch)

    both = join_groups(digests, answers, "text_sha256", "copies")
    kept = ~F.col("old") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return both.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_rows(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows that repeat an id and its text stay once or more."""
    return with_ids(docs, dedup(docs, index, doc_id, text, batch).filter("kept").select("doc_id"), doc_id)
