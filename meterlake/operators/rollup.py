"""From words and OCR passes to pages, from pages to documents, and the score against known values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings

PLAUSIBLE = 30.0


def upright(words: DataFrame) -> DataFrame:
    """Words of lines that run to the right; a page that is mostly at an angle keeps all. Lines have a direction (dx, dy)."""
    angled = (F.col("dx") <= 0) | (F.abs("dy") > 0.1)
    pages = words.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~angled).alias("_straight"))
    return words.join(pages, ["doc_id", "page"]).filter(~angled | (2 * F.col("_straight") < F.col("_n"))).drop("_n", "_straight")


def page_confidence(words: DataFrame) -> DataFrame:
    """Mean confidence of a pass, and its score: the confidence of all plausible words together."""
    seen = F.trim("text") != ""
    plausible = (F.col("conf") >= PLAUSIBLE) & F.col("text").rlike(r"[\p{L}\p{N}]")
    return words.filter(seen).groupBy("doc_id", "page", "variant").agg(
        F.bround(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), 2).alias("mean_conf"),
        F.coalesce(F.sum(F.when(plausible, F.col("conf"))), F.lit(0.0)).alias("score"),
    )


def needed_passes(passes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Passes that count: the first always, a later one only where the first is unsure."""
    first = passes.filter("pass_no = 1").select("doc_id", "page", F.col("mean_conf").alias("_first"))
    unsure = F.coalesce(F.col("_first") < settings.sure_confidence, F.lit(True))
    return passes.join(first, ["doc_id", "page"]).filter((F.col("pass_no") == 1) | unsure).drop("_first")


def best_pass(passes: DataFrame) -> DataFrame:
    """The pass with the highest score of each page; of equal ones the earlier."""
    values = [c for c in passes.columns if c not in ("doc_id", "page")]
    best = F.max_by(F.struct(*values), F.struct("score", (-F.col("pass_no")).alias("n")))
    return passes.groupBy("doc_id", "page").agg(best.alias("b")).select("doc_id", "page", "b.*")


def documents(pages: DataFrame) -> DataFrame:
    """One row per document: joined text, method, pages, mean of the pages' confidences."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    marked = F.transform(ordered, lambda p: F.concat(F.lit("----- Page "), p["page"].cast("string"), F.lit(" -----\n"), p["text"]))
    df = pages.groupBy("doc_id").agg(
        ordered.alias("_pages"),
        marked.alias("_marked"),
        F.when(F.min("method") == F.max("method"), F.min("method")).otherwise("mixed").alias("extraction_method"),
        F.count(F.lit(1)).cast("int").alias("page_count"),
        F.bround(F.avg("confidence"), 2).alias("ocr_confidence"),
    )
    text = F.when(F.size("_pages") == 1, F.col("_pages")[0]["text"]).otherwise(F.array_join("_marked", "\n\n"))
    return df.withColumn("text", text).drop("_pages", "_marked")


def comparable(value: Column, kind: str) -> Column:
    """Numbers as doubles, dates in ISO form, all as text."""
    return value.cast("double").cast("string") if kind.startswith(("decimal", "int", "bigint", "double")) else value.cast("string")


def accuracy(actual: DataFrame, truth: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Matches and comparisons per field, over the keys that both have."""
    kinds = dict(truth.dtypes)
    both = actual.select(key, *[F.col(f).alias(f"a_{f}") for f in fields]).join(truth.select(key, *[F.col(f).alias(f"t_{f}") for f in fields]), key)
    same = [F.struct(F.lit(f).alias("field"), comparable(F.col(f"a_{f}"), kinds[f]).eqNullSafe(comparable(F.col(f"t_{f}"), kinds[f])).alias("ok")) for f in fields]
    return both.select(F.explode(F.array(*same)).alias("x")).groupBy(F.col("x.field").alias("field")).agg(F.count_if(F.col("x.ok")).alias("matched"), F.count(F.lit(1)).alias("checked"))
