"""Words with boxes to layout text: visual rows by a running mean of centres, columns by position.

A row takes a word while its centre lies within half the median word height of the row's mean so far, so the order of the
words decides; that is a fold over each page's words, done by ``aggregate``, as is the padding of a line, which depends on
the text built so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 1.8  # in character widths: wider gaps part columns
WORD = "struct<x0:double,x1:double,text:string>"


def to_rows(words: DataFrame) -> DataFrame:
    """doc_id, page, row_no, words (in order) and the page's least x and median character width."""
    seen = words.filter(F.trim("text") != "")
    width = F.when((F.length("text") > 0) & (F.col("x1") > F.col("x0")), (F.col("x1") - F.col("x0")) / F.length("text"))
    item = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("yc"), "x0", "x1", "text")
    pages = seen.groupBy("doc_id", "page").agg(
        F.array_sort(F.collect_list(item)).alias("words"),
        F.median(F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))).alias("height"),
        F.greatest(F.coalesce(F.median(width), F.lit(1.0)), F.lit(1e-3)).alias("char_width"),
        F.min("x0").alias("left"),
    )
    empty = F.expr(f"cast(array() as array<array<{WORD}>>)")
    zero = F.struct(F.lit(0.0).alias("mean"), F.lit(0).alias("n"), F.expr(f"cast(array() as array<{WORD}>)").alias("row"), empty.alias("done"))

    def step(a: Column, w: Column) -> Column:
        word = F.array(F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"), w["text"].alias("text")))
        joins = (a["n"] > 0) & (F.abs(w["yc"] - a["mean"]) <= 0.5 * F.col("height"))
        grown = F.struct((a["mean"] + (w["yc"] - a["mean"]) / (a["n"] + 1)).alias("mean"), (a["n"] + 1).alias("n"), F.concat(a["row"], word).alias("row"), a["done"].alias("done"))
        done = F.when(a["n"] > 0, F.concat(a["done"], F.array(a["row"]))).otherwise(a["done"])
        return F.when(joins, grown).otherwise(F.struct(w["yc"].alias("mean"), F.lit(1).alias("n"), word.alias("row"), done.alias("done")))

    rows = F.aggregate("words", zero, step, lambda a: F.concat(a["done"], F.array(a["row"])))
    found = pages.withColumn("rows", rows).select("doc_id", "page", "char_width", "left", F.posexplode("rows").alias("row_no", "words"))
    return found.withColumn("words", F.array_sort("words", lambda a, b: F.when(a["x0"] < b["x0"], -1).when(a["x0"] > b["x0"], 1).otherwise(0)))


def line_text(words: Column, left: Column, char_width: Column) -> Column:
    """The line of a row: a blank within a phrase, two or more up to the word's column otherwise."""
    zero = F.struct(F.lit("").alias("line"), F.lit(None).cast("double").alias("end"))

    def step(a: Column, w: Column) -> Column:
        column = F.bround((w["x0"] - left) / char_width, 0).cast("int")
        gap = (w["x0"] - a["end"]) / char_width
        pad = F.when(a["end"].isNull(), F.greatest(column, F.lit(0))).when(gap < GAP, 1).otherwise(F.greatest(F.lit(2), column - F.length(a["line"])))
        return F.struct(F.concat(a["line"], F.repeat(F.lit(" "), pad), w["text"]).alias("line"), w["x1"].alias("end"))

    return F.rtrim(F.aggregate(words, zero, step, lambda a: a["line"]))


def to_text(words: DataFrame) -> DataFrame:
    """doc_id, page and layout text of each page."""
    lines = to_rows(words).withColumn("line", line_text(F.col("words"), F.col("left"), F.col("char_width")))
    ordered = F.array_sort(F.collect_list(F.struct("row_no", "line")))
    return lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
