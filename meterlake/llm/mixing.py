"""Mixing sources to target weights by Pareto order sampling.

*Targets.* Sources in the order of their code points (null last) have weights 5, 2, 1, repeating. They share all words by
weight; a target stops at three times its source's words, and what is above is shared again by weight among the others.
The common factor of the weights rises from round to round until no source is above its bound.

*Copies.* A source whose target is k times its words and some more takes k whole copies of every document. For the rest,
its budget, a sample is drawn: a document that is no longer than the budget gets an inclusion probability in proportion to
its words. Documents whose probability would reach 1 are certain: they come first, and the others share what is left of the
budget, again until no further one is certain. The others are ranked by random odds divided by inclusion odds. The sample
is the head of that order whose words come nearest to the budget. A document longer than its source's budget can't be in a
sample of that size and has no probability; only if all others together fall short is the shortest of these added, where
that comes nearer. So no document is taken more than three times.

*No sort by source.* The end of the head is found by sums over 1024 ranges of the rank, then over 1024 parts of the range
where the budget ends, and only the documents of that part (a millionth of the source, and ties) are put in order. All
sums are combined on the map side first, so a source with a third of all rows is no hot key. What the driver gets is a few
numbers a round; each round in which some source's large documents become certain is one sum over all sizes. Which documents are taken follows from a row and its source's line in the plan, so that applying a plan
is a join with one line per source.

Random numbers come from a hash of the id and a seed: reruns agree. Defined results: null text has no words and a size of
0; documents without words are never sampled (whole copies of nothing); repeated rows share their random number and are
ranked next to each other; an empty table gives no rows; further columns are kept by ``apply``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_groups, stage

WEIGHTS, MOST_COPIES, PARTS, SEED = (5, 2, 1), 3, 1024, 17
MOST_SOURCES = 50_000
WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS)).cast("long")


def _key(source: str) -> Column:
    """The source as a join key that null has too."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _weighed(sources: DataFrame) -> DataFrame:
    """Add ``weight`` by place in the order of code points, null last. One count for each partition goes to the driver."""
    ordered = stage(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    before, total = [], 0
    for p, n in sorted(ordered.groupBy(part).count().collect()):
        before.append((F.lit(p), F.lit(total)))
        total += n
    first = F.element_at(F.create_map(*[x for pair in before for x in pair]), part) if before else F.lit(0)
    place = first + (F.col("at") - F.shiftleft(part, 33))
    return ordered.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))).drop("at")


def targets(rows: DataFrame) -> DataFrame:
    """One row per source of ``rows`` (doc_id, source, size): ``words``, ``weight`` and ``target``."""
    sources = stage(_weighed(rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("_n"))), "sources")
    most, weight = MOST_COPIES * F.col("words"), F.col("weight")
    total, factor = sources.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0], 0.0
    while True:
        free = F.lit(factor) * weight <= most
        bound, weights = sources.agg(F.sum(F.when(~free, most).otherwise(0)), F.sum(F.when(free, weight).otherwise(0))).first()
        new = (total - bound) / weights if weights else factor
        if new <= factor:
            break
        factor = new
    return sources.withColumn("target", F.least(F.lit(factor) * weight, most.cast("double")))


def _rank(size: Column, doc_id: Column, rate: Column) -> Column:
    """Random odds over inclusion odds, brought into 0 to 1; 0 for certain documents."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(SEED)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    p = F.greatest(F.lit(1e-12), rate * size)
    odds = u / (1 - u) * (1 - p) / p
    return F.when(p >= 1, 0.0).otherwise(odds / (1 + odds))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the line of their source."""
    rows = rows.withColumn("_key", _key("source"))
    if plan.count() <= MOST_SOURCES:
        return rows.join(F.broadcast(plan.drop("_n")), "_key")
    return join_groups(rows, plan, "_key", "_n").drop("_n")


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the line of their source, and each document's rank and its part on both levels."""
    out = _with_plan(rows, plan).withColumn("_rank", _rank(F.col("size"), F.col("doc_id"), F.col("_rate")))
    out = out.withColumn("_open", (F.col("size") > 0) & (F.col("size") <= F.col("_budget")))
    out = out.withColumn("_part", F.floor(F.col("_rank") * PARTS).cast("int"))
    return out.withColumn("_small", F.floor((F.col("_rank") * PARTS - F.col("_part")) * PARTS).cast("int"))


def _rates(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``_rate``, a document's inclusion probability per word: from 1 / _rate words on it is certain."""
    fits = rows.filter((F.col("size") > 0) & (F.col("size") <= F.col("_budget"))).select("_key", "size", "_budget")
    rate, known = F.lit(None).cast("double"), None
    while True:
        # documents are certain from this size on; none in the first round
        rated = fits.withColumn("_rate", rate) if known is None else _on_plan(fits, known)
        sure = F.coalesce(F.col("size") * F.col("_rate") >= 1, F.lit(False))
        sums = rated.groupBy("_key").agg(
            F.max("_budget").alias("_budget"), F.sum(F.when(~sure, F.col("size").cast("double") * F.col("size"))).alias("squares"),
            F.coalesce(F.sum(F.when(sure, F.col("size"))), F.lit(0)).alias("sure"), F.count(F.when(sure, 1)).alias("certain"), F.max("_rate").alias("before"),
        )
        # what is certain once stays certain, and the rate never falls; with nothing left to share it stays
        left = F.greatest(F.lit(0.0), F.col("_budget") - F.col("sure"))
        sums = sums.select("_key", "certain", F.greatest(F.coalesce("before", F.lit(0.0)), F.coalesce(left / F.col("squares"), F.lit(0.0))).alias("_rate"))
        last, known = known, stage(sums, "rates")
        if last is not None and known.join(last.select("_key", F.col("certain").alias("was")), "_key").filter("certain > was").isEmpty():
            return plan.join(known.select("_key", "_rate"), "_key", "left").fillna(0.0, ["_rate"])


def _on_plan(rows: DataFrame, lines: DataFrame) -> DataFrame:
    few = lines.select("_key", "_rate")
    return rows.join(F.broadcast(few) if lines.count() <= MOST_SOURCES else few, "_key")


def _ending(sums: DataFrame, by: str) -> DataFrame:
    """Per source the part in which the budget ends, and the words before it."""
    w = W.partitionBy("_key").orderBy(by)
    sums = sums.withColumn("_upto", F.sum("words").over(w))
    return sums.filter(F.col("_upto") > F.col("_left")).groupBy("_key").agg(F.min(by).alias(by), F.min_by(F.col("_left") - F.col("_upto") + F.col("words"), by).alias("_left"))


def make_plan(rows: DataFrame) -> DataFrame:
    """One line per source of ``rows`` (doc_id, source, size): target, whole copies, and where its sample ends."""
    ratio = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    copies = F.floor(ratio).cast("int")
    plan = targets(rows).select(_key("source").alias("_key"), F.col("words").alias("source_size"), "target", copies.alias("_copies"), F.greatest(F.lit(0.0), F.col("target") - copies * F.col("words")).alias("_budget"), "_n")
    plan = stage(plan, "plan")
    keyed = _with_plan(rows, plan)
    known = keyed.groupBy("_key").agg(
        F.coalesce(F.sum(F.when((F.col("size") > 0) & (F.col("size") <= F.col("_budget")), F.col("size"))), F.lit(0)).alias("_fitting"),
        F.min(F.when(F.col("size") > F.col("_budget"), F.struct("size", "doc_id"))).alias("_longer"),
    )
    short = F.col("_budget") - F.col("_fitting")
    extra = F.when((short > 0) & (F.col("_longer.size") - short < short), F.col("_longer.doc_id"))
    plan = stage(_rates(keyed, plan).join(known, "_key").withColumn("_extra", extra).drop("_fitting", "_longer"), "rates")

    ranked = stage(_ranked(rows, plan).filter("_open").select("_key", "doc_id", "size", "_rank", "_part", "_small", "_budget"), "ranked")
    sums = ranked.groupBy("_key", "_part").agg(F.sum("size").alias("words"), F.max("_budget").alias("_left"))
    ends = stage(_ending(sums, "_part"), "parts")
    within = ranked.join(ends, ["_key", "_part"])
    sums = within.groupBy("_key", "_part", "_small").agg(F.sum("size").alias("words"), F.max("_left").alias("_left"))
    small = stage(ends.drop("_left").join(_ending(sums, "_small"), "_key"), "small")
    last = ranked.join(small, ["_key", "_part", "_small"])
    w = W.partitionBy("_key").orderBy("_rank", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = last.withColumn("_upto", F.sum("size").over(w))
    before = F.col("_upto") - F.col("size")
    inside = (F.col("_upto") <= F.col("_left")) | ((before < F.col("_left")) & (F.col("_upto") - F.col("_left") < F.col("_left") - before))
    last = last.filter(inside).groupBy("_key").agg(F.max(F.struct("_rank", "doc_id")).alias("_end"))
    ends = small.drop("_left").join(last, "_key", "left").withColumnsRenamed({"_part": "_end_part", "_small": "_end_small"})
    return stage(plan.join(ends, "_key", "left"), "plan")


def apply(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` (with doc_id, source, size) and what the plan says: ``source_size``, ``target``, ``copies`` (0 to 3)."""
    rows = _ranked(docs, plan)
    at, end = F.struct("_part", "_small"), F.struct("_end_part", "_end_small")
    head = F.col("_end_part").isNull() | (at < end) | ((at == end) & F.coalesce(F.struct("_rank", "doc_id") <= F.col("_end"), F.lit(False)))
    sampled = (F.col("_open") & head) | F.coalesce(F.col("doc_id") == F.col("_extra"), F.lit(False))
    rows = rows.withColumn("copies", F.col("_copies") + F.when(sampled, 1).otherwise(0))
    return rows.select(*docs.columns, "source_size", "target", "copies")


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target and the words taken."""
    rows = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(text).alias("size")), "sizes")
    out = apply(rows, make_plan(rows))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    rows = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(text).alias("size")), "sizes")
    whole = docs.select(F.struct("*").alias("row"), "doc_id", F.col("source").cast("string").alias("source"), size_of(text).alias("size"))
    out = apply(whole, make_plan(rows)).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
