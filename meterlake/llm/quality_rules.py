"""Quality rules: statistics of every whole text, a base rule, and an isolation forest for the rest.

The statistics come from one pass over a text's bytes; the forest sees all but the number of words as ratios. (With the
number of words it took the shortest clean texts for anomalies: 59 % of those of up to 31 words stayed, without it 82 %.) It is fitted on at most ``sample`` rows that are labelled
good, each tree on ``SUBSAMPLE`` of them; splits are drawn a little beyond a node's range, so that values which no good
row has are cut off early too. Rows whose path lengths are short on average are anomalies. The threshold is the lowest
with at most ``LOST`` of the good labelled rows above it, calibrated on labelled rows by a histogram of their scores.

Scale: texts are read once; what follows works on a dozen numbers a row, written to the shared folder. The fit's sample
has a fixed bound, the histogram ``BINS`` rows a label, and the forest is a few hundred kilobytes.

Defined results: a null or empty text has no words and fails the base rule; repeated rows get the same verdict; without
good labelled rows all rows that pass the base rule stay; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, stage
from .words import hashes, windows

LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
SAMPLE, TREES, SUBSAMPLE, BINS, LOST, COST = 10_000, 150, 256, 2000, 0.02, 10.0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["word_length", "symbols", "upper", "marks", "distinct", "dup_lines", "repeat_words"]

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_KIND = np.zeros((256, 4), bool)  # a character's first byte, white space, upper case, punctuation
_KIND[:, 0] = (np.arange(256) & 0xC0) != 0x80
_KIND[[9, 10, 11, 12, 13, 32], 1] = True
_KIND[65:91, 2] = _KIND[33:48, 3] = _KIND[58:65, 3] = True


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The counts and the ratios of a text in UTF-8."""
    words = text.split()  # at the six ASCII characters of white space
    n = len(words)
    per_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    first, white, upper, marks = (int(per_byte[_KIND[:, k]].sum()) for k in range(4))
    chars, symbols = first - white, int(per_byte[_IS_SYMBOL].sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = len(lines) - len(set(lines))
    again = distinct = 0
    if n:
        h = hashes(words)
        distinct = len(np.unique(h))
        w = windows(h, WINDOW)
        if len(w):
            order = np.argsort(w, kind="stable")
            same = w[order][1:] == w[order][:-1]
            if same.any():
                twice = np.zeros(len(w), bool)
                twice[order[1:]] = same
                twice[order[:-1]] |= same
                edges = np.zeros(n + 1, np.int64)
                at = np.flatnonzero(twice)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + WINDOW, -1)
                again = int((np.cumsum(edges) > 0).sum())
    counts = [n, chars, symbols, repeated, again]
    c, m = max(chars, 1), max(n, 1)
    # the share of distinct words falls with length: compared with what a text of this length has
    ratios = [chars / m, symbols / m, upper / c, marks / m, np.log(max(distinct, 1)) / np.log(m + 1.0), repeated / max(len(lines), 1), again / m]
    return counts, ratios


class Forest:
    """Isolation trees in arrays: feature (-1: a leaf), split, children, and a leaf's depth with what its size adds."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.expected = _path(min(subsample, len(rows)))
        limit = int(np.ceil(np.log2(max(2, min(subsample, len(rows)))))) + 1
        self.trees = []
        for _ in range(trees):
            feature, split, left, right, depth = [], [], [], [], []

            def grow(x: np.ndarray, d: int) -> int:
                me = len(feature)
                for column, value in zip((feature, split, left, right, depth), (-1, 0.0, 0, 0, d + _path(len(x)))):
                    column.append(value)
                spread = x.max(0) - x.min(0) if len(x) else np.zeros(rows.shape[1])
                if len(x) > 1 and d < limit and spread.any():
                    f = rng.choice(np.flatnonzero(spread))
                    feature[me], split[me] = f, rng.uniform(x[:, f].min() - 0.3 * spread[f], x[:, f].max() + 0.3 * spread[f])
                    left[me] = grow(x[x[:, f] < split[me]], d + 1)
                    right[me] = grow(x[x[:, f] >= split[me]], d + 1)
                return me

            grow(rows[rng.choice(len(rows), min(subsample, len(rows)), replace=False)], 0)
            self.trees.append(tuple(np.array(c) for c in (feature, split, left, right, depth)))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Near 1 for anomalies, under 0.5 for ordinary rows."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, split, left, right, depth in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                at = np.where(inner, np.where(rows[every, feature[at]] < split[at], left[at], right[at]), at)
            total += depth[at]
        return 2.0 ** (-total / len(self.trees) / max(self.expected, 1e-9))


def _path(n: int) -> float:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the counts and the ratios of every row."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py() or b"") for t in batch.column(1)]
            columns = [pa.array([f[0][k] for f in found], pa.int64()) for k in range(len(COUNTS))]
            columns += [pa.array([f[1][k] for f in found], pa.float64()) for k in range(len(RATIOS))]
            yield pa.record_batch([batch.column(0), *columns], ["doc_id", *COUNTS, *RATIOS])

    schema = "doc_id long, " + ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in RATIOS])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(measured, schema)


def _scored(rows: DataFrame, forest: Forest | None) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in RATIOS])
            yield batch.append_column("anomaly", pa.array(shared.value.score(x) if shared.value else np.zeros(len(x))))

    return rows.mapInArrow(scored, rows.withColumn("anomaly", F.lit(0.0)).schema)


def verdicts(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", lost: float = LOST, sample: int = SAMPLE) -> DataFrame:
    """Counts, ``base_failed``, ``anomaly`` (0 to 1) and ``kept`` for every row of ``docs``."""
    rows = stage(measure(docs, doc_id, text), "statistics")
    n = F.col("n_words")
    rows = rows.withColumn("base_failed", (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n))
    marked = labels.filter(F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("_good"))
    labelled = stage(rows.filter(~F.col("base_failed")).join(marked, "doc_id"), "labelled")
    good = first_by_hash(labelled.filter("_good = 1"), "doc_id", sample).select(*RATIOS).collect()  # at most that many rows
    forest = Forest(np.array(good, float)) if len(good) > 1 else None
    bins = _scored(labelled, forest).groupBy("_good", F.floor(F.col("anomaly") * BINS).alias("bin")).count().collect()  # at most two for each bin
    of = {y: np.zeros(BINS + 2) for y in (0, 1)}
    for y, b, count in bins:
        of[1 if y == 1 else 0][min(max(int(b), 0), BINS)] += count
    lost_good = of[1][::-1].cumsum()[::-1] / max(of[1].sum(), 1)  # good rows in a bin or a higher one
    missed = (of[0].cumsum() - of[0]) / max(of[0].sum(), 1)  # bad rows in a lower bin
    cost = np.where(lost_good <= lost, missed + COST * lost_good, np.inf)
    bound = int(np.argmin(cost)) / BINS if forest else 2.0
    out = _scored(rows, forest)
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("anomaly") < F.lit(bound))).alias("kept"), "anomaly")
