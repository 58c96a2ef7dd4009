"""Near-duplicate groups by MinHash and an LSH forest, confirmed on full shingle sets.

1. *Sets.* Each text gives its distinct word shingles (64-bit hashes), their number, a digest of the set, and a MinHash
   signature. Texts with the same set are one class from here on, represented by the least id.
2. *Forest.* Each of ``TREES`` trees has ``DEPTH`` signature values of its own; its order is that of these values.
   Neighbours with a common prefix of ``least_depth`` values or more are candidates. Where more than ``RUN`` rows share a
   prefix, the region goes deeper, to the depth at which ``RUN`` rows or fewer share it, and neighbours in the order are
   candidates as well. The orders are range-partitioned with the id as a tie-breaker: no region is too large for a task.
3. *Confirmation.* Candidates are grouped by the connected components of the candidate graph and range-partitioned by
   them, each class with its full set and its candidates; pairs that are in one component already need no test. Pairs that
   are split between tasks follow: two for each pair of components, then all that still join two components.
4. *Large regions.* Where a region was too large (or ended with a task's range), its classes may have been too far apart
   in every order. If such a region has classes of several components now, those outside its largest component are
   compared by signature with all its classes, in blocks; pairs of different components with a similar signature are
   confirmed there, on their full sets. So depth and neighbourhood bound the work, not the result.

A pair with a similarity of 0.8 has four common values in a tree with a probability of 0.41, in none of 20 trees with
2.6e-5; at 0.9, 2.3e-10. For lower limits the least prefix is shorter, so that this probability stays under ``MISSED``;
under 41 % no prefix is short enough, and such a limit is an error.

Scale: one shuffle of the texts (to bring those with candidates to their candidates), none of all pairs; the driver gets
counts only; every step is written to the shared folder. What a task holds is bounded: the orders are cut into ranges of
``ROWS_A_RANGE`` rows, the confirmation into ranges of ``SHINGLES_A_RANGE`` shingles or so, or ten times these where that
would make more than ``MOST_RANGES`` of them.

Defined results: words are split at the six ASCII characters of white space after lowering A-Z; a text with fewer words
than a shingle has the whole sequence as its only shingle; a null or empty text, or one without words, has no shingles and
is linked with nothing, nor is a row without an id, which stays; repeated rows are members of one class; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, stage, with_ids
from .components import Forest, components
from .words import chained, hashes, windows

TREES, DEPTH, MOST_LEAST_DEPTH, RUN, BLOCK = 20, 8, 4, 12, 128
MISSED = 3e-5  # at most, of pairs at the limit: those with no common prefix in any tree
SIGNATURE = TREES * DEPTH
BATCH_ROWS = 256  # texts or sets that a worker gets at a time
ROWS_A_RANGE, SHINGLES_A_RANGE = 100_000, 1_000_000  # of a tree's order, and of the sets that a task compares
MOST_RANGES = 100_000  # from here on ranges grow, up to ten times, before there are more of them

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(1)
_FACTORS = (_RNG.integers(0, 1 << 31, SIGNATURE, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_TERMS = _RNG.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32)[:, None]


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of n words."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes(words)
    return np.unique(windows(h, n)) if len(h) >= n else chained([np.array([len(h)], np.uint64), *(h[i : i + 1] for i in range(len(h)))])


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values of a set, cut to 16 bits."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (_FACTORS * x[at : at + 1024] + _TERMS).min(1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _intersection(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``percent`` or more."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    common = _intersection(a, b)
    return 100 * common >= percent * (small + large - common)


def least_depth(percent: int) -> int:
    """Values of a prefix that pairs with a similarity of ``percent`` have in common in some tree."""
    for depth in range(MOST_LEAST_DEPTH, 0, -1):
        if (1 - (percent / 100) ** depth) ** TREES <= MISSED:
            return depth
    raise ValueError(f"a similarity of {percent} % is too low for {TREES} trees")


def least_common(percent: int) -> float:
    """Signatures with a smaller common share are five deviations away from a similarity of ``percent``; 0.62 for 80 and above."""
    p = min(percent, 80) / 100
    return p - 0.45 * (p * (1 - p)) ** 0.5


def describe(docs: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``digest`` of the set and ``signature`` (null without shingles) of every row."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, signatures = [], [], []
            for t in batch.column(1):
                s = shingles(t.as_py() or b"", n)
                counts.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(signature(s).tobytes() if len(s) else None)
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "digest", "signature"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(described, "doc_id long, n_shingles long, digest binary, signature binary")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, signature) to one row per tree: its values as big-endian bytes sort as the values do."""
    for batch in batches:
        reps = batch.column(0).to_numpy()
        if not len(reps):
            continue
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(reps), TREES, DEPTH).astype(">u2")
        for tree in range(TREES):
            keys = pa.array([row.tobytes() for row in values[:, tree]], pa.binary())
            yield pa.record_batch([pa.array(np.full(len(reps), tree, np.int32)), keys, pa.array(reps)], ["tree", "key", "rep"])


def _neighbours(least: int):
    """A range of the forest's orders to candidate pairs, and to the rows of regions that need another look (b is null).

    A region's name is its tree, as a byte, and its common prefix.
    """

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        tree = np.concatenate([b.column(0).to_numpy() for b in found]) if found else np.zeros(0, np.int32)
        if not len(tree):
            return
        raw = [k for b in found for k in b.column(1).to_pylist()]
        reps = np.concatenate([b.column(2).to_numpy() for b in found])
        keys = np.frombuffer(b"".join(raw), np.uint16).reshape(len(tree), DEPTH)
        common = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(1) * (tree[1:] == tree[:-1])
        region, settled = np.zeros(len(tree), np.int64), np.zeros(len(tree), bool)
        for depth in range(least, DEPTH + 1):
            own = np.r_[0, np.cumsum(common < depth)]
            size = np.bincount(own)
            if depth == least:
                again = (size[own] > RUN) | (own == 0) | (own == own[-1])
            now = ~settled & (size[own] <= RUN)
            region[now] = depth * (len(tree) + 1) + own[now]
            settled |= now
        pairs = [(np.flatnonzero(common >= least), 1)]
        for k in range(2, RUN):
            if k < len(tree):
                pairs.append((np.flatnonzero(settled[k:] & (region[k:] == region[:-k])), k))
        a = np.concatenate([reps[i] for i, _ in pairs])
        b = np.concatenate([reps[i + k] for i, k in pairs])
        a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0).T
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("region", pa.binary())])
        yield pa.record_batch([pa.array(a), pa.array(b), pa.nulls(len(a), pa.binary())], schema=schema)
        at = np.flatnonzero(again)
        yield pa.record_batch([pa.array(reps[at]), pa.nulls(len(at), pa.int64()), pa.array([bytes([tree[i]]) + raw[i][: 2 * least] for i in at], pa.binary())], schema=schema)

    return neighbours


def _confirm_near(percent: int):
    """Rows (group, rep, near, words) ordered by group, to links and to pairs whose other end is elsewhere."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sets, near = None, {}, []

        def settle() -> pa.RecordBatch:
            forest, out = Forest(), []
            for b, ends in near:
                for a in ends:
                    if a not in sets:
                        out.append((a, b, False))
                    elif forest.root(a) != forest.root(b) and alike(sets[a], sets[b], percent):
                        forest.union(a, b)
                        out.append((a, b, True))
            return pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "linked"])

        for batch in batches:
            for g, rep, ends, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if g != group:
                    if near:
                        yield settle()
                    group, sets, near = g, {}, []
                sets[rep] = np.frombuffer(words.as_py(), np.uint64)
                if ends:
                    near.append((rep, sorted(ends)))
        if near:
            yield settle()

    return confirm


def _confirm_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose sets are alike."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("x", "y"))
            good = [alike(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64), percent) for p, q in zip(x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    own = lambda end, name: sets.select(F.col("rep").alias(end), F.col("words").alias(name))
    return pairs.select("a", "b").join(own("a", "x"), "a").join(own("b", "y"), "b").mapInArrow(confirm, "a long, b long")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components, with these as ca and cb."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return pairs.filter("ca <> cb")


def _compare_blocks(percent: int):
    """A block of stragglers and a block of their region to links between different components.

    A pair is looked at in the first tree in which it has a common prefix only: it is settled there, by the order or here.
    """
    least, alike_from = least_depth(percent), least_common(percent)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, tree = rows[rows["left"]], rows[~rows["left"]], rows["region"].iloc[0][0]
        sets = [np.frombuffer(w, np.uint64) for w in right["words"]]
        values = np.stack([signature(w) for w in sets]) if sets else np.zeros((0, SIGNATURE), np.uint16)
        roots, reps, forest, out = right["root"].to_numpy(), right["rep"].to_numpy(), Forest(), []
        for rep, root, words in zip(left["rep"], left["root"], left["words"]):
            mine = np.frombuffer(words, np.uint64)
            equal = values == signature(mine)
            prefix = equal.reshape(-1, TREES, DEPTH)[:, :, :least].all(2)
            some = np.flatnonzero((equal.mean(1) >= alike_from) & (roots != root) & (prefix.argmax(1) == tree))
            for i in some[np.argsort(-equal[some].mean(1), kind="stable")]:
                if forest.root(root) != forest.root(int(roots[i])) and alike(mine, sets[i], percent):
                    forest.union(root, int(roots[i]))
                    out.append((min(rep, reps[i]), max(rep, reps[i])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return compare


def _with_roots(again: DataFrame, roots: DataFrame) -> DataFrame:
    rows = again.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    return rows.select("region", "rep", F.coalesce("root", "rep").alias("root"))


def _open_regions(rows: DataFrame) -> DataFrame:
    """Regions with several components: the largest of these, and in how many blocks the region and the rest of it are."""
    parts = rows.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n"))
    regions = parts.groupBy("region").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    return regions.select("region", "n", F.col("main.root").alias("main"), blocks(F.col("n")).alias("rights"), blocks(F.col("n") - F.col("main.n")).alias("lefts"))


def _far_links(rows: DataFrame, regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across the components of regions that were too large to compare in order."""
    rows = join_groups(rows, regions, "region", "n")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    right = rows.withColumn("j", some("rights")).withColumn("i", every("lefts")).withColumn("left", F.lit(False))
    left = rows.filter("root <> main").withColumn("i", some("lefts")).withColumn("j", every("rights")).withColumn("left", F.lit(True))
    both = right.unionByName(left).select("region", "i", "j", "left", "rep", "root").join(sets.select("rep", "words"), "rep")
    return both.groupBy("region", "i", "j").applyInPandas(_compare_blocks(percent), "a long, b long")


def _ranges(spark: SparkSession, total: int, size: int) -> int:
    return max(spark.sparkContext.defaultParallelism, min(total // size, max(MOST_RANGES, total // (10 * size))) + 1)


def groups(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (the least id of the group) and ``kept`` for every row of ``docs``."""
    spark = docs.sparkSession
    described = stage(describe(docs, n, doc_id, text), "described", BATCH_ROWS)
    linkable = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    members = described.filter(linkable)
    classes = members.groupBy("digest").agg(F.min(F.struct("doc_id", "signature")).alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes.select("digest", "copies", F.col("first.doc_id").alias("rep"), F.col("first.signature").alias("signature")), "classes")

    forest = classes.select("rep", "signature").mapInArrow(_trees, "tree int, key binary, rep long")
    forest = forest.repartitionByRange(_ranges(spark, classes.count() * TREES, ROWS_A_RANGE), "tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")
    found = stage(forest.mapInArrow(_neighbours(least_depth(percent)), "a long, b long, region binary"), "neighbours")
    pairs = stage(found.filter("b is not null").select("a", "b").distinct(), "pairs")
    again = found.filter("b is null").select("region", F.col("a").alias("rep"))
    crowded = stage(again.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "crowded")
    again = stage(join_groups(again, crowded, "region", "n").select("region", "rep"), "again")

    near = pairs.groupBy(F.col("b").alias("rep")).agg(F.collect_list("a").alias("near"))
    needed = components(pairs, staged=True).select(F.col("node").alias("rep"), F.col("root").alias("group"))
    needed = needed.unionByName(again.select("rep", F.col("rep").alias("group"))).groupBy("rep").agg(F.min("group").alias("group"))
    needed = stage(needed.join(near, "rep", "left"), "needed")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [shingles(t.as_py() or b"", n).tobytes() for t in batch.column(3)]
            yield pa.record_batch([*batch.columns[:3], pa.array([len(w) // 8 for w in words], pa.int64()), pa.array(words, pa.binary())], ["group", "rep", "near", "n", "words"])

    texts = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).cast("binary").alias("text"))
    sets = texts.join(needed.hint("merge"), "rep").select("group", "rep", "near", "text").mapInArrow(to_sets, "group long, rep long, near array<long>, n long, words binary")
    sets = stage(sets, "sets", BATCH_ROWS)
    ranges = _ranges(spark, sets.agg(F.sum("n")).first()[0] or 0, SHINGLES_A_RANGE)
    tested = sets.select("group", "rep", "near", "words").repartitionByRange(ranges, "group", "rep").sortWithinPartitions("group", "rep").mapInArrow(_confirm_near(percent), "a long, b long, linked boolean")
    tested = stage(tested, "tested", BATCH_ROWS)
    links, split = tested.filter("linked").select("a", "b"), tested.filter("not linked").select("a", "b")
    roots = components(links)

    apart = stage(_apart(split, roots), "apart")
    if not apart.isEmpty():
        pair = F.struct("a", "b")
        two = apart.groupBy("ca", "cb").agg(F.min(pair).alias("p"), F.max(pair).alias("q")).select(F.explode(F.array_distinct(F.array("p", "q"))).alias("p")).select("p.*")
        links = stage(links.unionByName(_confirm_pairs(two, sets, percent)), "links", BATCH_ROWS)
        roots = components(links)
        rest = stage(_apart(split, roots), "apart")
        if not rest.isEmpty():
            links = stage(links.unionByName(_confirm_pairs(rest, sets, percent)), "links", BATCH_ROWS)
            roots = components(links)
    rows = stage(_with_roots(again, roots), "regions")
    regions = stage(_open_regions(rows), "open")
    if not regions.isEmpty():
        far = stage(_far_links(rows, regions, sets, percent), "far")
        roots = components(links.unionByName(far))

    answers = stage(classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("digest", "copies", F.coalesce("root", "rep").alias("component_id")), "answers")
    grouped = join_groups(members.select("doc_id", "n_shingles", "digest"), answers, "digest", "copies").select("doc_id", "n_shingles", "component_id")
    lone = described.filter(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_rows(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one id of each group."""
    return with_ids(docs, groups(docs, n, percent, doc_id, text).filter("kept").select("doc_id"), doc_id)
