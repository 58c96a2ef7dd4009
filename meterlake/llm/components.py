"""Connected components of a graph given as edges, by contraction.

Each task reduces its edges to stars with a union-find. Where a node has several roots from several tasks, it takes the
least, and the roots are joined by new edges: a smaller graph, treated in the same way until one task's edges are left.
No node's edges need to be together, so a hub is no hot key, and the driver gets counts only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

EDGES_A_TASK = 500_000


class Forest:
    """Union-find over any integers; a root is the least of its nodes."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        top = x
        while (up := above.setdefault(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above[x]
        return top

    def union(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)

    def stars(self) -> Iterable[tuple[int, int]]:
        return ((x, self.root(x)) for x in list(self.above))


def components(edges: DataFrame, edges_a_task: int = EDGES_A_TASK, staged: bool = False) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of ``edges`` (a, b).

    Loops and repeated edges do no harm; rows with a null end are left out; no edges give no rows.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f.union(a, b)
        found = list(f.stars())
        for at in range(0, len(found), 100_000):
            part = found[at : at + 100_000]
            yield pa.record_batch([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["node", "root"])

    edges = edges.select("a", "b").dropna()
    edges = edges if staged else stage(edges, "edges")  # they are read twice
    tasks = max(1, -(-edges.count() // edges_a_task))
    stars = stage(edges.coalesce(tasks).mapInArrow(local, "node long, root long"), "stars")
    if tasks == 1:
        return stars
    least = stage(stars.groupBy("node").agg(F.min("root").alias("root")), "least")
    between = stars.withColumnRenamed("root", "a").join(least.withColumnRenamed("root", "b"), "node").filter("a <> b").select("a", "b").distinct()
    above = components(between, edges_a_task).select(F.col("node").alias("root"), F.col("root").alias("_top"))
    return stage(least.join(above, "root", "left").select("node", F.coalesce("_top", "root").alias("root")), "components")
