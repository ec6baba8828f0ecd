"""Connected components of links between integer ids, by alternating large and small stars.

Each round is joins and minima on distributed tables, cut off by a checkpoint; no link leaves the
executors. The number of rounds grows with the logarithm of the longest path. Up to FEW links are settled
by one task instead: the tasks, plans and files of the rounds would take more than the links do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import arrow_map, checkpointed

#: Links that one task settles, of 16 bytes each.
FEW = 1_000_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id in the links and the smallest one reachable: roots that links join hang onto the smaller one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return ids, ids[root]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each id but the roots, and its root, of links that are all in this partition."""
    links = [[batch.column(c).to_numpy() for c in (0, 1)] for batch in batches]
    ids, root = least_reachable(*[np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*links, strict=True) if links else ((), ()))])
    yield pa.RecordBatch.from_arrays([pa.array(x[ids != root]) for x in (ids, root)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each id in ``links`` (a, b) but the roots; root is the smallest id reachable.

    Links of an id with itself or with a null are left out; no links give no rows.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    # ids linked to several smaller ones are linked to the least of them, and those to each other: links told by
    # many posting lists fold up before the rounds, without a join
    least = edges.withColumn("_m", F.min("b").over(Window.partitionBy("a")))
    folded = least.where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    edges = checkpointed(folded.unionByName(least.select("a", F.col("_m").alias("b"))).distinct())
    known = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state[0] <= FEW:
            return arrow_map(edges.coalesce(1), _settled, "a long, b long").toDF("node", "root")
        if state == known:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        known = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(root, "a").where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        edges = checkpointed(small.unionByName(root.withColumnRenamed("_m", "b")).distinct())
