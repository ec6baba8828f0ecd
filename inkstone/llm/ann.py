"""Operator 7: nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, each quantised with a codebook of its own; an entry lies in the
cell of its two nearest centroids. A query goes through the centroid pairs by summed distance with a
heap until the cells visited hold its share of all entries; the entries of these cells are reranked by their cosine.

The share is found when the codebooks are fitted: the sample's own queries are searched in the sample by brute
force, and the share is the least that visits TARGET of their neighbours. Clustered vectors need little of the index,
vectors without any structure much. ``share`` can be given instead; 1.0 visits every cell and is exact.

Cells in the order of their centroids are dealt out in blocks of about BLOCK entries, a cell with more in several. A
query goes once to each block that has a cell it visits, with the summed distance of the last one, which tells the
block which of its cells are visited. No task holds a whole cell or all queries of a block.

Rows with one vector are one entry with their TOP + 1 smallest ids, which is all that any query's TOP can use.
Codebooks are fitted on at most SAMPLE vectors; every vector is indexed.

Defined cases: vectors null, empty, zero or with a null or non-finite component, and rows without an id,
take no part; vectors are scaled by a power of two before they are squared, so that components of any finite size
give the same cosine; ties go to the smaller vec_id; vectors are compared with those of their own dimension;
rows that repeat a vec_id and a vector are one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import arrow_map, checkpointed, table

TOP, EVERY = 5, 50
#: Vectors that the codebooks are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 16_384, 8
#: Vectors of the sample for each centroid and entries for each cell, at least; no codebook is larger than MAX_CODES.
PER_CODE, PER_CELL, MIN_CODES, MAX_CODES = 32, 4, 4, 256
#: Share of the neighbours of ASKED vectors of the sample that the search has to visit.
TARGET, ASKED = 0.96, 512
#: Entries and queries that a task compares at once.
BLOCK, QUERIES = 4096, 256


def squared(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1))


def codebook(x: np.ndarray, size: int) -> np.ndarray:
    """Centroids by Lloyd's algorithm from evenly spaced distinct rows."""
    x = np.unique(x, axis=0)
    codes = x[np.linspace(0, len(x) - 1, min(size, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = squared(x, codes).argmin(1)
        held = np.bincount(near, minlength=len(codes))
        total = np.stack([np.bincount(near, x[:, c], len(codes)) for c in range(x.shape[1])], 1)
        codes[held > 0] = total[held > 0] / held[held > 0, None]
    return codes


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between 1/2 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unit = scaled(x)
    unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
    cut = max(1, unit.shape[1] // 2)
    return unit[:, :cut], unit[:, cut:] if unit.shape[1] > 1 else unit[:, :cut] * 0


def traverse(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, want: float) -> list[tuple[int, int]]:
    """Cells with entries in order of d1[i] + d2[j], from a heap, until those visited hold ``want`` entries."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, held_by = d1[o1].tolist(), d2[o2].tolist(), counts[np.ix_(o1, o2)].tolist()
    heap, out, held = [(s1[0] + s2[0], 0, 0)], [], 0
    while heap and held < want:
        _, i, j = heapq.heappop(heap)
        if n := held_by[i][j]:
            out.append((int(o1[i]), int(o2[j])))
            held += n
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


@dataclass
class Books:
    """The two codebooks and the share of entries that a query visits."""

    first: np.ndarray
    second: np.ndarray
    share: float

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = halves(x)
        return squared(a, self.first).argmin(1) * len(self.second) + squared(b, self.second).argmin(1)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = halves(x)
        return squared(a, self.first), squared(b, self.second)


def share_for(x: np.ndarray, books: Books, top: int, target: float = TARGET) -> float:
    """The least share of the entries ``x`` to be visited to meet ``target`` of the neighbours of some of them."""
    asked = x[np.linspace(0, len(x) - 1, min(ASKED, len(x))).astype(int)]
    unit, cell = np.concatenate(halves(x), 1), books.cells(x)
    d1, d2 = books.distances(asked)
    need = []
    for q, v in enumerate(np.concatenate(halves(asked), 1)):
        near = np.argsort(-(unit @ v), kind="stable")[1 : top + 1]
        reach = d1[q][cell // len(books.second)] + d2[q][cell % len(books.second)]
        need += [(reach <= r).mean() for r in reach[near]]
    return float(np.quantile(need, target)) if need else 1.0


def fitted(x: np.ndarray, total: int, top: int = TOP, share: float | None = None) -> Books:
    """Codebooks for ``total`` entries, of which ``x`` is a sample."""
    size = int(np.clip(min(len(x) / PER_CODE, (total / PER_CELL) ** 0.5), MIN_CODES, MAX_CODES))
    books = Books(*[codebook(h, size) for h in halves(x)], share=1.0)
    books.share = share_for(x, books, top) if share is None else share
    return books


@dataclass
class Blocks:
    """Where the entries of a cell are: in ``n_sub[cell]`` blocks from ``first[cell]`` on."""

    counts: np.ndarray
    first: np.ndarray
    n_sub: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, block: int) -> Blocks:
        n_sub = np.maximum(1, -(-counts // block))
        # small cells share a block, in order; a cell of several blocks has them to itself
        load = np.where(n_sub > 1, n_sub * block, counts)
        first, at, used = np.zeros(len(counts), np.int64), 0, 0
        for c in np.flatnonzero(counts):
            if n_sub[c] > 1 or used + load[c] > block:
                at, used = at + (used > 0), 0
            first[c] = at
            at, used = (at + n_sub[c], 0) if n_sub[c] > 1 else (at, used + load[c])
        return cls(counts, first, n_sub)


def vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _assign(batches: Iterator[pa.RecordBatch], books: Books) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cell = books.cells(vectors(batch.column(2)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], ["cid", "ids", "vec", "cell"])


def _deal(batches: Iterator[pa.RecordBatch], blocks: Blocks) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cell, cid = batch.column(3).to_numpy(), batch.column(0).to_numpy()
        sub = ((cid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % blocks.n_sub[cell].astype(np.uint64)
        block = blocks.first[cell] + sub.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(block), batch.column(1), batch.column(2), batch.column(3)], ["block", "ids", "vec", "cell"])


def _probe(batches: Iterator[pa.RecordBatch], books: Books, blocks: Blocks, want: float) -> Iterator[pa.RecordBatch]:
    """(qid, qvec, reach, block): each query with the summed distance of its last cell, for each block it visits."""
    width = len(books.second)
    counts = blocks.counts.reshape(-1, width)
    for whole in batches:
        for at in range(0, whole.num_rows, QUERIES):
            batch = whole.slice(at, QUERIES)
            d1, d2 = books.distances(vectors(batch.column(1)))
            rows, reach, block = [], [], []
            for q in range(batch.num_rows):
                visited = np.array([i * width + j for i, j in traverse(d1[q], d2[q], counts, want)])
                n = blocks.n_sub[visited]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                mine = np.unique(np.repeat(blocks.first[visited], n) + inside)
                last = (d1[q][visited // width] + d2[q][visited % width]).max()
                rows += [q] * len(mine)
                reach += [last] * len(mine)
                block += mine.tolist()
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(reach, pa.float64()), pa.array(block, pa.int64())], ["qid", "qvec", "reach", "block"])


def _rerank(entries: pd.DataFrame, queries: pd.DataFrame, top: int, books: Books) -> pd.DataFrame:
    """Of a block's entries in cells that a query visits, the ``top`` best rows for each query."""
    if not len(entries) or not len(queries):
        return pd.DataFrame({"qid": [], "vec_id": [], "score": []})
    x, ids, cell = np.stack(entries["vec"].to_list()).astype(np.float64), entries["ids"].to_list(), entries["cell"].to_numpy()
    x = scaled(x)
    norm = np.sqrt((x * x).sum(1))
    unit = x / norm[:, None]
    i, j = cell // len(books.second), cell % len(books.second)
    out = []
    for at in range(0, len(queries), QUERIES):
        part = queries.iloc[at : at + QUERIES]
        v = np.stack(part["qvec"].to_list()).astype(np.float64)
        d1, d2 = books.distances(v)
        v = scaled(v)
        about = (v / np.sqrt((v * v).sum(1, keepdims=True))) @ unit.T
        about[d1[:, i] + d2[:, j] > part["reach"].to_numpy()[:, None] * (1 + 1e-9) + 1e-12] = -np.inf
        for q, qid in enumerate(part["qid"]):
            row = about[q]
            least = np.partition(row, -top)[-top] if len(row) > top else -np.inf
            best = np.flatnonzero((row >= least - 1e-9) & (row > -np.inf))
            # row by row, so that a pair's score is the same wherever it is computed
            score = (x[best] * v[q]).sum(1) / (norm[best] * np.sqrt((v[q] * v[q]).sum()))
            got = sorted((-s, int(r)) for s, k in zip(score.tolist(), best, strict=True) for r in ids[k])[:top]
            out += [(qid, r, -s) for s, r in got]
    return pd.DataFrame(out, columns=["qid", "vec_id", "score"])


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    return embeddings.where(F.coalesce(ok, F.lit(False))).select("vec_id", v.alias("vec"))


def _search(rows: DataFrame, top: int, every: int, share: float | None) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors of one dimension."""
    by_vec = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.distinct().withColumn("_n", F.row_number().over(by_vec)).where(F.col("_n") <= top + 1)
    entries = few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = checkpointed(entries.select(F.col("ids")[0].alias("cid"), "ids", "vec"))
    sample = entries.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("vec").toPandas()
    books = fitted(np.stack(sample["vec"].to_list()), entries.count(), top, share)
    index = checkpointed(arrow_map(entries, partial(_assign, books=books), "cid long, ids array<bigint>, vec array<double>, cell int"))
    counts = np.zeros(len(books.first) * len(books.second), np.int64)
    for cell, n in index.groupBy("cell").count().collect():  # at most MAX_CODES ** 2 rows
        counts[cell] = n
    blocks = Blocks.of(counts, BLOCK)
    dealt = arrow_map(index, partial(_deal, blocks=blocks), "block long, ids array<bigint>, vec array<double>, cell int")
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    asked = checkpointed(asked.join(entries.select("cid", "vec"), "vec").select("vec_id", "cid", "vec"))
    n_asked = asked.count()
    tasks = max(-(-n_asked // BLOCK), min(n_asked, rows.sparkSession.sparkContext.defaultParallelism), 1)
    probes = asked.groupBy(F.col("cid").alias("qid")).agg(F.first("vec").alias("qvec")).repartition(tasks)
    want = max(books.share * float(counts.sum()), top + 1)
    probes = checkpointed(arrow_map(probes, partial(_probe, books=books, blocks=blocks, want=want), "qid long, qvec array<double>, reach double, block long"))
    parts = probes.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_ask"))
    dealt = dealt.join(parts, "block").withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("n_ask") - 1))).select("block", "ask", "ids", "vec", "cell")
    probes = probes.join(parts, "block").withColumn("ask", F.pmod(F.xxhash64("qid"), "n_ask").cast("int")).select("block", "ask", "qid", "qvec", "reach")
    key = ["block", "ask"]
    found = dealt.groupBy(key).cogroup(probes.groupBy(key)).applyInPandas(partial(_rerank, top=top + 1, books=books), "qid long, vec_id long, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= top + 1)
    found = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("found"))
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qid")).join(found, "qid")
    pairs = pairs.withColumn("found", F.filter("found", lambda x: x["vec_id"] != F.col("query_id")))
    pairs = pairs.select("query_id", F.posexplode(F.slice("found", 1, top)).alias("at", "hit"))
    return pairs.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def nearest(embeddings: DataFrame, top: int = TOP, every: int = EVERY, share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score); ``share`` of the entries is visited, by default what the sample asks for."""
    rows = usable(embeddings)
    out = None
    for (dim,) in rows.select(F.size("vec").alias("d")).distinct().orderBy("d").collect():
        one = _search(rows.where(F.size("vec") == dim), top, every, share)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def op7_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
