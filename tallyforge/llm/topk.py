"""Exact top-k search by inner product with multi-resolution segment statistics.

For a vector cut into segments of l components with mean m and deviation s,
the values m*sqrt(l) and s*sqrt(l) keep its norm, and the distance between two
vectors' values is a lower bound of their distance. With equal norms on both
sides that bound says that the inner product of the values is an upper bound
of the vectors' inner product.

Queries are written once, in blocks with their statistics and a first k-th
score, to the shared folder. Rows aren't shuffled: a task gathers HOLD rows,
orders them by coarse statistics into cells with an envelope (least and
greatest of each value), and takes the blocks of queries in turn. Cells whose
envelope is below a query's k-th score fall at once; of the best cells first
the exact scores raise it; rows of the others meet the coarse bound, then the
finer one, and what is left is scored. Each task's k best of a query are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays
from .common import checkpoint, fresh_folder

LEVELS = (4, 16)
QUERY_BLOCK = 1024
#: Rows that a task holds, and rows of a cell of them.
HOLD, CELL = 65_536, 1024
#: Pairs that are bounded or scored at a time.
PAIRS = 1 << 18


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, times the root of their length."""
    cuts = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
    length = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / length
    spread = np.add.reduceat((x - np.repeat(mean, length, axis=1)) ** 2, cuts[:-1], axis=1)
    return np.concatenate([mean * np.sqrt(length), np.sqrt(spread)], axis=1)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, all with all: in float64 where that is exact, else in int64."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    reach = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if reach < 2**53 else q @ x.T


def _envelope(stats: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(stats, edges[:-1], axis=0), np.maximum.reduceat(stats, edges[:-1], axis=0)


class Rows:
    """The rows that a task holds, in cells."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        coarse = statistics(x.astype(np.float64), LEVELS[0])
        # cells: rows that agree on which of their segments' means are high, in order of the largest one
        means = coarse[:, : coarse.shape[1] // 2]
        high = (means > np.median(means, axis=0)) @ (1 << np.arange(means.shape[1]))
        order = np.lexsort((means.max(axis=1, initial=0.0), high))
        self.ids, self.x, self.coarse = ids[order], x[order], coarse[order]
        self.fine = statistics(self.x.astype(np.float64), LEVELS[1])
        self.edges = np.r_[np.arange(0, len(ids), CELL), len(ids)]
        self.least, self.most = _envelope(self.coarse, self.edges)
        self.norm = float(np.linalg.norm(self.x.astype(np.float64), axis=1).max())


class Queries:
    """A block of queries."""

    KEYS = ("ids", "v", "kth")

    def __init__(self, ids: np.ndarray, v: np.ndarray, kth: np.ndarray):
        self.ids, self.v, self.kth = ids, v, kth
        self.coarse, self.fine = (statistics(v.astype(np.float64), n) for n in LEVELS)
        self.norm = float(np.linalg.norm(v.astype(np.float64), axis=1).max(initial=0.0))


def first_scores(ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """The k-th score of each query among the other rows of its own block, which are candidates too: no k-th score is below it."""
    scores = _exact(v, v).astype(np.float64)
    scores[ids[:, None] == ids[None, :]] = -np.inf
    return np.sort(scores, axis=1)[:, -k] if len(ids) >= k else np.full(len(ids), -np.inf)


def search(q: Queries, rows: Rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, row, score of each query's k best of the rows, its own id excepted, as far as they reach its first k-th score; ties to the smaller id."""
    # rounding of the bounds, far above what float64 loses here
    slack = 1e-9 * (1 + q.norm * rows.norm)
    limit = q.kth - slack
    best_score, best_id = np.full((len(q.ids), k), -np.inf), np.full((len(q.ids), k), np.iinfo(np.int64).max)
    # a cell's bound: each query value times the envelope's end that suits it; deviations aren't negative
    up = np.maximum(q.coarse, 0) @ rows.most.T + np.minimum(q.coarse, 0) @ rows.least.T
    for c in np.argsort(-up.max(axis=0), kind="stable"):
        part = slice(int(rows.edges[c]), int(rows.edges[c + 1]))
        size = part.stop - part.start
        who = np.flatnonzero(up[:, c] >= limit)
        for at in range(0, len(who), max(1, PAIRS // size)):
            w = who[at : at + max(1, PAIRS // size)]
            a, b = np.nonzero(q.coarse[w] @ rows.coarse[part].T >= limit[w, None])
            if not len(a):
                continue
            if 4 * len(a) < len(w) * size:  # few pairs: the finer bound, then the rest one by one
                keep = np.einsum("pd,pd->p", q.fine[w[a]], rows.fine[part][b]) >= limit[w[a]]
                a, b = a[keep], b[keep]
                score = np.einsum("pd,pd->p", q.v[w[a]], rows.x[part][b]).astype(np.float64)
            else:  # bounds save nothing here: all at once
                score = _exact(q.v[w], rows.x[part])[a, b].astype(np.float64)
            keep = (score >= q.kth[w[a]]) & (q.ids[w[a]] != rows.ids[part][b])
            a, b, score = a[keep], b[keep], score[keep]
            if not len(a):
                continue
            ids = rows.ids[part][b]
            order = np.lexsort((ids, -score, a))
            a, ids, score = a[order], ids[order], score[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            top = place < k
            hit = np.unique(a)
            new_score, new_id = np.full((len(hit), 2 * k), -np.inf), np.full((len(hit), 2 * k), np.iinfo(np.int64).max)
            new_score[:, :k], new_id[:, :k] = best_score[w[hit]], best_id[w[hit]]
            row = np.searchsorted(hit, a[top])
            new_score[row, k + place[top]], new_id[row, k + place[top]] = score[top], ids[top]
            order = np.lexsort((new_id, -new_score), axis=1)[:, :k]
            best_score[w[hit]], best_id[w[hit]] = np.take_along_axis(new_score, order, 1), np.take_along_axis(new_id, order, 1)
            limit[w[hit]] = np.maximum(limit[w[hit]], best_score[w[hit], -1] - slack)
    a, b = np.nonzero(best_score > -np.inf)
    return q.ids[a], best_id[a, b], best_score[a, b].astype(np.int64)


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v, floor(256 * x) of each component; rows with a null id or vector, or a null or non-finite component, go."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query row with the other rows.

    Queries are the rows whose vec_id is divisible by `every`; of rows that bear
    one id the smallest vector, component by component, is the query. Vectors
    that are null or hold a null or non-finite component take no part, nor do
    rows with a null id; vectors of different lengths aren't compared. Ties go to
    the smaller vec_id. All rows that bear the query's id are its own; a repeated
    id among the candidates counts once for each row. No queries or no candidates
    give no rows. Components are taken to be small enough for sums in 64-bit
    integers, scores to be below 2**53.
    """
    rows = checkpoint(quantised(vectors).withColumn("dim", F.size("v")))
    asked = checkpoint(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    folder = fresh_folder(vectors.sparkSession, "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def read(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids, v = t.column("vec_id").to_numpy(), t.column("v")
        flat = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v).flatten().to_numpy(zero_copy_only=False)
        return ids, flat.reshape(len(ids), -1)

    def write(t: pa.Table) -> pa.Table:
        ids, v = read(t)
        dim, block = v.shape[1], t.column("block")[0].as_py()
        arrays.save(folder, f"block-{dim}-{block}", {"ids": ids, "v": v, "kth": first_scores(ids, v, k)})
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int32())})

    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    written = asked.groupBy("dim", "block").applyInArrow(write, "dim int, block int").collect()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims):
                mine = Rows(*read(table.filter(pa.array(dims == dim))))
                for b in sorted(r["block"] for r in written if r["dim"] == dim):
                    got = arrays.load(folder, f"block-{dim}-{b}", Queries.KEYS)
                    a, i, s = search(Queries(*(np.asarray(got[c]) for c in Queries.KEYS)), mine, k)
                    if len(a):
                        yield pa.RecordBatch.from_pydict({"query_id": a, "vec_id": i, "score": s})

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= HOLD:
                yield from flush()
        if held:
            yield from flush()

    found = rows.select("dim", "vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = {
    "op7_topk": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score FROM e q JOIN e x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 5"""
}
QUERIES = {"op7_topk": op7_topk}
