"""Ranked lexical search: the best documents of each query, by bounds on their scores (no random access).

1. The queries' terms go into sorted shards, the queries into blocks of files.
2. One pass over the documents keeps of each its length and its counts of terms
   that some query has. Sums over that give the number of documents, of terms,
   and each term's documents, and so its weight.
3. A task takes documents in shards of bounded size. A shard has a list for each
   term, its documents in falling order of impact (what they add to a score).
   For each query the lists of its terms are read in step, from the highest
   impacts down. What a document has been seen with is the lower bound of its
   score; that and the last impacts read in the lists where it wasn't seen are
   the upper bound. Once the sum of the last impacts is below the k-th best
   lower bound no other document can come in, and those whose upper bound falls
   below it go. Reading ends when every document left has equal bounds, so that
   members, ties and scores are final.
4. The best of all shards are ranked together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays
from .common import fresh_folder, slices, utf8, word_hashes

#: Bytes that aren't part of a term: all of ASCII but digits and letters.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Queries of a block, query terms of a shard, and documents and counts of a shard of documents.
BLOCK, TERMS, DOCS, COUNTS = 256, 1 << 20, 1 << 16, 1 << 22


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each term of the texts (A-Z as a-z), and each text's first term."""
    return word_hashes(data, offsets, between=BETWEEN)


def _counts(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, hash, count of the distinct pairs, in order."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, np.int64)
    return r[at], h[at], np.diff(np.r_[at, len(h)])


def _lists(row: np.ndarray, values: np.ndarray, rows: int) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, values)


def _flat(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)


def _write_queries(items: DataFrame, folder: str) -> tuple[int, int, DataFrame]:
    """Blocks of queries as files (ids; starts, hash, times of their terms): (their number, bits of a term's shard, the distinct hashes)."""
    items = items.where(F.col("item_id").isNotNull()).groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    blocks = max(1, -(-items.count() // BLOCK))

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("item_id")
        hashes, first = terms_of(*utf8(table.column("text").combine_chunks()))
        row, h, times = _counts(hashes, np.repeat(np.arange(table.num_rows), np.diff(first)))
        starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=table.num_rows))])
        arrays.save(folder, f"block-{table.column('block')[0].as_py()}", {"ids": table.column("item_id").to_numpy(), "starts": starts, "hash": h, "times": times})
        return pa.table({"h": np.unique(h).view(np.int64)})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    made = fresh_folder(items.sparkSession, "query-terms")
    dealt.groupBy("block").applyInArrow(write, "h long").write.parquet(made)
    terms = items.sparkSession.read.parquet(made).distinct()
    return blocks, max(0, math.ceil(math.log2(max(1, terms.count()) / TERMS))), terms


def _write_shards(terms: DataFrame, folder: str, bits: int, value: str) -> None:
    """h and a column of whole numbers as sorted shards by the first bits of h."""

    def write(table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        shard = table.column("shard")[0].as_py()
        arrays.save(folder, f"shard-{shard}", {"hash": h[order], value: table.column(value).to_numpy()[order]})
        return pa.table({"shard": pa.array([shard], pa.int32())})

    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    terms.select("h", F.col(value).cast("long").alias(value), shard.alias("shard")).groupBy("shard").applyInArrow(write, "shard int").count()


def _postings(docs: DataFrame, folder: str, bits: int) -> DataFrame:
    """doc_id, n (terms), terms and counts (of the queries' terms alone) of the documents with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = arrays.sorted_shards(folder, bits, "there")
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = terms_of(*utf8(part.column("text")))
                n = np.diff(first)
                row, h, times = _counts(hashes, np.repeat(np.arange(len(n)), n))
                asked = known.find(h) >= 0
                row, h, times = row[asked], h[asked], times[asked]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n": n, "terms": _lists(row, h.view(np.int64), len(n)), "counts": _lists(row, times.astype(np.int64), len(n))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, terms array<long>, counts array<long>").where("n > 0")


def length_factor(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 - 75 + (75 * n * docs) div total, also where the product has more than 63 bits."""
    if len(n) and 75 * int(n.max()) * docs >= 1 << 63:
        return np.array([25 + 75 * int(x) * docs // total for x in n], np.int64)
    return 25 + 75 * n * docs // max(1, total)


class Shard:
    """Documents (ids, in any order) with a list for each term: places of documents and impacts, the highest first."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        order = np.lexsort((-impacts, terms))
        self.ids, self.doc, self.impacts = ids, doc[order], impacts[order]
        self.terms, at = np.unique(terms[order], return_index=True)
        self.edges = np.append(at, len(order))

    def lists(self, hashes: np.ndarray, times: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Documents and impacts, times the query's repeats, of those of the terms that occur here and weigh anything."""
        at = np.searchsorted(self.terms, hashes)
        out = []
        for t, h, m in zip(at.tolist(), hashes, times.tolist(), strict=True):
            if t < len(self.terms) and self.terms[t] == h and self.impacts[self.edges[t]] > 0:
                s = slice(self.edges[t], self.edges[t + 1])
                out.append((self.doc[s], self.impacts[s] * m))
        return out


def best(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best documents with a score above 0, in order, ties by id; lists as Shard.lists() gives them.

    Reads all lists in step by falling impact, half as far down each round.
    """
    lower = np.zeros(len(ids), np.int64)
    read = np.zeros(len(lists), np.int64)
    rising = [-impacts for _, impacts in lists]
    last = np.array([impacts[0] for _, impacts in lists], np.int64)
    down = int(last.max(initial=0))
    left: np.ndarray | None = None  # the documents that may be among the best; None: any
    stays = np.ones(len(ids), bool)
    while True:
        down //= 2
        for t, (doc, impacts) in enumerate(lists):
            to = int(np.searchsorted(rising[t], -down, side="right")) if down else len(doc)
            if to > read[t]:
                d, x = doc[read[t] : to], impacts[read[t] : to]
                if left is not None:
                    d, x = d[stays[d]], x[stays[d]]
                lower[d] += x
                read[t] = to
                last[t] = impacts[to] if to < len(doc) else 0
        total = int(last.sum())
        seen = np.flatnonzero(lower) if left is None else left
        kth = int(np.partition(lower[seen], len(seen) - k)[len(seen) - k]) if len(seen) >= k else 0
        if left is None and total and total >= kth:
            continue
        # what a document was seen with no longer counts into its upper bound
        upper = np.full(len(ids), total, np.int64)
        if total:
            for t, (doc, _) in enumerate(lists):
                if last[t]:
                    upper[doc[: read[t]]] -= last[t]
        left = seen[(lower + upper)[seen] >= max(kth, 1)]
        if not upper[left].any():
            break
        stays = np.zeros(len(ids), bool)
        stays[left] = True
    order = left[np.lexsort((ids[left], -lower[left]))][:k]
    return order, lower[order]


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: of each item (item_id, text) the k documents (doc_id, text) with the highest scores above 0.

    Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z
    as a-z. A term's weight is floor(1000 * ln((2 * N + 2) / (2 * df + 1))); a
    document with tf of it adds weight * ((10**9 * tf) div (1000 * tf + 8 * m)),
    m being 25 + (75 * n * N) div L, for each time that the item has it. Ties go
    to the smaller doc_id. Texts that are null or without terms aren't counted
    and match nothing. Rows of documents that repeat an id are documents of
    their own; one without an id counts into N, L and df, but isn't ranked. Of
    items with one id the smallest text is asked; those without an id aren't.
    No documents or no items give no rows. Terms are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    folder, weights = fresh_folder(spark, "queries"), fresh_folder(spark, "weights")
    blocks, bits, terms = _write_queries(items, folder)
    _write_shards(terms.withColumn("there", F.lit(1)), folder, bits, "there")
    kept = fresh_folder(spark, "postings")
    _postings(docs, folder, bits).write.parquet(kept)
    postings = spark.read.parquet(kept)
    size, total = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = postings.select(F.explode("terms").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln((2.0 * size + 2) / (2 * F.col("df") + 1)))
    _write_shards(found.withColumn("w", weight), weights, bits, "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = arrays.sorted_shards(weights, bits, "w")
        held: list[pa.RecordBatch] = []
        counts = rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            ids = table.column("doc_id").to_numpy()
            lengths = pc.list_value_length(table.column("terms")).to_numpy()
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
            h, tf = _flat(table.column("terms")).view(np.uint64), _flat(table.column("counts"))
            m = length_factor(table.column("n").to_numpy(), size, total)[doc]
            own, back = np.unique(h, return_inverse=True)
            shard = Shard(ids, doc, h, known.find(own)[back] * (10**9 * tf // (1000 * tf + 8 * m)))
            for b in range(blocks):
                if not arrays.exists(folder, f"block-{b}", "ids"):
                    continue
                asked = {c: np.asarray(a) for c, a in arrays.load(folder, f"block-{b}", ("ids", "starts", "hash", "times")).items()}
                out = []
                for item, lo, hi in zip(asked["ids"].tolist(), asked["starts"][:-1].tolist(), asked["starts"][1:].tolist(), strict=True):
                    lists = shard.lists(asked["hash"][lo:hi], asked["times"][lo:hi])
                    if lists:
                        place, score = best(lists, ids, k)
                        out.append((np.full(len(place), item), ids[place], score))
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(("item_id", "doc_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):  # long documents have many counts
                part = batch.slice(at, 1024)
                more = len(part.column("terms").flatten())
                if held and (rows + part.num_rows > DOCS or counts + more > COUNTS):
                    yield from flush()
                    counts = rows = 0
                held.append(part)
                counts, rows = counts + more, rows + part.num_rows
        if rows:
            yield from flush()

    hits = postings.where("doc_id IS NOT NULL").mapInArrow(run, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
SQL = {
    "op13_lexical": f"""
WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY doc_id),
z AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t WHERE term IN (SELECT term FROM q) GROUP BY term), z),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
    FROM t JOIN w USING (term) JOIN q USING (term) JOIN d USING (doc_id), z GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0)
SELECT item_id, k::INTEGER AS rank, doc_id, score FROM r WHERE k <= 10"""
}
QUERIES = {"op13_lexical": op13_lexical}
