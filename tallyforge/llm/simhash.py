"""SimHash near-duplicates: fingerprints embedded by the bit counts of their segments, a grid range join, exact verification.

1. A text's fingerprint has the bits that over half the hashes of its word
   shingles have. Equal fingerprints are one point, however many texts bear it.
2. A fingerprint's 64 bits are FIELDS segments of WIDTH bits; their bit counts
   are a point on a grid, and the Manhattan distance of two points is a lower
   bound of the number of bits in which the fingerprints differ. The segments
   fall into groups: of fingerprints that differ in few enough bits, the counts
   of one group are at a distance of 2 or less. Two points that near have a
   grid point in common within 1 of both, so that each fingerprint is put into
   the cells within 1 of its own, in each group, and candidates share a cell.
3. What shares a cell is compared bit by bit, and each cell gives a star for
   each set of members that hang together. A cell of more than SLICE members is
   cut into slices, each pair of which is a task's piece of work.
4. Connected components of the stars are those of the links.

No candidate is left out: the bound never drops a true pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, slices
from .components import components

BITS = 64
SEED = 42
#: Bits of a segment.
WIDTH = 2
FIELDS = BITS // WIDTH
#: Members of a cell, or of a slice of one, that are compared together.
SLICE = 8192
#: Cells of at most so many members are compared many at once, so many pairs at a time.
SMALL, PAIRS = 64, 1 << 21
#: Hashes of one text whose bits are counted at a time.
STEP = 1 << 16


def fingerprint(text: bytes, width: int = 4) -> int:
    """The fingerprint of a text's shingles of `width` words, repeats counted; fewer words are one shingle, none give zero."""
    words = text.lower().split()  # of bytes: A-Z, and the six separators
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(width, len(words))
    starts, ends = (ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), STEP):
        part = [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at : at + STEP], ends[at : at + STEP], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """The columns of docs but text, with the text's fingerprint as a signed 64-bit number (`fp`); docs has no such column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in part.column("text")], np.uint64)
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in part.schema.names if c != "text"} | {"fp": made.view(np.int64)})

    kept = [f"`{c}` {t}" for c, t in docs.drop("text").dtypes]
    return docs.mapInArrow(run, ", ".join([*kept, "fp long"]))


def groups_of(bits: int) -> int:
    """Into how many groups the segments fall, so that the counts of one of them are at a distance of 2 at most."""
    if not 0 <= bits < 12:
        raise ValueError("fingerprints of 64 bits are joined at 0 to 11 differing bits")
    return 2 if bits < 6 else 4


def cells(points: DataFrame, bits: int) -> DataFrame:
    """cell, fp: each fingerprint in the cells within 1 of the counts of each group of its segments."""
    groups = groups_of(bits)
    size, low = BITS // groups, sum(1 << k for k in range(0, BITS // groups, WIDTH))
    here: list[Column] = []
    for g in range(groups):
        half = F.shiftrightunsigned("fp", g * size).bitwiseAND(F.lit((1 << size) - 1))
        # WIDTH is 2: a field's two bits become their number
        count = half.bitwiseAND(F.lit(low)) + F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(low))
        own = F.col(f"_v{g}")
        points = points.withColumn(f"_v{g}", count)
        near = [own]
        for k in range(0, size, WIDTH):
            field = F.shiftrightunsigned(own, k).bitwiseAND(F.lit((1 << WIDTH) - 1))
            near += [F.when(field < WIDTH, own + (1 << k)), F.when(field > 0, own - (1 << k))]
        here += [n + (g << size) if g else n for n in near] if size < 62 else near
    return points.select(F.explode(F.array_compact(F.array(*here))).alias("cell"), "fp")


def stars(group: np.ndarray, points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): a link of each point to another one of those it hangs together with, within runs of equal `group`; none for one that leads its set."""
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(1, np.int64)
    at, sizes = edges[:-1], np.diff(edges)
    label = np.arange(len(points))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
        i, j = np.triu_indices(m, 1)
        own = at[sizes == m]
        step = max(1, PAIRS // len(i))
        for k in range(0, len(own), step):
            base = own[k : k + step, None]
            near = np.bitwise_count(points[base + i] ^ points[base + j]) <= bits
            one, two = np.nonzero(near)
            left.append(base[one, 0] + i[two])
            right.append(base[one, 0] + j[two])
    a, b = np.concatenate(left), np.concatenate(right)
    while len(a) and (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
    for k, m in zip(at[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        # from one member to those near it, and on from them, until none is near; each one reached leaves the rest
        rest, mine = np.arange(k, k + m), points[k : k + m]
        while len(rest):
            lead, rest, mine = rest[0], rest[1:], mine[1:]
            wave = [lead]
            while wave and len(rest):
                near = np.bitwise_count(mine ^ points[wave.pop()]) <= bits
                if near.any():
                    found = rest[near]
                    label[found] = lead
                    wave.extend(found.tolist())
                    rest, mine = rest[~near], mine[~near]
    off = np.flatnonzero(label != np.arange(len(points)))
    return points[off], points[label[off]]


def links(points: DataFrame, bits: int) -> DataFrame:
    """a, b: pairs of fingerprints (fp, distinct) that hang together by links of at most `bits` differing bits, enough to join all of them."""
    dealt = cells(points, bits)
    large = checkpoint(dealt.groupBy("cell").agg(F.count("*").alias("m")).where(F.col("m") > SLICE))
    key = ["cell"]
    if not large.isEmpty():
        cut = large.select("cell", F.ceil(F.col("m") / SLICE).cast("int").alias("k"))
        dealt = dealt.join(cut, "cell", "left").withColumn("k", F.coalesce("k", F.lit(1)))
        dealt = dealt.withColumn("s", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
        dealt = dealt.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        # two slices meet in one piece; one alone only if there is no other
        dealt = dealt.where("s <> t OR k = 1").select("cell", F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y"), "fp")
        key = ["cell", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            parts = [table.column(c).to_numpy() for c in key]
            turn = np.zeros(table.num_rows, bool)
            for x in parts:
                turn[1:] |= x[1:] != x[:-1]
            # the last piece may go on in the next batch
            to = table.num_rows if whole else int(np.flatnonzero(turn)[-1]) if turn.any() else 0
            held[:] = table.slice(to).combine_chunks().to_batches()
            if to:
                a, b = stars(np.cumsum(turn[:to]), table.column("fp").to_numpy()[:to].view(np.uint64), bits)
                yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * SLICE:
                yield from flush(False)
        if held:
            yield from flush(True)

    return checkpoint(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs (doc_id, text and any other columns).

    Fingerprints that differ in at most `bits` bits link; component_id is the
    smallest doc_id reachable. Texts that are null, empty or without words have
    the fingerprint zero, which links like any other. Rows that repeat an id are
    one node with the links of all their texts. A row without an id links others,
    but has a null component_id, as a null names none. An empty table gives an
    empty result.
    """
    signed = checkpoint(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width))
    points = checkpoint(signed.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    several = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    same = signed.join(several, "doc_id").where("fp <> lo").select(F.col("fp").alias("a"), F.col("lo").alias("b"))
    roots = components(links(points.select("fp"), bits).unionByName(same)).withColumnRenamed("id", "fp")
    linked = checkpoint(points.join(roots, "fp"))
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    named = points.join(linked.join(least, "component").select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "rep").alias("least"))
    # written first, so that both sides of the join are plain shuffles, whose large partitions Spark splits
    out = signed.join(checkpoint(named), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("least")).alias("component_id"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, bits=4)


#: SQL has no XXH64; tests hold the query against a brute-force version.
SQL: dict[str, str] = {}
QUERIES = {"op12_simhash": op12_simhash}
