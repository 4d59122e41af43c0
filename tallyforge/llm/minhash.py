"""Near-duplicate documents: banded MinHash, Odd Sketches, exact confirmation.

1. Each text becomes its set of word shingles, K minimum hashes of the set,
   BANDS bucket keys of ROWS minima each, and an Odd Sketch: the minima hashed
   into a bitmap of BITS parities. Texts with the same set fall into one class,
   by its size and a 128-bit fingerprint, and only the class goes on, under a
   number of its own. Classes that an id's rows have in common are linked.
2. In each bucket the members are paired with the one of the smallest id alone. The
   population count of the XOR of two sketches estimates how many minima
   differ; pairs far below the threshold go. So do pairs whose whole sets,
   folded into parities alike, differ in more bits than the threshold allows
   shingles. The others' full sets are compared.
3. The links give components. If a bucket whose members are in more than one
   component holds more than CELL, up to PIVOTS rounds draw another member of each bucket by a hash, and
   compare each member of another component with the nearest one it met. What is still apart then is gone
   through pair by pair, by sketch and by full sets. After that no pair that
   shares a bucket can lack a link that would change the components, and pairs
   within one component are never made.

A pair of the threshold's similarity misses all buckets with a probability of
(1 - 0.8**ROWS)**BANDS, about 1e-7, and is discarded by its sketch more rarely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, mix, row_hash, slices, unused, utf8, word_hashes
from .components import components

ROWS, BANDS = 5, 40
K = ROWS * BANDS
BITS = 1024
#: Bits of the parities of a whole set, which bound how many shingles two sets don't share.
WHOLE = 2048
#: Pairs whose sketches estimate a similarity this far below the threshold aren't compared.
SLACK = 0.25
#: Rounds in which a bucket's members of other components are paired with one member, drawn by a hash.
PIVOTS = 1
#: Members of a bucket that one cell of the last round pairs with another's.
CELL = 4096
#: Ids, of 8 bytes each, that may be broadcast.
BROADCAST = 500_000
#: Members that a task of the last round takes together, about.
TOGETHER = 20_000

_seeds = mix(np.arange(1, 2 * K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A = (_seeds[:K].astype(np.uint32) | np.uint32(1))[None, :]
_B = _seeds[K:].astype(np.uint32)[None, :]
_PLACE = mix(np.arange(1000, 1000 + max(K, BANDS), dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a text of fewer words is one shingle, one without words none."""
    words, first = word_hashes(data, offsets)
    total = np.full(len(words), 0x243F6A8885A308D3, np.uint64)
    for k in range(width):
        if k < len(words):
            total[: len(words) - k] = mix(total[: len(words) - k] * np.uint64(0x9E3779B97F4A7C15) + words[k:])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for w in words[a:b]:
                short = mix(short * np.uint64(0x9E3779B97F4A7C15) + w)
            out.append(mix(short + np.uint64(1)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(hashes: np.ndarray) -> np.ndarray:
    """The K minimum hashes of a set that isn't empty."""
    x = ((hashes >> np.uint64(32)) ^ hashes).astype(np.uint32)[:, None]
    best = np.full(K, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(best, ((x[at : at + 256] ^ _B) * _A).min(axis=0), out=best)
    return best


def odd_sketches(least: np.ndarray) -> np.ndarray:
    """A bitmap of BITS parities for each row of minima, as int64 words."""
    n = len(least)
    place = (mix(least.astype(np.uint64) + _PLACE[None, :K]) % np.uint64(BITS)).astype(np.int64)
    place += np.arange(n)[:, None] * BITS
    odd = (np.bincount(place.ravel(), minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS)
    return np.packbits(odd, axis=1).view(np.int64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """WHOLE parities of each set, as int64 words: two sets differ in at least as many shingles as these in bits."""
    n = len(sets)
    sizes = [len(s) for s in sets]
    place = (np.concatenate(sets) & np.uint64(WHOLE - 1)).astype(np.int64) if n else np.zeros(0, np.int64)
    place += np.repeat(np.arange(n) * WHOLE, sizes)
    odd = (np.bincount(place, minlength=n * WHOLE) & 1).astype(np.uint8).reshape(n, WHOLE)
    return np.packbits(odd, axis=1).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    grouped = least.reshape(len(least), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(_PLACE[:BANDS], (len(least), BANDS)).copy()
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, k])
    return key.view(np.int64)


def most_different(threshold: float) -> int:
    """The XOR population count at an estimated similarity of threshold - SLACK."""
    apart = 2 * K * (1 - max(0.0, threshold - SLACK))
    return math.ceil(BITS / 2 * (1 - math.exp(-2 * apart / BITS)))


#: What names a class of texts with the same set.
FINGERPRINT = ["n_shingles", "f1", "f2"]
SIGNED = "n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>, whole array<long>"


def _fingerprints(sets: list[np.ndarray]) -> dict[str, np.ndarray]:
    total = lambda key: np.array([mix(s ^ np.uint64(key)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
    return {"n_shingles": np.array([len(s) for s in sets], np.int64), "f1": total(0), "f2": total(0xA4093822299F31D0)}


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """The columns of docs but text, with set size, fingerprint, band keys and Odd Sketch of the text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*utf8(part.column("text")), width)
                full = np.flatnonzero([len(s) for s in sets])
                least = np.array([minima(sets[i]) for i in full], np.uint32).reshape(len(full), K)
                bands, sketch = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), BITS // 64), np.int64)
                bands[full], sketch[full] = band_keys(least), odd_sketches(least)
                rows = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
                same = {c: part.column(c) for c in part.schema.names if c != "text"}
                yield pa.RecordBatch.from_pydict(same | _fingerprints(sets) | {"bands": rows(bands), "sketch": rows(sketch), "whole": rows(parities(sets))})

    kept = ", ".join(f"{c} {t}" for c, t in docs.drop("text").dtypes)
    return docs.mapInArrow(run, f"{kept}, {SIGNED}")


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """The fingerprint and the full set of shingle hashes of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*utf8(part.column("text")), width)
                ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict(_fingerprints(sets) | {"hashes": pa.ListArray.from_arrays(ends, flat)})

    return docs.select("text").mapInArrow(run, "n_shingles long, f1 long, f2 long, hashes array<long>")


def _apart(a: str, b: str, bits: int = BITS) -> Column:
    """Bits in which two sketches differ."""
    total = F.lit(0)
    for k in range(bits // 64):
        total = total + F.bit_count(F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k))))
    return total


def confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets have percent or more of their union in common.

    A class's set is that of a row with its smallest id; as an id may have
    several texts, the fingerprint says which row it is.
    """
    asked = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(classes, "id"))
    few = asked.count() <= BROADCAST  # few ids go to the texts; many meet them by a shuffle
    small = lambda x: F.broadcast(x) if few else x
    texts = docs.join(small(asked.select(F.col("rep").alias("_rep")).distinct()), F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    sets = checkpoint(sets_of(texts, width).join(small(asked.select("id", *FINGERPRINT)), FINGERPRINT).select("id", "hashes").dropDuplicates(["id"]))
    got = pairs.join(sets.withColumnsRenamed({"id": "b", "hashes": "hb"}), "b").join(sets.withColumnsRenamed({"id": "a", "hashes": "ha"}), "a")
    both = F.size(F.array_intersect("ha", "hb")).cast("long")
    return got.where(100 * both >= percent * (F.size("ha") + F.size("hb") - both)).select("a", "b")


def _near_in_cell(c: np.ndarray, part: np.ndarray, n: np.ndarray, sketch: np.ndarray, whole: np.ndarray, own: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near pairs of different components: within a part's own cell, else of one part with the other."""
    if own:  # those outside the cell's largest component with all
        kinds, back, sizes = np.unique(c, return_inverse=True, return_counts=True)
        most = kinds[sizes.argmax()]
        left, right = np.flatnonzero(back != sizes.argmax()), np.arange(len(c))
    else:
        left, right = np.flatnonzero(part == part.min()), np.flatnonzero(part != part.min())
    bits = lambda x, i, j: np.bitwise_count(x[i] ^ x[j]).sum(axis=-1, dtype=np.int64)
    found = []
    for at in range(0, len(left), 64):
        i, j = (x.ravel() for x in np.meshgrid(left[at : at + 64], right, indexing="ij"))
        keep = (c[i] != c[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        if own:
            keep &= (i < j) | (c[j] == most)
        i, j = i[keep], j[keep]
        keep = (100 + percent) * bits(whole, i, j) <= (100 - percent) * (n[i] + n[j])
        i, j = i[keep], j[keep]
        keep = bits(sketch, i, j) <= most_different(percent / 100)
        found.append((i[keep], j[keep]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)])


def _dealt(open_: DataFrame) -> DataFrame:
    """key, id, c, s (slice), x, y (cell), g (group) of the members of each bucket.

    A bucket of CELL members is one cell. In a larger one the members outside
    its largest component are cut into slices of about CELL, then those of the
    largest, and a slice of the former meets every slice, itself included; no
    cell holds two slices of the largest component. So k members outside it,
    of m in all, make about k * m / CELL rows and m at least. A cell that may
    hold more than CELL / 4 rows is a group of its own, of some 2 * CELL rows
    at most; the rest share groups of about TOGETHER rows.
    """
    sizes = open_.groupBy("key", "c").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("m"), F.max(F.struct("n", "c")).alias("top"))
    sizes = checkpoint(sizes.select("key", "m", F.col("top.n").alias("n"), F.col("top.c").alias("most")))
    small = F.col("m") <= CELL
    few, many = F.when(small, 1).otherwise(F.ceil((F.col("m") - F.col("n")) / CELL)).cast("int"), F.when(small, 0).otherwise(F.ceil(F.col("n") / CELL)).cast("int")
    sizes = sizes.select("key", "m", "most", few.alias("few"), many.alias("many"))
    shared = sizes.where(F.col("m") <= CELL // 4).agg(F.sum("m")).first()[0] or 0
    groups = max(1, -(-shared // TOGETHER))
    aside = (F.col("m") > CELL) & (F.col("c") == F.col("most"))
    of = lambda k: F.pmod(F.xxhash64("id"), F.greatest(k, F.lit(1))).cast("int")
    dealt = open_.select("key", "id", "c").join(sizes, "key")
    dealt = dealt.withColumn("s", F.when(aside, F.col("few") + of(F.col("many"))).otherwise(of(F.col("few"))))
    dealt = dealt.withColumn("t", F.explode(F.sequence(F.lit(0), F.when(aside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)))
    dealt = dealt.withColumns({"x": F.least("s", "t"), "y": F.greatest("s", "t")})
    cell = F.xxhash64("key", "x", "y")
    return dealt.select("key", "id", "c", "s", "x", "y", F.when(F.col("m") > CELL // 4, cell).otherwise(F.pmod(cell, F.lit(groups))).alias("g"))


def _across(open_: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The near pairs of members of different components of each bucket, which is dealt out in cells."""
    dealt = _dealt(open_).join(reps.select("id", "n", "sketch", "whole"), "id")

    def pairs(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("x", "ascending"), ("y", "ascending")]).combine_chunks()
        key, x, y, ids, c, part, n = (table.column(k).to_numpy() for k in ("key", "x", "y", "id", "c", "s", "n"))
        wide = lambda k: table.column(k).combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), -1)
        sketch, whole = wide("sketch"), wide("whole")
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]), True])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            r = slice(lo, hi)
            i, j = _near_in_cell(c[r], part[r], n[r], sketch[r], whole[r], x[lo] == y[lo], percent)
            a.append(ids[r][i])
            b.append(ids[r][j])
        one, two = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(one, two), "b": np.maximum(one, two)})

    return checkpoint(dealt.groupBy("g").applyInArrow(pairs, "a long, b long").distinct())


def _of_one_id(signed: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, id (class) of the ids whose rows have more than one set; and links (a, b) that join an id's classes."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in FINGERPRINT for f in (F.min, F.max)]
    several = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*ends)
    several = several.where(" OR ".join(f"min_{c} <> max_{c}" for c in FINGERPRINT)).select("doc_id")
    texts = signed.where("n_shingles > 0").join(several, "doc_id", "left_semi").select("doc_id", *FINGERPRINT).distinct()
    texts = checkpoint(texts.join(classes, FINGERPRINT).select("doc_id", "id"))
    first = texts.groupBy("doc_id").agg(F.min("id").alias("a"))
    return texts, texts.join(first, "doc_id").where("id <> a").select("a", F.col("id").alias("b"))


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The columns of docs but text, with n_shingles, group (null: no words) and component_id; docs has doc_id, text and no column that signatures() makes."""
    signed = checkpoint(signatures(docs, width))
    texts = signed.where("n_shingles > 0")
    # rows of a class have the same sketches; each task sends one row of it
    reps = texts.groupBy(*FINGERPRINT).agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("bands", "sketch", "whole")])
    reps = checkpoint(reps.withColumn("id", F.monotonically_increasing_id()).withColumn("n", F.col("n_shingles")))
    classes = reps.select("id", "rep", *FINGERPRINT)
    repeated, links = _of_one_id(signed, classes)
    members = reps.select("id", "rep", F.explode("bands").alias("key"))
    buckets = checkpoint(members.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("m")).where("m > 1"))
    side = lambda x: mates.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), F.col("whole").alias(f"w{x}"))
    # sets of that similarity share all but (100 - percent) / (100 + percent) of their shingles
    few = (100 + percent) * _apart("wa", "wb", WHOLE) <= (100 - percent) * (F.col("na") + F.col("nb"))
    near = few & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (_apart("sa", "sb") <= most_different(percent / 100))
    crowded = checkpoint(members.join(buckets, "key"))
    # sketches of those that share a bucket at all
    mates = checkpoint(reps.select("id", "n", "sketch", "whole").join(crowded.select("id").distinct(), "id", "left_semi"))

    def linked(pairs: DataFrame, nearest: bool = False) -> DataFrame:
        close = pairs.distinct().join(side("b"), "b").join(side("a"), "a").where(near)
        if nearest:  # of the pivots that a member met
            close = close.groupBy("b").agg(F.min(F.struct(_apart("sa", "sb").alias("d"), F.col("a").alias("a"))).alias("p")).select("p.a", "b")
        return checkpoint(confirm(checkpoint(close.select("a", "b")), docs, classes, width, percent))

    # copies are mostly younger than what they were made from: the smallest doc_id is nearest to most
    first = crowded.where("rep <=> lead").groupBy("key").agg(F.min("id").alias("a"))
    links = links.unionByName(linked(crowded.join(first, "key").where("id != a").select("a", F.col("id").alias("b"))))
    roots = components(links)
    # buckets of three and more whose members aren't one component yet
    crowded = crowded.where("m > 2").drop("rep", "lead")
    for turn in range(PIVOTS + 1):
        named = crowded.join(roots, "id", "left").select("key", "id", "m", F.coalesce("component", "id").alias("c"))
        chosen = F.min(F.struct(F.xxhash64("id", "key", F.lit(turn)).alias("h"), F.col("id").alias("a"), F.col("c").alias("ca")))
        split = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), chosen.alias("p")).where("lo != hi").select("key", "p.a", "p.ca")
        open_ = checkpoint(named.join(split, "key"))
        largest = open_.agg(F.max("m")).first()[0]
        if largest is None:
            break
        last = turn == PIVOTS or largest <= CELL
        if not last:
            more = linked(open_.where("c != ca").select("a", F.col("id").alias("b")), nearest=True)
        else:
            more = checkpoint(confirm(_across(open_, mates, percent), docs, classes, width, percent))
        links = links.unionByName(more)
        roots = components(links)
        if last:
            break

    least = roots.join(classes, "id").groupBy("component").agg(F.min("rep").alias("least"))
    roots = roots.join(least, "component")
    named = classes.join(roots, "id", "left").select(*FINGERPRINT, F.coalesce("component", "id").alias("group"), F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("_least"))
    out = signed.drop("bands", "sketch", "whole").join(named, FINGERPRINT, "left")
    own = F.coalesce("_least", "doc_id")
    if not repeated.isEmpty():  # a row without words belongs to what its id's other rows belong to
        other = repeated.join(classes.join(roots, "id", "left"), "id").groupBy("doc_id").agg(F.min(F.coalesce("least", "rep")).alias("_other"))
        out, own = out.join(other, "doc_id", "left"), F.coalesce("_least", "_other", "doc_id")
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), own)).drop("f1", "f2", "_least", "_other")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text and any other columns).

    Texts are linked if their sets of `width`-word shingles (A-Z as a-z; fewer
    words make one shingle) have at least percent % of their union in common;
    component_id is the smallest doc_id reachable over links, and the rows that
    bear it are kept. Texts that are null, empty or without words have no
    shingles and no links. Equal sets always link. Rows that repeat an id are
    one node, with the links of all their texts. A row without an id links
    others, but has a null component_id, as a null names none, and is kept.
    An empty table gives an empty result.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = _labelled(ids, width, percent).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near_duplicates(), with all its columns; rows without words all stay.

    The row with the smallest doc_id stays, null last; of several with that id
    the one whose columns hash lowest; of equal rows one.
    """
    one, two, first, second = unused(docs, "row_one", "row_two", "other_one", "other_two")
    hashed = docs.withColumns({one: row_hash(docs, 0), two: row_hash(docs, 1)})
    same = (F.col(one) == F.col(first)) & (F.col(two) == F.col(second))
    rows = _labelled(hashed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(one).alias("one"), F.col(two).alias("two")), width, percent)
    rows = checkpoint(rows.where("group IS NOT NULL").select("group", "doc_id", "one", "two"))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "one", "two")).alias("best")
    groups = checkpoint(rows.groupBy("group").agg(best, F.count("*").alias("n")).where("n > 1").select("group", F.col("best.one").alias("b1"), F.col("best.two").alias("b2")))
    rows = checkpoint(rows.join(groups, "group"))
    named = lambda x: x.select(F.col("one").alias(first), F.col("two").alias(second))
    gone = named(rows.where("one <> b1 OR two <> b2")).distinct()
    # equal rows of which one stays
    twice = checkpoint(rows.where("one = b1 AND two = b2").groupBy("one", "two").agg(F.count("*").alias("m")).where("m > 1"))
    if twice.isEmpty():
        return hashed.join(_sized(gone), same, "left_anti").drop(one, two)
    single = hashed.join(_sized(gone.unionByName(named(twice))), same, "left_anti")
    return single.unionByName(hashed.join(_sized(named(twice)), same, "left_semi").dropDuplicates([one, two])).drop(one, two)


def _sized(keys: DataFrame) -> DataFrame:
    """keys, to be broadcast if they are few."""
    keys = checkpoint(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST else keys


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2, percent=80)


SQL = {
    "op1_near_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT s.doc_id, g, n FROM s JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM k a JOIN k b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
r AS (SELECT doc_id, doc_id AS x FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.x = e.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(x) AS component_id, doc_id = min(x) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n.n"""
}
QUERIES = {"op1_near_dedup": op1_near_dedup}
