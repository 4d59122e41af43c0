"""Removal of passages that occur anywhere else, by a sparse suffix array.

Every window of LENGTH bytes has an anchor: the GRAM bytes with the smallest
hash in it (the rightmost of equals). Equal windows have equal anchors at equal
places, so a passage that occurs twice is found by sorting only the suffixes
that start at anchors whose bytes occur twice. For those the bytes to the right
and, reversed, to the left are brought together by anchor, sorted by
deep-shallow sorting, and the common prefixes of neighbours tell, for each
place d of a window before its anchor, which windows are equal: those that
share d bytes to the left and LENGTH - d to the right.

Copies of a whole text are found by its hash first and searched once. The
surroundings of an anchor in more than HOT texts aren't sorted in one task:
they are split by the bytes that all windows of a range of d have in common, and
each part is sorted by itself. What still shares all of those bytes in more
than HOT different surroundings is split by the whole window, which leaves
nothing to sort, only to count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .common import checkpoint, fresh_folder, mix, slices, utf8
from .suffix_sort import deep_shallow_sort

LENGTH = 200
GRAM = 24
#: Texts (counted twice if an anchor stands in them twice) whose occurrences of one anchor, or part of it, a task sorts at most.
HOT = 50_000
#: Ranges of d by which a frequent anchor is split.
RANGES = 8
#: Occurrences that are sorted together, on average, and such groups in a task.
TOGETHER, GROUPS = 15_000, 4

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all windows of a text, and hashes of their bytes, evenly spread."""
    reach = length - GRAM + 1  # grams in a window
    grams = len(text) - GRAM + 1
    if len(text) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    raw = text.tobytes()
    eight = np.ndarray(len(text) - 7, "<u8", raw, strides=(1,))
    h = mix(eight[:grams] * _A + eight[8 : grams + 8] * _B + eight[16 : grams + 16] * _C)
    place = np.arange(grams, dtype=np.uint64)
    mask = np.uint64((1 << 28) - 1)
    # equal hashes: the rightmost is the smallest
    key = (h & ~mask) | (mask - (place & mask))
    # sliding minimum: running minima of blocks of `reach`, from the left and from the right
    full = -(-grams // reach) * reach
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:grams] = key
    blocks = padded.reshape(-1, reach)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: grams - reach + 1], left[reach - 1 : grams])
    fresh = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    # the place in the key is modulo 2**28; the window it was found in says the rest
    low = (mask - (least[fresh] & mask)).astype(np.int64)
    at = fresh + ((low - fresh) & int(mask))
    at = np.unique(at)
    # a window's smallest hash is small: mixed once more, it falls anywhere
    return at, mix(h[at] ^ _C)


def steady(text: np.ndarray, place: np.ndarray, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors that stand for all: of those whose surroundings come again at equal steps, the first; and how far from it the last is.

    So a text of one letter, with an anchor at every byte, has a few that stand
    for all. The windows of such a run cover one another's ends, so together
    they are one span.
    """
    alone = np.arange(len(place)), np.zeros(len(place), np.int64)
    if len(place) < 2:
        return alone
    step = np.diff(place)
    again = (anchor[1:] == anchor[:-1]) & (step <= length)
    if again.sum() < 64:
        return alone
    joined = np.zeros(len(step), dtype=bool)
    for s, n in zip(*np.unique(step[again], return_counts=True), strict=True):
        if n < 16:
            continue
        differ = np.r_[0, np.cumsum(text[s:] != text[:-s])]
        i = np.flatnonzero(again & (step == s) & (place[:-1] >= length) & (place[1:] + length <= len(text)))
        joined[i] = differ[place[i] + length] == differ[place[i] - length]
    # a pair that follows a run of another step begins anew
    joined[1:] &= ~(joined[:-1] & (step[1:] != step[:-1]))
    head = np.flatnonzero(np.r_[True, ~joined])
    last = np.r_[head[1:], len(place)] - 1
    return head, place[last] - place[head]


def _ends(place: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last place of each distinct anchor."""
    order = np.argsort(anchor, kind="stable")
    a = anchor[order]
    edge = np.r_[True, a[1:] != a[:-1]] | np.r_[a[1:] != a[:-1], True] if len(a) else np.zeros(0, dtype=bool)
    return place[order[edge]], a[edge]


def _scan(texts: DataFrame, length: int) -> DataFrame:
    """h1, h2, anchor, place: the anchors of each text (bytes in `raw`), of repeated ones the first and last place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "raw"):
                data, at = utf8(part.column("raw"))
                found = [_ends(*anchors(data[a:b], length)) for a, b in zip(at[:-1], at[1:], strict=True)]
                n = [len(f[0]) for f in found]
                of = np.repeat(np.arange(len(found)), n)
                if not len(of):
                    continue
                yield pa.RecordBatch.from_pydict({
                    "h1": part.column("h1").take(pa.array(of)), "h2": part.column("h2").take(pa.array(of)),
                    "anchor": np.concatenate([f[1] for f in found]).view(np.int64), "place": np.concatenate([f[0] for f in found]).astype(np.int64),
                })

    return texts.select("h1", "h2", "raw").mapInArrow(run, "h1 long, h2 long, anchor long, place long")


CONTEXT = "anchor long, left binary, right binary, members binary"


def _contexts(texts: DataFrame, length: int, folder: str, bits: int, hot: bool) -> DataFrame:
    """For each anchor of a text that occurs elsewhere: the bytes before it, reversed, and those from it on, as far as a window reaches.

    Anchors of a batch with the same surroundings make one row; its members are
    h1, h2 and, as one number, the place and how far the same surroundings go on
    at equal steps. Of the copies of a text that one task reads, the first is
    enough: a second one of them counts nowhere.
    """
    schema = pa.schema([("anchor", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("members", pa.binary())])

    def rows(found: dict[tuple, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"anchor": [k[0] for k in found], "left": [k[1] for k in found], "right": [k[2] for k in found], "members": [np.array(m, np.int64).tobytes() for m in found.values()]}, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = arrays.sorted_shards(folder, bits, "hot")
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "raw"):
                data, at = utf8(part.column("raw"))
                keys = list(zip(part.column("h1").to_pylist(), part.column("h2").to_pylist(), strict=True))
                mine = []
                for i, key in enumerate(keys):
                    if key not in seen:
                        seen.add(key)
                        text = data[at[i] : at[i + 1]]
                        place, anchor = anchors(text, length)
                        head, reach = steady(text, place, anchor, length)
                        mine.append((i, place[head], anchor[head], (place[head] << 32) + reach))
                if not mine:
                    continue
                kind = shared.find(np.concatenate([m[2] for m in mine]))
                ends = np.cumsum([0, *(len(m[1]) for m in mine)])
                found: dict[tuple, list[int]] = {}
                for (i, place, anchor, member), a, b in zip(mine, ends[:-1], ends[1:], strict=True):
                    take = kind[a:b] == int(hot)
                    if not take.any():
                        continue
                    raw = data[at[i] : at[i + 1]].tobytes()
                    for p, h, m in zip(place[take].tolist(), anchor[take].view(np.int64).tolist(), member[take].tolist(), strict=True):
                        found.setdefault((h, raw[max(0, p - length + GRAM) : p][::-1], raw[p : p + length]), []).extend((*keys[i], m))
                    if len(found) >= 8192:
                        yield rows(found)
                        found = {}
                if found:
                    yield rows(found)

    return texts.select("h1", "h2", "raw").mapInArrow(run, CONTEXT)


class Windows:
    """The equal windows of a set of contexts: matched[d, k] if the window that starts d bytes before kind k's anchor occurs again."""

    def __init__(self, anchor: np.ndarray, left: list[bytes], right: list[bytes], times: np.ndarray, length: int):
        head = [a.to_bytes(8, "big", signed=True) for a in anchor.tolist()]
        # occurrences with the same surroundings are of one kind; they match wherever a window fits
        kind: dict[tuple, int] = {}
        self.of = np.array([kind.setdefault(x, len(kind)) for x in zip(head, left, right, strict=True)], np.int64)
        times = np.bincount(self.of, times, minlength=len(kind))
        n = len(kind)
        rights, lefts = [h + r for h, _, r in kind], [h + x for h, x, _ in kind]
        by_right, common_right = deep_shallow_sort(rights)
        by_left, common_left = deep_shallow_sort(lefts)
        room_right, room_left = np.array([len(s) - 8 for s in rights]), np.array([len(s) - 8 for s in lefts])
        self.matched = np.zeros((length - GRAM + 1, n), dtype=bool)
        group_right, group_left = np.empty(n, np.int64), np.empty(n, np.int64)
        for d in range(length - GRAM + 1):
            # neighbours in order that have the bytes in common are of one group
            group_right[by_right] = np.cumsum(common_right < length - d + 8)
            group_left[by_left] = np.cumsum(common_left < d + 8)
            fits = np.flatnonzero((room_right >= length - d) & (room_left >= d))
            if not len(fits):
                continue
            _, group = np.unique(group_right[fits] * (n + 1) + group_left[fits], return_inverse=True)
            count = np.bincount(group, times[fits])
            self.matched[d, fits] = count[group] > 1

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kind, and where the bytes that each run of matched windows covers begin and end, from the anchor; in order of kinds."""
        edge = np.zeros((1, self.matched.shape[1]), dtype=bool)
        step = np.diff(np.concatenate([edge, self.matched, edge]).astype(np.int8), axis=0).T
        who, low = np.nonzero(step == 1)
        _, high = np.nonzero(step == -1)  # the first d that matches no more
        return who, 1 - high, length - low


SPAN = "h1 long, h2 long, start long, end long"


def _members(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All members, h1, h2, place, reach each; how many each row has; and how many occurrences, at most two for each member, those are."""
    blobs = column.to_pylist()
    sizes = np.array([len(m) // 24 for m in blobs], np.int64)
    flat = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 3)
    members = np.column_stack([flat[:, :2], flat[:, 2] >> 32, flat[:, 2] & 0xFFFFFFFF])
    row = np.repeat(np.arange(len(sizes)), sizes)
    return members, sizes, sizes + np.bincount(row, members[:, 3] > 0, len(sizes)).astype(np.int64)


def _spans(members: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    return {"h1": members[:, 0], "h2": members[:, 1], "start": members[:, 2] + start, "end": members[:, 2] + members[:, 3] + end}


def covered(table: pa.Table, length: int) -> pa.Table:
    """The spans of all members of a table of whole anchors."""
    members, sizes, times = _members(table.column("members"))
    found = Windows(table.column("anchor").to_numpy(), table.column("left").to_pylist(), table.column("right").to_pylist(), times, length)
    who, start, end = found.runs(length)
    of = np.repeat(found.of, sizes)
    # each member takes the runs of its kind
    first, last = np.searchsorted(who, of), np.searchsorted(who, of, side="right")
    n = last - first
    m = np.repeat(np.arange(len(members)), n)
    run = np.arange(len(m)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return pa.table(_spans(members[m], start[run], end[run]))


def _shared_anchors(texts: DataFrame, length: int, hot: int) -> tuple[str, int, int, bool]:
    """Writes the anchors that stand in two texts or at two places, in sorted shards: their folder and bits, the occurrences, and whether any is hot.

    Copies of a text give the same (text, place) and don't make an anchor
    shared. Each task adds up its own rows first, so that a frequent anchor
    sends one row from each.
    """
    folder = fresh_folder(texts.sparkSession, "anchors")
    bits = max(0, (texts.count() // 32_768).bit_length())
    where = F.xxhash64("h1", "h2", "place")
    shared = _scan(texts, length).groupBy("anchor").agg(F.min(where).alias("a"), F.max(where).alias("b"), F.count("*").alias("n")).where("a != b")
    shared = shared.select("anchor", "n", (F.shiftrightunsigned("anchor", 64 - bits) if bits else F.lit(0).cast("long")).cast("int").alias("shard"))

    def build(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        anchor, n = table.column("anchor").to_numpy().view(np.uint64), table.column("n").to_numpy()
        order = np.argsort(anchor)
        arrays.save(folder, f"shard-{shard}", {"hash": anchor[order], "hot": (n[order] > hot).astype(np.uint8)})
        return pa.table({"n": pa.array([int(n.sum())], pa.int64()), "hot": pa.array([bool((n > hot).any())])})

    made = shared.groupBy("shard").applyInArrow(build, "n long, hot boolean").agg(F.sum("n"), F.max("hot")).first()
    return folder, bits, made[0] or 0, bool(made[1])


def repeated(texts: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """h1, h2, spans: the parts of texts (h1, h2, raw; copies change nothing) covered by a window that occurs in another text or elsewhere in this one."""
    folder, bits, n, any_hot = _shared_anchors(texts, length, hot)
    buckets = max(1, -(-n // TOGETHER))

    around = _contexts(texts, length, folder, bits, False).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    # as many tasks as the occurrences need, whatever the session's number of shuffle partitions
    spans = around.repartition(-(-buckets // GROUPS), "bucket").groupBy("bucket").applyInArrow(lambda t: covered(t, length), SPAN)
    if any_hot:
        spans = spans.unionByName(_hot_windows(_contexts(texts, length, folder, bits, True), length, hot))
    return spans.groupBy("h1", "h2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


KIND = ["k1", "k2"]


def _hot_windows(around: DataFrame, length: int, hot: int) -> DataFrame:
    """The spans of very frequent anchors, without a task that holds all occurrences of one.

    For d from lo on and below hi, all windows hold the lo bytes before the
    anchor and the length - hi + 1 from it on; only surroundings that share
    these can match. Those that do make a part; equal ones in it are one kind
    with a number of occurrences, which Spark adds up in each task first. A
    part's kinds, without their members, are sorted by one task, and the runs
    found go to the members by the kind's hash.
    """
    cuts = [int(x) for x in np.linspace(0, length - GRAM + 1, RANGES + 1)]
    ranges = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    fits = F.greatest("lo", F.lit(length) - F.octet_length("right")) <= F.least(F.col("hi") - 1, F.octet_length("left"))
    head = lambda c, n: F.substring(c, F.lit(1), n)
    split = around.withColumn("r", F.explode(ranges)).select("anchor", "left", "right", "members", "r.lo", "r.hi").where(fits)
    part = F.xxhash64("anchor", "lo", head("left", F.col("lo")), head("right", length - F.col("hi") + 1))
    split = split.select("anchor", "lo", "hi", "members", part.alias("part"), head("left", F.col("hi") - 1).alias("left"), head("right", length - F.col("lo")).alias("right"))
    named = ("anchor", "lo", "left", "right", F.octet_length("left"))
    split = checkpoint(split.withColumns({"k1": F.xxhash64(*named), "k2": F.xxhash64(F.lit(1), *named)}))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = {c: batch.column(c) for c in batch.schema.names if c != "members"}
                yield pa.RecordBatch.from_pydict(same | {"times": _members(batch.column("members"))[2]})

    counted = split.select("part", "anchor", *KIND, "left", "right", "members").mapInArrow(count, "part long, anchor long, k1 long, k2 long, left binary, right binary, times long")
    kinds = checkpoint(counted.groupBy(*KIND, "part").agg(F.first("anchor").alias("anchor"), F.first("left").alias("left"), F.first("right").alias("right"), F.sum("times").alias("times")))
    sizes = kinds.groupBy("part").agg(F.count("*").alias("n"))
    large = checkpoint(sizes.where(F.col("n") > hot).select("part"))
    buckets = max(1, -(-kinds.count() // TOGETHER))

    def sort(table: pa.Table) -> pa.Table:
        found = Windows(table.column("anchor").to_numpy(), table.column("left").to_pylist(), table.column("right").to_pylist(), table.column("times").to_numpy(), length)
        who, start, end = found.runs(length)
        row = np.argsort(found.of)  # kinds are distinct: one row each
        k1, k2 = table.column("k1").to_numpy()[row], table.column("k2").to_numpy()[row]
        return pa.table({"k1": k1[who], "k2": k2[who], "start": start, "end": end})

    small = kinds.join(large, "part", "left_anti").withColumn("bucket", F.pmod("part", F.lit(buckets)))
    runs = small.groupBy("bucket").applyInArrow(sort, "k1 long, k2 long, start long, end long")
    spans = split.select(*KIND, "members").join(runs, KIND).select("members", "start", "end").mapInArrow(_member_spans, SPAN)
    if large.isEmpty():
        return spans
    # nothing left to sort: the whole window names the group
    rest = split.join(large, "part", "left_semi")
    rest = rest.withColumn("d", F.explode(F.sequence("lo", F.least(F.col("hi") - 1, F.octet_length("left"))))).where(F.octet_length("right") >= length - F.col("d"))
    before, after = head("left", F.col("d")), head("right", length - F.col("d"))
    rest = rest.select("members", "anchor", "d", F.xxhash64(before, after).alias("w1"), F.xxhash64(after, before, F.lit(7)).alias("w2"))
    keys = ["anchor", "d", "w1", "w2"]
    counted = rest.mapInArrow(count, "anchor long, d int, w1 long, w2 long, times long")
    again = counted.groupBy(*keys).agg(F.sum("times").alias("times")).where("times > 1").select(*keys)
    found = rest.join(again, keys, "left_semi").select("members", (-F.col("d")).cast("long").alias("start"), (F.lit(length) - F.col("d")).cast("long").alias("end"))
    return spans.unionByName(found.mapInArrow(_member_spans, SPAN))


def _member_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        if part.num_rows:
            members, sizes, _ = _members(part.column("members"))
            yield pa.RecordBatch.from_pydict(_spans(members, np.repeat(part.column("start").to_numpy(), sizes), np.repeat(part.column("end").to_numpy(), sizes)))


def merged(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of bytes of (start, end) pairs; runs that touch are one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """row (all columns of docs), copies and spans: null copies for a text that no other row has, null spans where nothing is to be removed.

    Every text is taken as its UTF-8 bytes (null as none). A row whose text
    occurs in another row too has copies > 1: all its bytes go if it has
    `length` of them. Repeated rows are such copies.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"))
    long = rows.where(F.octet_length("row.text") >= length)
    each = checkpoint(long.groupBy("h1", "h2").agg(F.count("*").alias("copies")).where("copies > 1"))
    cuts = checkpoint(repeated(long.select("h1", "h2", F.col("row.text").cast("binary").alias("raw")), length, hot))
    return rows.join(each, ["h1", "h2"], "left").join(cuts, ["h1", "h2"], "left").select("row", "copies", "spans")


def _cut(rows: DataFrame, schema, finish) -> DataFrame:
    """finish(columns of docs, bytes, kept bytes, spans) of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(pa.RecordBatch.from_struct_array(batch.column("row")), "text"):
                copies, found = (batch.column(c).slice(at, part.num_rows).to_pylist() for c in ("copies", "spans"))
                at += part.num_rows
                data, ends = utf8(part.column("text"))
                raws, kept, spans = [], [], []
                for i, (n, mine) in enumerate(zip(copies, found, strict=True)):
                    raw = data[ends[i] : ends[i + 1]].tobytes()
                    cut = [(0, len(raw))] if n else merged([(s["start"], s["end"]) for s in mine or []])
                    edges = [0, *(x for c in cut for x in c), len(raw)]
                    raws.append(raw)
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    spans.append(cut)
                yield finish(part, raws, kept, spans)

    return rows.mapInArrow(run, schema)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digest(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs.

    A byte goes if a string of `length` bytes that covers it also starts
    anywhere else, in any row, this one included; strings are judged on the
    input. Null and empty texts lose nothing; equal rows are copies of each
    other; an empty table gives no rows. Other columns are left out.
    """

    def finish(part: pa.RecordBatch, raws: list[bytes], kept: list[bytes], spans: list) -> pa.RecordBatch:
        n = [len(r) for r in raws]
        return pa.RecordBatch.from_pydict({
            "doc_id": part.column("doc_id").cast(pa.int64()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array([a - len(k) for a, k in zip(n, kept, strict=True)], pa.int64()),
            "n_spans": pa.array([len(s) for s in spans], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        })

    return _cut(remove_repeats(docs.select("doc_id", "text"), length, hot), DIGEST, finish)


def strip(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """docs with the repeated bytes taken out of text, and n_chars, if there, counted again.

    As in digest(). What is left of a character that was cut in two goes too,
    so that the text stays valid. Texts may end up empty; rows all stay, with
    their other columns, whatever their names.
    """
    names = docs.columns

    def finish(part: pa.RecordBatch, raws: list[bytes], kept: list[bytes], spans: list) -> pa.RecordBatch:
        before = part.column("text").to_pylist()
        text = [b if not s else k.decode("utf-8", "ignore") for b, k, s in zip(before, kept, spans, strict=True)]
        new = {"text": pa.array(text, pa.string())}
        if "n_chars" in names:
            new["n_chars"] = pa.array([a if not s else len(t) for a, s, t in zip(part.column("n_chars").to_pylist(), spans, text, strict=True)]).cast(part.schema.field("n_chars").type)
        return pa.RecordBatch.from_pydict({c: new.get(c, part.column(c)) for c in names})

    return _cut(remove_repeats(docs, length, hot), docs.schema, finish)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op10_suffix_dedup": f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, n - {LENGTH - 1})) AS i FROM d WHERE n >= {LENGTH}),
w AS (SELECT doc_id, i, md5_number(substr(x, (2 * i + 1)::BIGINT, {2 * LENGTH})) AS h FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER o <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
t AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM s),
k AS (SELECT t.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS e, string_agg(substr(x, (2 * z + 1)::BIGINT, (2 * (a - z))::BIGINT), '' ORDER BY a) AS body FROM t JOIN d ON d.doc_id = t.doc_id GROUP BY t.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(CASE WHEN k.doc_id IS NULL THEN x ELSE body || substr(x, (2 * e + 1)::BIGINT) END)) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
}
QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
