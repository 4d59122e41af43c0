"""Language model scoring with an Elias-Fano n-gram trie.

Training makes one level after another, each with one pass over the texts:

* words: 64-bit hashes in order with their counts, cut into shards by hash. A
  word's id is its place, so ids are spread evenly whatever the words.
* n-grams: an entry belongs to a context, which is an entry of the level below
  (in the second level a word, or the begin of a text). A shard holds a range of
  entries in order of context and word id. Monotone pointers tell where each
  context's entries begin; the word ids, made monotone by adding the context's
  number times the size of the vocabulary, are an Elias-Fano sequence, and a
  query is a successor search among its context's entries. With an entry goes
  its smoothed log probability, in 8 bits, and its backoff for the next level.

A pass sends its counts as packed blocks of sorted keys, one for each shard of
the next level. The level below tells where to cut: each shard of it cuts its
own range at quantiles of its counts, within one context too if that is
frequent, so that shards stay near SHARD n-grams. A task merges one shard after
another and appends it to a file of up to TOGETHER neighbouring shards, as what
a lookup costs besides its keys is one visit of each file: a level of many shards
has about FILES. Files lie in the shared folder; scoring maps them into memory
and touches the pages it needs. No task and not the driver ever holds a level.

Smoothing: p(w | context) = (c(context w) + MU p(w | shorter context)) / (c(context) + MU);
the shortest is (c + 0.1) / (N + 0.1 (V + 1)).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, elias_fano
from .common import STEP_BYTES, crc32_sql, crc_mod, fresh_folder, mix_int, slices, utf8, word_hashes

ORDER = 3
MU = 2.0
#: n-grams (with repeats) that a shard of a level holds, about.
SHARD = 2_000_000
#: Files of a level, about, as long as none holds more than TOGETHER shards.
FILES = 64
TOGETHER = 32
#: Bytes of text that one step of the lookups holds: each step visits all files of a level.
LOOKUP = 2 * STEP_BYTES
#: Bytes of packed blocks that a task sends at a time, about.
SENT = 1 << 22
#: Keys that a task gathers before it packs them.
GATHER = 3_000_000
#: A byte of a quantised log10 probability or backoff stands for this much.
STEP = 1 / 24
END = np.uint64(mix_int(0xE7037ED1A0B428DB))

def _quantise(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logs / STEP), 0, 255).astype(np.uint8)


def _runs(shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """shard, begin, end of the runs of a sorted array of shards: only shards that are asked for."""
    edges = np.r_[np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]), len(shards)] if len(shards) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(shards[a]), a, b


def _by_begin(keys: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The same of sorted keys that lie in the shards that begin at `begins`; -1 for those before the first. Whichever is shorter is looked up in the other."""
    if not len(keys):
        return
    lo, hi = (int(x) for x in np.searchsorted(begins, keys[[0, -1]], side="right") - 1)
    if hi - lo > len(keys):
        yield from _runs(np.searchsorted(begins, keys, side="right") - 1)
        return
    edges = np.r_[0, np.searchsorted(keys, begins[lo + 1 : hi + 1]), len(keys)].tolist()
    for k, a, b in zip(range(lo, hi + 1), edges[:-1], edges[1:], strict=True):
        if a < b:
            yield k, a, b


class Vocabulary:
    """The mapped shards of the words, OPEN of them at a time; few more are ever made, as each step asks them all."""

    OPEN = 4096

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits
        self.starts = arrays.load(folder, "words", ("starts",))["starts"]
        self.shard = lru_cache(maxsize=self.OPEN)(self._shard)

    def _shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        got = arrays.load(self.folder, f"words-{k}", ("hash", "count"))
        return got["hash"], got["count"]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for k, a, b in _runs(hashes >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(hashes), np.uint64)):
            if self.starts[k] == self.starts[k + 1]:
                continue
            known, count = self.shard(k)
            at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
            hit = known[at] == hashes[a:b]
            ids[a:b] = np.where(hit, at + self.starts[k], -1)
            counts[a:b] = np.where(hit, count[at], 0)
        return ids, counts

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids."""
        out = np.zeros(len(ids), np.int64)
        for k, a, b in _by_begin(ids, self.starts):
            out[a:b] = self.shard(k)[1][ids[a:b] - self.starts[k]]
        return out


class Level:
    """The mapped files of the n-grams of one length, OPEN of them at a time; few more are ever made, as each step asks them all."""

    OPEN = 1024

    KEYS = (*(f"{a}_{b}" for a in ("pointer", "word") for b in ("low", "words", "ones", "shape")), "word_zeros", "prob", "backoff", "base")

    def __init__(self, folder: str, n: int, size: int):
        self.folder, self.n, self.size = folder, n, size  # size: the number of word ids
        got = arrays.load(folder, f"level{n}", ("first", "starts"))
        self.first, self.starts = got["first"], got["starts"]
        self.shard = lru_cache(maxsize=self.OPEN)(self._shard)

    def _shard(self, k: int):
        got = arrays.load(self.folder, f"level{self.n}-{k}", self.KEYS)
        part = lambda p: elias_fano.EliasFano({b: got[f"{p}_{b}"] for b in ("low", "words", "ones", "zeros", "shape") if f"{p}_{b}" in got})
        return part("pointer"), part("word"), got["prob"], got["backoff"], int(got["base"][0])

    def find(self, keys: np.ndarray, logs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry (-1: none), log10 probability and log10 backoff (zeros without logs) of sorted keys context * size + word."""
        entry, prob, backoff = np.full(len(keys), -1, np.int64), np.zeros(len(keys)), np.zeros(len(keys))
        for k, a, b in _by_begin(keys, self.first):
            if k < 0 or self.starts[k] == self.starts[k + 1]:
                continue
            pointer, word, p, o, base = self.shard(k)
            context = keys[a:b] // self.size - base
            fresh = np.r_[True, context[1:] != context[:-1]]
            back, heads = np.cumsum(fresh) - 1, context[fresh]
            there = heads < pointer.n - 1
            heads = np.where(there, heads, 0)
            begin, end = pointer.pair(heads)
            end = np.where(there, end, begin)[back]
            begin, inside = begin[back], there[back]
            at = word.find(np.where(inside, keys[a:b] - base * self.size, 0), begin, end)
            hit = at >= 0
            entry[a:b] = np.where(hit, at + self.starts[k], -1)
            if not logs:
                continue
            at = np.maximum(at, 0)
            prob[a:b] = np.where(hit, p[at] * -STEP, 0.0)
            backoff[a:b] = np.where(hit, o[at] * -STEP, 0.0)
        return entry, prob, backoff

    def counts_of(self, entries: np.ndarray) -> np.ndarray:
        """How often each of sorted entries occurs in training."""
        out = np.zeros(len(entries), np.int64)
        for k, a, b in _by_begin(entries, self.starts):
            out[a:b] = arrays.load(self.folder, f"level{self.n}-{k}", ("count",))["count"][entries[a:b] - self.starts[k]]
        return out

    def words_of(self, entries: np.ndarray) -> np.ndarray:
        """The last word's id of sorted entries."""
        out = np.zeros(len(entries), np.int64)
        for k, a, b in _by_begin(entries, self.starts):
            out[a:b] = self.shard(k)[1].get(entries[a:b] - self.starts[k]) % self.size
        return out


@dataclass
class Model:
    """What a task needs to know; small, whatever the corpus. Where the shards begin is in files of the folder."""

    folder: str
    bits: int
    types: int
    tokens: int
    texts: int
    levels: tuple[int, ...] = ()

    def open(self) -> tuple[Vocabulary, list[Level]]:
        return _open(self.folder, self.bits, self.types, self.levels)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


@lru_cache(maxsize=2)
def _open(folder: str, bits: int, types: int, levels: tuple[int, ...]) -> tuple[Vocabulary, list[Level]]:
    return Vocabulary(folder, bits), [Level(folder, n, types) for n in levels]


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and where each text's tokens begin."""
    words, first = word_hashes(*utf8(part.column("text")))
    n = np.diff(first) + 1
    starts = np.cumsum(np.r_[0, n])
    out = np.full(int(starts[-1]), END, np.uint64)
    mine = np.ones(len(out), dtype=bool)
    mine[starts[1:] - 1] = False
    out[mine] = words
    return out, starts


def _add(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, counts behind them, byte by byte of all, which the shuffle's codec shrinks."""
    step = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    first, step[0] = step[0], 0
    planes = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, : max(1, (int(x.max()).bit_length() + 7) // 8)].T)
    a, b = planes(step), planes(counts.astype(np.uint64))
    return np.array([len(keys), first, len(a), len(b)], np.uint64).tobytes() + a.tobytes() + b.tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, first, a, b = (int(x) for x in np.frombuffer(blob, np.uint64, 4))
    out = []
    at = 32
    for planes in (a, b):
        x = np.zeros((n, 8), np.uint8)
        x[:, :planes] = np.frombuffer(blob, np.uint8, n * planes, at).reshape(planes, n).T
        out.append(x.reshape(-1).view(np.uint64))
        at += n * planes
    out[0][0] = first
    return np.cumsum(out[0], dtype=np.uint64), out[1].astype(np.int64)


BLOCKS = "shard int, block binary"


def _count(texts: DataFrame, keys_of, cuts) -> DataFrame:
    """shard, block: the keys that keys_of(batch) gives, counted in each task and packed for the shards that begin at cuts()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        raw: list[np.ndarray] = []

        def gather() -> None:
            if raw:
                held.append(np.unique(np.concatenate(raw), return_counts=True))
                raw.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            gather()
            if held:
                keys, counts = _add(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])) if len(held) > 1 else held[0]
                held.clear()
                shards, blocks = [], []
                for k, a, b in _by_begin(keys, cuts()):
                    shards.append(k)
                    blocks.append(_packed(keys[a:b], counts[a:b]))
                    if sum(map(len, blocks)) > SENT:
                        yield pa.RecordBatch.from_pydict({"shard": pa.array(shards, pa.int32()), "block": pa.array(blocks, pa.binary())})
                        shards, blocks = [], []
                if shards:
                    yield pa.RecordBatch.from_pydict({"shard": pa.array(shards, pa.int32()), "block": pa.array(blocks, pa.binary())})

        for batch in batches:
            for part in slices(batch, "text", LOOKUP):
                raw.append(keys_of(part))
                if sum(map(len, raw)) > GATHER // 4:
                    gather()
                    if sum(len(k) for k, _ in held) > GATHER:
                        yield from flush()
        yield from flush()

    return texts.mapInArrow(run, BLOCKS)


def _merged(blocks: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All of a shard's counts, added."""
    parts = [_unpacked(b) for b in blocks]
    return _add(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


MADE = "shard int, entries long, total long, at array<long>, part array<double>"


def _made(shard: int, counts: np.ndarray) -> pa.Table:
    """The shard's size, and cuts for the next level: the entry, and how far into its words."""
    at, part = [0], [0.0]
    ends = np.cumsum(counts)
    for want in range(SHARD, int(ends[-1]) if len(ends) else 0, SHARD):
        e = int(np.searchsorted(ends, want, side="right"))
        at.append(e)
        part.append(float((want - (ends[e] - counts[e])) / counts[e]))
    kinds = pa.schema([("shard", pa.int32()), ("entries", pa.int64()), ("total", pa.int64()), ("at", pa.list_(pa.int64())), ("part", pa.list_(pa.float64()))])
    return pa.Table.from_pydict({"shard": [shard], "entries": [len(counts)], "total": [int(ends[-1]) if len(ends) else 0], "at": [at], "part": [part]}, schema=kinds)


def _words(texts: DataFrame, folder: str, bits: int) -> list:
    def build(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _merged(b.as_py() for b in table.column("block"))
        arrays.save(folder, f"words-{shard}", {"hash": keys.astype(np.uint64), "count": counts})
        return _made(shard, counts)

    def cuts() -> np.ndarray:
        return np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)

    return _count(texts, lambda part: _tokens(part)[0], cuts).groupBy("shard").applyInArrow(build, MADE).collect()


def _ids(vocabulary: Vocabulary, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and counts of the tokens, and where each text begins."""
    tokens, starts = _tokens(part)
    kinds, back = np.unique(tokens, return_inverse=True)
    ids, counts = vocabulary.find(kinds)
    return ids[back], counts[back], starts


def _before(entries: np.ndarray, starts: np.ndarray, first: int) -> np.ndarray:
    """The entry that ends before each token; `first` where a text begins."""
    out = np.r_[-1, entries[:-1]][: len(entries)]
    out[starts[:-1]] = first
    return out


def _joined(context: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """The key of the n-gram of each context and token; -1 if one of them isn't known."""
    return np.where((context >= 0) & (ids >= 0), context * size + ids, -1)


def _keys(levels: list[Level], ids: np.ndarray, starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """The key of the n-gram that ends in each token; -1 if it or its context isn't known, or the text begins too late for it."""
    context = _before(ids, starts, size)  # the begin of a text is a word of its own
    for level in levels[: n - 2]:
        kinds, back = np.unique(_joined(context, ids, size), return_inverse=True)
        context = _before(level.find(kinds, logs=False)[0][back], starts, -1)
    return _joined(context, ids, size)


def train(texts: DataFrame, order: int = ORDER, rows: int | None = None) -> Model:
    """A model of order `order` of all of texts (a column text; null counts as empty)."""
    if order not in (1, 2, 3):
        raise ValueError("order must be 1, 2 or 3")
    spark = texts.sparkSession
    texts = texts.select("text")
    rows = texts.count() if rows is None else rows
    folder = fresh_folder(spark, "ngrams")
    # distinct words grow more slowly than texts
    bits = max(0, math.ceil(0.7 * math.log2(max(1, rows) / 2048)))
    made = {r["shard"]: r for r in _words(texts, folder, bits)}
    starts = np.cumsum([0, *(made[k]["entries"] if k in made else 0 for k in range(1 << bits))])
    arrays.save(folder, "words", {"starts": starts})
    model = Model(folder, bits, int(starts[-1]), sum(r["total"] for r in made.values()), rows)
    size = model.types
    cuts = [int(starts[k] + e) * size + int(p * size) for k, r in sorted(made.items()) for e, p in zip(r["at"], r["part"], strict=True)]
    pieces = -(-rows // SHARD)
    cuts += [size * size + size * k // pieces for k in range(pieces)]
    contexts = size + 1
    for n in range(2, order + 1):
        if not size:
            break
        if contexts * size >= 1 << 63:
            raise OverflowError(f"{contexts} contexts of {size} words have no 64-bit keys; train a lower order, or on fewer texts")
        first = np.unique(np.array(cuts, np.int64))
        arrays.save(folder, f"cuts{n}", {"first": first})
        per = min(TOGETHER, -(-len(first) // FILES))
        made = {r["shard"]: r for r in _level(texts, model, n, n < order, first[::per], contexts, len(first), per)}
        at = np.cumsum([0, *(made[k]["entries"] if k in made else 0 for k in range(len(first)))])
        arrays.save(folder, f"level{n}", {"first": first[::per], "starts": np.r_[at[:-1][::per], at[-1]]})
        model, contexts = replace(model, levels=(*model.levels, n)), int(at[-1])
        cuts = [(int(at[k]) + e) * size + int(p * size) for k, r in sorted(made.items()) for e, p in zip(r["at"], r["part"], strict=True)]
    return model


def _level(texts: DataFrame, model: Model, n: int, inner: bool, first: np.ndarray, contexts: int, shards: int, per: int) -> list:
    """Writes the level's files, of `per` shards each, which begin at the keys `first`; a row for each shard."""
    size = model.types

    def keys_of(part: pa.RecordBatch) -> np.ndarray:
        vocabulary, levels = model.open()
        ids, _, starts = _ids(vocabulary, part)
        key = _keys(levels, ids, starts, size, n)
        return key[key >= 0]

    def logs(context: np.ndarray, word: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and backoff of a shard's entries."""
        vocabulary, levels = model.open()
        # probabilities of the shorter context, and the context's count
        kinds, back = np.unique(word, return_inverse=True)
        lower = model.base(vocabulary.count_of(kinds))[back]
        heads, head = np.unique(context, return_inverse=True)
        if n == 2:
            total = np.full(len(heads), model.texts, np.int64)
            known = heads < size
            total[known] = vocabulary.count_of(heads[known])
            total = total[head]
        else:
            below = levels[n - 3]
            tail = below.words_of(heads)[head]  # the context's last word
            lower = _logs(levels[0], tail, word, lower, vocabulary, model)
            total = below.counts_of(heads)[head]
        return np.log10((counts + MU * 10**lower) / (total + MU)), np.log10(MU / (counts + MU)) if inner else np.zeros(len(counts))

    def file(k: int, parts: Iterator[tuple[int, Iterable[bytes]]]) -> Iterator[pa.Table]:
        base, end = int(first[k]) // size, int(first[k + 1]) if k + 1 < len(first) else contexts * size
        least = max(1, model.tokens * per // (2 * shards))  # entries, if half of the tokens repeat; a bad guess costs a bit an entry
        pointer = elias_fano.Builder(elias_fano.Builder.width_of(-(-end // size) - base, least))
        words = elias_fano.Builder(elias_fano.Builder.width_of(least, end - base * size))
        probs, backoffs, all_counts, last = [], [], [], base - 1
        for shard, blocks in parts:
            keys, counts = _merged(blocks)
            keys = keys.astype(np.int64)
            context, word = keys // size, keys % size
            pointer.add(words.n + np.searchsorted(context, np.arange(last + 1, int(context[-1]) + 1)))
            words.add(keys - base * size)
            last = int(context[-1])
            prob, backoff = logs(context, word, counts)
            probs.append(_quantise(prob))
            backoffs.append(_quantise(backoff))
            if inner:  # the next level's training reads them, scoring doesn't
                all_counts.append(counts.astype(np.uint32 if counts.max() < 1 << 32 else np.uint64))
            yield _made(shard, counts)
        pointer.add(np.array([words.n]))
        made = {f"pointer_{key}": a for key, a in pointer.arrays(words.n + 1).items() if key != "zeros"}
        made |= {f"word_{key}": a for key, a in words.arrays((last + 1 - base) * size).items()}
        made |= {"count": all_counts} if inner else {}
        arrays.save(model.folder, f"level{n}-{k}", made | {"prob": probs, "backoff": backoffs, "base": np.array([base], np.int64)})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = ((shard, block.as_py()) for batch in batches for shard, block in zip(batch.column("shard").to_pylist(), batch.column("block"), strict=True))
        parts = ((shard, (b for _, b in rows)) for shard, rows in groupby(blocks, key=lambda x: x[0]))
        for k, mine in groupby(parts, key=lambda x: x[0] // per):
            for table in file(k, mine):
                yield from table.to_batches()

    counted = _count(texts, keys_of, lambda: arrays.load(model.folder, f"cuts{n}", ("first",))["first"])
    dealt = counted.repartitionById(len(first), (F.col("shard") / per).cast("int")).sortWithinPartitions("shard")
    return dealt.mapInArrow(build, MADE).collect()


def _logs(level: Level, context: np.ndarray, word: np.ndarray, lower: np.ndarray, vocabulary: Vocabulary, model: Model) -> np.ndarray:
    """log10 p(word | context) in the second level; both known words, or the context the begin."""
    kinds, back = np.unique(context * model.types + word, return_inverse=True)
    entry, prob, _ = level.find(kinds)
    heads, head = np.unique(context, return_inverse=True)
    total = np.full(len(heads), model.texts, np.int64)
    total[heads < model.types] = vocabulary.count_of(heads[heads < model.types])
    return np.where(entry[back] >= 0, prob[back], np.log10(MU / (total[head] + MU)) + lower)


SCORES = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with n_tokens, n_known, train_tokens, base_score and score.

    A null text counts as empty: one token, the end. A token is known if
    training saw it. A model of no texts gives the same score to all tokens.
    Rows are independent of each other. Columns of `keep` with the names of the
    results are replaced.
    """
    keep = [c for c in keep if c not in SCORES]
    base = docs.select(F.struct(*keep).alias("row"), "text")
    schema = docs.select(*keep).select("*", *[F.lit(0).cast("long").alias(c) for c in SCORES[:3]], *[F.lit(0.0).alias(c) for c in SCORES[3:]]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, levels = model.open()
        for batch in batches:
            for part in slices(batch, "text", LOOKUP):
                ids, counts, starts = _ids(vocabulary, part)
                plain = model.base(counts)
                logs = plain.copy()
                begin = np.zeros(len(ids), dtype=bool)
                begin[starts[:-1]] = True
                total = np.r_[0, counts[:-1]][: len(ids)]
                total[begin] = model.texts
                # what a context costs that lacks the token; nothing if the context itself isn't known
                cost = np.log10(MU / (total + MU))
                context = _before(ids, starts, model.types)
                for level in levels:
                    kinds, back = np.unique(_joined(context, ids, model.types), return_inverse=True)
                    entry, prob, backoff = (x[back] for x in level.find(kinds))
                    context = _before(entry, starts, -1)
                    logs = np.where(entry >= 0, prob, logs + cost)
                    cost = np.r_[0.0, np.where(entry >= 0, backoff, 0.0)[:-1]][: len(ids)]
                    cost[begin] = 0.0
                n = np.diff(starts)
                kept = pa.RecordBatch.from_struct_array(part.column("row"))
                cols = {c: kept.column(c) for c in keep}
                known = np.add.reduceat((counts > 0).astype(np.int64), starts[:-1]) if len(n) else n
                yield pa.RecordBatch.from_pydict(cols | {
                    "n_tokens": pa.array(n, pa.int64()), "n_known": known, "train_tokens": np.full(len(n), model.tokens, np.int64),
                    "base_score": np.add.reduceat(plain, starts[:-1]) if len(n) else plain, "score": np.add.reduceat(logs, starts[:-1]) if len(n) else logs,
                })

    return base.mapInArrow(run, schema)


def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = crc_mod("doc_id", 10) == 0
    model = train(docs.where(~held))
    return score(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])


def ngram_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8_ngram_lm says of each text that depends on single tokens alone, so that SQL can say it too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = crc_mod("doc_id", 10) == 0
    got = score(docs.withColumn("held_out", held), train(docs.where(~held), order=1), ["doc_id", "held_out"])
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


QUERIES = {"op8_ngram_lm": op8_ngram_lm, "ngram_base": ngram_base}
SQL = {
    "ngram_base": f"""
WITH d AS (SELECT doc_id, coalesce({crc32_sql("doc_id")} % 10, 0) = 0 AS held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') || [chr(10)] AS ws FROM documents),
t AS (SELECT doc_id, held_out, unnest(ws) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.n) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.1::DOUBLE) / (n.n + 0.1::DOUBLE * (n.v + 1)))), 4) AS base_score
FROM t LEFT JOIN c ON c.w = t.w CROSS JOIN n GROUP BY doc_id, held_out"""
}
