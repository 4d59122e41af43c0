"""Exact BPE encoding and decoding with a SentencePiece model, by vectorised merge rounds.

The text of each batch is cut into words where no piece of the vocabulary can
reach across (a word is a run of spaces and what follows it). Every distinct
word of a batch is encoded once: all words lie end to end in one flat array of
symbols, each round looks up the rank of every adjacent pair, takes each word's
best pair by a segmented minimum, merges its leftmost occurrences at once, and
compacts the array, until no pair of the vocabulary remains. A word of more than
LONG symbols (base64, a text without spaces) has rounds of its own, one for each
rank, which look at the places of that rank alone, so that its cost doesn't grow
with rounds times length. Symbols that are no piece fall back to their UTF-8
bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

META = "▁"
_SEGMENT = re.compile(f"{META}*[^{META}]+|{META}+")
#: Words that a worker remembers between batches, and their longest.
REMEMBERED, REMEMBERED_SIZE = 100_000, 1000
#: Symbols beyond which a word has rounds of its own.
LONG = 1000


class Bpe:
    """The merge tables of one model; made once in each Python worker."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # what a normaliser or another treatment of blanks would change; texts are cut and merged as they are
        odd = [t for t in (" x  y ", "x", "\ufb01 \u2167\u3000e\u0301", "a\tb\n") if model.normalize(t) != META + t.replace(" ", META)]
        if odd:
            raise ValueError(f"the model normalises texts: {odd[0]!r} becomes {model.normalize(odd[0])!r}")
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.unk = model.unk_id()
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        byte_of = {i: b for b, i in self.byte_ids.items()}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        crossing = [self.pieces[i] for i in plain if META in self.pieces[i].lstrip(META)]
        if crossing or len(self.byte_ids) != 256:
            raise ValueError(f"pieces reach across words or bytes are missing: {crossing[:3]}")
        self.id_of = {self.pieces[i]: i for i in plain}
        # The library picks the pair with the highest score, the leftmost of equals.
        order = sorted({model.get_score(i) for i in plain}, reverse=True)
        rank_of = {s: k for k, s in enumerate(order)}
        keys, ranks, made = [], [], []
        for i in plain:
            p = self.pieces[i]
            for cut in range(1, len(p)):
                a, b = self.id_of.get(p[:cut]), self.id_of.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    ranks.append(rank_of[model.get_score(i)])
                    made.append(i)
        at = np.argsort(np.array(keys, np.int64), kind="stable")
        self.n = n
        self.keys, self.ranks, self.made = np.array(keys, np.int64)[at], np.array(ranks, np.int64)[at], np.array(made, np.int64)[at]
        slots = 1 << max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self.raw = [bytes([byte_of[i]]) if i in byte_of else p.replace(META, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw[self.unk] = " ⁇ ".encode()
        self.hidden = {i for i in range(n) if model.is_control(i)}
        self._table(slots)

    def _table(self, slots: int) -> None:
        """An open-addressed table of the pairs: one probe answers most lookups."""
        self.slots = np.full(slots, -1, np.int64)
        home = self._home(self.keys)
        left = np.arange(len(self.keys))
        step = 0
        while len(left):
            at = (home[left] + step) & (slots - 1)
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left = left[self.slots[at] != left]
            step += 1
        self.probes = step

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The row of each pair among the merges, -1 if it makes no piece."""
        keys = left * self.n + right
        found = np.full(len(keys), -1, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        home, mask = self._home(keys[todo]), len(self.slots) - 1
        for step in range(self.probes):
            got = self.slots[(home + step) & mask]
            hit = (got >= 0) & (self.keys[got] == keys[todo])
            found[todo[hit]] = got[hit]
            more = ~hit & (got >= 0)
            todo, home = todo[more], home[more]
            if not len(todo):
                break
        return found

    def merge(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        text = "".join(words)
        if not text:
            return [[] for _ in words]
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, back = np.unique(chars, return_inverse=True)
        # characters that are no piece stand as -2 - code point, and never merge
        code = np.array([self.id_of.get(chr(c), -2 - int(c)) for c in kinds], np.int64)
        symbols = code[back]
        sizes = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        long = np.flatnonzero(sizes > LONG)
        for w, end in zip(long.tolist(), np.cumsum(sizes)[long].tolist(), strict=True):
            done_symbols.append(self._merge_long(symbols[end - sizes[w] : end]))
            done_words.append(np.full(len(done_symbols[-1]), w))
        if len(long):
            short = ~np.repeat(sizes > LONG, sizes)
            symbols, word = symbols[short], word[short]
        while len(symbols) > 1:
            pair = self.find(symbols[:-1], symbols[1:])
            pair[word[:-1] != word[1:]] = -1
            rank = np.where(pair >= 0, self.ranks[pair], np.iinfo(np.int64).max)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(np.r_[rank, np.iinfo(np.int64).max], starts)
            live = best < np.iinfo(np.int64).max
            sizes = np.diff(np.r_[starts, len(symbols)])
            alive = np.repeat(live, sizes)
            if not live.all():  # words without a pair leave
                done_symbols.append(symbols[~alive])
                done_words.append(word[~alive])
                if not live.any():
                    symbols, word = symbols[:0], word[:0]
                    break
            take = np.r_[rank, np.iinfo(np.int64).max] == np.repeat(best, sizes)
            take &= alive
            # of neighbouring takes, every second one stands, counted from the left of the run
            hits = np.flatnonzero(take)
            fresh = np.r_[True, np.diff(hits) > 1]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
            hits = self._leftmost(hits, np.arange(len(hits)) - run, pair, word, symbols, rank)
            merged = symbols.copy()
            merged[hits] = self.made[pair[hits]]
            keep = alive.copy()
            keep[hits + 1] = False
            symbols, word = merged[keep], word[keep]
        done_symbols.append(symbols)
        done_words.append(word)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        symbols, counts = symbols[order], np.bincount(word, minlength=len(words))
        flat, ends = symbols.tolist(), np.cumsum(counts).tolist()
        out, at = [], 0
        for end in ends:
            ids = flat[at:end]
            out.append(ids if min(ids, default=0) >= 0 else self._bytes(ids))
            at = end
        return out

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one word: rounds in order of rank, over the places that wait for it."""
        symbols = symbols.copy()
        n = len(symbols)
        left, right = np.arange(-1, n - 1), np.r_[np.arange(1, n), -1]
        want = np.full(n, -1, np.int64)  # the row of the pair that begins at a place; -1 also where a symbol is gone
        gone = np.zeros(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def look(at: np.ndarray) -> None:
            at = at[right[at] >= 0]
            rows = self.find(symbols[at], symbols[right[at]])
            want[at] = rows
            at, rows = at[rows >= 0], rows[rows >= 0]
            ranks = self.ranks[rows]
            order = np.argsort(ranks, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(ranks[order])) + 1) if len(order) else ():
                rank = int(ranks[part[0]])
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(queue, rank)
                waiting[rank].append(at[part])

        look(np.arange(n))
        while queue:
            rank = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[want[at] >= 0]
            at = at[self.ranks[want[at]] == rank]
            if not len(at):
                continue
            whole = at
            if (self.made[want[at]] != self.made[want[at[0]]]).any():  # pieces of the same rank: one at a time
                at = at[:1]
            # of neighbouring pairs every second one stands, counted from the left of the run
            fresh = np.r_[True, at[1:] != right[at[:-1]]]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
            chained = np.r_[False, at[1:] == right[right[at[:-1]]]]
            at = at[self._in_one_round(chained, want[at], symbols[at], np.where(left[at] >= 0, symbols[left[at]], -1), rank)]
            if len(at) < len(whole):  # those that are neither merged nor gone now wait for the next round
                waiting[rank] = [whole]
                heapq.heappush(queue, rank)
            other = right[at]
            symbols[at] = self.made[want[at]]
            gone[other] = True
            want[at] = want[other] = -1
            after = right[other]
            right[at] = after
            left[after[after >= 0]] = at[after >= 0]
            before = left[at]
            want[before[before >= 0]] = -1
            look(np.unique(np.r_[at, before[before >= 0]]))
        return symbols[~gone]

    def _in_one_round(self, chained: np.ndarray, pair: np.ndarray, first: np.ndarray, before: np.ndarray, rank) -> np.ndarray:
        """Which of the hits, equal pairs from left to right, may merge at once.

        The library merges equal pairs from left to right too, but a merge makes
        new pairs, and those of a rank no worse than the current one come before
        the equal pairs to its right. That matters only where the next hit
        follows directly (chained): such hits stand if neither the symbol before
        their chain, nor the next one's first symbol, nor another merged symbol
        makes a piece of such a rank with what was merged. The others wait.
        """
        if not chained.any():
            return np.ones(len(chained), dtype=bool)
        at = np.flatnonzero(chained)
        head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(chained))))
        made = self.made[pair[at]]
        unsafe = np.zeros(len(at), dtype=bool)
        limit = rank if np.isscalar(rank) else rank[at]
        for a, b in ((made, first[at]), (made, made), (before[head[at]], made)):
            found = self.find(a, b)
            unsafe |= (found >= 0) & (self.ranks[found] <= limit)
        # one unsafe hit holds its whole chain
        held = np.zeros(len(chained), dtype=bool)
        held[head[at[unsafe]]] = True
        return ~(chained & held[head])

    def _leftmost(self, hits: np.ndarray, place: np.ndarray, pair: np.ndarray, word: np.ndarray, symbols: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Every second of neighbouring hits, from the left, as far as they may merge in one round; of a word where different pieces share the best rank, the first alone."""
        hits = hits[place % 2 == 0]
        if len(hits) < 2:
            return hits
        first = np.r_[True, word[hits[1:]] != word[hits[:-1]]]
        lead = np.maximum.accumulate(np.where(first, np.arange(len(hits)), 0))
        mixed = np.zeros(int(word[hits].max()) + 1, dtype=bool)
        mixed[word[hits[pair[hits] != pair[hits[lead]]]]] = True
        hits = hits[first | ~mixed[word[hits]]]
        chained = np.r_[False, (np.diff(hits) == 2) & (word[hits[1:]] == word[hits[:-1]])]
        inside = (hits > 0) & (word[np.maximum(hits - 1, 0)] == word[hits])
        return hits[self._in_one_round(chained, pair[hits], symbols[hits], np.where(inside, symbols[hits - 1], -1), best[hits])]

    def _bytes(self, ids: list[int]) -> list[int]:
        out: list[int] = []
        for i in ids:
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in chr(-2 - i).encode("utf-8", "replace"))
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The text's bytes, still with the space that encoding put first."""
        return b"".join(self.raw[i] for i in ids if i not in self.hidden)


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def segments(text: str) -> list[str]:
    """The words of a text after the model's normalisation: a space in front, spaces as the meta symbol."""
    return _SEGMENT.findall(META + text.replace(" ", META)) if text else []


class Coder:
    """Encodes and decodes lists of texts; remembers words between calls."""

    def __init__(self, path: str):
        self.bpe = load(path)
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.long: list[str] = []  # of the last call, not to be remembered

    def words(self, texts: list[str]) -> list[list[str]]:
        out = [segments(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for w in self.long:
            self.known.pop(w, None)
        fresh = sorted({w for ws in out for w in ws if w not in self.known})
        for w, ids in zip(fresh, self.bpe.merge(fresh), strict=True):
            self.known[w] = (len(ids), ",".join(map(str, ids)), self.bpe.decode_bytes(ids))
        self.long = [w for w in fresh if len(w) > REMEMBERED_SIZE]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for w in ws for i in self.known[w][1].split(",")] for ws in self.words(texts)]

    def decode(self, ids: list[int]) -> str:
        got = self.bpe.decode_bytes(ids)
        return (got[1:] if got[:1] == b" " else got).decode("utf-8", "replace")

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Of each text: the number of ids, the hash of the ids, the hash of the text that they decode to."""
        counts, ids_hash, text_hash = [], [], []
        known = self.known
        for ws in self.words(texts):
            got = [known[w] for w in ws]
            counts.append(sum(g[0] for g in got))
            ids_hash.append(hashlib.sha256(",".join([g[1] for g in got]).encode()).hexdigest())
            back = b"".join([g[2] for g in got])
            text_hash.append(hashlib.sha256(back[1:] if back[:1] == b" " else back).hexdigest())
        return counts, ids_hash, text_hash


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs and a column `out` of the ids of `text`, exactly as the sentencepiece library encodes it.

    A null text counts as empty and has no ids. Rows are independent: repeated
    rows, ties and other columns stay as they are, but a column named `out` is
    replaced.
    """
    schema = docs.drop(out).withColumn(out, F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model)
        for batch in batches:
            for part in slices(batch, text):
                ids = coder.encode([t or "" for t in part.column(text).to_pylist()])
                cols = {c: part.column(c) for c in part.schema.names}
                yield pa.RecordBatch.from_pydict(cols | {out: pa.array(ids, pa.list_(pa.int32()))})

    return docs.drop(out).mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """rows and a column `out` with the text that `ids` decode to; null ids give an empty text."""
    schema = rows.drop(out).withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model)
        for part in batches:
            texts = [coder.decode(i or []) for i in part.column(ids).to_pylist()]
            cols = {c: part.column(c) for c in part.schema.names}
            yield pa.RecordBatch.from_pydict(cols | {out: pa.array(texts, pa.string())})

    return rows.drop(out).mapInArrow(run, schema)


def digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: what encode() and decode() give, without the bulk.

    Null texts count as empty: no tokens, the hashes of the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model)
        for batch in batches:
            for part in slices(batch, "text"):
                counts, ids, texts = coder.digests([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": ids, "decoded_sha256": texts})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
SQL: dict[str, str] = {}
