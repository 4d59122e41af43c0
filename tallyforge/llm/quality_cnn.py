"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned embedding. FILTERS filters of WIDTH bytes slide over
the whole document by STRIDE; their rectified outputs are max-pooled (and
averaged) over chunks of two halves, each chunk sharing a half with the next,
so that chunks overlap and none of the text is left out. A layer of HIDDEN
units sees each chunk, the document takes each unit's maximum over its chunks,
and a logistic unit makes one probability of them. Training (Adam, balanced
classes) runs on whole texts of a bounded, documented sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, draw, slices, utf8

EMBED, FILTERS, HIDDEN = 8, 32, 16
WIDTH, STRIDE = 16, 4
#: Filter positions in half a chunk.
HALF = 32
#: Labelled rows that training takes from each class, at most; which ones a hash of doc_id decides.
PER_CLASS = 800
THRESHOLD = 0.3
#: Filter positions computed at a time.
BLOCK = 16_384

_SPAN = HALF * STRIDE


def layout(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of byte codes 1 to 256, each padded with 0 to whole halves, at least two, and a half of zeros behind it; and their first halves.

    The last windows of a text's halves reach WIDTH - STRIDE bytes beyond them: into that half of zeros, not into the next text.
    """
    halves = [max(2, -(-len(t) // _SPAN)) + 1 for t in texts]
    first = np.cumsum([0, *halves])
    flat = np.zeros(int(first[-1]) * _SPAN + WIDTH, np.int16)
    for t, h in zip(texts, first[:-1], strict=True):
        flat[h * _SPAN : h * _SPAN + len(t)] = t
        flat[h * _SPAN : h * _SPAN + len(t)] += 1
    return flat, first


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    f = np.float32
    return {
        "emb": rng.normal(0, 0.5, (257, EMBED)).astype(f), "conv": rng.normal(0, 0.1, (WIDTH * EMBED, FILTERS)).astype(f), "cb": np.zeros(FILTERS, f),
        "dense": rng.normal(0, 0.15, (2 * FILTERS, HIDDEN)).astype(f), "db": np.zeros(HIDDEN, f), "out": rng.normal(0, 0.3, HIDDEN).astype(f), "ob": np.zeros(1, f),
    }


def _positions(flat: np.ndarray, emb: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The embedded windows of filter positions lo to hi, a row each."""
    got = emb[flat[lo * STRIDE : (hi - 1) * STRIDE + WIDTH]]
    step = got.strides[0]
    view = np.lib.stride_tricks.as_strided(got, (hi - lo, WIDTH * EMBED), (step * STRIDE, got.strides[1]))
    return np.ascontiguousarray(view)


def _activations(flat: np.ndarray, n: int, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum, its place and mean of every filter in each of n halves."""
    most, where, mean = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64), np.empty((n, FILTERS), np.float32)
    step = BLOCK // HALF
    for a in range(0, n, step):
        b = min(n, a + step)
        act = _positions(flat, p["emb"], a * HALF, b * HALF) @ p["conv"] + p["cb"]
        np.maximum(act, 0, out=act)
        act = act.reshape(b - a, HALF, FILTERS)
        where[a:b] = act.argmax(axis=1)
        most[a:b] = np.take_along_axis(act, where[a:b, None, :], 1)[:, 0]
        mean[a:b] = act.mean(axis=1)
    return most, where, mean


def _chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The left half of every chunk, and each document's first chunk; the half of zeros behind a document is in none."""
    sizes = np.diff(first) - 2
    starts = np.cumsum(np.r_[0, sizes])
    left = np.arange(starts[-1]) + np.repeat(first[:-1] - starts[:-1], sizes)
    return left, starts[:-1]


def _forward(flat: np.ndarray, first: np.ndarray, p: dict) -> dict:
    most, where, mean = _activations(flat, int(first[-1]), p)
    left, begins = _chunks(first)
    second = most[left + 1] > most[left]
    pooled = np.concatenate([np.maximum(most[left], most[left + 1]), (mean[left] + mean[left + 1]) / 2], axis=1)
    hidden = np.maximum(pooled @ p["dense"] + p["db"], 0)
    best = np.maximum.reduceat(hidden, begins, axis=0)
    z = best @ p["out"] + p["ob"][0]
    return {"most": most, "where": where, "left": left, "begins": begins, "second": second, "pooled": pooled, "hidden": hidden, "best": best, "p": 1 / (1 + np.exp(-np.clip(z, -30, 30)))}


def probabilities(texts: list[np.ndarray], p: dict) -> np.ndarray:
    """The probability of label 1 for each text."""
    return _forward(*layout(texts), p)["p"].astype(np.float64) if texts else np.zeros(0)


def _gradients(flat: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, p: dict) -> dict[str, np.ndarray]:
    s = _forward(flat, first, p)
    dz = ((s["p"] - y) * weight / len(y)).astype(np.float32)
    g = {"out": s["best"].T @ dz, "ob": np.array([dz.sum()], np.float32)}
    docs = np.repeat(np.arange(len(y)), np.diff(np.r_[s["begins"], len(s["left"])]))
    won = (s["hidden"] == s["best"][docs]) & (s["hidden"] > 0)
    dh = np.where(won, dz[docs, None] * p["out"][None, :], 0).astype(np.float32)
    g["dense"], g["db"] = s["pooled"].T @ dh, dh.sum(axis=0)
    dp = dh @ p["dense"].T
    n = int(first[-1])
    dmost, dmean = np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS), np.float32)
    np.add.at(dmost, s["left"], np.where(s["second"], 0, dp[:, :FILTERS]))
    np.add.at(dmost, s["left"] + 1, np.where(s["second"], dp[:, :FILTERS], 0))
    np.add.at(dmean, s["left"], dp[:, FILTERS:] / 2)
    np.add.at(dmean, s["left"] + 1, dp[:, FILTERS:] / 2)
    g["conv"], g["cb"], g["emb"] = np.zeros_like(p["conv"]), np.zeros_like(p["cb"]), np.zeros_like(p["emb"])
    step = BLOCK // HALF
    for a in range(0, n, step):
        b = min(n, a + step)
        rows = _positions(flat, p["emb"], a * HALF, b * HALF)
        act = rows @ p["conv"] + p["cb"]
        d = np.repeat(dmean[a:b] / HALF, HALF, axis=0).reshape(b - a, HALF, FILTERS)
        np.put_along_axis(d, s["where"][a:b, None, :], np.take_along_axis(d, s["where"][a:b, None, :], 1) + dmost[a:b, None, :], 1)
        d = d.reshape(-1, FILTERS)
        d[act <= 0] = 0
        g["conv"] += rows.T @ d
        g["cb"] += d.sum(axis=0)
        back = (d @ p["conv"].T).reshape(-1, WIDTH, EMBED)
        codes = flat[a * HALF * STRIDE + np.arange(0, (b - a) * HALF * STRIDE, STRIDE)[:, None] + np.arange(WIDTH)[None, :]]
        for e in range(EMBED):
            g["emb"][:, e] += np.bincount(codes.ravel(), back[:, :, e].ravel(), 257).astype(np.float32)
    return g


def train(texts: list[bytes], labels: list[int], epochs: int = 6, batch: int = 16, rate: float = 0.004, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters fitted to the labelled texts; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    p = initial(rng)
    arrays, y = [np.frombuffer(t, np.uint8) for t in texts], np.array(labels, np.float32)
    share = np.bincount(y.astype(int), minlength=2) / max(1, len(y))
    weight = np.where(y > 0, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9)).astype(np.float32)
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(arrays))
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            g = _gradients(*layout([arrays[i] for i in ids]), y[ids], weight[ids], p)
            t += 1
            now = rate * (1 - epoch / epochs)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return p


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[bytes], list[int]]:
    """Of each class the labelled documents with the smallest hashes of doc_id, outside the held-out fifth.

    An id with both labels counts as label 0. Labels other than 0 and 1, null
    ids and null texts take no part.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(crc_mod("doc_id", 5) != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    found = draw(docs, "quality", per_class, known)
    return [r["text"].encode() for r in found], [r["quality"] for r in found]


def score(docs: DataFrame, params: dict[str, np.ndarray] | None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score and predicted, under the given names (columns of these names are replaced).

    Null counts as empty; an empty text is scored as padding alone. Without
    parameters (no labelled rows of both classes) every score is 1. Rows are
    independent of each other; whole texts are scored.
    """
    base = docs.drop(*names)
    schema = base.select("*", F.lit(0.0).alias(names[0]), F.lit(1).alias(names[1])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = utf8(part.column("text"))
                got = probabilities([data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], params) if params else np.ones(len(at) - 1)
                cols = {c: part.column(c) for c in part.schema.names}
                yield pa.RecordBatch.from_pydict(cols | {names[0]: got, names[1]: (got >= THRESHOLD).astype(np.int32)})

    return base.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | None:
    texts, y = sample(docs, labels)
    return train(texts, y) if len(set(y)) == 2 else None


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    params = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, params).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op2_quality_cnn": op2_quality_cnn}
SQL: dict[str, str] = {}
