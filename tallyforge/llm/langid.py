"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by gradient descent in numpy.

A text's features are its byte n-grams (A-Z as a-z), hashed into BUCKETS rows
of an embedding; the text is the mean of its rows, and a softmax over the
languages follows. Training draws a bounded sample of labelled rows and cuts
each whole text anew in each epoch into pieces of mixed lengths, every one of
which is learnt from; a text's pieces weigh as much as one text. A part of the
sample is kept back to fit a temperature, and the confidence below which a
prediction is marked as not accepted. For scoring, the embedding times the
softmax weights is one small table, and every n-gram of the whole text is
looked up in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, draw, slices, unused, utf8

BUCKETS = 1 << 16
DIM = 16
ORDERS = (2, 3, 4)
#: Labelled rows that training takes from each language, at most; which ones a hash decides.
PER_LANGUAGE = 400
#: Lengths in bytes of the pieces that training cuts texts into.
PIECES = (60, 200, 1000, 2000)
#: Bytes of a text whose n-grams are held at a time.
BLOCK = 1 << 20
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MASK = {n: np.uint32((1 << (8 * n)) - 1) for n in ORDERS}
_MULTIPLIER = {n: np.uint32(m) for n, m in zip(ORDERS, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=True)}


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    accept: float


def grams(text: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text's bytes, with a space on either side, from a block of the text at a time."""
    padded = np.full(len(text) + 5, 32, np.uint8)
    padded[1 : len(text) + 1] = _FOLD[text]
    four = np.ndarray(len(text) + 2, "<u4", padded.tobytes(), strides=(1,))
    for at in range(0, len(text) + 1, BLOCK):
        yield np.concatenate([((four[at : max(at, min(at + BLOCK, len(text) + 3 - n))] & _MASK[n]) * _MULTIPLIER[n]) >> np.uint32(16) for n in ORDERS])


def mean_logits(text: np.ndarray, logits: np.ndarray) -> np.ndarray:
    """The mean of the rows of a text's n-grams. Those of a long text are counted by bucket, so that memory doesn't grow with it."""
    if len(text) < BUCKETS // len(ORDERS):
        return np.take(logits, np.concatenate(list(grams(text))), axis=0).mean(axis=0, dtype=np.float64)
    counts = np.zeros(BUCKETS, np.int64)
    for found in grams(text):
        counts += np.bincount(found, minlength=BUCKETS)
    return (counts / counts.sum()) @ logits


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[bytes], langs: list[str], epochs: int = 3, rate: float = 0.5, seed: int = 5) -> Model:
    """A model of the languages in langs; every fifth row is kept back for the calibration."""
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    y = np.searchsorted(languages, langs)
    weight = len(y) / (len(languages) * np.bincount(y, minlength=len(languages)))
    order = rng.permutation(len(texts))
    held, fit = order[::5], order[np.arange(len(order)) % 5 != 0] if len(order) > 1 else order
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    soft, bias = rng.normal(0, 0.5, (DIM, len(languages))), np.zeros(len(languages))
    arrays = [np.frombuffer(t, np.uint8) for t in texts]

    def pieces(i: int) -> list[np.ndarray]:
        size = len(arrays[i])
        cuts = np.cumsum(rng.choice(PIECES, size // min(PIECES) + 1))
        return np.split(arrays[i], cuts[cuts < size])

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            parts = pieces(i)
            for part in parts:
                g, n = np.unique(np.concatenate(list(grams(part))), return_counts=True)
                share = (n / n.sum())[:, None]
                x = (emb[g] * share).sum(axis=0)
                err = _softmax(x @ soft + bias)
                err[y[i]] -= 1
                err *= min(weight[y[i]], 10.0) / len(parts)
                back = soft @ err
                soft -= step * np.outer(x, err)
                bias -= step * 0.1 * err
                emb[g] -= step * 20 * share * back
    logits = (emb @ soft).astype(np.float32)
    # the calibration sees the first piece of each text, and the whole text
    z = np.array([mean_logits(a, logits) + bias for i in held for a in (pieces(i)[0], arrays[i])]) if len(held) else np.zeros((0, len(languages)))
    held = np.repeat(held, 2)
    best, loss = 1.0, np.inf
    for t in np.geomspace(0.5, 10, 31) if len(held) else ():
        now = -np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
        if now < loss:
            best, loss = float(t), now
    sure = np.sort(_softmax(z / best).max(axis=1)[z.argmax(axis=1) == y[held]]) if len(held) else np.zeros(0)
    return Model(languages, logits, bias, best, float(sure[len(sure) // 100]) if len(sure) else 0.0)


def sample(docs: DataFrame, train_on) -> tuple[list[bytes], list[str]]:
    """The training rows: of each language PER_LANGUAGE distinct ones, drawn by a hash."""
    found = draw(docs.where(train_on), "lang", PER_LANGUAGE)
    return [r["text"].encode() for r in found], [r["lang"] for r in found]


def identify(docs: DataFrame, model: Model | None, reject: bool = True) -> DataFrame:
    """docs with lang_pred, score and accepted (columns of these names are replaced).

    A text that is null or has no letter is `und` with score 0, as is every
    text if the model is None (nothing to learn from). With reject, a
    prediction less sure than 99 of 100 right ones of the calibration rows is
    not accepted, but still named. Rows are independent of each other.
    """
    base = docs.drop("lang_pred", "score", "accepted")
    schema = base.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("accepted")).schema
    (flag,) = unused(base, "letters")
    base = base.withColumn(flag, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = utf8(part.column("text"))
                names, scores = [], []
                for i, letters in enumerate(part.column(flag).to_pylist()):
                    if not letters or model is None:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    z = mean_logits(data[at[i] : at[i + 1]], model.logits) + model.bias
                    p = _softmax(z / model.temperature)
                    names.append(model.languages[int(p.argmax())])
                    scores.append(float(p.max()))
                sure = [n != UNKNOWN and not (reject and s < model.accept) for n, s in zip(names, scores, strict=True)]
                cols = {c: part.column(c) for c in part.schema.names if c != flag}
                yield pa.RecordBatch.from_pydict(cols | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()), "accepted": pa.array(sure, pa.bool_())})

    return base.mapInArrow(run, schema)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = crc_mod("doc_id", 3) == 1
    texts, langs = sample(docs, ~held)
    model = train(texts, langs) if texts else None
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


QUERIES = {"op6_langid": op6_langid}
SQL: dict[str, str] = {}
