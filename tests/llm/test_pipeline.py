"""The pipeline's stages on a small table, each against plain Python, and on odd rows."""

import collections
import hashlib
import math
import os
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import mixing, quality_cnn, registry
from tallyforge.llm.sentencepiece import default_model
from tallyforge.sources import shared

DATA = "/root/testdata/sf0.001"
LIMIT = 200


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def components(rows, width=5, percent=80):
    """doc_id: smallest doc_id reachable, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                label[y] = x
    return {i: find(i) for i, _ in rows}


def without_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i : i + LIMIT] for r in raw for i in range(len(r) - LIMIT + 1))
    out = []
    for t, r in zip(texts, raw):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - LIMIT + 1):
            if count[r[i : i + LIMIT]] > 1:
                gone[i : i + LIMIT] = True
        out.append(bytes(np.frombuffer(r, np.uint8)[~gone]).decode("utf-8", "ignore") if gone.any() else t)
    return out


def budgets(sizes):
    """Targets by repeated sharing: what is over a cap goes to the sources below theirs, by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def mixed(rows):
    """(doc_id, words) of the mix of (doc_id, source, text): whole epochs, then a cut in order of hashes."""
    sizes = collections.Counter()
    for _, s, t in rows:
        sizes[s] += len(words(t))
    out = []
    for s, target in budgets(sizes).items():
        epochs = int(target // sizes[s]) if sizes[s] else 0
        rest = math.floor(target - epochs * sizes[s] + 1e-9)
        key = lambda r: (hashlib.md5(f"{'' if r[0] is None else r[0]}:{mixing.SEED}".encode()).hexdigest(), r[0] is None, r[0] or 0)
        for i, _, t in sorted((r for r in rows if r[1] == s), key=key):
            w = words(t)
            part = min(len(w), rest)
            rest -= part
            out += [(i, tuple(w))] * (epochs if w else 1)
            if part:
                out.append((i, tuple(w[:part])))
    return sorted(out, key=repr)


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, frames = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], DATA).write.parquet(f"{tmp_path}/{k}")
        frames.append(spark.read.parquet(f"{tmp_path}/{k}"))
        assert k == 4 or frames[-1].columns == names, name
    rows = [f.collect() for f in frames]
    # quality classifier: each text scored alone
    params = quality_cnn.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    score = {r["doc_id"]: quality_cnn.probabilities([np.frombuffer((r["text"] or "").encode(), np.uint8)], params)[0] for r in rows[0]}
    assert sorted(r["doc_id"] for r in rows[1]) == sorted(i for i, s in score.items() if s >= 0.3)
    assert 0 < len(rows[1]) < len(rows[0])
    # near-dedup
    root = components([(r["doc_id"], r["text"]) for r in rows[1]])
    assert sorted(map(tuple, rows[2])) == sorted(tuple(r) for r in rows[1] if root[r["doc_id"]] == r["doc_id"])
    # suffix array
    left = without_repeats([r["text"] for r in rows[2]])
    assert sorted((r["doc_id"], r["text"]) for r in rows[3]) == sorted((r["doc_id"], t) for r, t in zip(rows[2], left))
    # mixing
    got = sorted(((r["doc_id"], tuple(words(r["text"]))) for r in rows[4]), key=repr)
    assert got == mixed([(r["doc_id"], r["source"], r["text"]) for r in rows[3]])
    # tokens
    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = sorted((r["doc_id"], hashlib.sha256(",".join(map(str, model.encode(r["text"] or ""))).encode()).hexdigest()) for r in rows[4])
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in rows[5]) == want


CLASH = ["score", "predicted", "raw", "h1", "h2", "copies", "spans", "row", "one", "two", "size", "taken", "group", "n_shingles", "row_one", "letters", "_i", "_key", "bands"]


def odd(spark):
    prose = " ".join(f"w{k * 7919 % 1000}" for k in range(300))
    long = " ".join(f"x{k * 104729 % 99991}" for k in range(60_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "one", None), (4, prose, "b"), (5, prose, "a"), (6, prose + " end", "b"), (7, long, "c"), (8, "same row", "c"), (8, "same row", "c"), (8, "another text", "c"), (None, "no id here", "a"), (None, "no id here", "a"), (None, None, None)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.concat_ws("-", F.lit(c), "doc_id").alias(c) for c in CLASH])


def test_odd_rows_keep_all_their_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs, before = spark.read.parquet(f"{tmp_path}/{k}"), docs.collect()
        rows = docs.collect()
        assert docs.columns == odd(spark).columns, name
        assert all(r[c] == "-".join([c, str(r["doc_id"])] if r["doc_id"] is not None else [c]) for r in rows for c in CLASH), name
        of = lambda rs: sorted(str(r["doc_id"]) for r in rs)
        if k == 0:  # no labels: every document stays
            assert of(rows) == of(before)
        if k == 1:
            assert of(rows) == sorted(["1", "2", "3", "4", "7", "8", "None", "None"])
        if k == 2:
            assert of(rows) == of(before) and {r["doc_id"]: r["text"] for r in rows}[1] is None
        if k == 3:
            got = sorted(((r["doc_id"], tuple(words(r["text"]))) for r in rows), key=repr)
            assert got == mixed([(r["doc_id"], r["source"], r["text"]) for r in before])
    last = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert len(last) == docs.count() and {r["ids_sha256"] for r in last if r["doc_id"] in (1, 2)} == {hashlib.sha256(b"").hexdigest()}


def test_equal_rows_in_the_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TIMES", 3)
    rows = [(1, "a", "u v w x")] * 10 + [(2, "a", "p q")] * 2 + [(None, "a", f"n{k % 3}") for k in range(12)] + [(5, "b", "y " * 40), (6, "b", None)]
    docs = spark.createDataFrame([(i, s, t) for i, s, t in rows], "doc_id long, source string, text string")
    sizes = {"a": 40 + 4 + 12, "b": 40}
    target = budgets(sizes)
    for d in (docs, docs.repartition(5)):
        got = mixing.take(mixing.sized(d)).collect()
        assert len(got) == len(rows)
        for s in sizes:
            assert sum(r["taken"] for r in got if r["source"] == s) == math.floor(target[s] + 1e-9)
        assert all(r["taken"] <= 2 * r["size"] for r in got)
        out = mixing.mix(d).collect()
        for s in sizes:
            assert sum(len(words(r["text"])) for r in out if r["source"] == s) == math.floor(target[s] + 1e-9)


@pytest.mark.parametrize("k", range(4))
def test_empty_tables(spark, tmp_path, k):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd(spark).limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)).collect() == []


def test_run_removes_what_it_no_longer_needs(spark):
    """Another operator of the session keeps its files while the pipeline runs; of the pipeline's only the last stage stays, and goes with the caller's scope."""
    root = shared.shared_dir(spark).removeprefix("file:").replace("//", "/")
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(root) for f in names}
    own = shared.checkpoint(spark.range(10))
    before = files()
    with shared.scope(spark) as mine:
        rows = corpus_pipeline.run(spark, DATA)
        assert rows.count() > 0 and "ids_sha256" in rows.columns and len(mine) == 1
        assert [f for f in files() - before if "/stage-sentencepiece-" not in f] == []
    assert files() == before and own.count() == 10


@pytest.mark.parametrize("name", ["op1_near_dedup", "op7_topk", "op8_ngram_lm", "op10_suffix_dedup", "op12_simhash", "op13_lexical"])
def test_queries_leave_nothing_in_the_shared_folder(spark, name):
    root = shared.shared_dir(spark).removeprefix("file:").replace("//", "/")
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(root) for f in names}
    before = files()
    with shared.scope(spark):
        registry.queries()[name](spark, DATA).count()
        assert files() != before
    assert files() == before
