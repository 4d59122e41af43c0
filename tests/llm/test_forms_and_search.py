"""Fill-in-the-middle, SimHash and ranked search: brute force, round trips, odd inputs."""

import collections
import hashlib
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from tallyforge.llm import fim, lexical, registry, simhash

DATA = "/root/testdata/sf0.001"


def fim_by_hand(doc_id, t):
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fim_by_hand(spark):
    rnd = random.Random(5)
    texts = ["", None, "a", "é", "<P>", "x<S>y", "<P", "S>", "<", ">", "<M", "日本語 text 🙂 ends", "<<<>>>", "\0\0", "word " * 200_000]
    texts += ["".join(rnd.choice("ab<>PSMé🙂\n ") for _ in range(rnd.randrange(0, 40))) for _ in range(600)]
    rows = [(i if i % 50 else None, t, "form of its own", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, `odd name` string")
    for parts in (1, 7):
        got = fim.restore(fim.transform(docs.repartition(parts)), into="text again").collect()
        want = collections.Counter((i, t, o, *fim_by_hand(i, t or ""), t or "") for i, t, _, o in rows)
        assert collections.Counter((r["doc_id"], r["text"], r["odd name"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["text again"]) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.restore(fim.transform(docs.limit(0))).collect() == []


def test_fim_outputs_that_are_not_of_their_form(spark):
    rows = [("<P>a<S>b<M>c", "psm", "acb"), ("<P>a<S>b<M>c", "spm", None), ("<S>b<P>a<M>c", "spm", "acb"), ("<P>a<P>a<S>b<M>c", "psm", None), ("z<P>a<S>b<M>c", "psm", None), ("", "psm", None), (None, "plain", ""), ("<P>a", None, "<P>a"), ("<P><S><M>", "psm", ""), ("<P>a<S>b", "psm", None), ("q", "other", "q")]
    got = fim.restore(spark.createDataFrame(rows, "output string, form string, want string").coalesce(1)).collect()
    assert [r["restored"] for r in got] == [r["want"] for r in got]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def fingerprint(t, width=4):
    ws = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[i : i + width]).encode(), 42) for i in range(max(1, len(ws) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(points, bits):
    """The smallest index reachable from each of points, over all pairs."""
    x = np.array(points, np.uint64)
    label = np.arange(len(x))
    while True:
        new = np.array([label[np.bitwise_count(x ^ p) <= bits].min() for p in x]) if len(x) else label
        if (new == label).all():
            return label
        label = new


def test_simhash_query_by_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    points = [fingerprint(t) for _, t in docs]
    label = roots(points, 4)
    got = sorted(map(tuple, simhash.op12_simhash(spark, DATA).collect()))
    assert got == [(i, f"{p:016x}", docs[k][0]) for (i, _), p, k in zip(docs, points, label)]


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 5, 7])
@pytest.mark.parametrize("slice_", [24, 8192])
def test_simhash_links(spark, monkeypatch, bits, slice_):
    """Clusters around random points, each member so many bits off another; all links found, in whole cells and in sliced ones."""
    monkeypatch.setattr(simhash, "SLICE", slice_)
    rnd = random.Random(bits)
    points = set()
    for _ in range(30):
        members = [rnd.getrandbits(64)]
        for _ in range(rnd.choice([1, 3, 60])):
            p = rnd.choice(members)
            for b in rnd.sample(range(64), rnd.randrange(0, bits + 3)):
                p ^= 1 << b
            members.append(p)
        points |= set(members)
    points = sorted(points | {0, 1, (1 << 64) - 1, (1 << 64) - 2})
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bits).collect()
    at = {p: k for k, p in enumerate(signed)}
    label = list(range(len(points)))
    for _ in points:
        was = list(label)
        for r in found:
            a, b = at[r["a"]], at[r["b"]]
            label[a] = label[b] = min(label[a], label[b])
        if was == label:
            break
    assert label == roots(points, bits).tolist()


def test_stars_of_large_runs():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 62, 40).astype(np.uint64)
    points = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << b) for b in range(0, 60, 3)), *(base ^ np.uint64(0b11111 << b) for b in (0, 20))]))
    a, b = simhash.stars(np.zeros(len(points), np.int64), points, 4)
    at = {p: k for k, p in enumerate(points.tolist())}
    label = np.arange(len(points))
    for _ in range(20):
        for x, y in zip(a.tolist(), b.tolist()):
            label[at[x]] = label[at[y]] = min(label[at[x]], label[at[y]])
    assert label.tolist() == roots(points.tolist(), 4).tolist()
    assert len(a) < len(points)


def test_simhash_odd_inputs(spark):
    rnd = random.Random(8)
    long = " ".join(f"w{rnd.randrange(5000)}" for _ in range(80_000))
    near = long.replace("w7 ", "v7 ", 3)
    rows = [(9, None), (4, ""), (7, " \n\t"), (3, "One two"), (3, "lone"), (8, "one TWO"), (None, "lone"), (None, "x y z"), (11, long), (10, near), (12, "lone"), (2, "İstanbul ÀB c d e")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, fp string")
    got = collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert bin(fingerprint(long) ^ fingerprint(near)).count("1") <= 4
    root = {9: 4, 4: 4, 7: 4, 3: 3, 8: 3, 12: 3, None: None, 11: 10, 10: 10, 2: 2}
    assert got == collections.Counter((i, f"{fingerprint(t):016x}", root[i]) for i, t in rows)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def search_by_hand(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    size, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(x for _, c in counted for x in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked[i] = min((x for x in (asked.get(i), t) if x is not None), default=None)
    out = []
    for item, text in asked.items():
        scored = []
        for i, c in counted:
            m = 25 + 75 * sum(c.values()) * size // total
            s = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m)) for x in terms(text) if x in c)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_search_by_brute_force(spark, monkeypatch):
    rnd = random.Random(21)
    vocabulary = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.choice([1, 5, 40, 200])))) for i in range(700)]
    docs += [(700 + i, docs[i][1]) for i in range(0, 100, 5)]  # ties
    docs += [(None, "w1 w2 only"), (3, "w5 twice the id"), (5000, None), (5001, ""), (5002, "... !"), (5003, "w250 " * 60_000), (5004, "É-w9_w9 ÉÉ w9x")]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 2, 8, 60])))) for i in range(60)]
    items += [(100, "w1 w1 w1 W299"), (101, "nothing here"), (102, None), (103, ""), (104, "É é w9"), (None, "w1"), (105, "w2"), (105, "w3"), (106, " ".join(vocabulary))]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = search_by_hand(docs, items)
    for size, block in ((1 << 16, 256), (50, 7)):
        monkeypatch.setattr(lexical, "DOCS", size)
        monkeypatch.setattr(lexical, "BLOCK", block)
        monkeypatch.setattr(lexical, "TERMS", 40 if block == 7 else 1 << 20)
        assert sorted(map(tuple, lexical.rank(d.repartition(3), q).collect())) == want
    assert lexical.rank(d.limit(0), q).collect() == [] and lexical.rank(d, q.limit(0)).collect() == []
    assert sorted(map(tuple, lexical.rank(d, q, k=1).collect())) == search_by_hand(docs, items, 1)


def test_search_reads_no_more_than_it_needs():
    """Bounds close before the lists end: impacts of a long list that can't matter aren't added up."""

    class Watched(np.ndarray):
        parts: list = []

        def __getitem__(self, key):
            if isinstance(key, slice):
                Watched.parts.append((key.start or 0, key.stop))
            return super().__getitem__(key)

    n = 10_000
    long = np.sort(np.random.default_rng(1).integers(1, 1000, n))[::-1].copy()
    lists = [(np.arange(n), long.view(Watched)), (np.arange(20), np.full(20, 10_000)), (np.arange(20), np.full(20, 9_000))]
    place, score = lexical.best(lists, np.arange(n), 10)
    assert place.tolist() == list(range(10)) and score.tolist() == [19_000 + int(x) for x in long[:10]]
    assert max(stop for _, stop in Watched.parts) < n / 2


def test_length_factor_of_large_numbers():
    n = np.array([1, 7_000_000], np.int64)
    size, total = 20_000_000_000, 30_000_000_000_000
    assert lexical.length_factor(n, size, total).tolist() == [25 + 75 * int(x) * size // total for x in n]


@pytest.mark.parametrize("name", ["op11_fim", "op13_lexical"])
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    got = registry.queries()[name](spark, DATA)
    columns = ", ".join(sorted(got.columns))
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=repr) == sorted(db.sql(f"SELECT {columns} FROM ({registry.oracle_sql()[name]})").fetchall(), key=repr)
