"""The numbered operators on small fixtures: brute force, round trips, held-out accuracy, odd inputs."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import arrays, elias_fano, langid, minhash, mixing, ngram_lm, quality_cnn, quality_rules, sharding, suffix_dedup, suffix_sort, topk
from tallyforge.llm import registry
from tallyforge.llm import sentencepiece as sp
from tallyforge.llm.common import draw
from tallyforge.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], SCHEMA)


def odd(spark):
    long = " ".join(random.Random(1).choice(["ab", "cd", "ef", "gh"]) + str(k % 911) for k in range(20_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "one", None), (4, "same text here", "b"), (4, "same text here", "b"), (5, long, "b"), (None, "no id at all", "a"), (None, None, None)]
    return frame(spark, rows)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_odd_and_empty_inputs(spark):
    for docs in (odd(spark), odd(spark).limit(0)):
        n = docs.count()
        assert minhash.near_duplicates(docs).count() == n
        assert quality_rules.apply_rules(docs).count() == n
        assert sharding.place(docs, ["a", "b"]).count() == n
        assert mixing.take(mixing.sized(docs)).count() == n
        assert mixing.mix(docs).columns == docs.columns
        assert langid.identify(docs, None).count() == n
        assert quality_cnn.score(docs, None).count() == n
        assert sp.digest(docs, sp.default_model()).count() == n
        assert suffix_dedup.digest(docs).count() == n
        assert suffix_dedup.strip(docs).columns == docs.columns
        assert ngram_lm.score(docs, ngram_lm.train(docs), ["doc_id"]).count() == n
    model = ngram_lm.train(odd(spark))
    for docs in (odd(spark),):
        null = lambda df, *cols: [tuple(r[c] for c in cols) for r in df.collect() if r["doc_id"] in (1, 2)]
        empty = hashlib.sha256(b"").hexdigest()
        assert null(langid.identify(docs, None), "lang_pred", "score", "accepted") == [("und", 0.0, False)] * 2
        assert null(sp.digest(docs, sp.default_model()), "n_tokens", "ids_sha256", "decoded_sha256") == [(0, empty, empty)] * 2
        assert null(suffix_dedup.digest(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == [(0, 0, 0, empty)] * 2
        assert null(quality_rules.apply_rules(docs), "n_words", "n_repeat_words", "base_failed", "kept") == [(0, 0, True, False)] * 2
        scored = ngram_lm.score(docs, model, ["doc_id", "score", "lang"])
        assert scored.columns == ["doc_id", "lang", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        assert null(scored, "n_tokens", "n_known") == [(1, 1)] * 2
        params = quality_cnn.initial(np.random.default_rng(0))
        alone = quality_cnn.probabilities([np.zeros(0, np.uint8)], params)[0]
        assert all(abs(s - alone) < 1e-6 for (s,) in null(quality_cnn.score(docs, params), "score"))
        found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
        assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, None: None}
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (50, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [0.5, 0.5]), (6, [])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(vectors).collect()] == [(0, 1, 5, 128 * 256 + 128 * 512)]
    assert topk.top_k(vectors.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000, 1000 + k) for k in range(1, 400)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for e in edges for x in e)


def test_near_duplicates_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 120))]
        for _ in range(6):
            rows.append(" ".join(rnd.choice(vocabulary) if rnd.random() < 0.05 else w for w in base))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, [(i, t, "a") for i, t in enumerate(rows)]), width=2).collect()}
    sets = [set(zip(words(t), words(t)[1:])) for t in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert [got[i] for i in range(len(rows))] == comp


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rnd = random.Random(12)
    text = lambda n: " ".join(f"w{rnd.randrange(10_000)}" for _ in range(n))
    near = lambda t: t + " more"
    a, b, c, d = (text(60) for _ in range(4))
    rows = [(1, a), (1, b), (5, near(a)), (6, near(b)), (7, c), (8, None), (8, near(c)), (3, ""), (None, d), (12, near(d)), (None, near(near(d))), (6, near(b)), (None, "alone"), (None, "alone"), (2, " ")]
    docs = frame(spark, [(i, t, "a") for i, t in rows])
    got = sorted(((r["doc_id"] or 0, r["component_id"] or 0, r["n_shingles"], r["kept"]) for r in minhash.near_duplicates(docs).collect()))
    n = lambda t: max(len(words(t)) - 4, 1 if words(t) else 0)
    root = {1: 1, 5: 1, 6: 1, 7: 7, 8: 7, 3: 3, 12: 12, 2: 2, None: 0}
    assert got == sorted((i or 0, root[i], n(t), i is None or root[i] == i) for i, t in rows)
    kept = minhash.deduplicate(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["1", "7", "8", "3", "12", "None", "2"])
    assert [r["text"] for r in kept if r["doc_id"] == 8] == [None] and len({r["text"] for r in kept if r["doc_id"] is None}) == 1


def test_recall_at_the_threshold(spark):
    """Pairs of texts of 80 to 85 % similarity: all but one in a hundred at most are found."""
    rnd = random.Random(13)
    rows, pairs = [], 0
    while pairs < 2000:
        base = [f"w{rnd.randrange(10**9)}" for _ in range(rnd.randrange(40, 120))]
        other = list(base)
        for k in rnd.sample(range(len(base)), rnd.randrange(2, 7)):
            other[k] = f"x{rnd.randrange(10**9)}"
        a, b = (set(zip(x, x[1:])) for x in (base, other))
        if 80 * len(a | b) <= 100 * len(a & b) <= 85 * len(a | b):
            rows += [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(other))]
            pairs += 1
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, [(i, t, "a") for i, t in rows]), width=2).collect()}
    assert all(got[2 * k] == 2 * k and got[2 * k + 1] in (2 * k, 2 * k + 1) for k in range(pairs))
    assert sum(got[2 * k + 1] == 2 * k for k in range(pairs)) >= 0.99 * pairs


def test_sketches():
    rnd = np.random.default_rng(3)
    a = np.unique(rnd.integers(0, 1 << 62, 600).astype(np.uint64))
    b = np.unique(np.r_[a[:560], rnd.integers(0, 1 << 62, 40).astype(np.uint64)])
    wide = minhash.parities([a, b]).view(np.uint64)
    assert np.bitwise_count(wide[0] ^ wide[1]).sum() <= len(np.setxor1d(a, b))
    small = minhash.odd_sketches(np.array([minhash.minima(a), minhash.minima(b)])).view(np.uint64)
    assert np.bitwise_count(small[0] ^ small[1]).sum() <= minhash.most_different(0.8)


def test_last_round_pairs():
    rnd = np.random.default_rng(0)
    whole = rnd.integers(0, 1 << 62, (20, 32)).astype(np.uint64) | np.uint64(1 << 63)
    whole[7] = whole[3]
    sketch = np.zeros((20, 16), np.uint64)
    i, j = minhash._near_in_cell(np.arange(20), np.zeros(20, int), np.full(20, 100), sketch, whole, True, 80)
    assert list(zip(i.tolist(), j.tolist())) == [(3, 7)]


def test_last_round_deals_only_across_components(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 16)
    monkeypatch.setattr(minhash, "TOGETHER", 40)
    # one stray among 600; three components and strays; no large component; small buckets
    buckets = {1: [0] * 600 + [1], 2: [0] * 90 + [1] * 30 + [2] * 20 + list(range(3, 23)), 3: list(range(50)), 4: [0] * 9 + [1], 5: [7, 8], 6: [0, 0, 5]}
    open_ = spark.createDataFrame([(k, 1000 * k + i, 1000 * k + c) for k, cs in buckets.items() for i, c in enumerate(cs)], "key long, id long, c long")
    rows = minhash._dealt(open_).collect()
    assert sum(r["key"] == 1 for r in rows) <= 600 + 1 + 600 // 16 + 1
    assert max(collections.Counter(r["g"] for r in rows).values()) <= 4 * 40
    cells = collections.defaultdict(list)
    for r in rows:
        cells[r["key"], r["x"], r["y"]].append(r)
    met = collections.Counter()
    for (_, x, y), members in cells.items():
        assert len({r["g"] for r in members}) == 1
        met.update((min(a["id"], b["id"]), max(a["id"], b["id"])) for i, a in enumerate(members) for b in members[:i] if a["c"] != b["c"] and (x == y or a["s"] != b["s"]))
    want = {(1000 * k + j, 1000 * k + i) for k, cs in buckets.items() for i in range(len(cs)) for j in range(i) if cs[i] != cs[j]}
    assert set(met) == want and set(met.values()) == {1}
    # all sketches equal: the last round finds each of these pairs
    reps = open_.select("id", F.lit(10).cast("long").alias("n"), F.array_repeat(F.lit(3).cast("long"), 16).alias("sketch"), F.array_repeat(F.lit(5).cast("long"), 32).alias("whole"))
    assert {(r["a"], r["b"]) for r in minhash._across(open_, reps, 80).collect()} == want


def test_bpe_equals_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    rnd = random.Random(7)
    texts = ["", " ", "▁", "a▁b", "<s> <unk> </s>", "日本 😀", "x" * 50, " " * 40, "\x00\n\t"] + ["".join(rnd.choice("abe tinré▁ö \n日=-0") for _ in range(rnd.randrange(300))) for _ in range(200)]
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in sp.digest(docs, sp.default_model()).collect()}
    for i, t in enumerate(texts):
        ids = model.encode(t)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    back = sp.decode(sp.encode(docs, sp.default_model()), sp.default_model(), out="again")
    assert all(r["again"] == model.decode(model.encode(r["text"])) for r in back.collect())


def test_long_words_equal_library():
    model = sentencepiece.SentencePieceProcessor(model_file=sp.default_model())
    rnd = random.Random(17)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    prose = "".join(rnd.choice("the of and into with nation ing er est un re".split()) for _ in range(4000))
    texts = ["".join(rnd.choice(base64) for _ in range(60_000)), prose, "a" * 5001, "ab" * 3000, " " * 3000 + "x", "日本語" * 700 + "ÿ" * 3, "".join(chr(rnd.randrange(33, 0x3000)) for _ in range(4000)), prose[:999] + " " + prose]
    coder = sp.Coder(sp.default_model())
    for t in texts:
        assert coder.encode([t, "short " + t[:50]])[0] == model.encode(t)
    few = ["ab", "aba", "aab", "hing", "a", "\n\n", "  ", "=="]
    for _ in range(300):
        t = "".join(rnd.choice(few) for _ in range(rnd.randrange(2, 30)))
        assert coder.encode([t])[0] == model.encode(t)
    long = ["".join(rnd.choice(few) for _ in range(900)) for _ in range(3)]
    assert coder.encode(long) == model.encode(long)


def test_deep_shallow_sort():
    rnd = random.Random(5)
    strings = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randrange(0, 90))) for _ in range(400)]
    strings += [b"x" * 60 + bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 9))) for _ in range(300)] + strings[:50]
    order, common = suffix_sort.deep_shallow_sort(strings)
    ordered = [strings[i] for i in order]
    assert ordered == sorted(strings)
    assert all(c == suffix_sort.lcp(a, b) for a, b, c in zip(ordered, ordered[1:], common[1:]))


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 12, 2])
def test_suffix_dedup_brute_force(spark, hot):
    rnd = random.Random(6)
    alphabet = "abcdefgh é"
    passage = ["".join(rnd.choice(alphabet) for _ in range(n)) for n in (230, 199, 420)]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 400))) + rnd.choice(passage) + "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 300))) for _ in range(24)]
    texts += ["and " * 200, texts[0], texts[0], passage[0] * 2, "x" * 200, "y" * 201, "z" * 3000, "ab" * 900 + "z" * 900, None, ""]
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i : i + 200] for r in raw for i in range(len(r) - 199))
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in suffix_dedup.digest(docs, hot=hot).collect()}
    cut = {r["doc_id"]: r["text"] for r in suffix_dedup.strip(docs, hot=hot).collect()} if hot == 12 else {}
    for i, r in enumerate(raw):
        gone = bytearray(len(r))
        for p in range(len(r) - 199):
            if count[r[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        left = bytes(b for b, g in zip(r, gone) if not g)
        assert got[i]["n_removed"] == sum(gone), i
        assert got[i]["n_spans"] == len(re.findall(b"\1+", bytes(gone)))
        assert got[i]["kept_sha256"] == hashlib.sha256(left).hexdigest()
        assert not cut or cut[i] == (None if texts[i] is None else left.decode("utf-8", "ignore") if sum(gone) else texts[i])


def test_steady_surroundings():
    for text in (b"x" * 5000, b"and " * 1000, b"abc" * 900 + b"x" * 900 + b"q" + b"x" * 900, bytes(np.random.default_rng(1).integers(97, 123, 4000).astype(np.uint8)) + b"y" * 700):
        raw = np.frombuffer(text, np.uint8)
        place, anchor = suffix_dedup.anchors(raw, 200)
        head, reach = suffix_dedup.steady(raw, place, anchor, 200)
        around = lambda p: text[max(0, p - 176) : p + 200]
        ends = np.r_[head[1:], len(place)]
        for h, e, r in zip(head, ends, reach):
            assert place[e - 1] - place[h] == r and len({around(p) for p in place[h:e]}) == 1
            assert (anchor[h:e] == anchor[h]).all() and len(set(np.diff(place[h:e]))) <= 1
        if text[:1] == b"x":
            assert len(head) < 600


def test_shards_of_sorted_hashes(tmp_path):
    rnd = np.random.default_rng(2)
    known = np.unique(rnd.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    for k in range(16):
        mine = known[known >> np.uint64(60) == k]
        if k != 3:
            arrays.save(f"file://{tmp_path}", f"shard-{k}", {"hash": mine, "v": (mine % np.uint64(5)).astype(np.uint8)})
    shards = arrays.SortedShards(f"file://{tmp_path}", 4, "v")
    asked = np.r_[known, rnd.integers(0, 1 << 62, 100).astype(np.uint64) * np.uint64(2) + np.uint64(1)]
    want = [int(x % np.uint64(5)) if x in set(known.tolist()) and int(x) >> 60 != 3 else -1 for x in asked.tolist()]
    assert shards.find(asked).tolist() == want and shards.find(asked[:0]).tolist() == []


def test_elias_fano():
    rnd = np.random.default_rng(1)
    for n, universe in ((1, 10), (1000, 2000), (5000, 10**12)):
        values = np.unique(np.r_[rnd.integers(0, universe, n), rnd.integers(0, max(2, universe // 1000), n)])
        e = elias_fano.EliasFano(elias_fano.build(values, universe))
        assert (e.get(np.arange(len(values))) == values).all()
        asked = np.r_[values, rnd.integers(0, universe, 500)]
        at = e.find(asked, np.zeros(len(asked), np.int64), np.full(len(asked), len(values)))
        want = np.minimum(np.searchsorted(values, asked), len(values) - 1)
        assert (at == np.where(values[want] == asked, want, -1)).all()


def test_elias_fano_in_parts():
    """The same arrays as of the whole sequence, whatever the parts: also with repeated values, empty parts and a wide gap."""
    rnd = np.random.default_rng(4)
    for n, universe in ((1, 10), (70, 100), (5000, 10**12), (3000, 3000)):
        values = np.sort(np.r_[rnd.integers(0, universe, n), universe - 1])
        whole = elias_fano.build(values, universe)
        made = elias_fano.Builder(elias_fano.Builder.width_of(len(values), universe))
        for part in np.split(values, np.sort(rnd.integers(0, len(values), 6))):
            made.add(part)
        got = {k: np.concatenate(a) for k, a in made.arrays(universe).items()}
        assert all((got[k] == a).all() and len(got[k]) == len(a) for k, a in whole.items())
        one, two = elias_fano.EliasFano(whole), elias_fano.EliasFano(got)
        asked = rnd.integers(0, universe, 200)
        at = [e.find(asked, np.zeros(len(asked), np.int64), np.full(len(asked), len(values))).tolist() for e in (one, two)]
        assert at[0] == at[1] and (two.get(np.arange(len(values))) == values).all()


def test_shards_of_ngrams_share_files(spark, monkeypatch):
    """Hundreds of shards of the second level lie in 64 files at most, as each step of the lookups visits all of them; scores are those of a file for each shard."""
    texts = [f"w{k} w{k * 7 % 200} w{k % 13} w{k % 3}" for k in range(200)]
    docs = frame(spark, [(k, t, "a") for k, t in enumerate(texts)])
    score = lambda model: sorted(tuple(r) for r in ngram_lm.score(docs, model, ["doc_id"]).collect())
    model = ngram_lm.train(docs, rows=149 * ngram_lm.SHARD)  # of so many texts the begins are dealt to 149 shards
    level = model.open()[1][0]
    shards = len(arrays.load(model.folder, "cuts2", ("first",))["first"])
    assert shards > 150 and len(level.first) <= 64
    assert level.counts_of(np.arange(int(level.starts[-1]))).sum() == 5 * len(texts)
    monkeypatch.setattr(ngram_lm, "FILES", 1000)
    apart = ngram_lm.train(docs, rows=149 * ngram_lm.SHARD)
    assert len(apart.open()[1][0].first) == shards and score(apart) == score(model)


@pytest.mark.parametrize("order", [2, 3])
def test_ngram_scores(spark, order):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("The the of a b c d e".split()) for _ in range(rnd.randrange(0, 30))) for _ in range(60)]
    train = texts[:40]
    tok = lambda t: words(t.lower()) + ["</s>"]
    c1 = collections.Counter(w for t in train for w in tok(t))
    c2 = collections.Counter(p for t in train for p in zip(["<s>", *tok(t)], tok(t)))
    c3 = collections.Counter(p for t in train for p in zip(["<s>", *tok(t)], tok(t), tok(t)[1:]))
    n, v, mu = sum(c1.values()), len(c1), ngram_lm.MU
    p1 = lambda w: (c1[w] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda a, w: (c2[a, w] + mu * p1(w)) / ((len(train) if a == "<s>" else c1[a]) + mu)
    p3 = lambda a, b, w: (c3[a, b, w] + mu * p2(b, w)) / (c2[a, b] + mu)
    model = ngram_lm.train(frame(spark, [(i, t, "a") for i, t in enumerate(train)]), order)
    got = {r["doc_id"]: r for r in ngram_lm.score(frame(spark, [(i, t, "a") for i, t in enumerate(texts)]), model, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        s = ["<s>", *tok(t)]
        want = sum(math.log10(p2(a, b)) for a, b in zip(s, s[1:])) if order == 2 else math.log10(p2(s[0], s[1])) + sum(math.log10(p3(*x)) for x in zip(s, s[1:], s[2:]))
        assert abs(got[i]["base_score"] - sum(math.log10(p1(w)) for w in s[1:])) < 1e-9
        # of each token a probability, and a backoff where the context is known without it, are off by half a step at most
        assert abs(got[i]["score"] - want) < ngram_lm.STEP * len(s)
        assert got[i]["n_known"] == sum(c1[w] > 0 for w in s[1:]) and got[i]["train_tokens"] == n


def test_trigrams_of_a_frequent_context_have_exact_counts(spark):
    """A context of 10,000 occurrences: the probability is off by half a step of its logarithm, not by the backoff's."""
    texts = ["a b c"] * 10_000 + ["a b d"] * 13
    model = ngram_lm.train(frame(spark, [(i, t, "a") for i, t in enumerate(texts)]))
    vocabulary, levels = model.open()
    shards = lambda level: range(len(level.first))
    counts = sorted(int(c) for k in shards(levels[0]) if levels[0].starts[k] < levels[0].starts[k + 1] for c in arrays.load(model.folder, f"level2-{k}", ("count",))["count"])
    assert counts == [13, 13, 10_000, 10_000, 10_013, 10_013]
    assert levels[0].counts_of(np.arange(6)).sum() == sum(counts)
    n, mu = 4 * 10_013, ngram_lm.MU
    p1 = lambda c: (c + 0.1) / (n + 0.1 * 6)
    p2 = (13 + mu * p1(13)) / (10_013 + mu)
    want = math.log10((13 + mu * p2) / (10_013 + mu))
    score = lambda t: ngram_lm.score(frame(spark, [(1, t, "a")]), model, ["doc_id"]).first()["score"]
    first = math.log10((10_013 + mu * p1(10_013)) / (10_013 + mu)), math.log10((10_013 + mu * (10_013 + mu * p1(10_013)) / (10_013 + mu)) / (10_013 + mu))
    p3 = math.log10((13 + mu * (13 + mu * p1(10_013)) / (13 + mu)) / (13 + mu))
    assert abs(score("a b d") - (sum(first) + want + p3)) <= 4 * ngram_lm.STEP / 2


def test_keys_beyond_64_bits_are_refused(spark, monkeypatch):
    made = ngram_lm._words
    monkeypatch.setattr(ngram_lm, "_words", lambda *a: [r.asDict() | {"entries": 1 << 32} for r in made(*a)])
    with pytest.raises(OverflowError):
        ngram_lm.train(frame(spark, [(1, "a b", "a")]), 2)


def test_ngram_query_uses_trigrams(spark, tmp_path):
    texts = ["a b c d b e " * 10 if k % 3 else "d b e a b c " * 9 for k in range(60)]
    frame(spark, [(i, t, "a") for i, t in enumerate(texts)]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in ngram_lm.op8_ngram_lm(spark, str(tmp_path)).collect()}
    tok = lambda t: words(t) + ["</s>"]
    train = [t for i, t in enumerate(texts) if not got[i]["held_out"]]
    assert 0 < len(train) < len(texts) == len(got)
    c1 = collections.Counter(w for t in train for w in tok(t))
    c2 = collections.Counter(p for t in train for p in zip(["<s>", *tok(t)], tok(t)))
    c3 = collections.Counter(p for t in train for p in zip(["<s>", *tok(t)], tok(t), tok(t)[1:]))
    n, v, mu = sum(c1.values()), len(c1), ngram_lm.MU
    p2 = lambda a, w: (c2[a, w] + mu * (c1[w] + 0.1) / (n + 0.1 * (v + 1))) / ((len(train) if a == "<s>" else c1[a]) + mu)
    p3 = lambda a, b, w: (c3[a, b, w] + mu * p2(b, w)) / (c2[a, b] + mu)
    for i, t in enumerate(texts):
        s = ["<s>", *tok(t)]
        short = sum(math.log10(p2(a, b)) for a, b in zip(s, s[1:]))
        want = math.log10(p2(s[0], s[1])) + sum(math.log10(p3(*x)) for x in zip(s, s[1:], s[2:]))
        assert abs(got[i]["score"] - want) < 0.03 * len(s) < abs(got[i]["score"] - short)


def test_stop_words_only_judge_their_script(spark):
    russian, jumble = " ".join(f"слово{chr(1072 + k % 30)}{chr(1072 + k // 30)}" for k in range(200)), " ".join(f"wq{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200))
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.apply_rules(frame(spark, [(1, russian, "a"), (2, jumble, "a"), (3, "the " + jumble + " of and to in the of and to in", "a")])).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (False, True)}


def test_prose_of_languages_without_a_list_is_kept(spark):
    polish = """W małym mieście nad rzeką mieszkał stary zegarmistrz, który od lat naprawiał zegary i nie pytał, skąd się wzięły. Każdego ranka szedł na rynek,
kupował chleb i wracał do domu, a po drodze mówił dzień dobry do ludzi, których znał od dziecka. Nie miał rodziny, ale nie czuł się sam, bo w jego domu było pełno
głosów: tykały zegary na ścianie, na stole i na oknie. Pewnego dnia przyszła do niego dziewczyna z wielkim pudłem. To był zegar jej dziadka, powiedziała, i nie
chodzi od dnia, w którym dziadek wyjechał na wojnę. Zegarmistrz wziął go do ręki, otworzył i długo patrzył. Nie było w nim nic zepsutego, a on i tak nie chciał iść."""
    turkish = """Küçük bir kasabada yaşlı bir saatçi yaşardı ve her gün dükkanını sabah erkenden açardı. Bu dükkan dar bir sokakta idi, ama herkes onu bilir ve ona
saatini getirirdi. Bir gün genç bir kız geldi ve ona büyük bir kutu verdi. Bu saat dedemin, dedi, ve o gittiği günden beri hiç çalışmadı. Saatçi kutuyu aldı, açtı ve
uzun uzun baktı. Ne bir çark kırıktı ne de bir yay, ama saat yine de durdu. O gece uyumadı ve saatin başında bekledi. Sabah olunca kız geri geldi ve ne oldu diye
sordu. Saatçi ona bir şey demedi, ama saati ona verdi ve gülümsedi. Kız saati eline aldı ve o an saat yeniden çalıştı, çünkü onu bekleyen bir el vardı artık."""
    vietnamese = """Ở một thị trấn nhỏ bên sông có một người thợ sửa đồng hồ đã già. Mỗi sáng ông ra chợ mua bánh mì rồi về nhà, trên đường ông chào những người mà ông
biết từ khi còn nhỏ. Ông không có gia đình, nhưng ông không thấy cô đơn, vì trong nhà ông có rất nhiều tiếng tích tắc trên tường, trên bàn và bên cửa sổ. Một ngày
kia có một cô gái đến với một cái hộp lớn. Đây là đồng hồ của ông tôi, cô nói, và nó đã không chạy từ ngày ông tôi đi xa. Người thợ mở nó ra và nhìn rất lâu. Không có gì
hỏng ở trong đó, nhưng nó vẫn không chạy. Đêm ấy ông không ngủ và ngồi bên nó cho đến khi trời sáng, rồi ông nghe thấy nó chạy."""
    rnd = random.Random(3)
    jumble = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(3, 9))) for _ in range(300))
    got = {r["doc_id"]: (r["base_failed"], r["n_stop_words"], r["kept"]) for r in quality_rules.apply_rules(frame(spark, [(i, t, "a") for i, t in enumerate((polish, turkish, vietnamese, jumble))])).collect()}
    assert all(len(words(t)) >= 100 for t in (polish, turkish, vietnamese))
    assert [got[i][0] for i in range(4)] == [False] * 4 and [got[i][2] for i in range(4)] == [True, True, True, False]


def test_top_k_brute_force(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(0, 1, (230, 24)).astype(np.float32)
    x[7] = x[150]
    got = collections.defaultdict(list)
    for r in topk.top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    for i in range(0, 230, 50):
        s = q @ q[i]
        assert got[i] == [(j, int(s[j])) for j in sorted((j for j in range(230) if j != i), key=lambda j: (-s[j], j))[:5]]


def test_top_k_over_cells(monkeypatch):
    """Blocks of queries against held rows in small cells, with clusters, ties, zero vectors and vectors of no components."""
    rnd = np.random.default_rng(5)
    monkeypatch.setattr(topk, "CELL", 16)
    centre = rnd.normal(0, 300, (8, 20))
    x = np.floor(centre[rnd.integers(0, 8, 700)] + rnd.normal(0, 30, (700, 20))).astype(np.int64)
    x[5:9], x[30:40] = x[4], 0
    ids = rnd.permutation(700)
    ids[600] = ids[3]
    at = np.flatnonzero(ids % 50 == 0)
    for kth in (np.full(len(at), -np.inf), topk.first_scores(ids[at], x[at], 5)):
        a, b, s = topk.search(topk.Queries(ids[at], x[at], kth), topk.Rows(ids, x), 5)
        got = collections.defaultdict(list)
        for i, j, v in zip(a.tolist(), b.tolist(), s.tolist()):
            got[i].append((j, v))
        for q in at:
            score = x @ x[q]
            assert got[ids[q]] == [(ids[j], score[j]) for j in sorted(np.flatnonzero(ids != ids[q]), key=lambda j: (-score[j], ids[j]))[:5]]
    a, b, s = topk.search(topk.Queries(np.array([0]), np.zeros((1, 0), int), np.array([-np.inf])), topk.Rows(np.arange(9), np.zeros((9, 0), int)), 5)
    assert b.tolist() == [1, 2, 3, 4, 5] and s.tolist() == [0] * 5


def test_top_k_of_repeated_queries(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (3, [5.0, 1.0]), (4, [1.0, 5.0]), (4, [1.0, 5.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 4, 5 << 16), (0, 2, 4, 5 << 16), (0, 3, 3, 1 << 16)]


def test_lookup_table():
    table = sharding.lookup_table([f"s{k}" for k in range(10)], 1009)
    counts = np.bincount(table)
    assert counts.min() >= 100 and counts.max() <= 101
    fewer = sharding.lookup_table([f"s{k}" for k in range(9)], 1009)
    assert ((table != fewer) & (table != 9)).mean() < 0.25
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 1000)


def test_placement_by_plain_python(spark, tmp_path):
    """The table filled by preference lists, and every row placed by the published hash."""
    names, slots = [f"shard-{k:03d}" for k in range(7)], 101
    prefer = {}
    for n in names:
        h = hashlib.sha256(n.encode()).digest()
        offset, skip = int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1
        prefer[n] = iter([(offset + j * skip) % slots for j in range(slots)])
    owner = {}
    while len(owner) < slots:
        for n in names:
            slot = next((s for s in prefer[n] if s not in owner), None)
            if slot is not None:
                owner[slot] = n
    docs = frame(spark, [(i * 7919 - 5000, f"t{i}", "a") for i in range(500)] + [(None, f"null {i}", "a") for i in range(200)] + [(None, "equal", "a")] * 3)
    rows = sharding.place(docs, names, slots=slots).collect()
    assert len(rows) == 703
    for r in rows:
        if r["doc_id"] is not None:
            slot = xxhash.xxh64(r["doc_id"].to_bytes(8, "little", signed=True), seed=42).intdigest()
            slot = (slot - (1 << 64) if slot >> 63 else slot) % slots
            assert (r["slot"], r["shard"]) == (slot, owner[slot])
    nulls = [r for r in rows if r["doc_id"] is None]
    assert len({r["shard"] for r in nulls}) == 7 and len({r["shard"] for r in nulls if r["text"] == "equal"}) == 1
    sharding.write_shards(docs, f"{tmp_path}/out", names, slots=slots, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["text"], r["shard"]) for r in back.collect()) == sorted((r["text"], r["shard"]) for r in rows) and "part" not in back.columns


def test_mix_takes_the_budget(spark):
    rnd = random.Random(3)
    docs = frame(spark, [(i, " ".join(["w"] * rnd.randrange(0, 40)), rnd.choice(["a", "b", "c", None])) for i in range(300)])
    plan = {r["source"]: r for r in mixing.take(mixing.sized(docs)).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("source_size").alias("size")).collect()}
    assert all(r["taken"] == math.floor(r["target"] + 1e-9) and r["target"] <= 2 * r["size"] for r in plan.values())
    mixed = mixing.mix(docs).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in mixed} == {k: r["taken"] for k, r in plan.items()}


def test_quality_of_a_text_alone_and_in_batches(spark):
    rnd = np.random.default_rng(4)
    params = quality_cnn.initial(rnd)
    params["cb"] -= 0.5  # few windows fire, so that one foreign one shows
    texts = [rnd.integers(97, 123, n).astype(np.uint8) for n in (0, 1, 115, 116, 117, 127, 128, 240, 244, 245, 250, 255, 256, 384, 500, 512, 640) for _ in range(6)]
    alone = np.array([quality_cnn.probabilities([t], params)[0] for t in texts])
    for order in (np.arange(len(texts)), np.arange(len(texts))[::-1], rnd.permutation(len(texts))):
        assert np.allclose(quality_cnn.probabilities([texts[i] for i in order], params), alone[order], rtol=0, atol=1e-5)
    docs = frame(spark, [(i, t.tobytes().decode(), "a") for i, t in enumerate(texts)])
    for parts in (1, 7):
        got = {r["doc_id"]: r["score"] for r in quality_cnn.score(docs.repartition(parts), params).collect()}
        assert np.allclose([got[i] for i in range(len(texts))], alone, rtol=0, atol=1e-5)


def test_classifiers_on_held_out_rows():
    rnd = random.Random(9)
    clean = lambda: " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 8))) for _ in range(60))
    junk = lambda: " ".join("".join(rnd.choice("ETAOIN") for _ in range(4)) + "!!" for _ in range(60))
    texts = [f().encode() for _ in range(80) for f in (clean, junk)]
    params = quality_cnn.train(texts, [1, 0] * 80, epochs=4)
    fresh = [np.frombuffer(f().encode(), np.uint8) for _ in range(20) for f in (clean, junk)]
    assert ((quality_cnn.probabilities(fresh, params) >= 0.3) == ([1, 0] * 20)).mean() > 0.9
    de = lambda: " ".join(rnd.choice("der die und ist nicht schön haus weg".split()) for _ in range(20))
    en = lambda: " ".join(rnd.choice("the of and house way with not nice".split()) for _ in range(20))
    model = langid.train([f().encode() for _ in range(40) for f in (de, en)], ["de", "en"] * 40, epochs=3)
    for f, want in ((de, 0), (en, 1)):
        z = langid.mean_logits(np.frombuffer(f().encode(), np.uint8), model.logits) + model.bias
        assert int(z.argmax()) == want


def test_language_scores_by_a_dictionary(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    logits = rnd.normal(0, 1, (langid.BUCKETS, 3)).astype(np.float32)
    model = langid.Model(["de", "en", "fr"], logits, rnd.normal(0, 1, 3), 0.7, 0.5)
    long = "".join(rnd.choice(list("abc dé"), 90_000).tolist())
    texts = ["A", "Über alles", long, "12 34", "", None, "the end"]

    def want(t):
        b = b" " + bytes(x + 32 if 65 <= x <= 90 else x for x in t.encode()) + b" "
        got = collections.Counter(b[i : i + n] for n in langid.ORDERS for i in range(len(b) - n + 1))
        multiplier = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}
        z = sum(n * logits[(int.from_bytes(g, "little") * multiplier[len(g)] % (1 << 32)) >> 16].astype(float) for g, n in got.items()) / sum(got.values()) + model.bias
        e = [math.exp(x / 0.7) for x in z]
        return model.languages[int(np.argmax(z))], max(e) / sum(e)

    for block in (langid.BLOCK, 1000):
        monkeypatch.setattr(langid, "BLOCK", block)
        for i, t in enumerate(texts):
            if t and t != "12 34":
                z = langid.mean_logits(np.frombuffer(t.encode(), np.uint8), logits) + model.bias
                assert abs(langid._softmax(z / 0.7).max() - want(t)[1]) < 1e-5
    got = {r["doc_id"]: r for r in langid.identify(frame(spark, [(i, t, "a") for i, t in enumerate(texts)]), model).collect()}
    for i, t in enumerate(texts):
        name, score = want(t) if t and t != "12 34" else ("und", 0.0)
        assert got[i]["lang_pred"] == name and abs(got[i]["score"] - score) < 1e-5 and got[i]["accepted"] == (score >= 0.5)


def test_models_that_normalise_are_refused(monkeypatch):
    kept = sentencepiece.SentencePieceProcessor.normalize
    assert sp.Bpe(sp.default_model()).n == 32_000
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "normalize", lambda self, t: kept(self, t.replace("\ufb01", "fi")))
    with pytest.raises(ValueError, match="normalises"):
        sp.Bpe(sp.default_model())


def test_draw_is_bounded_and_repeats(spark):
    rows = [(i, f"t{i}", "en" if i % 3 else "de") for i in range(600)] + [(7, "t7", "en")] * 500 + [(None, "x", "en"), (1, None, "en"), (2, "y", None), (9, "only", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = draw(docs, "lang", 20)
    assert collections.Counter(r["lang"] for r in got) == {"en": 20, "de": 20, "fr": 1} and len(set(got)) == 41
    assert draw(docs.repartition(7), "lang", 20) == got and draw(docs.limit(0), "lang", 20) == []
    assert len(draw(docs, "lang", 10_000)) == 601


def test_network_by_loops():
    """Every layer of the network once more, one text and one number at a time; and its gradients by differences."""
    rnd = np.random.default_rng(11)
    p = quality_cnn.initial(rnd)
    texts = [rnd.integers(0, 256, n).astype(np.uint8) for n in (0, 5, 300, 517)]
    got = quality_cnn.probabilities(texts, p)
    for t, probability in zip(texts, got):
        halves = max(2, -(-len(t) // 128))
        code = np.zeros(halves * 128 + 16, int)
        code[: len(t)] = t.astype(int) + 1
        act = np.array([np.maximum(p["emb"][code[i * 4 : i * 4 + 16]].reshape(-1) @ p["conv"] + p["cb"], 0) for i in range(halves * 32)])
        hidden = []
        for k in range(halves - 1):
            chunk = act[k * 32 : k * 32 + 64]
            hidden.append(np.maximum(np.concatenate([chunk.max(axis=0), chunk.mean(axis=0)]) @ p["dense"] + p["db"], 0))
        z = np.max(hidden, axis=0) @ p["out"] + p["ob"][0]
        assert abs(probability - 1 / (1 + math.exp(-z))) < 1e-5
    p = {k: v.astype(np.float64) for k, v in p.items()}
    y, w = np.array([1, 0, 1, 0], np.float32), np.array([1.0, 2.0, 0.5, 1.0], np.float32)
    flat, first = quality_cnn.layout(texts)
    g = quality_cnn._gradients(flat, first, y, w, p)

    def loss():
        q = quality_cnn._forward(flat, first, p)["p"]
        return -(w * (y * np.log(q) + (1 - y) * np.log(1 - q))).mean()

    for key in p:
        at = np.unravel_index(np.argmax(np.abs(g[key])), g[key].shape)
        was = p[key][at]
        p[key][at] = was + 1e-3
        up = loss()
        p[key][at] = was - 1e-3
        down = loss()
        p[key][at] = was
        assert abs((up - down) / 2e-3 - g[key][at]) < 0.05 * abs(g[key][at]) + 1e-3, key


@pytest.mark.parametrize("name", ["op3_quality_rules", "op5_mixing", "op7_topk", "ngram_base"])
def test_queries_equal_their_sql(spark, name):
    data = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = registry.queries()[name](spark, data)
    columns = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want)
