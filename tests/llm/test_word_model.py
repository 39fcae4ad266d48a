"""The word model of op8 held against a plain interpolated modified Kneser-Ney model."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from ledgerspark.llm import quality

TOKEN = re.compile(r"[A-Za-z0-9à-ÿЀ-ӿ]+|[^\sA-Za-z0-9à-ÿЀ-ӿ]")


def split(text):
    return [re.sub(r"\d", "0", t) for t in TOKEN.findall(text)]


def plain(texts):
    """Nats per token of a text under a model of ``texts``."""
    counts = [None, Counter(), Counter(), Counter()]
    for t in texts:
        s = ["<s>", "<s>", *split(t)]
        counts[3].update(tuple(s[i - 2 : i + 1]) for i in range(2, len(s)))
    for n in (2, 1):
        counts[n].update(g[1:] for g in counts[n + 1])
    cut, tot, left = {}, defaultdict(int), defaultdict(float)
    for n in (1, 2, 3):
        n1, n2, n3, n4 = (sum(c == i for c in counts[n].values()) for i in (1, 2, 3, 4))
        cut[n] = quality._discounts(n1, n2, n3, n4)
        for g, c in counts[n].items():
            tot[g[:-1], n] += c
            left[g[:-1], n] += cut[n][min(c, 3) - 1]

    def p(g):
        n = len(g)
        if not n:
            return 1 / (len(counts[1]) + 1)
        c = counts[n].get(g, 0)
        if not tot[g[:-1], n]:
            return p(g[1:])
        return ((c - cut[n][min(c, 3) - 1] if c else 0) + left[g[:-1], n] * p(g[1:])) / tot[g[:-1], n]

    def score(text):
        s = ["<s>", "<s>", *split(text or "")]
        return -sum(math.log(p(tuple(s[i - 2 : i + 1]))) for i in range(2, len(s))) / (len(s) - 2) if len(s) > 2 else None

    return score


def test_perplexity_by_joins_of_counts(spark, monkeypatch):
    rnd = random.Random(8)
    text = lambda n: " ".join(rnd.choice("the cat Dog sat. 12 été, 中文字 x1 (y)".split()) for _ in range(n))
    good = [text(rnd.randrange(1, 40)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([*good, "the the unseen words 7 文 字\n\tcat", "", None, " \n", good[0], "Привет мир été"])] + [(90, "twice"), (90, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(good)
    counts, model = quality.fit_words(docs.where("doc_id < 60"), 5)
    for limit in (1 << 40, 0):
        monkeypatch.setattr(quality, "ONE_ROUND", limit)
        got = quality.code_lengths(docs, counts, model, 5, 1, keep=["doc_id"]).collect()
        assert len(got) == len(rows)
        by = defaultdict(list)
        for r in got:
            by[r["doc_id"]].append(r["_lm_nll"])
        for i, t in rows:
            w = want(t)
            assert all(x is None if w is None else abs(x - w) < 1e-4 for x in by[i]), (t, by[i], w)


def test_signs_are_told_apart(spark):
    """Scrambled Chinese text costs more than clean text, also of the same signs."""
    clean, rnd = "今天天气很好我们去公园散步", random.Random(3)
    docs = spark.createDataFrame([(i, clean * 5 + str(i)) for i in range(20)], "doc_id long, text string")
    counts, model = quality.fit_words(docs, 3)
    mixed = "".join(rnd.sample(clean, len(clean)))
    a, b, c = (quality.code_lengths(spark.createDataFrame([(t,)], "text string"), counts, model, 3, 1).first()["_lm_nll"] for t in (clean, mixed, "龘靐齉爩"))
    assert a < b < c


def test_tokens_of_neighbouring_texts():
    texts = ["ab", "cd 5e", "", "é.é"]
    data = [t.encode() for t in texts]
    h, at = quality.tokens(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert at.tolist() == [0, 1, 3, 3, 6] and h[3] == h[5] and len(set(h.tolist())) == 5


def test_distinct_values_without_argsort(monkeypatch):
    rnd = np.random.default_rng(5)
    cases = [rnd.integers(0, 900, 5000).astype(np.uint32), rnd.integers(0, 1 << 50, 5000).astype(np.uint64) // np.uint64(1 << 42), np.array([7], np.uint64), np.zeros(0, np.uint32)]
    wide = rnd.integers(0, 40, 5000).astype(np.uint64) << np.uint64(58)
    for x in [*cases, wide]:
        ids, place = quality._ids(x)
        assert ids.dtype == x.dtype and (ids == np.unique(x)).all() and (ids[place] == x).all()

    def refused(*a, **k):
        raise AssertionError("argsort of values that fit with their position")

    monkeypatch.setattr(quality.np, "argsort", refused)
    for x in cases[:-1]:
        quality._ids(x)
    words = rnd.integers(0, 1 << 32, 400, dtype=np.uint32)[rnd.integers(0, 400, 5000)]
    for order, (ctx, w, place) in quality.grams(words, np.array([0, 1200, 1200, 5000])).items():
        assert (w[place] == words).all()
        key = list(zip(ctx.tolist(), w.tolist(), strict=True))
        assert key == sorted(set(key)) and (order > 1 or not ctx.any())


def test_runs_are_short():
    c = np.array([1, 2, 255], np.int64)
    assert quality._unpack(quality._pack(c), np.int64).tolist() == c.tolist() and quality._pack(c)[8] == 1
    c[1] = 1 << 40
    assert quality._unpack(quality._pack(c), np.int64).tolist() == c.tolist()
    ctx, w = np.array([3, 3, 3, 9], np.uint64), np.array([1, 4, 5, 1], np.uint32)
    sizes = {3: ((0.5, 0.75, 0.9), 4, 6, 2.0)}
    counts = pa.Table.from_batches([quality._rows([(2, quality._pack(ctx), quality._pack(w), quality._pack(np.array([1, 2, 1, 2])))], quality._COUNTS)])
    asks = pa.Table.from_batches([quality._rows([(2, 0, quality._pack(np.array([3, 3, 3, 8], np.uint64)), quality._pack(np.array([1, 2, 4, 1], np.uint32)))], quality._ASKS)])
    r = quality._answer(sizes)((pa.scalar(2),), asks, counts).to_pylist()[0]
    assert np.allclose(quality._unpack(r["u"], np.float32), [0.5 / 4, 0, 1.25 / 4, 0])
    assert np.allclose(quality._unpack(r["lam"], np.float32), [1.75 / 4, 1])  # one for each context
