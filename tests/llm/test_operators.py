"""Each operator against a plain version on small fixtures with nulls, empties, ties and repeats."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from ledgerspark.llm import decontaminate, html_extract, language_id, line_dedup, mixing, quality, simhash, substring_dedup, topk_search, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd, n, size=400):
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    passage = words(rnd, 60)
    rows = [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "one"), (5, "Two words")]
    for i in range(6, 40):
        rows.append((i, "\n".join(words(rnd, rnd.randrange(3, 40)) for _ in range(rnd.randrange(1, 5)))))
    rows += [(40, passage), (41, words(rnd, 20) + " " + passage + " " + words(rnd, 5)), (42, words(rnd, 9) + " " + passage[:200])]
    base = words(rnd, 300)
    rows += [(43, base), (44, base), (45, base.replace(" w1 ", " x1 ")), (46, base + " tail"), (46, base + " tail"), (47, passage + " " + passage)]
    rows.append((48, " ".join(["again"] * 200)))
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in corpus], DOCS)


def test_substring_dedup(docs, corpus):
    texts = [(i, WORD.findall(t or "")) for i, t in corpus]
    seen = collections.Counter(tuple(w[k : k + 35]) for _, w in texts for k in range(len(w) - 34))
    want = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substring_dedup.substring_dedup(docs).collect()]
    assert sorted(got) == sorted(want)


def plain_print(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x)
    return [low[find(i)] for i in range(len(ids))]


def test_simhash(docs, corpus):
    fp = [plain_print(t) for _, t in corpus]
    want = components([i for i, _ in corpus], lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = simhash.simhash_components(docs).collect()
    assert sorted((r["doc_id"], r["_lm_fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == sorted((i, f, c) for (i, _), f, c in zip(corpus, fp, want, strict=True))


def test_tiles_in_shares(spark):
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, 60)
    fps = np.unique(np.concatenate([base, base ^ 1, base ^ 6, base ^ (1 << 40)]))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    whole, cut = (sorted(map(tuple, simhash.components(simhash.links(df, 3, n)).collect())) for n in (8192, 3))
    assert whole == cut and len(whole) >= 150


def test_near_dedup(docs, corpus):
    kept = sorted(r["doc_id"] for r in simhash.near_dedup(docs).collect())
    assert {43, 3, 0} <= set(kept) and not {44, 45, 46, 4, 1} & set(kept) and len(kept) == len(set(kept))


def kept_by_all_pairs(rows):
    """Smallest id of each group under all pairs of 5-word shingle sets with a Jaccard similarity of 0.8, counted shingle by shingle."""
    sets, held, root = {}, collections.defaultdict(list), {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[x : x + 5]) for x in range(max(1, len(w) - 4))}
        root[i] = i

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        common = collections.Counter(j for s in sets[i] for j in held[s])
        for j, n in common.items():
            if 10 * n >= 8 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
        for s in sets[i]:
            held[s].append(i)
    return [i for i in sorted(sets) if root[i] == i]


def test_near_dedup_groups(spark):
    """Copies of a group lie on both sides of the threshold: a pair that fails must not hide another one."""
    rnd = random.Random(11)
    rows = []
    for _ in range(300):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice((20, 40, 80)))]
        for _ in range(12):
            t = list(base)
            # both ends change little, the places next to them change a pair from just above to just below the threshold
            for at in rnd.sample((0, 1, 2, 3, -1, -2, -3, -4), 2 + len(base) // 40):
                t[at] = f"x{rnd.randrange(3)}"
            rows.append((len(rows), " ".join(t)))
    rnd.shuffle(rows)
    got = sorted(r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == kept_by_all_pairs(rows)


def test_near_dedup_short(spark):
    """Eight words and the same with a ninth have 4 of 5 shingles in common, 12 of 15 for sixteen and nineteen; their fingerprints are often far apart."""
    rnd = random.Random(12)
    rows = []
    for i in range(400):
        t = words(rnd, 8 if i % 2 else 16, 100_000)
        rows += [(2 * i, t), (2 * i + 1, t + " " + words(rnd, 1 if i % 2 else 3, 100_000))]
    got = sorted(r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == list(range(0, 800, 2))


def test_line_dedup(docs, corpus):
    lines = [(i, n, frozenset(WORD.findall(x))) for i, t in sorted({(i, t) for i, t in corpus if t is not None}) for n, x in enumerate(t.split("\n"))]
    gone = collections.defaultdict(set)
    for k, (i, n, s) in enumerate(lines):
        if s and any(o and 10 * len(s & o) >= 8 * len(s | o) for _, _, o in lines[:k]):
            gone[i].add(n)
    got = {r["doc_id"]: list(r["_lm_removed"]) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {i: sorted(gone[i]) for i, _ in corpus}


def test_line_dedup_of_a_large_group(spark, monkeypatch):
    """Lines of one group of which one in eight is a near copy of another: few pairs are left for the join of all."""
    rnd, made = random.Random(7), {}
    base = [f"w{k}" for k in range(40)]
    lines = [rnd.sample(base, 35) for _ in range(2000)]

    def counted(df, label, write=line_dedup.written):
        out = write(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "written", counted)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"] for r in line_dedup.line_dedup(docs).collect() if r["_lm_removed"]}
    sets = [frozenset(x) for x in lines]
    assert got == {i for i, s in enumerate(sets) if any(10 * len(s & o) >= 8 * len(s | o) for o in sets[:i])}
    assert made["all_pairs"] < 100 * len(lines)


def test_topk(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(24)]) for i in range(230)] + [(300, None), (301, [float("nan")] * 24), (350, [0.5, None] + [0.1] * 22), (120, [0.1] * 24), (400, [0.25] * 8), (450, [0.5] * 8)]
    q = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk_search.topk(q, q.where("id % 50 = 0"), row_block=40, query_block=2).collect()
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v and None not in v and v[0] == v[0]]
    want = []
    for i, v in ok:
        if i % 50 == 0:
            s = sorted(((-sum(a * b for a, b in zip(v, u, strict=True)), j) for j, u in ok if j != i and len(u) == len(v)))[:5]
            want += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_mixing_stays_within_a_block(docs):
    out = mixing.mix(docs, block_rows=1, frame=32)
    plan = mixing.frame_of(docs.groupBy(mixing.F.col("source").alias("s")).agg(mixing.F.count("*").alias("n")), frame=32).collect()
    share = {r["s"]: r["a"] / 32 for r in plan}
    done = collections.Counter()
    for t, r in enumerate(sorted(plan, key=lambda r: r["t"])):
        assert r["t"] == t
        done[r["s"]] += 1
        assert all(abs(done[s] - (t + 1) * w) < 1 for s, w in share.items())
    rows = out.collect()
    assert len(rows) == docs.count() and len({(r["_mix_slot"], r["_mix_place"]) for r in rows}) == len(rows)


def test_decontaminate(spark):
    item = "Tom Hill sold 12 kg of apples to Anna Berg and then 12 kg more, how many kg did he sell in 3 days on the market?"
    docs = spark.createDataFrame([(1, "Intro text. " + item + " More text."), (2, "Intro text here. " + item.replace("12", "45").replace("Anna Berg", "Carl Voss")), (3, item.replace("12 kg of", "45 kg of")), (4, "Nothing of that kind is in here at all, not even 12 kg."), (5, None), (6, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")
    got = {r["doc_id"]: r["_lm_items"] for r in decontaminate.decontaminate(docs, bench).collect()}
    # 3 gives one value of the item two values: its slots disagree
    assert got == {1: [7], 2: [7], 3: None, 4: None, 5: None, 6: None}
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("_lm_items is not null").count() == 0


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><a>Menu</a></nav><div class='cookie-notice'>Cookies</div><article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b><br>word.<p>Two&nbsp;x<aside>Side</aside><div class=comments>Nice!</div><p>Subscribe now</p></article><footer>Foot</footer>"
    pages = [(i, f"http://a.example/{i}", page.replace("One", f"One{i}")) for i in range(10)] + [(20, None, None), (21, "x", ""), (22, "http://b.example/", "<p>Plain <script>var a='</p>'</script>text")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    # the last paragraphs and the headline are the same on every page of the host
    assert got[3] == "One3 bold word." and got[20] == "" and got[21] == "" and got[22] == "Plain text"


def test_language(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog are here", "en"), ("der Hund und die Katze sind hier", "de")] * 20)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "the dogs"), (2, "die Hunde und"), (3, "123 !"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(asked, model, ["doc_id"]).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["en", "de", "und", "und", "und"] and 0.5 < got[1][1] <= 1 and got[3][1] == 0


def test_toxicity(spark):
    rnd = random.Random(1)
    rows = [(words(rnd, 30, 90) + ". " + ("you vile cur" if i % 4 == 0 else "so it goes") + ". " + words(rnd, 20, 90), int(i % 4 == 0)) for i in range(200)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, y int"))
    asked = spark.createDataFrame([(1, "Hello there. What a vile cur. Bye."), (2, "Hello there. Bye."), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(asked, model, ["doc_id"]).collect()}
    assert got[1]["score"] > 0.5 > got[2]["score"] and got[3]["score"] == got[4]["score"] == 0
    assert [x["sentence"] for x in got[1]["offending"]] == ["What a vile cur"]


def test_kneser_ney_sums_to_one(spark):
    trusted = spark.createDataFrame([("the cat sat on the mat. the dog ran.",), ("a dog and a cat.",)], "text string")
    p = np.exp(quality.fit(trusted).astype(np.float64)).reshape(-1, quality.SYMBOLS).sum(1)
    assert np.allclose(p, 1, atol=1e-4)


def test_quality(spark):
    rnd = random.Random(4)
    good = [(i, words(rnd, 40), "en") for i in range(60)]
    docs = spark.createDataFrame([*good, (90, "#### %%% $$$ @@@ QQQQ ZZZZ &&& *** " * 9, "en"), (91, None, "en"), (92, "", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(90, 0), (91, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["_lm_keep"] for r in quality.classify(docs, quality.trusted_of(docs, labels)).collect()}
    assert not got[90] and not got[91] and not got[92] and sum(got[i] for i in range(60)) >= 58
