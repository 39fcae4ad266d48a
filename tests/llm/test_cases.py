"""Cases that the contracts name: clashing column names, part mixtures, names at the start of a sentence, empty tables."""

import collections
from fractions import Fraction

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerspark.llm import decontaminate, line_dedup, mixing, quality, simhash, toxicity

ITEM = "Tom has 3 apples. Anna gives him 5. Ben eats 2. How many apples does Tom have now?"
CLASH = "doc_id long, text string, lang string, source string, _mix_s string, _mix_slot int, _lm_node int, _lm_items int, _lm_nll int, _lm_removed int, d int, h int, s int, node int, _in0 int"


@pytest.fixture(scope="module")
def clash(spark):
    rows = [(i, f"some words of text number {i} and a few more words here\nline {i}" if i else None, None if i == 3 else "en", f"s{i % 2}", "x", 7, 7, 7, 7, 7, 1, 2, 3, 4, 5) for i in range(9)]
    return spark.createDataFrame(rows + rows[4:6], CLASH)


def test_clashing_names(spark, clash):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    for out, new in (
        (mixing.mix(clash), {"_mix_slot", "_mix_place", "_mix_on_target"}),
        (decontaminate.decontaminate(clash, bench), {"_lm_items"}),
        (line_dedup.line_dedup(clash), {"_lm_removed"}),
        (quality.classify(clash, quality.trusted_of(clash, labels)), {"_lm_perplexity", "_lm_threshold", "_lm_keep"}),
        (simhash.near_dedup(clash), set()),
    ):
        assert sorted(out.columns) == sorted(set(clash.columns) | new)
        rows = out.collect()
        assert all(r[c] == v for r in rows for c, v in (("_mix_s", "x"), ("_lm_node", 7), ("_lm_nll", 7), ("d", 1), ("h", 2), ("s", 3), ("node", 4), ("_in0", 5)))
        assert len(rows) == (11 if new else len({r["doc_id"] for r in rows}))


def test_empty_tables(spark, clash):
    none, bench = clash.limit(0), spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (mixing.mix(none), mixing.mix(none, weights={"s0": 1}), decontaminate.decontaminate(none, bench), line_dedup.line_dedup(none), quality.classify(none, quality.trusted_of(none, labels)), simhash.near_dedup(none)):
        assert out.collect() == []


def test_exact_weights(spark):
    """1 to 3000: less than one block off after each of 10,000 slots."""
    sizes = spark.createDataFrame([("a", 100), ("b", 9000)], "s string, n long")
    plan = {r["t"]: r["s"] for r in mixing.frame_of(sizes, weights={"a": 1, "b": 3000, "absent": 5}).collect()}
    assert len(plan) == 3001
    done: collections.Counter = collections.Counter()
    for t in range(10_000):
        done[plan[t % 3001]] += 1
        for s, w in (("a", Fraction(1, 3001)), ("b", Fraction(3000, 3001))):
            assert abs(done[s] - (t + 1) * w) < 1
    assert mixing.stated_shares({"a": 0.25, "b": 0.75}, ["a", "b"]) == ({"a": 1, "b": 3}, 4)
    shares, d = mixing.stated_shares({"a": 0.123456789, "b": 1, "c": 0}, ["a", "b", "c"])
    assert d == mixing.EXACT_FRAME == sum(shares.values()) and shares["a"] in (1799, 1800, 1801) and "c" not in shares


def test_part_mixture(spark):
    docs = spark.createDataFrame([(i, "s%d" % (i % 3)) for i in range(30)], "doc_id long, source string")
    rows = mixing.mix(docs, weights={"s0": 1, "s1": 2}, block_rows=1).collect()
    assert len(rows) == 30 and all((r["_mix_slot"] is None) == (r["source"] == "s2") for r in rows)
    assert sorted(r["_mix_slot"] for r in rows if r["source"] == "s1") == sorted({r["_mix_slot"] for r in rows if r["source"] == "s1"})
    assert {r["source"] for r in rows if r["_mix_on_target"]} == {"s0", "s1"}
    with pytest.raises(ValueError, match="negative"):
        mixing.mix(docs, weights={"s0": -1})


def test_names_at_the_start_of_a_sentence(spark):
    other = ITEM.replace("Tom", "Maria").replace("Anna", "Joe Hill").replace("Ben", "Ute").replace("3", "14").replace("5", "26")
    docs = spark.createDataFrame(
        [(1, ITEM), (2, other), (3, "(" + other + ")"), (4, "He said: " + other + " And more."), (5, other.replace("does Maria", "does Ute")), (6, "Tom has a dog. Anna likes cats. How many are there?"), (7, ITEM.upper())],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(1, ITEM), (2, "A 5 W lamp and a 7 W lamp run for 3 hours each night")], "item_id long, text string")
    got = {r["doc_id"]: r["_lm_items"] for r in decontaminate.decontaminate(docs, bench).collect()}
    # 5 asks for another person than the first one
    assert got == {1: [1], 2: [1], 3: [1], 4: [1], 5: None, 6: None, 7: None}
    lamps = docs.limit(1).select("doc_id", F.lit("A 6 W lamp and a 9 W lamp run for 4 hours each night").alias("text"))
    assert decontaminate.decontaminate(lamps, bench).first()["_lm_items"] == [2]


def test_long_runs_of_names(spark):
    """Runs of very many capitalised words, letters or numbers need no stack, and the item after them is found."""
    runs = ["Abc " * 200_000, "A" * 800_000 + " ", "A " * 300_000, "1.2" * 200_000 + " ", "Aa-'" * 200_000 + " "]
    docs = spark.createDataFrame([(i, r + "\n" + ITEM) for i, r in enumerate(runs)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert {r["doc_id"]: r["_lm_items"] for r in decontaminate.decontaminate(docs, bench).collect()} == {i: [1] for i in range(5)}


def test_toxicity_travels_by_value():
    """The functions that run on executors take no module of the package with them, which can hold what cannot be sent."""
    for f in (toxicity._frequencies(64), toxicity._features(np.arange(3), 64), toxicity._score(None, 64, 0.5)):
        assert callable(cloudpickle.loads(cloudpickle.dumps(f)))


def test_narrow_postings_hold_the_parities_of_lines(spark):
    lines = ["w1 w2 w3 w4 w5 w6", " ".join(f"v{i}" for i in range(150))]
    docs = spark.createDataFrame([(i, 0, x) for i, x in enumerate(lines)], "_lm_id long, _lm_h long, _lm_text string")
    equal = spark.createDataFrame([], "d long, h long, i int")
    posts = line_dedup._postings(docs, equal, 0.8)
    assert posts.columns == ["w", "d", "h", "i", "np", "a", "b"]
    hashes = docs.select("_lm_id", F.transform(F.split("_lm_text", " "), lambda w: F.xxhash64(w)).alias("h"))
    words = {d: [(h % (1 << 64)) >> 8 for h in hs] for d, hs in hashes.collect()}
    signed = lambda x: x - (x >> 63 << 64)
    for d, c in words.items():
        rows = posts.where(F.col("d") == d).collect()
        assert sorted(r["np"] for r in rows) == [(len(c) << 32) + p for p in range(len(c) - -(-len(c) * 4 // 5) + 1)]
        parity = [0, 0, 0, 0]
        for x in c:
            parity[x >> 6 & 3] ^= 1 << (x & 63)
        b = tuple(signed(x) for x in parity[1:]) if len(c) > 64 else None
        assert {(r["a"], r["b"] and tuple(r["b"])) for r in rows} == {(signed(parity[0] ^ parity[1] ^ parity[2] ^ parity[3]), b)}
