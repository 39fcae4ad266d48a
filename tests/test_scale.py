"""Forms of the matching tiers that make no pairs, held against the pairs."""

import random
from datetime import date, timedelta
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F

from ledgerspark.functions.similarity import common_bound
from ledgerspark.operators import forecast as C
from ledgerspark.operators import recon as R
from ledgerspark.plans.storage import checkpointed, dropped

LINES = "seq long, line_id string, txn_date date, narration string, amount long, utr string"
DOCS = "seq long, doc_id string, kind string, number string, counterparty string, party_code string, amount long, paid long, doc_date date, due_date date"
WORDS = "AMBER BIRCH CEDAR DELTA EMBER FALCON GARNET HARBOR".split()


def book(spark, n, most, same=0):
    rnd, day = random.Random(n), date(2026, 1, 1)
    name = lambda: " ".join(rnd.sample(WORDS, rnd.randint(1, most)))
    docs = []
    for i in range(n):
        due = day + timedelta(rnd.randrange(300))
        docs.append((i, f"D{rnd.randrange(10**6)}-{i}", rnd.choice(["AR", "AR", "AP"]), f"INV-2026-{i:06d}", "AMBER" if i < same else name(), "P", rnd.randrange(1, 40) * 1000, 0, due - timedelta(rnd.choice([0, 40, 200])), due if i % 50 else None))
    lines = [(i, f"L{i}", day + timedelta(rnd.randrange(300)), "CHQ CLG " + name(), rnd.choice([1, 1, -1]) * rnd.randrange(1, 60) * 1000, None) for i in range(n // 2)]
    return spark.createDataFrame(lines, LINES), spark.createDataFrame(docs, DOCS)


def test_token_counts_are_those_of_the_pairs(spark):
    for n, most, same in ((200, 7, 0), (1500, 3, 1200)):
        lines, docs = book(spark, n, most, same)
        pairs = R.t6_candidates(lines, docs).groupBy("l_line_id").agg(F.count("*"), F.min("d_doc_id"))
        got = R.t6_counts(lines, docs, store=checkpointed)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect()))
    twice = lines.union(lines.limit(20))
    pairs = R.t6_candidates(twice, docs).groupBy("l_line_id").agg(F.count("*"), F.min("d_doc_id"))
    assert sorted(map(tuple, R.t6_counts(twice, docs, store=checkpointed).collect())) == sorted(map(tuple, pairs.collect()))


def test_lines_with_two_candidates_leave_before_pairs(spark):
    lines, docs = book(spark, 600, 3)
    slack = (F.col("l_size") * F.lit(0.18)).cast("long")
    pairs = R.range_pairs(lines, docs, slack, 1_000_000, "fuzzy").where(F.arrays_overlap(R.S.name_tokens("l_hint"), "d_tokens"))
    n = {r["l_line_id"]: r["count"] for r in pairs.groupBy("l_line_id").count().collect()}
    left, right = R._pairs(R.line_index(lines), R.doc_index(docs))
    gone = {r[0] for r in R.crowded(left.withColumn("slack", slack), right, "fuzzy").collect()}
    assert gone and all(n[x] > 1 for x in gone)
    got = {r["line_id"]: r["doc_id"] for r in R.t8_single_candidates(lines, docs, store=checkpointed).collect()}
    assert got == {r["l_line_id"]: r["d_doc_id"] for r in pairs.collect() if n[r["l_line_id"]] == 1}


def test_assignment_of_like_names(spark, monkeypatch):
    lines, docs = book(spark, 400, 3)
    run = lambda: sorted((r["l_seq"], r["d_seq"]) for r in R.greedy_assignment(R.t7_candidates(lines, docs, store=checkpointed), store=checkpointed).collect())
    want = run()
    monkeypatch.setattr(R, "NAME_PAIRS", 0)  # names of pairs only
    monkeypatch.setattr(R, "IN_ORDER", 3)  # rounds to the last pairs
    assert want and run() == want


def test_bound_of_the_character_ratio():
    rnd = random.Random(1)
    names = ["".join(rnd.choice("ABCé ") for _ in range(rnd.randrange(12))) for _ in range(60)] + ["A" * 70]
    a, b = (pd.Series(x) for x in zip(*[(x, y) for x in names for y in names], strict=True))
    assert all(bound >= SequenceMatcher(None, x, y, autojunk=False).ratio() - 1e-9 for bound, x, y in zip(common_bound(a, b), a, b, strict=True))
    assert common_bound(pd.Series(["ABC"]), pd.Series(["CBA"]))[0] < 0.4


def test_simulation_works_profiles_out_once(spark):
    day = F.to_date(F.lit("2026-09-05"))
    docs = spark.createDataFrame([(f"D{i}", "AR", 1000, date(2026, 9, 1), 0.9, [1 / 166] * 166) for i in range(3)], "doc_id string, kind string, outstanding long, due_date date, p_paid double, pmf array<double>")
    plan = C.monte_carlo(C.expected_profile(docs, day, 30), day, 30, 100, runs=5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(slice(pmf") == 1 and plan.count("aggregate(slice(p#") == 1


def test_bands_take_all_runs_of_the_policy(spark, monkeypatch):
    from ledgerspark.plans import catalogue
    from ledgerspark.settings import RULES

    profiles = spark.createDataFrame([("D1", "AR", 1000, "pmf", date(2000, 5, 20), [0.02] * 30)], "doc_id string, kind string, outstanding long, branch string, due_date date, p array<double>")
    monkeypatch.setattr(catalogue, "_profiles", lambda v: profiles)
    plan = catalogue.QUERIES["mc_bands"](spark, "none")._jdf.queryExecution().optimizedPlan().toString()
    assert f"Range (1, {RULES['cash_policy']['runs'] + 1}," in plan


def test_simulated_days_follow_the_profile(spark):
    day = F.to_date(F.lit("2026-09-05"))
    p = [0.05, 0.0, 0.2, 0.75]  # paid for sure within four days
    rows = [(f"D{i}", kind, 1 << (40 * (kind == "AR")), branch, date(2026, 6, 1), p) for i in range(40) for kind, branch in (("AR", "pmf"), ("AR", "hazard"), ("AP", "pmf"))]
    rows.append(("none", "AR", 1 << 45, "pmf", date(2026, 6, 1), [0.0] * 4))
    profiles = spark.createDataFrame(rows, "doc_id string, kind string, outstanding long, branch string, due_date date, p array<double>")
    x = profiles.select(F.xxhash64(F.lit(7), "doc_id", "kind", "branch").alias("key"), F.when(F.col("kind") == "AR", F.col("outstanding")).otherwise(-F.col("outstanding")).alias("signed"), F.when(F.col("branch") == "hazard", 0.25).otherwise(1.0).alias("share"), F.expr("transform(sequence(1, 4), k -> aggregate(slice(p, 1, k), 0D, (s, v) -> s + v))").alias("cum"))
    got = {}
    for r in x.repartition(3).mapInArrow(C._draws(4, 501), "run int, i int, net long").groupBy("run", "i").agg(F.sum("net").alias("net")).collect():
        got[r["run"], r["i"]] = r["net"]
    # payables are small and receivables large, so that a sum tells both numbers apart
    out = lambda v: -v % (1 << 40)
    for i, share in enumerate(p):
        ar = sum((v + out(v)) >> 40 for (_, k), v in got.items() if k == i)
        ap = sum(out(v) for (_, k), v in got.items() if k == i)
        n = 40 * 501
        assert abs(ar - 1.25 * n * share) < 5 * (1.25 * n * share) ** 0.5 + 1e-9 and abs(ap - n * share) < 5 * (n * share) ** 0.5 + 1e-9
    assert all(sum(out(got.get((run, k), 0)) for k in range(4)) == 40 for run in range(1, 502))
    bands = lambda k: [tuple(r) for r in C.monte_carlo(profiles.repartition(k), day, 4, 0, runs=501).orderBy("day").collect()]
    assert bands(1) == bands(5)


def test_stored_frames_can_be_dropped(spark):
    df = checkpointed(spark.range(5))
    assert df.count() == 5 and df.inputFiles()
    files = df.inputFiles()
    dropped(df)
    import os

    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_ladder_leaves_one_copy_of_the_books(spark):
    from pathlib import Path

    from ledgerspark.plans.ladder import reconcile

    docs = [(i, f"D{i}", "AR", f"INV-2026-{i:06d}", "AMBER WORKS", "P", 1000 + i, 0, date(2026, 8, 15), date(2026, 9, 1)) for i in range(1, 6)]
    # two lines quote each number, so that there is a second round
    lines = [(i, f"L{i}", date(2026, 9, 3), f"NEFT CR FROM AMBER WORKS INV-2026-{(i + 1) // 2:06d}", 1000 + (i + 1) // 2, f"U{i}") for i in range(1, 11)]
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("stored-*"))
    empty = lambda s: spark.createDataFrame([], s)
    m, left = reconcile(spark.createDataFrame(lines, LINES), spark.createDataFrame(docs, DOCS), empty("seq long, advice_id string, payer_name string, amount long, notified_on date, invoice_no string, utr string"), empty("seq long, settlement_id string, settled_on date, payout_utr string, txn_count int, gross long, fee long, tmn long, gst long, tds long, net long"), strategy="exact")
    assert m.count() == 5 and left.count() == 5
    kinds = [spark.read.parquet(str(p)).columns for p in set(shared.glob("stored-*")) - before]
    assert sum("narration" in k for k in kinds) == 1 and sum("counterparty" in k for k in kinds) == 1
