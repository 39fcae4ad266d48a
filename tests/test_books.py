from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import evaluate as E
from ledgerspark.operators import forecast as C
from ledgerspark.operators import recon as R
from ledgerspark.operators import verify as V
from ledgerspark.plans.ladder import reconcile
from ledgerspark.sources.books import load_books

LINES = "seq long, line_id string, txn_date date, narration string, amount long, utr string"
DOCS = "seq long, doc_id string, kind string, number string, counterparty string, party_code string, amount long, paid long, doc_date date, due_date date"
ADVICES = "seq long, advice_id string, payer_name string, amount long, notified_on date, invoice_no string, utr string"
SETTLEMENTS = "seq long, settlement_id string, settled_on date, payout_utr string, txn_count int, gross long, fee long, tmn long, gst long, tds long, net long"


def doc(seq, amount, party="ZENITH FOODS", due=date(2026, 9, 1), kind="AR", number=None):
    return (seq, f"D{seq}", kind, number or f"INV-2026-{seq:06d}", party, "P-" + party[:3], amount, 0, date(2026, 8, 15), due)


def line(seq, amount, text, utr=None, day=date(2026, 9, 3)):
    return (seq, f"L{seq}", day, text, amount, utr)


def test_duplicates(spark):
    lines = spark.createDataFrame([line(1, 500, "A", "u1"), line(2, -500, "A", "u1"), line(3, 900, "CHQ CLG ZENITH FOODS"), line(4, 900, "CHQ CLG ZENITH FOODS"), line(5, 900, "CHQ CLG ZENITH FOODS", day=date(2026, 9, 7))], LINES)
    assert [(r["line_id"], r["anchor"]) for r in R.t0_utr_duplicates(lines).collect()] == [("L2", "L1")]
    # L5 is four days after L3, the last line that was kept
    assert [(r["line_id"], r["anchor"]) for r in R.t0_suspected_duplicates(lines).collect()] == [("L4", "L3")]


def test_ladder_uses_each_document_once(spark):
    docs = spark.createDataFrame([doc(1, 10_000), doc(2, 10_000), doc(3, 70_000, "MARINE WORKS"), doc(4, 30_000, "MARINE WORKS"), doc(5, 55_555, "OPTIC STORES")], DOCS)
    lines = spark.createDataFrame([
        line(1, 10_000, "NEFT CR FROM ZENITH FOODS INV-2026-000001"), line(2, 10_000, "NEFT CR FROM ZENITH FOODS INV-2026-000001", day=date(2026, 9, 8)), line(3, 100_000, "RTGS MARINE WORKS"),
        line(4, 55_555, "UPI OPTIC STORES"), line(5, -900, "MONTHLY MAINTENANCE CHG"),
    ], LINES)
    m, left = reconcile(lines, docs, spark.createDataFrame([], ADVICES), spark.createDataFrame([], SETTLEMENTS))
    got = {r["line_id"]: (r["tier"], r["doc_ids"]) for r in m.collect()}
    used = [d for _, ids in got.values() for d in ids]
    assert got["L1"] == ("t3", ["D1"]) and got["L4"] == ("t4", ["D5"]) and got["L3"] == ("t6", ["D3", "D4"])
    assert len(used) == len(set(used)) and got["L2"][1] == ["D2"]
    assert [r["code"] for r in R.classify_unresolved(left).collect()] == ["BANK_CHARGE_NO_DOCUMENT"]
    assert all(r["confidence"] >= 0.9 for r in m.where("auto_post").collect())


def test_ladder_goes_in_book_order(spark):
    docs = spark.createDataFrame([
        doc(1, 100_000, "ZENITH FOODS WORKS"), doc(2, 100_010, "ZENITH FOODS WORKSX"), doc(3, 50_000, "MARINE MILLS"), doc(4, 20_000, "MARINE MILLS"), doc(5, 9_999, "MARINE MILLS", date(2020, 9, 1)),
        doc(6, 77_700, "OPTIC STORES"), doc(7, 88_800, "LOTUS TOOLS", date(2020, 1, 1)), doc(8, 88_800, "LOTUS TOOLS"),
    ], DOCS)
    lines = spark.createDataFrame([
        line(1, 100_050, "RTGS ZENITH FOODS WORKS"), line(2, 100_060, "RTGS ZENITH FOODS WORKS"), line(3, 100_070, "RTGS ZENITH FOODS WORKSX"),
        line(4, 70_000, "NEFT CR FROM MARINE MILLS INV-2026-000003"), line(5, 70_000, "CHQ", "u5"), line(6, 88_800, "NEFT CR FROM LOTUS TOOLS INV-2026-000007"),
    ], LINES)
    advices = spark.createDataFrame([(1, "A1", "x", 1, date(2026, 9, 1), None, "u5"), (2, "A2", "x", 77_700, date(2026, 9, 1), None, "u5")], ADVICES)
    m, left = reconcile(lines, docs, advices, spark.createDataFrame([], SETTLEMENTS))
    got = {r["line_id"]: r for r in m.collect()}
    # L2 finds D1 gone and takes D2, before L3 has its turn
    assert [(got[x]["tier"], got[x]["doc_ids"]) for x in ("L1", "L2")] == [("t5", ["D1"]), ("t5", ["D2"])] and "L3" not in got
    # what D3 leaves open is D4's amount
    assert got["L4"]["doc_ids"] == ["D3", "D4"] and got["L4"]["confidence"] <= 0.88 and not got["L4"]["auto_post"]
    # no advice names a document, so the amount of the last one counts
    assert (got["L5"]["tier"], got["L5"]["doc_ids"], got["L5"]["diff"]) == ("t2", ["D6"], -7_700)
    # the quoted document is outside its window: no other tier guesses
    assert sorted(r["line_id"] for r in left.collect()) == ["L3", "L6"] and len(got) == 4


def test_sums_of_a_residue(spark):
    import random
    from itertools import combinations

    from ledgerspark.plans.ladder import _sums

    rnd = random.Random(5)
    for _ in range(300):
        v, t = [rnd.randrange(1, 12) for _ in range(rnd.randrange(9))], rnd.randrange(30)
        want = [c for n in (2, 3, 4) for c in combinations(range(len(v)), n) if t > 0 and sum(v[i] for i in c) == t]
        got = _sums(v, t, 2, 4)
        assert len(got) == min(2, len(want)) and {tuple(sorted(g)) for g in got} <= set(want)


def test_subset_sums(spark):
    df = spark.createDataFrame([([100, 150, 250, 75], 500)], "v array<long>, t long")
    assert df.select(R.subset_sums("v", "t").alias("m")).first()["m"] == [7]


def test_greedy_is_the_sequential_one(spark):
    import random

    rnd = random.Random(3)
    rows = [(rnd.randrange(30), rnd.randrange(30), rnd.randrange(5) / 10) for _ in range(200)]
    rows = list({(a, b): (a, b, s) for a, b, s in rows}.values())
    want, la, da = set(), set(), set()
    for s, a, b in sorted(((s, a, b) for a, b, s in rows), reverse=True):
        if a not in la and b not in da:
            want.add((a, b)), la.add(a), da.add(b)
    got = R.greedy_assignment(spark.createDataFrame(rows, "l_seq long, d_seq long, score double"), store=lambda df: df.cache())
    assert {(r["l_seq"], r["d_seq"]) for r in got.collect()} == want


def test_batch_arithmetic(spark):
    s = spark.createDataFrame([(1, "b1", date(2026, 9, 1), "u", 1, 100_000, 2_000, 1, 360, 40, 97_599), (2, "b2", date(2026, 9, 2), "v", 1, 100_000, 2_500, 1, 450, 50, 96_999)], SETTLEMENTS)
    p = spark.createDataFrame([("p1", "b1", 100_000, "card", date(2026, 8, 30)), ("p2", "b2", 100_000, "card", date(2026, 8, 30))], "payment_id string, settlement_id string, amount long, method string, captured_on date")
    r = spark.createDataFrame([], "refund_id string, settlement_id string, amount long, created_on date")
    lines = spark.createDataFrame([line(1, 97_599, "x"), line(2, 96_999, "y")], LINES)
    links = spark.createDataFrame([("b1", "L1"), ("b2", "L2")], "settlement_id string, line_id string")
    got = V.batch_claims(V.batch_flags(V.with_credits(V.batch_expected(s, p, r), links, lines), F.to_date(F.lit("2026-09-30"))))
    by = {x["settlement_id"]: x for x in got.collect()}
    assert by["b1"]["flags"] == [] and by["b1"]["recoverable"] == 0
    assert "FEE_TIER_MISMATCH" in by["b2"]["flags"] and by["b2"]["overbilled"] == 500


def test_profiles_and_path(spark):
    day = F.to_date(F.lit("2026-09-05"))
    docs = spark.createDataFrame([doc(i, 1000 * i) for i in range(1, 6)], DOCS)
    cleared = spark.createDataFrame([("D1", date(2026, 9, 3)), ("D2", date(2026, 9, 4))], "doc_id string, cleared_on date")
    counts = C.delay_counts(docs, cleared, day)
    pmf = C.delay_pmf(counts)
    assert abs(sum(pmf.first()["pmf"]) - 1) < 1e-9
    b = C.party_behaviour(docs, cleared, day)
    open_ = docs.join(cleared, "doc_id", "left_anti").withColumn("outstanding", F.col("amount"))
    prof = C.expected_profile(open_.join(b.select("kind", "party_code", "p_paid"), ["kind", "party_code"]).join(pmf, ["kind", "party_code"]), day, 30)
    for r in prof.collect():
        assert r["branch"] == "pmf" and 0 < sum(r["p"]) <= 1
    path = C.cash_path(C.expected_flows(prof, day), 100).orderBy("day").collect()
    assert path[-1]["closing"] == 100 + sum(x["expected_in"] - x["expected_out"] for x in path)
    bands = C.monte_carlo(prof, day, 30, 100, runs=40).collect()
    assert len(bands) == 30 and all(x["p10"] <= x["p50"] <= x["p90"] for x in bands)


def test_scorecard(spark):
    m = spark.createDataFrame([("a", ["1"], "t3", True), ("b", ["1", "2"], "t3", False), ("d", ["9"], "t4", False)], "line_id string, doc_ids array<string>, tier string, auto_post boolean")
    t = spark.createDataFrame([("a", ["1"], "matchable", 10), ("b", ["2"], "matchable", 20), ("c", ["3"], "matchable", 30), ("d", [], "expected_unmatched_charge", 5)], "line_id string, doc_ids array<string>, kind string, amount long")
    r = E.scorecard(m, t).first()
    assert (r["matchable"], r["matched"], r["correct"], r["partial"], r["missed"], r["auto_posted"]) == (3, 3, 1, 1, 1, 1)


def test_load_books(spark, tmp_path):
    (tmp_path / "bank_statement.csv").write_text("﻿txn_date,narration,amount_in,amount_out\n2026-09-01,NEFT x,100.50,\nnope,y,5,\n2026-09-02,z,0,0\n", encoding="utf-8")
    (tmp_path / "invoices.csv").write_text("document_no,customer_name,document_date,gross_amount,net_amount\nINV-1,Acme,2026-08-01,100,\n,Bad,2026-08-01,5,\n")
    b = load_books(spark, str(tmp_path))
    assert [(r["line_id"], r["amount"]) for r in b.bank_lines.collect()] == [("bank_statement-2", 10050)]
    assert sorted(r["reason"] for r in b.quarantine.collect()) == ["bad date", "missing number/date/amount", "zero amount"]
    assert [r["amount"] for r in b.docs.collect()] == [10000] and str(b.as_of) == "2026-09-01" and "missing bills.csv" in b.warnings
    with pytest.raises(FileNotFoundError):
        load_books(spark, str(tmp_path / "none"))
