"""Scores against known truth, recovery arithmetic, ageing and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import tolerance

# Truth kinds that can be matched, and the triage table.
MATCHABLE = ["matchable", "matchable_amount_mismatch", "matchable_lumpsum", "gateway_settlement"]
QUARANTINE = ["expected_unmatched_charge", "expected_unmatched_interest", "expected_unmatched_unknown", "expected_unmatched_duplicate"]
TRIAGE = {
    "BANK_CHARGE_NO_DOCUMENT": ("bank_charge", "post_to_bank_charges_gl"),
    "BANK_INTEREST_NO_DOCUMENT": ("interest", "post_to_interest_income_gl"),
    "REVERSAL_OR_RETURN": ("refund_or_reversal", "match_against_original_then_repost"),
    "SHORT_DEDUCTION": ("partial_or_short_payment", "raise_credit_note_or_writeoff"),
    "UNALLOCATED_CREDIT": ("customer_overpayment", "contact_customer_for_remap_advice"),
    "UNMATCHED_DEBIT": ("vendor_overpayment", "confirm_payee_with_ap_team_before_reposting"),
    "DUPLICATE_BANK_LINE": ("duplicate_bank_posting", "verify_with_bank_then_de_dup"),
    "SUSPECTED_DUPLICATE": ("duplicate_bank_posting", "ask_ap_team_whether_this_is_a_second_payment"),
    "AMBIGUOUS_CANDIDATES": ("needs_invoice_breakup_from_customer", "human_pick_then_post"),
    "AMBIGUOUS_LUMPSUM": ("needs_invoice_breakup_from_customer", "allocate_by_oldest_invoice_first"),
    "DOC_REF_OUTSIDE_WINDOW": ("advance_or_overshoot", "check_if_payment_is_against_a_different_invoice"),
    "OVERDUE_UNRECONCILED_AR": ("unknown", "chase_or_provision"),
    "FEE_TIER_MISMATCH": ("unknown", "dispute_with_gateway_and_attach_batch_breakdown"),
    "CREDIT_AMOUNT_MISMATCH": ("gateway_settlement_unallocated", "request_settlement_breakdown_for_unexplained_gap"),
    "SETTLEMENT_NOT_CREDITED": ("gateway_settlement_unallocated", "escalate_to_gateway_settlement_team"),
    "PARSE_FAILURE": ("misposted_to_wrong_entity", "fix_the_source_file"),
}


def judged(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """truth's line_id, kind and amount with tier, auto_post and outcome (correct, partial, wrong, missed, quarantined, false)."""
    m = matches.groupBy("line_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("doc_ids")))).alias("claimed"), F.max("auto_post").alias("auto_post"), F.min("tier").alias("tier"))
    j = truth.select("line_id", "kind", "amount", F.array_sort(F.array_distinct("doc_ids")).alias("real")).join(m, "line_id", "left")
    can = F.col("kind").isin(MATCHABLE)
    some = F.arrays_overlap("claimed", "real")
    outcome = F.when(can & F.col("claimed").isNull(), "missed").when(can & (F.col("claimed") == F.col("real")), "correct").when(can & some, "partial").when(can, "wrong").when(F.col("claimed").isNull(), "quarantined").otherwise("false")
    return j.withColumn("outcome", outcome)


def _card(g: DataFrame, keys: list) -> DataFrame:
    r = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0)
    is_ = lambda *o: F.count_if(F.col("outcome").isin(*o))
    out = (g.groupBy(*keys) if keys else g).agg(
        F.count_if(F.col("kind").isin(MATCHABLE)).alias("matchable"), is_("correct", "partial", "wrong", "false").alias("matched"), is_("correct").alias("correct"), is_("partial").alias("partial"), is_("missed").alias("missed"),
        F.count_if(F.col("kind").isin(QUARANTINE)).alias("to_quarantine"), is_("quarantined").alias("quarantined"), F.count_if("auto_post").alias("auto_posted"), F.count_if(F.col("auto_post") & (F.col("outcome") == "correct")).alias("auto_correct"),
        F.coalesce(F.sum(F.when(F.col("kind").isin(MATCHABLE), F.abs("amount"))), F.lit(0).cast("long")).alias("value"), F.coalesce(F.sum(F.when(F.col("outcome") == "correct", F.abs("amount"))), F.lit(0).cast("long")).alias("value_correct"),
    )
    out = out.withColumns({"precision": r("correct", "matched"), "recall": r("correct", "matchable"), "auto_post_precision": F.when(F.col("auto_posted") > 0, F.round(F.col("auto_correct") / F.col("auto_posted"), 4)).otherwise(1.0), "rupee_accuracy": r("value_correct", "value"), "quarantine_accuracy": r("quarantined", "to_quarantine")})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, F.round(2 * F.col("precision") * F.col("recall") / both, 4)).otherwise(0.0))


def scorecard(matches: DataFrame, truth: DataFrame) -> DataFrame:
    return _card(judged(matches, truth), [])


def scorecard_by(matches: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """The scorecard by ``kind`` or ``tier``."""
    return _card(judged(matches, truth), [key])


def aged_receivables(docs: DataFrame, as_of: Column) -> DataFrame:
    """doc_id, party_code, outstanding, days_overdue, bucket of open receivables that are due."""
    d = docs.where("kind = 'AR'").withColumns({"outstanding": F.greatest(F.lit(0).cast("long"), F.col("amount")) - F.col("paid"), "days_overdue": F.datediff(as_of, "due_date")})
    n = F.col("days_overdue")
    bucket = F.when(n <= 30, "1-30").when(n <= 60, "31-60").when(n <= 90, "61-90").when(n <= 180, "91-180").otherwise("180+")
    return d.where((F.col("outstanding") > 0) & (n >= 0)).select("doc_id", "party_code", "outstanding", "days_overdue", bucket.alias("bucket"))


def exception_mix(exceptions: DataFrame) -> DataFrame:
    """code, n, amount."""
    return exceptions.groupBy("code").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def triage(exceptions: DataFrame) -> DataFrame:
    """Adds category, action and owner from the fixed table; ``exceptions`` has code and ref_type."""
    look = lambda i: F.coalesce(*[F.when(F.col("code") == k, F.lit(v[i])) for k, v in TRIAGE.items()], F.lit(("unknown", "investigate_manually")[i]))
    owner = F.when(F.col("ref_type") == "invoice", "AR").when(F.col("ref_type") == "settlement", "Treasury").otherwise("Banking-ops")
    return exceptions.withColumns({"category": look(0), "action": look(1), "owner": owner})


def receivables_recovery(planted: DataFrame, found: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row: short payments that were surfaced by a match, queued as an unresolved line, or missed.

    ``planted`` has doc_id, deduction, expected; ``found`` has doc_id, gap;
    ``unresolved`` has amount. The queue is probed on bins of the tolerance.
    """
    best = found.groupBy("doc_id").agg(F.max("gap").alias("gap"))
    p = planted.join(best, "doc_id", "left").withColumn("tol", tolerance("expected"))
    p = p.withColumn("got", F.when(F.col("gap") > F.col("tol"), F.least("gap", "deduction")))
    width = 1_000_000  # twice the largest tolerance
    bins = F.array_distinct(F.array(F.floor((F.col("expected") - F.col("tol")) / width), F.floor((F.col("expected") + F.col("tol")) / width)))
    asked = p.where("got is null").select("doc_id", "expected", "tol", F.explode(bins).alias("bin"))
    u = unresolved.select(F.abs("amount").alias("size")).distinct().withColumn("bin", F.floor(F.col("size") / width))
    queued = asked.join(u, (asked["bin"] == u["bin"]) & (F.abs(F.col("size") - F.col("expected")) <= F.col("tol")), "left_semi").select("doc_id", F.lit(True).alias("queued")).distinct()
    p = p.join(queued, "doc_id", "left")
    return p.agg(F.count("*").alias("planted"), F.sum("deduction").alias("planted_amount"), F.count("got").alias("surfaced"), F.coalesce(F.sum("got"), F.lit(0).cast("long")).alias("surfaced_amount"), F.count_if("queued").alias("queued"), F.count_if(F.col("got").isNull() & F.col("queued").isNull()).alias("missed"))


def batch_defect_recovery(planted: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: planted defects by batch, how many were flagged, what was identified, and flags without a defect.

    ``planted`` has settlement_id, class, amount (one row for each defect).
    """
    p = planted.groupBy("settlement_id").agg(F.sum("amount").alias("planted"))
    j = claims.select("settlement_id", F.size("flags").alias("n"), "recoverable").join(p, "settlement_id", "left")
    hit = F.col("planted").isNotNull()
    return j.agg(F.count_if(hit).alias("defects"), F.count_if(hit & (F.col("n") > 0)).alias("flagged"), F.coalesce(F.sum("planted"), F.lit(0).cast("long")).alias("planted_amount"), F.coalesce(F.sum(F.when(hit, F.least("planted", "recoverable"))), F.lit(0).cast("long")).alias("identified"), F.count_if(~hit & (F.col("n") > 0)).alias("false_flags"))


def top_hit_rate(docs: DataFrame, k: int = 25) -> DataFrame:
    """One row: of the k documents with the largest ``expected``, and with the largest ``outstanding``, the share that ``paid_in_window``."""
    rate = lambda by: docs.orderBy(F.desc(by), "doc_id").limit(k).agg(F.round(F.avg(F.col("paid_in_window").cast("double")), 4).alias(f"by_{by}")).withColumn("one", F.lit(1))
    return rate("expected").join(rate("outstanding"), "one").drop("one")


def forecast_errors(forecast: DataFrame, actual: DataFrame) -> DataFrame:
    """model, horizon, mae, bias, share: forecast has model, origin, horizon, net; actual has origin, horizon, net, gross."""
    j = forecast.join(actual.withColumnRenamed("net", "real"), ["origin", "horizon"])
    e = F.col("net") - F.col("real")
    return j.groupBy("model", "horizon").agg(F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.avg(F.when(F.col("gross") > 0, 100.0 * F.abs(e) / F.col("gross")).otherwise(0.0)).alias("share"))


def worst_class(by_kind: DataFrame, least: int = 10) -> DataFrame:
    """The kind with the lowest recall among those with at least ``least`` lines (among all, if there is none)."""
    any_ = Window.partitionBy()
    x = by_kind.where("matchable > 0").withColumn("big", F.max((F.col("matchable") >= least).cast("int")).over(any_))
    return x.where((F.col("big") == 0) | (F.col("matchable") >= least)).orderBy("recall", F.desc("matchable")).limit(1).select("kind", "recall", "matchable")
