"""Gateway settlements, recomputed from payments in integer paise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import RULES


def _trunc(x: Column) -> Column:
    return x.cast("long")


def rate(method: str, fees: dict) -> Column:
    """Rate of a payment's mode; unknown modes pay the default one's."""
    default = fees["modes"][fees["default_mode"]]
    return F.coalesce(*[F.when(F.lower(F.col(method)) == m, F.lit(r)) for m, r in sorted(fees["modes"].items())], F.lit(default))


def batch_expected(settlements: DataFrame, payments: DataFrame, refunds: DataFrame, fees: dict = RULES["fees"]) -> DataFrame:
    """The settlement's columns with n_payments, refunds, exp_fee, exp_tmn, exp_gst, exp_tds, exp_net.

    Fees are cut to whole paise payment by payment, before they are added.
    """
    p = payments.where("settlement_id is not null").groupBy("settlement_id").agg(F.count("*").alias("n_payments"), F.sum(_trunc(F.col("amount") * rate("method", fees))).alias("fee_sum"))
    r = refunds.where("settlement_id is not null").groupBy("settlement_id").agg(F.sum("amount").alias("refunds"))
    s = settlements.join(p, "settlement_id", "left").join(r, "settlement_id", "left")
    default = fees["modes"][fees["default_mode"]]
    s = s.withColumns({"n_payments": F.coalesce("n_payments", F.lit(0).cast("long")), "refunds": F.coalesce("refunds", F.lit(0).cast("long")), "exp_fee": F.coalesce("fee_sum", _trunc(F.col("gross") * F.lit(default)))}).drop("fee_sum")
    s = s.withColumn("exp_tmn", _trunc(F.col("gross") * F.lit(fees["tmn"]))).withColumn("exp_gst", _trunc((F.col("exp_fee") + F.col("exp_tmn")) * F.lit(fees["gst"]))).withColumn("exp_tds", _trunc(F.col("exp_fee") * F.lit(fees["tds"])))
    return s.withColumn("exp_net", F.col("gross") - F.col("exp_fee") - F.col("exp_tmn") - F.col("exp_gst") - F.col("exp_tds") - F.col("refunds"))


def with_credits(expected: DataFrame, links: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds credited, the amount of the bank line linked to each settlement (null: none)."""
    paid = links.join(lines.select("line_id", F.col("amount").alias("credited")), "line_id").groupBy("settlement_id").agg(F.max("credited").alias("credited"))
    return expected.join(paid, "settlement_id", "left")


def batch_flags(batches: DataFrame, as_of: Column, fees: dict = RULES["fees"]) -> DataFrame:
    """Adds flags, the sorted names of the checks that a batch fails."""
    tol = fees["tolerance_paise"]
    c = F.col
    checks = {
        "FEE_TIER_MISMATCH": F.abs(c("fee") - c("exp_fee")) > F.greatest(F.lit(tol).cast("long"), _trunc(c("exp_fee") * F.lit(0.005))),
        "FEE_COMPONENT_MISMATCH": (F.abs(c("gst") - c("exp_gst")) > tol) | (F.abs(c("tds") - c("exp_tds")) > tol),
        "BATCH_ARITHMETIC": F.abs(c("gross") - c("fee") - c("tmn") - c("gst") - c("tds") - c("refunds") - c("net")) > tol,
        "NOT_CREDITED": c("credited").isNull() & (c("settled_on") <= as_of),
        "CREDIT_AMOUNT_MISMATCH": F.coalesce(F.abs(c("credited") - c("net")) > tol, F.lit(False)),
    }
    return batches.withColumn("flags", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in checks.items()])))


def batch_claims(batches: DataFrame, fees: dict = RULES["fees"]) -> DataFrame:
    """Adds what a batch was overbilled, leaves unexplained, lacks in credit, and what is recoverable.

    ``recoverable`` adds the unexplained residue to the larger of the other
    two; ``recoverable_dedup`` does not count a residue twice that the credit
    follows.
    """
    c, zero = F.col, F.lit(0).cast("long")
    b = batches.withColumns(
        {
            "overbilled": c("fee") - c("exp_fee"),
            "unexplained": c("gross") - c("fee") - c("tmn") - c("gst") - c("tds") - c("refunds") - c("net"),
            "component_overbill": F.greatest(zero, c("gst") - c("exp_gst")) + F.greatest(zero, c("tds") - c("exp_tds")),
            "undercredited": F.when(c("credited").isNull(), zero).otherwise(F.greatest(zero, c("exp_net") - c("credited"))),
            "credit_gap": F.when(c("credited").isNull(), zero).otherwise(c("net") - c("credited")),
        }
    )
    b = b.withColumn("rate_card_claim", F.greatest(zero, c("overbilled")) + c("component_overbill"))
    most = F.greatest("rate_card_claim", "undercredited")
    b = b.withColumns({"recoverable": F.abs("unexplained") + most, "recoverable_dedup": F.greatest(F.abs("unexplained") + c("rate_card_claim"), c("undercredited"))})
    return b.withColumn("recovery_rate_pct", F.when(c("exp_net") <= 0, 100.0).otherwise(F.round(100.0 * F.coalesce("credited", zero) / c("exp_net"), 4)))


def verify_summary(claims: DataFrame) -> DataFrame:
    """One row of sums and counts over all batches."""
    flag = lambda n: F.count_if(F.array_contains("flags", n))
    names = ["FEE_TIER_MISMATCH", "FEE_COMPONENT_MISMATCH", "BATCH_ARITHMETIC", "NOT_CREDITED", "CREDIT_AMOUNT_MISMATCH"]
    sums = ["gross", "fee", "exp_fee", "net", "exp_net", "overbilled", "undercredited", "recoverable", "recoverable_dedup"]
    return claims.agg(F.count("*").alias("batches"), F.count_if(F.size("flags") > 0).alias("flagged"), *[F.sum(n).alias(f"{n}_sum") for n in sums], *[flag(n).alias(n.lower()) for n in names])


def unsettled_payments(payments: DataFrame, as_of: Column, fees: dict = RULES["fees"]) -> DataFrame:
    """One row: n, amount and the first five ids of captured payments that no batch has paid out in time."""
    late = payments.where(F.col("settlement_id").isNull() & (F.date_add("captured_on", fees["expect_days"] + 2) < as_of))
    firsts = late.select("payment_id").orderBy("payment_id").limit(5).agg(F.array_join(F.array_sort(F.collect_list("payment_id")), ";").alias("first_ids")).withColumn("one", F.lit(1))
    total = late.agg(F.count("*").alias("n"), F.coalesce(F.sum("amount"), F.lit(0).cast("long")).alias("amount")).withColumn("one", F.lit(1))
    return total.join(firsts, "one").select("n", "amount", "first_ids")


def settlement_gaps(settlements: DataFrame, fees: dict = RULES["fees"]) -> DataFrame:
    """settled_on, previous, gap_days where payouts paused for longer than allowed.

    One row per payout day goes into the window, not one per settlement.
    """
    days = settlements.select("settled_on").distinct()
    w = Window.orderBy("settled_on")
    gaps = days.withColumn("previous", F.lag("settled_on").over(w)).withColumn("gap_days", F.datediff("settled_on", "previous"))
    return gaps.where(F.col("gap_days") > fees["gap_days"] + 1)


def orphan_refunds(refunds: DataFrame, as_of: Column) -> DataFrame:
    """Refunds that no batch has taken up after four days."""
    return refunds.where(F.col("settlement_id").isNull() & (F.date_add("created_on", 4) < as_of)).select("refund_id", "amount", "created_on")
