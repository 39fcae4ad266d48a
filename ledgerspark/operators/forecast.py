"""Cash forecasting: seasonality, payment behaviour, expected flows, percentile bands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import aging_recovery, quarter_end_boost
from ..settings import RULES

#: Delays of -45 to 120 days, one bin a day.
LOW, HIGH = -45, 120
BINS = HIGH - LOW + 1
SHRINK, FLOOR, SIGMA = 8.0, 0.0015, 5.0
#: Probability of payment of a party without any known document.
UNSEEN = 0.9


def once(x: Column) -> Column:
    """``x``, not taken to be deterministic, so that the optimiser neither repeats it where it is used nor moves filters below it."""
    return F.when(F.monotonically_increasing_id() >= 0, x)


def flows_by_day(lines: DataFrame) -> DataFrame:
    """day, inflow, outflow (both as magnitudes)."""
    a = F.col("amount")
    return lines.groupBy(F.col("txn_date").alias("day")).agg(F.sum(F.when(a > 0, a).otherwise(0)).alias("inflow"), F.sum(F.when(a < 0, -a).otherwise(0)).alias("outflow"))


def _received(flows: DataFrame, as_of: Column | None) -> DataFrame:
    got = flows.where("inflow > 0")
    return got if as_of is None else got.where(F.col("day") <= as_of)


def _index(flows: DataFrame, bucket: Column, first: int, last: int) -> DataFrame:
    """bucket, idx: mean flow of a bucket against all days, shrunk towards 1 and scaled to mean 1."""
    every = flows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("bucket"))
    x = flows.select(bucket.alias("bucket"), F.col("inflow").cast("double").alias("v"))
    by = x.groupBy("bucket").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    all_ = Window.partitionBy()
    j = every.join(by, "bucket", "left").withColumn("overall", F.sum("s").over(all_) / F.sum("n").over(all_))
    w = F.coalesce("n", F.lit(0)) / (F.coalesce("n", F.lit(0)) + SHRINK)
    j = j.withColumn("raw", 1 + w * (F.coalesce(F.col("s") / F.col("n") / F.nullif("overall", F.lit(0.0)), F.lit(1.0)) - 1))
    return j.select("bucket", F.round(F.col("raw") / F.avg("raw").over(all_), 4).alias("idx"))


def weekday_index(flows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Over the days with an inflow, up to ``as_of``."""
    return _index(_received(flows, as_of), F.weekday("day"), 0, 6)


def month_index(flows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Over the days with an inflow, up to ``as_of``."""
    return _index(_received(flows, as_of), F.month("day"), 1, 12)


def party_behaviour(docs: DataFrame, cleared: DataFrame, as_of: Column, aged_days: int = 45, dust: int = 100) -> DataFrame:
    """kind, party_code, n_cleared, n_open, n_aged, median_delay (upper), p_paid, share_uncleared.

    ``cleared`` has doc_id and cleared_on. The median comes from counts by
    delay, so that no party's delays are gathered in one row.
    """
    known = docs.where(F.col("doc_date") <= as_of).join(cleared.where(F.col("cleared_on") <= as_of), "doc_id", "left")
    delay = F.datediff("cleared_on", "due_date")
    open_ = F.col("cleared_on").isNull() & (F.col("amount") - F.col("paid") > dust)
    by = known.groupBy("kind", "party_code").agg(F.count("cleared_on").alias("n_cleared"), F.count_if(open_).alias("n_open"), F.count_if(open_ & (F.date_add("due_date", aged_days) <= as_of)).alias("n_aged"))
    c = known.where("cleared_on is not null").groupBy("kind", "party_code", delay.alias("delay")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("kind", "party_code")
    c = c.withColumns({"upto": F.sum("c").over(w.orderBy("delay")), "n": F.sum("c").over(w)})
    median = c.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("kind", "party_code").agg(F.min("delay").alias("median_delay"))
    p = F.when(F.col("n_cleared") + F.col("n_aged") == 0, 0.95).otherwise(F.least(F.lit(0.995), (F.col("n_cleared") + 1) / (F.col("n_cleared") + F.col("n_aged") + 2)))
    out = by.join(median, ["kind", "party_code"], "left")
    share = F.when(F.col("n_open") + F.col("n_cleared") > 0, F.col("n_open") / (F.col("n_open") + F.col("n_cleared"))).otherwise(0.0)
    return out.select("kind", "party_code", "n_cleared", "n_open", "n_aged", F.coalesce("median_delay", F.lit(0)).alias("median_delay"), p.alias("p_paid"), share.alias("share_uncleared"))


def delay_counts(docs: DataFrame, cleared: DataFrame, as_of: Column) -> DataFrame:
    """kind, party_code, delay (within the support), c."""
    delay = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.datediff("cleared_on", "due_date")))
    return docs.join(cleared.where(F.col("cleared_on") <= as_of), "doc_id").groupBy("kind", "party_code", delay.alias("delay")).agg(F.count("*").alias("c"))


def delay_density(counts: DataFrame, keys: list) -> DataFrame:
    """keys, bin, q: gaussian density of the delays (width 5, cut at 15 days and at the support), summing to 1."""
    off = counts.withColumn("off", F.explode(F.sequence(F.lit(-15), F.lit(15)))).withColumn("bin", F.col("delay") + F.col("off")).where(F.col("bin").between(LOW, HIGH))
    q = off.groupBy(*keys, "bin").agg(F.sum(F.col("c") * F.exp(-0.5 * F.pow(F.col("off") / SIGMA, F.lit(2.0)))).alias("q"))
    return q.withColumn("q", F.col("q") / F.sum("q").over(Window.partitionBy(*keys) if keys else Window.partitionBy()))


def delay_pmf(counts: DataFrame, parties: DataFrame | None = None) -> DataFrame:
    """kind, party_code, pmf (array by bin): the party's density shrunk towards that of all, with a floor, summing to 1.

    ``parties`` (kind, party_code) adds those without a delay, which follow all parties.
    """
    bins = F.array(*[F.lit(b) for b in range(LOW, HIGH + 1)])
    as_array = lambda df, keys: df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "q"))).alias("m")).select(*keys, F.transform(bins, lambda b: F.coalesce(F.element_at("m", b), F.lit(0.0))).alias("q"))
    # the densities of ``delay_density``, as arrays from the few delays of a party
    bell = F.array(*[F.exp(F.lit(-0.5 * (k / SIGMA) ** 2)) for k in range(16)])
    density = F.transform(bins, lambda b: F.aggregate("ds", F.lit(0.0), lambda s, x: s + x["c"] * F.coalesce(F.get(bell, F.abs(b - x["delay"])), F.lit(0.0))))
    own = counts.groupBy("kind", "party_code").agg(F.collect_list(F.struct("delay", "c")).alias("ds"), F.sum("c").alias("n")).withColumn("q", once(density))
    own = own.withColumn("t", once(F.aggregate("q", F.lit(0.0), lambda s, x: s + x))).select("kind", "party_code", "n", once(F.transform("q", lambda x: x / F.col("t"))).alias("q"))
    whole = as_array(delay_density(counts.groupBy("delay").agg(F.sum("c").alias("c")), []), []).select(F.col("q").alias("g"), F.lit(1).alias("one"))
    if parties is not None:
        zero = F.transform(bins, lambda b: F.lit(0.0))
        own = parties.join(own, ["kind", "party_code"], "left").withColumns({"q": F.coalesce("q", zero), "n": F.coalesce("n", F.lit(0))})
    j = own.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one")  # one row of 166 numbers
    w = F.col("n") / (F.col("n") + SHRINK)
    raw = F.zip_with("q", "g", lambda q, g: w * q + (1 - w) * g + FLOOR / BINS)
    j = j.withColumn("raw", once(raw)).withColumn("t", once(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x)))
    return j.select("kind", "party_code", F.transform("raw", lambda x: x / F.col("t")).alias("pmf"))


def expected_profile(docs: DataFrame, as_of: Column, horizon: int, hazard: float = RULES["aged_daily_hazard"], dust: int = 100) -> DataFrame:
    """Adds branch and p (array: probability that the document is paid on day 1..horizon).

    ``docs`` has outstanding, due_date, pmf (array by bin) and p_paid. A
    document that is no more than dust, or due far beyond the horizon, gets
    none; one overdue for 120 days or more is paid at a daily hazard on days
    other than Sunday; others follow their party's delays, given that they are
    still open.
    """
    age = F.datediff(as_of, "due_date")
    q = lambda k: F.when(k.between(LOW, HIGH), F.get("pmf", k - LOW)).otherwise(0.0)
    days = F.sequence(F.lit(1), F.lit(horizon))
    tail = F.aggregate(F.slice("pmf", F.greatest(F.lit(1), F.col("age") + 1 - LOW + 1), F.lit(BINS)), F.lit(0.0), lambda s, x: s + x)
    d = docs.withColumn("age", age).withColumn("tail", once(F.when(F.col("age") < HIGH, tail).otherwise(0.0)))
    denom = F.col("p_paid") * F.col("tail") + 1 - F.col("p_paid")
    branch = F.when(F.col("outstanding") <= dust, "dust").when(F.col("age") < LOW - horizon, "beyond").when(F.col("age") >= HIGH, "hazard").when(denom <= 1e-9, "starved").otherwise("pmf")
    d = d.withColumn("branch", once(branch)).withColumn("denom", once(denom))
    # working days up to the day before, in closed form: days less Sundays
    sundays = lambda i: F.floor((F.weekday(as_of) + i + 1) / 7) - F.floor((F.weekday(as_of) + 1) / 7)
    is_sunday = lambda i: (F.weekday(as_of) + i) % 7 == 6
    # the same for all documents: folded once if the day is a constant
    haz = F.array(*[F.when(is_sunday(i), 0.0).otherwise(hazard * F.pow(F.lit(1 - hazard), (i - 1 - sundays(i - 1)).cast("double"))) for i in map(F.lit, range(1, horizon + 1))])
    p = F.when(F.col("branch") == "hazard", F.transform(haz, lambda h: F.col("p_paid") * h)).when(F.col("branch") == "pmf", F.transform(days, lambda i: F.col("p_paid") * q(F.col("age") + i) / F.col("denom"))).otherwise(F.transform(days, lambda i: F.lit(0.0)))
    return d.withColumn("p", once(p)).drop("age", "tail", "denom")


def weekday_redistribute(profiles: DataFrame, as_of: Column, weekdays: DataFrame) -> DataFrame:
    """Weighs p by the index of each day's weekday (within 0.2 and 3), keeping the document's total.

    ``weekdays`` has seven rows.
    """
    idx = weekdays.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "idx"))), lambda x: F.greatest(F.lit(0.2), F.least(F.lit(3.0), x["idx"]))).alias("wd")).withColumn("one", F.lit(1))
    j = profiles.withColumn("one", F.lit(1)).join(F.broadcast(idx), "one").drop("one")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    j = j.withColumn("w", F.transform("p", lambda x, i: x * F.get("wd", ((F.weekday(as_of) + i + 1) % 7).cast("int"))))
    j = j.withColumns({"old": total(F.col("p")), "new": total(F.col("w"))})
    return j.withColumn("p", F.when(F.col("new") > 0, F.transform("w", lambda x: x * F.col("old") / F.col("new"))).otherwise(F.col("p"))).drop("w", "old", "new", "wd")


def expected_flows(profiles: DataFrame, as_of: Column) -> DataFrame:
    """day, expected_in, expected_out: outstanding times probability, aged claims at their recovery share."""
    x = profiles.select("kind", "outstanding", "branch", F.datediff(as_of, "due_date").alias("late"), F.posexplode("p").alias("i", "pr"))
    share = F.when((F.col("kind") == "AR") & (F.col("branch") == "hazard"), aging_recovery("late")).otherwise(1.0)
    x = x.withColumn("v", F.col("outstanding") * F.col("pr") * share).withColumn("day", F.date_add(as_of, F.col("i") + 1))
    return x.groupBy("day").agg(F.sum(F.when(F.col("kind") == "AR", F.col("v")).otherwise(0.0)).cast("long").alias("expected_in"), F.sum(F.when(F.col("kind") == "AP", F.col("v")).otherwise(0.0)).cast("long").alias("expected_out"))


def cash_path(flows: DataFrame, opening: int) -> DataFrame:
    """Adds closing, the running balance; there is a row for each day of a horizon."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return flows.withColumn("closing", F.lit(opening).cast("long") + F.sum(F.col("expected_in") - F.col("expected_out")).over(w))


def horizon_summary(path: DataFrame, opening: int, horizons: list = RULES["cash_policy"]["horizons"], floor: int = RULES["cash_policy"]["minimum_cash_paise"]) -> DataFrame:
    """horizon, net_change, worst, worst_day, days_below, first_breach, funding_need."""
    n = F.row_number().over(Window.orderBy("day"))
    x = path.withColumn("n", n).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).where("n <= horizon")
    low = F.col("closing") < floor
    g = x.groupBy("horizon").agg(F.max_by("closing", "n").alias("last"), F.min("closing").alias("worst"), F.min_by("day", F.struct("closing", "n")).alias("worst_day"), F.count_if(low).alias("days_below"), F.min(F.when(low, F.col("day"))).alias("first_breach"))
    return g.select("horizon", (F.col("last") - opening).alias("net_change"), "worst", "worst_day", "days_below", "first_breach", F.greatest(F.lit(0).cast("long"), F.lit(floor).cast("long") - F.col("worst")).alias("funding_need"))


def gateway_projection(payments: DataFrame, settlements: DataFrame, as_of: Column, days: int = 28) -> DataFrame:
    """One row: gross, net, ratio, active_days, daily_gross, lag (upper median) over the trailing days."""
    recent = lambda c: (F.col(c) <= as_of) & (F.col(c) > F.date_sub(as_of, days))
    p = payments.where(recent("captured_on")).agg(F.coalesce(F.sum("amount"), F.lit(0).cast("long")).alias("gross"), F.countDistinct("captured_on").alias("active_days")).withColumn("one", F.lit(1))
    s = settlements.where(recent("settled_on")).agg(F.coalesce(F.sum("net"), F.lit(0).cast("long")).alias("net"), F.coalesce(F.sum("gross"), F.lit(0).cast("long")).alias("settled")).withColumn("one", F.lit(1))
    lag = payments.join(settlements.select("settlement_id", "settled_on"), "settlement_id").where(recent("captured_on")).groupBy(F.datediff("settled_on", "captured_on").alias("d")).agg(F.count("*").alias("c")).where("d >= 0")
    w = Window.orderBy("d")  # a row for each lag in days
    lag = lag.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy())}).where(F.col("upto") > F.floor(F.col("n") / 2)).agg(F.coalesce(F.min("d"), F.lit(0)).alias("lag")).withColumn("one", F.lit(1))
    gross = F.when(F.col("gross") > 0, F.col("gross")).otherwise(F.col("settled"))
    return p.join(s, "one").join(lag, "one").select(gross.alias("gross"), "net", F.when(gross > 0, F.round(F.col("net") / gross, 4)).otherwise(0.965).alias("ratio"), "active_days", F.when(F.col("active_days") > 0, (gross / F.col("active_days")).cast("long")).otherwise(0).alias("daily_gross"), "lag")


def same_window_churn(docs: DataFrame, cleared: DataFrame, as_of: Column, horizon: int) -> DataFrame:
    """window, kind, churn, moved: of the last four windows, amounts raised and cleared inside, and cleared inside but raised before."""
    x = docs.join(cleared, "doc_id").withColumn("window", F.floor(F.datediff(as_of, "cleared_on") / horizon).cast("int")).where((F.col("cleared_on") <= as_of) & (F.col("window") < 4))
    start = F.date_sub(as_of, (F.col("window") + 1) * horizon)
    inside = F.col("doc_date") > start
    return x.groupBy("window", "kind").agg(F.sum(F.when(inside, F.col("amount")).otherwise(0)).alias("churn"), F.sum(F.when(inside, 0).otherwise(F.col("amount"))).alias("moved"))


def prospective(churn: DataFrame) -> DataFrame:
    """kind, expected: churn weighted .5, .25, .15, .10 over the windows in which any kind moved."""
    w = F.element_at(F.array(*[F.lit(x) for x in (0.5, 0.25, 0.15, 0.10)]), F.col("window") + 1)
    total = churn.select("window").distinct().agg(F.sum(w).alias("total")).withColumn("one", F.lit(1))  # four windows at most
    each = churn.groupBy("kind").agg(F.sum(F.col("churn") * w).alias("v")).withColumn("one", F.lit(1))
    return each.join(total, "one").select("kind", (F.col("v") / F.col("total")).cast("long").alias("expected"))


def seasonality_calendar(as_of: Column, horizon: int, weekdays: DataFrame, months: DataFrame) -> DataFrame:
    """day, factor: weekday index times month index times the quarter-end boost."""
    days = weekdays.sparkSession.range(1, horizon + 1).select(F.date_add(as_of, F.col("id").cast("int")).alias("day"))
    j = days.join(F.broadcast(weekdays), F.weekday("day") == weekdays["bucket"]).select("day", F.col("idx").alias("wd"))
    j = j.join(F.broadcast(months), F.month("day") == months["bucket"]).select("day", "wd", F.col("idx").alias("mo"))
    return j.select("day", (F.col("wd") * F.col("mo") * quarter_end_boost("day")).alias("factor"))


def _mixed(x: np.ndarray, spare: np.ndarray) -> None:
    """The finaliser of SplitMix64, in place."""
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.right_shift(x, np.uint64(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if by is not None:
            np.multiply(x, np.uint64(by), out=x)


def _draws(horizon: int, runs: int, together: int = 16):
    """Sums of signed amounts by (run, day) over the documents of one task, each drawn in each run.

    A draw is 32 bits of a hash of (document, run). Documents go ``together`` at
    a time, so that their draws stay in the processor's cache.
    """

    def run(batches):
        half = (runs + 1) // 2
        salts = [(np.arange(1, half + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(x) for x in (0, 0xD1B54A32D192ED03)]
        x, spare = np.empty((together, half), np.uint64), np.empty((together, half), np.uint64)
        total, some, weight = np.zeros(runs * horizon, np.int64), np.zeros(runs * horizon), 0.0
        top, base = float(1 << 32), np.arange(together, dtype=np.int64) << 32
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy().view(np.uint64)
            signed = b.column("signed").to_numpy().astype(np.float64)
            share = b.column("share").to_numpy()
            cum = b.column("cum").flatten().to_numpy().reshape(b.num_rows, -1)
            steps = np.minimum(np.rint(np.maximum.accumulate(cum, 1) * top), top).astype(np.int64)
            most = np.abs(signed).max() * together * runs
            for lo in range(0, b.num_rows, together):
                n = min(together, b.num_rows - lo)
                h, t = x[:n], spare[:n]
                np.add(key[lo : lo + n, None], salts[0], out=h)
                _mixed(h, t)
                u = h.view(np.uint32)[:, :runs]
                at = steps[lo : lo + n]
                # most draws are past the last day
                hit = u <= np.maximum(at[:, -1:] - 1, 0).astype(np.uint32)
                hit[at[:, -1] == 0] = False
                doc, who = np.nonzero(hit)
                drawn = u[doc, who].astype(np.int64)
                day = np.searchsorted((at + base[:n, None]).ravel(), drawn + base[doc], "right") - doc * at.shape[1]
                if (share[lo : lo + n] < 1).any():
                    np.add(key[lo : lo + n, None], salts[1], out=h)
                    _mixed(h, t)
                    paid = h.view(np.uint32)[:, :runs][doc, who] < share[lo : lo + n][doc] * top
                    doc, who, day = doc[paid], who[paid], day[paid]
                if weight + most > 1 << 52:  # sums of whole numbers are exact up to there
                    total += some.astype(np.int64)
                    some[:], weight = 0.0, 0.0
                some += np.bincount(who * horizon + day, signed[lo : lo + n][doc], runs * horizon)
                weight += most
        total += some.astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // horizon + 1).astype(np.int32)), pa.array((at % horizon).astype(np.int32)), pa.array(total[at])], names=["run", "i", "net"])

    return run


def monte_carlo(profiles: DataFrame, as_of: Column, horizon: int, opening: int, runs: int = RULES["cash_policy"]["runs"], seed: int = 7) -> DataFrame:
    """day, p10, p50, p90 of the closing balance over simulated runs.

    Each document of each run draws a day by inverse distribution from a hash
    of (seed, run, document): the draws are independent of partitioning. Each
    task adds up its documents by (run, day), so that no row is made for a
    document in a run.
    """
    none = F.struct(F.array().cast("array<double>").alias("c"), F.lit(0.0).alias("s"))
    upto = F.aggregate(F.slice("p", 1, horizon), none, lambda a, x: F.struct(F.array_append(a["c"], a["s"] + x).alias("c"), (a["s"] + x).alias("s")))
    p = profiles.where("branch in ('pmf', 'hazard')").select("doc_id", "outstanding", "kind", "branch", F.datediff(as_of, "due_date").alias("late"), once(upto).alias("a"))
    share = F.when((F.col("kind") == "AR") & (F.col("branch") == "hazard"), aging_recovery("late")).otherwise(1.0)
    signed = F.when(F.col("kind") == "AR", F.col("outstanding")).otherwise(-F.col("outstanding"))
    x = p.where("a.s > 0 and outstanding is not null").select(F.xxhash64(F.lit(seed), "doc_id").alias("key"), signed.cast("long").alias("signed"), share.cast("double").alias("share"), F.col("a.c").alias("cum"))
    day = x.mapInArrow(_draws(horizon, runs), "run int, i int, net long").groupBy("run", "i").agg(F.sum("net").alias("net"))
    grid = profiles.sparkSession.range(1, runs + 1).select(F.col("id").cast("int").alias("run"), F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("i"))
    path = grid.join(day, ["run", "i"], "left").withColumn("closing", F.lit(opening) + F.sum(F.coalesce("net", F.lit(0))).over(Window.partitionBy("run").orderBy("i")))
    q = path.groupBy("i").agg(F.percentile("closing", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    return q.select(F.date_add(as_of, F.col("i") + 1).alias("day"), *[F.col("q")[k].alias(n) for k, n in enumerate(("p10", "p50", "p90"))])


def naive_baselines(flows: DataFrame, docs: DataFrame, as_of: Column, horizon: int) -> DataFrame:
    """day, seasonal (mean net of the same weekday, 1 to 8 weeks back), moving (mean net of the active days of four weeks), due (receivables less payables due)."""
    net = flows.where(F.col("day") <= as_of).select("day", (F.col("inflow") - F.col("outflow")).alias("net"))
    days = flows.sparkSession.range(1, horizon + 1).select(F.date_add(as_of, F.col("id").cast("int")).alias("day"))
    back = days.withColumn("was", F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.date_sub("day", k * 7))))
    seasonal = back.join(net.withColumnRenamed("day", "was"), "was", "left").groupBy("day").agg(F.round(F.avg("net"), 2).alias("seasonal"))
    moving = net.where(F.col("day") > F.date_sub(as_of, 28)).agg(F.round(F.avg("net"), 2).alias("moving")).withColumn("one", F.lit(1))
    due = docs.groupBy(F.col("due_date").alias("day")).agg(F.sum(F.when(F.col("kind") == "AR", F.col("amount")).otherwise(-F.col("amount"))).alias("due"))
    return seasonal.withColumn("one", F.lit(1)).join(moving, "one").join(due, "day", "left").select("day", "seasonal", "moving", F.coalesce("due", F.lit(0).cast("long")).alias("due"))
