"""Operator 5, mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Rows of a source, in the order of a hash, are cut into blocks of
``block_rows``. Weights are a_i slots of a frame of D slots: stated weights
exactly, if their frame has at most ``EXACT_FRAME`` slots, and the default ones
by rounding to ``FRAME`` slots, which are then the target. Block k of source i is released at slot floor(k * D / a_i) and due by slot
ceil((k + 1) * D / a_i); in each slot the released block with the earliest
deadline runs. On one stream with weights that add up to one, earliest
deadline first meets every window (Baruah et al. 1996), so after any number of
slots each source is less than one block off its target. The schedule repeats
after D slots, so one frame of bounded size is computed, and block k takes
slot (k div a_i) * D + slot of block (k mod a_i) in the frame: no step of the
work is sequential in the rows.

No row is dropped or repeated: each row gets its slot. When a source ends, its
slots stay empty; rows up to that point have ``on_target`` true.

Contract cases: rows without a source are a source of their own (''), sorted
first; repeated rows get places next to each other; sources without a stated
weight, or with one of 0, take no part in a stated mixture: their rows have a
null slot and place, and ``on_target`` false; stated sources without rows are
left out of the target; a negative weight is an error; an empty table gives an
empty result; other columns pass through, also those whose names clash with the
ones used here.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, read_table, small_side, written

BLOCK_ROWS = 32
FRAME = 1024
#: Slots that the exact frame of stated weights may have.
EXACT_FRAME = 1 << 14
ALPHA = 0.5


def stated_shares(weights: dict, present: list, limit: int = EXACT_FRAME) -> tuple[dict, int]:
    """Slots by source, and the size of the frame, of the stated weights of the sources that are present.

    Weights are taken as decimal numbers, so that 1 to 3000 has a frame of
    3,001 slots. If the exact frame has more than ``limit`` slots, weights are
    rounded to that many, one for each source at least.
    """
    if any(Fraction(str(x)) < 0 for x in weights.values()):
        raise ValueError("a weight is negative")
    w = {s: Fraction(str(weights[s])) for s in sorted(present) if Fraction(str(weights.get(s, 0))) > 0}
    if not w:
        return {}, 0
    w = {s: x / sum(w.values()) for s, x in w.items()}
    d = math.lcm(*[x.denominator for x in w.values()])
    if d > limit:
        d = max(limit, 2 * len(w))
        q = {s: x * (d - len(w)) for s, x in w.items()}
        a = {s: 1 + int(x) for s, x in q.items()}
        for s in sorted(q, key=lambda s: (int(q[s]) - q[s], s))[: d - sum(a.values())]:
            a[s] += 1
        return a, d
    return {s: int(x * d) for s, x in w.items()}, d


def frame_of(sizes: DataFrame, alpha: float = ALPHA, weights: dict | None = None, frame: int = FRAME) -> DataFrame:
    """s, a, j, t: source, its slots in a frame, and slot t of its j-th block, from rows (s, n).

    Weights are n^alpha, rounded to the frame with one slot for each source at
    least, unless they are given. There is a row for each slot of a frame.
    """
    if weights is not None:
        held = [r["s"] for r in sizes.where(F.col("s").isin(list(weights))).select("s").collect()] if weights else []
        shares, frame = stated_shares(weights, held)
        a = sizes.sparkSession.createDataFrame(list(shares.items()), "s string, a int")
        if not shares:
            return a.select("s", "a", F.lit(0).alias("j"), F.lit(0).alias("t"))
    else:
        w = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
        every = Window.partitionBy()
        q = w.withColumn("q", F.col("w") / F.sum("w").over(every) * (frame - F.count("*").over(every))).withColumn("b", F.floor("q"))
        rest = F.lit(frame) - F.count("*").over(every) - F.sum("b").over(every)
        rank = F.row_number().over(Window.orderBy(F.desc(F.col("q") - F.col("b")), "s"))
        a = q.withColumn("rest", rest).withColumn("r", rank).select("s", (1 + F.col("b") + F.when(F.col("r") <= F.col("rest"), 1).otherwise(0)).cast("int").alias("a"))
    one = a.agg(F.array_sort(F.collect_list(F.struct("s", "a"))).alias("x")).where("size(x) > 0")
    step = f"""aggregate(sequence(0, {frame} - 1),
      named_struct('done', transform(x, y -> 0), 'out', cast(array() as array<int>)),
      (st, t) -> aggregate(array(array_min(transform(filter(transform(x, (y, i) -> i),
            i -> st.done[i] < x[i].a and st.done[i] * {frame} div x[i].a <= t),
          i -> named_struct('due', -((-(st.done[i] + 1) * {frame}) div x[i].a) + if((st.done[i] + 1) * {frame} % x[i].a = 0, 0, 1), 'i', i)))),
        st, (u, m) -> named_struct('done', transform(u.done, (d, i) -> if(i = m.i, d + 1, d)), 'out', array_append(u.out, m.i))))"""
    slots = one.select("x", F.expr(step).getField("out").alias("out")).select("x", F.posexplode("out").alias("t", "i"))
    j = F.row_number().over(Window.partitionBy("i").orderBy("t")) - 1
    return slots.select(F.expr("x[i].s").alias("s"), F.expr("x[i].a").alias("a"), j.alias("j"), "t")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", alpha: float = ALPHA, weights: dict | None = None, block_rows: int = BLOCK_ROWS, frame: int = FRAME) -> DataFrame:
    """The columns of ``docs`` with _mix_slot, _mix_place (in the block) and _mix_on_target, which replace input columns of these names."""
    src, inner = apart(docs)
    key = F.md5(F.coalesce(F.col(inner[id_col]).cast("string"), F.lit("")))
    rows = src.withColumns({"s": F.coalesce(F.col(inner[source_col]).cast("string"), F.lit("")), "m": key}).withColumn("b", F.substring("m", 1, 3))
    counts = written(rows.groupBy("s", "b").agg(F.count("*").alias("n")), "sizes")
    sizes = counts.groupBy("s").agg(F.sum("n").alias("n"))
    plan = written(frame_of(sizes, alpha, weights, max(frame, 2 * sizes.count())), "frame")
    d = plan.count()
    # where each source's slots end: the slot of the first block that it lacks
    ends = sizes.join(plan, "s").where(F.ceil(F.col("n") / block_rows) % F.col("a") == F.col("j"))
    horizon = ends.agg(F.min(F.floor(F.ceil(F.col("n") / block_rows) / F.col("a")) * d + F.col("t"))).first()[0] or 0
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = small_side(counts.select("s", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from")))
    order = Window.partitionBy("s", "b").orderBy("m", inner[id_col])
    rows = rows.withColumn("r", F.row_number().over(order)).join(starts, ["s", "b"])
    rows = rows.withColumn("r", F.col("from") + F.col("r") - 1).withColumn("k", F.floor(F.col("r") / block_rows))
    shares = small_side(plan.select("s", "a").distinct())
    slots = small_side(plan.select("s", F.col("j").cast("long").alias("j"), "t"))
    rows = rows.join(shares, "s", "left").withColumn("j", F.col("k") % F.col("a")).join(slots, ["s", "j"], "left")
    slot = F.floor(F.col("k") / F.col("a")) * d + F.col("t")
    kept = [F.col(inner[c]).alias(c) for c in docs.columns if c not in ("_mix_slot", "_mix_place", "_mix_on_target")]
    place = F.when(slot.isNotNull(), (F.col("r") % block_rows).cast("int"))
    return rows.select(*kept, slot.cast("long").alias("_mix_slot"), place.alias("_mix_place"), F.coalesce(slot < horizon, F.lit(False)).alias("_mix_on_target"))


def op5(spark, sf_dir: str) -> DataFrame:
    out = mix(read_table(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("doc_id", "source", F.col("_mix_slot").alias("slot"), F.col("_mix_place").alias("place"), F.col("_mix_on_target").alias("on_target"))


ORACLE = """
WITH RECURSIVE sizes AS (
  SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1
), c AS (
  SELECT greatest(1024, 2 * count(*)) AS d, count(*) AS m, sum(pow(n, 0.5)) AS w FROM sizes
), q AS (
  SELECT s, n, pow(n, 0.5) / w * (d - m) AS q, floor(pow(n, 0.5) / w * (d - m)) AS b FROM sizes, c
), a AS (
  SELECT s, n, CAST(1 + b + CASE WHEN row_number() OVER (ORDER BY q - b DESC, s) <= (SELECT d - m FROM c) - (SELECT sum(b) FROM q) THEN 1 ELSE 0 END AS BIGINT) AS a FROM q
), x AS (
  SELECT list(s ORDER BY s) AS ss, list(a ORDER BY s) AS aa, (SELECT d FROM c) AS d FROM a
), f AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(aa, lambda y: CAST(0 AS BIGINT)) AS done, CAST(NULL AS BIGINT) AS pick FROM x
  UNION ALL
  SELECT t + 1, list_transform(done, lambda v, i: CASE WHEN i = p THEN v + 1 ELSE v END), p
  FROM (
    SELECT t, done, list_min(list_transform(
      list_filter(range(1, len(aa) + 1), lambda i: done[i] < aa[i] AND done[i] * d // aa[i] <= t),
      lambda i: {'due': (done[i] + 1) * d // aa[i] + CASE WHEN (done[i] + 1) * d % aa[i] = 0 THEN 0 ELSE 1 END, 'i': i})).i AS p
    FROM f, x WHERE t < d)
), frame AS (
  SELECT ss[pick] AS s, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j, t - 1 AS t FROM f, x WHERE pick IS NOT NULL
), h AS (
  SELECT min(CAST(ceil(n / 32.0) AS BIGINT) // a * (SELECT d FROM c) + t) AS h FROM a JOIN frame USING (s) WHERE CAST(ceil(n / 32.0) AS BIGINT) % a = j
), r AS (
  SELECT doc_id, source, coalesce(source, '') AS s,
    row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS r FROM documents
)
SELECT r.doc_id, r.source, CAST(r.r // 32 // a.a * (SELECT d FROM c) + frame.t AS BIGINT) AS slot, CAST(r.r % 32 AS INTEGER) AS place,
  r.r // 32 // a.a * (SELECT d FROM c) + frame.t < (SELECT h FROM h) AS on_target
FROM r JOIN a ON r.s = a.s JOIN frame ON frame.s = r.s AND frame.j = r.r // 32 % a.a
"""
