"""Operator 4, line dedup: an exact set-similarity join of lines, in DataFrame functions only.

A line is the set of its words ``[^\\x20\\x09-\\x0D]+``. It is removed if an
earlier line (by document id, then line number) has Jaccard similarity of
``threshold`` or more with it; whether that line itself stays is of no matter.

1. Equal lines are counted by a 128-bit hash with a map-side combine; all but
   the first go, and one line of each kind is left for the join.
2. The words of a line are ordered by rarity: a class from the counts of
   hashed words over the whole table, then the word's hash. Lines that reach
   the threshold share a word in their prefixes: n - ceil(t * n) + 1 words of
   the longer line, and n - ceil(2t / (1 + t) * n) + 1 of the shorter. Words
   that stand in one prefix only are dropped.
3. Rounds settle groups of near copies: open lines are held against one of
   ``SHARE`` ** k earlier lines, drawn by a hash, with k one less each time. A
   line with many near copies before it meets one of them and is closed, so
   that about ``SHARE`` / e pairs of a line with near copies are left for the
   next round.
4. Lines that are still open meet all earlier lines of their groups.

Every pair passes the length filter, the positional filter and a parity filter
(the parities of the hashed words differ in at most as many bits as the sets
differ in words) before it is verified on the words themselves.

Contract cases: null texts are kept as they are; lines without a word are
always kept; rows that repeat both id and text are one document, so a line is
removed from all of them or from none; rows that repeat an id with another
text are ordered by the text's hash; null ids come first; an empty table gives
an empty result; other columns pass through, also those whose names clash with
the ones used here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, bucketed, drop_written, read_table, small_rows, small_side, written

THRESHOLD = 0.8
#: Buckets of hashed words in the table of rarity classes.
BUCKETS = 1 << 15
#: Lines of more words have 256 parities, others 64.
LONG = 64
LONG_BITS = ("b1", "b2", "b3")
#: One of how many earlier lines, of those that the next round takes, a round takes.
SHARE = 32
#: Postings for each pair that the next round would make, from which on this one is not verified.
FEW = 32
#: Most postings in a bucket for which the join of all pairs holds a side in memory.
HASHED = 1_500_000
#: Bytes of text for each bucket of the postings, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 100_000
GAP = r"[\x20\x09-\x0D]+"
AT = ("d", "h", "i")


def pieces(line: str) -> Column:
    """The words of a line and empty strings: split at blanks, which needs no pattern, where there is no other white space."""
    other = F.lit(False)
    for c in "\t\x0b\x0c\r":
        other = other | F.contains(line, F.lit(c))
    return F.when(other, F.split(line, GAP)).otherwise(F.split(line, " "))


def _lines(docs: DataFrame, *more: str) -> DataFrame:
    """d, h (hash of the text, or 0 where ids are unique), i, line; one row per line with a word.

    Arrays are exploded in the outer form here and below: for the inner one
    the optimiser works out the array once more to test for emptiness.
    """
    rows = docs.select(F.col("_lm_id").alias("d"), F.col("_lm_h").alias("h"), *more, F.posexplode_outer(F.split("_lm_text", "\n")).alias("i", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def rarity_classes(docs: DataFrame) -> Column:
    """An array of ``BUCKETS`` classes, in the top byte: the count of a bucket of hashed words over all texts, on a log scale.

    The table has the same size whatever the data.
    """
    word = docs.select(F.replace("_lm_text", F.lit("\n"), F.lit(" ")).alias("text")).select(F.explode_outer(pieces("text")).alias("w"))
    counts = word.groupBy(F.xxhash64("w").bitwiseAND(BUCKETS - 1).cast("int").alias("b")).agg(F.count("w").alias("n"))
    table = ["0"] * BUCKETS
    for b, n in counts.collect():
        table[b] = str(min(120, 1 + int(3 * math.log2(n))) << 56) if n else "0"
    return F.split(F.lit(",".join(table)), ",").cast("array<bigint>")


def _equal_lines(docs: DataFrame) -> DataFrame:
    """d, h, i of lines that an earlier line equals."""
    rows = _lines(docs).select(*AT, F.xxhash64("line").alias("k"), F.xxhash64(F.lit(1), "line").alias("k2"))
    kinds = rows.groupBy("k", "k2").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    rows = written(rows.join(small_side(written(kinds, "line_kinds")), ["k", "k2"]), "repeated_lines")
    first = rows.groupBy("k", "k2").agg(F.min(F.struct(*AT)).alias("x"))
    return rows.join(small_side(first), ["k", "k2"]).where(F.struct(*AT) > F.col("x")).select(*AT).distinct()


def _postings(docs: DataFrame, equal: DataFrame, threshold: float) -> DataFrame:
    """A row for each word of a line's prefix: w, d, h, i, np (n words and position p from 0), a (parities), b (b1 to b3: those of three quarters of the words, null for short lines), without the ``equal`` lines.

    Few columns spare shuffle. w is cut to 31 bits to spare shuffle; words that then fall together give
    candidates which the filters and the verification refuse.
    """
    marks = small_rows(equal.groupBy(F.col("d").alias("md"), F.col("h").alias("mh")).agg(F.collect_set("i").alias("skip")), "skip")
    src = docs.join(marks, docs["_lm_id"].eqNullSafe(marks["md"]) & (docs["_lm_h"] == marks["mh"]), "left").select("_lm_id", "_lm_h", "_lm_text", "skip")
    rows = _lines(src, "skip").where("skip is null or not array_contains(skip, i)")
    table = rarity_classes(docs)
    hashes = F.array_distinct(F.transform(F.array_remove(pieces("line"), ""), lambda w: F.xxhash64(w)))
    # an array without nulls is sorted as numbers
    code = F.transform(hashes, lambda h: F.coalesce(table[h.bitwiseAND(BUCKETS - 1)], F.lit(0).cast("long")).bitwiseOR(F.shiftrightunsigned(h, 8)))
    rows = rows.select(*AT, F.sort_array(code).alias("c"))
    n = F.size("c")
    b = F.when(n > LONG, F.struct(*[_parities(q).alias(f"b{q}") for q in (1, 2, 3)]))
    rows = rows.select(*AT, n.cast("int").alias("n"), _parities().alias("a"), b.alias("b"), F.slice("c", F.lit(1), (n - F.ceil(threshold * n - 1e-9) + 1).cast("int")).alias("c"))
    rows = rows.select(*AT, "n", "a", "b", F.posexplode_outer("c").alias("p", "c"))
    np = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("p").cast("long"))
    return rows.select(F.shiftrightunsigned("c", 12).bitwiseAND(0x7FFFFFFF).cast("int").alias("w"), *AT, np.alias("np"), "a", "b")


def _parities(quarter: int | None = None) -> Column:
    """The parities of the hashed words c, of all or of a quarter of them.

    The bits are looked up, as functions of lambdas are interpreted, and a
    table takes fewer of them.
    """
    bits = [1 << i % 64 if quarter in (None, i // 64) else 0 for i in range(256 if quarter else 64)]
    table = F.split(F.lit(",".join(str(x - (x >> 63 << 64)) for x in bits)), ",").cast("array<bigint>")
    return F.aggregate("c", F.lit(0).cast("long"), lambda x, c: x.bitwiseXOR(table[c.bitwiseAND(len(bits) - 1)]))


def shuffled_once(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` in ``n`` partitions by a key, such that several uses in one plan share the shuffle.

    The filter is not deterministic, as filters and projections of one use
    would else go below the shuffle and make it another one.
    """
    df = df.repartition(n, key)
    return df.where(F.when(F.monotonically_increasing_id() >= 0, F.lit(True)).otherwise(F.hash(*df.columns) > 0))


@contextmanager
def kept_partitioning(spark: SparkSession) -> Iterator[None]:
    """Joins on a word and a level take rows that are partitioned by the word alone as they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _buckets(docs: DataFrame) -> int:
    """Buckets of the postings: the shuffle partitions of the session, and more for many bytes of text."""
    size = docs.agg(F.sum(F.octet_length("_lm_text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, size // BUCKET_BYTES))


def _shared(posts: DataFrame, n: int, threshold: float) -> DataFrame:
    """The postings of words that stand in another prefix too, of a line of about the same length; ``n`` partitions by w."""
    posts = shuffled_once(posts, "w", n)
    words, place = F.shiftright("np", 32).cast("int"), F.col("np").bitwiseAND(0x7FFFFFFF).cast("int")
    level = F.least(F.lit(61), F.floor(F.log(words.cast("double")) / -math.log(threshold) + 1e-9)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    masks = posts.select("w", level.alias("level")).groupBy("w").agg(F.bit_or(one).alias("any"), F.count("*").alias("c")).where("c > 1")
    # a level counts as shared by two if any level of the word is
    own = F.when(F.col("c") > F.bit_count("any"), F.col("any")).otherwise(0)
    masks = masks.select(F.col("w").alias("mw"), own.bitwiseOR(F.shiftleft("any", 1)).bitwiseOR(F.shiftrightunsigned("any", 1)).alias("bits"))
    posts = posts.join(masks.hint("shuffle_hash"), F.col("w") == F.col("mw")).withColumn("level", level).where(F.col("bits").bitwiseAND(one) != 0)
    return posts.select("w", *AT, words.alias("n"), place.alias("p"), "a", *[F.col(f"b.{c}").alias(c) for c in LONG_BITS], "level")


def _near(threshold: float) -> Column:
    """Whether lines y and x, which share a word, pass the length, positional and parity filters."""
    total = F.col("y.n") + F.col("x.n")
    most = total - 2 * F.ceil(threshold / (1 + threshold) * total - 1e-9)
    # at the first word that two lines share, all words before it differ, and the rests differ by their lengths at least
    apart = F.col("y.p") + F.col("x.p") + F.abs((F.col("y.n") - F.col("y.p")) - (F.col("x.n") - F.col("x.p")))
    parts = {c: F.col(f"y.{c}").bitwiseXOR(F.col(f"x.{c}")) for c in ("a", *LONG_BITS)}
    whole = F.bit_count(parts["a"]) <= most
    first = parts["a"].bitwiseXOR(parts["b1"]).bitwiseXOR(parts["b2"]).bitwiseXOR(parts["b3"])
    quarters = F.bit_count(first) + F.bit_count(parts["b1"]) + F.bit_count(parts["b2"]) + F.bit_count(parts["b3"])
    length = F.least("y.n", "x.n") >= threshold * F.greatest("y.n", "x.n") - 1e-9
    return whole & length & (apart <= most) & ((F.least("y.n", "x.n") <= LONG) | (quarters <= most))


def _at(p: str) -> Column:
    return F.struct(*[F.col(f"{p}.{c}") for c in AT])


def _verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """d, h, i of the later lines of the pairs (d, h, i, xd, xh, xi) that reach the threshold."""
    pairs = written(pairs.distinct(), "line_pairs")
    wanted = pairs.select(*AT).union(pairs.select("xd", "xh", "xi")).distinct()
    wanted = written(wanted.select(*[F.col(c).alias(f"w{c}") for c in AT]), "wanted")
    held = wanted.select("wd", "wh").distinct()
    src = docs.join(small_side(held), docs["_lm_id"].eqNullSafe(F.col("wd")) & (F.col("_lm_h") == F.col("wh")), "left_semi")
    same = lambda p, q: F.col(f"{p}d").eqNullSafe(F.col(f"{q}d")) & (F.col(f"{p}h") == F.col(f"{q}h")) & (F.col(f"{p}i") == F.col(f"{q}i"))
    lines = _lines(src).join(small_side(wanted), same("", "w"), "left_semi").dropDuplicates(AT)
    lines = written(lines.select(*AT, F.array_remove(F.array_distinct(pieces("line")), "").alias("words")), "wanted_lines")
    side = lambda p, c: lines.select(*[F.col(x).alias(p + x) for x in AT], F.col("words").alias(c))
    pairs = pairs.join(side("k", "a"), same("", "k")).join(side("l", "b"), same("x", "l"))
    enough = F.size(F.array_intersect("a", "b")) >= threshold / (1 + threshold) * (F.size("a") + F.size("b")) - 1e-9
    return pairs.where(enough).select(*AT).distinct()


def _inner(s: str, threshold: float) -> Column:
    """Whether a posting is among those that the shorter line of a pair needs."""
    return F.col(f"{s}.p") < F.col(f"{s}.n") - F.ceil(2 * threshold / (1 + threshold) * F.col(f"{s}.n") - 1e-9) + 1


def _some_pairs(posts: DataFrame, rate: int, threshold: float) -> DataFrame:
    """Pairs of an open line y and an earlier line x, for one of ``rate`` lines x, drawn by a hash."""
    x = posts.where(F.pmod(F.xxhash64(F.lit(rate), *AT), F.lit(rate)) == 0)
    x = x.withColumn("level", F.explode(F.array_distinct(F.array(F.col("level") - 1, F.col("level"), F.least(F.lit(61), F.col("level") + 1))))).hint("shuffle_hash").alias("x")
    shorter = F.when(F.col("x.n") <= F.col("y.n"), _inner("x", threshold)).otherwise(_inner("y", threshold))
    rows = posts.where("open").alias("y").join(x, (F.col("y.w") == F.col("x.w")) & (F.col("y.level") == F.col("x.level")) & (_at("x") < _at("y")) & shorter & _near(threshold))
    return rows.select(*[F.col(f"y.{c}") for c in AT], *[F.col(f"x.{c}").alias(f"x{c}") for c in AT])


def _all_pairs(posts: DataFrame, threshold: float, hashed: bool = False) -> DataFrame:
    """Pairs of an open line and an earlier line that share a posting and pass the filters.

    The longer line y of a pair meets the shorter line x; a shorter line needs
    only its first n - ceil(2t / (1 + t) * n) + 1 words for that. Lines meet
    the shorter ones of their own level of length and of the level below.
    """
    y = posts.alias("y")
    x = posts.alias("x").where(_inner("x", threshold)).withColumn("level", F.explode(F.array_distinct(F.array(F.col("level"), F.least(F.lit(61), F.col("level") + 1)))))
    x = (x.hint("shuffle_hash") if hashed else x).alias("x")
    first = _at("x") < _at("y")
    turn = (F.col("x.n") < F.col("y.n")) & F.when(first, F.col("y.open")).otherwise(F.col("x.open")) | (F.col("x.n") == F.col("y.n")) & first & F.col("y.open")
    rows = y.join(x, (F.col("y.w") == F.col("x.w")) & (F.col("y.level") == F.col("x.level")) & (F.col("x.n") <= F.col("y.n")) & _near(threshold) & turn)
    ends = [F.when(first, F.col(f"{s}.{c}")).otherwise(F.col(f"{o}.{c}")).alias(n + c) for s, o, n in (("y", "x", ""), ("x", "y", "x")) for c in AT]
    return rows.select(*ends)


def _rounds(rows: int) -> int:
    """Rounds before that of all pairs: two, and one more for each ``SHARE`` times 2^25 postings."""
    return 2 + max(0, math.ceil(math.log(max(rows, 1) / (1 << 25), SHARE)))


def _close(posts: DataFrame, closed: DataFrame) -> DataFrame:
    """The postings with ``open``: whether their line is not among the closed ones."""
    shut = small_side(closed.select(*[F.col(c).alias(f"c{c}") for c in AT]).withColumn("shut", F.lit(True)))
    hit = F.col("d").eqNullSafe(F.col("cd")) & (F.col("h") == F.col("ch")) & (F.col("i") == F.col("ci"))
    return posts.join(shut, hit, "left").withColumn("open", F.col("shut").isNull()).drop("cd", "ch", "ci", "shut")


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """d, h, i of the lines to remove, from columns _lm_id, _lm_h and _lm_text."""
    equal = written(_equal_lines(docs), "equal_lines")
    n = _buckets(docs)
    every = bucketed(_shared(_postings(docs, equal, threshold), n, threshold), "w", n, "postings", ordered=True)
    posts, closed = every.withColumn("open", F.lit(True)), None
    buckets = every.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("c")).agg(F.sum("c").alias("rows"), F.max("c").alias("most")).na.fill(0).first()
    with kept_partitioning(docs.sparkSession):
        rates = [SHARE**k for k in range(_rounds(buckets["rows"]), -1, -1)]
        for rate, then in zip(rates, rates[1:], strict=False):
            some = written(_some_pairs(posts, rate, threshold), "some_pairs")
            if some.count() * rate / then > buckets["rows"] / FEW:
                new = written(_verified(some, docs, threshold), "closed")
                closed = new if closed is None else closed.unionByName(new)
                posts = _close(every, closed)
            drop_written(some)
        pairs = written(_all_pairs(posts, threshold, buckets["most"] <= HASHED), "all_pairs")
    rest = _verified(pairs, docs, threshold)
    return (equal if closed is None else equal.unionByName(closed)).unionByName(rest).distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``docs``, the text without removed lines, and _lm_removed (array of line numbers from 0).

    A column of the input that is called _lm_removed is replaced.
    """
    src, inner = apart(docs)
    lm = src.select(F.col(inner[id_col]).alias("_lm_id"), F.col(inner[text_col]).alias("_lm_text"))
    again = lm.groupBy("_lm_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    h = F.xxhash64(inner[text_col]) if again else F.lit(0).cast("long")
    lm = lm.withColumn("_lm_h", F.xxhash64("_lm_text")).dropDuplicates(["_lm_id", "_lm_h"]) if again else lm.withColumn("_lm_h", h)
    gone = written(removed_lines(lm, threshold), "removed").groupBy("d", "h").agg(F.array_sort(F.collect_set("i")).alias("removed"))
    gone = small_rows(gone, "removed")
    text = F.col(inner[text_col])
    out = src.join(gone, F.col(inner[id_col]).eqNullSafe(F.col("d")) & (h == F.col("h")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    kept = F.when(F.col("removed").isNull(), text).otherwise(kept)
    cols = [(kept if c == text_col else F.col(inner[c])).alias(c) for c in docs.columns if c != "_lm_removed"]
    return out.select(*cols, F.coalesce("removed", F.array().cast("array<int>")).alias("_lm_removed"))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", F.size("_lm_removed").cast("long").alias("n_removed"), F.array_join(F.col("_lm_removed").cast("array<string>"), ",").alias("removed_lines"), F.sha2("text", 256).alias("kept_sha256"))
