"""Operator 2, benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units that follow a number, and runs of capitalised words become the
placeholders <num>, <unit> and <name>; the other words are lower-cased and
punctuation goes. A word that starts a sentence is a placeholder too, as it may
be a name; words in capitals throughout are not. Windows of 8 template tokens (4 for items of
4 to 7) with at least 3 words that are not placeholders are hashed and joined
with those of the benchmark. A document leaks an item if on one alignment

* half of the item's windows that have 3 such words match, and reach over half
  of its tokens, or windows cover 20 of its tokens, and
* the slots agree: a value of the item always meets the same value of the
  document and the other way round. Equal values are a copy, other values are
  a re-parameterised question.

The benchmark's windows are broadcast behind a check of their number; texts
are not shuffled in the search.

Contract cases: null and empty texts and items leak nothing, nor do items of
under 4 tokens; repeated items are reported by each of their ids, repeated ids
with different texts count as that id; rows that repeat an id with another
text are judged on their own text; an empty benchmark leaks nothing; other
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, read_table, small_side, written

WINDOW = 8
COVERAGE = 0.5
TOKENS = 20
LITERALS = 3
# Unit names.
UNITS = "kg|km|cm|mm|mg|ml|m|g|l|s|h|min|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|ft|inch(?:es)?|meters?|metres?|grams?|lit(?:er|re)s?|dollars?|euros?|cents?|percent|%|°C|°F|kW|kWh|W|V|A|Hz|GB|MB|KB"
# possessive, so that Java neither goes back in a run nor nests a call for each of its parts
NUMBER = r"[0-9]++(?:[.,:/][0-9]++)*+"
# a number is tried from its start only, not from each of its digits
MEASURE = rf"((?<![0-9])(?<![0-9][.,:/]){NUMBER})[ ]?({UNITS})([^\p{{L}}\p{{N}}]|$)"
_REST = r"(?:[\p{L}'\-&&[^\p{Ll}]]*+\p{Ll}[\p{L}'\-]*+)?+(?![\p{L}\p{N}])"
NAME = rf"(\p{{Lu}}(?<![\p{{L}}\p{{N}}]\p{{Lu}})(?<![0-9] \p{{Lu}}){_REST}(?: \p{{Lu}}{_REST})*+)"


def template(text: Column) -> Column:
    """Template tokens of a text."""
    t = F.regexp_replace(text, NAME, "<name>")
    t = F.regexp_replace(t, MEASURE, "<num> <unit>$3")
    t = F.lower(F.regexp_replace(t, NUMBER, "<num>"))
    return F.array_remove(F.split(t, r"[^\p{L}\p{N}<>]+"), "")


def _join(h: Column, by: int) -> Column:
    """Hashes of runs twice as long, from hashes of runs of ``by`` tokens; the last ``by`` ones stand for shorter runs."""
    return F.zip_with(h, F.slice(h, F.lit(by + 1), F.lit(1 << 30)), lambda a, b: F.xxhash64(a, b))


def windows(df: DataFrame, length: int) -> DataFrame:
    """Adds w: hashes of the windows of ``length`` (4 or 8) tokens of column toks.

    The last length - 1 entries stand for shorter runs at the end of the text.
    """
    df = df.withColumn("w", F.transform("toks", lambda x: F.xxhash64(x)))
    by = 1
    while by < length:
        df = df.withColumn("w", _join(F.col("w"), by))
        by *= 2
    return df


KINDS = ("num", "unit", "name")


def _count(tokens: Column, kind: str) -> Column:
    """How many placeholders of a kind an array of tokens has."""
    return F.size(F.filter(tokens, lambda x: x == f"<{kind}>"))


def _region(toks: str, start: Column, n: Column, side: str) -> dict[str, Column]:
    """n tokens from start, and how many placeholders of each kind stand before them."""
    head = F.slice(toks, F.lit(1), start)
    return {f"{side}_part": F.slice(toks, start + 1, n)} | {f"{side}_{k}_at": _count(head, k) for k in KINDS}


def _slots(side: str) -> Column:
    """The value of each placeholder of a region, null for words."""
    part = F.col(f"{side}_part")

    def value(x: Column, i: Column) -> Column:
        upto = F.slice(part, F.lit(1), i + 1)
        out = F.lit(None).cast("string")
        for k in KINDS:
            out = F.when(x == f"<{k}>", F.get(F.col(f"{side}_{k}s"), F.col(f"{side}_{k}_at") + _count(upto, k) - 1)).otherwise(out)
        return out

    return F.transform(part, value)


def _values(text: Column) -> dict[str, Column]:
    bare = F.regexp_replace(text, NAME, "")
    return {"nums": F.regexp_extract_all(bare, F.lit(f"({NUMBER})"), F.lit(1)), "units": F.regexp_extract_all(bare, F.lit(MEASURE), F.lit(2)), "names": F.regexp_extract_all(text, F.lit(NAME), F.lit(1))}


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """d, h (hash of the text), item: the items that each document leaks."""
    src = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).where("text is not null")
    items = bench.select(F.col(item_col).alias("item"), F.col(item_text).alias("itext")).where("itext is not null").distinct()
    items = items.withColumn("toks", template(F.col("itext"))).withColumn("ih", F.xxhash64("itext")).where(F.size("toks") >= 4)
    items = written(items, "items")
    hits = None
    for length, those in ((WINDOW, F.size("toks") >= WINDOW), (4, F.size("toks") < WINDOW)):
        own = items.where(those)
        if not own.limit(1).count():
            continue
        full = F.size("toks") - length + 1
        marks = windows(own, length).select("item", "ih", F.size("toks").alias("size"), full.alias("full"), "toks", F.posexplode("w").alias("ip", "w")).where("ip < full")
        words = F.size(F.filter(F.slice("toks", F.col("ip") + 1, F.lit(length)), lambda x: ~x.isin("<num>", "<unit>", "<name>")))
        marks = written(marks.where(words >= LITERALS).select("item", "ih", "size", "ip", "w"), "marks")
        marks = small_side(marks.withColumn("windows", F.count("*").over(Window.partitionBy("item", "ih"))))
        # the outer form, as for the inner one the optimiser would work out the windows once more to test for emptiness
        seen = windows(src.select("d", "h", template(F.col("text")).alias("toks")), length).select("d", "h", F.posexplode_outer("w").alias("p", "w"))
        found = seen.join(marks, "w").groupBy("d", "h", "item", "ih", "windows", "size", (F.col("p") - F.col("ip")).alias("shift"))
        found = found.agg(F.countDistinct("ip").alias("n"), F.min("ip").alias("lo"), F.max("ip").alias("hi")).withColumn("length", F.lit(length))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return src.select("d", "h", F.lit(None).cast(dict(bench.dtypes)[item_col]).alias("item")).where(F.lit(False))
    reach = F.col("hi") - F.col("lo") + F.col("length")
    half = (F.col("n") >= COVERAGE * F.col("windows")) & (reach >= COVERAGE * F.col("size"))
    hits = written(hits.where(half | (F.col("n") + F.col("length") - 1 >= TOKENS)), "hits")
    few = small_side(hits.select(F.col("d").alias("hd"), F.col("h").alias("hh")).distinct())
    texts = src.join(few, src["d"].eqNullSafe(few["hd"]) & (src["h"] == few["hh"]), "left_semi").distinct()
    texts = texts.select(F.col("d").alias("td"), F.col("h").alias("th"), template(F.col("text")).alias("dtoks"), *[c.alias(f"d_{n}") for n, c in _values(F.col("text")).items()])
    given = items.select(F.col("item").alias("gi"), F.col("ih").alias("gh"), F.col("toks").alias("itoks"), *[c.alias(f"i_{n}") for n, c in _values(F.col("itext")).items()])
    rows = hits.join(texts, hits["d"].eqNullSafe(texts["td"]) & (hits["h"] == texts["th"])).join(given, hits["item"].eqNullSafe(F.col("gi")) & (F.col("ih") == F.col("gh")))
    # written, as the regions' columns are read many times below and must not be worked out each time
    rows = written(rows.withColumns(_region("itoks", F.col("lo"), reach, "i") | _region("dtoks", F.col("lo") + F.col("shift"), reach, "d")).drop("itoks", "dtoks"), "regions")
    rows = rows.withColumn("a", _slots("i")).withColumn("b", _slots("d"))
    met = F.array_distinct(F.filter(F.arrays_zip("a", "b"), lambda x: x["a"].isNotNull() & x["b"].isNotNull()))
    rows = rows.withColumn("met", met)
    side = lambda c: F.size(F.array_distinct(F.transform("met", lambda x: x[c])))
    return rows.where((side("a") == F.size("met")) & (side("b") == F.size("met"))).select("d", "h", "item").distinct()


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` and _lm_items, the sorted ids of the items that the row leaks (null: none).

    A column of the input that is called _lm_items is replaced.
    """
    src, inner = apart(docs)
    found = written(leaks(src, bench, inner[id_col], inner[text_col]), "leaks").groupBy("d", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = src.join(small_side(found), F.col(inner[id_col]).eqNullSafe(F.col("d")) & (F.xxhash64(inner[text_col]) == F.col("h")), "left")
    return out.select(*[F.col(inner[c]).alias(c) for c in docs.columns if c != "_lm_items"], F.col("items").alias("_lm_items"))


def op2(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.col("_lm_items").isNotNull().alias("contaminated"), F.coalesce(F.array_join(F.col("_lm_items").cast("array<string>"), ","), F.lit("")).alias("items"))
