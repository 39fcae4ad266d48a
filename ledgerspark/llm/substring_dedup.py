"""Operator 3, substring dedup: seed and extend on winnowed anchors.

A passage of at least ``min_words`` words that occurs at two places shares a
winnowed anchor at the same offset in both (Schleimer, Wilkerson, Aiken 2003:
shingles of k words and windows of w shingles with k + w - 1 = min_words).
Every window of ``min_words`` words therefore belongs to exactly one anchor,
and equal windows belong to equal anchors.

* Seed: texts become rows (anchor, extent), where the extent is the anchor
  extended both ways to the ends of all windows that belong to it.
* Equal extents are counted with a map-side combine, so a group of copies of
  any size is one row per extent; all their windows are repeats.
* Where one anchor has several different extents (the ends of a passage, an
  edited word), one place per distinct extent is extended word by word: its
  windows are counted. No pairs of places are ever made.

Contract cases: null texts have no words; texts below ``min_words`` lose
nothing; the very same text in two rows loses every word in both if it is
long enough; repeated rows are rows like any other; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_bytes, chunks, drop_written, read_table, run_hash, written

MIN_WORDS = 35
SHINGLE = 8


def _last_min(s: np.ndarray, w: int) -> np.ndarray:
    """Index of the rightmost minimum of each window of w values."""
    m, p, have = s, np.arange(len(s)), 1
    while have < w:
        d = min(have, w - have)
        a, b = m[: len(m) - d], m[d:]
        right = b <= a
        m, p, have = np.where(right, b, a), np.where(right, p[d:], p[: len(p) - d]), have + d
    return p


def owners(w: Words, min_words: int, shingle: int):
    """Runs of windows that share an anchor: row, first window, windows, anchor hash, extent hash."""
    n = len(w.hash)
    if n < min_words:
        return None
    q = w.runs()
    s = run_hash(q, np.arange(n - shingle + 1), np.arange(shingle, n + 1))
    a = _last_min(s, min_words - shingle + 1)
    i = np.flatnonzero(w.row[: len(a)] == w.row[min_words - 1 :])
    if not len(i):
        return None
    a, r = a[i], w.row[i]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1])])
    count = np.diff(np.r_[new, len(i)])
    start = i[new]
    extent = run_hash(q, start, start + count - 1 + min_words)
    return r[new], start - w.first[r[new]], count, s[a[new]], extent


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _seeds(min_words: int, shingle: int):
    def run(batches):
        for b in batches:
            buf, offs = arrow_bytes(b.column("text"))
            for lo, hi in chunks(offs):
                w = Words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1])
                found = owners(w, min_words, shingle)
                if found is None:
                    continue
                row, first, count, anchor, extent = found
                at = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(at), b.column("th").take(at), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), _signed(anchor), _signed(extent)],
                    names=["doc_id", "th", "first", "n", "anchor", "extent"],
                )

    return run


def _windows(min_words: int, shingle: int):
    """Windows of the asked places, by recomputing their owners."""

    def run(batches):
        for b in batches:
            buf, offs = arrow_bytes(b.column("text"))
            asked = b.column("asked").to_pylist()
            for lo, hi in chunks(offs):
                w = Words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1])
                q = w.runs()
                row, first, n, anchor, single = [], [], [], [], []
                for r in range(lo, hi):
                    for x in asked[r]:
                        row.append(r - lo), first.append(x["first"]), n.append(x["n"]), anchor.append(x["anchor"]), single.append(x["single"])
                if not row:
                    continue
                row, n, k = np.array(row), np.array(n), np.arange(sum(n))
                at = np.repeat(np.arange(len(n)), n)
                off = np.array(first)[at] + k - np.r_[0, np.cumsum(n)[:-1]][at]
                start = w.first[row[at]] + off
                who = pa.array(row[at] + lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(who), b.column("th").take(who), pa.array(off.astype(np.int32)), pa.array(np.array(anchor, np.int64)[at]), _signed(run_hash(q, start, start + min_words)), pa.array(np.array(single)[at])],
                    names=["doc_id", "th", "first", "anchor", "window", "single"],
                )

    return run


def _kept(min_words: int):
    def run(batches):
        for b in batches:
            texts, spans = b.column("text"), b.column("spans")
            ids, nw, nr, kept, cut = b.column("doc_id"), [], [], [], []
            for t, sp in zip(texts, spans, strict=True):
                words = (t.as_py() or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int32)
                for x in sp.as_py() or ():
                    gone[x["first"]] += 1
                    gone[x["first"] + x["n"] - 1 + min_words] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                cut.append([{"first_word": int(x), "n_words": int(y - x)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                nw.append(len(words))
                nr.append(int(gone.sum()))
                kept.append(b" ".join(x for x, g in zip(words, gone, strict=True) if not g).decode() if nr[-1] else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(nw, pa.int64()), pa.array(nr, pa.int64()), pa.array(kept, pa.string()), pa.array(cut, pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32())])))],
                names=["doc_id", "n_words", "n_removed", "kept_text", "removed_spans"],
            )

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text, removed_spans.

    Where ids repeat, rows are told apart by (id, hash of the text), so rows
    that repeat an id with another text keep their own spans.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    again = src.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    src = src.withColumn("th", F.xxhash64("text") if again else F.lit(0).cast("long"))
    kind = f"doc_id {dict(src.dtypes)['doc_id']}, th long, "
    seeds = written(src.mapInArrow(_seeds(min_words, shingle), kind + "first int, n int, anchor long, extent long"), "seeds")
    place = F.xxhash64("doc_id", "th", "first")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])

    # plans in functions of their own, as shuffle files stay as long as a frame of their plan has a name
    def marked() -> DataFrame:
        extents = seeds.groupBy("anchor", "extent").agg(F.count("*").alias("places"), F.min(place).alias("rep"))
        anchors = extents.groupBy("anchor").agg(F.sum("places").alias("total"), F.count("*").alias("kinds")).where("total >= 2")
        all_marks = seeds.join(extents.join(anchors, "anchor"), ["anchor", "extent"])
        all_marks = all_marks.withColumn("full", F.col("places") >= 2).withColumn("ask", (F.col("kinds") >= 2) & (place == F.col("rep")))
        return all_marks.where("full or ask").select("doc_id", "th", "first", "n", "anchor", "full", "ask")

    marks = written(marked(), "marks")
    drop_written(seeds)

    def asked_windows() -> DataFrame:
        asked = marks.where("ask").groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "n", "anchor", (~F.col("full")).alias("single"))).alias("asked"))
        held = src.join(asked, same(src, asked)).select(src["doc_id"], src["th"], "text", "asked")
        return held.mapInArrow(_windows(min_words, shingle), kind + "first int, anchor long, window long, single boolean")

    wins = written(asked_windows(), "windows")
    # two different places, as a row that repeats another's id and text asks for the same place again
    twice = wins.groupBy("anchor", "window").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("anchor", "window")
    part = wins.where("single").join(twice, ["anchor", "window"], "left_semi").select("doc_id", "th", "first", F.lit(1).alias("n"))
    spans = (
        marks.where("full").select("doc_id", "th", "first", "n").unionByName(part)
        .groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    )
    out = src.join(spans, same(src, spans), "left").select(src["doc_id"], "text", "spans")
    return out.mapInArrow(_kept(min_words), f"doc_id {dict(src.dtypes)['doc_id']}, n_words long, n_removed long, kept_text string, removed_spans array<struct<first_word:int,n_words:int>>")


def op3(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE = """
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), p AS (
  SELECT r, i, array_to_string(ws[i:i+34], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 33, 1))) AS t(i) WHERE len(ws) >= 35
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS c FROM p) WHERE c > 1
), gone AS (
  SELECT DISTINCT r, i + k AS i FROM twice, unnest(range(0, 35)) AS t(k)
), words AS (
  SELECT r, i, ws[i] AS x FROM w, unnest(range(1, len(ws) + 1)) AS t(i)
), kept AS (
  SELECT words.r, string_agg(words.x, ' ' ORDER BY words.i) AS k, count(*) AS n
  FROM words LEFT JOIN gone ON words.r = gone.r AND words.i = gone.i WHERE gone.i IS NULL GROUP BY words.r
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.r = kept.r
"""
