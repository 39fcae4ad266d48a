"""Operator 7, language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (hash buckets x languages) is fitted on a bounded
sample of labelled texts and broadcast; its size is fixed by ``BUCKETS`` and
the number of language codes. Texts are scored in numpy batches: one gather
from the matrix per n-gram and a segmented sum per text.

Contract cases: null texts and texts without a letter are ``und`` with score
0; ties go to the language that sorts first; if nothing can be learned every
text is ``und``; a null id is never held out and never learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, read_table, small_side

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
ALPHA = 0.1
#: Labelled texts to learn from, per language.
SAMPLE_PER_LANG = 4000

_alpha: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _alpha


def points(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, one after the other, and their offsets."""
    raw = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
    offs = np.r_[0, np.cumsum([len(x) // 4 for x in raw])].astype(np.int64)
    return np.frombuffer(b"".join(raw), np.uint32), offs


def grams(cp: np.ndarray, offs: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram that lies in one text, and offsets by text."""
    m = len(cp) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    h = np.full(m, n, np.uint32)
    for i in range(n):
        h = (h ^ cp[i : i + m]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    b = (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - int(buckets).bit_length() + 1)
    count = np.maximum(np.diff(offs) - n + 1, 0)
    if n > 1:
        ok = np.ones(m, bool)
        for e in offs[1:-1]:
            ok[max(0, e - n + 1) : e] = False
        b = b[ok]
    return b, np.r_[0, np.cumsum(count)]


def segment_sum(x: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of the runs offs[i]:offs[i+1] of the rows of x; empty runs are 0."""
    out = np.zeros((len(offs) - 1, *x.shape[1:]))
    full = np.flatnonzero(np.diff(offs) > 0)
    if len(full):
        out[full] = np.add.reduceat(x, offs[:-1][full], axis=0)
    return out


def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, texts) runs of about ``limit`` characters."""
    run, first, size = [], 0, 0
    for i, t in enumerate(col):
        t = t.as_py()
        if run and size + len(t or "") > limit:
            yield first, run
            run, first, size = [], i, 0
        run.append(t)
        size += len(t or "")
    if run:
        yield first, run


def _counts(buckets: int):
    def run(batches):
        total: dict = {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            for first, texts in text_chunks(b.column("text")):
                own = np.array(langs[first : first + len(texts)])
                cp, offs = points(texts)
                for n in ORDERS:
                    g, at = grams(cp, offs, n, buckets)
                    who = np.repeat(np.arange(len(texts)), np.diff(at))
                    for lang in np.unique(own):
                        x = np.bincount(g[(own == lang)[who]], minlength=buckets)
                        total[lang] = total.get(lang, 0) + x
        for lang, x in total.items():
            i = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(i)), pa.array(i.astype(np.int32)), pa.array(x[i].astype(np.int64))], names=["lang", "bucket", "c"])

    return run


def fit(labelled: DataFrame, buckets: int = BUCKETS, sample_per_lang: int = SAMPLE_PER_LANG) -> tuple[list, np.ndarray, np.ndarray]:
    """(languages, log-probabilities buckets x languages, log priors) from columns doc_id, text, lang."""
    known = labelled.where("lang is not null and text is not null")
    sizes = known.groupBy("lang").count()
    share = small_side(sizes.select("lang", (F.lit(float(sample_per_lang)) / F.col("count")).alias("share")))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.join(share, "lang").where(draw < F.col("share")).select("lang", "text")
    table = sample.mapInArrow(_counts(buckets), "lang string, bucket int, c long").groupBy("lang", "bucket").agg(F.sum("c").alias("c")).toPandas()
    langs = sorted(table.lang.unique())
    c = np.zeros((buckets, len(langs)))
    c[table.bucket.to_numpy(), np.searchsorted(langs, table.lang.to_numpy()) if langs else []] = table.c.to_numpy()
    n = {r["lang"]: r["count"] for r in sizes.collect()}
    prior = np.log(np.array([n[x] for x in langs], float)) - np.log(sum(n[x] for x in langs)) if langs else np.zeros(0)
    return langs, (np.log(c + ALPHA) - np.log(c.sum(0) + ALPHA * buckets)).astype(np.float32), prior


def _predict(model, buckets: int):
    def run(batches):
        langs, logp, prior = model.value
        for b in batches:
            pred, score = [], []
            for _, texts in text_chunks(b.column("text")):
                cp, offs = points(texts)
                z = np.tile(prior, (len(texts), 1))
                for n in ORDERS:
                    g, at = grams(cp, offs, n, buckets)
                    z += segment_sum(logp[g], at)
                has = segment_sum(_letters()[cp].astype(np.int32), offs) > 0
                if len(langs):
                    best = z.argmax(1)
                    p = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
                else:
                    has[:] = False
                pred += [langs[best[i]] if has[i] else "und" for i in range(len(texts))]
                score += [float(p[i]) if has[i] else 0.0 for i in range(len(texts))]
            keep = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: tuple, keep: list, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """The ``keep`` columns, lang_pred and score of every text."""
    src = docs.select(*keep, F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [f"`{n}` {t}" for n, t in src.dtypes if n != "text"]
    return src.mapInArrow(_predict(shared, buckets), ", ".join([*kinds, "lang_pred string, score double"]))


def fold(n: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(fold(4) != 2).select("doc_id", "text", "lang"))
    held = F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out")
    return identify(docs, model, ["doc_id", held])
