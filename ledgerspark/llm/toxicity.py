"""Operator 9, toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model gives each sentence a
probability, and the bag's is their noisy-or: 1 - prod(1 - p). The model
learns from document labels alone: the gradient of the bag's likelihood
spreads a label over the sentences that explain it. The sentences above the
threshold are the offending ones.

Words and their first bytes (inflected forms share a stem) are hashed to
``BUCKETS``. From a bounded sample of labelled documents,
document frequencies by label pick the ``VOCABULARY`` most telling buckets
(G-test of presence against label), and the model is fitted to these on the driver; what it
collects is bounded by the sample. All texts are scored whole in numpy.

Contract cases: null and empty texts have no sentence and score 0; a null
label, or an id with contradicting labels, is not learned from; if nothing can
be learned all scores are 0; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _LOWER, _P_BYTE, _SPACE, arrow_bytes, chunks, mix, read_table, small_side
from .language_id import fold, segment_sum

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7)
VOCABULARY = 2048
#: Labelled documents of each label to learn from.
SAMPLE_PER_LABEL = 8000
MIN_DOCS = 4
MIN_G = 16.0

_CUT = _SPACE.copy()
_CUT[[c for c in range(33, 128) if not chr(c).isalnum()]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def bags(buf: np.ndarray, offs: np.ndarray, buckets: int):
    """Features of a run of texts: row, sentence (numbered over the run), bucket; then the row, start and end of each word, and the first word of each sentence.

    A sentence is a run of words without one of ``.!?`` or a line break
    between. Its features are the words and their first ``PREFIXES`` bytes.
    """
    offs = offs - offs[0]
    n = len(buf)
    cut = _CUT[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.ones(n, bool)
    before[1:] = cut[:-1]
    after = np.ones(n, bool)
    after[:-1] = cut[1:]
    start = np.flatnonzero(~cut & (before | edge[:n]))
    end = np.flatnonzero(~cut & (after | edge[1:])) + 1
    up, down = _P_BYTE.upto(n + 1)
    p = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[buf]] * up[:n], out=p[1:])
    hashes = [(p[end] - p[start]) * down[start]]
    valid = [np.ones(len(start), bool)]
    for i, k in enumerate(PREFIXES):
        valid.append(end - start > k)
        hashes.append((p[np.minimum(start + k, end)] - p[start]) * down[start] + np.uint64(i + 1))
    valid, word = np.stack(valid, 1).ravel(), np.repeat(np.arange(len(start)), len(hashes))
    bucket = (mix(np.stack(hashes, 1).ravel()[valid]) % np.uint64(buckets)).astype(np.int64)
    word = word[valid]
    first = np.searchsorted(start, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    stops = np.cumsum(_STOP[buf])[start] if len(start) else np.zeros(0, np.int64)
    new = np.r_[True, (stops[1:] != stops[:-1]) | (row[1:] != row[:-1])] if len(start) else np.zeros(0, bool)
    sent = np.cumsum(new) - 1
    return row[word], sent[word], bucket, row, start, end, np.flatnonzero(new)


def _frequencies(buckets: int):
    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        docs = np.zeros(2, np.int64)
        for b in batches:
            buf, offs = arrow_bytes(b.column("text"))
            y = np.asarray(b.column("y").to_pylist(), np.int64)
            for lo, hi in chunks(offs):
                row, _, bucket, *_ = bags(buf[offs[lo] : offs[hi]], offs[lo : hi + 1], buckets)
                seen = np.unique(row * buckets + bucket)
                np.add.at(total, (y[lo + seen // buckets], seen % buckets), 1)
            docs += np.bincount(y, minlength=2)
        i = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, -1]), pa.array(np.r_[total[0, i], docs[0]]), pa.array(np.r_[total[1, i], docs[1]])], names=["bucket", "n0", "n1"])

    return run


def _features(chosen: np.ndarray, buckets: int):
    """For each labelled document: its label, sentences, and (sentence, word of the vocabulary) pairs."""

    def run(batches):
        slot = np.full(buckets, -1, np.int32)
        slot[chosen] = np.arange(len(chosen))
        for b in batches:
            buf, offs = arrow_bytes(b.column("text"))
            y = b.column("y").to_pylist()
            for lo, hi in chunks(offs):
                row, sent, bucket, wrow, _, _, heads = bags(buf[offs[lo] : offs[hi]], offs[lo : hi + 1], buckets)
                sents = np.bincount(wrow[heads], minlength=hi - lo)
                hit = np.flatnonzero(slot[bucket] >= 0)
                at = np.searchsorted(row[hit], np.arange(hi - lo + 1))
                s, f = sent[hit].astype(np.int32), slot[bucket[hit]]
                yield pa.RecordBatch.from_pydict({"y": pa.array(y[lo:hi], pa.int32()), "n": pa.array(sents.astype(np.int32)), "s": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(s)), "f": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(f))})

    return run


def train(y: np.ndarray, n: np.ndarray, doc: np.ndarray, sent: np.ndarray, feat: np.ndarray, w: np.ndarray, steps: int = 300, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Gradient ascent (Adam) on the noisy-or likelihood.

    ``doc, sent, feat`` name the telling words; sentences without one share the
    value of the bias, ``n`` counts all sentences of a document.
    """
    key = doc.astype(np.int64) << 32 | sent
    uniq, si = np.unique(key, return_inverse=True)
    sdoc = (uniq >> 32).astype(np.int64)
    plain = n - np.bincount(sdoc, minlength=len(y))
    theta = np.r_[w, -6.0]
    m = v = np.zeros_like(theta)
    k = len(w)
    for t in range(1, steps + 1):
        z = np.bincount(si, theta[feat], len(uniq)) + theta[k]
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[k]))
        rest = np.bincount(sdoc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + plain * np.log1p(-p0)
        none = np.exp(rest)
        pull = np.where(y == 1, none / np.maximum(1 - none, 1e-9), -1.0)
        gs = p * pull[sdoc]
        g = np.r_[np.bincount(feat, gs[si], k), gs.sum() + (plain * p0 * pull).sum()] / len(y) - l2 * np.r_[theta[:k], 0] / 10
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:k], float(theta[k])


def g_test(n1: np.ndarray, n0: np.ndarray, d1: int, d0: int) -> np.ndarray:
    """Log-likelihood ratio statistic of a word's presence (n of d documents) against the label."""
    total, out = d1 + d0, np.zeros(len(n1))
    for seen, docs, every in ((n1, d1, n1 + n0), (n0, d0, n1 + n0), (d1 - n1, d1, total - n1 - n0), (d0 - n0, d0, total - n1 - n0)):
        out += 2 * seen * np.log(np.maximum(seen, 1e-9) * total / (docs * np.maximum(every, 1e-9)))
    return out


def fit(labelled: DataFrame, buckets: int = BUCKETS, sample_per_label: int = SAMPLE_PER_LABEL) -> tuple[np.ndarray, float]:
    """(weights by bucket, bias) from columns text and y (0 or 1)."""
    freq = labelled.mapInArrow(_frequencies(buckets), "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    weights = np.zeros(buckets, np.float32)
    docs = freq[freq.bucket == -1]
    words = freq[(freq.bucket >= 0) & (freq.n0 + freq.n1 >= MIN_DOCS)].sort_values("bucket")
    d0, d1 = (int(docs.n0.iloc[0]), int(docs.n1.iloc[0])) if len(docs) else (0, 0)
    if not (d0 and d1 and len(words)):
        return weights, -np.inf
    n1, n0 = words.n1.to_numpy().astype(float), words.n0.to_numpy().astype(float)
    odds = np.log((n1 + 0.5) / (d1 - n1 + 0.5)) - np.log((n0 + 0.5) / (d0 - n0 + 0.5))
    order = np.argsort(-g_test(n1, n0, d1, d0), kind="stable")[:VOCABULARY]
    order = order[g_test(n1, n0, d1, d0)[order] >= MIN_G]
    chosen = words.bucket.to_numpy()[order]
    if not len(chosen):
        return weights, -np.inf
    t = labelled.mapInArrow(_features(chosen, buckets), "y int, n int, s array<int>, f array<int>").toArrow()
    y, n = t.column("y").to_numpy(), t.column("n").to_numpy()
    size = np.array([len(x) for x in t.column("s")])
    doc = np.repeat(np.arange(len(y)), size)
    flat = lambda c: np.concatenate([np.asarray(x.flatten(), np.int64) for x in t.column(c).chunks] or [np.zeros(0, np.int64)])
    w, bias = train(y, n, doc, flat("s"), flat("f"), np.clip(odds[order], -3, 6))
    weights[chosen] = w
    return weights, bias


def _score(model, buckets: int, threshold: float):
    def run(batches):
        weights, bias = model.value
        idle = np.log1p(-1 / (1 + np.exp(-bias))) if bias > -np.inf else 0.0
        for b in batches:
            buf, offs = arrow_bytes(b.column("text"))
            score, bad = [], []
            for lo, hi in chunks(offs):
                part = buf[offs[lo] : offs[hi]]
                _, sent, bucket, row, start, end, heads = bags(part, offs[lo : hi + 1], buckets)
                sents = np.bincount(row[heads], minlength=hi - lo)
                w = weights[bucket]
                hit = np.flatnonzero(w)
                which, at = np.unique(sent[hit], return_inverse=True)
                z = np.bincount(at, w[hit], len(which)) + bias
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                srow = row[heads[which]] if len(which) else np.zeros(0, np.int64)
                logs = np.bincount(srow, np.log1p(-np.minimum(p, 1 - 1e-15)), hi - lo) + (sents - np.bincount(srow, minlength=hi - lo)) * idle
                score.append(1 - np.exp(logs))
                found: list = [[] for _ in range(hi - lo)]
                last = np.r_[heads[1:], len(row)] - 1
                for s, q in zip(which[p >= threshold], p[p >= threshold], strict=True):
                    found[row[heads[s]]].append({"sentence": part[start[heads[s]] : end[last[s]]].tobytes().decode(errors="replace"), "score": float(q)})
                bad += found
            keep = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(n) for n in keep], pa.array(np.concatenate(score) if score else np.zeros(0)), pa.array(bad, pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())])))],
                names=[*keep, "score", "offending"],
            )

    return run


def toxicity(docs: DataFrame, model: tuple, keep: list, text_col: str = "text", buckets: int = BUCKETS, threshold: float = 0.5) -> DataFrame:
    """The ``keep`` columns, score and offending sentences of every text."""
    src = docs.select(*keep, F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [f"`{n}` {t}" for n, t in src.dtypes if n != "text"]
    return src.mapInArrow(_score(shared, buckets, threshold), ", ".join([*kinds, "score double, offending array<struct<sentence:string,score:double>>"]))


def sample_of(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """text, y of at most about ``per_label`` documents of each label, drawn by a hash of the id."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_hi")).where("y = _hi and doc_id is not null")
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, F.lit(per_label / n)).otherwise(share)
    drawn = known.where(draw < share).select("doc_id", "y")
    return docs.select("doc_id", "text").join(small_side(drawn), "doc_id").select("text", "y")


def op9(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit(sample_of(docs, labels.where(fold(5) != 0), "toxic", SAMPLE_PER_LABEL))
    held = F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")
    out = toxicity(docs, model, ["doc_id", held])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
