"""Operator 8, quality classifier: an interpolated modified Kneser-Ney word model of trusted text.

Tokens are runs of letters and digits, and every other character on its own,
which takes Chinese and Japanese text sign by sign; case is kept, and digits count
as 0. The model has trigrams of tokens with two start symbols before each
text; its lower orders hold continuation counts (Chen and Goodman 1999), and
an unseen token has the share of one more word.

The counts are a Spark table sharded by the context of the n-gram. Each part
of the documents (all rows with one hash) asks the shards for its distinct
n-grams, a join of the questions with the counts answers them, and a join of
the answers with the part gives each document's perplexity. Counts, questions
and answers grow with the input and stay in Spark; rows carry them as sorted,
compressed runs. Parts are scored in ``ROUNDS`` rounds, so that scratch space
holds the questions of one round at a time.

A tenth of the trusted texts, told by their hash, is held out of the counts. A
text is rejected if its mean code length exceeds the threshold of its
language: the ``quantile`` of the code lengths of held-out texts in that
language (of all held-out texts where the language has none), plus ``slack``
and plus ``spread / sqrt(tokens)``, as short texts scatter more. The trusted
texts set the threshold themselves where none is held out.

Words are told by 32 bits of hash, so that n-grams can be taken apart again;
words that fall together share their counts.

Contract cases: null texts and texts without a token have no perplexity and are
rejected; null languages form a group of their own, apart from empty ones; a
null label is not trusted; where nothing is trusted, nothing is rejected but
empty texts; repeated rows are scored alike.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _P_BYTE, apart, arrow_bytes, bucketed, chunks, drop_written, mix, read_table, small_side, written
from .language_id import segment_sum, text_chunks

ORDER = 4
SYMBOLS = 48
QUANTILE = 0.99
SLACK = 0.05
SPREAD = 2.0
#: Tokens of the longest n-grams of words.
WORDS = 3
#: Of so many trusted texts one is held out.
HELD = 10
#: Bytes of text for each part and shard, the least number of both, and rounds of parts beyond a size.
PART_BYTES, LEAST, ROUNDS, ONE_ROUND = 10 << 20, 6, 8, 64 << 20
#: Bytes of text that are cut into tokens in one go, few enough for a processor's cache.
TOKEN_BYTES = 1 << 17
#: Bytes of trusted text that are counted in one go.
COUNT_BYTES = 8 << 20

_table: np.ndarray | None = None


def symbol_table() -> np.ndarray:
    """Class of each code point: 0 text start, 1-26 a-z, 27 upper case, 28 digits, 29-33 common marks, 34-47 the rest."""
    global _table
    if _table is None:
        t = np.full(0x110000, 47, np.uint8)
        ascii_marks = [c for c in range(33, 127) if not chr(c).isalnum()]
        t[ascii_marks] = 40
        t[[ord(c) for c in ":;!?\"'"]] = np.arange(34, 40)
        for c in range(128, 0x3000):
            x = chr(c)
            t[c] = 27 if x.isupper() else 41 + c % 6 if x.isalpha() else 47
        t[97:123] = np.arange(1, 27)
        t[65:91] = 27
        t[48:58] = 28
        t[[32, 9, 11, 12, 13]] = 29
        t[10], t[ord(".")], t[ord(",")], t[ord("-")] = 30, 31, 32, 33
        _table = t
    return _table


def codes(texts: list, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character, with start symbols before each text; offsets by text."""
    raw = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    size = np.array([len(x) // 4 for x in raw], np.int64)
    offs = np.r_[0, np.cumsum(size)]
    sym = symbol_table()[np.frombuffer(b"".join(raw), np.uint32)]
    at = np.arange(len(sym)) + np.repeat(np.arange(1, len(size) + 1) * (order - 1), size)
    pad = np.zeros(len(sym) + (order - 1) * len(size), np.int64)
    pad[at] = sym
    g = pad[at].copy()
    for i in range(1, order):
        g += pad[at - i] * SYMBOLS**i
    return g, offs


def _counts(order: int):
    def run(batches):
        total = np.zeros(SYMBOLS**order, np.int64)
        for b in batches:
            for _, texts in text_chunks(b.column("text")):
                total += np.bincount(codes(texts, order)[0], minlength=len(total))
        i = np.flatnonzero(total)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], names=["g", "c"])

    return run


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, ...]:
    """Discounts of counts 1, 2 and above, from the numbers of n-grams with counts 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))


def fit(trusted: DataFrame, text_col: str = "text", order: int = ORDER) -> np.ndarray | None:
    """The character model, which no query uses: natural-log probabilities by n-gram code; None if there is no trusted text."""
    src = trusted.select(F.col(text_col).alias("text"))
    top = src.mapInArrow(_counts(order), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    tables = [written(top, f"counts{order}")]
    for n in range(order - 1, 0, -1):
        tables.append(tables[-1].groupBy((F.col("g") % SYMBOLS**n).alias("g")).agg(F.count("*").alias("c")))
    lower, dense = None, np.full(SYMBOLS, 1.0 / SYMBOLS, np.float32)
    for n, counts in zip(range(1, order + 1), reversed(tables), strict=True):
        d = _discounts(*counts.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first())
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        counts = counts.withColumn("ctx", F.floor(F.col("g") / SYMBOLS))
        stats = counts.groupBy("ctx").agg(F.sum("c").alias("tot"), F.sum(cut).alias("left"))
        p = counts.join(stats, "ctx")
        if lower is not None:
            p = p.join(lower.select(F.col("g").alias("low"), F.col("p").alias("q")), F.col("g") % SYMBOLS ** (n - 1) == F.col("low"))
        else:
            p = p.withColumn("q", F.lit(1.0 / SYMBOLS))
        lower = written(p.select("g", ((F.col("c") - cut + F.col("left") * F.col("q")) / F.col("tot")).alias("p")), f"probs{n}")
        seen, ctx = lower.toPandas(), stats.select("ctx", (F.col("left") / F.col("tot")).alias("share")).toPandas()
        if not len(seen):
            return None
        share = np.ones(SYMBOLS ** (n - 1), np.float32)
        share[ctx.ctx.to_numpy()] = ctx.share.to_numpy()
        dense = np.tile(dense.reshape(-1, SYMBOLS), (SYMBOLS if n > 1 else 1, 1))
        dense *= share[:, None]
        dense = dense.reshape(-1)
        dense[seen.g.to_numpy()] = seen.p.to_numpy()
    np.maximum(dense, 1e-12, out=dense)
    return np.log(dense, out=dense)

#: By first byte of a character: 0 space, 1 of a word, 2 a token of its own, 3 not the first byte.
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC3, 0xE2), *range(0xEA, 0xEF)]] = 1
_KIND[0x80:0xC0] = 3
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[48:58] = 48
_START = np.uint32(1)
_LOW = np.uint64(0xFFFFFFFF)


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the tokens of texts in UTF-8, and offsets by text."""
    offs = offs - offs[0]
    at = np.flatnonzero(_KIND[buf] != 3)
    kind = _KIND[buf[at]]
    after = np.r_[at[1:], len(buf)].astype(np.int64)
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    word = kind == 1
    joins = word[1:] & word[:-1] & ~edge[at[1:]]
    start, end = at[(kind != 0) & ~np.r_[False, joins][: len(at)]], after[(kind != 0) & ~np.r_[joins, False][: len(at)]]
    up, down = _P_BYTE.upto(len(buf) + 1)
    p = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[_FOLD[buf]] * up[: len(buf)], out=p[1:])
    h = (mix((p[end] - p[start]) * down[start]) >> np.uint64(32)).astype(np.uint32)
    return h, np.searchsorted(start, offs)


def _once(x: np.ndarray) -> np.ndarray:
    """The distinct values of a sorted array; the hash tables of np.unique take longer."""
    return x[np.r_[True, x[1:] != x[:-1]][: len(x)]]


def _ids(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and the place of each value among them.

    Values that leave room for it are sorted with their own position in the
    low bits, as numbers are sorted several times faster than argsort works.
    """
    bits = max(len(x) - 1, 1).bit_length()
    if len(x) and int(x.max()).bit_length() + bits <= 64:
        y = x.astype(np.uint64) << np.uint64(bits)
        y |= np.arange(len(x), dtype=np.uint64)
        y.sort()
        by = (y & np.uint64((1 << bits) - 1)).astype(np.int64)
        y >>= np.uint64(bits)
        y = y.astype(x.dtype)
    else:
        by = np.argsort(x)
        y = x[by]
    new = np.ones(len(x), bool)
    new[1:] = y[1:] != y[:-1]
    place = np.empty(len(x), np.int32 if len(x) < 1 << 31 else np.int64)
    place[by] = np.cumsum(new, dtype=place.dtype) - 1
    return y[new], place


def grams(words: np.ndarray, offs: np.ndarray, lower: bool = True, places: bool = True) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By order the distinct n-grams, sorted, and the place of each token's n-gram among them.

    An n-gram is a context (both words before in 64 bits, the word before, or
    0) and a word. ``lower``: whether to give the lower orders, too. Without
    ``places`` these are None.
    """
    # words by their rank, which is the same order in fewer bits
    known, rank = _ids(np.r_[words, _START])
    bits = np.uint64(len(known).bit_length())
    word, low = rank[:-1], (np.uint64(1) << bits) - np.uint64(1)
    at = np.arange(len(words)) + np.repeat(np.arange(1, len(offs)) * (WORDS - 1), np.diff(offs))
    pad = np.full(len(words) + (WORDS - 1) * (len(offs) - 1), rank[-1], np.uint64)
    pad[at] = word
    code, pair = _ids(np.r_[rank[-1:].astype(np.uint64), pad[:-1]] << bits | pad)
    three = pair[at - 1].astype(np.uint64) << bits | pad[at]
    three, place = _ids(three) if places else (_once(np.sort(three)), None)
    pairs = known[(code >> bits).astype(np.int64)].astype(np.uint64) << np.uint64(32) | known[(code & low).astype(np.int64)]
    out = {3: (pairs[(three >> bits).astype(np.int64)], known[(three & low).astype(np.int64)], place)}
    if lower:
        asked = np.zeros(len(pairs), bool)
        asked[pair[at]] = True
        two = pairs[asked]
        out[2] = two >> np.uint64(32), (two & _LOW).astype(np.uint32), (np.cumsum(asked, dtype=pair.dtype) - 1)[pair[at]] if places else None
        used = np.zeros(len(known), bool)
        used[word] = True
        out[1] = np.zeros(int(used.sum()), np.uint64), known[used], (np.cumsum(used, dtype=rank.dtype) - 1)[word] if places else None
    return out


def _summed(ctx: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each n-gram once, sorted, with the sum of its counts."""
    if not len(w):
        return ctx, w, c
    ids, place = _ids(ctx)
    code, place = _ids(place.astype(np.uint64) << np.uint64(32) | w)
    return ids[(code >> np.uint64(32)).astype(np.int64)], (code & _LOW).astype(np.uint32), np.bincount(place, c).astype(np.int64)


def _by_shard(order: int, ctx: np.ndarray, w: np.ndarray, n: int):
    """(shard, rows) of n-grams, of single words by the word; each order has ``n`` shards of its own."""
    shard = (mix((w.astype(np.uint64) if order == 1 else ctx) + np.uint64(order)) % np.uint64(n)).astype(np.int32)
    by = np.argsort(shard.astype(np.uint16) if n < 1 << 16 else shard, kind="stable")
    size = np.bincount(shard)
    ids = np.flatnonzero(size)
    if len(ids):
        yield from zip((ids * WORDS + order - 1).tolist(), np.split(by, np.cumsum(size[ids])[:-1]), strict=True)


def _codec(kind: type | np.dtype) -> str:
    return "lz4_raw" if kind == np.float32 else "zstd"


def _pack(x: np.ndarray) -> bytes:
    """Compressed; 64-bit contexts, which are sorted, as differences, and counts in as few bytes as they need.

    Shares (float32) are packed by LZ4, in half the time for half as much again.
    """
    x = np.diff(x, prepend=x.dtype.type(0)) if x.dtype == np.uint64 else x
    if x.dtype == np.int64:
        x = x.astype(np.min_scalar_type(x.max(initial=0)))
    return len(x).to_bytes(8, "little") + x.itemsize.to_bytes(1, "little") + pa.compress(x, _codec(x.dtype), asbytes=True)


def _unpack(b: bytes, kind: type) -> np.ndarray:
    """The numbers again; counts (int64) stay as short as they are stored."""
    n, size = int.from_bytes(b[:8], "little"), b[8]
    x = np.frombuffer(pa.decompress(memoryview(b)[9:], n * size, _codec(kind)), f"u{size}" if kind is np.int64 else kind)
    return np.cumsum(x, dtype=np.uint64) if kind is np.uint64 else x


def _new(x: np.ndarray) -> np.ndarray:
    """Whether each value of a sorted array differs from the one before."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


_COUNTS = pa.schema([("shard", pa.int32()), ("ctx", pa.binary()), ("w", pa.binary()), ("c", pa.binary())])
_SIZES = pa.schema([(x, pa.int64()) for x in ("n1", "n2", "n3", "n4", "kinds", "total")])
_ASKS = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("ctx", pa.binary()), ("w", pa.binary())])
_ANSWERS = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("u", pa.binary()), ("lam", pa.binary())])
_COUNTS_SQL = "shard int, ctx binary, w binary, c binary"
_SIZES_SQL = ", ".join(f"{x} long" for x in _SIZES.names)


def _rows(items: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in items], schema=schema)


def _dealt(order: int, ctx: np.ndarray, w: np.ndarray, c: np.ndarray, n: int):
    """A batch for each shard."""
    for shard, i in _by_shard(order, ctx, w, n):
        yield _rows([(shard, _pack(ctx[i]), _pack(w[i]), _pack(c[i]))], _COUNTS)


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``tokens`` a chunk at a time, which bounds the memory for bytes."""
    words, at = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
    for lo, hi in chunks(offs, TOKEN_BYTES):
        h, o = tokens(buf[offs[lo] : offs[hi]], offs[lo : hi + 1])
        words.append(h)
        at.append(o[1:] + at[-1][-1])
    return np.concatenate(words), np.concatenate(at)


def _count_texts(n: int):
    def run(batches):
        for b in batches:
            buf, offs = arrow_bytes(b.column("text"))
            for lo, hi in chunks(offs, COUNT_BYTES):
                ctx, w, place = grams(*_words(buf, offs[lo : hi + 1]), lower=False)[WORDS]
                yield from _dealt(WORDS, ctx, w, np.bincount(place, minlength=len(w)).astype(np.int64), n)

    return run


def _count_lower(order: int, n: int):
    """Each n-gram of an order counts once for the n-gram without its first word."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ctx, w = _unpack(r["ctx"], np.uint64), _unpack(r["w"], np.uint32)
                code = np.sort(ctx << np.uint64(32) | w if order == 3 else w.astype(np.uint64))
                first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
                code, c = code[first], np.diff(first, append=len(code))
                yield from _dealt(order - 1, code >> np.uint64(32), (code & _LOW).astype(np.uint32), c, n)

    return run


def _merge(key, table):
    """The parts of a shard as one row, with the numbers of n-grams of counts 1 to 4, of all, and the sum of counts."""
    ctx, w, c = _summed(*[np.concatenate([_unpack(x.as_py(), kind) for x in table.column(name)]) for name, kind in (("ctx", np.uint64), ("w", np.uint32), ("c", np.int64))])
    sizes = [int((c == i).sum()) for i in (1, 2, 3, 4)] + [len(c), int(c.sum())]
    return pa.Table.from_batches([_rows([(key[0].as_py(), _pack(ctx), _pack(w), _pack(c), *sizes)], pa.schema([*_COUNTS, *_SIZES]))])


def fit_words(trusted: DataFrame, shards: int, text_col: str = "text") -> tuple[DataFrame, dict] | None:
    """The counts of all orders in ``shards`` buckets of shards, and by order its discounts and numbers; None if there is no token."""
    name, model, parts = f"counts_{uuid.uuid4().hex}", {}, trusted.select(F.col(text_col).alias("text")).mapInArrow(_count_texts(shards), _COUNTS_SQL)
    for order in range(WORDS, 0, -1):
        counts = bucketed(parts.repartition(shards, "shard").groupBy("shard").applyInArrow(_merge, f"{_COUNTS_SQL}, {_SIZES_SQL}"), "shard", shards, "counts", name)
        own = counts.where(F.col("shard") % WORDS == order - 1)
        r = own.agg(*[F.sum(x).alias(x) for x in _SIZES.names]).first()
        if not r["kinds"]:
            return None
        d = _discounts(r["n1"], r["n2"], r["n3"], r["n4"])
        model[order] = d, r["kinds"], r["total"], r["n1"] * d[0] + r["n2"] * d[1] + (r["kinds"] - r["n1"] - r["n2"]) * d[2]
        parts = own.select(*_COUNTS.names).mapInArrow(_count_lower(order, shards), _COUNTS_SQL)
    return counts.select(*_COUNTS.names), model


def _tokenised(batches):
    """The text replaced by its tokens, as _lm_words."""
    for b in batches:
        buf, offs = arrow_bytes(b.column("_lm_text"))
        h, at = _words(buf, offs)
        words = [h[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        keep = [c for c in b.schema.names if c != "_lm_text"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(words, pa.binary())], names=[*keep, "_lm_words"])


def _part_words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a part, and offsets by row."""
    col = table.column("_lm_words").to_pylist()
    return np.frombuffer(b"".join(col), np.uint32), np.r_[0, np.cumsum([len(x) // 4 for x in col], dtype=np.int64)]


def _ask(n: int):
    def run(key, table):
        rows = [(shard, key[0].as_py(), _pack(ctx[i]), _pack(w[i])) for order, (ctx, w, _) in grams(*_part_words(table), places=False).items() for shard, i in _by_shard(order, ctx, w, n)]
        return pa.Table.from_batches([_rows(rows, _ASKS)])

    return run


def _answer(model: dict):
    """For each n-gram that is asked for its discounted share, and for each context what it leaves to the lower order."""

    def run(key, asks, counts):
        order = key[0].as_py() % WORDS + 1
        ctx, w, c = (np.concatenate([np.zeros(0, np.uint8), *[_unpack(x.as_py(), kind) for x in counts.column(name)]]) for name, kind in (("ctx", np.uint64), ("w", np.uint32), ("c", np.int64)))
        d, _, total, rest = model[order]
        d = np.array([0, *d])
        new = _new(ctx)
        first = np.flatnonzero(new)
        ids = ctx[first]
        # single words are dealt over the shards, so the sums are those of the whole table
        if order > 1 and len(ids):
            tot = np.add.reduceat(c, first, dtype=np.int64)
            left = np.add.reduceat(d[np.minimum(c, 3)], first) / tot
        else:
            tot, left = np.full(len(ids), total), np.full(len(ids), rest / total)
        code = np.cumsum(new, dtype=np.uint64)
        code -= np.uint64(1)
        code <<= np.uint64(32)
        code |= w
        rows = []
        for r in asks.to_pylist():
            x, y = _unpack(r["ctx"], np.uint64), _unpack(r["w"], np.uint32)
            asked = _new(x)
            x = x[asked]
            u, lam = np.zeros(len(y), np.float32), np.full(len(x), 1 if order > 1 else rest / total, np.float32)
            if len(ids):
                i = np.searchsorted(ids, x)
                i[i == len(ids)] = 0
                known = ids[i] == x
                lam[known] = left[i[known]]
                run = np.cumsum(asked) - 1
                z = np.flatnonzero(known[run])
                i = i[run[z]]
                z, y = i.astype(np.uint64) << np.uint64(32) | y[z], z
                j = np.searchsorted(code, z)
                j[j == len(code)] = 0
                hit = code[j] == z
                j = j[hit]
                u[y[hit]] = (c[j] - d[np.minimum(c[j], 3)]) / tot[i[hit]]
            rows.append((r["shard"], r["part"], _pack(u), _pack(lam)))
        return pa.Table.from_batches([_rows(rows, _ANSWERS)])

    return run


def _score(model: dict, n: int, keep: list):
    def run(key, docs, answers):
        words, at = _part_words(docs)
        asked = grams(words, at)
        given = {r["shard"]: r for r in answers.to_pylist()}
        p = np.full(at[-1], 1.0 / (model[1][1] + 1))
        for order in range(1, WORDS + 1):
            ctx, w, place = asked[order]
            u, lam = np.empty(len(w), np.float32), np.empty(len(w), np.float32)
            for shard, i in _by_shard(order, ctx, w, n):
                u[i] = _unpack(given[shard]["u"], np.float32)
                lam[i] = _unpack(given[shard]["lam"], np.float32)[np.cumsum(_new(ctx[i])) - 1]
            p = u[place] + lam[place] * p
        size = np.diff(at)
        nll = [None if not k else -float(x) / int(k) for x, k in zip(segment_sum(np.log(p), at), size, strict=True)]
        return docs.select(keep).append_column("_lm_nll", pa.array(nll, pa.float64())).append_column("_lm_n", pa.array(size, pa.int64()))

    return run


def code_lengths(docs: DataFrame, counts: DataFrame, model: dict, shards: int, size: int, text_col: str = "text", keep: list | None = None) -> DataFrame:
    """``keep`` columns (all of them by default), _lm_nll (nats per token) and _lm_n (tokens), from ``size`` bytes of text."""
    keep = docs.columns if keep is None else keep
    rounds = ROUNDS if size > ONE_ROUND else 1
    parts = max(LEAST, size // rounds // PART_BYTES)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("_lm_text"))
    src = src.withColumn("_lm_part", F.pmod(F.xxhash64(*src.columns), F.lit(parts * rounds)).cast("int"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in src.dtypes if c != "_lm_text") + ", _lm_words binary"
    out = None
    for turn in range(rounds):
        some = bucketed(src.where(F.col("_lm_part") % rounds == turn).mapInArrow(_tokenised, kinds).repartition(2 * parts, "_lm_part"), "_lm_part", 2 * parts, "parts")
        asks = some.select("_lm_part", "_lm_words").groupBy("_lm_part").applyInArrow(_ask(shards), "shard int, part int, ctx binary, w binary")
        answers = asks.repartition(shards, "shard").groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(_answer(model), "shard int, part int, u binary, lam binary")
        kind = ", ".join([f"`{c}` {t}" for c, t in some.dtypes if c in keep] + ["_lm_nll double", "_lm_n long"])
        got = written(some.groupBy("_lm_part").cogroup(answers.repartition(2 * parts, "part").groupBy("part")).applyInArrow(_score(model, shards, keep), kind), "scored")
        drop_written(some)
        out = got if out is None else out.unionByName(got)
    return out


def thresholds(scored: DataFrame, quantile: float) -> tuple[DataFrame, float | None]:
    """(_lm_lang, _lm_cut) of held-out texts by language, and the cut over all of them."""
    q = F.percentile_approx("_lm_nll", F.lit(quantile), F.lit(10_000))
    by = scored.groupBy("_lm_lang").agg(q.alias("_lm_cut"))
    return by, scored.agg(q).first()[0]


def trusted_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose id is labelled with quality 1 and never with 0."""
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").alias("_lm_good"))
    return docs.join(small_side(good), docs["doc_id"] == F.col("_lm_good"), "left_semi")


def _bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def classify(docs: DataFrame, trusted: DataFrame, text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, slack: float = SLACK, spread: float = SPREAD, keep: list | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all by default) with _lm_perplexity, _lm_threshold and _lm_keep."""
    new = ("_lm_perplexity", "_lm_threshold", "_lm_keep")
    src, inner = apart(docs)
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    kept = [F.col(inner[c]).alias(c) for c in names]
    size = _bytes(docs, text_col)
    shards = max(LEAST, size // PART_BYTES)
    held = F.pmod(F.xxhash64(text_col), F.lit(HELD)) == 0
    lang = F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("")).alias("_lm_lang")
    trusted = trusted.select(F.col(text_col).alias("text"), lang, held.alias("held")).where("text is not null")
    apart_too = trusted.where("held")
    fitted = fit_words(trusted.where("not held"), shards)
    if fitted is None:
        fitted = fit_words(trusted, shards)
    if fitted is None:
        none = F.lit(None).cast("double")
        return src.select(*kept, none.alias(new[0]), none.alias(new[1]), F.coalesce(F.length(inner[text_col]) > 0, F.lit(False)).alias(new[2]))
    counts, model = fitted
    for probe in (apart_too, trusted):
        scored = code_lengths(probe, counts, model, shards, _bytes(probe, "text"), keep=["_lm_lang"]).where("_lm_nll is not null").withColumn("_lm_nll", F.col("_lm_nll") - spread / F.sqrt(F.greatest("_lm_n", F.lit(1))))
        by, overall = thresholds(scored, quantile)
        if overall is not None:
            break
    by = small_side(written(by, "cuts"))
    columns = list(dict.fromkeys([*[inner[c] for c in names], inner[lang_col]]))
    out = code_lengths(src, counts, model, shards, size, inner[text_col], columns)
    drop_written(counts)
    own = F.coalesce(F.concat(F.lit("="), F.col(inner[lang_col]).cast("string")), F.lit(""))
    out = out.withColumn("_lm_lang", own).join(by, "_lm_lang", "left")
    cut: Column = F.coalesce("_lm_cut", F.lit(overall)) + slack + spread / F.sqrt(F.greatest("_lm_n", F.lit(1)))
    stays = F.coalesce(F.col("_lm_nll") <= cut, F.lit(False))
    return out.select(*kept, F.exp("_lm_nll").alias(new[0]), F.exp(cut).alias(new[1]), stays.alias(new[2]))


def op8(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    docs = docs.select("doc_id", "text", "lang")
    out = classify(docs, trusted_of(docs, labels), keep=["doc_id", "lang"])
    return out.select("doc_id", "lang", F.col("_lm_perplexity").alias("perplexity"), F.col("_lm_threshold").alias("threshold"), F.col("_lm_keep").alias("keep"))
