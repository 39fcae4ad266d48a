"""Operator 6, SimHash near-dedup by tiled exact comparison.

Fingerprints: word shingles of the lower-cased (A-Z) text, hashed with XXH64
(seed 42); a bit is 1 if it is set in over half the hashes. A text with fewer
words than a shingle is one shingle; a text without words has fingerprint 0.

Links: all pairs of distinct fingerprints within ``radius`` differing bits.
Fingerprints are cut into radius + 1 blocks of bits. Two of them within the
radius agree on a whole block, so tiles hold the fingerprints that agree on
one block, in the order of their population counts; pairs whose population
counts differ by more than ``radius`` are skipped. A comparison is a numpy
exclusive-or and a bit count over many small tiles at once. Tiles with more
than ``TILE_ROWS`` fingerprints are cut into shares, and each pair of shares
goes to a task of its own. Tasks return a spanning forest of the links they
found, never all pairs; components come from rounds of minimum-label joins.

Contract cases: null and empty texts have fingerprint 0 and are linked with
each other; repeated ids and ties go to the smallest id; rows without an id
keep component null unless their group has one; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, apart, arrow_bytes, chunks, read_table, run_hash, small_side, written

SEED = 42
#: Buckets of hashed shingles in the table of rarity classes.
CLASSES = 1 << 18
TILE_ROWS = 8192


def fingerprint(text: bytes, k: int, sized: bool = False) -> tuple[int, int]:
    """Fingerprint and, if ``sized``, the number of different shingles."""
    words = text.lower().split()
    if not words:
        return 0, 0
    h64, join = xxhash.xxh64_intdigest, b" ".join
    rows = [words[i:] for i in range(k)] if len(words) >= k else [[join(words)]]
    total, n, seen = np.zeros(64, np.int64), 0, []
    hashes = (h64(join(t), SEED) for t in zip(*rows, strict=False))
    while len(h := np.fromiter((x for _, x in zip(range(1 << 15), hashes, strict=False)), np.uint64)):
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
        if sized:
            seen.append(np.unique(h))
        if len(h) < 1 << 15:
            break
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0]), len(np.unique(np.concatenate(seen))) if sized else 0


def _fingerprints(k: int, sized: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = arrow_bytes(b.column("_lm_text"))
            data = buf.tobytes()
            found = [fingerprint(data[x:y], k, sized) for x, y in zip(offs[:-1], offs[1:], strict=True)]
            fp, n = np.array([x for x, _ in found], np.uint64), pa.array([x for _, x in found], pa.int64())
            keep = [c for c in b.schema.names if c != "_lm_text"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(fp.view(np.int64)), n], names=[*keep, "_lm_fp", "_lm_shingles"])

    return run


def fingerprints(docs: DataFrame, keep: list, text_col: str, k: int, sized: bool = False) -> DataFrame:
    """``keep`` columns, _lm_fp long (the unsigned fingerprint's bits) and, if ``sized``, _lm_shingles."""
    src = docs.select(*keep, F.col(text_col).alias("_lm_text"))
    kinds = [f"`{n}` {t}" for n, t in src.dtypes if n != "_lm_text"]
    out = src.mapInArrow(_fingerprints(k, sized), ", ".join([*kinds, "_lm_fp long", "_lm_shingles long"]))
    return out if sized else out.drop("_lm_shingles")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Root (smallest index) of each of n nodes under the links i-j."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def _tiles(radius: int):
    """Rows sorted by tile and population count -> spanning links; a tile may go over batches."""

    def solve(tile: np.ndarray, ones: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        names, node = np.unique(fp, return_inverse=True)
        i, a, b, held = np.arange(len(fp)), [], [], 0
        tree = np.zeros((0, 2), np.int64)
        for o in range(1, len(fp)):
            i = i[i + o < len(fp)]
            i = i[(tile[i] == tile[i + o]) & (ones[i + o] - ones[i] <= radius)]
            if not len(i):
                break
            hit = i[np.bitwise_count(fp[i] ^ fp[i + o]) <= radius]
            a.append(node[hit]), b.append(node[hit + o])
            held += len(hit)
            if held > 1 << 20:
                tree, held = _tree(len(names), [tree[:, 0], *a], [tree[:, 1], *b]), 0
                a, b = [], []
        tree = _tree(len(names), [tree[:, 0], *a], [tree[:, 1], *b])
        return pa.RecordBatch.from_arrays([pa.array(names[tree[:, 0]].view(np.int64)), pa.array(names[tree[:, 1]].view(np.int64))], names=["a", "b"])

    def run(batches):
        tile, ones, fp, last = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for x in batches:
            keys = np.stack([x.column(c).to_numpy().astype(np.int64) for c in ("block", "value", "l", "r")], 1)
            if not len(keys):
                continue
            new = np.r_[True, (keys[1:] != keys[:-1]).any(1)]
            if last is not None:
                new[0] = bool((keys[0] != last).any())
            last = keys[-1]
            number = (tile[-1] if len(tile) else 0) + np.cumsum(new)
            tile, ones, fp = np.r_[tile, number], np.r_[ones, x.column("level").to_numpy().astype(np.int64)], np.r_[fp, x.column("fp").to_numpy().view(np.uint64)]
            done = int(np.searchsorted(tile, tile[-1]))
            if done:
                yield solve(tile[:done], ones[:done], fp[:done])
                tile, ones, fp = tile[done:], ones[done:], fp[done:]
        if len(tile):
            yield solve(tile, ones, fp)

    return run


def _tree(n: int, a: list, b: list) -> np.ndarray:
    root = forest(n, np.concatenate(a), np.concatenate(b))
    child = np.flatnonzero(root != np.arange(n))
    return np.stack([root[child], child], 1)


def links(fps: DataFrame, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links a-b that span the components of distinct fingerprints ``fp`` within ``radius`` bits."""
    blocks = radius + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    value = lambda i: F.shiftrightunsigned("fp", edges[i]).bitwiseAND((1 << (edges[i + 1] - edges[i])) - 1)
    rows = fps.select("fp", F.bit_count("fp").alias("level"), F.explode(F.array(*[F.struct(F.lit(i).alias("block"), value(i).alias("value")) for i in range(blocks)])).alias("t"))
    rows = rows.select("fp", "level", "t.block", "t.value")
    large = rows.groupBy("block", "value").count().where(F.col("count") > tile_rows).select("block", "value", F.ceil(F.col("count") / tile_rows).cast("int").alias("parts"))
    rows = rows.join(small_side(written(large, "large")), ["block", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("s", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    goes = F.expr("""concat(transform(sequence(s, parts - 1), q -> named_struct('l', s, 'r', q)),
                            if(s > 0, transform(sequence(0, s - 1), p -> named_struct('l', p, 'r', s)), array()))""")
    rows = rows.select("block", "value", "level", "fp", F.explode(goes).alias("_goes")).select("block", "value", "_goes.*", "level", "fp")
    key = ["block", "value", "l", "r"]
    rows = rows.repartition(*key).sortWithinPartitions(*key, "level", "fp")
    return rows.mapInArrow(_tiles(radius), "a long, b long").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: connected components of the links by rounds of large-star and small-star.

    Each round is a pair of aggregations on a node (Kiveris et al. 2014), so it
    needs about log(n) rounds; a round's links are written to the shared
    folder. Hot nodes cost a map-side combined minimum and a joined row per
    link.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = written(e, "links")
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = written(small.where("u != v").distinct(), "links")
        # stars: every node has one link, to a root that has none
        ragged = new.groupBy("u").count().where("count > 1").limit(1).count() or new.join(new.select(F.col("v").alias("w")).distinct(), F.col("u") == F.col("w"), "left_semi").limit(1).count()
        e = new
        if not ragged:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, _lm_fp, component_id (smallest id reachable)."""
    fps = written(fingerprints(docs, [F.col(id_col).alias("doc_id")], text_col, k), "fingerprints")
    distinct = written(fps.groupBy(F.col("_lm_fp").alias("fp")).agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(ids, "root").select(F.col("fp").alias("_lm_fp"), "component_id")
    return fps.join(named, "_lm_fp").select("doc_id", "_lm_fp", "component_id")


#: Near-dedup of whole documents: words of a shingle, least Jaccard similarity.
SHINGLE, SIMILARITY = 5, 0.8
#: Pairs for each posting that are all looked at without another round of hubs.
FEW = 4


def _shingle_hashes(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each shingle of a run of texts; a text of fewer than k words is one shingle."""
    words = Words(buf, offs, lower=True)
    held = np.diff(words.first)
    many = np.where(held > 0, np.maximum(1, held - k + 1), 0)
    row = np.repeat(np.arange(len(held)), many)
    start = words.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    return row, run_hash(words.runs(), start, np.minimum(start + k, words.first[row + 1]))


def _count_shingles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for x in batches:
            buf, offs = arrow_bytes(x.column("_lm_text"))
            for lo, hi in chunks(offs):
                _, h = _shingle_hashes(buf[offs[lo] : offs[hi]], offs[lo : hi + 1], k)
                total += np.bincount((h & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["b", "n"])

    return run


def rarity_classes(docs: DataFrame, count) -> bytes:
    """The class of each bucket of what ``count`` counts: its count over all texts, on a log scale.

    The table has ``CLASSES`` entries whatever the data.
    """
    counts = docs.select("_lm_text").mapInArrow(count, "b long, n long")
    every = docs.sparkSession.range(CLASSES).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("n"))
    c = counts.unionByName(every).groupBy("b").agg(F.sum("n").alias("n"))
    c = c.select(F.shiftright("b", 10).alias("hi"), "b", F.when(F.col("n") > 0, F.least(F.lit(120), 1 + F.floor(3 * F.log2("n")))).otherwise(0).cast("int").alias("c"))
    # a row for each 1024 buckets, as hexadecimal text: the table goes to the driver as CLASSES / 1024 strings
    rows = c.groupBy("hi").agg(F.array_sort(F.collect_list(F.struct("b", "c"))).alias("m"))
    text = F.array_join(F.transform("m", lambda x: F.lpad(F.hex(x["c"]), 2, "0")), "")
    table = bytearray(CLASSES)
    for r in rows.select("hi", text.alias("text")).collect():
        table[r["hi"] * 1024 : (r["hi"] + 1) * 1024] = bytes.fromhex(r["text"])
    return bytes(table)


def _prefixes(classes: bytes, k: int, threshold: float):
    """The rarest n - ceil(threshold * n) + 1 shingles of each text; texts without words have posting 0."""
    scale = np.frombuffer(classes, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            buf, offs = arrow_bytes(x.column("_lm_text"))
            names = x.column("node").to_numpy()
            for lo, hi in chunks(offs):
                row, h = _shingle_hashes(buf[offs[lo] : offs[hi]], offs[lo : hi + 1], k)
                rare = scale[(h & np.uint64(CLASSES - 1)).astype(np.int64)]
                order = np.lexsort((h, rare, row))
                row, h = row[order], h[order]
                new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])][: len(row)]
                row, h = row[new], h[new]
                n = np.bincount(row, minlength=hi - lo)
                i = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                keep = i < (n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)[row]
                bare = np.flatnonzero(n == 0)
                row, h, i = np.r_[row[keep], bare], np.r_[h[keep].view(np.int64), np.zeros(len(bare), np.int64)], np.r_[i[keep], np.zeros(len(bare), np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(names[lo:hi][row]), pa.array(n[row].astype(np.int32)), pa.array(i.astype(np.int32))], names=["w", "node", "n", "i"])

    return run


def _shingles(text: str, k: int) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def _similar(k: int, threshold: float):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("ta"), b.column("tb"), strict=True):
                p, q = _shingles(x.as_py(), k), _shingles(y.as_py(), k)
                n = len(p & q)
                keep.append(n >= threshold * (len(p) + len(q) - n) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_links(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """node, root: the groups of texts (columns node and _lm_text) under all pairs with a similarity of ``threshold``.

    Two such texts share one of their rarest shingles (the prefixes). Rounds
    of hubs come first: each text is verified against one text of each of its
    postings, so that groups of copies are joined with linear work. Then all
    pairs of a posting that verified links have not joined are verified.
    """
    classes = rarity_classes(docs, _count_shingles(k))
    posts = docs.mapInArrow(_prefixes(classes, k, threshold), "w long, node long, n int, i int").dropDuplicates(["w", "node"])
    posts = written(posts, "postings")
    repeated = posts.groupBy("w").count().where("count > 1").select("w")
    posts = written(posts.join(repeated, "w"), "postings")
    # shingles that two sets must share, and those that they can share from a first common one on
    least = F.ceil(threshold / (1 + threshold) * (F.col("n") + F.col("m")) - 1e-9)
    close = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= least

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.where(close).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "candidates")
        wanted = small_side(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        texts = written(docs.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "texts")
        pairs = pairs.join(texts.select(F.col("node").alias("a"), F.col("_lm_text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("_lm_text").alias("tb")), "b")
        return written(pairs.select("a", "b", "ta", "tb").mapInArrow(_similar(k, threshold), "a long, b long"), "similar")

    edges = roots = before = None
    turn = 0
    while True:
        live = posts if roots is None else posts.join(roots, "node", "left")
        live = live.withColumn("root", F.col("node") if roots is None else F.coalesce("root", "node"))
        if roots is not None:
            unjoined = live.groupBy("w", "root").agg(F.count("*").cast("double").alias("c")).groupBy("w").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("s")).where("c * c > s")
            live = written(live.join(unjoined.select("w", ((F.col("c") * F.col("c") - F.col("s")) / 2).alias("pairs"), F.col("c").alias("held")), "w"), "live")
            size = live.agg(F.sum(F.col("pairs") / F.col("held")).alias("pairs"), F.count("*").alias("rows")).first()
            if not size["rows"]:
                return roots
            if size["pairs"] <= FEW * size["rows"] or (before is not None and size["pairs"] > before / 2):
                break
            before = size["pairs"]
        turn += 1
        hub = live.groupBy("w").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("x"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("at"))).alias("h"))
        new = verified(live.join(hub.select("w", "h.*"), "w").where("root != at"))
        edges = new if edges is None else edges.unionAll(new)
        roots = components(edges)
    other = live.select("w", F.col("node").alias("other"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("at"))
    return components(edges.unionAll(verified(live.join(other, "w").where("node < other and root != at"))))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near duplicates the one with the smallest id.

    Equal texts are one node. Nodes are linked if the Jaccard similarity of
    their sets of k-word shingles is ``threshold`` or more; no such pair is
    left out, and groups are what the links join. Rows that repeat id and text
    count once; texts without words are one group.
    """
    names = docs.columns
    docs, inner = apart(docs)
    text = F.coalesce(F.col(inner[text_col]), F.lit(""))
    node = F.xxhash64(text)
    ids = docs.select(F.col(inner[id_col]).alias("d"), node.alias("node"))
    nodes = written(ids.groupBy("node").agg(F.min("d").alias("d")), "nodes")
    roots = near_links(docs.select(node.alias("node"), text.alias("_lm_text")), k, threshold)
    named = nodes.join(roots, "node", "left").select("node", "d", F.coalesce("root", "node").alias("root"))
    stay = written(named.groupBy("root").agg(F.min(F.struct(F.col("d"), F.col("node"))).alias("x")).select("x.d", "x.node"), "stay")
    out = docs.join(small_side(stay), F.col(inner[id_col]).eqNullSafe(F.col("d")) & (node == F.col("node")), "left_semi")
    repeats = ids.groupBy("d", "node").count().where("count > 1").limit(1).count()
    if repeats:
        out = out.withColumn("node", node).dropDuplicates([inner[id_col], "node"])
    return out.select(*[F.col(inner[c]).alias(c) for c in names])


def op6(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("_lm_fp")), 16, "0").alias("fingerprint"), "component_id")
