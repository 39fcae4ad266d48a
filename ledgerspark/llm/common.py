"""Shared helpers of the training-data operators: storage, size checks, vectorised words.

Everything here keeps memory bounded by a fixed chunk size plus the longest
single text, and reads or writes only through Spark or Arrow batches.
"""

from __future__ import annotations

import atexit
import gc
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most this many narrow rows (under about 64 MB).
BROADCAST_ROWS = 500_000
#: Bytes of text that the vectorised helpers look at in one go.
CHUNK_BYTES = 1 << 20
#: Per thread, the list (``made``) to which scratch folders are noted.
_noting = threading.local()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = "/tmp/ledgerspark-checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone by then; the folder is scratch space
        pass


def _sweep(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing refers to any more go with the driver's garbage, which takes two rounds."""
    gc.collect()
    for pause in (0.3, 0.0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Unlike a local checkpoint the result survives a lost executor. The files
    go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    kind = df.schema
    df.write.parquet(path)
    del df
    _sweep(spark)
    atexit.register(_remove, spark, path)
    _note("", path)
    return spark.read.schema(kind).parquet(path)


@contextmanager
def noted() -> Iterator[list]:
    """The list of what ``written`` and ``bucketed`` make meanwhile in this thread, for ``drop_noted``."""
    before, _noting.made = getattr(_noting, "made", None), []
    try:
        yield _noting.made
    finally:
        _noting.made = before


def _note(name: str, path: str) -> None:
    if getattr(_noting, "made", None) is not None:
        _noting.made.append((name, path))


def drop_noted(spark: SparkSession, made: list, but: DataFrame) -> None:
    """Delete the folders of a list of ``noted``, except those that ``but`` reads; these stay in the list."""
    held = {f.rstrip("/").rsplit("/", 2)[-2] for f in but.inputFiles()}
    for item in list(made):
        if item[1].rsplit("/", 1)[1] not in held:
            _forget(spark, *item) if item[0] else _remove(spark, item[1])
            made.remove(item)


def _forget(spark: SparkSession, name: str, path: str) -> None:
    try:
        spark.sql(f"drop table if exists {name}")
    except Exception:  # the session may be gone by then, and with it a catalogue in memory
        pass
    _remove(spark, path)


def bucketed(df: DataFrame, key: str, n: int, label: str, name: str | None = None, ordered: bool = False) -> DataFrame:
    """``written`` in ``n`` buckets of a key: joins and aggregations on the key (and more) need no shuffle.

    ``df`` should be partitioned by the key into ``n``, so that each task writes one file.
    Frames with the same ``name`` go into one table. ``ordered`` sorts each file by the key.
    """
    spark = df.sparkSession
    name = name or f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    to = df.write.mode("append").bucketBy(n, key)
    (to.sortBy(key) if ordered else to).format("parquet").option("path", path).saveAsTable(name)
    del df
    _sweep(spark)
    atexit.register(_forget, spark, name, path)
    _note(name, path)
    return spark.table(name)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a frame made by ``written`` that nothing reads any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        _remove(df.sparkSession, f)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a check of the size; larger sides are left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_rows(df: DataFrame, array: str, rows: int = 200_000, items: int = 4_000_000) -> DataFrame:
    """Broadcast hint for rows with an array, behind a check of the rows and of all items together."""
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(array)), F.lit(0)).alias("m")).first()
    return F.broadcast(df) if size["n"] <= rows and size["m"] <= items else df


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named by their place, and the name that each has now, so that no column can clash with the operator's own."""
    names = [f"_in{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inv)):
                x = np.full(m, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_P_BYTE, _P_WORD = Powers(0x9E3779B97F4A7C15 | 1), Powers(0xD6E8FEB86659FD93 | 1)


def arrow_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("").cast(pa.large_string())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of about ``limit`` bytes; a longer row stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a run of texts, with a 64-bit hash each.

    ``row[i]`` is the text of word i; ``first[r]:first[r+1]`` are the words of
    text r.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = False):
        offs = offs - offs[0]
        n = len(buf)
        sp = _SPACE[buf]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.empty(n, bool)
        before[:1] = True
        before[1:] = sp[:-1]
        after = np.empty(n, bool)
        after[-1:] = True
        after[:-1] = sp[1:]
        self.start = np.flatnonzero(~sp & (before | edge[:n]))
        self.end = np.flatnonzero(~sp & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offs)
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))
        up, down = _P_BYTE.upto(n + 1)
        p = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[buf] if lower else buf] * up[:n], out=p[1:])
        self.hash = mix((p[self.end] - p[self.start]) * down[self.start])

    def runs(self) -> np.ndarray:
        """Prefix sums from which ``run_hash`` takes the hash of any run of words."""
        n = len(self.hash)
        up, _ = _P_WORD.upto(n + 1)
        q = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * up[:n], out=q[1:])
        return q


def run_hash(q: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, down = _P_WORD.upto(len(q))
    return mix((q[stop] - q[start]) * down[start])
