"""Shared pieces: table access, shared work folders, size-checked broadcasts, vectorised tokenising."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a slim table (a few longs a row) is sent to every executor; beyond it a shuffle join is used.
BROADCAST_ROWS = 500_000
#: UTF-8 bytes that the vectorised kernels handle at once (one document at least).
CHUNK_BYTES = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes as well as by rows, so very long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def give_back() -> None:
    """Memory that this process no longer uses goes back to the system; allocators would keep it for its next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def lean(run):
    """``run`` (batches -> batches) for mapInArrow; workers live on beside the next steps' memory, so each gives back what its task
    took."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir (or a checkpoint folder set before). Where neither is
    set, a temporary one is made for a local master; on a cluster that is an error, as executors would write elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="kindredge-")
    spark.sparkContext.setCheckpointDir(root)
    return root


class Work:
    """Intermediate tables of one operator call, written under the shared folder so that lost executors cost nothing.

    ``drop`` removes tables that later steps no longer read. What an operator's lazy result still reads stays until the
    caller removes it: with ``collected(held)`` the work tables of operators called within are listed in ``held``."""

    _scopes: list[list["Work"]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if Work._scopes:
            Work._scopes[-1].append(self)

    @classmethod
    @contextmanager
    def collected(cls, held: list["Work"]):
        cls._scopes.append(held)
        try:
            yield held
        finally:
            cls._scopes.pop()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.load(name, df.schema)

    def load(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names or ("",):
            p = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            p.getFileSystem(conf).delete(p, True)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` has ``rows`` slim rows (already counted): broadcast up to ``limit``, else left to a shuffle join."""
    return F.broadcast(df) if rows <= limit else df


# ---------------------------------------------------------------- vectorised tokenising

def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES):
    """(first, last) index ranges of consecutive texts of about ``limit`` bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n + 1
    if first < len(texts):
        yield first, len(texts)


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, CHUNK_BYTES + 4096)
        a = np.full(n, _P, np.uint64)
        a[0] = 1
        _pow = np.multiply.accumulate(a)
        a[1:] = _PINV
        _inv = np.multiply.accumulate(a)
    return _pow, _inv


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of A-Z-lower-cased UTF-8 texts, and each text's first word.

    Returns (hashes, bounds): text i has hashes[bounds[i]:bounds[i + 1]]."""
    joined = (b" " + b" ".join(t or b"" for t in texts) + b" ").translate(_LOWER)
    buf = np.frombuffer(joined, np.uint8)
    solid = buf != 32
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _powers(len(buf))
    total = np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)])
    h = mix64((total[ends - 1] - total[starts - 1]) * inverse[starts] + (ends - starts).astype(np.uint64))
    at = np.cumsum([1] + [len(t or b"") + 1 for t in texts])
    return h, np.searchsorted(starts, at)


def shingle_sets(texts: list[bytes | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as sorted 64-bit hashes; a text of fewer words is one shingle.

    Returns (hashes, bounds) as ``word_hashes`` does."""
    words, bounds = word_hashes(texts)
    n = len(words) - k + 1
    if n > 0:
        h = words[:n].copy()
        for j in range(1, k):
            h *= np.uint64(0x9FB21C651E98DF25)
            h += words[j: n + j]
        h = mix64(h)
    out, sizes = [], np.zeros(len(texts) + 1, np.int64)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b - a >= k:
            s = np.sort(h[a: b - k + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            short = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    short = short * np.uint64(0x9FB21C651E98DF25) + w
            s = mix64(np.array([short]))
        else:
            continue
        out.append(s)
        sizes[i + 1] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)
