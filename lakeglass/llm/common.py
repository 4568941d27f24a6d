"""What the operators share: words, hashes, compact byte columns and tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"\w+")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset, as in tests, one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = sc.getCheckpointDir()
        if own is None:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="lakeglass-"))
            own = sc.getCheckpointDir()
        named = own
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/lakeglass/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: its lineage ends, and a lost executor loses nothing of it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets the shuffle files of queries that have ended go: they stay as long as their plans, which Python, events still under way and the JVM's garbage hold."""
    gc.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.sparkContext._jvm.System.gc()


_BYTE = np.zeros(256, bool)
_BYTE[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_", *range(128, 256)]] = True
_VALUE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes that are hashed at once.
CHUNK = 1 << 20


def _powers(n: int, base: np.uint64, held: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    if len(held.get(int(base), ())) < n:
        p = np.full(max(n, 2 * CHUNK), base)
        p[0] = 1
        held[int(base)] = np.cumprod(p)
    return held[int(base)][:n]


#: A word as hashed_words sees it, in text in lower case.
HASHED_WORD = re.compile("[0-9a-z_\u0080-\U0010ffff]+")


def hashed_spans(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """hashed_words, and besides the bytes of the portion and the places where each word begins and ends in them."""
    held, size, first = [], 0, 0
    for k, t in enumerate([*texts, None]):
        if t is None or (held and (size > CHUNK or len(held) == 1 << 15)):
            raw = np.frombuffer(b"\n".join(held) + b"\n", np.uint8) if held else np.empty(0, np.uint8)
            edge = np.flatnonzero(np.diff(_BYTE[raw].view(np.int8), prepend=0, append=0))
            start, end = edge[::2], edge[1::2]
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_VALUE[raw] * _powers(len(raw), _STEP), out=sums[1:])
            words = mix((sums[end] - sums[start]) * _powers(len(raw), _BACK)[start]) if len(start) else np.empty(0, np.uint64)
            ends = np.searchsorted(start, np.cumsum([len(x) + 1 for x in held]))
            if held:
                yield first, words, ends, raw, start, end
            held, size, first = [], 0, k
        if t is not None:
            held.append(x := t.lower().encode("utf-8", "surrogatepass"))
            size += len(x)


def hashed_words(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, 64-bit hashes of all words of some texts, places where each text's words end) for portions of the texts.

    A word is a run of ASCII letters, digits, underscores and characters beyond ASCII, in lower case. All words of a
    portion are hashed at once: a polynomial in their bytes, taken from its running sums.
    """
    for first, words, ends, *_ in hashed_spans(texts):
        yield first, words, ends


def trim() -> None:
    """Gives memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in portions of so many rows, so that no more texts than these are Python strings at once."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def mix(a: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finaliser of splitmix64)."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns of one length as compressed byte planes."""
    raw = b"".join(np.ascontiguousarray(np.frombuffer(c.tobytes(), np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), 0, []
    for k in kinds:
        w = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).ravel())
        at += n * w
    return out
