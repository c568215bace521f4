"""Helpers that several operators share: shared storage, skew-safe joins, Arrow batches."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import delete, fresh_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table: A-Z to a-z, all else as it is.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A key is hot from this share of all rows on; so at most that many keys can be hot.
HOT_KEYS = 1000


def cut(df: DataFrame, name: str = "cut", scan: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: ends the lineage and survives lost executors.

    What comes of a shuffle is written by a few tasks a core, or an eighth of the shuffle's, so that thin tables don't become thousands of small files.
    scan: df is a pass over an input, whose own tasks write it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if not scan:
        df = df.coalesce(max(4 * spark.sparkContext.defaultParallelism, shuffles(spark) // 8))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that cut() wrote and no later job reads."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            delete(table.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let the driver drop shuffle files and checkpoints that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take Spark's fast path."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def skew_join(facts: DataFrame, groups: DataFrame, keys: list[str], weight: str, unique: Column, total: int | None = None) -> DataFrame:
    """Left join facts to groups (one row a key) when some keys hold a large share of the facts.

    groups[weight] is the number of facts of its key. Keys with 1/HOT_KEYS of all facts or more are at most
    HOT_KEYS rows, so those are broadcast whatever the size of the data; the rest are joined by shuffling, where no
    key can fill a task. Facts that met a hot key shuffle under a salt of their own (from `unique`).
    groups should be materialised: it is read three times.
    """
    if total is None:
        total = groups.agg(F.sum(weight)).first()[0] or 0
    rest = [c for c in groups.columns if c not in keys]
    is_hot = F.col(weight) * HOT_KEYS >= F.lit(total)
    hot = groups.where(is_hot).select(*[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(c).alias(f"_h_{c}") for c in rest])
    cold = groups.where(~is_hot).select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.lit(0).cast("long").alias("_c_salt"), *[F.col(c).alias(f"_c_{c}") for c in rest])
    same = lambda side: reduce(and_, [F.col(k).eqNullSafe(F.col(f"{side}{k}")) for k in keys])
    met = facts.join(F.broadcast(hot), same("_h_"), "left")
    met = met.withColumn("_salt", F.when(F.col(f"_h_{weight}").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(unique)))
    out = met.join(cold, same("_c_") & (F.col("_salt") == F.col("_c_salt")), "left")
    return out.select(*[F.col(c) for c in facts.columns], *[F.coalesce(F.col(f"_h_{c}"), F.col(f"_c_{c}")).alias(c) for c in rest])


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b"" if t is None else t for t in col.cast(kind).to_pylist()]


def text_runs(batch: pa.RecordBatch, name: str, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """texts_of the batch in runs of about `most` bytes, each with its first row: what works on a run needs memory for a run, not for a batch."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(size, dtype=np.int64), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, texts_of(batch.slice(lo, hi - lo), name)
        lo = hi


def trim() -> None:
    """Give freed memory back to the system, as later stages use the same Python workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, which trims the worker's memory when it is through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        trim()

    return run


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and each text's start in it (with the end as last)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer(b"".join(texts), np.uint8), at


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA24BAED4963EE407)
    x ^= x >> np.uint64(32)
    return x


def random_table(seed: int, n: int = 256) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[int, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15 | 1


#: Bytes hashed at a time; each takes some 50 bytes of memory.
SLICE = 1 << 18
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64; kept from call to call but for words longer than a slice."""
    if n <= 2 * SLICE and _POWERS:
        return _POWERS[0], _POWERS[1]
    size, out = max(n, 2 * SLICE), []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        step = np.full(size, np.uint64(base))
        step[0] = 1
        out.append(np.multiply.accumulate(step))
    if n <= 2 * SLICE:
        _POWERS[0], _POWERS[1] = out
    return out[0], out[1]


_TABLE = random_table(20240601)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, and each text's first word (with the end as last)."""
    words, counts = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64)
    for of, part in _slices(texts):
        w, c = _word_hashes(part, lower)
        words.append(w)
        np.add.at(counts, of, c)
    return np.concatenate(words), np.concatenate([[0], np.cumsum(counts)])


def _slices(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts in slices of about SLICE bytes, with each part's text; long texts are cut at a blank."""
    of: list[int] = []
    part: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        lo = 0
        while lo < len(t):
            cut_at = _BLANK.search(t, lo + SLICE) if len(t) - lo > SLICE else None
            hi = cut_at.end() if cut_at else len(t)
            if part and size + hi - lo > SLICE:
                yield of, part
                of, part, size = [], [], 0
            of.append(i)
            part.append(t[lo:hi])
            size += hi - lo + 1
            lo = hi
    if part:
        yield of, part


def _word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    blob = b" ".join(texts) + b" "
    if lower:
        blob = blob.translate(ASCII_LOWER)
    raw = np.frombuffer(blob, np.uint8)
    gap = _SPACE[raw]
    power, inverse = _powers(raw.size + 1)
    edge = np.empty(raw.size, bool)
    edge[0] = not gap[0]
    np.logical_and(~gap[1:], gap[:-1], out=edge[1:])
    start = np.flatnonzero(edge)
    edge[0] = False
    np.logical_and(gap[1:], ~gap[:-1], out=edge[1:])
    end = np.flatnonzero(edge)
    total = np.zeros(raw.size + 1, np.uint64)
    np.cumsum(_TABLE[raw] * power[: raw.size], out=total[1:])
    h = mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    return h, np.diff(np.searchsorted(start, first))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length of every row, one after the other."""
    ends = np.cumsum(lengths)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    rows = np.flatnonzero(lengths)
    if rows.size == 0:
        return out[:0]
    s, n = starts[rows], lengths[rows]
    out[0] = s[0]
    at = np.cumsum(n)[:-1]
    out[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)
