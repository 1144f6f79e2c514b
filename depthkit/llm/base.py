"""Shared helpers of the subpackage: shipping the code, scratch tables, text buffers.

Texts reach numpy as the UTF-8 buffer of an Arrow column, without a Python object per row.
Buffers are cut into slices of about ``SLICE_BYTES`` at document borders, so that memory per
task follows the longest text and not the size of a partition.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthkit.session import cut_lineage, scratch_path

SLICE_BYTES = 1 << 19
#: For networks that take a step in Python for each place of the longest row: fewer, longer slices.
WIDE_SLICE = 1 << 21


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


#: Bytes of a batch that a task and its Python worker hand each other, unless the session sets its own: Spark's 64 MB are held several
#: times over, in the JVM's buffers and in the worker.
BATCH_BYTES, _BATCH = 1 << 22, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application (a zip through addPyFile), and bound the session's batches."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if getattr(sc, "_depthkit_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "depthkit_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._depthkit_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) of consecutive rows of a string column.

    Null texts are empty.  ``offsets`` has one more entry than rows and starts at 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    n = len(col)
    if not n:
        return
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi
    give_back(int(offs[-1] - offs[0]))


#: Bytes of text after which a worker returns freed memory, and those since it last did.
GIVE_BACK = 1 << 24
_seen = [0]


def give_back(size: int) -> None:
    """Return freed memory to the system now and then: workers live through many stages, and allocators keep what they once had."""
    _seen[0] += size
    if _seen[0] >= GIVE_BACK:
        give_back_now()


def give_back_now() -> None:
    """Return freed memory to the system, and drop the powers that hashing keeps."""
    _seen[0] = 0
    _pow.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Flat indices start, start+1, ... of ragged rows, concatenated."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts - (ends - lens), lens)
    return out


# Polynomial hashes of byte spans, from one running sum per buffer.
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PI = np.uint64(pow(int(_P), -1, 1 << 64))
_LEN = np.uint64(0xC2B2AE3D27D4EB4F)
_pow: dict[str, np.ndarray] = {}
#: Powers that a worker keeps; those of a longer buffer are made for it and dropped.
_KEPT = (1 << 20) + 1
#: Bytes of a span that one polynomial covers; a longer span's parts are mixed one by one.
PART = 256


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow["p"]) < n:
        m = n if n > _KEPT else min(_KEPT, max(2 * n, 1 << 16))
        with np.errstate(over="ignore"):
            p = np.full(m, _P, np.uint64)
            p[0] = 1
            q = np.full(m, _PI, np.uint64)
            q[0] = 1
            p, q = np.multiply.accumulate(p), np.multiply.accumulate(q)
        if m > _KEPT:
            return p, q
        _pow["p"], _pow["i"] = p, q
    return _pow["p"], _pow["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    p, _ = _powers(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    s[1:] = data
    s[1:] += np.uint64(1)
    s[1:] *= p[:len(data)]
    np.cumsum(s[1:], out=s[1:])
    return s


def raw_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, the same wherever the span lies."""
    _, inv = _powers(len(sums))
    return (sums[ends] - sums[starts]) * inv[starts]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans.

    Polynomials modulo 2^64 have known pairs of long strings with equal values (those built like the
    Thue-Morse word, from 1,024 letters on), so a span of more than ``PART`` bytes is hashed in parts of that
    length, and the sum is over the parts' mixed hashes."""
    lens = (ends - starts).astype(np.uint64)
    sums = prefix_sums(data)
    out = mix(raw_hash(sums, starts, ends) ^ (lens * _LEN))
    long = np.flatnonzero(ends - starts > PART)
    if len(long):
        n = -(-(ends - starts)[long] // PART)
        part = ragged(np.zeros(len(long), np.int64), n)
        a = np.repeat(starts[long], n) + PART * part
        b = np.minimum(a + PART, np.repeat(ends[long], n))
        own = mix(raw_hash(sums, a, b) ^ ((b - a).astype(np.uint64) * _LEN))
        own = mix(own ^ (part.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
        out[long] = mix(np.add.reduceat(own, np.cumsum(n) - n) ^ (lens[long] * _LEN))
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words ``[^\\x20\\x09-\\x0D]+`` of each row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    cut = offs[:-1][(offs[:-1] < n)]
    begin[cut] = solid[cut]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    last = offs[1:][offs[1:] > 0] - 1
    stop[last] = solid[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def strings(values: list[bytes]) -> pa.Array:
    return pa.array([v.decode() for v in values], pa.string())


def partition_offsets(totals: DataFrame, part: str, n: str) -> dict[int, int]:
    """Second pass of a two-pass prefix sum: one row per partition, so bounded by their number."""
    rows = sorted((r[0], r[1]) for r in totals.groupBy(part).agg(F.sum(n)).collect())
    out, at = {}, 0
    for p, k in rows:
        out[p] = at
        at += k
    return out


__all__ = ["ship", "read", "text_slices", "ragged", "mix", "prefix_sums", "raw_hash", "span_hashes",
           "words", "strings", "partition_offsets", "cut_lineage", "scratch_path"]


def letter_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, starts, ends, rows) of the runs of letters of each row.

    ASCII letters and all characters beyond ASCII count as letters; ASCII and Latin-1 letters
    are lowered."""
    low = data | ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    upper = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    low[upper] += 32
    solid = ((low >= 97) & (low <= 122)) | (low >= 128)
    if not solid.any():
        z = np.zeros(0, np.int64)
        return low, z, z, z
    flag = np.ones(len(low), bool)
    flag[1:] = solid[1:] != solid[:-1]
    flag[offs[:-1][offs[:-1] < len(low)]] = True
    s = np.flatnonzero(flag)
    e = np.append(s[1:], len(low))
    keep = solid[s]
    s, e = s[keep], e[keep]
    return low, s, e, np.searchsorted(offs, s, "right") - 1


def fold(doc_id, folds: int = 5):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def labelled_sample(df: DataFrame, label: str, most: int, key: str = "doc_id") -> DataFrame:
    """About ``most`` rows of each label, chosen by a hash of ``key`` over all rows.

    The rate of each label is ``most`` / (its rows); one row per label reaches the driver."""
    sizes = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, most / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return df.where(F.col(label).isNotNull() & (draw < share))
