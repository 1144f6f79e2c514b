"""Quality rules: compression bands (op 3).

A text passes the base rules if it has enough words and does not mostly repeat its own
three-word windows.  The method then compresses the whole text, and each chunk of
``CHUNK`` bytes, with zstandard: a ratio (compressed / raw bytes) below the band of the text's
length means repetition, one above it means noise such as encoded binary data.  Short texts
compress less, so every length class has limits of its own.

The limits are learned (``learn``) from all rows labelled clean, as quantiles of their ratios with
a margin.  ``Bands()`` holds wide limits for classes that these rows do not reach, and for inputs without labels.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthkit.llm.base import fold, mix, ship, span_hashes, text_slices, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Lengths in bytes at which the learned classes begin; the last one is open.
EDGES = (0, 128, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096, 6144, 8192, 12288, 16384, 24576, 32768, 49152, 65536, 1 << 17, 1 << 18)
#: Texts (or chunks) a class needs to have learned limits.
CLASS_TEXTS = 20
#: A limit is this quantile of the clean ratios, moved outwards by a share of its distance from the median.
QUANTILE, MARGIN_LOW, MARGIN_HIGH, MARGIN_CHUNK = 0.01, 0.25, 1.0, 1.0
_BINS = 10_000


@dataclass(frozen=True)
class Bands:
    """Limits of the compression ratio by length in bytes: (shorter than, least, most).

    The values here are wide; ``learn`` narrows them."""

    whole: tuple = ((128, 0.0, 9.0), (256, 0.35, 1.2), (512, 0.32, 0.95), (1024, 0.28, 0.85), (2048, 0.25, 0.80),
                    (4096, 0.22, 0.75), (16384, 0.18, 0.70), (1 << 62, 0.12, 0.70))
    #: limits for chunks, and the share of chunks that may lie outside them
    chunk: tuple = (0.15, 0.72)
    chunk_share: float = 0.25
    chunk_bytes: int = 4096
    level: int = 3
    min_words: int = 50
    repeat_percent: int = 50


def base_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each row of a slice, all from its bytes at once."""
    rows = len(offs) - 1
    zero = np.zeros(rows, np.int64)
    out = dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), zero)
    if not len(data):
        return out
    s, e, row = words(data, offs)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    signs = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    out["n_words"] = np.bincount(row, minlength=rows)
    out["word_chars"] = np.bincount(row, points[e] - points[s], rows).astype(np.int64)
    out["n_symbols"] = signs[offs[1:]] - signs[offs[:-1]]
    if not len(s):
        return out
    # lines
    breaks = data == 10
    first = np.unique(np.concatenate([offs[:-1][offs[:-1] < len(data)], np.flatnonzero(breaks[:-1]) + 1]))
    line_row = np.searchsorted(offs, first, "right") - 1
    last = np.append(first[1:], len(data))
    last = last - breaks[last - 1]
    full = np.zeros(len(first), bool)
    full[np.searchsorted(first, s, "right") - 1] = True
    first, last, line_row = first[full], last[full], line_row[full]
    salt = mix(np.arange(rows, dtype=np.uint64) + np.uint64(0x51ED270B))
    keyed = span_hashes(data, first, last) ^ salt[line_row]
    order = np.argsort(keyed)
    key, of = keyed[order], line_row[order]
    again = np.flatnonzero(key[1:] == key[:-1]) + 1
    out["n_dup_lines"] = np.bincount(of[again], minlength=rows)
    # windows of three words
    if len(s) > 2:
        h = span_hashes(data, s, e)
        inside = row[2:] == row[:-2]
        a = np.flatnonzero(inside)
        key = mix(mix(mix(h[a]) + h[a + 1]) + h[a + 2]) ^ salt[row[a]]
        order = np.argsort(key)
        k = key[order]
        same = k[1:] == k[:-1]
        twice = np.zeros(len(k), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = a[order[twice]]
        cover = np.zeros(len(s), bool)
        cover[at] = cover[at + 1] = cover[at + 2] = True
        out["n_repeat_words"] = np.bincount(row[cover], minlength=rows)
    return out


def limits(bands: Bands, n: int) -> tuple[float, float]:
    return next((lo, hi) for below, lo, hi in bands.whole if n < below)


def chunk_ratios(raw: bytes, bands: Bands, packer) -> list[float]:
    """Ratios of chunks of equal size; the last one ends where the text ends and may overlap the one before it."""
    n, size = len(raw), bands.chunk_bytes
    starts = [min(k, n - size) for k in range(0, n, size)] if n > size else []
    return [len(packer.compress(raw[k:k + size])) / size for k in starts]


def verdict(raw: bytes, bands: Bands, packer) -> tuple[float, float, bool]:
    """(ratio of the whole text, share of chunks outside their band, within all bands)."""
    n = len(raw)
    if not n:
        return 0.0, 0.0, False
    whole = len(packer.compress(raw)) / n
    low, high = limits(bands, n)
    parts = chunk_ratios(raw, bands, packer)
    share = sum(not bands.chunk[0] <= part <= bands.chunk[1] for part in parts) / len(parts) if parts else 0.0
    return whole, share, low <= whole <= high and share <= bands.chunk_share


def _limits_of(counts: dict[int, int], low: float, high: float) -> tuple[float, float]:
    """Limits around the ratios of a histogram, by quantiles with margins."""
    at = np.array(sorted(counts))
    seen = np.cumsum([counts[int(k)] for k in at])
    a, m, b = (at[np.searchsorted(seen, q * seen[-1])] / _BINS for q in (QUANTILE, 0.5, 1 - QUANTILE))
    return float(a - low * (m - a)), float(b + high * (b - m))


def learned(histogram: dict[int, dict[int, int]], bands: Bands = Bands()) -> Bands:
    """Bands with limits from clean ratios: {class (-1 for chunks): {ratio in ``_BINS``: texts}}.

    A class with fewer than CLASS_TEXTS of them keeps the wide limits of ``bands``: ratios fall with the
    length, so limits of a neighbouring class cost clean texts (21 instead of 5 of 3,243 at sf0.1)."""
    own = {c: _limits_of(seen, MARGIN_LOW, MARGIN_HIGH) for c, seen in histogram.items() if c >= 0 and sum(seen.values()) >= CLASS_TEXTS}
    whole = []
    for c, (lo, hi) in enumerate(zip(EDGES, (*EDGES[1:], 1 << 62))):
        whole.append((hi, *own.get(c, limits(bands, lo))))
    parts = histogram.get(-1, {})
    chunk = _limits_of(parts, MARGIN_CHUNK, MARGIN_CHUNK) if sum(parts.values()) >= CLASS_TEXTS else bands.chunk
    return replace(bands, whole=tuple(whole), chunk=chunk)


def learn(docs: DataFrame, labels: DataFrame, bands: Bands = Bands(), folds: int = 5, held: int = 0) -> Bands:
    """Bands from all texts labelled clean (quality 1) outside the held-out fold.

    Texts become ratios where they are, and only ratios with their ids are joined with the labels, so neither texts
    nor all ids are shipped; one count per class and ratio reaches the driver.  Labels without a
    quality, or none, leave the wide limits."""
    if "quality" not in labels.columns:
        return bands
    ship(docs.sparkSession)
    known = labels.where((fold(F.col("doc_id"), folds) != held) & F.col("quality").isin(0, 1)).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.where("quality = 1").select("doc_id")

    def run(batches):
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for lo, _, data, offs in text_slices(batch.column(1)):
                failed, raw = base_failed(base_counts(data, offs), bands), data.tobytes()
                at, c, ratio = [], [], []
                for r in np.flatnonzero(~failed):
                    t = raw[offs[r]:offs[r + 1]]
                    parts = chunk_ratios(t, bands, packer)
                    at += [lo + int(r)] * (1 + len(parts))
                    c += [int(np.searchsorted(EDGES, len(t), "right")) - 1] + [-1] * len(parts)
                    ratio += [len(packer.compress(t)) / len(t), *parts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(c, pa.int32()),
                     pa.array(np.round(np.array(ratio) * _BINS).astype(np.int32), pa.int32())], ["doc_id", "c", "ratio"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # one row for each document, class and ratio before the join
    ratios = texts.where(fold(F.col("doc_id"), folds) != held).mapInArrow(run, "doc_id long, c int, ratio int").groupBy("doc_id", "c", "ratio").count()
    histogram: dict[int, dict[int, int]] = {}
    for c, ratio, n in ratios.join(chosen, "doc_id").groupBy("c", "ratio").agg(F.sum("count").alias("n")).collect():
        histogram.setdefault(c, {})[ratio] = n
    return learned(histogram, bands)


def base_failed(c: dict[str, np.ndarray], bands: Bands) -> np.ndarray:
    return (c["n_words"] < bands.min_words) | (100 * c["n_repeat_words"] > bands.repeat_percent * c["n_words"])


def _measured(col: pa.Array, bands: Bands):
    """For each slice of a text column: its rows, counts, ratios and verdicts."""
    packer = zstandard.ZstdCompressor(level=bands.level)
    for lo, hi, data, offs in text_slices(col):
        c = base_counts(data, offs)
        failed = base_failed(c, bands)
        raw = data.tobytes()
        seen = [verdict(raw[a:b], bands, packer) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        c |= {"ratio": np.array([x[0] for x in seen]), "chunks_outside": np.array([x[1] for x in seen])}
        yield lo, hi, c, failed, ~failed & np.array([x[2] for x in seen], bool)


def assess(df: DataFrame, bands: Bands = Bands(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, ratios and verdict of every row's whole text.

    A null or empty text has no words, fails the base rules and is not kept.  Rows are
    independent: repeated rows give repeated results, null ids stay null."""
    ship(df.sparkSession)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    names = ["doc_id", *counts, "base_failed", "kept", "ratio", "chunks_outside"]

    def run(batches):
        for batch in batches:
            for lo, hi, c, failed, kept in _measured(batch.column(1), bands):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(c[k], pa.int64()) for k in counts), pa.array(failed),
                     pa.array(kept), pa.array(c["ratio"]), pa.array(c["chunks_outside"])], names)

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in counts) + ", base_failed boolean, kept boolean, ratio double, chunks_outside double"
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def keep(df: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text passes."""
    ship(df.sparkSession)
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            for lo, hi, _, _, kept in _measured(batch.column(at), bands):
                yield batch.slice(lo, hi - lo).filter(pa.array(kept))

    return df.mapInArrow(run, df.schema)
