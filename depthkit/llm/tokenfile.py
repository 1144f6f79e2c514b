"""Token files: canonical length-limited Huffman coding of ids (op 10).

A file set is a folder of Parquet files in ascending order of documents; each row is a block
that can be decoded alone:

* ``first``, ``n_tokens``: place of its first id in the whole row of ids, and its ids;
* ``doc_ids``, ``doc_tokens``: documents that lie in the block (whole, or a part of a long one)
  and how many of the block's ids each has; ``doc_start``: global start of each document;
* ``bits``: the coded ids; ``checkpoints``: bit offset of every ``STRIDE``-th id.

The code comes from counts over all documents and is stored once (``lengths``: code length of
each id), which is all that a canonical code needs.  Decoding reads the ids from every
checkpoint in step with one table lookup per id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthkit.llm.base import scratch_path, ship
from depthkit.llm.bpe import vocabulary_size
from depthkit.llm.packing import END_ID, global_starts, id_type, tokenized

#: Longest code in bits; 2**LIMIT table entries decode any code at once.
LIMIT = 18
STRIDE = 256
#: Ids of a block at most.
BLOCK = 1 << 17
SCHEMA = ("first long, n_tokens long, doc_ids array<long>, doc_start array<long>, doc_total array<long>, "
          "doc_tokens array<long>, bits binary, checkpoints array<long>")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code length of each symbol: Huffman's, then shortened to ``limit`` bits.

    Symbols with count 0 get 0 (no code); a lone symbol gets 1 bit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need more than {limit} bits")
    if len(used) <= 1:
        out[used] = 1
        return out
    heap = [(int(counts[s]), k) for k, s in enumerate(used)]
    heapq.heapify(heap)
    up, n = [0] * (2 * len(used) - 1), len(used)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        up[a[1]] = up[b[1]] = n
        heapq.heappush(heap, (a[0] + b[0], n))
        n += 1
    depth = [0] * n
    for k in range(n - 2, -1, -1):
        depth[k] = depth[up[k]] + 1
    lens = np.minimum(depth[:len(used)], limit)
    # too long codes were cut: lengthen the rarest shorter codes until the code space fits
    room = (1 << limit) - int((1 << (limit - lens)).sum())
    order = np.lexsort((used, counts[used]))
    while room < 0:
        free = order[lens[order] < limit]
        best = free[np.argmax(lens[free])]
        room += 1 << int(limit - lens[best] - 1)
        lens[best] += 1
    # give what is left to the most frequent symbols that fit
    for k in order[::-1]:
        while lens[k] > 1 and (1 << (limit - lens[k])) <= room:
            room -= 1 << (limit - lens[k])
            lens[k] -= 1
    out[used] = lens
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of a canonical code: by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    code = prev = 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[s])
        if n:
            code <<= n - prev
            codes[s] = code
            code, prev = code + 1, n
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) for each next ``limit`` bits."""
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    width = 1 << (limit - lengths[used])
    symbols = np.zeros(1 << limit, np.int32)
    sizes = np.ones(1 << limit, np.int64)
    if not len(used):
        return symbols, sizes
    at = (codes[used].astype(np.int64)) << (limit - lengths[used])
    filled = np.repeat(used, width)
    symbols[at[0]:at[0] + len(filled)] = filled
    sizes[at[0]:at[0] + len(filled)] = lengths[filled]
    return symbols, sizes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Coded bits (most significant first, with 8 spare bytes) and the bit offset of every STRIDE-th id."""
    size = lengths[ids]
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    word, inside = starts >> 6, starts & 63
    code = codes[ids]
    spill = inside + size - 64
    high = np.where(spill <= 0, code << np.maximum(-spill, 0).astype(np.uint64), code >> np.maximum(spill, 0).astype(np.uint64))
    head = np.flatnonzero(np.diff(word, prepend=-1))
    if len(ids):
        words[word[head]] = np.bitwise_or.reduceat(high, head)
        over = np.flatnonzero(spill > 0)
        words[word[over] + 1] |= code[over] << (64 - spill[over]).astype(np.uint64)
    return words.astype(">u8").tobytes(), starts[::STRIDE]


def decode_block(bits: bytes, checkpoints: np.ndarray, n: int, symbols: np.ndarray, sizes: np.ndarray,
                 limit: int = LIMIT) -> np.ndarray:
    """All ids of a block, one id of every checkpoint's run at a time."""
    runs = len(checkpoints)
    if not n:
        return np.zeros(0, np.int32)
    raw = np.frombuffer(bits, np.uint8).astype(np.uint32)
    raw = np.concatenate([raw, np.zeros(8, np.uint32)])
    window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    out = np.zeros((STRIDE, runs), np.int32)
    at = checkpoints.astype(np.int64).copy()
    last = len(window) * 8 - 8
    for k in range(min(STRIDE, n)):
        part = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - limit)
        out[k] = symbols[part]
        at += sizes[part]
        np.minimum(at, last, out=at)
    return out.T.reshape(-1)[:n]


def _binary(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8), offs


def write(df: DataFrame, path: str, folder: str, end_id: int | None = END_ID, doc_id: str = "doc_id", text: str = "text",
          partitions: int | None = None, block: int = BLOCK) -> None:
    """Tokenize ``df`` in ascending order of documents and write it as a token file set.

    Equal ids keep some order among themselves; null ids come first; null texts are empty.
    A range partition sorts rows in pieces, so no task holds all of them."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = tokenized(rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id"), path, end_id)
    size, kind = vocabulary_size(path), id_type(path)

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            flat, offs = _binary(batch.column(0))
            total += np.bincount(flat[offs[0]:offs[-1]].view(kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r[0]] = r[1]  # at most one row per id of the vocabulary
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytes(lengths.astype(np.uint8)), LIMIT, STRIDE)], "lengths binary, `limit` int, stride int").coalesce(1).write.parquet(
        f"{folder}/code")

    def blocks(batches):
        codes, part, held, n = canonical(lengths), None, [], 0

        def flush():
            ids = np.concatenate([x[4] for x in held])
            bits, marks = encode_block(ids, codes, lengths)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([held[0][1] + held[0][3]]), pa.array([len(ids)], pa.int64()),
                 pa.array([[x[0] for x in held]], pa.list_(pa.int64())), pa.array([[x[1] for x in held]], pa.list_(pa.int64())),
                 pa.array([[x[2] for x in held]], pa.list_(pa.int64())), pa.array([[len(x[4]) for x in held]], pa.list_(pa.int64())),
                 pa.array([bits], pa.binary()), pa.array([marks.tolist()], pa.list_(pa.int64()))],
                ["part", "first", "n_tokens", "doc_ids", "doc_start", "doc_total", "doc_tokens", "bits", "checkpoints"])

        for batch in batches:
            flat, offs = _binary(batch.column(3))
            for k, (p, doc, start) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)))):
                ids = flat[offs[k]:offs[k + 1]].view(kind)
                if held and (p != part or start != held[-1][1] + held[-1][3] + len(held[-1][4])):
                    yield flush()
                    held, n = [], 0
                part = p
                for at in range(0, max(len(ids), 1), block):
                    cut = ids[at:at + block]
                    if held and n + len(cut) > block:
                        yield flush()
                        held, n = [], 0
                    held.append((doc, start, len(ids), at, cut))
                    n += len(cut)
        if held:
            yield flush()

    ordered = global_starts(tokens).select("part", "doc_id", "start", "ids")
    # a folder per range of documents, each written in order
    ordered.mapInArrow(blocks, f"part int, {SCHEMA}").write.partitionBy("part").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, at, total, ids): the ids of each document, or of each part of a long one, from a file set."""
    ship(spark)
    row = spark.read.schema("lengths binary, `limit` int, stride int").parquet(f"{folder}/code").first()
    lengths, limit = np.frombuffer(bytes(row[0]), np.uint8).astype(np.int64), row[1]

    def run(batches):
        symbols, sizes = decode_table(lengths, limit)
        for batch in batches:
            for b in range(batch.num_rows):
                first, n, docs, starts, totals, sizes_, bits, marks = (batch.column(i)[b] for i in range(8))
                ids = decode_block(bits.as_py(), np.asarray(marks.values), n.as_py(), symbols, sizes, limit)
                per = np.asarray(sizes_.values)
                offs = np.concatenate([[0], np.cumsum(per)])
                start = np.asarray(starts.values)
                at = first.as_py() + offs[:-1] - start
                yield pa.RecordBatch.from_arrays(
                    [docs.values, starts.values, pa.array(at), totals.values,
                     pa.Array.from_buffers(pa.binary(), len(per), [None, pa.py_buffer((offs * 4).astype(np.int32).tobytes()),
                                                                   pa.py_buffer(ids.astype("<u4").tobytes())])],
                    ["doc_id", "start", "at", "total", "ids"])

    return spark.read.schema(SCHEMA).parquet(f"{folder}/blocks").select(
        "first", "n_tokens", "doc_ids", "doc_start", "doc_total", "doc_tokens", "bits", "checkpoints").mapInArrow(
        run, "doc_id long, start long, at long, total long, ids binary")


def digests(parts: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document; documents cut over blocks are put together again.

    Only rows of documents longer than a block are shuffled; (start, doc_id) names a document,
    since every document has at least its end id."""
    whole = parts.where(F.length("ids") == 4 * F.col("total"))
    cut = parts.where(F.length("ids") != 4 * F.col("total"))
    joined = cut.groupBy("doc_id", "start", "total").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("p")).select(
        "doc_id", "start", "total", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
    return whole.select("doc_id", "start", "total", "ids").unionByName(joined).select(
        "doc_id", "start", F.col("total").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a token file set in the shared folder and read it back."""
    spark = df.sparkSession
    folder = scratch_path(spark, "tokenfile")
    write(df, path, folder)
    return digests(read_tokens(spark, folder))
