"""Sequence packing: concatenate and cut (op 5).

Two passes.  The first tokenizes each partition once and writes the ids, with each document's
offset within its partition, to the shared folder.  The partition totals (one row a
partition) give every partition its place in one long row of ids, so each document knows its
global offset without a sort or shuffle of tokens.  The second pass cuts that row into fixed
windows: sequence ``k`` holds ids ``[k * length, (k + 1) * length)``, and each document yields
one boundary record for every window it touches.  Only the last sequence is padded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthkit.llm.base import cut_lineage, give_back_now, partition_offsets, ragged, ship
from depthkit.llm.bpe import SLICE, Vocabulary, crc_of, encode_batches, vocabulary_size

END_ID = 2
LENGTH = 4096
#: With ``lean``: bytes of text that are encoded at once, and distinct pieces that a task remembers.
LEAN_SLICE, LEAN_REMEMBER = 1 << 19, 1 << 18


def tokenized(df: DataFrame, path: str, end_id: int | None = END_ID, doc_id: str = "doc_id", text: str = "text",
              lean: bool = False) -> DataFrame:
    """(part, doc_id, local_start, n_tokens, ids) of every row, written once to the shared folder.

    ``ids`` are little-endian bytes of 16 bits where the vocabulary allows it, else of 32.
    ``part`` and ``local_start`` place a row within the rows its task saw.  Null texts are empty.
    With ``lean`` a task has smaller tables of its own and returns their memory when it ends, about half as much time again:
    workers live on through other stages, and each core of an executor has one beside the JVM."""
    ship(df.sparkSession)

    def run(batches):
        context = TaskContext.get()
        part, at = context.partitionId() if context else 0, 0
        kind = id_type(path)
        if lean:
            give_back_now()  # what earlier stages have left
        v = Vocabulary(path, LEAN_REMEMBER) if lean else None
        for batch, lo, hi, flat, counts in encode_batches(batches, path, v=v, limit=LEAN_SLICE if lean else SLICE):
            if end_id is not None:
                ends = np.cumsum(counts)
                out = np.empty(len(flat) + len(counts), kind)
                where = ends + np.arange(len(counts))
                out[where] = end_id
                rest = np.ones(len(out), bool)
                rest[where] = False
                out[rest] = flat
                counts = counts + 1
            else:
                out = flat.astype(kind)
            offs = np.concatenate([[0], np.cumsum(counts)])
            raw = (offs * out.itemsize).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(raw.tobytes()), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(counts), part), pa.int32()), batch.column(0).slice(lo, hi - lo),
                 pa.array(offs[:-1] + at, pa.int64()), pa.array(counts, pa.int64()), ids],
                ["part", "doc_id", "local_start", "n_tokens", "ids"])
            at += int(offs[-1])
        if lean:
            del v
            give_back_now()

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "part int, doc_id long, local_start long, n_tokens long, ids binary")
    return cut_lineage(rows, "tokens")


def id_type(path: str):
    return np.dtype("<u2") if vocabulary_size(path) <= 1 << 16 else np.dtype("<u4")


def global_starts(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``start``: the ids of all documents before each document."""
    place = partition_offsets(tokens, "part", "n_tokens")
    spark = tokens.sparkSession
    if not place:
        return tokens.withColumn("start", F.col("local_start"))
    part, before = zip(*sorted(place.items()))  # a row per partition; as Arrow, which needs no Python worker
    places = spark.createDataFrame(pa.table({"part": pa.array(part, pa.int32()), "before": pa.array(before, pa.int64())}))
    return tokens.join(F.broadcast(places), "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def pack(df: DataFrame, path: str, length: int = LENGTH, end_id: int | None = END_ID,
         doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` ids.

    Columns: doc_id, start (ids of the document before the piece), length, ids_crc32,
    doc_tokens, sequence_id, offset (place in the sequence), and ids (binary) on request.
    An empty or null text still has its end id; without an end id it has no piece.  Repeated
    rows are packed once each.  Which documents are neighbours follows the input's partitions."""
    spark = df.sparkSession
    tokens = global_starts(tokenized(df, path, end_id, doc_id, text, lean=True))
    kind = id_type(path)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches):
        for batch in batches:
            doc, n, start = (batch.column(i) for i in (0, 1, 2))
            n, start = n.to_numpy(), start.to_numpy()
            ids = batch.column(3)
            first, last = start // length, np.where(n > 0, (start + n - 1) // length, start // length - 1)
            per = last - first + 1
            owner = np.repeat(np.arange(len(n)), per)
            seq = ragged(first, per)
            lo = np.maximum(seq * length, start[owner])
            hi = np.minimum((seq + 1) * length, (start + n)[owner])
            offs = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1].astype(np.int64)
            flat = np.frombuffer(ids.buffers()[2], np.uint8)
            a = offs[owner] + (lo - start[owner]) * kind.itemsize
            b = a + (hi - lo) * kind.itemsize
            cut = [flat[x:y].view(kind) for x, y in zip(a.tolist(), b.tolist())]
            out = [doc.take(pa.array(owner)), pa.array(lo - start[owner]), pa.array(hi - lo),
                   pa.array([crc_of(x) for x in cut], pa.int64()), pa.array(n[owner]), pa.array(seq), pa.array(lo - seq * length)]
            yield pa.RecordBatch.from_arrays(out + [pa.array([x.tobytes() for x in cut], pa.binary())] * with_ids, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    ship(spark)
    return tokens.select("doc_id", "n_tokens", "start", "ids").mapInArrow(run, schema + ", ids binary" * with_ids)
